"""The registered queries of the engine."""

from fathomline.plans import calendar, calibration, cargo, landed, markets, models, panels, pricing, records, series, sheets, simulations, sqltext  # noqa: F401
from fathomline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
