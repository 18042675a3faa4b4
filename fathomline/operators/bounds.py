"""Broadcasts of sides whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is sent to every task, at most; a larger one is shuffled as Spark sees fit.
SMALL = 100_000


def if_small(side: DataFrame, rows: int = SMALL) -> DataFrame:
    """side with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
