"""Forward curves: monthly strips from month, quarter, half-year and year quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import tenor as tn


def _map(values: dict) -> Column:
    return F.create_map(*[x for p, v in values.items() for x in (F.lit(p), F.lit(v))])


def _months(first: Column, year: Column, n: Column) -> Column:
    """The first days of n months from that month of that year."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.add_months(F.make_date(year, first, F.lit(1)), k))


def _shape(months: Column, years: Column, first: int, n: int) -> Column:
    """Prices of a period's months over their mean, in the first year of which all are quoted; null without one. months: start to price."""
    prices = F.transform(years, lambda y: F.transform(_months(F.lit(first), y, F.lit(n)), lambda d: F.try_element_at(months, d)))
    whole = F.filter(prices, lambda p: F.forall(p, lambda x: x.isNotNull()))
    over_mean = F.transform(whole, lambda p: F.transform(p, lambda x: x * n / F.aggregate(p, F.lit(0.0), lambda s, y: s + y)))
    return F.try_element_at(over_mean, F.lit(1))


def _gathered(quotes: DataFrame, by: list[str], after: Column | None) -> DataFrame:
    """One row for each group: months (start to price), longer quotes (period, year, price) and shapes (period to ratios or null). The lowest of several quotes counts; null ones don't."""
    tenor = F.col("tenor")
    rows = quotes.where(F.col("price").isNotNull() & tn.valid_tenor(tenor)).groupBy(*by, "tenor").agg(F.min("price").cast("double").alias("price"))
    start = tn.tenor_date(tenor)
    own = tn.is_month(tenor) if after is None else tn.is_month(tenor) & (start > after)
    month = F.when(own, F.struct(start.alias("start"), F.col("price").alias("price")))
    period = F.when(~tn.is_month(tenor), F.struct(tn.tenor_period(tenor).alias("period"), (2000 + tn.tenor_year(tenor)).alias("year"), F.col("price").alias("price")))
    out = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(month)).alias("months"), F.collect_list(period).alias("longer"))
    out = out.withColumn("years", F.array_sort(F.array_distinct(F.transform(F.map_keys("months"), F.year))))
    shapes = [x for p, (first, n) in tn.PERIODS.items() for x in (F.lit(p), _shape(F.col("months"), F.col("years"), first, n))]
    return out.withColumn("shapes", F.create_map(*shapes))


def shape_ratios(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, period, k, month, ratio): month price over period average in the first year whose months are all quoted, else 1. One row a group holds its quotes; no joins."""
    by = by or []

    def ratios(period: str, first: int, n: int) -> Column:
        own = F.try_element_at("shapes", F.lit(period))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit(period).alias("period"), k.alias("k"), ((k + (first - 1)) % 12 + 1).alias("month"), F.coalesce(F.get(own, k), F.lit(1.0)).alias("ratio")))

    return _gathered(quotes, by, None).select(*by, F.inline(F.concat(*[ratios(p, a, n) for p, (a, n) in tn.PERIODS.items()])))


def monthly_curve(quotes: DataFrame, pricing_date: str, by: list[str] | None = None) -> DataFrame:
    """(by, start, price) of all months: quoted ones after the pricing date, others from the first of Q1..Q4, SS, WS, Y that has them, times its shape.

    quotes: (by, tenor, price). They are read once and brought together in one row a
    group, in which arrays hold months, shapes and what is inferred. The lowest of
    several quotes of a tenor counts; null prices and unknown tenors don't.
    """
    by = by or []
    first, size, rank = (_map(m) for m in ({p: a for p, (a, _) in tn.PERIODS.items()}, {p: n for p, (_, n) in tn.PERIODS.items()}, {p: k for k, p in enumerate(tn.PERIODS, 1)}))

    def inferred(q: Column) -> Column:
        ratios = F.try_element_at("shapes", q["period"])
        starts = _months(first[q["period"]], q["year"], size[q["period"]])
        return F.transform(starts, lambda d, k: F.struct(d.alias("start"), (q["price"] * F.coalesce(F.get(ratios, k), F.lit(1.0))).alias("price"), rank[q["period"]].alias("rank")))

    own = F.transform(F.map_entries("months"), lambda e: F.struct(e["key"].alias("start"), e["value"].alias("price"), F.lit(0).alias("rank")))
    rows = _gathered(quotes, by, F.lit(pricing_date).cast("date")).select(*by, F.inline(F.concat(own, F.flatten(F.transform("longer", inferred)))))
    return rows.groupBy(*by, "start").agg(F.min_by("price", F.struct("rank", "price")).alias("price"))


def curve_times(curve: DataFrame, pricing_date: str) -> DataFrame:
    """The curve with x, years from the pricing date to the 15th of the month."""
    return curve.withColumn("x", tn.years_between(F.lit(pricing_date).cast("date"), F.date_add("start", 14)))


def off_peak(base: Column, peak: Column, peak_hours: Column, off_hours: Column) -> Column:
    """Off-peak price that with the peak price averages to the base price over all hours."""
    return (base * (peak_hours + off_hours) - peak * peak_hours) / off_hours


def local_vols(grid: DataFrame, by: list[str], forward: str, strike: str, tenor: str, vol: str) -> DataFrame:
    """grid with local_vol at the inner points of each group's rectangular grid of implied volatilities: Dupire's formula in total variance and log-moneyness, by differences with the neighbours; null at the edges and where the grid has an arbitrage."""
    out = grid.withColumns({"_k": F.ln(F.col(strike) / F.col(forward)), "_w": F.col(vol) ** 2 * F.col(tenor)})
    across, along = Window.partitionBy(*by, tenor).orderBy(strike), Window.partitionBy(*by, strike).orderBy(tenor)
    near = {f"_{c}{s}": f(c2).over(w) for c, c2, w in (("k", "_k", across), ("w", "_w", across), ("t", tenor, along), ("v", "_w", along)) for s, f in (("0", F.lag), ("1", F.lead))}
    out = out.withColumns(near)
    k, w, c = F.col("_k"), F.col("_w"), F.col
    a, b = k - c("_k0"), c("_k1") - k
    slope = (c("_w1") - w) / b * a / (a + b) + (w - c("_w0")) / a * b / (a + b)
    bend = 2 * ((c("_w1") - w) / b - (w - c("_w0")) / a) / (a + b)
    out = out.withColumns({"_s": slope, "_b": bend, "_r": (c("_v1") - c("_v0")) / (c("_t1") - c("_t0"))})
    down = 1 - k / w * c("_s") + (-0.25 - 1 / w + k * k / (w * w)) * c("_s") ** 2 / 4 + c("_b") / 2
    value = F.when((down > 1e-12) & (c("_r") > 0), F.sqrt(c("_r") / down))
    return out.select(*grid.columns, value.alias("local_vol"))
