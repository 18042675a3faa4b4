"""Cargo flows: recap tables, origin-destination matrices and transit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = "TOTAL"


def within(start: str | None, end: str | None, column: str = "arrival") -> Column:
    """A closed range of dates, everything if a bound is missing."""
    return F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) if start and end else F.lit(True)


def with_total(rows: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """rows and one more that sums the (already rounded) measures."""
    total = rows.agg(*[F.sum(m).alias(m) for m in measures]).select(F.lit(TOTAL).alias(label), *measures)
    return rows.select(label, *measures).unionByName(total)


def by_region(visits: DataFrame, region: str = "dest_region", start: str | None = None, end: str | None = None) -> DataFrame:
    """Cargoes, tonnes and cubic metres of imports by region, unknown regions kept, with a TOTAL row."""
    rows = visits.where((F.lower("visit_type") == "import") & within(start, end))
    sums = rows.groupBy(region).agg(F.count("vessel").alias("cargoes"), F.round(F.sum("tonnes"), 2).alias("tonnes"), F.round(F.sum("volume"), 2).alias("volume"))
    return with_total(sums, region, ["cargoes", "tonnes", "volume"])


def recap(visits: DataFrame, as_of: str, days: list[int], region: str = "dest_region") -> DataFrame:
    """by_region sums for several windows that end on as_of, both ends counted, in one pass."""
    end = F.lit(as_of).cast("timestamp")

    def inside(n: int) -> Column:
        return F.col("arrival").between(end - F.expr(f"INTERVAL {n} DAYS"), end)

    rows = visits.where((F.lower("visit_type") == "import") & inside(max(days)))
    sums = [a for n in days for a in (F.count_if(inside(n)).alias(f"cargoes_{n}"), F.round(F.coalesce(F.sum(F.when(inside(n), F.col("tonnes"))), F.lit(0.0)), 2).alias(f"tonnes_{n}"))]
    return rows.groupBy(region).agg(*sums)


def matrix(visits: DataFrame, origin: str, destinations: list[str], destination: str = "dest_region") -> DataFrame:
    """Origin x destination sums with 0 for none, TOTAL column and TOTAL row; rows without origin or destination go."""
    known = visits.where((F.lower("visit_type") == "import") & F.col(origin).isNotNull() & F.col(destination).isNotNull())
    wide = known.groupBy(origin).pivot(destination, destinations).agg(F.round(F.sum("tonnes"), 2)).fillna(0.0)
    wide = wide.withColumn(TOTAL, sum((F.col(f"`{d}`") for d in destinations), F.lit(0.0)))
    return with_total(wide, origin, [*destinations, TOTAL])


def flow_table(visits: DataFrame, origin: str, destination: str) -> DataFrame:
    """Long form of the matrix: positive flows, largest first."""
    rows = visits.where((F.lower("visit_type") == "import") & F.col(origin).isNotNull() & F.col(destination).isNotNull())
    sums = rows.groupBy(F.col(origin).alias("origin"), F.col(destination).alias("destination")).agg(F.round(F.sum("tonnes"), 2).alias("value"))
    return sums.where("value > 0").orderBy(F.desc("value"), "origin", "destination")


def unpivot_matrix(wide: DataFrame, origin: str) -> DataFrame:
    """A wide matrix as (origin, destination, value) without totals and zeros."""
    values = [c for c in wide.columns if c not in (origin, TOTAL)]
    long = wide.unpivot([origin], values, "destination", "value").withColumnRenamed(origin, "origin")
    return long.where((F.col("origin") != TOTAL) & (F.col("value") > 0))


def in_transit(visits: DataFrame) -> Column:
    """Whether the destination says that the cargo is under way; unknown is no."""
    return F.coalesce(F.lower("dest_port").contains("transit"), F.lit(False))


def transit_list(visits: DataFrame, columns: list[str], order: str = "departure") -> DataFrame:
    """Cargoes under way, those of the wanted columns that exist, by departure with unknown ones last."""
    own = [c for c in columns if c in visits.columns]
    return visits.where(in_transit(visits)).select(*own).orderBy(F.asc_nulls_last(order))


def transit_by_origin(visits: DataFrame, country: str = "port_country") -> DataFrame:
    """Cargoes under way by country with a TOTAL row; nothing if none is under way."""
    rows = visits.where(in_transit(visits))
    sums = rows.groupBy(country).agg(F.count("vessel").alias("cargoes"), F.round(F.sum("tonnes"), 2).alias("tonnes"), F.round(F.sum("volume"), 2).alias("volume"))
    return with_total(sums, country, ["cargoes", "tonnes", "volume"]).where("tonnes is not null")


def transit_ages(visits: DataFrame, as_of: str, ages: dict[str, int], country: str = "port_country") -> DataFrame:
    """Cargoes and tonnes under way for at least n-1 days, one pair of columns for each labelled n, in one pass."""
    day = F.lit(as_of).cast("date")
    sums = []
    for label, n in ages.items():
        old = F.to_date("departure") <= F.date_sub(day, n - 1)
        sums += [F.count_if(old).alias(f"cargoes_{label}"), F.round(F.coalesce(F.sum(F.when(old, F.col("tonnes"))), F.lit(0.0)), 2).alias(f"tonnes_{label}")]
    return visits.where(in_transit(visits)).groupBy(country).agg(*sums).where(F.col(f"cargoes_{next(iter(ages))}") > 0)


def totals(flows: DataFrame) -> DataFrame:
    """Sums by origin and by destination in one pass: side, name, value."""
    grouped = flows.groupingSets([["origin"], ["destination"]], "origin", "destination").agg(F.sum("value").alias("value"), F.grouping("origin").alias("g"))
    return grouped.select(F.when(F.col("g") == 0, "origin").otherwise("destination").alias("side"), F.coalesce("origin", "destination").alias("name"), F.round("value", 2).alias("value"))


def share_layout(named: DataFrame, side: str = "side", name: str = "name", value: str = "value") -> DataFrame:
    """Share of each name in its side and where it begins when the largest is laid first."""
    own = Window.partitionBy(side)
    before = own.orderBy(F.desc(value), name).rowsBetween(Window.unboundedPreceding, -1)
    share = F.col(value) / F.sum(value).over(own)
    return named.withColumn("share", share).withColumn("begins", F.coalesce(F.sum("share").over(before), F.lit(0.0)))


def scaled(rows: DataFrame, names: dict[str, str], divide: dict[str, float], drop_with: str | None = None) -> DataFrame:
    """Columns renamed, some divided by a unit, and those whose name holds a text dropped."""
    out = rows.withColumnsRenamed(names)
    for c, unit in divide.items():
        out = out.withColumn(c, F.col(c) / unit)
    return out.drop(*[c for c in out.columns if drop_with and drop_with.lower() in c.lower()])
