"""Regasification netbacks, cargo prices and terminal slots from JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.staging import stage

#: Number fields of a netback, in the order of the document (fixed values of the format).
FIELDS = ("netbackTtfBasis", "netbackOutright", "totalRegasificationCost", "slotBerth", "slotUnloadStorageRegas", "slotBerthUnloadStorageRegas", "additionalStorage", "additionalSendout", "gasInKind", "entryCapacity", "commodityCharge")
PAGE = f"data array<struct<releaseDate:string,terminalUuid:string,monthIndex:string,deliveryMonth:string,{','.join(f'{f}:string' for f in FIELDS)}>>, metaData struct<terminals:map<string,string>>"
NETBACK = "releaseDate string, fobPort string, netbacks array<struct<neaMinusNwe:struct<outright:struct<usdPerMMBtu:string>>>>"


def netbacks(documents: DataFrame, column: str = "doc") -> DataFrame:
    """(release_date, terminal, month_index, delivery_month, each of FIELDS, variable_only) of pages of netbacks.

    Terminals get the names that their page has for them (null without one). A figure
    that can't be read is null. variable_only adds the berth slot once and the berth,
    unload, storage and regas slot twice to the basis, as the column has always been
    defined. Documents that can't be read give no row.
    """
    # out of a generator a document is read once; as a column it would be once for the filter and for each field that is taken
    page = documents.select(F.inline(F.array(F.from_json(column, PAGE)))).where("data is not null")
    rows = page.select(F.explode("data").alias("d"), F.col("metaData.terminals").alias("names"))
    own = rows.select(
        F.to_date("d.releaseDate").alias("release_date"),
        F.try_element_at("names", F.col("d.terminalUuid")).alias("terminal"),
        F.col("d.monthIndex").alias("month_index"),
        F.to_date("d.deliveryMonth").alias("delivery_month"),
        *[F.col(f"d.{f}").try_cast("double").alias(f) for f in FIELDS],
    )
    return own.withColumn("variable_only", F.col("netbackTtfBasis") + 2 * F.col("slotBerthUnloadStorageRegas") + F.col("slotBerth"))


def month_price(points: Column, month: Column) -> Column:
    """The element of an array of delivery periods that a month written M+k stands for, M+1 the first; null beyond the array."""
    k = F.regexp_extract(month, r"^M\+(\d+)$", 1).try_cast("int")
    return F.get(points, F.when(k > 0, k - 1))


def mean_netbacks(documents: DataFrame, months: int, column: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(release_date, port, value): the mean of the first months' differences of each document; and the documents that can't be read or have a figure that can't, for quarantine."""
    found = documents.select("*", F.from_json(column, NETBACK).alias("_n"))
    first = F.transform(F.slice("_n.netbacks", 1, months), lambda x: x["neaMinusNwe"]["outright"]["usdPerMMBtu"].try_cast("double"))
    found = found.withColumn("_v", first)
    good = F.coalesce(F.to_date("_n.releaseDate").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull()), F.lit(False))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v")
    return found.where(good).select(F.to_date("_n.releaseDate").alias("release_date"), F.col("_n.fobPort").alias("port"), mean.alias("value")), found.where(~good).drop("_n", "_v")


def willingness(rows: DataFrame, cargo: DataFrame, regions: DataFrame, default: str) -> DataFrame:
    """(release_date, terminal, wtp): a terminal's variable netback over the cargo price of its region.

    cargo (release_date, region, price): a day without a price takes the next one's,
    by region. regions (terminal, region); a terminal without one counts to `default`.
    Few terminals and regions a day: prices are filled on the days of netbacks. What is
    left of the rows is staged, as the join reads it more than once.
    """
    from fathomline.operators.asof import asof

    best = stage(rows.groupBy("release_date", "terminal").agg(F.max("variable_only").alias("_v")), "netbacks")
    own, cargo = best.join(regions, "terminal", "left").withColumn("region", F.coalesce("region", F.lit(default))), stage(cargo, "cargo-prices")
    priced = asof(own, cargo.withColumnRenamed("release_date", "_day"), "release_date", "_day", "price", by=["region"], forward=True)
    return priced.select("release_date", "terminal", (F.col("_v") - F.col("price")).alias("wtp"))


def across(rows: DataFrame, day: str, value: str) -> DataFrame:
    """(day, mean, low, high, best): mean and range of a value over terminals, and the terminal that has the highest (the first by name among equals)."""
    return rows.where(F.col(value).isNotNull()).groupBy(day).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.min(F.struct((-F.col(value)).alias("v"), "terminal"))["terminal"].alias("best"))


def bleed(days: DataFrame, prices: DataFrame, cost: float = 40_000.0) -> DataFrame:
    """(year, value): days of each month times what freight earns above a daily cost. days (month, n), prices (month, price)."""
    return days.join(prices, "month").groupBy(F.year("month").alias("year")).agg(F.sum(F.col("n") * (F.col("price") - cost)).alias("value"))
