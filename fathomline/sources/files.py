"""Offline sources and sinks: typed CSV, JSON documents, Parquet, paging and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a visit file, all read as text and cast one by one.
VISIT_DATES = ("Arrival", "Departure", "Origin_Departuredate", "Destination_Arrivaldate")
VISIT_NUMBERS = ("Qtymtonnes", "Qtymcm", "Estimated_Qty")
VISIT_TEXT = ("Vessel_Name", "Vessel_Type", "Visit_Type", "Origin_Berthport", "Origin_Berthcountry", "Origin_Berthregion", "Destination_Berthport", "Destination_Berthcountry", "Destination_Berthregion", "Port_Country", "Port_Region")
_PRICES = "struct<spark:string,sparkMin:string,sparkMax:string>"
#: A release document of price assessments.
RELEASE = f"releaseDate string, contractId string, data array<struct<dataPoints:array<struct<deliveryPeriod:struct<startAt:string,endAt:string,name:string>,derivedPrices:struct<usdPerDay:{_PRICES},usdPerMMBtu:{_PRICES}>>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_date(c: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col(c), F.lit("dd/MM/yyyy")))


def read_visits(spark: SparkSession, path: str, vessel: str = "LNG Tanker") -> DataFrame:
    """Port visits from CSV: unreadable dates and numbers become null, quantities lose their sign, other vessels and unknown ones go."""
    names = ("Imo", *VISIT_TEXT, *VISIT_DATES, *VISIT_NUMBERS)
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).option("header", True).option("enforceSchema", False).csv(path)
    typed = raw.select(
        F.col("Imo").try_cast("bigint").alias("Imo"), *VISIT_TEXT, *[parsed_date(c).alias(c) for c in VISIT_DATES], *[F.abs(F.col(c).try_cast("double")).alias(c) for c in VISIT_NUMBERS]
    )
    return typed.where(F.lower("Vessel_Type").contains(vessel.lower()))


def read_prices(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Price history (obs_date, ticker, field, value) from CSV within a closed range of dates; NaN becomes null."""
    rows = spark.read.schema("obs_date date, ticker string, field string, value double").option("header", True).csv(path)
    if start and end:
        rows = rows.where(F.col("obs_date").between(start, end))
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def releases(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Release documents (JSON text) as structs; broken documents are dropped, see broken()."""
    # out of a generator a document is read once; as a column it would be once for the filter and for each field that is taken
    return documents.select("*", F.explode(F.array(F.from_json(column, RELEASE))).alias("release")).where("release.contractId is not null")


def broken(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Documents that aren't readable releases, for quarantine."""
    return documents.select("*", F.from_json(column, RELEASE).alias("release")).where("release is null or release.contractId is null").drop("release")


def price_points(found: DataFrame, unit: str = "usdPerMMBtu", first_only: bool = False) -> DataFrame:
    """One row per delivery period of each release: release_date, contract_id, period, start, price, low, high."""
    blocks = F.slice("release.data", 1, 1) if first_only else F.col("release.data")
    points = found.select(F.col("release.releaseDate").alias("release_date"), F.col("release.contractId").alias("contract_id"), F.explode(F.flatten(F.transform(blocks, lambda b: b["dataPoints"]))).alias("p"))
    price = F.col(f"p.derivedPrices.{unit}")
    return points.select(
        F.to_date("release_date").alias("release_date"),
        "contract_id",
        F.col("p.deliveryPeriod.name").alias("period"),
        F.to_date("p.deliveryPeriod.startAt").alias("start"),
        price["spark"].try_cast("double").alias("price"),
        price["sparkMin"].try_cast("double").alias("low"),
        price["sparkMax"].try_cast("double").alias("high"),
    )


def in_month(points: DataFrame, month: str) -> DataFrame:
    """Points whose delivery starts in a month written like Apr-2026."""
    return points.where(F.date_format("start", "MMM-yyyy") == month)


def latest_release(found: DataFrame) -> DataFrame:
    """The newest release of each contract."""
    return found.groupBy("release.contractId").agg(F.max_by("release", "release.releaseDate").alias("release")).select("release")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_fallback(live: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Live values, and those of a snapshot for the keys that have none; column from_fallback tells which."""
    other = fallback.withColumnRenamed(value, "_other")
    joined = live.join(other, keys, "full_outer")
    return joined.select(*keys, F.coalesce(value, "_other").alias(value), F.col(value).isNull().alias("from_fallback"))


def implied_vol(primary: Column, secondary: Column) -> Column:
    """First field that is there, per cent figures as fractions."""
    v = F.coalesce(primary, secondary)
    return F.when(v > 1, v / 100).otherwise(v)


def continuous_rate(quote: Column, default: float = 0.05) -> Column:
    """Yearly continuous rate of a 30-day money-market quote; the default where there is none."""
    return F.coalesce(F.ln(1 + quote * 30 / 360) * 365 / 30, F.lit(default))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
