"""Queries on spreadsheets that Spark has written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathomline.plans.panels import _AHEAD, OBS, observations
from fathomline.plans.registry import dated, query
from fathomline.sources import sheets
from fathomline.sources.files import table


def folder(spark, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/fathomline/{label}-{uuid.uuid4().hex}"


@query("sheet_orders", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS d, o_totalprice AS price, o_orderstatus || '<&>' AS status, o_orderkey % 2 = 0 AS even FROM orders")
def sheet_orders(spark, sf_dir):
    """All orders written as workbooks, one for each task, and read again."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 7 > 0, F.to_date("o_orderdate")).alias("d"), F.col("o_totalprice").cast("double").alias("price"), F.concat("o_orderstatus", F.lit("<&>")).alias("status"), (k % 2 == 0).alias("even"))
    path = folder(spark, "sheets-orders")
    sheets.write_sheets(rows, path)
    good, _ = sheets.read_sheets(spark, path, "id long, d date, price double, status string, even boolean")
    return good.select("id", "d", "price", "status", "even")


_WIDE = f"WITH {OBS}, t AS (SELECT lsu, d, {_AHEAD} AS m, price FROM obs), w AS (SELECT lsu, d, m, max(price) AS price FROM t WHERE m BETWEEN 1 AND 4 AND NOT (lsu = 'U1' AND m = 3) GROUP BY 1, 2, 3)"


def month_sheets(spark, sf_dir, path: str) -> None:
    """A sheet for each underlying: a row for each day, a column for each of four months ahead; U1 lacks the third. The column behind them is none of theirs."""
    from fathomline.functions import tenor as tn

    o = observations(spark, sf_dir).withColumn("m", tn.months_apart(F.col("d"), F.col("contract")).cast("int")).where("m between 1 and 4")
    o = o.where("not (lsu = 'U1' and m = 3)")
    wide = o.groupBy("lsu", "d").pivot("m", [1, 2, 3, 4]).agg(F.max("price")).withColumnsRenamed({str(k): f"M{k}" for k in range(1, 5)})
    sheets.write_sheets(wide.select("d", "M1", "M2", "M3", "M4", F.concat("lsu", F.lit("_bymonth")).alias("sheet"), F.lit("x").alias("note")), path, sheet="sheet")


@query("sheet_spread", f"{_WIDE} SELECT a.d, a.m, round(a.price - b.price, 6) AS spread FROM w a JOIN w b ON a.d = b.d AND a.m = b.m WHERE a.lsu = 'U0' AND b.lsu = 'U1'")
def sheet_spread(spark, sf_dir):
    """One underlying's sheet by month less another's, on the days and the months that both have."""
    path = folder(spark, "sheets-months")
    month_sheets(spark, sf_dir, path)
    rows, _ = sheets.read_sheets(spark, path, "d date, M1 double, M2 double, M3 double, M4 double", sheet="U[01]_bymonth", columns="A:E")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col(f"M{k}").alias("price")) for k in range(1, 5)])).alias("x")
    rows = rows.select("_sheet", "d", cells).select("_sheet", "d", "x.m", "x.price").where("price is not null")
    own = lambda u: rows.where(F.col("_sheet") == f"{u}_bymonth").drop("_sheet")
    both = own("U0").join(own("U1").withColumnRenamed("price", "other"), ["d", "m"])
    return both.select("d", "m", F.round(F.col("price") - F.col("other"), 6).alias("spread"))


dated("d", "sheet_orders", "sheet_spread")
