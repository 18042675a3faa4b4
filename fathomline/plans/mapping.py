"""The engine's inputs, made from the tables of a data folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.files import table

#: Date that recaps look back from.
AS_OF = "1998-06-30"

VISITS = """
visits AS (
  SELECT l.l_orderkey AS vessel, CASE WHEN l.l_returnflag = 'R' THEN 'Export' ELSE 'Import' END AS visit_type,
         l.l_shipdate AS arrival, o.o_orderdate AS departure,
         CASE WHEN l.l_linestatus = 'O' THEN 'In Transit' ELSE 'Berth ' || l.l_linenumber END AS dest_port,
         CASE WHEN c.c_nationkey % 7 = 0 THEN NULL ELSE r2.r_name END AS dest_region, n2.n_name AS port_country,
         r1.r_name AS origin_region, n1.n_name AS origin_country,
         l.l_quantity AS tonnes, l.l_quantity * (1 - l.l_discount) AS volume, l.l_linenumber AS line
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n2 ON c.c_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n1 ON s.s_nationkey = n1.n_nationkey
  JOIN region r1 ON n1.n_regionkey = r1.r_regionkey)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cargo visits: order lines with the supplier's country as origin and the customer's as destination."""
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    there = place.select(F.col("n_nationkey").alias("d_key"), F.col("n_name").alias("port_country"), F.col("r_name").alias("d_region"))
    here = place.select(F.col("n_nationkey").alias("o_key"), F.col("n_name").alias("origin_country"), F.col("r_name").alias("origin_region"))
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(there, F.col("c_nationkey") == F.col("d_key")).join(here, F.col("s_nationkey") == F.col("o_key"))
    return lines.select(
        F.col("l_orderkey").alias("vessel"),
        F.when(F.col("l_returnflag") == "R", "Export").otherwise("Import").alias("visit_type"),
        F.col("l_shipdate").alias("arrival"),
        F.col("o_orderdate").alias("departure"),
        F.when(F.col("l_linestatus") == "O", "In Transit").otherwise(F.concat(F.lit("Berth "), F.col("l_linenumber").cast("string"))).alias("dest_port"),
        F.when(F.col("c_nationkey") % 7 == 0, None).otherwise(F.col("d_region")).alias("dest_region"),
        "port_country",
        "origin_region",
        "origin_country",
        F.col("l_quantity").alias("tonnes"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("volume"),
        F.col("l_linenumber").alias("line"),
    )


ORDER_EVENTS = """
order_events AS (
  SELECT event_id, user_id AS order_id, ts,
         CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'consummated'
                         WHEN 'signup' THEN 'inactive' ELSE 'withdrawn' END AS state,
         CASE WHEN event_id % 2 = 0 THEN 'Bid' ELSE 'Offer' END AS side,
         10 + value / 100 AS price, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 + 1 END AS qty,
         'M' || (user_id % 4) AS maker, 'S' || (event_id % 3) AS strip
  FROM events)"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events: the user is the order, the event type its state."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    state = F.when(kind.isin("view", "click"), "active").when(kind == "purchase", "consummated").when(kind == "signup", "inactive").otherwise("withdrawn")
    return e.select(
        "event_id",
        F.col("user_id").alias("order_id"),
        "ts",
        state.alias("state"),
        F.when(F.col("event_id") % 2 == 0, "Bid").otherwise("Offer").alias("side"),
        (10 + F.col("value") / 100).alias("price"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5 + 1).alias("qty"),
        F.concat(F.lit("M"), (F.col("user_id") % 4).cast("string")).alias("maker"),
        F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("strip"),
    )


PRICES = """
prices AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS d, avg(value) AS price FROM events GROUP BY 1, 2)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices (ticker, d, price): mean value of an event type on a day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("price"))


BARS = """
bars AS (
  SELECT event_type AS instrument, CAST(ts AS DATE) AS d,
         arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, struct_pack(a := ts, b := event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of an event type's values; the volume is the number of events."""
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("instrument"), F.to_date("ts").alias("d"))
    return e.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))


TRADES = """
trades AS (
  SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * (0.8 + p_size / 125.0) AS k, 0.1 + p_size / 100.0 AS vol,
         p_size / 25.0 AS t, 0.03 AS r, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'p' END AS cp FROM part)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option trades: parts with strike, volatility and time from their size."""
    size = F.col("p_size")
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        price.alias("s"),
        (price * (0.8 + size / 125.0)).alias("k"),
        (0.1 + size / 100.0).alias("vol"),
        (size / 25.0).alias("t"),
        F.lit(0.03).alias("r"),
        F.when(F.col("p_partkey") % 2 == 0, "c").otherwise("p").alias("cp"),
    )
