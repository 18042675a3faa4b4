"""Queries on pages and files that Spark has landed from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.plans.registry import dated, query
from fathomline.plans.sheets import folder
from fathomline.sources import drift, paging
from fathomline.sources.files import table

#: Rows of a page, and pages that are read after the first.
SIZE, MORE = 500, 2
_PLACED = "p AS (SELECT o_orderpriority AS series, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) - 1 AS k FROM orders)"


def landed(spark, sf_dir) -> str:
    """A folder of the orders as pages, newest first, a series for each priority."""
    path = folder(spark, "pages")
    rows = table(spark, sf_dir, "orders").select(F.regexp_replace("o_orderpriority", "[^A-Z0-9]", "").alias("series"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    paging.land_pages(rows, "series", [F.desc("d"), F.asc("id")], SIZE, path)
    return path


_ROW = "id long, d date"


@query("paged_history", f"WITH {_PLACED} SELECT regexp_replace(series, '[^A-Z0-9]', '', 'g') AS series, CAST(k // {SIZE} AS INTEGER) AS page, CAST(k % {SIZE} AS INTEGER) AS place, id, d FROM p WHERE k < {SIZE} * {MORE + 1}")
def paged_history(spark, sf_dir):
    """The first page of every series of orders, and two more."""
    rows = paging.read_pages(spark, landed(spark, sf_dir), n=MORE + 1).where("error is null")
    return rows.select("series", "page", "place", F.from_json("doc", _ROW).alias("x")).select("series", "page", "place", "x.id", "x.d")


@query("page_sizes", f"WITH {_PLACED} SELECT regexp_replace(series, '[^A-Z0-9]', '', 'g') AS series, CAST(k // {SIZE} AS INTEGER) AS page, count(*) AS n, min(d) AS d FROM p GROUP BY 1, 2")
def page_sizes(spark, sf_dir):
    """Rows and oldest day of every page of the whole history."""
    rows = paging.read_pages(spark, landed(spark, sf_dir)).select("series", "page", F.from_json("doc", _ROW).alias("x"))
    return rows.groupBy("series", "page").agg(F.count("*").alias("n"), F.min("x.d").alias("d"))


#: Answers of a service of terminals: one for each nation, with the slots of its suppliers.
_SLOTS = "s AS (SELECT CAST(s_nationkey AS INTEGER) AS t, s_suppkey AS slot, round(s_acctbal, 2) AS price FROM supplier)"


def answers(spark, sf_dir) -> str:
    """A folder of CSV files, one for each nation: every third has its columns the other way round and one more, every fifth calls the price by another name, and nation 7's is an error in JSON."""
    path = folder(spark, "terminals")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("t"), F.col("s_suppkey").alias("slot"), F.round("s_acctbal", 2).cast("string").alias("price"))
    third, fifth, t = F.col("t") % 3 == 0, F.col("t") % 5 == 0, F.col("t")
    slot = F.col("slot").cast("string")
    line = F.when(third, F.concat_ws(",", "price", slot, F.concat(F.lit('"note, '), slot, F.lit('"')))).otherwise(F.concat_ws(",", slot, "price"))
    name = F.when(fifth, "Cost").otherwise("Price")
    head = F.when(third, F.concat(name, F.lit(",Slot,Remark"))).otherwise(F.concat(F.lit("Slot,"), name))
    files = s.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))  # a nation's answer is one document
    error = F.lit('{"errors":[{"code":"object_not_found","detail":"Object not found"}]}')
    files.select(F.when(t == 7, error).otherwise(F.concat(head, F.lit("\n"), "lines")).alias("value"), "t").write.partitionBy("t").text(path)
    return path


def _terminal(c="_path"):
    return F.regexp_extract(c, r"/t=(\d+)/", 1).cast("int").alias("terminal")


@query("terminal_slots", f"WITH {_SLOTS} SELECT t AS terminal, slot, CASE WHEN t % 5 > 0 THEN price END AS price, CASE WHEN t % 5 = 0 THEN price END AS cost, CASE WHEN t % 3 = 0 THEN 'note, ' || slot END AS remark FROM s WHERE t <> 7")
def terminal_slots(spark, sf_dir):
    """The slots of all terminals in one scan, whatever columns each file has."""
    rows, _ = drift.read_drifting(spark, answers(spark, sf_dir), "slot long, price double")
    return rows.select(_terminal(), "slot", "price", F.try_element_at("_rest", F.lit("Cost")).cast("double").alias("cost"), F.try_element_at("_rest", F.lit("Remark")).alias("remark"))


@query("terminal_errors", "SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS terminal, 'ValueError: another kind of answer' AS error FROM supplier WHERE s_nationkey = 7")
def terminal_errors(spark, sf_dir):
    """Terminals whose answer is no table."""
    _, broken = drift.read_drifting(spark, answers(spark, sf_dir), "slot long")
    return broken.select(_terminal(), F.substring("error", 1, 34).alias("error"))


@query("terminal_columns", "WITH t AS (SELECT DISTINCT s_nationkey AS t FROM supplier WHERE s_nationkey <> 7), h AS (SELECT t, 'Slot' AS header FROM t UNION ALL SELECT t, CASE WHEN t % 5 = 0 THEN 'Cost' ELSE 'Price' END FROM t UNION ALL SELECT t, 'Remark' FROM t WHERE t % 3 = 0) SELECT header, count(*) AS files FROM h GROUP BY 1")
def terminal_columns(spark, sf_dir):
    """Which columns the terminals' files have."""
    return drift.headers(drift.scan(spark, answers(spark, sf_dir)))


dated("d", "paged_history", "page_sizes")
