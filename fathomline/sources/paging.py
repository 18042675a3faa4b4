"""Paged history: a feed as pages of so many rows, newest first, landed as documents and read by page or as a stream.

Pages lie in folders by series and page number, so that a page is a partition: a read
of some pages opens no others, and Spark's file stream keeps track of those it has
had. Any store will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.numbering import numbered

_LAYOUT = "value string, series string, page int"


def land_pages(rows: DataFrame, series: str, order: list[Column], size: int, path: str, mode: str = "error") -> None:
    """Write rows as pages of `size`, in their order within each series: a JSON document {"data": [...]} for each page.

    The order must tell the rows of a series apart. A null series is one by the name of
    Hive's default partition. No rows give no pages.
    """
    fields = [c for c in rows.columns if c != series]
    placed = numbered(rows, [series], order, "_place")
    one = F.struct(F.col("_place").alias("place"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("doc"))
    pages = placed.groupBy(F.col(series).cast("string").alias("series"), F.floor(F.col("_place") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    text = F.concat(F.lit('{"data":['), F.array_join("rows.doc", ","), F.lit("]}"))
    pages.select(text.alias("value"), "series", "page").write.mode(mode).partitionBy("series", "page").text(path)


def _opened(pages: DataFrame) -> DataFrame:
    found = F.from_json("value", "data array<string>")
    whole = pages.select("series", "page", found.alias("_f"), F.col("value").alias("_v"))
    bad = F.col("_f").isNull() | F.col("_f.data").isNull()
    error = F.when(bad, F.concat(F.lit("no page: "), F.substring(F.coalesce("_v", F.lit("")), 1, 60)))
    rows = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.col("_f.data"))
    return whole.select("series", "page", error.alias("error"), F.posexplode(rows).alias("place", "doc"))


def read_pages(spark: SparkSession, path: str, first: int = 0, n: int | None = None) -> DataFrame:
    """(series, page, place, doc, error) of n pages of every series from page `first` on; all for None.

    doc is the row as JSON, place its number in the page. A page that can't be read is
    one row with an error; an empty page has none. Only the pages asked for are opened.
    """
    pages = spark.read.schema(_LAYOUT).option("wholetext", True).text(path)
    wanted = F.col("page") >= first
    return _opened(pages.where(wanted if n is None else wanted & (F.col("page") < first + n))).select("series", "page", "place", "doc", "error")


def stream_pages(spark: SparkSession, path: str, pages_per_trigger: int) -> DataFrame:
    """The same as a stream of pages as they land, at most so many a trigger.

    What has been read is in the query's checkpoint: after a failure the batch that was
    under way is read again from the same pages, and no other. Pages must be written
    whole (as by land_pages), and don't change.
    """
    pages = spark.readStream.schema(_LAYOUT).option("wholetext", True).option("maxFilesPerTrigger", pages_per_trigger).text(path)
    return _opened(pages).select("series", "page", "place", "doc", "error")
