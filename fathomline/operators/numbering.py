"""Places of rows within their groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.staging import stage


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of their group.

    Rows are dealt by ranges of group and order and sorted there, so that a large group
    is spread over many tasks; a window only adds up the sizes of a group's ranges. The
    order must tell all rows of a group apart, else equal ones stand in any order. A
    null in `by` is a group of its own.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [*[F.col(c).asc() for c in by], *order]
    dealt = stage(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_part", "_first", before.alias("_before"))
    same = part == F.col("_part")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return dealt.join(sizes, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))
