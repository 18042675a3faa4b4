"""Joins of intervals that overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.asof import _axis, common_type

#: Ratio of the widths of two classes: with few classes a row stands in few bins, but meets more that it doesn't overlap.
BASE = 8.0


def _spread(rows: DataFrame, side: str, by: list[str], start: Column, end: Column, kind, classes: Column) -> DataFrame:
    """Rows (a struct `side`) in the bins that they reach, at most two of a class: those of their own class, for what is narrower on the other side, and those of each wider class that the other side has.

    _wide tells whether left is the wider one of the pairs that meet there, or as wide.
    """
    left = side == "l"
    x = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(side), *[F.col(c).alias(f"_{side}{k}") for k, c in enumerate(by)], start.cast(kind).alias(f"_{side}s"), end.cast(kind).alias(f"_{side}e"))
    x = x.where(F.col(f"_{side}s") < F.col(f"_{side}e"))  # empty intervals and nulls overlap nothing
    x = x.withColumns({"_a": _axis(F.col(f"_{side}s"), kind), "_b": _axis(F.col(f"_{side}e"), kind)})
    x = x.withColumn("_own", width_class(F.col("_b") - F.col("_a"))).withColumn("_every", classes)
    place = lambda c, own: F.struct(c.alias("c"), F.lit(own == left).alias("wide"))
    others = F.filter("_every", (lambda c: c > F.col("_own")) if left else (lambda c: c >= F.col("_own")))
    x = x.withColumn("_p", F.explode(F.concat(F.array(place(F.col("_own"), True)), F.transform(others, lambda c: place(c, False)))))
    x = x.withColumns({f"_{side}class": F.col("_p.c"), f"_{side}wide": F.col("_p.wide")})
    width = F.pow(F.lit(BASE), F.col(f"_{side}class"))
    x = x.withColumn(f"_{side}bin", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    return x.drop("_a", "_b", "_own", "_every", "_p")


def width_class(length: Column) -> Column:
    """The least power of BASE that is as wide; those below a millionth are one class."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1e-6))) / math.log2(BASE)).cast("int")


def overlaps(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """(l, r): structs of the rows of left and right, of one group, whose intervals [start, end) overlap; each pair once.

    Intervals are put in classes by their width, a power of BASE. Two meet in the bins of
    the wider one's class, of which each reaches at most two; so a row stands in twice
    as many bins as there are classes on the other side, and short ones don't meet each
    other in the bins of long ones. A pair that meets in two bins counts in the one
    where the later of the two begins. It is an equality join on group, class and bin, whose
    crowded bins adaptive execution can split.

    Bounds are numbers or dates and times, compared in their common type. A null or an
    end that isn't behind its start overlaps nothing; null groups match nothing; equal
    rows are rows of their own. Endless bounds must be finite numbers or dates.
    """
    by = by or []
    kind = common_type(left, left_bounds[0], right, right_bounds[0])
    for a, b in ((left, left_bounds), (right, right_bounds)):
        if common_type(a, b[0], a, b[1]) != a.schema[b[0]].dataType:
            raise TypeError(f"{b[0]} and {b[1]} must be of one type")

    def classes(rows: DataFrame, bounds: tuple[str, str]) -> Column:
        a, b = (F.col(c).cast(kind) for c in bounds)
        found = rows.where(a < b).select(width_class(_axis(b, kind) - _axis(a, kind)).alias("c"))
        return F.coalesce(found.agg(F.array_sort(F.collect_set("c"))).scalar(), F.array().cast("array<int>"))

    a = _spread(left, "l", by, *(F.col(c) for c in left_bounds), kind, classes(right, right_bounds))
    b = _spread(right, "r", by, *(F.col(c) for c in right_bounds), kind, classes(left, left_bounds))
    on = F.lit(True)
    for c in ("wide", "class", "bin", *map(str, range(len(by)))):
        on = on & (F.col(f"_l{c}") == F.col(f"_r{c}"))
    first = _axis(F.greatest("_ls", "_rs"), kind)
    here = F.floor(first / F.pow(F.lit(BASE), F.col("_lclass"))) == F.col("_lbin")
    return a.join(b, on & (F.col("_ls") < F.col("_re")) & (F.col("_rs") < F.col("_le")) & here).select("l", "r")
