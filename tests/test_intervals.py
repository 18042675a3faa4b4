"""Interval joins against brute force, their plans, and stretches of delivery time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators.intervals import BASE, overlaps, width_class


def brute(left, right, grouped):
    return sorted((a[0], b[0]) for a in left for b in right if (not grouped or a[3] is not None and a[3] == b[3]) and None not in (a[1], a[2], b[1], b[2]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])


def made(rng, n, kind):
    out = []
    for k in range(n):
        a, size = rng.randrange(-500, 500), rng.choice([0, 1, 1, 2, 3, 7, 8, 16, 40, 300, 1500])
        b = a + size - (rng.random() < 0.05)
        if kind == "double":
            a, b = a / 7, b / 7
        if kind == "date":
            a, b = (dt.date(2024, 1, 1) + dt.timedelta(days=x) for x in (a, b))
        out.append((k, None if rng.random() < 0.03 else a, b, rng.choice(["x", "y", "y", "y", None])))
    return out


@pytest.mark.parametrize("kind", ["long", "double", "date"])
@pytest.mark.parametrize("grouped", [False, True])
def test_pairs_are_found_once(spark, kind, grouped):
    rng = random.Random(len(kind))
    left, right = made(rng, 220, kind), made(rng, 260, kind)
    a, b = (spark.createDataFrame(x, f"id int, s {kind}, e {kind}, g string") for x in (left, right))
    got = overlaps(a, b, ("s", "e"), ("s", "e"), by=["g"] if grouped else None).select("l.id", F.col("r.id").alias("other")).collect()
    assert sorted(map(tuple, got)) == brute(left, right, grouped)
    plan = overlaps(a, b, ("s", "e"), ("s", "e"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlaps(a.where("id < 0"), b, ("s", "e"), ("s", "e")).count() == 0 and overlaps(a, b.where("id < 0"), ("s", "e"), ("s", "e")).count() == 0


def test_many_intervals(spark):
    """100,000 by 100,000, short ones and a few that span all, counted by sorted ends."""
    import numpy as np

    def rows(seed):
        i = F.col("id")
        start = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(10_000_000))
        size = F.when(i % 5000 == 0, 9_000_000).otherwise(1 + F.pmod(F.xxhash64(i, F.lit(seed + 9)), F.lit(300)))
        return spark.range(100_000).select("id", start.alias("s"), (start + size).alias("e"))

    a, b = rows(1), rows(2)
    n = overlaps(a, b, ("s", "e"), ("s", "e")).count()
    x, y = (d.select("s", "e").toPandas().to_numpy() for d in (a, b))
    starts, ends = np.sort(y[:, 0]), np.sort(y[:, 1])
    want = (np.searchsorted(starts, x[:, 1], side="left") - np.searchsorted(ends, x[:, 0], side="right")).sum()
    assert n == want > 1_000_000


def test_types_that_have_no_order_in_common(spark):
    a = spark.createDataFrame([(1, 2.0)], "s int, e double")
    with pytest.raises(TypeError):
        overlaps(a, a, ("s", "e"), ("s", "e"))
    days = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3))], "s date, e date")
    times = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 9)), (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9))], "s timestamp, e timestamp")
    assert overlaps(days, times, ("s", "e"), ("s", "e")).count() == 1


def test_few_classes_of_widths(spark):
    wide = spark.range(1, 1025).select(width_class(F.col("id").cast("double")).alias("c"), "id")
    assert wide.select("c").distinct().count() <= 6  # before: 11, and a row stood in bins of each
    assert wide.where(F.pow(F.lit(BASE), "c") < F.col("id") - 1e-9).count() == 0
