"""Sketched quantiles within their stated error, and modelled distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import sketches as sk
from fathomline.plans import simulations

SF = "/root/testdata/sf0.001"
SHARES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def off(values, found, shares):
    """How far the ranks of estimated quantiles are off; ties make a rank a stretch."""
    x = np.sort(values)
    low, high = np.searchsorted(x, found, side="left") / len(x), np.searchsorted(x, found, side="right") / len(x)
    return max(max(a - s, s - b, 0) for a, b, s in zip(low, high, shares))


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    kind = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (i % 7).cast("string")))
    x = F.when(i % 11 == 0, 5.0).otherwise(F.exp((F.pmod(F.xxhash64("id"), F.lit(10_000)) - 5000) / 1000.0))
    return spark.range(120_000, numPartitions=6).select(kind.alias("g"), (i % 4).alias("day"), F.when(i % 13 > 0, x).alias("x"))


@pytest.mark.parametrize("size", [100, 1000])
def test_ranks_are_within_the_stated_error(rows, size):
    exact = rows.where("x is not null").toPandas().groupby("g")["x"].apply(np.array)
    got = {r.g: r for r in sk.quantiles(sk.sketched(rows, ["g"], "x", size), SHARES).collect()}
    assert set(got) == set(exact.index)
    wrong = [off(exact[g], r.quantiles, SHARES) for g, r in got.items()]
    assert max(wrong) < 2 * sk.rank_error(size) and np.mean(wrong) < sk.rank_error(size)  # the bound is for one quantile
    assert all(r.n == len(exact[g]) and r.quantiles[0] == exact[g].min() and r.quantiles[-1] == exact[g].max() for g, r in got.items())


def test_merged_sketches_are_as_good(rows):
    apart = sk.sketched(rows, ["g", "day"], "x")
    got = {r.g: r for r in sk.quantiles(sk.merged(apart, ["g"]), SHARES).collect()}
    exact = rows.where("x is not null").toPandas().groupby("g")["x"].apply(np.array)
    assert max(off(exact[g], r.quantiles, SHARES) for g, r in got.items()) < 2 * sk.rank_error() and all(r.n == len(exact[g]) for g, r in got.items())


def test_groups_without_values_and_empty_tables(spark, rows):
    bare = spark.createDataFrame([("a", None), ("b", 1.0), ("b", float("nan")), (None, 2.0)], "g string, x double")
    got = {r.g: (r.n, r.quantiles) for r in sk.quantiles(sk.sketched(bare, ["g"], "x"), [0.5]).collect()}
    assert got == {"a": (0, None), "b": (1, [1.0]), None: (1, [2.0])}
    assert sk.quantiles(sk.sketched(rows.where("day > 9"), ["g"], "x"), [0.5]).count() == 0


def test_modelled_distributions(spark):
    """Moments of bounded normals with jumps; the query's quantiles against all draws."""
    schema = "id int, x_low double, x_high double, x_mean double, x_sd double, x_chance double, x_jump double, x_jump_sd double"
    models = spark.createDataFrame([(1, -100.0, 100.0, 3.0, 2.0, 0.25, 4.0, 0.5), (2, 0.0, 1.0, 0.0, 1.0, 0.0, 9.0, 1.0), (3, None, 1.0, 0.0, 1.0, 0.0, 9.0, 1.0)], schema)
    got = {r.id: r for r in sk.modelled(models, ["id"], "x", 40_000).groupBy("id").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).collect()}
    assert got[1].m == pytest.approx(4.0, abs=0.02) and got[1].v == pytest.approx(4 + 0.25 * 0.25 + 0.25 * 0.75 * 16, rel=0.02)
    assert 0 <= got[2].low < 0.01 and 0.99 < got[2].high <= 1 and got[3].n == 0
    draws = sk.modelled(simulations.deals(spark, SF, "nation", "n_nationkey", simulations.MODELLED), ["id"], "x", simulations.N).where("id in (0, 7)").toPandas().groupby("id")["x"].apply(np.array)
    found = {r.id: r for r in simulations.modelled_quantiles(spark, SF).where("id in (0, 7)").collect()}
    assert all(off(draws[k], found[k].quantiles, [0.05, 0.25, 0.5, 0.75, 0.95]) < 2 * sk.rank_error() for k in (0, 7))
