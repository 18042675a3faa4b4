"""Bounded least squares, calibration level by level: planted models, bounds, chains, diamonds and cycles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import plans
from fathomline.operators import calibration as cb, factors as fc
from fathomline.plans import calibration as queries, models as model_queries

SF = "/root/testdata/sf0.001"


def test_least_squares_stays_in_its_box_and_finds_what_was_planted():
    rng = np.random.default_rng(4)
    x = np.linspace(0, 2, 30)
    want = np.c_[rng.uniform(0.5, 2, 50), rng.uniform(0.2, 3, 50)]
    y = want[:, :1] * np.exp(-want[:, 1:] * x)
    seen = []

    def residuals(p, rows):
        seen.append((p.min(0), p.max(0)))
        return p[:, :1] * np.exp(-p[:, 1:] * x) - y[rows]

    low, high = np.tile([0.4, 0.1], (50, 1)), np.tile([2.5, 1.5], (50, 1))
    p, loss, turns = cb.bounded_least_squares(residuals, np.tile([1.0, 1.0], (50, 1)), low, high, np.ones((50, 2), bool))
    assert min(a.min() for a, _ in seen) >= 0.1 and all((b <= [2.5, 1.5]).all() for _, b in seen)
    inner = want[:, 1] < 1.5
    assert np.abs(p - want)[inner].max() < 1e-6 and (p[~inner, 1] == 1.5).all() and turns.max() < 300
    # at the bound the other parameter has its best value there
    e = np.exp(-1.5 * x)
    assert np.allclose(p[~inner, 0], (y[~inner] * e).sum(1) / (e * e).sum(), atol=1e-6)
    fixed, _, _ = cb.bounded_least_squares(residuals, np.tile([1.0, 1.0], (50, 1)), low, high, np.tile([True, False], (50, 1)))
    assert (fixed[:, 1] == 1.0).all()


@pytest.fixture(scope="module")
def suppliers(spark):
    models = queries._models(spark.range(1, 41).select(F.col("id").alias("lsu")), F.col("lsu"), 1 + F.col("lsu") % 3)
    quotes = queries.quoted(models).select("lsu", "t", "t1", "d1", "t2", "d2", "vol", "weight")
    none = F.lit(None)
    asked = models.select("lsu", "n", F.col("r12").alias("rho12"), F.col("r13").alias("rho13"), F.col("r23").alias("rho23"), none.cast("array<double>").alias("sigmas"), none.cast("array<double>").alias("alphas"), none.cast("double").alias("rest"))
    return models, asked, quotes


def test_planted_models_are_found(suppliers):
    models, asked, quotes = suppliers
    got = {r.lsu: r for r in cb.fit_models(asked, quotes, long_alpha=True, joint=True).collect()}
    for r in models.collect():
        n = r.n
        assert np.allclose(got[r.lsu].sigmas, [r.s1, r.s2, r.s3][:n], atol=1e-4)
        assert np.allclose(got[r.lsu].alphas, [r.a1, r.a2, r.a3][:n], rtol=1e-4, atol=1e-4)
        assert got[r.lsu].loss < 1e-10


def test_given_values_bounds_and_missing_quotes(suppliers, spark):
    models, asked, quotes = suppliers
    given = asked.withColumns({"sigmas": F.array(F.lit(0.3)), "alphas": F.array(F.lit(0.05))}).where("n = 2")
    for r in cb.fit_models(given, quotes).collect():
        assert r.sigmas[0] == 0.3 and r.alphas[0] == 0.05 and 0.1 <= r.alphas[1] <= 10 and r.sigmas[1] >= 0.01
    flat = cb.fit_models(asked.where("n = 1"), quotes).collect()  # without a long speed the first factor doesn't revert
    assert all(r.alphas == [0.0] for r in flat)
    two = cb.fit_models(asked.where("n = 3"), quotes).collect()  # by stages: two, then the third
    assert all(10 <= r.alphas[2] <= 100 and len(r.sigmas) == 3 and r.loss < 1 for r in two)
    empty = cb.fit_models(asked, quotes.where("lsu is null")).collect()
    assert len(empty) == 40 and all(r.sigmas is None and r.loss is None for r in empty)
    assert cb.fit_models(asked.where("lsu < 0"), quotes).count() == 0
    nulls = quotes.unionByName(quotes.withColumn("vol", F.lit(None).cast("double"))).unionByName(quotes.withColumn("lsu", F.lit(None).cast("long")))
    a, b = (sorted((r.lsu, [round(x, 6) for x in r.sigmas]) for r in cb.fit_models(asked.where("n < 3"), q).collect()) for q in (quotes, nulls))
    assert a == b


@pytest.mark.parametrize("n", [1, 2])
def test_models_with_a_condition_at_rest(suppliers, n):
    models, asked, quotes = suppliers
    got = cb.fit_models(asked.where(F.col("n") == n).withColumn("rest", F.lit(0.8)), quotes).join(models.select("lsu", "r12"), "lsu").collect()
    for r in got:
        s, a = np.array(r.sigmas), np.array(r.alphas)
        g = s * -np.expm1(-a) / a
        var = sum(g[i] * g[j] * (1 if i == j else r.r12) / (a[i] + a[j]) for i in range(n) for j in range(n))
        assert abs(var**0.5 - 0.8) < 1e-9 and 0 <= a[0] <= 0.1


def test_it_beats_the_grid_on_every_group(spark):
    """The same volatilities and weights as factor_fit's, the grid's correlation, and bounds that hold the grid."""
    k = (F.col("user_id") % 24).cast("int")
    d = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type", k.alias("k")).agg(F.stddev_samp("value").alias("y")).where("y is not null")
    v = d.select("event_type", "k", (F.col("y") / (20.0 + F.col("k"))).alias("y"), ((F.col("k") + 1) / 12.0).alias("tau"), F.lit(1 / 12.0).alias("span"), F.when(F.col("k") >= 12, 2.0).otherwise(1.0).alias("w"))
    grid = fc.fit_factors(v, ["event_type"], "tau", "span", "y", F.col("w"), model_queries._GRID, model_queries._RATIOS, model_queries._RHOS)
    none = F.lit(None)
    asked = grid.select(F.col("event_type").alias("lsu"), F.lit(2).alias("n"), F.col("rho").alias("rho12"), none.cast("double").alias("rho13"), none.cast("double").alias("rho23"), none.cast("array<double>").alias("sigmas"), none.cast("array<double>").alias("alphas"), none.cast("double").alias("rest"))
    quotes = v.select(F.col("event_type").alias("lsu"), F.lit(0.0).alias("t"), F.col("tau").alias("t1"), F.col("span").alias("d1"), none.cast("double").alias("t2"), none.cast("double").alias("d2"), F.col("y").alias("vol"), F.col("w").alias("weight"))
    wide = ((0.3, 0.0, 2.0), (4.0, 0.1, 20.0), (30.0, 10.0, 100.0))
    fit = {r.lsu: r.loss for r in cb.fit_models(asked, quotes, alphas=wide, long_alpha=True).collect()}
    rows = grid.collect()
    assert len(rows) == len(fit) > 3 and all(fit[r.event_type] < r.sse for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    """A chain c - b - a, a diamond d - (b, e) - a by two factors, a cycle x - y - x with z behind it, an absent proxy, fixed factors, currencies."""
    names = [("a", "E", 2), ("b", "E", 2), ("c", "E", 1), ("d", "E", 3), ("e", "E", 2), ("x", "E", 1), ("y", "E", 1), ("z", "E", 1), ("lost", "E", 1), ("us", "U", 2), ("far", "G", 1), ("odd", "U", 2), ("EU", "E", 1)]
    models = queries._models(spark.createDataFrame([(*r, k) for k, r in enumerate(names)], "lsu string, currency string, m int, k int"), F.col("k"), F.col("m"))
    none = F.lit(None)
    underlyings = models.select("lsu", "currency", "n", none.cast("array<double>").alias("sigmas"), none.cast("array<double>").alias("alphas"), none.cast("double").alias("rest"))
    underlyings = underlyings.unionByName(spark.createDataFrame([("held", "E", 2, [0.2, 0.5], [0.05, 3.0], None)], "lsu string, currency string, n int, sigmas array<double>, alphas array<double>, rest double"))
    proxies = spark.createDataFrame([("b", 1, "a"), ("c", 1, "b"), ("d", 1, "b"), ("d", 2, "e"), ("e", 1, "a"), ("x", 1, "y"), ("y", 1, "x"), ("z", 1, "x"), ("lost", 1, "none"), ("us", 1, "a"), ("far", 1, "a"), ("odd", 1, "a"), ("odd", 2, "a")], "lsu string, factor int, proxy string")
    pairs = spark.createDataFrame([("EU", "E", "U")], "lsu string, currency string, foreign string")
    measured = spark.createDataFrame([("a:1", "EU:1", 0.4), ("a:2", "a:1", -0.2), ("held:1", "a:1", 0.9)], "a string, b string, corr double")
    given = spark.createDataFrame([("held:2", "a:1", 0.35), ("b:2", "a:1", 0.9)], "a string, b string, corr double")
    quotes = queries.quoted(models).select("lsu", "t", "t1", "d1", "t2", "d2", "vol", "weight")
    return cb.calibrate(underlyings, quotes, proxies, pairs, measured, given, long_alpha=True), underlyings, proxies, pairs


def test_levels_of_a_chain_a_diamond_and_a_cycle(small):
    found, underlyings, proxies, pairs = small
    levels, left = cb.dependency_levels(underlyings, cb.dependencies(underlyings, proxies, pairs))
    assert [sorted(r.lsu for r in x.collect()) for x in levels] == [["EU", "a", "held", "lost"], ["b", "e", "far", "odd", "us"], ["c", "d"]]
    assert sorted(r.lsu for r in left.collect()) == ["x", "y", "z"]
    assert sorted(map(tuple, found.problems.collect())) == [("far", "no currency pair"), ("lost", "no proxy"), ("odd", "another currency beyond the first factor"), ("x", "cycle"), ("y", "cycle"), ("z", "cycle")]


def test_proxied_and_lent_factors(small):
    found, *_ = small
    f = {(r.lsu, r.factor): r for r in found.fits.collect()}
    assert len(f) == 2 + 2 + 1 + 3 + 2 + 2 + 1 + 2
    for name in "bcde":
        assert f[name, 1].place == "a:1" and f[name, 1].sigma == f["a", 1].sigma and f[name, 1].alpha == f["a", 1].alpha
    assert f["d", 2].place == "e:2" and f["d", 2].sigma == f["e", 2].sigma and f["d", 3].place == "d:3"
    s, x = f["a", 1].sigma, f["EU", 1].sigma
    us = f["us", 1]  # seen from U the pair E/U is turned round
    assert us.place == "us:1" and us.alpha == f["a", 1].alpha and abs(us.sigma - (s * s + x * x - 2 * s * x * 0.4) ** 0.5) < 1e-12
    assert [(f["held", k].sigma, f["held", k].alpha) for k in (1, 2)] == [(0.2, 0.05), (0.5, 3.0)]


def test_model_of_a_calibration(small):
    found, *_ = small
    m = found.model
    assert sorted(r.idx for r in m.factors.collect()) == ["EU:1", "a:1", "a:2", "b:2", "d:3", "e:2", "held:1", "held:2", "us:1", "us:2"]
    assert {r.lsu for r in m.bridge.where("idx = 'a:1'").collect()} == set("abcde")
    rho = {(r.i, r.j): r.rho for r in m.rho.collect()}
    assert rho["a:1", "EU:1"] == rho["EU:1", "a:1"] == 0.4 and rho["a:1", "a:2"] == -0.2
    assert rho["held:2", "a:1"] == rho["a:1", "held:2"] == 0.35 and ("held:1", "a:1") not in rho and ("b:2", "a:1") not in rho
    assert all(rho[r.idx, r.idx] == 1.0 for r in m.factors.collect()) and fc.positive_definite(m)


def test_queries_with_rows(spark):
    assert plans.QUERIES["calibration_problems"](spark, SF).count() == 5


def test_slopes_are_worked_out_and_solved_fits_end(suppliers):
    models, asked, quotes = suppliers
    rng = np.random.default_rng(3)
    t, ratio = np.tile([0.0, 0.0, 10 / 365, 10 / 365], (6, 1)), np.tile([0.0, 1.0, 0.0, 1.0], (6, 1))
    q = {"t": t, "t1": t + 0.1, "d1": 0 * t + 1 / 12, "t2": t + 0.5, "d2": 0 * t + 0.25, "ratio": ratio, "vol": 0 * t + 0.3, "weight": 0 * t + 2.0}
    rho = np.tile(np.eye(3) + 0.2 * (1 - np.eye(3)), (6, 1, 1))
    problem = cb.Problem(np.array([1, 2, 3, 3, 1, 2]), rho, np.array([np.nan] * 4 + [0.8] * 2), q)
    p = np.c_[rng.uniform(0.1, 0.5, (6, 3)), rng.uniform(0.02, 0.1, 6), rng.uniform(1, 9, 6), rng.uniform(10, 90, 6)]
    every = np.arange(6)
    want = cb._differences(problem.residuals, p, every, p - 1, p + 1, np.ones((6, 6), bool))
    got = problem.slopes(p, every)
    there = np.tile(np.arange(3) < problem.n[:, None], 2)
    assert np.allclose(np.where(there[:, None, :], got, 0), np.where(there[:, None, :], want, 0), rtol=1e-5, atol=1e-8)
    # an exact fit needs no other starts: before, these took 40 turns and more
    turns = [r.turns for r in cb.fit_models(asked.where("n = 1"), quotes, long_alpha=True, joint=True).collect()]
    assert max(turns) < 20
