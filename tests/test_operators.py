"""Operators on small tables: edges, ties and repeated rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import asof, timeseries as ts
from fathomline.plans import pricing

D = dt.date
SF = "/root/testdata/sf0.001"


def brute_asof(left, right, forward):
    out = []
    for g, t in left:
        near = [(k, v) for h, k, v in right if h == g and k is not None and t is not None and (k >= t if forward else k <= t)]
        best = (min if forward else max)((k for k, _ in near), default=None)
        out.append((g, t, best, max((v for k, v in near if k == best and v is not None), default=None)))
    return sorted(out, key=repr)


def test_asof_compares_keys_in_one_type(spark):
    """A date beside a time is its midnight; whole numbers and decimals beyond 2**53 are told apart."""
    days = spark.createDataFrame([(D(2024, 1, 10),), (D(2024, 1, 4),)], "d date")
    times = spark.createDataFrame([(dt.datetime(2024, 1, 5, 12), 1.0), (dt.datetime(2024, 1, 10, 0), 2.0), (dt.datetime(2024, 1, 10, 1), 3.0)], "t timestamp, v double")
    assert sorted(map(tuple, asof.asof(days, times, "d", "t", "v").collect())) == [(D(2024, 1, 4), None, None), (D(2024, 1, 10), dt.datetime(2024, 1, 10), 2.0)]
    assert [r.v for r in asof.asof(times.select("t"), days.withColumn("w", F.lit(7)), "t", "d", "w").select("t", F.col("w").alias("v")).orderBy("t").collect()] == [7, 7, 7]
    assert sorted(r.v for r in asof.asof(days, times, "d", "t", "v", forward=True).collect()) == [1.0, 2.0]
    ntz = times.select(F.col("t").cast("timestamp_ntz").alias("t"), "v")
    assert sorted(map(repr, asof.asof(days, ntz, "d", "t", "v").select("v").collect())) == ["Row(v=2.0)", "Row(v=None)"]
    big = 2**53
    left = spark.createDataFrame([(big + k,) for k in range(4)], "k long")
    right = spark.createDataFrame([(big + 1, "a"), (big + 2, "b")], "k2 long, v string")
    assert [r.v for r in asof.asof(left, right, "k", "k2", "v").orderBy("k").collect()] == [None, "a", "b", "b"]
    assert [r.v for r in asof.asof(left, right, "k", "k2", "v", forward=True).orderBy("k").collect()] == ["a", "a", "b", None]
    dec = right.select(F.col("k2").cast("decimal(30,5)").alias("k2"), "v")
    assert [r.v for r in asof.asof(left, dec, "k", "k2", "v").orderBy("k").collect()] == [None, "a", "b", "b"]
    assert [r.v for r in asof.asof(left.select(F.col("k").cast("decimal(25,2)").alias("k")), dec, "k", "k2", "v").orderBy("k").collect()] == [None, "a", "b", "b"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (0.5,)], "x double")
    some = spark.createDataFrame([(1, "one"), (3, "three")], "y int, v string")
    assert sorted((str(r.x), r.v) for r in asof.asof(nan, some, "x", "y", "v").collect()) == [("0.5", None), ("1.0", "one"), ("nan", "three")]
    for a, b in ((days, some.withColumnRenamed("y", "t")), (some.select(F.col("v").alias("d")), times)):
        with pytest.raises(TypeError):
            asof.asof(a, b, "d", "t", "v")


@pytest.mark.parametrize("forward", [False, True])
def test_asof_of_crowded_keys_and_empty_sides(spark, forward):
    rng = random.Random(3)
    left = [("a", 500)] * 400 + [("a", rng.randrange(1000)) for _ in range(400)] + [(None, 5), (None, None)]
    right = [("a", 490 + k % 20, float(k)) for k in range(900)] + [("a", k * 3, float(k)) for k in range(330)] + [(None, 4, 1.5), (None, 6, 2.5), ("b", None, 1.0)]
    a, b = spark.createDataFrame(left, "g string, t int"), spark.createDataFrame(right, "g string, k int, v double")
    got = asof.asof(a, b, "t", "k", "v", by=["g"], forward=forward)
    assert sorted(((r.g, r.t, r.k_asof, r.v) for r in got.collect()), key=repr) == brute_asof(left, right, forward)
    assert all(r.v is None for r in asof.asof(a, b.where("k < 0"), "t", "k", "v", by=["g"], forward=forward).collect())
    assert asof.asof(a.where("t < 0"), b, "t", "k", "v", by=["g"], forward=forward).count() == 0
    clash = a.withColumnsRenamed({"t": "_k", "g": "_at"}).withColumn("_left", F.lit(1))
    assert asof.asof(clash, b.withColumnRenamed("g", "_at"), "_k", "k", "v", by=["_at"], forward=forward).count() == len(left)


def test_curves_read_their_quotes_once(spark):
    """One scan of each source and at most three shuffles, whatever is asked of the curves."""
    import re

    from fathomline import plans

    for name, most in (("hub_curves", 3), ("hub_spreads", 4), ("import_floor", 4), ("first_tenors", 3)):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan|Scan parquet", plan)) == 2, name
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= most, name
        assert "NestedLoop" not in plan and "SinglePartition" not in plan


def test_curve_edges(spark):
    from fathomline.operators import curve

    rows = [("a", "Jan_26", 10.0), ("a", "Feb_26", 20.0), ("a", "Mar_26", 30.0), ("a", "Mar_26", 27.0), ("a", "Q1_27", 40.0), ("a", "Q2_26", 8.0), ("a", "odd", 1.0), ("a", None, 1.0), ("a", "May_26", None), ("b", "Y_26", 12.0), ("b", "Jan_26", 1.0), ("c", "Jun_26", None)]
    quotes = spark.createDataFrame(rows, "hub string, tenor string, price double")
    got = {(r.hub, str(r.start)): r.price for r in curve.monthly_curve(quotes, "2025-12-15", by=["hub"]).collect()}
    mean = 19.0
    assert [round(got["a", f"2027-0{k}-01"], 9) for k in (1, 2, 3)] == [round(40 * x / mean, 9) for x in (10, 20, 27)]
    assert got["a", "2026-03-01"] == 27.0 and got["a", "2026-05-01"] == 8.0 and got["b", "2026-01-01"] == 1.0 and got["b", "2026-12-01"] == 12.0
    assert not any(h == "c" for h, _ in got) and len(got) == 3 + 3 + 3 + 12
    later = {(r.hub, str(r.start)) for r in curve.monthly_curve(quotes, "2026-01-01", by=["hub"]).collect()}
    assert ("a", "2026-01-01") not in later and ("b", "2026-01-01") in later
    assert curve.monthly_curve(quotes.where("hub = 'z'"), "2025-12-15", by=["hub"]).count() == 0
    plain = curve.monthly_curve(quotes.where("hub = 'b'"), "2025-12-15")
    assert plain.count() == 12 and plain.columns == ["start", "price"]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("kind", ["long", "date"])
def test_asof(spark, forward, kind):
    rng = random.Random(5)
    day = (lambda x: x) if kind == "long" else (lambda x: None if x is None else D(2020, 1, 1) + dt.timedelta(days=x))
    left = [(rng.choice("abc"), day(rng.choice([None, *range(400)]))) for _ in range(300)] + [("z", day(3)), ("a", None)]
    right = [(rng.choice("abcd"), day(rng.choice([None, *range(100, 300)])), float(k)) for k in range(60)] + [("a", None, 9.0), ("b", day(150), 1.0), ("b", day(150), 2.0)]
    a, b = spark.createDataFrame(left, f"g string, t {kind}"), spark.createDataFrame(right, f"g string, k {kind}, v double")
    got = asof.asof(a, b, "t", "k", "v", by=["g"], forward=forward)
    assert sorted(((r.g, r.t, r.k_asof, r.v) for r in got.collect()), key=repr) == brute_asof(left, right, forward)
    plain = asof.asof(a.select("t"), b.select("k", "v"), "t", "k", "v", forward=forward)
    want = brute_asof([("x", t) for _, t in left], [("x", k, v) for _, k, v in right], forward)
    assert sorted((("x", r.t, r.k_asof, r.v) for r in plain.collect()), key=repr) == want
    lines = plain._jdf.queryExecution().executedPlan().toString().split("\n")
    # what meets in one task are partial aggregates: the bounds of the stretches and one value for each
    assert all("functions=[partial_" in below for line, below in zip(lines, lines[1:]) if "SinglePartition" in line)
    assert asof.asof(a, b.limit(0), "t", "k", "v", by=["g"], forward=forward).where("v is not null").count() == 0


def brute_waves(rows, per_bar, signed):
    out, state = [], None
    for close, top, bottom, box, vol in rows:
        if state is None:
            state = [close, 0, 1, vol]
        else:
            at, way, bars, total = state
            new = top if top > at + box else bottom if bottom < at - box else at
            turn = 1 if new > at else -1 if new < at else way
            state = [new, turn, bars + 1 if per_bar and turn == way else 1, total + vol if turn == way else vol]
        shown = state[3] / state[2]
        out.append((state[0], state[1], state[2], -shown if signed and state[1] < 0 else shown))
    return out


@pytest.mark.parametrize("per_bar, signed, wide", [(False, False, False), (True, True, True)])
def test_waves(spark, per_bar, signed, wide):
    rng = random.Random(2)
    rows = []
    for name in "pq":
        close = 50.0
        for i in range(120):
            close += rng.gauss(0, 2)
            rows.append((name, i, close, close + 1, close - 1, rng.choice([None, 5.0, 7.0]), 1.5))
    df = spark.createDataFrame(rows, "name string, d int, close double, high double, low double, volume double, box double").repartition(5)
    sides = {"high": "high", "low": "low"} if wide else {}
    got = ts.waves(df, ["name"], "d", "box", signed=signed, per_bar=per_bar, **sides).orderBy("name", "d").collect()
    want = []
    for name in "pq":
        own, before = [], None
        for _, _, close, high, low, volume, box in (r for r in rows if r[0] == name):
            tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
            before = close
            own.append((close, high if wide else close, low if wide else close, box, tr if volume is None else volume))
        want += brute_waves(own, per_bar, signed)
    for r, w in zip(got, want, strict=True):
        assert (r.wave_close, r.direction, r.wave_bars, r.wave_volume) == pytest.approx(w)


def test_wilder_mean_with_gaps(spark):
    rows = [("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0), ("b", 1, None), ("b", 2, 1.0)]
    got = ts.wilder_mean(spark.createDataFrame(rows, "n string, d int, x double"), ["n"], "d", "x", 3).orderBy("n", "d").collect()
    assert [r.rma for r in got] == [2.0, 2.0, 3.0, None, 1.0]


def test_equal_requests_are_rows_of_their_own(spark):
    asked = spark.createDataFrame([("B", "A", 0.01, 0.01, 1e-5, 0.02, 0.01)] * 3 + [("B", "X", 0.01, 0.01, 1e-5, 0.02, 0.01)], "lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")
    got = pricing.model(spark).covariances(asked).orderBy("lsu2").collect()
    assert [r.cov for r in got] == [pytest.approx(0.000465899, abs=1e-6)] * 3 + [None]


def test_factor_model_golden_values(spark):
    m = pricing.model(spark)
    one = m.covariances(spark.createDataFrame([("B", "B", 0.01, 0.01, 1e-5, 0.01, 1e-5)], "lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")).first()
    assert one["cov"] == pytest.approx(0.000946255, abs=1e-6)
    asked = spark.createDataFrame([(1, "B", "A", 0.1, 0.2, 0.1, 0.2, 0.1)], "id int, lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")
    now, over = m.correlations(asked, instant=True).first(), m.correlations(asked).first()
    assert (now.vol1, now.vol2, now["corr"]) == pytest.approx((0.195543738, 0.098825049, 0.426194457), abs=1e-7)
    assert over["corr"] == pytest.approx(0.446090982, abs=1e-7)
    moved = {(r.i, r.j): r.rho for r in m.shift_rho("A", "B", -0.05).rho.collect()}
    assert [moved[k] for k in ((1, 3), (1, 4), (2, 3), (2, 4))] == pytest.approx([0.35, 0.55, 0.45, 0.65])


def test_last_rows_and_missing_edges(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("b", 1, None)], "name string, d int, x double")
    assert ts.missing(rows, ["name"], "x").where("missing = n").count() == 1
    assert ts.last_rows(rows.limit(0), ["name"], "d", 2).count() == 0
    with pytest.raises(ValueError, match="series"):
        ts.pairwise_corr(spark.range(ts.MAX_SERIES + 1).select(F.col("id").alias("n"), F.lit(1).alias("d"), F.lit(0.1).alias("ret")), "n", "d")


def test_simulated_prices_are_martingales_with_the_model_s_variance(spark):
    from fathomline.plans import models

    rows = {r.id: r for r in models.martingale_prices(spark, SF).collect()}
    m = models.nations_model(spark, SF)
    names = [r.lsu for r in m.bridge.select("lsu").distinct().collect()]
    asked = spark.createDataFrame([(f"{u}-{s}", u, u, t, 0.6, 0.1, 0.6, 0.1) for u in names for s, t in enumerate((0.1, 0.5))], "id string, lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")
    assert len(rows) == 2 * len(names) > 10
    for r in m.covariances(asked).collect():
        own = rows[r.id]
        assert own.paths == 20_001 and own["mean"] == pytest.approx(1, abs=5 * (r["cov"] / 20_000) ** 0.5)
        assert own["variance"] == pytest.approx(r["cov"], rel=0.06)


def test_simulated_prices_over_a_currency(spark):
    from fathomline.operators import factors as fc

    m = pricing.model(spark)
    asked = spark.createDataFrame([("x", "A", 0, 0.5, 0.6, 0.1)], "id string, lsu string, step int, t double, tau double, span double")
    states = spark.createDataFrame([(0, 0, k, 0.0) for k in range(1, 5)], "path long, step int, factor int, state double")
    plain = fc.simulated_prices(states, asked, m).first().price
    over = fc.simulated_prices(states, asked, m, spark.createDataFrame([("x", "B")], "id string, lsu2 string")).first().price
    cov = m.covariances(spark.createDataFrame([("A", "B", 0.5, 0.6, 0.1, 0.6, 0.1)], "lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")).first()["cov"]
    assert over / plain == pytest.approx(2.718281828459045 ** -cov)


def test_model_checks(spark):
    from fathomline.operators import covariance as cv, factors as fc

    m = pricing.model(spark)
    assert fc.positive_definite(m)
    bad = cv.Factors(m.factors, m.bridge, m.rho.withColumn("rho", F.when(F.col("i") == F.col("j"), 1.0).otherwise(-0.9)))
    assert not fc.positive_definite(bad)
    changed = m.override_sigma(2, 0.5).factors.where("idx = 2").first().sigma
    assert changed == 0.5 and m.factor_counts().where("n = 2").count() == 2 and m.first_factors(1).factors.count() == 2
    assert m.shift_third("A", 0.1).factors.where("sigma = 0.1 or sigma = 0.15 or sigma = 0.2").count() == 4
    turned = {(r.i, r.j): r.rho for r in m.inverted(2).rho.collect()}
    assert turned[1, 2] == -0.8 and turned[2, 2] == 1.0 and turned[1, 3] == 0.4
    vol = spark.range(1).select(cv.triangulated(F.lit(0.2), F.lit(0.3), F.lit(0.3)).alias("x"), cv.ratio_vol(F.lit(0.2), F.lit(0.3), F.lit(0.3)).alias("y")).first()
    assert vol.x == pytest.approx((0.04 + 0.09 + 2 * 0.3 * 0.06) ** 0.5) and vol.y == pytest.approx((0.04 + 0.09 - 2 * 0.3 * 0.06) ** 0.5)


def test_variance_at_rest_of_one_factor(spark):
    from fathomline.operators import covariance as cv

    one = cv.Factors(spark.createDataFrame([(1, 0.3, 0.7)], "idx int, sigma double, alpha double"), spark.createDataFrame([(1, "A")], "idx int, lsu string"), spark.createDataFrame([(1, 1, 1.0)], "i int, j int, rho double"))
    t, d = 60.0, 0.5
    cov = one.covariances(spark.createDataFrame([("A", "A", t, t, d, t, d)], "lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")).first()["cov"]
    assert cov == pytest.approx(0.09 / 1.4 * ((1 - 2.718281828459045 ** (-0.35)) / 0.35) ** 2, rel=1e-6)


GOLDEN = [("black76", 19, 19, 0.28, 0.75, 0.1, "c", 1.7010507), ("black76", 18, 19, 0.28, 1.0, 0.0, "p", 2.5978), ("black76", 18, 19, 0.28, 0.0, 0.0, "p", 1.0), ("black76", 18, 17, 0.28, 0.0, 0.0, "p", 0.0), ("black76", 20, 18, 0.0, 1.0, 0.0, "c", 2.0), ("black76", 16, 18, 0.0, 1.0, 0.0, "c", 0.0), ("black76", 100, float("inf"), 0.5, 1.0, 0.0, "c", 0.0)]


def test_option_golden_values(spark):
    from fathomline.functions import options as op

    rows = spark.createDataFrame([(i, *map(float, r[1:6]), r[6], float(r[7])) for i, r in enumerate(GOLDEN)], "i int, s double, k double, v double, t double, r double, cp string, want double")
    args = [F.col(c) for c in ("s", "k", "v", "t", "r")]
    for r in rows.withColumn("got", op.black_value(*args, F.col("cp"))).collect():
        assert r.got == pytest.approx(r.want, abs=1e-4), r
    normal = spark.range(1).select(*[op.bachelier_value(F.lit(18.0), F.lit(19.0), F.lit(2.0), F.lit(0.75), F.lit(0.1), F.lit(cp), paid=F.lit(1.0)).alias(cp) for cp in "cp"], op.bachelier_d(F.lit(18.0), F.lit(19.0), F.lit(2.0), F.lit(0.75)).alias("d")).first()
    assert (normal.c, normal.p, normal.d) == pytest.approx((0.27421, 1.179055, -0.57735), abs=1e-4)
    vols = spark.createDataFrame([(float(s), float(k), cp, r) for s, k in ((100, 90), (100, 100), (100, 110)) for cp in "cp" for r in (0.0, 0.05)], "s double, k double, cp string, r double")
    again = vols.select(op.vol_from_premium(op.black_value(F.col("s"), F.col("k"), F.lit(0.25), F.lit(0.5), F.col("r"), F.col("cp")), F.col("s"), F.col("k"), F.lit(0.5), F.col("r"), F.col("cp")).alias("v")).collect()
    assert [r.v for r in again] == pytest.approx([0.25] * 12, rel=1e-5)


def test_copula_spread_is_a_double_integral(spark):
    import numpy as np

    from fathomline.functions import options as op

    x, w = np.polynomial.hermite_e.hermegauss(200)
    w = w / w.sum()
    a, b = np.meshgrid(x, x, indexing="ij")
    for f1, f2, k, v1, v2, rho, t in ((20.0, 15.0, 2.0, 0.3, 0.4, 0.6, 1.0), (20.0, 15.0, -3.0, 0.5, 0.2, -0.3, 0.4)):
        one = f1 * np.exp(v1 * t**0.5 * a - v1 * v1 * t / 2)
        two = f2 * np.exp(v2 * t**0.5 * (rho * a + (1 - rho * rho) ** 0.5 * b) - v2 * v2 * t / 2)
        want = (np.maximum(one - two - k, 0) * w[:, None] * w[None, :]).sum()
        got = spark.range(1).select(op.copula_spread(*[F.lit(z) for z in (f1, f2, k, v1, 0.0, v2, 0.0, rho, t)]).alias("v")).first().v
        assert got == pytest.approx(want, rel=2e-3)


def test_copula_spread_works_out_few_rows_at_once_in_many_tasks(spark, monkeypatch):
    import numpy as np

    from fathomline import plans
    from fathomline.functions import options as op

    one = [np.full((40, 1), x) for x in (20.0, 15.0, 2.0, 0.3, 0.05, 0.4, -0.05, 0.6, 1.0)]
    one[7][:, 0] = np.linspace(-0.95, 0.95, 40)
    whole = op._copula(*one, 500, 7.0)
    near = op.NEAR
    monkeypatch.setattr(op, "NEAR", 40.0)  # nothing is left out
    assert np.allclose(whole, op._copula(*one, 500, 7.0), rtol=1e-13, atol=0) and near > 8
    one[4][3] = one[7][5] = np.nan
    assert np.flatnonzero(np.isnan(op._copula(*one, 500, 7.0))).tolist() == [3, 5]
    got = plans.QUERIES["copula_spread"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 8  # a small file was one task


def test_cheapest_of_three_is_near_its_simulation(spark):
    import numpy as np

    from fathomline.functions import options as op

    f, v, t = [80.0, 82.0, 79.0], [0.3, 0.25, 0.4], 0.8
    rho = np.array([[1, 0.6, 0.3], [0.6, 1, 0.5], [0.3, 0.5, 1]])
    z = np.random.default_rng(1).normal(size=(400_000, 3)) @ np.linalg.cholesky(rho).T
    want = np.min(np.array(f) * np.exp(np.array(v) * t**0.5 * z - np.array(v) ** 2 * t / 2), 1).mean()
    lit = [[F.lit(x) for x in y] for y in (f, v)]
    got = op.with_cheapest(spark.range(1), *lit, F.lit(0.6), F.lit(0.3), F.lit(0.5), F.lit(t), F.lit(0.0)).first().value
    assert got == pytest.approx(want, rel=4e-3)


def test_factor_pairs_meet_their_condition(spark):
    import numpy as np

    from fathomline.functions import options as op

    s = spark.range(1).select(op.two_factor_sigmas(F.lit(0.05), F.lit(0.5), F.lit(0.4), F.lit(6.0), F.lit(1.5), F.lit(0.3)).alias("s")).first().s
    g = [(1 - np.exp(-a)) / a for a in (0.4, 6.0)]
    total = s.slow**2 * g[0] ** 2 / 0.8 + 2 * 0.3 * s.slow * s.fast * g[0] * g[1] / 6.4 + s.fast**2 * g[1] ** 2 / 12
    q = -1.6448536269514722
    assert total**0.5 == pytest.approx(q + (q * q - 2 * np.log(0.5)) ** 0.5) and s.fast / s.slow == pytest.approx(1.5)


def test_implied_vol_of_the_least_of_three(spark):
    from fathomline.operators import montecarlo as mc

    base = {"f0": 80.0, "f1": 81.0, "f2": 79.5, "v0": 0.3, "v1": 0.3, "v2": 0.3, "t": 0.5, "r": 0.04}
    rho = [[1.0, 0.5, 0.3], [0.5, 1.0, 0.4], [0.3, 0.4, 1.0]]
    draws = mc.correlated(mc.paths(spark, 20_000, 3, antithetic=True), rho)
    price = mc.scenario_values(draws, mc.shifted(base, {})).first().value
    assert mc.implied_least_vol(draws, base, price) == pytest.approx(0.3, abs=1e-3)
    assert mc.implied_least_vol(draws, base, 500.0) is None


def test_curves_keep_started_months_and_bounds(spark):
    from fathomline.operators import montecarlo as mc

    def curves(sigmas, alphas, low, high):
        row = ("x", [3.0, 3.2], [0.25, 1.0], [0.1, 0.3, 0.6], sigmas, alphas, low, high, None)
        return spark.createDataFrame([row], "id string, forwards array<double>, starts array<double>, times array<double>, sigmas array<double>, alphas array<double>, low double, high double, drift double")

    rows = mc.simulate_curve(curves([0.5], [1.2], 2.0, 4.0), "id", 4000).toPandas()
    assert rows["price"].between(2.0, 4.0).all()
    free = mc.simulate_curve(curves([0.3, 0.2], [1.2, 4.0], None, None), "id", 4000).toPandas()
    assert sorted(free["path"].unique()) == list(range(4000)) and set(free["id"]) == {"x"}
    first = free[free["tenor"] == 0].pivot(index="path", columns="step", values="price")
    assert (first[1] == first[2]).all() and (first[0] != first[1]).any()
    mean = free[free["step"] == 2].groupby("tenor")["price"].agg(["mean", "sem"])
    assert (abs(mean["mean"] - [3.0, 3.2]) < 4 * mean["sem"]).all()


def test_deals_are_simulated_each_on_the_same_paths(spark):
    """Equal deals have equal values wherever they are; values don't depend on other rows or partitions; nulls and empty tables."""
    from fathomline.operators import montecarlo as mc

    rho = [[1.0, 0.4], [0.4, 1.0]]
    schema = "id long, f0 double, f1 double, v0 double, v1 double, strike double, t double, r double"
    rows = [(k, 10.0 + k % 2, 8.0, 0.3, 0.2, 1.0, 0.5, 0.01) for k in range(4)] + [(9, None, 8.0, 0.3, 0.2, 1.0, 0.5, 0.01)]
    deals = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in mc.spread_option(deals, ["id"], rho, 25_001, seed=3).collect()}
    assert got[0].value == pytest.approx(got[2].value, rel=1e-12) and got[1].value > got[0].value and got[0].paths == 25_001
    assert got[9].value is None and got[9].paths == 0
    alone = mc.spread_option(deals.where("id = 3").repartition(3), ["id"], rho, 25_001, seed=3).first()
    assert alone.value == pytest.approx(got[3].value, rel=1e-12)
    assert mc.spread_option(deals.where("id < 0"), ["id"], rho, 1000).count() == 0 and mc.deal_paths(deals, 0, 2).count() == 0
    plain = mc.correlated(mc.paths(spark, 25_001, 2, seed=3), rho).select(mc.terminal(F.lit(10.0), F.lit(0.3), F.lit(0.5), F.col("w0")).alias("a"), mc.terminal(F.lit(8.0), F.lit(0.2), F.lit(0.5), F.col("w1")).alias("b"))
    want = plain.agg(F.avg(F.greatest(F.col("a") - F.col("b") - 1.0, F.lit(0.0)) * F.exp(F.lit(-0.005)))).first()[0]
    assert got[0].value == pytest.approx(want, rel=1e-9)


def test_correlations_by_row_are_those_of_the_matrix(spark):
    from fathomline.operators import montecarlo as mc

    draws = mc.paths(spark, 500, 3, seed=1)
    by_row = mc.correlated_three(draws, F.lit(0.5), F.lit(-0.3), F.lit(0.4)).orderBy("path").toPandas()
    fixed = mc.correlated(draws, [[1.0, 0.5, -0.3], [0.5, 1.0, 0.4], [-0.3, 0.4, 1.0]]).orderBy("path").toPandas()
    assert (abs(by_row[["w0", "w1", "w2"]] - fixed[["w0", "w1", "w2"]]).max() < 1e-12).all()


def test_local_vol_without_smile_is_a_spread(spark):
    from fathomline.operators import montecarlo as mc

    flat = ([0.0, 1.0], [1.0, 1000.0], [[0.3, 0.3], [0.3, 0.3]])
    deal = spark.createDataFrame([(1, 100.0, 90.0, 0.6, 0.0, 0.5, 0.0)], "id long, f1 double, f2 double, rho double, strike double, t double, r double")
    r = mc.local_vol_spread(deal, "id", flat, flat, 10, 40_000).first()
    from fathomline.functions import options as op

    want = op.with_margrabe(spark.range(1), "v", F.lit(100.0), F.lit(90.0), F.lit(0.3), F.lit(0.3), F.lit(0.6), F.lit(0.5)).first().v
    assert abs(r.value - want) < 4 * r.error


def test_interpolation_between_points_of_groups(spark):
    points = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 4.0, 0.0), ("b", 0.0, 5.0)], "g string, x double, y double")
    asked = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 3.0, 4.0, 5.0)] + [("a", None), ("b", 1.0), ("c", 1.0)], "g string, t double")
    want = {0.0: 0.0, 1.0: 10.0, 1.5: 15.0, 3.0: 10.0, 4.0: 0.0, 5.0: -10.0}
    got = asof.interpolate(asked, points, "t", "x", "y", by=["g"]).collect()
    assert {(r.g, r.t): r.y for r in got} == {**{("a", k): v for k, v in want.items()}, ("a", None): None, ("b", 1.0): None, ("c", 1.0): None}
    flat = asof.interpolate(asked.where("g = 'a'").select("t"), points.where("g = 'a'").select("x", "y"), "t", "x", "y", flat=True).collect()
    assert {r.t: r.y for r in flat} == {**want, 0.0: 10.0, 5.0: 0.0, None: None}


def test_what_was_known(spark):
    """Corrections, quotes known late, taken back or stale, against plain Python."""
    rng = random.Random(12)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    quotes = [(rng.choice(["a", "b", None]), day(v), day(v + rng.choice([0, 1, 1, 2, 5, 30])), rng.choice([None, float(rng.randrange(100))])) for v in (rng.randrange(60) for _ in range(150))]
    quotes += [("a", None, day(3), 1.0), ("a", day(3), None, 1.0)]
    asked = [(rng.choice(["a", "b", "c", None]), day(d), day(d + rng.choice([-1, 0, 1, 3, 40]))) for d in (rng.randrange(70) for _ in range(200))] + [("a", None, day(3)), ("a", day(3), None)]
    asked += asked[:5]

    def brute(g, d, at):
        own = [q for q in quotes if q[0] == g and None not in (q[1], q[2], d, at) and d - dt.timedelta(days=6) <= q[1] <= d and q[2] <= at]
        v = max((q[1] for q in own), default=None)
        k = max((q[2] for q in own if q[1] == v), default=None)
        return v, k, max((q[3] for q in own if q[1:3] == (v, k) and q[3] is not None), default=None)

    a, q = spark.createDataFrame(asked, "g string, d date, at date"), spark.createDataFrame(quotes, "g string, v date, k date, x double")
    got = asof.known_asof(a, q, ["g"], "d", "at", "v", "k", "x", 6)
    assert got.columns == ["g", "d", "at", "v", "k", "x"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*r, *brute(*r)) for r in asked), key=repr)
    assert asof.known_asof(a, q.where("v is null"), ["g"], "d", "at", "v", "k", "x", 6).where("v is not null").count() == 0
