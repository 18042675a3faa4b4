"""The pricing functions by name: the same as the columns, in the caller's plan, with defaults and nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline import plans
from fathomline.functions import catalog, options as op
from fathomline.plans import pricing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    return catalog.register(spark)


def test_functions_are_the_columns(spark, names):
    rows = pricing._dated_trades(spark, SF)
    rows.createOrReplaceTempView("t")
    c = F.col
    want = op.with_black_dated(rows, c("pricing"), c("expiry"), c("s"), c("k"), c("vol"), c("r"), c("cp")).select("id", "value", "delta", "gamma", "vega", "theta")
    got = spark.sql("SELECT t.id, x.* FROM t, LATERAL black76_risks(t.pricing, t.expiry, t.s, t.k, t.cp, t.vol, t.r) x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = op.with_kirk_dated(rows, c("pricing"), c("expiry"), c("s"), c("k"), F.lit(2.0), c("vol"), F.lit(0.3), F.lit(0.4), c("r"), c("cp")).select("id", *catalog.KIRK)
    got = spark.sql("SELECT t.id, x.* FROM t, LATERAL kirk_risks(t.pricing, t.expiry, t.s, t.k, 2D, t.cp, t.vol, 0.3D, 0.4D, t.r) x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    vols = op.vol_from_premium(c("s") * 0.2, c("s"), c("k"), F.datediff("expiry", "pricing") / 365, c("r"), c("cp"))
    got = spark.sql("SELECT id, black76_vol_from_premium(pricing, expiry, s, k, s * 0.2D, cp, r) AS v FROM t")
    both = rows.select("id", vols.alias("w")).join(got, "id")
    assert both.where("not (v <=> w)").count() == 0 and both.where("v is not null").count() > 100


def test_no_python_worker_in_the_plans(spark, names):
    pricing._dated_trades(spark, SF).createOrReplaceTempView("t")
    for text in ("SELECT t.id, x.* FROM t, LATERAL kirk_risks(t.pricing, t.expiry, t.s, t.k, 2D, t.cp, t.vol, 0.3D, 0.4D) x", "SELECT black76_delta(pricing, expiry, s, k, cp, vol), norm_ppf(vol) FROM t"):
        plan = spark.sql(text)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_defaults_nulls_and_clashing_names(spark, names):
    day = "DATE'2024-01-01', DATE'2025-01-01'"
    plain, zero = spark.sql(f"SELECT black76_price({day}, 100D, 95D, 'c', 0.3D) AS a, black76_price({day}, 100D, 95D, 'c', 0.3D, 0D) AS b").first()
    assert plain == zero == pytest.approx(14.0, abs=0.5)
    row = spark.sql(f"SELECT black76_price({day}, NULL, 95D, 'c', 0.3D) AS a, black76_price({day}, 100D, 95D, 'x', 0.3D) AS b, norm_cdf(NULL) AS c, norm_ppf(2D) AS d, kirk_vega({day}, 100D, 90D, 5D, 'c', 0.3D, NULL, 0.5D) AS e, black76_vol_from_premium({day}, 100D, 95D, 1D, 'c') AS f").first()
    assert row.asDict() == dict.fromkeys("abcdef")
    # the caller's columns bear the names of parameters
    clash = spark.createDataFrame([(dt.date(2024, 1, 1), 7.0, 0.5, 100.0)], "expiry_date date, vol double, strike double, forward_price double")
    clash.createOrReplaceTempView("clash")
    got = spark.sql(f"SELECT x.value, black76_price({day}, c.forward_price, 95D, 'c', 0.3D) AS p FROM clash c, LATERAL black76_risks({day}, c.forward_price, 95D, 'c', 0.3D) x").first()
    assert got.value == got.p == plain


def test_all_are_registered_and_can_be_again(spark, names):
    assert {"black76_price", "black76_vol_from_premium", "kirk_risks", "kirk_delta", "kirk_gamma", "kirk_vega_by_leg", "kirk_corr_sensitivity", "norm_ppf"} <= set(names)
    assert catalog.register(spark) == names
    known = {r.function for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    assert all(any(k.endswith(n) for k in known) for n in names)


def test_model_functions(spark):
    m = pricing.model(spark)
    assert catalog.register_model(spark, m, "own") == ["own_vol", "own_corr"]
    asked = spark.createDataFrame([(1, "A", "B", 0.5, 0.6, 0.1, 0.9, 0.25), (2, "B", "B", 0.1, 0.2, 0.0, 0.2, 0.0), (3, "A", "Z", 0.5, 0.6, 0.1, 0.9, 0.25)], "id int, lsu1 string, lsu2 string, t double, t1 double, d1 double, t2 double, d2 double")
    asked.createOrReplaceTempView("asked")
    want = {r.id: r for r in m.correlations(asked).collect()}
    got = {r.id: r for r in spark.sql("SELECT a.id, x.* FROM asked a, LATERAL own_corr(a.lsu1, a.t1, a.d1, a.lsu2, a.t2, a.d2, a.t) x").collect()}
    assert set(got) == {1, 2}
    for k, r in got.items():
        assert (r["corr"], r.vol1, r.vol2) == pytest.approx((want[k]["corr"], want[k].vol1, want[k].vol2), rel=1e-12)
    vols = {r.id: r.vol for r in spark.sql("SELECT a.id, x.vol FROM asked a, LATERAL own_vol(a.lsu1, a.t, a.t1, a.d1) x").collect()}
    assert vols == pytest.approx({k: want[k].vol1 for k in (1, 2, 3)}, rel=1e-12) if want[3].vol1 else len(vols) == 3


def test_queries(spark):
    assert plans.QUERIES["sql_term_corr"](spark, SF).count() > 0
