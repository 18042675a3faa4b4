"""Queries and inputs that cover all rows of their tables."""

import math

import numpy as np
import pytest

from fathomline import plans
from fathomline.plans import simulations
from fathomline.plans.mapping import trades

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_release_documents_cover_all_orders(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert simulations.documents(spark, SF).count() == lines.select("l_orderkey").distinct().count()
    assert plans.QUERIES["release_points_all"](spark, SF).count() == lines.count()
    april = lines.where("date_format(l_shipdate, 'yyyy-MM') = '1996-04'").count()
    assert plans.QUERIES["release_month_all"](spark, SF).count() == april > 0


def cdf(x):
    return np.vectorize(lambda v: math.erfc(-v / math.sqrt(2)) / 2)(x)


def pdf(x):
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


@pytest.fixture(scope="module")
def priced(spark):
    """All trades with their forward call premiums by erfc: c, b (normal), and the time values in them."""
    x = trades(spark, LARGER).select("id", "s", "k", "vol", "t", "r", "cp").toPandas().set_index("id").sort_index()
    sd, nsd = x.vol * np.sqrt(x.t), x.vol * x.s * np.sqrt(x.t)
    x["d1"] = np.log(x.s / x.k) / sd + sd / 2
    x["c"] = x.s * cdf(x.d1) - x.k * cdf(x.d1 - sd)
    x["b"] = (x.s - x.k) * cdf((x.s - x.k) / nsd) + nsd * pdf((x.s - x.k) / nsd)
    low = np.maximum(x.s - x.k, 0)
    return x.assign(tc=x.c - low, tb=x.b - low)


def whole(spark, name, priced):
    rows = plans.QUERIES[name](spark, LARGER).toPandas().set_index("id").sort_index()
    assert rows.index.equals(priced.index)
    return rows


def test_implied_vols_of_all_trades(spark, priced):
    vol = whole(spark, "implied_vols_all", priced).vol
    sure = (priced.tc / 1e-8 - 1).abs() > 0.01
    assert (vol.isna() == (priced.tc <= 1e-8))[sure].all() and 0 < vol.isna().sum() < 1000
    assert (vol - priced.vol).abs().max() < 2e-5


def test_bachelier_vols_of_all_trades(spark, priced):
    vol = whole(spark, "bachelier_vols_all", priced).vol
    sure = (priced.tb / 1e-10 - 1).abs() > 0.05
    assert (vol.isna() == (priced.tb <= 1e-10))[sure].all() and vol.isna().sum() < 1000
    assert (vol - priced.vol * priced.s).abs().max() < 2e-3


def test_approximate_vols_of_all_trades(spark, priced):
    x, rows = priced, whole(spark, "approximate_vols_all", priced)
    half, scale = x.c - (x.s - x.k) / 2, np.sqrt(2 * np.pi / x.t)
    corrado = scale / (x.s + x.k) * (half + np.sqrt(np.maximum(half**2 - (x.s - x.k) ** 2 / np.pi, 0)))
    sure = (x.tc / 1e-8 - 1).abs() > 0.01
    assert (rows.corrado.isna() == (x.tc <= 1e-8))[sure].all()
    assert (rows.corrado - corrado).abs().max() < 2e-6
    assert (rows.bharadia - scale * half / (x.s - (x.s - x.k) / 2)).abs().max() < 2e-6


def test_delta_strikes_of_all_trades(spark, priced):
    x, rows = priced, whole(spark, "delta_strikes_all", priced)
    assert rows.strike.notna()[x.d1.abs() < 8].all() and (rows.strike / x.k - 1).abs().max() < 1e-6
    w = np.where(x.cp == "c", 1, -1)
    star = w * cdf(w * np.log(x.s / x.k) / (x.vol * np.sqrt(x.t))) * np.exp(-x.r * x.t)
    assert (rows.star - star).abs().max() < 2e-7


@pytest.mark.parametrize("name", ["netback_rows", "release_month", "release_month_all"])
def test_documents_are_read_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_margins_read_their_pages_once(spark):
    plan = plans.QUERIES["terminal_margins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "from_json(" not in plan and "lineitem" not in plan  # staged before the as-of join


@pytest.mark.parametrize("name", ["model_loadings", "scaled_loadings"])
def test_loadings_shuffle_no_rows(spark, name, monkeypatch):
    from fathomline.operators import factors

    found = plans.QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "hashpartitioning(_n#" not in plan
    monkeypatch.setattr(factors, "MOST_FACTORS", 0)  # too many stretches and factors for arrays in all tasks
    joined = plans.QUERIES[name](spark, SF)
    assert found.exceptAll(joined).isEmpty() and joined.exceptAll(found).isEmpty()
