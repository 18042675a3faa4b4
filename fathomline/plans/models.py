"""Queries on factor models in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import covariance as cv, factors as fc, montecarlo as mc
from fathomline.plans.pricing import _model_sql, model, rounded
from fathomline.plans.registry import query
from fathomline.sources.files import table

def stored(spark, sf_dir):
    """A model table made from the nations: a factor each, neighbours of a region share every fifth."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.concat(F.lit("U"), F.col("n_regionkey").cast("string"))
    shared = F.when(k % 5 == 0, F.concat(name, F.lit(" ;U"), (F.col("n_regionkey") + 5).cast("string"))).when(k >= 23, None).otherwise(name)
    rows = n.select(k.alias("place"), shared.alias("underlying"), (k % 3).alias("factor"), (0.1 + k / 100.0).alias("sigma"), (0.5 + k).cast("string").alias("alpha"))
    other = n.select(F.col("n_nationkey").alias("col"))
    cells = n.select(k.alias("row")).join(other, F.abs(F.col("row") - F.col("col")) <= 24)  # 25 x 25
    return rows, cells.select("row", "col", F.exp(-F.abs(F.col("row") - F.col("col")) / 10.0).alias("rho"))


@query("model_rows", """SELECT n_nationkey AS place, CASE WHEN n_nationkey % 5 = 0 THEN 'U' || n_regionkey || ';U' || (n_regionkey + 5) ELSE 'U' || n_regionkey END AS underlying, n_nationkey % 3 AS factor, round(0.1 + n_nationkey / 100.0, 9) AS sigma, round(0.5 + n_nationkey, 9) AS alpha FROM nation WHERE n_nationkey < 23""")
def model_rows(spark, sf_dir):
    """A model read from a table, up to the first blank underlying, and written as one again."""
    return fc.to_table(fc.from_table(*stored(spark, sf_dir))).select("place", "underlying", "factor", F.round("sigma", 9).alias("sigma"), F.round("alpha", 9).alias("alpha"))


@query("model_rho", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(exp(-abs(a.n_nationkey - b.n_nationkey) / 10.0), 9) AS rho FROM nation a, nation b WHERE a.n_nationkey < 23 AND b.n_nationkey < 23")
def model_rho(spark, sf_dir):
    return fc.from_table(*stored(spark, sf_dir)).rho.select("i", "j", F.round("rho", 9).alias("rho"))


@query("model_places", "WITH u AS (SELECT n_nationkey AS idx, 'U' || n_regionkey AS lsu FROM nation WHERE n_nationkey < 23 UNION ALL SELECT n_nationkey, 'U' || (n_regionkey + 5) FROM nation WHERE n_nationkey < 23 AND n_nationkey % 5 = 0) SELECT lsu, idx, row_number() OVER (PARTITION BY lsu ORDER BY idx) AS k FROM u")
def model_places(spark, sf_dir):
    """Factors of each underlying, slowest first."""
    return fc.from_table(*stored(spark, sf_dir)).indices().select("lsu", "idx", "k")


@query("model_doubles", "WITH u AS (SELECT n_nationkey % 3 AS factor, 'U' || n_regionkey AS lsu FROM nation WHERE n_nationkey < 23 UNION ALL SELECT n_nationkey % 3, 'U' || (n_regionkey + 5) FROM nation WHERE n_nationkey < 23 AND n_nationkey % 5 = 0) SELECT lsu, factor, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) > 1")
def model_doubles(spark, sf_dir):
    """Underlyings that have a factor number more than once."""
    return fc.double_factors(fc.from_table(*stored(spark, sf_dir)).bridge)


@query("model_subset", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey < 23 AND b.n_nationkey < 23 AND a.n_regionkey IN (1, 2) AND b.n_regionkey IN (1, 2)")
def model_subset(spark, sf_dir):
    return fc.subset(fc.from_table(*stored(spark, sf_dir)), ["U1", "U2"]).rho.select("i", "j")


def nations_model(spark, sf_dir):
    return fc.from_table(*stored(spark, sf_dir))


#: Correlations of the stored model, with the regions of both factors.
_CELLS = "cells AS (SELECT CAST(a.n_nationkey AS INTEGER) AS i, CAST(b.n_nationkey AS INTEGER) AS j, a.n_regionkey AS r, b.n_regionkey AS q, exp(-abs(a.n_nationkey - b.n_nationkey) / 10.0) AS rho FROM nation a, nation b WHERE a.n_nationkey < 23 AND b.n_nationkey < 23)"


@query("shifted_rho", f"WITH {_CELLS} SELECT i, j, round(CASE WHEN least(r, q) = 1 AND greatest(r, q) = 2 THEN rho - 0.05 ELSE rho END, 9) AS rho FROM cells")
def shifted_rho(spark, sf_dir):
    """Correlations between two underlyings' factors moved down."""
    return nations_model(spark, sf_dir).shift_rho("U1", "U2", -0.05).rho.select("i", "j", F.round("rho", 9).alias("rho"))


@query("scaled_factors", "SELECT CAST(n_nationkey AS INTEGER) AS idx, round((0.1 + n_nationkey / 100.0) * CASE WHEN n_regionkey = 1 THEN 1.5 ELSE 1 END, 9) AS sigma FROM nation WHERE n_nationkey < 23")
def scaled_factors(spark, sf_dir):
    return nations_model(spark, sf_dir).scale_sigma("U1", 1.5).factors.select("idx", F.round("sigma", 9).alias("sigma"))


@query("pulled_rho", f"WITH {_CELLS} SELECT i, j, round(CASE WHEN i = j THEN 1 ELSE rho * 0.9 + 0.1 END, 9) AS rho FROM cells")
def pulled_rho(spark, sf_dir):
    return nations_model(spark, sf_dir).pull_rho(0.1).rho.select("i", "j", F.round("rho", 9).alias("rho"))


_SLOWEST = "o AS (SELECT CAST(n_nationkey AS INTEGER) AS idx, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey < 23)"


@query("third_factors", f"WITH {_SLOWEST} SELECT idx, round(0.1 + idx / 100.0 + CASE WHEN r = 2 AND k = 3 THEN 0.05 ELSE 0 END, 9) AS sigma FROM o")
def third_factors(spark, sf_dir):
    """Volatilities with that of an underlying's third factor moved up."""
    return nations_model(spark, sf_dir).shift_third("U2", 0.05).factors.select("idx", F.round("sigma", 9).alias("sigma"))


@query("most_factors", "WITH u AS (SELECT 'U' || n_regionkey AS lsu FROM nation WHERE n_nationkey < 23 UNION ALL SELECT 'U' || (n_regionkey + 5) FROM nation WHERE n_nationkey < 23 AND n_nationkey % 5 = 0) SELECT lsu, count(*) AS n FROM u GROUP BY 1")
def most_factors(spark, sf_dir):
    """How many factors each underlying has."""
    return nations_model(spark, sf_dir).factor_counts()


@query("inverted_rate", f"WITH {_CELLS} SELECT i, j, round(CASE WHEN (i = 7) <> (j = 7) THEN -rho ELSE rho END, 9) AS rho FROM cells")
def inverted_rate(spark, sf_dir):
    """The model with one currency factor seen from the other side."""
    return nations_model(spark, sf_dir).inverted(7).rho.select("i", "j", F.round("rho", 9).alias("rho"))


@query("crossed_rates", f"WITH {_CELLS} SELECT i, j, round(sqrt(power(0.1 + i / 100.0, 2) + power(0.1 + j / 100.0, 2) + 2 * rho * (0.1 + i / 100.0) * (0.1 + j / 100.0)), 9) AS vol FROM cells")
def crossed_rates(spark, sf_dir):
    """Volatilities of the products of all two rates."""
    m = nations_model(spark, sf_dir)
    own = lambda k: m.factors.select(F.col("idx").alias(k), F.col("sigma").alias(f"_{k}"))
    rows = m.rho.join(own("i"), "i").join(own("j"), "j")
    return rows.select("i", "j", F.round(cv.triangulated(F.col("_i"), F.col("_j"), F.col("rho")), 9).alias("vol"))


@query("model_problems", f"""WITH {_CELLS} SELECT 'asymmetric' AS problem, i || '-' || j AS "at" FROM cells WHERE j = i + 1 AND i % 6 = 1 UNION ALL SELECT 'asymmetric', j || '-' || i FROM cells WHERE j = i + 1 AND i % 6 = 1
UNION ALL SELECT 'diagonal', i || '-' || j FROM cells WHERE i = j AND i % 7 = 3 UNION ALL SELECT 'beyond one', i || '-' || j FROM cells WHERE i + j = 11 AND i > 8 UNION ALL SELECT 'beyond one', j || '-' || i FROM cells WHERE i + j = 11 AND i > 8""")
def model_problems(spark, sf_dir):
    """What is wrong with the stored model when some of its cells are spoilt."""
    m, i, j = nations_model(spark, sf_dir), F.col("i"), F.col("j")
    bad = F.when((j == i + 1) & (i % 6 == 1), F.col("rho") - 0.2).when((i == j) & (i % 7 == 3), 0.5).when((i + j == 11) & (F.abs(i - j) > 5), 1.5).otherwise(F.col("rho"))
    return cv.Factors(m.factors, m.bridge, m.rho.withColumn("rho", bad)).problems()


#: Currency pairs as the factors of the stored model: some are seen from USD, some turned round, every fourth from a currency that has a pair of its own.
_PAIRS = "pairs AS (SELECT CAST(n_nationkey AS INTEGER) AS idx, CASE n_nationkey % 4 WHEN 1 THEN 'C' || (n_nationkey - 1) WHEN 2 THEN 'C' || n_nationkey ELSE 'USD' END AS currency, CASE n_nationkey % 4 WHEN 2 THEN 'USD' ELSE 'C' || n_nationkey END AS other FROM nation WHERE n_nationkey < 23)"
_W = "w AS (SELECT CAST(n_nationkey AS INTEGER) AS i, CAST(n_nationkey AS INTEGER) AS k, (0.1 + n_nationkey / 100.0) * CASE WHEN n_nationkey % 4 = 2 THEN -1 ELSE 1 END AS w FROM nation WHERE n_nationkey < 23 UNION ALL SELECT CAST(n_nationkey AS INTEGER), CAST(n_nationkey - 1 AS INTEGER), 0.1 + (n_nationkey - 1) / 100.0 FROM nation WHERE n_nationkey < 23 AND n_nationkey % 4 = 1)"


def currency_pairs(spark, sf_dir):
    k = F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("C"), x.cast("string"))
    own = F.when(k % 4 == 1, name(k - 1)).when(k % 4 == 2, name(k)).otherwise("USD")
    return table(spark, sf_dir, "nation").where("n_nationkey < 23").select(k.alias("idx"), own.alias("currency"), F.when(k % 4 == 2, "USD").otherwise(name(k)).alias("foreign"))


@query("model_currency", f"""WITH {_CELLS}, {_W}, c AS (SELECT a.i, b.i AS j, sum(a.w * b.w * rho) AS cov FROM w a, w b JOIN cells ON a.k = cells.i AND b.k = cells.j GROUP BY 1, 2)
SELECT c.i, c.j, round(sqrt(x.cov), 9) AS sigma, round(c.cov / sqrt(x.cov * y.cov), 9) AS rho FROM c JOIN c x ON x.i = c.i AND x.j = c.i JOIN c y ON y.i = c.j AND y.j = c.j""")
def model_currency(spark, sf_dir):
    """The stored model's pairs all seen from USD: some turned round, some through a third currency."""
    new, _ = fc.in_currency(nations_model(spark, sf_dir), currency_pairs(spark, sf_dir), "USD")
    return new.rho.join(new.factors.select(F.col("idx").alias("i"), "sigma"), "i").select("i", "j", F.round("sigma", 9).alias("sigma"), F.round("rho", 9).alias("rho"))


@query("model_pairs", """SELECT CAST(n_nationkey AS INTEGER) AS idx, 'USD' AS currency, 'C' || n_nationkey AS "foreign" FROM nation WHERE n_nationkey < 23""")
def model_pairs(spark, sf_dir):
    return fc.in_currency(nations_model(spark, sf_dir), currency_pairs(spark, sf_dir), "USD")[1]


@query("pivot_currencies", f"WITH {_PAIRS}, s AS (SELECT idx, currency FROM pairs WHERE idx % 4 <> 1 UNION SELECT idx, other FROM pairs WHERE idx % 4 <> 1) SELECT currency FROM s GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM pairs WHERE idx % 4 <> 1)")
def pivot_currencies(spark, sf_dir):
    """The currency that all pairs but those from elsewhere have in common."""
    return fc.pivot_currencies(currency_pairs(spark, sf_dir).where("idx % 4 <> 1"))


_ORDERS = "q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS lsu, CAST(o_orderdate AS DATE) AS pricing, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 20 END AS ex, CAST(o_orderdate AS DATE) + CAST(40 + o_custkey % 300 AS INTEGER) AS start FROM orders)"


def _orders(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("lsu"), day.alias("pricing"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 20)).alias("ex"), F.date_add(day, (40 + F.col("o_custkey") % 300).cast("int")).alias("start"))


def _dated(spark, sf_dir):
    return fc.dated(_orders(spark, sf_dir), F.col("pricing"), F.col("ex"), F.col("start"), F.date_add("start", 29))


_T = f"{_ORDERS}, d AS (SELECT id, lsu, pricing, date_diff('day', pricing, coalesce(ex, start - 1)) / 365.0 AS t, date_diff('day', pricing, start) / 365.0 AS T1, 30 / 365.0 AS D FROM q)"


@query("dated_times", f"WITH {_T} SELECT id, round(t, 9) AS exercise, round(T1, 9) AS delivery, round(D, 9) AS duration FROM d")
def dated_times(spark, sf_dir):
    """Years to exercise, to delivery and of delivery of every order."""
    return _dated(spark, sf_dir).select("id", *[F.round(a, 9).alias(b) for a, b in (("t", "exercise"), ("tau", "delivery"), ("span", "duration"))])


_MODEL = _model_sql().split("\nq AS")[0].rstrip(",")
_M = "sigma * exp(-{f}.alpha * (T1 - t)) * (1 - exp(-{f}.alpha * D)) / ({f}.alpha * D)"


@query("dated_vols", f"""WITH {_MODEL}, {_T} SELECT id, round(sqrt(sum(x.{_M.format(f='x')} * v * (1 - exp(-(x.alpha + y.alpha) * t)) / (x.alpha + y.alpha) * y.{_M.format(f='y')}) / any_value(t)), 7) AS vol FROM d JOIN f x ON x.lsu = d.lsu JOIN f y ON y.lsu = d.lsu JOIN rho ON rho.i = x.idx AND rho.j = y.idx GROUP BY id""")
def dated_vols(spark, sf_dir):
    """Volatility until exercise of every order's delivery."""
    d = _dated(spark, sf_dir).select("id", F.col("lsu").alias("lsu1"), F.col("lsu").alias("lsu2"), "t", F.col("tau").alias("t1"), F.col("span").alias("d1"), F.col("tau").alias("t2"), F.col("span").alias("d2"))
    return model(spark).correlations(d).select("id", *rounded(7, vol=F.col("vol1")))


@query("model_loadings", f"""WITH {_MODEL}, {_T}, m AS (SELECT id, lsu, idx AS factor, {_M.format(f='f')} AS load FROM (SELECT * FROM d) d JOIN f USING (lsu)),
w AS (SELECT a.id, sum(a.load * b.load * v) AS var FROM m a JOIN m b ON a.id = b.id JOIN rho ON rho.i = a.factor AND rho.j = b.factor GROUP BY 1) SELECT id, factor, round(load, 8) AS loading, round(load / sqrt(var), 8) AS part FROM m JOIN w USING (id)""")
def model_loadings(spark, sf_dir):
    """Loadings of every order's delivery at exercise, and what part of the volatility each is."""
    d = _dated(spark, sf_dir).select("id", "lsu", "t", "tau", "span")
    return fc.loadings(d, model(spark)).select("id", "factor", *rounded(8, loading=F.col("loading"), part=F.col("part")))


#: Stretches of delivery time over which volatility is scaled.
SCALES = [("A", 0.0, 0.25, 1.5), ("A", 0.25, 2.0, 1.0), ("B", 0.0, 0.3, 0.5), ("B", 0.3, 0.6, 2.0), ("B", 0.6, 2.0, 1.0)]
_PIECE = "sigma * exp(-f.alpha * (lo - t)) * (1 - exp(-f.alpha * (hi - lo))) / (f.alpha * (hi - lo))"


@query("scaled_loadings", f"""WITH {_MODEL}, {_T}, s(lsu, a, b, scale) AS (VALUES {', '.join(map(str, SCALES))}), p AS (SELECT id, d.lsu, t, D, scale, greatest(a, T1) AS lo, least(b, T1 + D) AS hi FROM d JOIN s ON s.lsu = d.lsu AND a < T1 + D AND b > T1)
SELECT id, idx AS factor, round(sum({_PIECE} * scale * (hi - lo)) / any_value(D), 8) AS loading FROM p JOIN f USING (lsu) GROUP BY 1, 2""")
def scaled_loadings(spark, sf_dir):
    """Loadings with volatility scaled over stretches of delivery time, their mean by length."""
    d = _dated(spark, sf_dir).select("id", "lsu", "t", "tau", "span")
    scales = spark.createDataFrame(SCALES, "lsu string, first double, last double, scale double")
    return fc.loadings(d, model(spark), scales).select("id", "factor", *rounded(8, loading=F.col("loading")))


@query("spot_ratios", f"WITH {_T} SELECT id, round(1 + (month(pricing + CAST(round(T1 * 365) AS INTEGER)) + CASE lsu WHEN 'A' THEN 0 ELSE 12 END) / 100.0, 9) AS ratio FROM d")
def spot_ratios(spark, sf_dir):
    """Ratio of spot to forward volatility of the calendar month that a delivery starts in; the ratios are a table with a column for each underlying."""
    wide = spark.range(1, 13).select(F.col("id").alias("month"), (1 + F.col("id") / 100.0).alias("A"), (1 + (F.col("id") + 12) / 100.0).alias("B"))
    d = _dated(spark, sf_dir).select("id", "lsu", "pricing", "tau")
    return fc.spot_ratios(d, fc.ratio_table(wide, "month"), F.col("pricing")).select("id", F.round("ratio", 9).alias("ratio"))


@query("ratio_vols", f"""WITH {_model_sql()}, c AS (SELECT q.id, q.t, x.lsu AS u, y.lsu AS w, sum(x.sigma * exp(-x.alpha * (CASE x.lsu WHEN 'A' THEN q.t1 ELSE q.t2 END - q.t)) * (1 - exp(-x.alpha * CASE x.lsu WHEN 'A' THEN q.d1 ELSE q.d2 END)) / (x.alpha * CASE x.lsu WHEN 'A' THEN q.d1 ELSE q.d2 END) * v * (1 - exp(-(x.alpha + y.alpha) * q.t)) / (x.alpha + y.alpha)
* y.sigma * exp(-y.alpha * (CASE y.lsu WHEN 'A' THEN q.t1 ELSE q.t2 END - q.t)) * (1 - exp(-y.alpha * CASE y.lsu WHEN 'A' THEN q.d1 ELSE q.d2 END)) / (y.alpha * CASE y.lsu WHEN 'A' THEN q.d1 ELSE q.d2 END)) AS cov FROM q, f x JOIN rho ON rho.i = x.idx JOIN f y ON rho.j = y.idx GROUP BY ALL)
SELECT id, round(sqrt((sum(CASE WHEN u = w THEN cov ELSE -cov END)) / any_value(t)), 7) AS ratio_vol FROM c GROUP BY 1""")
def ratio_vols(spark, sf_dir):
    """Volatility of the ratio of two forwards."""
    size = F.col("p_size")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("A").alias("lsu1"), F.lit("B").alias("lsu2"), (0.05 + size / 50.0).alias("t"), (0.1 + size / 50.0).alias("t1"), F.lit(0.08).alias("d1"), (0.3 + size / 40.0).alias("t2"), F.lit(0.25).alias("d2"))
    return fc.ratio_vols(q, model(spark)).select("id", *rounded(7, ratio_vol=F.col("ratio_vol")))


@query("corr_matrix", f"""WITH {_MODEL}, p AS (SELECT n_nationkey AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS lsu, 0.1 + n_nationkey / 20.0 AS T1, 0.25 AS D, 0.1 AS t FROM nation),
m AS (SELECT p.p, f.idx, f.alpha, t, {_M.format(f='f')} AS load FROM p JOIN f USING (lsu)), c AS (SELECT a.p, b.p AS q, sum(a.load * b.load * v * (1 - exp(-(a.alpha + b.alpha) * a.t)) / (a.alpha + b.alpha)) AS cov FROM m a, m b JOIN rho ON rho.i = a.idx AND rho.j = b.idx GROUP BY 1, 2)
SELECT c.p, c.q, round(c.cov / sqrt(x.cov * y.cov), 8) AS corr FROM c JOIN c x ON x.p = c.p AND x.q = c.p JOIN c y ON y.p = c.q AND y.q = c.q""")
def corr_matrix(spark, sf_dir):
    """Correlations of 25 delivery periods with each other."""
    k = F.col("n_nationkey")
    periods = table(spark, sf_dir, "nation").select(k.alias("p"), F.when(k % 2 == 0, "A").otherwise("B").alias("lsu"), F.lit(0.1).alias("t"), (0.1 + k / 20.0).alias("tau"), F.lit(0.25).alias("span"))
    return fc.corr_matrix(periods, model(spark)).select("p", "q", *rounded(8, corr=F.col("corr")))


_GRID = [(a, b) for a in (0.1, 0.3, 0.6, 1.0) for b in (2.0, 6.0, 12.0)]
_RATIOS, _RHOS = (0.0, 0.5, 1.0, 2.0), (-0.3, 0.0, 0.3)
_COMBOS = [(a, b, m, p) for a, b in _GRID for m in _RATIOS for p in (_RHOS if m else (0.0,))]


@query("factor_fit", f"""WITH d AS (SELECT event_type, CAST(user_id % 24 AS INTEGER) AS k, stddev_samp(value) / (20.0 + user_id % 24) AS y FROM events GROUP BY 1, 2, user_id % 24), v AS (SELECT event_type, (k + 1) / 12.0 AS T1, 1 / 12.0 AS D, y, CASE WHEN k >= 12 THEN 2.0 ELSE 1.0 END AS w FROM d WHERE y IS NOT NULL),
g(slow, fast, ratio, rho) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(m AS DOUBLE), CAST(p AS DOUBLE) FROM (VALUES {', '.join(map(str, _COMBOS))}) AS t(a, b, m, p)),
x AS (SELECT *, exp(-slow * T1) * (1 - exp(-slow * D)) / (slow * D) AS a, exp(-fast * T1) * (1 - exp(-fast * D)) / (fast * D) AS b FROM v, g), h AS (SELECT *, sqrt(a * a + 2 * rho * ratio * a * b + ratio * ratio * b * b) AS s FROM x),
t AS (SELECT event_type, slow, fast, ratio, rho, sum(w * s * s) AS xx, sum(w * s * y) AS xy, sum(w * y * y) AS yy FROM h GROUP BY ALL), e AS (SELECT *, xy / xx AS sigma, greatest(0, yy - xy / xx * xy) AS sse FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(sse, 9), slow, fast, ratio, rho) AS k FROM e) SELECT event_type, slow, fast, ratio, rho, round(sigma, 6) AS sigma, round(sse, 6) AS sse FROM k WHERE k = 1""")
def factor_fit(spark, sf_dir):
    """Two-factor models fitted to volatilities by contract, those beyond a year with double weight."""
    k = (F.col("user_id") % 24).cast("int")
    d = table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.stddev_samp("value").alias("y")).where("y is not null")
    v = d.select("event_type", "k", (F.col("y") / (20.0 + F.col("k"))).alias("y"), ((F.col("k") + 1) / 12.0).alias("tau"), F.lit(1 / 12.0).alias("span"))
    fit = fc.fit_factors(v, ["event_type"], "tau", "span", "y", F.when(F.col("k") >= 12, 2.0).otherwise(1.0), _GRID, _RATIOS, _RHOS)
    return fit.select("event_type", "slow", "fast", "ratio", "rho", *[F.round(c, 6).alias(c) for c in ("sigma", "sse")])


_FILLED = f"{_SLOWEST}, m AS (SELECT a.idx AS i, b.idx AS j, 0.1 + a.r / 10.0 AS corr FROM o a JOIN o b ON b.r = (a.r + 1) % 5 AND a.k = 1 AND b.k = 2 UNION ALL SELECT a.idx, b.idx, -0.1 - a.r / 10.0 FROM o a JOIN o b ON b.r = a.r AND a.k = 1 AND b.k = 2)"


@query("filled_rho", f"WITH {_FILLED} SELECT i, j, round(corr, 9) AS rho FROM m UNION ALL SELECT j, i, round(corr, 9) FROM m UNION ALL SELECT idx, idx, 1.0 FROM o")
def filled_rho(spark, sf_dir):
    """Correlations of factors from those measured between the contracts that stand for them: of each region's first with the next one's second, and with its own second."""
    m = nations_model(spark, sf_dir)
    r = F.col("r_regionkey")
    name = lambda x, k: F.concat(F.lit("U"), x.cast("string"), F.lit(f":{k}"))
    rows = table(spark, sf_dir, "region")
    across = rows.select(name(r, 1).alias("a"), name((r + 1) % 5, 2).alias("b"), (0.1 + r / 10.0).alias("corr"))
    measured = across.unionByName(rows.select(name(r, 1).alias("a"), name(r, 2).alias("b"), (-0.1 - r / 10.0).alias("corr")))
    return fc.filled_rho(measured, fc.ordered(m.factors.join(m.bridge, "idx"))).select("i", "j", F.round("rho", 9).alias("rho"))


def own_models(model):
    """A row for each underlying of a model: lsu, idxs, and sigmas (1), alphas and rho of its factors in the order of idxs."""
    own = model.bridge.select("idx", "lsu").join(model.factors, "idx")
    a, b = own.select("lsu", F.col("idx").alias("i"), "alpha"), own.select("lsu", F.col("idx").alias("j"))
    cells = a.join(b, "lsu").join(model.rho, ["i", "j"])
    rows = cells.groupBy("lsu", "i", "alpha").agg(F.array_sort(F.collect_list(F.struct("j", "rho"))).alias("row"))
    lists = rows.groupBy("lsu").agg(F.array_sort(F.collect_list(F.struct("i", "alpha", F.col("row.rho").alias("rho")))).alias("x"))
    return lists.select("lsu", F.col("x.i").alias("idxs"), F.transform("x", lambda _: F.lit(1.0)).alias("sigmas"), F.col("x.alpha").alias("alphas"), F.col("x.rho").alias("rho"))


@query("martingale_prices")
def martingale_prices(spark, sf_dir):
    """Means of simulated forward prices of each underlying of the stored model, 1 up to their errors, at two times; no SQL repeats the draws, a test holds them against the model's variance."""
    m = nations_model(spark, sf_dir)
    models = own_models(m)
    times = [0.1, 0.5]
    states = mc.simulate_factors(models, "lsu", times, 20_001).join(models.select("lsu", "idxs"), "lsu")
    states = states.select("lsu", "path", "step", F.get("idxs", F.col("factor")).alias("factor"), "state")
    at = F.posexplode(F.array(*[F.lit(t) for t in times])).alias("step", "t")
    asked = models.select("lsu", at).select(F.concat("lsu", F.lit("-"), F.col("step").cast("string")).alias("id"), "lsu", "step", "t", F.lit(0.6).alias("tau"), F.lit(0.1).alias("span"))
    prices = fc.simulated_prices(states, asked, m)
    return prices.groupBy("id").agg(F.count("*").alias("paths"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.var_samp(F.ln("price")), 6).alias("variance"))
