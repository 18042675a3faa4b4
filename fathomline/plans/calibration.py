"""Queries that calibrate factor models to volatilities which planted models give, so that SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import calibration as cb
from fathomline.operators.covariance import integral, loading
from fathomline.plans.registry import query
from fathomline.sources.files import table

#: Contracts that are measured: months, quarters and years ahead, as start and length in months; and ratios of such.
_CONTRACTS = [(m, 1) for m in (1, 2, 3, 4, 6, 8, 10, 12, 15, 18, 24)] + [(m, 3) for m in (3, 6, 9, 12)] + [(m, 12) for m in (12, 24, 36, 48)]
_RATIOS = [((1, 1), (2, 1)), ((1, 1), (6, 1)), ((3, 3), (12, 3)), ((12, 12), (24, 12))]


def planted(key):
    """Volatilities, speeds and correlations of a key's planted model, as columns."""
    k = key.cast("long")
    sigmas = [0.1 + (k % 7) / 50, 0.15 + (k % 5) / 20, 0.4 + (k % 4) / 10]
    speeds = [0.02 + (k % 4) / 50, 1 + (k % 6) / 2, 20 + (k % 5) * 5.0]
    return sigmas, speeds, [(k % 5 - 2) / 10, (k % 3 - 1) / 10, F.lit(0.1)]


_PLANTED = "0.1 + (k % 7) / 50.0 AS s1, 0.15 + (k % 5) / 20.0 AS s2, 0.4 + (k % 4) / 10.0 AS s3, 0.02 + (k % 4) / 50.0 AS a1, 1 + (k % 6) / 2.0 AS a2, 20 + (k % 5) * 5.0 AS a3"


def quoted(models):
    """The volatilities that models (lsu, n, s1.., a1.., r12..) give to all contracts and ratios, now and over ten days; far ones count double."""
    month = 1 / 12
    rows = [(t, a * month, b * month, None, None, 2.0 if a >= 12 else 1.0) for t in (0.0, 10 / 365) for a, b in _CONTRACTS]
    rows += [(t, a * month, b * month, c * month, d * month, 1.0) for t in (0.0, 10 / 365) for (a, b), (c, d) in _RATIOS]
    fields = ("t", "t1", "d1", "t2", "d2", "weight")
    asked = F.array(*[F.struct(*[F.lit(x).cast("double").alias(c) for c, x in zip(fields, row)]) for row in rows])
    out = models.select("*", F.explode(asked).alias("q")).select(*models.columns, "q.*")
    t, on = F.col("t"), lambda i: (F.col("n") >= i).cast("double")
    load = lambda i, start, length: loading(F.col(f"s{i}"), F.col(f"a{i}"), t, F.col(start), F.col(length))
    w = [on(i) * (load(i, "t1", "d1") - F.when(F.col("t2").isNotNull(), load(i, "t2", "d2")).otherwise(0.0)) for i in (1, 2, 3)]
    share = lambda i, j: F.when(t == 0, 1.0).otherwise(integral(F.lit(1.0), F.col(f"a{i}") + F.col(f"a{j}"), t) / t)
    var = sum(w[i - 1] * w[i - 1] * share(i, i) for i in (1, 2, 3)) + sum(2 * w[i - 1] * w[j - 1] * share(i, j) * F.col(f"r{i}{j}") for i, j in ((1, 2), (1, 3), (2, 3)))
    return out.withColumn("vol", F.sqrt(var))


def _models(rows, key, n):
    sigmas, speeds, rhos = planted(key)
    named = {f"s{i}": x for i, x in enumerate(sigmas, 1)} | {f"a{i}": x for i, x in enumerate(speeds, 1)} | dict(zip(("r12", "r13", "r23"), rhos))
    return rows.withColumns({"n": n.cast("int")} | named)


@query("calibrated_factors", f"""WITH p AS (SELECT s_suppkey AS k, 1 + s_suppkey % 3 AS n, {_PLANTED.replace('k %', 's_suppkey %')} FROM supplier),
e AS (SELECT k, 1 AS factor, s1 AS sigma, a1 AS alpha FROM p UNION ALL SELECT k, 2, s2, a2 FROM p WHERE n >= 2 UNION ALL SELECT k, 3, s3, a3 FROM p WHERE n = 3)
SELECT k AS id, factor, round(sigma, 3) AS sigma, round(alpha, 2) AS alpha, true AS exact FROM e""")
def calibrated_factors(spark, sf_dir):
    """Models of one to three factors of all suppliers, found again from the volatilities of their contracts."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # dealt before each becomes dozens of quotes: a file of a few MB is one task otherwise
    models = _models(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lsu")).repartition(parts, "lsu"), F.col("lsu"), 1 + F.col("lsu") % 3)
    quotes = quoted(models).select("lsu", "t", "t1", "d1", "t2", "d2", "vol", "weight")
    none = F.lit(None)
    asked = models.select("lsu", "n", F.col("r12").alias("rho12"), F.col("r13").alias("rho13"), F.col("r23").alias("rho23"), none.cast("array<double>").alias("sigmas"), none.cast("array<double>").alias("alphas"), none.cast("double").alias("rest"))
    found = cb.fit_models(asked, quotes, long_alpha=True, joint=True)
    each = found.select("lsu", "loss", F.posexplode(F.arrays_zip("sigmas", "alphas")).alias("k", "x"))
    return each.select(F.col("lsu").alias("id"), (F.col("k") + 1).alias("factor"), F.round("x.sigmas", 3).alias("sigma"), F.round("x.alphas", 2).alias("alpha"), (F.col("loss") < 1e-9).alias("exact"))


def standing(spark, sf_dir):
    """Underlyings of nations, the currency of each being that of its region: nation k takes its first factor over from nation k - 5, and its own second one is fitted; a currency pair for every two regions, of one factor. Nation 24 and 4 stand on each other.

    Returns underlyings, quotes, proxies, pairs and measured correlations.
    """
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("int").alias("r"))
    name, currency = F.concat(F.lit("N"), F.col("k").cast("string")), lambda r: F.concat(F.lit("C"), r.cast("string"))
    nations = _models(n.select(name.alias("lsu"), currency(F.col("r")).alias("currency"), "k", F.lit(2).alias("m")), F.col("k"), F.col("m"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("a"))
    others = r.select(F.explode(F.sequence(F.col("a") + 1, F.lit(5))).alias("b"), "a").where("b < 5")
    fx = others.select(F.concat(F.lit("X"), "a", "b").alias("lsu"), currency(F.col("a")).alias("currency"), currency(F.col("b")).alias("foreign"), (F.col("a") * 5 + F.col("b")).alias("k"))
    rates = _models(fx.withColumn("m", F.lit(1)), F.col("k"), F.col("m"))
    models = nations.select("lsu", "currency", "k", "n", *(f"{c}{i}" for c in "sa" for i in (1, 2, 3)), "r12", "r13", "r23").unionByName(rates.select("lsu", "currency", "k", "n", *(f"{c}{i}" for c in "sa" for i in (1, 2, 3)), "r12", "r13", "r23"))
    none = F.lit(None)
    underlyings = models.select("lsu", "currency", "n", none.cast("array<double>").alias("sigmas"), none.cast("array<double>").alias("alphas"), none.cast("double").alias("rest"))
    before = F.when(F.col("k") == 4, "N24").when(F.col("k") >= 5, F.concat(F.lit("N"), (F.col("k") - 5).cast("string")))
    proxies = n.select(name.alias("lsu"), F.lit(1).alias("factor"), before.alias("proxy")).where("proxy is not null")
    within = models.select(F.concat("lsu", F.lit(":1")).alias("a"), F.concat("lsu", F.lit(":2")).alias("b"), F.col("r12").alias("corr")).where("substr(a, 1, 1) = 'N'")
    cross = fx.select(F.concat("lsu", F.lit(":1")).alias("a"), "k").join(n.select(F.concat(name, F.lit(":1")).alias("b"), F.col("k").alias("j")), (F.col("k") + F.col("j")) % 3 != 0)  # a measured table: 10 pairs by 25 nations
    return models, underlyings, proxies, fx.select("lsu", "currency", "foreign"), within.unionByName(cross.select("a", "b", (((F.col("k") + F.col("j")) % 7 - 3) / 10).alias("corr")))


_STANDING = f"""WITH RECURSIVE m AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_regionkey AS r, {_PLANTED.replace('k %', 'n_nationkey %')} FROM nation),
f AS (SELECT x.r_regionkey AS a, y.r_regionkey AS b, x.r_regionkey * 5 + y.r_regionkey AS k, 0.1 + ((x.r_regionkey * 5 + y.r_regionkey) % 7) / 50.0 AS s, 0.02 + ((x.r_regionkey * 5 + y.r_regionkey) % 4) / 50.0 AS alpha FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey),
t AS (SELECT k, r, CAST(s1 AS DOUBLE) AS sigma, CAST(a1 AS DOUBLE) AS alpha, k AS place FROM m WHERE k < 4
UNION ALL SELECT m.k, m.r, CASE WHEN m.r = t.r THEN t.sigma ELSE sqrt(t.sigma * t.sigma + f.s * f.s + 2 * (CASE WHEN m.r < t.r THEN 1 ELSE -1 END) * t.sigma * f.s * (CASE WHEN (f.k + t.k) % 3 = 0 THEN 0 ELSE ((f.k + t.k) % 7 - 3) / 10.0 END)) END, t.alpha, CASE WHEN m.r = t.r THEN t.place ELSE m.k END
FROM t JOIN m ON m.k = t.k + 5 LEFT JOIN f ON f.a = least(m.r, t.r) AND f.b = greatest(m.r, t.r))"""


@query("calibrated_levels", f"""{_STANDING} SELECT 'N' || k AS lsu, 1 AS factor, round(sigma, 6) AS sigma, round(alpha, 6) AS alpha, 'N' || place || ':1' AS place FROM t
UNION ALL SELECT 'X' || a || b, 1, round(s, 6), round(alpha, 6), 'X' || a || b || ':1' FROM f""")
def calibrated_levels(spark, sf_dir):
    """First factors of underlyings that stand on others: fitted, shared, or lent through a currency pair."""
    models, underlyings, proxies, pairs, measured = standing(spark, sf_dir)
    quotes = quoted(models).select("lsu", "t", "t1", "d1", "t2", "d2", "vol", "weight")
    found = cb.calibrate(underlyings, quotes, proxies, pairs, measured, long_alpha=True)
    return found.fits.where("factor = 1").select("lsu", "factor", F.round("sigma", 6).alias("sigma"), F.round("alpha", 6).alias("alpha"), "place")


@query("calibration_problems", "SELECT 'N' || n_nationkey AS lsu, 'cycle' AS problem FROM nation WHERE n_nationkey % 5 = 4")
def calibration_problems(spark, sf_dir):
    """Underlyings that can't be calibrated, as they stand on each other."""
    models, underlyings, proxies, pairs, _ = standing(spark, sf_dir)
    levels, left = cb.dependency_levels(underlyings, cb.dependencies(underlyings, proxies, pairs))
    return left.select("lsu", F.lit("cycle").alias("problem"))
