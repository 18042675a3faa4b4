"""Queries on option prices, implied volatilities and factor covariances."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import normal, options as op
from fathomline.operators import covariance as cv
from fathomline.plans.mapping import TRADES, trades
from fathomline.plans.registry import query
from fathomline.sources.files import table


def _poly(x: str, c: tuple[float, ...]) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


def cdf(x: str) -> str:
    """SQL of the normal probability of a column x."""
    a = f"abs({x})"
    tail = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    e = f"exp(-{a} * {a} / 2)"
    upper = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {e} * {_poly(a, normal.CDF_NUM)} / {_poly(a, normal.CDF_DEN)} ELSE {e} / {tail} / 2.506628274631 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def ppf(p: str) -> str:
    """SQL of the normal quantile of a column p between 0 and 1."""
    q, r, t = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({t} - 1.6)", f"({t} - 5.0)"
    outer = f"CASE WHEN {t} <= 5 THEN {_poly(near, normal.PPF_NEAR_NUM)} / {_poly(near, normal.PPF_NEAR_DEN)} ELSE {_poly(far, normal.PPF_FAR_NUM)} / {_poly(far, normal.PPF_FAR_DEN)} END"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(r, normal.PPF_MID_NUM)} / {_poly(r, normal.PPF_MID_DEN)} WHEN {q} < 0 THEN -({outer}) ELSE {outer} END)"


def pdf(x: str) -> str:
    return f"(exp(-{x} * {x} / 2) / 2.5066282746310002)"


def rounded(n: int, **columns):
    """Rounded columns without negative zeros."""
    return [F.when(F.round(c, n) == 0, 0.0).otherwise(F.round(c, n)).alias(k) for k, c in columns.items()]


def plain(sql: str, columns: str) -> str:
    """sql without negative zeros."""
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = 0 THEN 0.0 ELSE {c} END AS {c}' for c in columns.split())}) FROM ({sql})"


_D = f"{TRADES}, d AS (SELECT *, CASE WHEN cp = 'c' THEN 1 ELSE -1 END AS w, exp(-r * t) AS df, ln(s / k) / (vol * sqrt(t)) + vol * sqrt(t) / 2 AS d1, ln(s / k) / (vol * sqrt(t)) - vol * sqrt(t) / 2 AS d2 FROM trades), e AS (SELECT *, w * d1 AS a1, w * d2 AS a2 FROM d)"
def _args():
    return [F.col(c) for c in ("s", "k", "vol", "t", "r")]




@query("black76", plain(f"""WITH {_D} SELECT id, round(df * w * (s * {cdf('a1')} - k * {cdf('a2')}), 7) AS value, round(w * {cdf('a1')} * df, 7) AS delta, round(df * {pdf('d1')} / (s * vol * sqrt(t)), 9) AS gamma,
round(s * df * {pdf('d1')} * sqrt(t), 6) AS vega, round((-s * df * {pdf('d1')} * vol / (2 * sqrt(t)) + w * r * s * df * {cdf('a1')} - w * r * k * df * {cdf('a2')}) / 365, 7) AS theta FROM e""", "value delta gamma vega theta"))
def black76(spark, sf_dir):
    rows = op.with_black(trades(spark, sf_dir), *_args(), F.col("cp"))
    c = F.col
    return rows.select("id", *rounded(7, value=c("value"), delta=c("delta")), *rounded(9, gamma=c("gamma")), *rounded(6, vega=c("vega")), *rounded(7, theta=c("theta")))


@query("black76_expired", f"WITH {TRADES} SELECT id, round(greatest(CASE WHEN cp = 'c' THEN s - k ELSE k - s END, 0), 7) AS value FROM trades")
def black76_expired(spark, sf_dir):
    zero = F.lit(0.0)
    return trades(spark, sf_dir).select("id", *rounded(7, value=op.black_value(F.col("s"), F.col("k"), F.col("vol"), zero, zero, F.col("cp"))))


@query("delta_strikes", f"""WITH {_D}, x AS (SELECT *, w * df * {cdf('a1')} AS delta, w * ln(s / k) / (vol * sqrt(t)) AS b FROM e) SELECT id, round(k, 5) AS strike, round(w * {cdf('b')} * df, 7) AS star FROM x""".replace("round(k, 5) AS strike", "CASE WHEN abs(d1) < 3 THEN round(k, 4) END AS strike"))
def delta_strikes(spark, sf_dir):
    """The strike that each option's own delta leads back to where the delta tells it (|d1| < 3; null elsewhere), and its symmetric delta."""
    rows = _delta_strikes(trades(spark, sf_dir)).join(trades(spark, sf_dir), "id")
    return rows.select("id", F.when(F.abs(op.black_d1(*_args()[:4])) < 3, F.round("strike", 4)).alias("strike"), "star")


@query("delta_strikes_all")
def delta_strikes_all(spark, sf_dir):
    """All trades; the strike is null where the delta is too near to a bound to tell it."""
    return _delta_strikes(trades(spark, sf_dir))


def _delta_strikes(found):
    s, k, vol, t, r = _args()
    cp = F.col("cp")
    rows = op.with_black(found, s, k, vol, t, r, cp)
    return rows.select("id", *rounded(5, strike=op.strike_from_delta(F.col("delta"), s, vol, t, r, cp)), *rounded(7, star=op.delta_star(s, k, vol, t, r, cp)))


@query("approximate_vols", f"""WITH {_D}, p AS (SELECT *, w * (s * {cdf('a1')} - k * {cdf('a2')}) + CASE WHEN w < 0 THEN s - k ELSE 0 END AS c FROM e)
SELECT id, round(CASE WHEN c - greatest(s - k, 0) > 1e-8 THEN sqrt(2 * pi() / t) / (s + k) * (c - (s - k) / 2 + sqrt(greatest((c - (s - k) / 2) ** 2 - (s - k) ** 2 / pi(), 0))) END, 6) AS corrado,
round(sqrt(2 * pi() / t) * (c - (s - k) / 2) / (s - (s - k) / 2), 6) AS bharadia FROM p""")
def approximate_vols(spark, sf_dir):
    """All trades; corrado is null without time value."""
    return _approximate_vols(trades(spark, sf_dir))


@query("approximate_vols_all")
def approximate_vols_all(spark, sf_dir):
    """All trades; corrado is null without time value."""
    return _approximate_vols(trades(spark, sf_dir))


def _approximate_vols(found):
    s, k, vol, t, r = _args()
    a = (F.col("value"), s, k, t, r, F.col("cp"))
    rows = op.with_black(found, s, k, vol, t, r, F.col("cp"))
    return rows.select("id", *rounded(6, corrado=op.vol_corrado_miller(*a), bharadia=op.vol_bharadia(*a)))


_TOLD = f"{_D}, p AS (SELECT *, w * (s * {cdf('a1')} - k * {cdf('a2')}) + CASE WHEN w < 0 THEN s - k ELSE 0 END AS c, s * {pdf('d1')} * sqrt(t) AS vega FROM e)"


@query("implied_vols", f"WITH {_TOLD} SELECT id, CASE WHEN c - greatest(s - k, 0) > 1e-6 THEN round(c, 4) END AS premium, CASE WHEN c - greatest(s - k, 0) > 1e-6 AND vega > 0.01 * s THEN round(vol, 4) END AS vol FROM p")
def implied_vols(spark, sf_dir):
    """Volatilities solved from the premiums of all trades: the call premium they give again (null without time value), and the volatility where a premium tells it (a vega above a hundredth of the forward)."""
    s, k, vol, t, r = _args()
    cp = F.col("cp")
    rows = op.with_black(trades(spark, sf_dir), s, k, vol, t, r, cp)
    rows = rows.withColumns({"solved": op.vol_from_premium(F.col("value"), s, k, t, r, cp), "call": op.call_from_put(F.col("value"), s, k, t, r, cp) * F.exp(r * t)})
    rows = rows.select("id", "s", "k", "t", "solved", (F.col("call") - F.greatest(s - k, F.lit(0.0)) > 1e-6).alias("open"), (F.col("vega") * F.exp(r * t) > 0.01 * s).alias("told"))
    again = op.with_black(rows, s, k, F.col("solved"), t, F.lit(0.0), F.lit("c"))
    return again.select("id", F.when(F.col("open"), F.round("value", 4)).alias("premium"), F.when(F.col("open") & F.col("told"), F.round("solved", 4)).alias("vol"))


@query("implied_vols_all")
def implied_vols_all(spark, sf_dir):
    """All trades; null without time value."""
    return _implied_vols(trades(spark, sf_dir))


def _implied_vols(found):
    s, k, vol, t, r = _args()
    rows = op.with_black(found, s, k, vol, t, r, F.col("cp"))
    return rows.select("id", *rounded(5, vol=op.vol_from_premium(F.col("value"), s, k, t, r, F.col("cp"))))


_N = f"{TRADES}, d AS (SELECT *, CASE WHEN cp = 'c' THEN 1 ELSE -1 END AS w, exp(-r * t) AS df, vol * s AS nv, (s - k) / (vol * s * sqrt(t)) AS d FROM trades), e AS (SELECT *, w * d AS a FROM d)"


@query("bachelier", plain(f"""WITH {_N} SELECT id, round(df * (w * (s - k) * {cdf('a')} + nv * sqrt(t) * {pdf('d')}), 6) AS value, round(df * w * {cdf('a')}, 7) AS delta, round(df * {pdf('d')} / (nv * sqrt(t)), 9) AS gamma,
round(df * sqrt(t) * {pdf('d')}, 7) AS vega, round(r * df * (w * (s - k) * {cdf('a')} + nv * sqrt(t) * {pdf('d')}) - df * nv * {pdf('d')} / (2 * sqrt(t)), 6) AS theta FROM e""", "value delta gamma vega theta"))
def bachelier(spark, sf_dir):
    s, k, vol, t, r = _args()
    a, cp = (s, k, vol * s, t, r), F.col("cp")
    return trades(spark, sf_dir).select("id", *rounded(6, value=op.bachelier_value(*a, cp)), *rounded(7, delta=op.bachelier_delta(*a, cp)), *rounded(9, gamma=op.bachelier_gamma(*a)), *rounded(7, vega=op.bachelier_vega(*a)), *rounded(6, theta=op.bachelier_theta(*a, cp)))


@query("bachelier_vols", f"WITH {_N} SELECT id, CASE WHEN {pdf('d')} > 0.001 THEN round(nv, 4) END AS vol FROM e")
def bachelier_vols(spark, sf_dir):
    """Normal volatilities solved from the premiums of all trades, where a premium tells it (a density above a thousandth); null elsewhere."""
    s, k, vol, t, _ = _args()
    rows = _bachelier_vols(trades(spark, sf_dir)).withColumnRenamed("vol", "solved").join(trades(spark, sf_dir), "id")
    return rows.select("id", F.when(normal.norm_pdf(op.bachelier_d(s, k, vol * s, t)) > 0.001, F.round("solved", 4)).alias("vol"))


@query("bachelier_vols_all")
def bachelier_vols_all(spark, sf_dir):
    """All trades; null without time value."""
    return _bachelier_vols(trades(spark, sf_dir))


def _bachelier_vols(found):
    s, k, vol, t, r = _args()
    cp = F.col("cp")
    rows = found.withColumn("premium", op.bachelier_value(s, k, vol * s, t, r, cp))
    return rows.select("id", *rounded(6, vol=op.bachelier_vol(F.col("premium"), s, k, t, r, cp)))


_K = f"""{TRADES}, b AS (SELECT *, CASE WHEN cp = 'c' THEN 1 ELSE -1 END AS w, exp(-r * t) AS df, 0.9 * s AS f2, 5.0 AS x, 0.25 AS v2, 0.6 AS rho FROM trades),
c AS (SELECT *, f2 + x AS kk, v2 * f2 / (f2 + x) AS vb FROM b), d AS (SELECT *, sqrt(vol * vol + vb * vb - 2 * rho * vol * vb) AS v FROM c),
e AS (SELECT *, ln(s / kk) / (v * sqrt(t)) + v * sqrt(t) / 2 AS d1, ln(s / kk) / (v * sqrt(t)) - v * sqrt(t) / 2 AS d2 FROM d), g AS (SELECT *, w * d1 AS a1, w * d2 AS a2, s * df * {pdf('d1')} * sqrt(t) AS vega FROM e)"""


@query("kirk", plain(f"""WITH {_K} SELECT id, round(df * w * (s * {cdf('a1')} - kk * {cdf('a2')}), 6) AS value, round(w * {cdf('a1')} * df, 7) AS delta1, round(-w * {cdf('a2')} * df, 7) AS delta2, round(df * {pdf('d1')} / (s * v * sqrt(t)), 9) AS gamma1,
round(df * {pdf('d2')} / (kk * v * sqrt(t)), 9) AS gamma2, round(vega * (vol - rho * vb) / v, 5) AS vega1, round(vega * (vb - rho * vol) / v * f2 / kk, 5) AS vega2, round(-vega * vol * vb / v, 2) AS rho_sensitivity, round((-s * df * {pdf('d1')} * v / (2 * sqrt(t)) + w * r * s * df * {cdf('a1')} - w * r * kk * df * {cdf('a2')}) / 365, 7) AS theta FROM g""", "value delta1 delta2 gamma1 gamma2 vega1 vega2 rho_sensitivity theta"))
def kirk(spark, sf_dir):
    args = (F.col("s"), 0.9 * F.col("s"), F.lit(5.0), F.col("vol"), F.lit(0.25), F.lit(0.6), F.col("t"), F.col("r"), F.col("cp"))
    rows = op.with_kirk(trades(spark, sf_dir).select("id", "s", "vol", "t", "r", "cp"), *args)
    n = {"value": 6, "delta1": 7, "delta2": 7, "gamma1": 9, "gamma2": 9, "vega1": 5, "vega2": 5, "rho_sensitivity": 2, "theta": 7}
    return rows.select("id", *[x for c, k in n.items() for x in rounded(k, **{c: F.col(c)})])


@query("exchange_option", f"""WITH {TRADES}, d AS (SELECT *, sqrt(vol * vol + 0.09 - 2 * 0.5 * vol * 0.3) AS v FROM trades), e AS (SELECT *, ln(s / k) / (v * sqrt(t)) + v * sqrt(t) / 2 AS d1, ln(s / k) / (v * sqrt(t)) - v * sqrt(t) / 2 AS d2 FROM d)
SELECT id, round(s * {cdf('d1')} - k * {cdf('d2')}, 6) AS value FROM e""")
def exchange_option(spark, sf_dir):
    rows = op.with_margrabe(trades(spark, sf_dir), "value", F.col("s"), F.col("k"), F.col("vol"), F.lit(0.3), F.lit(0.5), F.col("t"))
    return rows.select("id", *rounded(6, value=F.col("value")))


def _sds(*pairs: str) -> str:
    return ", ".join(f"sqrt(greatest(0, v{i} * v{i} + v{j} * v{j} - 2 * r{i}{j} * v{i} * v{j}) * t) AS s{i}{j}" for i, j in pairs)


def _ex(name: str, a: str, b: str, sd: str) -> str:
    """SQL of the value of an exchange from columns of the CTE before."""
    d1, d2 = f"(ln({a} / {b}) / {sd} + {sd} / 2)", f"(ln({a} / {b}) / {sd} - {sd} / 2)"
    return f"{a} * {cdf(d1)} - {b} * {cdf(d2)} AS {name}"


_CHEAPEST = f"""WITH {TRADES}, x AS (SELECT id, s AS a1, k AS a2, 1.05 * s AS a3, vol AS v1, 0.3 AS v2, 0.25 AS v3, 0.5 AS r12, 0.4 AS r13, 0.3 AS r23, t, r FROM trades),
y AS (SELECT *, {_sds('12', '13', '23')}, a1 * a1 * exp(v1 * v1 * t) AS q1, a2 * a2 * exp(v2 * v2 * t) AS q2, a1 * a3 * exp(r13 * v1 * v3 * t) AS p1, a2 * a3 * exp(r23 * v2 * v3 * t) AS p2 FROM x),
z AS (SELECT *, 2 * s12 AS sq FROM y), e AS (SELECT *, {_ex('m12', 'a1', 'a2', 's12')}, {_ex('m13', 'a1', 'a3', 's13')}, {_ex('m23', 'a2', 'a3', 's23')}, {_ex('mq', 'q1', 'q2', 'sq')}, {_ex('mp', 'p1', 'p2', 's12')} FROM z),
g AS (SELECT *, a2 + m12 AS mean FROM e), h AS (SELECT *, sqrt(greatest(0, greatest(0, ln((q2 + mq) / (mean * mean))) + v3 * v3 * t - 2 * ln((p2 + mp) / (mean * a3)))) AS s3 FROM g), f AS (SELECT *, {_ex('m3', 'mean', 'a3', 's3')} FROM h)
SELECT id, round(exp(-r * t) * (a1 - m12 - a3 - m13 - m23 + a3 + m3), 5) AS value FROM f"""


@query("cheapest_of_three", _CHEAPEST)
def cheapest_of_three(spark, sf_dir):
    s = F.col("s")
    rows = op.with_cheapest(trades(spark, sf_dir), [s, F.col("k"), 1.05 * s], [F.col("vol"), F.lit(0.3), F.lit(0.25)], F.lit(0.5), F.lit(0.4), F.lit(0.3), F.col("t"), F.col("r"))
    return rows.select("id", *rounded(5, value=F.col("value")))


_DATED = TRADES.replace("p_size / 25.0 AS t", "(p_size * 11) / 365.0 AS t")


def _dated_trades(spark, sf_dir):
    """Trades priced on a day, expiring 11 days later for each unit of size."""
    day = F.lit("2026-01-15").cast("date")
    return trades(spark, sf_dir).withColumn("pricing", day).withColumn("expiry", F.date_add("pricing", F.round(F.col("t") * 25).cast("int") * 11)).drop("t")


_DD = _D.replace(TRADES, _DATED)


@query("black76_dated", plain(f"""WITH {_DD} SELECT id, round(df * w * (s * {cdf('a1')} - k * {cdf('a2')}), 7) AS value, round(w * {cdf('a1')} * df, 7) AS delta, round(df * {pdf('d1')} / (s * vol * sqrt(t)), 9) AS gamma, round(s * df * {pdf('d1')} * sqrt(t), 6) AS vega,
round((-s * df * {pdf('d1')} * vol / (2 * sqrt(t)) + w * r * s * df * {cdf('a1')} - w * r * k * df * {cdf('a2')}) / 365, 7) AS theta FROM e""", "value delta gamma vega theta"))
def black76_dated(spark, sf_dir):
    """Prices and greeks between two dates."""
    rows = op.with_black_dated(_dated_trades(spark, sf_dir), F.col("pricing"), F.col("expiry"), F.col("s"), F.col("k"), F.col("vol"), F.col("r"), F.col("cp"))
    c = F.col
    return rows.select("id", *rounded(7, value=c("value"), delta=c("delta")), *rounded(9, gamma=c("gamma")), *rounded(6, vega=c("vega")), *rounded(7, theta=c("theta")))


_KD = _K.replace(TRADES, _DATED)


@query("kirk_dated", plain(f"""WITH {_KD} SELECT id, round(df * w * (s * {cdf('a1')} - kk * {cdf('a2')}), 6) AS value, round(w * {cdf('a1')} * df, 7) AS delta1, round(-w * {cdf('a2')} * df, 7) AS delta2, round(vega * (vol - rho * vb) / v, 5) AS vega1, round(vega * (vb - rho * vol) / v * f2 / kk, 5) AS vega2,
round(-vega * vol * vb / v, 2) AS rho_sensitivity, round((-s * df * {pdf('d1')} * v / (2 * sqrt(t)) + w * r * s * df * {cdf('a1')} - w * r * kk * df * {cdf('a2')}) / 365, 7) AS theta, round(df * greatest(w * (s - f2 - x), 0), 6) AS intrinsic FROM g""", "value delta1 delta2 vega1 vega2 rho_sensitivity theta intrinsic"))
def kirk_dated(spark, sf_dir):
    """Spread options between two dates, with their intrinsic values."""
    c = F.col
    legs = (c("s"), 0.9 * c("s"), F.lit(5.0))
    rows = op.with_kirk_dated(_dated_trades(spark, sf_dir), c("pricing"), c("expiry"), *legs, c("vol"), F.lit(0.25), F.lit(0.6), c("r"), c("cp"))
    t = F.datediff("expiry", "pricing") / 365
    n = {"value": 6, "delta1": 7, "delta2": 7, "vega1": 5, "vega2": 5, "rho_sensitivity": 2, "theta": 7}
    return rows.select("id", *[x for name, k in n.items() for x in rounded(k, **{name: c(name)})], *rounded(6, intrinsic=op.spread_intrinsic(*legs, t, c("r"), c("cp"))))


@query("bachelier_paid_later", plain(f"WITH {_N} SELECT id, round(exp(-r * (t + 0.25)) * (w * (s - k) * {cdf('a')} + nv * sqrt(t) * {pdf('d')}), 6) AS value FROM e", "value"))
def bachelier_paid_later(spark, sf_dir):
    """Normal options that are paid a quarter after they expire."""
    s, k, vol, t, r = _args()
    return trades(spark, sf_dir).select("id", *rounded(6, value=op.bachelier_value(s, k, vol * s, t, r, F.col("cp"), paid=t + 0.25)))


@query("copula_spread", f"""WITH {TRADES}, d AS (SELECT *, sqrt(vol * vol + 0.09 - 2 * 0.5 * vol * 0.3) AS v FROM trades), e AS (SELECT *, ln(s / k) / (v * sqrt(t)) + v * sqrt(t) / 2 AS d1, ln(s / k) / (v * sqrt(t)) - v * sqrt(t) / 2 AS d2 FROM d)
SELECT id, round(s * {cdf('d1')} - k * {cdf('d2')}, 2) AS value FROM e""")
def copula_spread(spark, sf_dir):
    """Spreads without strike and smile by the copula integral: the exchange option."""
    value = op.copula_spread(F.col("s"), F.col("k"), F.lit(0.0), F.col("vol"), F.lit(0.0), F.lit(0.3), F.lit(0.0), F.lit(0.5), F.col("t"))
    # a row takes tenths of a millisecond: dealt to a stated number of tasks, as a file of a few MB is one otherwise
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return trades(spark, sf_dir).repartition(parts).select("id", *rounded(2, value=value))


@query("star_strikes", f"WITH {_D} SELECT id, CASE WHEN abs(ln(s / k)) < 3 * vol * sqrt(t) THEN round(k, 4) END AS strike FROM e")
def star_strikes(spark, sf_dir):
    """Strikes that symmetric deltas lead back to; null beyond three deviations, where a delta, as a number, doesn't tell them."""
    s, k, vol, t, r = _args()
    cp = F.col("cp")
    told = F.abs(F.ln(s / k)) < 3 * vol * F.sqrt(t)
    rows = trades(spark, sf_dir).withColumn("star", F.when(told, op.delta_star(s, k, vol, t, r, cp)))
    return rows.select("id", *rounded(4, strike=op.strike_from_delta_star(F.col("star"), s, vol, t, r, cp)))


@query("two_factor_sigmas", f"""WITH p AS (SELECT p_partkey AS id, 0.05 + (p_partkey % 9) / 100.0 AS p, 0.5 AS share, 0.2 + p_size / 50.0 AS a, 5.0 + p_size / 10.0 AS b, 0.5 + (p_partkey % 5) / 2.0 AS m, (p_partkey % 7) / 10.0 - 0.3 AS rho FROM part),
x AS (SELECT *, {ppf('p')} AS q, (1 - exp(-a)) / a AS g, (1 - exp(-b)) / b AS h FROM p), y AS (SELECT *, (q + sqrt(q * q - 2 * ln(share))) / sqrt(g * g / (2 * a) + 2 * rho * m * g * h / (a + b) + m * m * h * h / (2 * b)) AS s FROM x)
SELECT id, round(s, 6) AS slow, round(s * m, 6) AS fast FROM y""")
def two_factor_sigmas(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    found = op.two_factor_sigmas(0.05 + (k % 9) / 100.0, F.lit(0.5), 0.2 + size / 50.0, 5.0 + size / 10.0, 0.5 + (k % 5) / 2.0, (k % 7) / 10.0 - 0.3)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), found.alias("s"))
    return rows.select("id", *rounded(6, slow=F.col("s.slow"), fast=F.col("s.fast")))


@query("normal_functions", f"WITH p AS (SELECT p_partkey AS id, (p_partkey % 401 - 200) / 25.0 AS x, (p_partkey % 999 + 1) / 1000.0 AS p FROM part) SELECT id, round({pdf('x')}, 9) AS pdf, round({cdf('x')}, 9) AS cdf, round({ppf('p')}, 8) AS ppf FROM p")
def normal_functions(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), *rounded(9, pdf=normal.norm_pdf((k % 401 - 200) / 25.0), cdf=normal.norm_cdf((k % 401 - 200) / 25.0)), *rounded(8, ppf=normal.norm_ppf((k % 999 + 1) / 1000.0)))


@query("condition_vols", f"WITH p AS (SELECT p_partkey AS id, 0.05 + (p_partkey % 9) / 100.0 AS p, 0.5 AS share, 0.2 + p_size / 50.0 AS alpha FROM part), x AS (SELECT *, {ppf('p')} AS q FROM p) SELECT id, round(q + sqrt(q * q - 2 * ln(share)), 7) AS total, round((q + sqrt(q * q - 2 * ln(share))) * sqrt(2 * alpha) * alpha / (1 - exp(-alpha)), 7) AS sigma FROM x")
def condition_vols(spark, sf_dir):
    k = F.col("p_partkey")
    p, alpha = 0.05 + (k % 9) / 100.0, 0.2 + F.col("p_size") / 50.0
    return table(spark, sf_dir, "part").select(k.alias("id"), *rounded(7, total=op.prob_vol(p, F.lit(0.5)), sigma=op.one_factor_sigma(p, F.lit(0.5), alpha)))


#: A factor model: index, volatility, mean reversion; underlyings of the factors; correlations.
FACTORS = [(1, 0.1, 0.5), (2, 0.15, 10.0), (3, 0.2, 0.1), (4, 0.2, 20.0)]
UNDERLYINGS = [(1, "A"), (2, "A"), (3, "B"), (4, "B")]
RHO = [(1, 2, 0.8), (1, 3, 0.4), (1, 4, 0.6), (2, 3, 0.5), (2, 4, 0.7), (3, 4, 0.3)]


def model(spark) -> cv.Factors:
    return cv.Factors(spark.createDataFrame(FACTORS, "idx int, sigma double, alpha double"), spark.createDataFrame(UNDERLYINGS, "idx int, lsu string"), cv.full_rho(spark.createDataFrame(RHO, "i int, j int, rho double")))


def _model_sql() -> str:
    rho = [*RHO, *((j, i, v) for i, j, v in RHO), *((i, i, 1.0) for i in range(1, 5))]
    return f"""f(idx, sigma, alpha, lsu) AS (VALUES {', '.join(f"({i}, {s}, {a}, '{u}')" for (i, s, a), (_, u) in zip(FACTORS, UNDERLYINGS))}), rho(i, j, v) AS (VALUES {', '.join(map(str, rho))}),
q AS (SELECT p_partkey AS id, 0.05 + p_size / 50.0 AS t, 0.1 + p_size / 50.0 AS t1, 0.08 AS d1, 0.3 + p_size / 40.0 AS t2, 0.25 AS d2 FROM part)"""


_LOAD = "sigma * exp(-{f}.alpha * ({T} - {t})) * (1 - exp(-{f}.alpha * {D})) / ({f}.alpha * {D})"


def _cov_sql(a: str, b: str, t1: str, d1: str, t2: str, d2: str, inst: bool = False) -> str:
    t = "0" if inst else "q.t"
    m1, m2 = "x." + _LOAD.format(f="x", T=t1, t=t, D=d1), "y." + _LOAD.format(f="y", T=t2, t=t, D=d2)
    c = "rho.v" if inst else "rho.v * (1 - exp(-(x.alpha + y.alpha) * q.t)) / (x.alpha + y.alpha)"
    return f"(SELECT sum({m1} * {c} * {m2}) FROM f x JOIN rho ON rho.i = x.idx JOIN f y ON rho.j = y.idx WHERE x.lsu = '{a}' AND y.lsu = '{b}')"


@query("factor_covariance", f"""WITH {_model_sql()} SELECT id, round({_cov_sql('A', 'B', 'q.t1', 'q.d1', 'q.t2', 'q.d2')}, 9) AS cov, round(sqrt({_cov_sql('A', 'A', 'q.t1', 'q.d1', 'q.t1', 'q.d1')} / t), 7) AS vol,
round({_cov_sql('A', 'B', 'q.t1', 'q.d1', 'q.t2', 'q.d2')} / sqrt({_cov_sql('A', 'A', 'q.t1', 'q.d1', 'q.t1', 'q.d1')} * {_cov_sql('B', 'B', 'q.t2', 'q.d2', 'q.t2', 'q.d2')}), 7) AS corr FROM q""")
def factor_covariance(spark, sf_dir):
    size = F.col("p_size")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("A").alias("lsu1"), F.lit("B").alias("lsu2"), (0.05 + size / 50.0).alias("t"), (0.1 + size / 50.0).alias("t1"), F.lit(0.08).alias("d1"), (0.3 + size / 40.0).alias("t2"), F.lit(0.25).alias("d2"))
    return model(spark).correlations(q).select("id", *rounded(9, cov=F.col("cov")), *rounded(7, vol=F.col("vol1"), corr=F.col("corr")))


@query("instant_covariance", f"""WITH {_model_sql()} SELECT id, round(sqrt({_cov_sql('B', 'B', 'q.t2', 'q.d2', 'q.t2', 'q.d2', True)}), 7) AS vol, round({_cov_sql('B', 'A', 'q.t2', 'q.d2', 'q.t1', 'q.d1', True)} / sqrt({_cov_sql('A', 'A', 'q.t1', 'q.d1', 'q.t1', 'q.d1', True)} * {_cov_sql('B', 'B', 'q.t2', 'q.d2', 'q.t2', 'q.d2', True)}), 7) AS corr FROM q""")
def instant_covariance(spark, sf_dir):
    size = F.col("p_size")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("B").alias("lsu1"), F.lit("A").alias("lsu2"), F.lit(0.0).alias("t"), (0.3 + size / 40.0).alias("t1"), F.lit(0.25).alias("d1"), (0.1 + size / 50.0).alias("t2"), F.lit(0.08).alias("d2"))
    return model(spark).correlations(q, instant=True).select("id", *rounded(7, vol=F.col("vol1"), corr=F.col("corr")))


@query("spread_days_value", f"""WITH {_D} SELECT round(sum(30 * df * (s * {cdf('d1')} - k * {cdf('d2')})), 2) AS value FROM e WHERE cp = 'c'""")
def spread_days_value(spark, sf_dir):
    """Value of the right to a margin on 30 days of each trade."""
    rows = op.with_black(trades(spark, sf_dir).where("cp = 'c'"), *_args(), F.col("cp"))
    return rows.agg(F.round(F.sum(30 * F.col("value")), 2).alias("value"))
