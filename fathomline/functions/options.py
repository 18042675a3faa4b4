"""Closed-form option prices and sensitivities as Column expressions.

Black 1976, Bachelier, Kirk 1995 spreads, Margrabe 1978 exchange options and the
cheapest of three by Stulz 1982 in Clark's moment-matched form. `right` columns hold
'c' or 'p'. Times are years, sensitivities per unit unless said otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fathomline.functions.normal import CDF_DEN, CDF_NUM, norm_cdf, norm_pdf, norm_ppf

INF = float("inf")

#: Newton steps of an implied volatility.
STEPS = 40


def omega(right: Column) -> Column:
    """1 for a call, -1 for a put, null otherwise."""
    return F.when(F.lower(right) == "c", 1.0).when(F.lower(right) == "p", -1.0)


def black_d1(s: Column, k: Column, vol: Column, t: Column) -> Column:
    """d1; null where volatility or time is not positive or a price is not."""
    sd = vol * F.sqrt(t)
    return F.when((sd > 0) & (s > 0) & (k > 0) & (k < INF), F.try_divide(F.ln(F.try_divide(s, k)), sd) + sd / 2)


def intrinsic(margin: Column, vol: Column, t: Column) -> Column:
    """The margin if it is positive, else 0; null if it, the volatility or the time is."""
    return F.when(margin.isNotNull() & vol.isNotNull() & t.isNotNull(), F.greatest(margin, F.lit(0.0)))


def black_value(s: Column, k: Column, vol: Column, t: Column, r: Column, right: Column) -> Column:
    """Black 76 value, the intrinsic value (discounted) where there is no time, volatility or finite strike."""
    w, d1 = omega(right), black_d1(s, k, vol, t)
    d2 = d1 - vol * F.sqrt(t)
    disc = F.exp(-r * F.greatest(t, F.lit(0.0)))
    return disc * F.when((t <= 0) | d1.isNull(), intrinsic(w * (s - k), vol, t)).otherwise(w * (s * norm_cdf(w * d1) - k * norm_cdf(w * d2)))


def delta_star(s, k, vol, t, r, right) -> Column:
    """Delta with the symmetric log-moneyness in place of d1."""
    w = omega(right)
    return w * norm_cdf(w * F.ln(s / k) / (vol * F.sqrt(t))) * F.exp(-r * t)


def strike_from_delta(delta, s, vol, t, r, right) -> Column:
    """The strike at which an option with this volatility has this delta; null where the delta, as a number, is nothing or that of the forward."""
    w, sd = omega(right), vol * F.sqrt(t)
    p = w * delta * F.exp(r * t)
    return F.when((p > 0) & (p < 1), s * F.exp(sd * sd / 2 - w * sd * norm_ppf(p)))


def strike_from_delta_star(delta, s, vol, t, r, right) -> Column:
    w = omega(right)
    return s * F.exp(-w * vol * F.sqrt(t) * norm_ppf(w * delta * F.exp(r * t)))


def call_from_put(premium, s, k, t, r, right) -> Column:
    """The premium of the call with the same terms, by parity."""
    return F.when(omega(right) < 0, premium + (s - k) * F.exp(-r * t)).otherwise(premium)


def vol_corrado_miller(premium, s, k, t, r, right) -> Column:
    """Approximate implied volatility (Corrado and Miller 1996); null without time value."""
    call = call_from_put(premium, s, k, t, r, right) * F.exp(r * t)
    half = call - (s - k) / 2
    root = F.sqrt(F.greatest(half * half - (s - k) * (s - k) / 3.141592653589793, F.lit(0.0)))
    extrinsic = call - F.greatest(s - k, F.lit(0.0))
    return F.when(extrinsic > 1e-8, F.sqrt(2 * F.lit(3.141592653589793) / t) / (s + k) * (half + root))


def vol_bharadia(premium, s, k, t, r, right) -> Column:
    """Approximate implied volatility (Bharadia, Christofides and Salkin 1996)."""
    call = call_from_put(premium, s, k, t, r, right) * F.exp(r * t)
    delta = (s - k) / 2
    return F.sqrt(2 * F.lit(3.141592653589793) / t) * (call - delta) / (s - delta)


@F.pandas_udf(DoubleType())
def forward_vol(call: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
    """Black volatility of undiscounted calls by Newton steps from the inflection point sqrt(2 |ln(s/k)| / t), over whole batches; NaN where none gives the premium."""
    c, s, k, t = (x.to_numpy(dtype=float, na_value=np.nan) for x in (call, s, k, t))
    with np.errstate(all="ignore"):
        ok = (t > 0) & (s > 0) & (k > 0) & (c - np.maximum(s - k, 0) > 1e-8) & (c < s)
        moneyness = np.where(ok, np.log(s / k), np.nan)
        vol = np.sqrt(2 * np.maximum(np.abs(moneyness), 0.02) / t)
        for _ in range(STEPS):
            sd = vol * np.sqrt(t)
            d1 = moneyness / sd + sd / 2
            value = s * _cdf(d1) - k * _cdf(d1 - sd)
            vega = s * np.sqrt(t) * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi)
            vol = np.clip(vol - (value - c) / np.maximum(vega, 1e-300), vol / 4, vol * 4)
        miss = np.abs(value - c) > 1e-7 * (c - np.maximum(s - k, 0)) + 1e-12 * np.maximum(s, 1)
    return pd.Series(np.where(ok & ~miss, vol, np.nan))


def vol_from_premium(premium, s, k, t, r, right) -> Column:
    """Implied Black volatility, solved over Arrow batches; null without time value or where no volatility gives the premium."""
    found = forward_vol(call_from_put(premium, s, k, t, r, right) * F.exp(r * t), s, k, t)
    return F.when(~F.isnan(found), found)


def _cdf(x):
    """Normal probabilities of an array, by the same approximation as norm_cdf."""
    a = np.minimum(np.abs(np.nan_to_num(x)), 37.0)
    e = np.exp(-a * a / 2)
    upper = e * np.polyval(CDF_NUM, a) / np.polyval(CDF_DEN, a)
    far = a >= 7.07106781186547
    if far.any():
        a, e = a[far], e[far]
        upper[far] = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    return np.where(x > 0, 1 - upper, upper)


def bachelier_d(s, k, vol, t) -> Column:
    return F.when((vol > 0) & (t > 0), (s - k) / (vol * F.sqrt(t)))


def bachelier_value(s, k, vol, t, r, right, paid: Column | None = None) -> Column:
    """Value when the forward moves by normal amounts; intrinsic without time or volatility. paid: time of payment, if not that of expiry."""
    w, d = omega(right), bachelier_d(s, k, vol, t)
    body = F.when(d.isNull(), F.greatest(w * (s - k), F.lit(0.0))).otherwise(w * (s - k) * norm_cdf(w * d) + vol * F.sqrt(t) * norm_pdf(d))
    return F.exp(-r * F.greatest(t if paid is None else paid, F.lit(0.0))) * body


def bachelier_delta(s, k, vol, t, r, right) -> Column:
    w = omega(right)
    return F.exp(-r * t) * w * norm_cdf(w * bachelier_d(s, k, vol, t))


def bachelier_gamma(s, k, vol, t, r) -> Column:
    return F.exp(-r * t) * norm_pdf(bachelier_d(s, k, vol, t)) / (vol * F.sqrt(t))


def bachelier_vega(s, k, vol, t, r) -> Column:
    return F.exp(-r * t) * F.sqrt(t) * norm_pdf(bachelier_d(s, k, vol, t))


def bachelier_theta(s, k, vol, t, r, right) -> Column:
    return r * bachelier_value(s, k, vol, t, r, right) - F.exp(-r * t) * vol * norm_pdf(bachelier_d(s, k, vol, t)) / (2 * F.sqrt(t))


def bachelier_vol(premium, s, k, t, r, right, steps: int = 30) -> Column:
    """Implied normal volatility: closed form at the money, Newton steps elsewhere."""
    call = call_from_put(premium, s, k, t, r, right) * F.exp(r * t)

    @F.pandas_udf("double")
    def solve(c: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        c, s, k, t = (x.to_numpy(dtype=float, na_value=np.nan) for x in (c, s, k, t))
        with np.errstate(all="ignore"):
            m = s - k
            straddle = 2 * c - m
            vol = straddle * np.sqrt(np.pi / 2 / t)
            low, high = np.zeros_like(vol), np.full_like(vol, np.inf)
            for _ in range(steps):
                sd = vol * np.sqrt(t)
                d = m / sd
                pdf = np.exp(-d * d / 2) / np.sqrt(2 * np.pi)
                miss = m * _cdf(d) + sd * pdf - c
                high, low = np.where(miss > 0, vol, high), np.where(miss > 0, low, vol)
                step = vol - miss / np.maximum(np.sqrt(t) * pdf, 1e-300)
                inside = (step > low) & (step < high)
                vol = np.where(inside, step, np.where(np.isinf(high), 2 * vol, (low + high) / 2))
            ok = (t >= 1e-8) & (c - np.maximum(m, 0) > 1e-10)
        return pd.Series(np.where(ok, vol, np.nan))

    found = solve(call, s, k, t)
    return F.when(~F.isnan(found), found)


def kirk_leg_vol(vol2, f2, k) -> Column:
    """Volatility of the second leg scaled by its share of leg and strike; infinite where these cancel."""
    return F.when(f2 + k == 0, INF).otherwise(vol2 * F.try_divide(f2, f2 + k))


def with_margrabe(rows: DataFrame, name: str, f1: Column, f2: Column, vol1: Column, vol2: Column, rho: Column, t: Column) -> DataFrame:
    """rows with E max(f1 - f2, 0), the right to give the second for the first, not discounted; and name_n1, the weight of the first."""
    out = rows.withColumns({"_f1": f1, "_f2": f2, "_mt": t, "_mv": F.sqrt(F.greatest(F.lit(0.0), vol1 * vol1 + vol2 * vol2 - 2 * rho * vol1 * vol2))})
    out = out.withColumn("_msd", F.col("_mv") * F.sqrt("_mt"))
    out = out.withColumn("_md", F.when(F.col("_msd") > 1e-12, F.ln(F.col("_f1") / F.col("_f2")) / F.col("_msd") + F.col("_msd") / 2))
    out = out.withColumn("_md2", F.col("_md") - F.col("_msd")).withColumns({"_mn1": norm_cdf(F.col("_md")), "_mn2": norm_cdf(F.col("_md2"))})
    value = F.when(F.col("_md").isNull(), F.greatest(F.col("_f1") - F.col("_f2"), F.lit(0.0))).otherwise(F.col("_f1") * F.col("_mn1") - F.col("_f2") * F.col("_mn2"))
    weight = F.when(F.col("_md").isNull(), (F.col("_f1") > F.col("_f2")).cast("double")).otherwise(F.col("_mn1"))
    return out.withColumns({name: value, f"{name}_n1": weight}).drop("_f1", "_f2", "_mt", "_mv", "_msd", "_md", "_md2", "_mn1", "_mn2")


def _exchange(rows: DataFrame, name: str, a: str, b: str, sd: str) -> DataFrame:
    """rows with E max(a - b, 0) of lognormals whose ratio has the deviation sd; columns by name."""
    d1 = F.when(F.col(sd) > 1e-12, F.ln(F.col(a) / F.col(b)) / F.col(sd) + F.col(sd) / 2)
    out = rows.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - F.col(sd))
    value = F.coalesce(F.col(a) * norm_cdf(F.col("_d1")) - F.col(b) * norm_cdf(F.col("_d2")), F.greatest(F.col(a) - F.col(b), F.lit(0.0)))
    return out.withColumn(name, value).drop("_d1", "_d2")


def with_cheapest(rows: DataFrame, f: list[Column], vol: list[Column], rho12: Column, rho13: Column, rho23: Column, t: Column, r: Column, name: str = "value") -> DataFrame:
    """rows with discounted E min(f1, f2, f3), by inclusion and exclusion of the larger of two and of three legs.

    The larger of the first two stands as the lognormal M with its first two moments
    and its covariance with the third leg, all of them exact: E M, E M^2 and E M f3 are
    values of exchange options on the legs, their squares and their products with f3.
    """
    c = F.col
    out = rows.withColumns({"_1": f[0], "_2": f[1], "_3": f[2], "_v1": vol[0], "_v2": vol[1], "_v3": vol[2], "_r12": rho12, "_r13": rho13, "_r23": rho23, "_t": t})
    for i, j in ((1, 2), (1, 3), (2, 3)):
        spread = c(f"_v{i}") ** 2 + c(f"_v{j}") ** 2 - 2 * c(f"_r{i}{j}") * c(f"_v{i}") * c(f"_v{j}")
        out = out.withColumn(f"_s{i}{j}", F.sqrt(F.greatest(F.lit(0.0), spread) * c("_t")))
        out = _exchange(out, f"_m{i}{j}", f"_{i}", f"_{j}", f"_s{i}{j}")
    squares = {f"_q{i}": c(f"_{i}") ** 2 * F.exp(c(f"_v{i}") ** 2 * c("_t")) for i in (1, 2)}
    products = {f"_p{i}": c(f"_{i}") * c("_3") * F.exp(c(f"_r{i}3") * c(f"_v{i}") * c("_v3") * c("_t")) for i in (1, 2)}
    out = out.withColumns({**squares, **products, "_sq": 2 * c("_s12")})
    out = _exchange(_exchange(out, "_mq", "_q1", "_q2", "_sq"), "_mp", "_p1", "_p2", "_s12")
    out = out.withColumn("_mean", c("_2") + c("_m12"))
    var = F.greatest(F.lit(0.0), F.ln((c("_q2") + c("_mq")) / c("_mean") ** 2))
    cov = F.ln((c("_p2") + c("_mp")) / (c("_mean") * c("_3")))
    out = out.withColumn("_s3", F.sqrt(F.greatest(F.lit(0.0), var + c("_v3") ** 2 * c("_t") - 2 * cov)))
    out = _exchange(out, "_m3", "_mean", "_3", "_s3")
    least = c("_1") + c("_2") + c("_3") - (c("_2") + c("_m12")) - (c("_3") + c("_m13")) - (c("_3") + c("_m23")) + (c("_3") + c("_m3"))
    return out.withColumn(name, F.exp(-r * t) * least).select(*rows.columns, name)


def prob_vol(probability: Column, share: Column) -> Column:
    """Long-run deviation at which a martingale lognormal ends below `share` of its start with this probability: root of x^2/2 - q x + ln(share) = 0."""
    q = norm_ppf(probability)
    return q + F.sqrt(F.greatest(q * q - 2 * F.ln(share), F.lit(0.0)))


def one_factor_sigma(probability: Column, share: Column, alpha: Column) -> Column:
    """Volatility of one mean-reverting factor that meets the condition of prob_vol over a delivery of one year."""
    return prob_vol(probability, share) * F.sqrt(2 * alpha) * alpha / (1 - F.exp(-alpha))


def two_factor_sigmas(probability: Column, share: Column, slow: Column, fast: Column, ratio: Column, rho: Column) -> Column:
    """Struct of the volatilities (slow, fast) of two mean-reverting factors that together meet the condition of prob_vol over a delivery of one year; ratio is fast over slow.

    The variance at rest of slow S + fast F is a quadratic form in the two, so the
    slow one is the wanted deviation over the root of the form at (1, ratio).
    """
    g = [-F.expm1(-a) / a for a in (slow, fast)]
    form = g[0] * g[0] / (2 * slow) + 2 * rho * ratio * g[0] * g[1] / (slow + fast) + ratio * ratio * g[1] * g[1] / (2 * fast)
    first = prob_vol(probability, share) / F.sqrt(form)
    return F.struct(first.alias("slow"), (first * ratio).alias("fast"))


def with_black(rows: DataFrame, s: Column, k: Column, vol: Column, t: Column, r: Column, right: Column, prefix: str = "") -> DataFrame:
    """rows with value, delta, gamma, vega and theta (a day) of Black options.

    Shared parts are columns of their own, so every one of them is computed once
    and the generated code stays small.
    """
    c = lambda name: F.col(f"_{name}")
    out = rows.withColumns({"_s": s, "_k": k, "_v": vol, "_t": t, "_r": r, "_w": omega(right)})
    out = out.withColumns({"_sd": c("v") * F.sqrt(F.greatest(c("t"), F.lit(0.0))), "_df": F.exp(-c("r") * F.greatest(c("t"), F.lit(0.0)))})
    out = out.withColumn("_d1", F.when((c("sd") > 0) & (c("s") > 0) & (c("k") > 0) & (c("k") < INF), F.ln(c("s") / c("k")) / c("sd") + c("sd") / 2))
    out = out.withColumns({"_a1": c("w") * c("d1"), "_a2": c("w") * (c("d1") - c("sd"))})
    out = out.withColumns({"_n1": norm_cdf(c("a1")), "_n2": norm_cdf(c("a2")), "_p": norm_pdf(c("d1"))})
    open_value = c("w") * (c("s") * c("n1") - c("k") * c("n2"))
    figures = {
        "value": c("df") * F.when(c("d1").isNull(), intrinsic(c("w") * (c("s") - c("k")), c("v"), c("t"))).otherwise(open_value),
        "delta": c("w") * c("n1") * c("df"),
        "gamma": F.try_divide(c("df") * c("p"), c("s") * c("sd")),
        "vega": c("s") * c("df") * c("p") * F.sqrt(c("t")),
        "theta": (F.try_divide(-c("s") * c("df") * c("p") * c("v"), 2 * F.sqrt(c("t"))) + c("w") * c("r") * c("df") * (c("s") * c("n1") - c("k") * c("n2"))) / 365,
    }
    return out.withColumns({prefix + name: x for name, x in figures.items()}).drop(*[f"_{n}" for n in ("s", "k", "v", "t", "r", "w", "sd", "df", "d1", "a1", "a2", "n1", "n2", "p")])


def with_kirk(rows: DataFrame, f1: Column, f2: Column, k: Column, vol1: Column, vol2: Column, rho: Column, t: Column, r: Column, right: Column) -> DataFrame:
    """rows with all figures of Kirk spread options, shared parts computed once: value, delta1, delta2, gamma1, gamma2, vega1, vega2, theta (a day), rho_sensitivity."""
    out = rows.withColumns({"_f1": f1, "_f2": f2, "_kk": f2 + k, "_v1": vol1, "_rho": rho, "_tt": t, "_rr": r, "_right": right, "_vol2": vol2})
    out = out.withColumn("_b", kirk_leg_vol(F.col("_vol2"), F.col("_f2"), F.col("_kk") - F.col("_f2")))
    variance = F.col("_v1") * F.col("_v1") + F.col("_b") * F.col("_b") - 2 * F.col("_rho") * F.col("_v1") * F.col("_b")
    out = out.withColumn("_vol", F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)))
    out = with_black(out, F.col("_f1"), F.col("_kk"), F.col("_vol"), F.col("_tt"), F.col("_rr"), F.col("_right"), "_x_")
    out = out.withColumn("_dd2", F.ln(F.col("_f1") / F.col("_kk")) / (F.col("_vol") * F.sqrt("_tt")) - F.col("_vol") * F.sqrt("_tt") / 2)
    w, v, kept = omega(F.col("_right")), F.col("_vol"), F.exp(-F.col("_rr") * F.col("_tt"))
    out = out.withColumns({"_n2w": norm_cdf(w * F.col("_dd2")), "_p2": norm_pdf(F.col("_dd2"))})
    figures = {
        "value": F.col("_x_value"),
        "delta1": F.col("_x_delta"),
        "delta2": -w * F.col("_n2w") * kept,
        "gamma1": F.col("_x_gamma"),
        "gamma2": kept * F.col("_p2") / (F.col("_kk") * v * F.sqrt("_tt")),
        "vega1": F.col("_x_vega") * F.when(v > 1e-6, (F.col("_v1") - F.col("_rho") * F.col("_b")) / v).when(v.isNotNull(), 0.0),
        "vega2": F.col("_x_vega") * F.when(v > 1e-6, (F.col("_b") - F.col("_rho") * F.col("_v1")) / v * F.col("_f2") / F.col("_kk")).when(v.isNotNull(), 0.0),
        "theta": F.col("_x_theta"),
        "rho_sensitivity": F.when(v > 1e-6, -F.col("_x_vega") * F.col("_v1") * F.col("_b") / v).when(v.isNotNull(), 0.0),
    }
    return out.withColumns(figures).select(*rows.columns, *figures)


def with_black_dated(rows: DataFrame, pricing: Column, expiry: Column, s: Column, k: Column, vol: Column, r: Column, right: Column) -> DataFrame:
    """with_black() between two dates, in years of 365 days."""
    return with_black(rows, s, k, vol, F.datediff(expiry, pricing) / 365, r, right)


def with_kirk_dated(rows: DataFrame, pricing: Column, expiry: Column, f1: Column, f2: Column, k: Column, vol1: Column, vol2: Column, rho: Column, r: Column, right: Column) -> DataFrame:
    """with_kirk() between two dates, in years of 365 days."""
    return with_kirk(rows, f1, f2, k, vol1, vol2, rho, F.datediff(expiry, pricing) / 365, r, right)


def spread_intrinsic(f1: Column, f2: Column, k: Column, t: Column, r: Column, right: Column) -> Column:
    """Discounted value of a spread option whose legs no longer move."""
    return F.exp(-r * F.greatest(t, F.lit(0.0))) * F.greatest(omega(right) * (f1 - f2 - k), F.lit(0.0))


#: Rows whose integrals are worked out at once, and deviations beyond which a correlation doesn't matter to a probability.
COPULA_ROWS, NEAR = 32, 8.6


def copula_spread(f1: Column, f2: Column, k: Column, vol1: Column, skew1: Column, vol2: Column, skew2: Column, rho: Column, t: Column, points: int = 500, deviations: float = 7.0) -> Column:
    """E max(f1 - f2 - k, 0), not discounted, of legs with smiles under a Gaussian copula.

    A leg's volatility at price x is vol + skew ln(x / f), at least a hundredth. The
    value is the integral over y of P(leg1 > y + k, leg2 < y), by `points` steps in
    ln y over `deviations` at either end, for Arrow batches of rows at once.
    """

    @F.pandas_udf("double")
    def integrate(f1: pd.Series, f2: pd.Series, k: pd.Series, v1: pd.Series, w1: pd.Series, v2: pd.Series, w2: pd.Series, rho: pd.Series, t: pd.Series) -> pd.Series:
        out = np.empty(len(f1))
        columns = [x.to_numpy(dtype=float)[:, None] for x in (f1, f2, k, v1, w1, v2, w2, rho, t)]
        for i in range(0, len(out), COPULA_ROWS):
            out[i : i + COPULA_ROWS] = _copula(*[x[i : i + COPULA_ROWS] for x in columns], points, deviations)
        return pd.Series(out)

    return integrate(*[x.cast("double") for x in (f1, f2, k, vol1, skew1, vol2, skew2, rho, t)])


def _copula(f1, f2, k, v1, w1, v2, w2, rho, t, points, deviations):
    with np.errstate(all="ignore"):
        ends = [f * np.exp(sign * deviations * v * np.sqrt(t)) - shift for f, v, shift in ((f1, v1, k), (f2, v2, 0 * k)) for sign in (-1, 1)]
        low, high = (np.log(np.maximum(1e-6, pick(ends, axis=0))) for pick in (np.min, np.max))
        y = np.exp(low + (high - low) * np.linspace(0, 1, points + 1))

        def normal(x, f, v, w):
            """The normal whose probability is that of a leg below x."""
            m = np.log(np.maximum(x, 1e-300) / f)
            sd = np.maximum(v + w * m, 0.01) * np.sqrt(t)
            return np.where(x > 0, (m + sd * sd / 2) / sd, -38.0)

        a, b = normal(y + k, f1, v1, w1), normal(y, f2, v2, w2)
        return ((_above_below(a, b, rho) * y).sum(1, keepdims=True) * (high - low) / points)[:, 0]


def _above_below(a, b, rho):
    """P(X > a, Y < b) of standard normals with correlations rho (rows x 1): the one-dimensional integral over the correlation, by 12 Gauss points, or 24 for strong ones.

    What the correlation adds is less than exp(-max(a, b)^2 / 2), so beyond NEAR it is less than rounding and isn't worked out.
    """
    out = _cdf(b) * _cdf(-a)
    near = ((np.abs(a) < NEAR) & (np.abs(b) < NEAR)) | np.isnan(a + b)
    a, b, counts = a[near], b[near], near.sum(1)
    one = len(rho) and (rho == rho[0]).all()  # one correlation for all rows: a number serves
    rho = rho[0] if one else rho[:, 0]
    each = (lambda x: x[0]) if one else (lambda x: np.repeat(x, counts))
    nodes, weights = np.polynomial.legendre.leggauss(24 if np.max(np.abs(rho), initial=0.0) > 0.75 else 12)
    angle = np.arcsin(np.clip(rho, -0.999999, 0.999999))
    squares, product = a * a, a * b
    squares += b * b
    part, more, total = np.empty_like(squares), np.empty_like(squares), np.zeros_like(squares)
    for x, w in zip(nodes, weights):  # in place, so that the arrays of a few rows stay in the processor's cache
        s = np.sin(angle * (x + 1) / 2)
        over = 1 / (1 - s * s)
        np.multiply(squares, each(-over / 2), out=part)
        np.multiply(product, each(s * over), out=more)
        part += more
        np.exp(part, out=part)
        part *= w
        total += part
    out[near] -= total * each(angle / (4 * np.pi))
    return out
