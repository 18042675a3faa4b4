"""Factor models to and from tables, in another currency, between dates, simulated and calibrated.

A model table has a row for each factor (place, underlying, factor, sigma, alpha):
underlying names one or, separated by ';', several that share the factor. Its
correlations are cells (row, col, rho) by places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.bounds import if_small
from fathomline.operators.covariance import Factors, loading
from fathomline.operators.intervals import overlaps
from fathomline.operators.staging import stage

#: Factors of a model that are checked as one matrix.
MOST_FACTORS = 2000
#: Days by which a month's start is moved forward in a look-up, so that its first day is in it.
SLACK = 0.001


def from_table(rows: DataFrame, cells: DataFrame) -> Factors:
    """The model of a table: rows up to the first place without an underlying, and the correlations between them.

    Rows (place, underlying, factor, sigma, alpha); cells (row, col, rho).
    """
    blank = F.coalesce(F.trim("underlying"), F.lit("")) == ""
    end = rows.where(blank).agg(F.min("place")).first()[0]
    own = rows.where(~blank & (F.lit(True) if end is None else F.col("place") < F.lit(end)))
    names = F.explode(F.transform(F.split("underlying", ";"), lambda x: F.trim(x))).alias("lsu")
    factors = own.select(F.col("place").alias("idx"), F.col("sigma").cast("double").alias("sigma"), F.col("alpha").cast("double").alias("alpha"))
    kept = factors.select("idx")
    rho = cells.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("rho").cast("double").alias("rho")).where("rho is not null")
    rho = rho.join(kept.withColumnRenamed("idx", "i"), "i", "left_semi").join(kept.withColumnRenamed("idx", "j"), "j", "left_semi").select("i", "j", "rho")
    return Factors(factors, own.select(F.col("place").alias("idx"), names, "factor"), rho)


def to_table(model: Factors) -> DataFrame:
    """Rows (place, underlying, factor, sigma, alpha) of a model; shared factors name all their underlyings, in order."""
    factor = F.min("factor") if "factor" in model.bridge.columns else F.lit(None).cast("int")
    names = model.bridge.groupBy("idx").agg(F.array_join(F.array_sort(F.collect_set("lsu")), ";").alias("underlying"), factor.alias("factor"))
    return model.factors.join(names, "idx").select(F.col("idx").alias("place"), "underlying", "factor", "sigma", "alpha")


def positive_definite(model: Factors) -> bool:
    """Whether the correlations have a Cholesky factor; at most MOST_FACTORS factors, which are one matrix."""
    n = model.factors.count()
    if n > MOST_FACTORS:
        raise ValueError(f"{n} factors: at most {MOST_FACTORS} can be checked")
    names = {r["idx"]: k for k, r in enumerate(model.factors.select("idx").orderBy("idx").collect())}
    m = np.zeros((n, n))
    for r in model.rho.collect():
        m[names[r["i"]], names[r["j"]]] = r["rho"]
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return False
    return True


def subset(model: Factors, underlyings: list[str]) -> Factors:
    """The factors of some underlyings, and what they have with each other."""
    bridge = model.bridge.where(F.col("lsu").isin(*underlyings))
    keep = bridge.select("idx").distinct()
    rho = model.rho.join(keep.withColumnRenamed("idx", "i"), "i", "left_semi").join(keep.withColumnRenamed("idx", "j"), "j", "left_semi").select("i", "j", "rho")
    return Factors(model.factors.join(keep, "idx", "left_semi"), bridge, rho)


def double_factors(bridge: DataFrame) -> DataFrame:
    """(lsu, factor, n): underlyings that have a factor number more than once."""
    return bridge.groupBy("lsu", "factor").agg(F.count("*").alias("n")).where("n > 1")


def pivot_currencies(fx: DataFrame) -> DataFrame:
    """(currency): those that are in every pair (idx, currency, foreign) of a model."""
    n = fx.agg(F.count_distinct("idx").alias("_n"))
    sides = fx.select("idx", F.explode(F.array_distinct(F.array("currency", "foreign"))).alias("currency"))
    return sides.groupBy("currency").agg(F.count_distinct("idx").alias("_own")).join(F.broadcast(n), F.col("_own") == F.col("_n")).select("currency")  # one row


def in_currency(model: Factors, fx: DataFrame, numeraire: str) -> tuple[Factors, DataFrame]:
    """The model with all currency pairs (idx, currency, foreign) seen from a currency, and the new pairs.

    A pair with the currency as foreign is turned round. Another one becomes the pair
    of the currency and its foreign side: the product of it and the pair of the
    currency and its own side. So every new factor is a weighted sum of old ones, and
    volatilities and correlations follow from the weights.
    """
    own = fx.withColumn("_turn", F.col("foreign") == numeraire)
    own = own.select("idx", F.when(F.col("_turn"), F.col("foreign")).otherwise(F.col("currency")).alias("currency"), F.when(F.col("_turn"), F.col("currency")).otherwise(F.col("foreign")).alias("foreign"), F.when(F.col("_turn"), -1.0).otherwise(1.0).alias("_sign"))
    direct = own.where(F.col("currency") == numeraire).select(F.col("foreign").alias("currency"), F.col("idx").alias("_cross"), F.col("_sign").alias("_cross_sign"))
    joined = own.join(direct, "currency", "left").withColumn("_through", F.col("_cross").isNotNull() & (F.col("currency") != numeraire))
    sigma = model.factors.select("idx", "sigma")
    parts = sigma.join(joined.select("idx", "_sign", "_cross", "_cross_sign", "_through"), "idx", "left")
    one = parts.select(F.col("idx").alias("i"), F.col("idx").alias("k"), (F.coalesce("_sign", F.lit(1.0)) * F.col("sigma")).alias("w"))
    two = parts.where("_through").select(F.col("idx").alias("i"), F.col("_cross").alias("k"), "_cross_sign").join(sigma.select(F.col("idx").alias("k"), F.col("sigma").alias("_s")), "k").select("i", "k", (F.col("_cross_sign") * F.col("_s")).alias("w"))
    weights = one.unionByName(two)
    other = weights.select(F.col("i").alias("j"), F.col("k").alias("l"), F.col("w").alias("v"))
    rho = model.rho.select(F.col("i").alias("k"), F.col("j").alias("l"), "rho")
    cov = rho.join(weights, "k").join(other, "l").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v") * F.col("rho")).alias("cov"))
    new = cov.where("i = j").select(F.col("i").alias("idx"), F.sqrt("cov").alias("_s"))
    factors = model.factors.join(new, "idx").select("idx", F.col("_s").alias("sigma"), "alpha")
    s1, s2 = new.select(F.col("idx").alias("i"), F.col("_s").alias("_s1")), new.select(F.col("idx").alias("j"), F.col("_s").alias("_s2"))
    out = cov.join(s1, "i").join(s2, "j").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("cov") / (F.col("_s1") * F.col("_s2"))).alias("rho"))
    pairs = joined.select("idx", F.when(F.col("_through"), F.lit(numeraire)).otherwise(F.col("currency")).alias("currency"), "foreign")
    return Factors(factors, model.bridge, out), pairs


def dated(asked: DataFrame, pricing: Column, exercise: Column, start: Column, end: Column) -> DataFrame:
    """asked with t, tau and span in years of 365 days: to exercise (a null: the day before delivery starts, not before pricing), to the start and for the days from start to end. A row that is exercised before it is priced has nulls."""
    day = F.greatest(pricing, F.coalesce(exercise, F.date_sub(start, 1)))
    good = F.coalesce(exercise >= pricing, F.lit(True))
    year = lambda a, b: F.when(good, F.datediff(b, a) / 365)
    return asked.withColumns({"t": year(pricing, day), "tau": year(pricing, start), "span": year(start, F.date_add(end, 1))})


def spot_ratios(asked: DataFrame, ratios: DataFrame, pricing: Column) -> DataFrame:
    """asked (lsu, tau, …) with ratio: that of the calendar month in which the part of tau beyond whole years from pricing lies. ratios: (lsu, month, ratio); null if there is none."""
    days = (F.col("tau") - F.floor("tau")) * 365 + SLACK
    month = F.month(F.date_add(pricing, F.floor(days).cast("int")))
    return asked.withColumn("_month", month).join(ratios.withColumnRenamed("month", "_month"), ["lsu", "_month"], "left").drop("_month")


def ratio_table(wide: DataFrame, month: str) -> DataFrame:
    """(lsu, month, ratio) from a table with a column for each underlying and a row for each of the twelve months."""
    names = [c for c in wide.columns if c != month]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("lsu"), F.col(f"`{c}`").cast("double").alias("ratio")) for c in names])).alias("x")
    return wide.select(F.col(month).cast("int").alias("month"), cells).select("x.lsu", "month", "x.ratio").where("ratio is not null")


def loadings(asked: DataFrame, model: Factors, scales: DataFrame | None = None) -> DataFrame:
    """asked (lsu, t, tau, span, …) with a row for each factor of lsu: columns factor (its index), loading and part (loading over the volatility at t).

    scales (lsu, first, last, scale): what volatility is multiplied with over stretches
    of delivery time; then the loading is the mean over the stretches that tau to tau +
    span meets, by their length (1 where there is none, so none is lost).
    """
    own = model.factors.join(model.bridge.select("idx", "lsu"), "idx")
    lists = own.groupBy("lsu").agg(F.array_sort(F.collect_list(F.struct("idx", "sigma", "alpha"))).alias("_f"))
    pairs = own.select("lsu", F.col("idx").alias("i")).distinct().join(own.select("lsu", F.col("idx").alias("j")).distinct(), "lsu").join(model.rho, ["i", "j"])
    lists = lists.join(pairs.groupBy("lsu").agg(F.collect_list(F.struct("i", "j", "rho")).alias("_rho")), "lsu", "left")
    keys = asked.columns
    rows = asked if scales is None else _stretches(asked, scales)
    at = lambda f, start, length: loading(f["sigma"], f["alpha"], F.col("t"), start, length)
    if scales is None:
        whole = lambda f: at(f, F.col("tau"), F.col("span"))
    else:
        whole = lambda f: F.aggregate("_part", F.lit(0.0), lambda acc, p: acc + at(f, p["from"], p["to"] - p["from"]) * p["scale"] * (p["to"] - p["from"])) / F.col("span")
    # the factors of an underlying are few: they come to the rows as arrays, and no row is shuffled or joined with itself
    rows = rows.join(if_small(lists, MOST_FACTORS), "lsu").withColumn("_l", F.transform("_f", lambda f: F.struct(f["idx"].alias("factor"), whole(f).alias("loading"))))
    rows = rows.withColumn("_by", F.map_from_entries(F.array_distinct("_l")))
    var = F.aggregate("_rho", F.lit(0.0), lambda acc, r: acc + F.try_element_at("_by", r["i"]) * F.try_element_at("_by", r["j"]) * r["rho"])
    return rows.withColumn("_var", var).select(*keys, "_var", F.inline("_l")).select(*keys, "factor", "loading", (F.col("loading") / F.sqrt("_var")).alias("part"))


def _stretches(asked: DataFrame, scales: DataFrame) -> DataFrame:
    """asked (lsu, tau, span, …) with _part: the stretches (from, to, scale) that tau to tau + span meets, the whole with scale 1 where there is none.

    Few stretches (MOST_FACTORS in all) come to the rows as arrays; more are joined by their overlaps.
    """
    end = F.col("tau") + F.col("span")
    whole = F.array(F.struct(F.col("tau").alias("from"), end.alias("to"), F.lit(1.0).alias("scale")))
    if scales.limit(MOST_FACTORS + 1).count() <= MOST_FACTORS:
        own = scales.where("first < last").groupBy("lsu").agg(F.collect_list(F.struct("first", "last", "scale")).alias("_s"))
        met = F.filter("_s", lambda x: (x["first"] < end) & (F.col("tau") < x["last"]) & (F.col("tau") < end))
        cut = F.transform(met, lambda x: F.struct(F.greatest("tau", x["first"]).alias("from"), F.least(end, x["last"]).alias("to"), x["scale"].alias("scale")))
        rows = asked.join(F.broadcast(own), "lsu", "left").withColumn("_part", cut)
        return rows.select(*asked.columns, F.when(F.size("_part") > 0, F.col("_part")).otherwise(whole).alias("_part"))
    own_rows = stage(asked.withColumns({"_n": F.monotonically_increasing_id(), "_end": end}), "asked")
    met = overlaps(own_rows.select("_n", "lsu", "tau", "_end"), scales, ("tau", "_end"), ("first", "last"), by=["lsu"])
    cut = F.struct(F.greatest("l.tau", "r.first").alias("from"), F.least("l._end", "r.last").alias("to"), F.col("r.scale").alias("scale"))
    parts = met.groupBy(F.col("l._n").alias("_n")).agg(F.collect_list(cut).alias("_part"))
    return own_rows.join(parts, "_n", "left").select(*asked.columns, F.coalesce("_part", whole).alias("_part"))


def ratio_vols(asked: DataFrame, model: Factors) -> DataFrame:
    """asked (lsu1, lsu2, t, t1, d1, t2, d2, …) with ratio_vol: yearly volatility of the ratio of the two forwards until t."""
    c = F.col
    out = model.correlations(asked)
    return out.select(*asked.columns, F.sqrt(F.greatest(F.lit(0.0), c("vol1") ** 2 + c("vol2") ** 2 - 2 * c("corr") * c("vol1") * c("vol2"))).alias("ratio_vol"))


def corr_matrix(periods: DataFrame, model: Factors) -> DataFrame:
    """(p, q, corr) of all pairs of the delivery periods (p, lsu, t, tau, span) that are exercised at the same time: as many rows as the matrix has, which is what is asked for."""
    a = periods.select(F.col("p"), F.col("lsu").alias("lsu1"), "t", F.col("tau").alias("t1"), F.col("span").alias("d1"))
    b = periods.select(F.col("p").alias("q"), F.col("lsu").alias("lsu2"), "t", F.col("tau").alias("t2"), F.col("span").alias("d2"))
    return model.correlations(a.join(b, "t")).select("p", "q", "corr")


def simulated_prices(states: DataFrame, asked: DataFrame, model: Factors, fx: DataFrame | None = None) -> DataFrame:
    """(path, step, id, price): martingale prices exp(sum of loading x state - variance / 2), over a currency drift if fx is given.

    states (path, step, factor, state) with factor as the model's index, and lsu where each underlying was simulated by itself; asked (id,
    lsu, step, t, tau, span), t the time of the step; fx (id, lsu2): the currency factor's
    underlying, whose covariance with the price is taken out.
    """
    rows = asked.select("id", "step", F.col("lsu").alias("lsu1"), F.col("lsu").alias("lsu2"), "t", F.col("tau").alias("t1"), F.col("span").alias("d1"), F.col("tau").alias("t2"), F.col("span").alias("d2"))
    var = model.covariances(rows).select("id", "step", (F.col("cov") / 2).alias("_drift"))
    if fx is not None:
        cov = model.covariances(rows.drop("lsu2").join(fx, "id")).select("id", "step", F.col("cov").alias("_fx"))
        var = var.join(cov, ["id", "step"], "left").select("id", "step", (F.col("_drift") + F.coalesce("_fx", F.lit(0.0))).alias("_drift"))
    own = ["lsu"] if "lsu" in states.columns else []
    load = loadings(asked, model).select(*own, "id", "step", "factor", "loading").join(var, ["id", "step"])
    moved = states.join(if_small(load, MOST_FACTORS), [*own, "step", "factor"])
    return moved.groupBy("path", "step", "id").agg(F.exp(F.sum(F.col("loading") * F.col("state")) - F.max("_drift")).alias("price"))


def fit_factors(vols: DataFrame, by: list[str], start: str, length: str, vol: str, weight: Column, alphas: list[tuple[float, float]], ratios: tuple[float, ...], rhos: tuple[float, ...]) -> DataFrame:
    """(by, slow, fast, ratio, rho, sigma, sse): the two-factor model that fits volatilities of contracts best by weighted least squares.

    For each combination of speeds, ratio of the fast to the slow volatility and
    correlation, a contract's volatility is the slow one times a known shape, so the
    slow volatility follows in closed form from two sums; the best combination of each
    group stays. Ratio 0 is a model of one factor.
    """
    grid = [(float(a), float(b), float(m), float(p)) for a, b in alphas for m in ratios for p in (rhos if m else (0.0,))]
    names = ("slow", "fast", "ratio", "rho")
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, row)]) for row in grid])).alias("_g")
    rows = vols.select(*by, F.col(start).alias("_T"), F.col(length).alias("_D"), F.col(vol).alias("_y"), weight.alias("_w"), each).select("*", "_g.*")
    a, b = (loading(F.lit(1.0), F.col(x), F.lit(0.0), F.col("_T"), F.col("_D")) for x in ("slow", "fast"))
    shape = F.sqrt(a * a + 2 * F.col("rho") * F.col("ratio") * a * b + F.col("ratio") ** 2 * b * b)
    x, y, w = F.col("_x"), F.col("_y"), F.col("_w")
    sums = rows.withColumn("_x", shape).groupBy(*by, *names).agg(F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"))
    sums = sums.withColumn("sigma", F.col("xy") / F.col("xx")).withColumn("sse", F.greatest(F.lit(0.0), F.col("yy") - F.col("sigma") * F.col("xy")))
    best = F.min_by(F.struct(*names, "sigma", "sse"), F.struct(F.round("sse", 9), *names)).alias("_b")
    return sums.groupBy(*by).agg(best).select(*by, "_b.*")


def filled_rho(measured: DataFrame, factors: DataFrame) -> DataFrame:
    """(i, j, rho) of factors (idx, lsu, k) from correlations (a, b, corr) measured between the contracts that stand for factor k of an underlying, written lsu:k; 1 with itself, 0 where nothing was measured."""
    named = factors.select("idx", F.concat_ws(":", "lsu", "k").alias("name"))
    both = measured.select("a", "b", "corr").unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).groupBy("a", "b").agg(F.max("corr").alias("corr"))
    left, right = named.select(F.col("idx").alias("i"), F.col("name").alias("a")), named.select(F.col("idx").alias("j"), F.col("name").alias("b"))
    found = both.join(left, "a").join(right, "b").where("i <> j").select("i", "j", F.col("corr").alias("rho"))
    own = named.select("idx").distinct()  # factors that underlyings share have several names
    return found.distinct().unionByName(own.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("rho")))


def ordered(factors: DataFrame) -> DataFrame:
    """(lsu, k, idx): factors of each underlying, slowest first."""
    return factors.select("lsu", F.row_number().over(Window.partitionBy("lsu").orderBy("alpha", "idx")).alias("k"), "idx")
