"""Calibration of factor models: bounded least squares for many underlyings at once, and underlyings that stand on others, level by level.

An underlying's log forward price is driven by one to three mean-reverting factors.
Their volatilities (sigma) and speeds (alpha) are fitted to measured volatilities of
contracts and of ratios of two contracts; correlations are measured, not fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.covariance import Factors
from fathomline.operators.staging import stage

#: Start, least and most of the long, short and very short factor's volatility and speed, and the speeds of a robust fit (fixed values of the model).
SIGMAS = ((0.1, 0.01, np.inf), (0.15, 0.01, np.inf), (0.4, 0.01, np.inf))
ALPHAS = ((0.05, 0.0, 0.1), (2.0, 0.1, 10.0), (30.0, 10.0, 100.0))
ROBUST_ALPHAS = ((0.25, 1e-05, 0.5), (2.0, 0.5, 10.0), (30.0, 10.0, 100.0))
#: Least variance of a volatility in another currency (fixed value of the model).
LEAST_VARIANCE = 1e-8
#: Factors of a model, at most.
MOST = 3
#: Underlyings that one batch of arrays holds, at most.
AT_ONCE = 256
#: Other starts besides the given one: where in their bounds (as powers of the ratio of most to least) the speeds of the factors begin.
OTHER_STARTS = ((0.2, 0.3, 0.5), (0.5, 0.7, 0.5), (0.3, 0.9, 0.2), (0.7, 0.4, 0.8), (0.6, 0.8, 0.3))
#: A sum of squares that is nothing but rounding.
NOTHING = 1e-26
#: Bounds of the logarithm of the fast volatility over the slow one, where both follow from a condition.
LOG_RATIO = (0.0, -7.0, 7.0)


def bounded_least_squares(
    residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, free: np.ndarray, turns: int = 300, slopes: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, sums of squares and turns of many small least squares problems at once, each within its box.

    residuals(parameters, rows) gives a row of residuals for each row of parameters;
    rows are the numbers of the problems they belong to. All of start, low, high and
    free (which parameters may move) have a row for each problem.

    Each turn is a damped Gauss-Newton step in the parameters that aren't held by a
    bound (one that the slope points out of), cut back to the box, and taken if it
    lowers the sum; the damping falls with success and rises without. A problem ends
    where its sum is nothing, or neither a step nor what its slopes promise lowers it
    by more than rounding does. slopes(parameters, rows) are those of the residuals
    (problems x residuals x parameters), worked out anew only where a step was taken;
    without it they are central differences that never leave the box.
    """
    p = np.clip(start, low, high)
    n, width = p.shape
    rows = np.arange(n)
    at = residuals(p, rows)
    loss, damp, took = (at * at).sum(1), np.full(n, 1e-3), np.zeros(n, int)
    known, moved = np.zeros((n, at.shape[1], width)), np.ones(n, bool)
    todo = rows[free.any(1)]
    eye = np.eye(width)
    differences = lambda x, own: _differences(residuals, x, own, low[own], high[own], free[own])
    for _ in range(turns):
        if not len(todo):
            break
        fresh = todo[moved[todo]]
        if len(fresh):
            known[fresh] = (slopes or differences)(p[fresh], fresh)
            moved[fresh] = False
        x, lo, hi, own = p[todo], low[todo], high[todo], free[todo]
        slope = known[todo]
        g = (at[todo][:, None, :] @ slope)[:, 0]
        held = ~own | (x <= lo) & (g >= 0) | (x >= hi) & (g <= 0)
        g[held] = 0.0
        h = np.where(held[:, None, :] | held[:, :, None], 0.0, slope.transpose(0, 2, 1) @ slope)
        scale = np.einsum("nkk->nk", h)
        scale = np.where(held, 1.0, np.maximum(scale, 1e-12 * np.maximum(scale.max(1, keepdims=True), 1e-30)))
        step = -np.linalg.solve(h + (damp[todo][:, None] * scale + held)[:, :, None] * eye, g[:, :, None])[:, :, 0]
        promised = -(g * step).sum(1)  # at least half of what the slopes promise, and shorter steps promise less
        new = np.clip(x + step, lo, hi)
        r2 = residuals(new, todo)
        lower = (r2 * r2).sum(1)
        good = lower < loss[todo]
        gain = loss[todo] - lower
        won = todo[good]
        p[won], at[won], moved[won] = new[good], r2[good], True
        still = np.where(good, (gain > 1e-15 * loss[todo]) & (loss[todo] > NOTHING), (damp[todo] < 1e12) & (promised > 1e-15 * loss[todo]))
        loss[won] = lower[good]
        damp[todo] = np.clip(np.where(good, damp[todo] * 0.3, damp[todo] * 5), 1e-12, 1e13)
        took[todo] += 1
        todo = todo[still & ~held.all(1)]
    return p, loss, took


def _differences(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Slopes of the free parameters by central differences within the box."""
    slope = None
    for k in np.flatnonzero(free.any(0)):
        step = 1e-6 * np.maximum(np.abs(x[:, k]), 1e-2)
        up, down = x.copy(), x.copy()
        up[:, k], down[:, k] = np.minimum(x[:, k] + step, high[:, k]), np.maximum(x[:, k] - step, low[:, k])
        span = up[:, k] - down[:, k]
        change = (residuals(up, rows) - residuals(down, rows)) / np.where(span > 0, span, 1.0)[:, None]
        if slope is None:
            slope = np.zeros((*change.shape, x.shape[1]))
        slope[:, :, k] = change
    return slope


def _mean_decay(x: np.ndarray) -> np.ndarray:
    """(1 - exp(-x)) / x, 1 at 0."""
    small = np.abs(x) < 1e-8
    return np.where(small, 1 - x / 2, -np.expm1(-x) / np.where(small, 1.0, x))


def _mean_decay_slope(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The derivative of _mean_decay, whose value is mean."""
    small = np.abs(x) < 1e-4
    return np.where(small, -0.5 + x / 3 - x * x / 8, (np.exp(-x) - mean) / np.where(small, 1.0, x))


def _loads(alpha: np.ndarray, start: np.ndarray, length: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Mean loading on a factor of unit volatility over a delivery, and its derivative in the factor's speed."""
    kept, x = np.exp(-alpha * start), alpha * length
    mean = _mean_decay(x)
    return kept * mean, kept * (length * _mean_decay_slope(x, mean) - start * mean) if slopes else None


def model_vols(sigma: np.ndarray, alpha: np.ndarray, rho: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
    """Yearly volatilities (models x quotes) until t of contracts that deliver from t1 on for d1 years, or of their ratio to those of t2 and d2 where `ratio` is 1; t 0 is now.

    sigma and alpha (models x MOST), rho (models x MOST x MOST); a factor that a model lacks has sigma 0.
    """
    return _vols(sigma, alpha, rho, q, False)[0]


def _vols(sigma: np.ndarray, alpha: np.ndarray, rho: np.ndarray, q: dict[str, np.ndarray], slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """model_vols, and its derivatives (models x quotes x 2 MOST) in sigma and alpha; those of a volatility of 0 are 0."""
    used = np.flatnonzero((sigma != 0).any(0))
    i, j = np.nonzero(q["ratio"])
    t = q["t"]
    start, second, length = q["t1"] - t, (q["t2"] - t)[i, j], q["d2"][i, j]
    unit, bend, w = {}, {}, {}
    for k in used:
        unit[k], bend[k] = _loads(alpha[:, k : k + 1], start, q["d1"], slopes)
        if len(i):
            more, more_bend = _loads(alpha[i, k], second, length, slopes)
            unit[k][i, j] -= q["ratio"][i, j] * more
            if slopes:
                bend[k][i, j] -= q["ratio"][i, j] * more_bend
        w[k] = sigma[:, k : k + 1] * unit[k]
    # what a factor moves together with all others, and how that changes with its speed
    joint, turned = {k: 0.0 for k in used}, {k: 0.0 for k in used}
    for n, k in enumerate(used):
        for m in used[n:]:
            x = (alpha[:, k] + alpha[:, m])[:, None] * t
            rest, c = _mean_decay(x), rho[:, k, m][:, None]
            both = c * rest
            joint[k] = joint[k] + both * w[m]
            if m != k:
                joint[m] = joint[m] + both * w[k]
            if slopes:
                slow = c * t * _mean_decay_slope(x, rest)
                turned[k] = turned[k] + slow * w[m]
                if m != k:
                    turned[m] = turned[m] + slow * w[k]
    vol = np.sqrt(np.maximum(sum((w[k] * joint[k] for k in used), np.zeros_like(t)), 0.0))
    if not slopes:
        return vol, None
    out = np.zeros((*t.shape, 2 * MOST))
    over = np.where(vol > 0, 1.0, 0.0) / np.where(vol > 0, vol, 1.0)
    for k in used:
        out[:, :, k] = over * unit[k] * joint[k]
        out[:, :, MOST + k] = over * (sigma[:, k : k + 1] * bend[k] * joint[k] + w[k] * turned[k])
    return vol, out


def _sigmas(p: np.ndarray, rest: np.ndarray, n: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Volatilities from parameters: themselves, or where `rest` is given those that make the deviation at rest of a year's delivery equal to it, at the ratio exp(second parameter)."""
    sigma, alpha = p[:, :MOST].copy(), p[:, MOST:]
    tied = ~np.isnan(rest)
    if tied.any():
        a = np.maximum(alpha[tied, :2], 1e-9)
        g = _mean_decay(a)
        ratio = np.where(n[tied] > 1, np.exp(sigma[tied, 1]), 0.0)
        form = g[:, 0] ** 2 / (2 * a[:, 0]) + 2 * rho[tied, 0, 1] * ratio * g[:, 0] * g[:, 1] / a.sum(1) + (ratio * g[:, 1]) ** 2 / (2 * a[:, 1])
        sigma[tied, 0] = rest[tied] / np.sqrt(form)
        sigma[tied, 1] = ratio * sigma[tied, 0]
    return np.where(np.arange(MOST) < n[:, None], sigma, 0.0)


@dataclass
class Problem:
    """The fits of one batch: factors of each, correlations, deviation at rest (NaN: none), quotes (models x quotes, weight 0 where there are fewer)."""

    n: np.ndarray
    rho: np.ndarray
    rest: np.ndarray
    quotes: dict[str, np.ndarray]

    def residuals(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q = {k: v[rows] for k, v in self.quotes.items()}
        found = model_vols(_sigmas(p, self.rest[rows], self.n[rows], self.rho[rows]), p[:, MOST:], self.rho[rows], q)
        return np.sqrt(q["weight"]) * (found - q["vol"])

    def slopes(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Derivatives of the residuals in the parameters."""
        q = {k: v[rows] for k, v in self.quotes.items()}
        own = (self.rest[rows], self.n[rows], self.rho[rows])
        _, out = _vols(_sigmas(p, *own), p[:, MOST:], own[2], q, True)
        tied = np.flatnonzero(~np.isnan(own[0]))
        if len(tied):  # there the volatilities follow from the other parameters: by central differences of these few numbers
            x, by_sigma, at = p[tied], out[tied, :, :MOST], [v[tied] for v in own]
            out[tied, :, :MOST] = 0.0
            for k in (1, MOST, MOST + 1):
                step = 1e-6 * np.maximum(np.abs(x[:, k]), 1e-2)
                up, down = x.copy(), x.copy()
                up[:, k], down[:, k] = x[:, k] + step, np.maximum(x[:, k] - step, 0.0) if k >= MOST else x[:, k] - step
                change = (_sigmas(up, *at) - _sigmas(down, *at)) / (up[:, k] - down[:, k])[:, None]
                out[tied, :, k] += np.einsum("nqi,ni->nq", by_sigma, change)
        return np.sqrt(q["weight"])[:, :, None] * out

    def part(self, rows: np.ndarray) -> Problem:
        return Problem(self.n[rows], self.rho[rows], self.rest[rows], {k: v[rows] for k, v in self.quotes.items()})

    def level(self, p: np.ndarray) -> np.ndarray:
        """Mean measured volatility over that of the parameters, by weight; 1 where there are no quotes."""
        w = self.quotes["weight"]
        found = model_vols(_sigmas(p, self.rest, self.n, self.rho), p[:, MOST:], self.rho, self.quotes)
        return (w * self.quotes["vol"]).sum(1) / np.where((w * found).sum(1) > 0, (w * found).sum(1), 1.0) + ~w.any(1)

    def fit(self, fixed: np.ndarray, alphas: tuple, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best parameters over all starts, sums of squares and turns. fixed: parameters that are given (NaN: to be fitted)."""
        tied = ~np.isnan(self.rest)[:, None]
        box = np.array([*SIGMAS, *alphas])
        start, low, high = (np.tile(box[:, k], (len(self.n), 1)) for k in range(3))
        for k, x in enumerate(LOG_RATIO):
            (start, low, high)[k][:, 1:2] = np.where(tied, x, (start, low, high)[k][:, 1:2])
        there = np.tile(np.arange(MOST) < self.n[:, None], 2)
        free = there & np.isnan(fixed)
        free[:, 0] &= ~tied[:, 0]
        free[:, 2] &= ~tied[:, 0]
        given = ~np.isnan(fixed)
        start, low, high = (np.where(given, fixed, x) for x in (start, low, high))
        starts = [start]
        for share in OTHER_STARTS:
            other = start.copy()
            a, b = np.maximum(low[:, MOST:], 1e-3), np.maximum(high[:, MOST:], 1e-3)
            other[:, MOST:] = np.where(free[:, MOST:], a * (b / a) ** np.array(share), start[:, MOST:])
            size = self.level(other)[:, None]  # volatilities of the right size
            other[:, :MOST] = np.where(free[:, :MOST] & ~tied, other[:, :MOST] * size, other[:, :MOST])
            starts.append(other)
        best, loss, took = bounded_least_squares(self.residuals, starts[0], low, high, free, turns, self.slopes)
        for x in starts[1:]:
            rows = np.flatnonzero(loss > NOTHING)  # no start can better a sum of nothing
            if not len(rows):
                break
            own = self.part(rows)
            p, less, more = bounded_least_squares(own.residuals, x[rows], low[rows], high[rows], free[rows], turns, own.slopes)
            better = less < loss[rows] * (1 - 1e-9)
            best[rows[better]], loss[rows[better]] = p[better], less[better]
            took[rows] += more
        return best, loss, took


def _batch(rows: list[dict], alphas: tuple, long_alpha: bool, joint: bool, turns: int) -> list[tuple]:
    """Fits of some underlyings: id, sigmas, alphas, loss, turns."""
    n = np.array([r["n"] for r in rows])
    width = max([1, *(len(r["quotes"]) for r in rows)])
    quotes = {k: np.zeros((len(rows), width)) for k in ("t", "t1", "d1", "t2", "d2", "vol", "weight", "ratio")}
    for i, r in enumerate(rows):
        for j, q in enumerate(r["quotes"]):
            for k in quotes:
                quotes[k][i, j] = q[k]
    rho = np.tile(np.eye(MOST), (len(rows), 1, 1))
    rest = np.array([np.nan if r["rest"] is None else r["rest"] for r in rows])
    fixed = np.full((len(rows), 2 * MOST), np.nan)
    for i, r in enumerate(rows):
        for (a, b), k in (((0, 1), "rho12"), ((0, 2), "rho13"), ((1, 2), "rho23")):
            rho[i, a, b] = rho[i, b, a] = r[k] or 0.0
        for first, k in ((0, "sigmas"), (MOST, "alphas")):
            given = (r[k] or [])[: r["n"]]
            fixed[i, first : first + len(given)] = given
        if not (long_alpha or r["alphas"] or r["rest"] is not None):
            fixed[i, MOST] = 0.0
    turns_of = np.zeros(len(rows), int)
    staged = np.zeros(len(rows), bool) if joint else n == 3
    if staged.any():  # the first two factors by themselves, then the third beside them
        two = Problem(np.where(staged, 2, n)[staged], rho[staged], rest[staged], {k: v[staged] for k, v in quotes.items()})
        found, _, turns_of[staged] = two.fit(np.where(np.tile(np.arange(MOST) < 2, 2), fixed[staged], np.nan), alphas, turns)
        for k in (0, 1, MOST, MOST + 1):
            fixed[staged, k] = found[:, k]
    whole = Problem(n, rho, rest, quotes)
    p, loss, more = whole.fit(fixed, alphas, turns)
    sigma = _sigmas(p, rest, n, rho)
    out = []
    for i, r in enumerate(rows):
        known = bool(r["quotes"]) or not np.isnan(fixed[i][np.tile(np.arange(MOST) < n[i], 2)]).any()
        out.append((r["lsu"], sigma[i, : n[i]].tolist() if known else None, p[i, MOST : MOST + n[i]].tolist() if known else None, float(loss[i]) if r["quotes"] else None, int(more[i] + turns_of[i])))
    return out


def fit_models(models: DataFrame, quotes: DataFrame, alphas: tuple = ALPHAS, long_alpha: bool = False, joint: bool = False, turns: int = 300) -> DataFrame:
    """(lsu, sigmas, alphas, loss, turns) of each model: the volatilities and speeds within the bounds whose squared errors, by weight, are least.

    models (lsu, n, rho12, rho13, rho23, sigmas, alphas, rest): one to three factors,
    their correlations (null: 0), given volatilities and speeds of the first factors
    (arrays, null: none), and the deviation at rest that the model must have (null: any;
    see prob_vol; one or two factors). quotes (lsu, t, t1, d1, t2, d2, vol, weight): the
    measured volatility until t (0: now) of the contract that delivers from t1 for d1
    years, or of its ratio to that of t2 and d2 where these aren't null; months far out
    may count double by their weight. Without long_alpha the first factor doesn't
    revert, unless its speed is given. Three factors are fitted as two and then the
    third, or all together if joint.

    The quotes of an underlying, a few dozen contracts, are brought together in its row;
    AT_ONCE underlyings are fitted at once in arrays. Quotes with a null in lsu, t1, d1 or
    vol don't count. A model without quotes has nulls, unless all is given; an
    underlying without a model has no row; n must be 1 to 3.
    """
    ratio = F.col("t2").isNotNull() & F.col("d2").isNotNull()
    none = F.lit(0.0)
    quote = F.struct(
        F.coalesce("t", none).cast("double").alias("t"), F.col("t1").cast("double").alias("t1"), F.col("d1").cast("double").alias("d1"),
        F.when(ratio, F.col("t2")).otherwise(none).cast("double").alias("t2"), F.when(ratio, F.col("d2")).otherwise(none).cast("double").alias("d2"),
        F.col("vol").cast("double").alias("vol"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"), ratio.cast("double").alias("ratio"),
    )
    # nulls are left out of the lists, not of the rows: as a filter of rows Spark would work out derived volatilities once more
    whole = lambda q: q["t1"].isNotNull() & q["d1"].isNotNull() & q["vol"].isNotNull()
    known = quotes.where("lsu is not null").groupBy("lsu").agg(F.array_sort(F.filter(F.collect_list(quote), whole)).alias("quotes"))
    rows = models.select("lsu", F.col("n").cast("int").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("rho12", "rho13", "rho23", "rest")], F.col("sigmas").cast("array<double>").alias("sigmas"), F.col("alphas").cast("array<double>").alias("alphas"))
    rows = rows.join(known, "lsu", "left").withColumn("quotes", F.coalesce("quotes", F.array().cast(known.schema["quotes"].dataType)))
    spark = models.sparkSession
    # a stated number of tasks: the rows are small, the fits aren't
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "lsu")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, AT_ONCE):
                found = list(zip(*_batch(b.slice(first, AT_ONCE).to_pylist(), alphas, long_alpha, joint, turns)))
                kinds = (b.column(0).type, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["lsu", "sigmas", "alphas", "loss", "turns"])

    return rows.mapInArrow(run, f"lsu {models.schema['lsu'].dataType.simpleString()}, sigmas array<double>, alphas array<double>, loss double, turns int")


def dependencies(underlyings: DataFrame, proxies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lsu, on): what must be calibrated before an underlying: its proxies, and the currency pair between them where their currencies differ."""
    own, other = underlyings.select("lsu", "currency"), underlyings.select(F.col("lsu").alias("proxy"), F.col("currency").alias("foreign"))
    edges = proxies.select("lsu", "proxy").distinct().join(own, "lsu").join(other, "proxy", "left")
    both = _both_ways(pairs)
    through = edges.where("currency <> foreign").join(both, ["currency", "foreign"]).select("lsu", F.col("pair").alias("on"))
    return edges.select("lsu", F.col("proxy").alias("on")).unionByName(through).distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(currency, foreign, pair, sign): each currency pair, and turned round where the turned one isn't there itself."""
    straight = pairs.select("currency", "foreign", F.col("lsu").alias("pair"), F.lit(1.0).alias("sign"))
    turned = pairs.select(F.col("foreign").alias("currency"), F.col("currency").alias("foreign"), F.col("lsu").alias("pair"), F.lit(-1.0).alias("sign"))
    return straight.unionByName(turned.join(straight.select("currency", "foreign"), ["currency", "foreign"], "left_anti"))


def dependency_levels(names: DataFrame, edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The underlyings (lsu) that need nothing, those that need only these, and so on, each a staged table; and those that are left: they need themselves, or one that does.

    One pass over tables for each level; the driver only counts the rows of a level.
    Needs that aren't in names hold nothing up.
    """
    todo, found = stage(names.select("lsu").distinct(), "level-todo"), []
    edges = stage(edges, "level-edges")
    while True:
        waiting = edges.join(todo.select(F.col("lsu").alias("on")), "on", "left_semi").select("lsu").distinct()
        ready = stage(todo.join(waiting, "lsu", "left_anti"), "level")
        if not ready.take(1):
            return found, todo
        found.append(ready)
        todo = stage(todo.join(ready, "lsu", "left_anti"), "level-todo")


@dataclass(frozen=True)
class Calibration:
    """fits (lsu, factor, sigma, alpha, place, loss): the factors of each underlying, place naming the factor (lsu:factor) that it is or shares; problems (lsu, problem); model."""

    fits: DataFrame
    problems: DataFrame
    model: Factors


def _given(level: DataFrame, proxies: DataFrame, currency: DataFrame, done: DataFrame, pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """(lsu, factor, sigma, alpha, place, missing) of the proxied factors of a level.

    A proxy of the same currency is shared: place is its factor. One of another
    currency lends its speed, and its volatility with that of the currency pair.
    """
    own = proxies.join(level, "lsu", "left_semi").join(currency, "lsu")
    lent = done.select(F.col("lsu").alias("proxy"), "factor", F.col("sigma").alias("_s"), "alpha", F.col("place").alias("_place"))
    own = own.join(currency.select(F.col("lsu").alias("proxy"), F.col("currency").alias("foreign")), "proxy", "left").join(lent, ["proxy", "factor"], "left")
    rates = _both_ways(pairs).join(done.where("factor = 1").select(F.col("lsu").alias("pair"), F.col("sigma").alias("_fx")), "pair").withColumn("_fx_name", F.concat("pair", F.lit(":1")))
    own = own.join(rates, ["currency", "foreign"], "left")
    corr = measured.select("a", "b", "corr").unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).groupBy("a", "b").agg(F.max("corr").alias("corr"))
    own = own.withColumn("_name", F.concat_ws(":", "proxy", "factor")).join(corr.withColumnsRenamed({"a": "_fx_name", "b": "_name"}), ["_fx_name", "_name"], "left")
    same = F.col("currency").eqNullSafe(F.col("foreign"))
    s, x = F.col("_s"), F.col("_fx")
    variance = s * s + x * x + 2 * F.col("sign") * s * x * F.coalesce("corr", F.lit(0.0))
    sigma = F.when(same, s).otherwise(F.sqrt(F.greatest(variance, F.lit(LEAST_VARIANCE))))
    missing = F.when(s.isNull(), "no proxy").when(~same & (F.col("factor") > 1), "another currency beyond the first factor").when(~same & x.isNull(), "no currency pair")
    return own.select("lsu", "factor", sigma.alias("sigma"), "alpha", F.when(same, F.col("_place")).otherwise(F.concat_ws(":", "lsu", "factor")).alias("place"), missing.alias("missing"))


def calibrate(underlyings: DataFrame, quotes: DataFrame, proxies: DataFrame, pairs: DataFrame, measured: DataFrame, given_rho: DataFrame | None = None, alphas: tuple = ALPHAS, long_alpha: bool = False, joint: bool = False) -> Calibration:
    """Calibrate all underlyings, those that others stand on first.

    underlyings (lsu, currency, n, sigmas, alphas, rest): sigmas and alphas are arrays of
    given values of the factors behind the proxied ones (both: fixed factors; alphas
    alone: given from the first factor on, where no proxy gives them). proxies (lsu,
    factor, proxy): factors, from 1 on without gaps, taken over from another underlying.
    pairs (lsu, currency, foreign): which underlyings are currency pairs. measured (a, b,
    corr) and given_rho: correlations of factors named lsu:factor; given_rho holds, or 0,
    where either underlying has fixed factors. quotes: see fit_models.

    One staged pass a level; all underlyings of a level are fitted together. Underlyings
    on a cycle, or behind one, and those whose proxy can't be had are in `problems` and
    have no fit; neither do those that stand on them.
    """
    rows = underlyings.withColumn("fixed", F.coalesce(F.size("sigmas") > 0, F.lit(False)))
    currency = rows.select("lsu", "currency")
    levels, left = dependency_levels(rows, dependencies(underlyings, proxies, pairs))
    kind = underlyings.schema["lsu"].dataType.simpleString()
    spark = underlyings.sparkSession
    done = spark.createDataFrame([], f"lsu {kind}, factor int, sigma double, alpha double, place string, loss double")
    problems = left.select("lsu", F.lit("cycle").alias("problem"))
    corr = measured.select("a", "b", "corr")
    for level in levels:
        taken = _given(level, proxies.withColumn("factor", F.col("factor").cast("int")), currency, done, pairs, corr)
        lists = taken.groupBy("lsu").agg(F.array_sort(F.collect_list(F.struct("factor", "sigma", "alpha", "place"))).alias("_p"), F.max("missing").alias("_missing"))
        own = rows.join(level, "lsu", "left_semi").join(lists, "lsu", "left")
        p = F.coalesce("_p", F.array().cast("array<struct<factor:int,sigma:double,alpha:double,place:string>>"))
        more = F.coalesce("alphas", F.array().cast("array<double>"))
        n_taken = F.size(p)
        own = own.withColumns({
            "_sigmas": F.concat(F.transform(p, lambda x: x["sigma"]), F.coalesce("sigmas", F.array().cast("array<double>"))),
            "_alphas": F.when(F.col("fixed"), F.concat(F.transform(p, lambda x: x["alpha"]), more)).otherwise(F.concat(F.transform(p, lambda x: x["alpha"]), F.slice(more, n_taken + 1, F.greatest(F.size(more), F.lit(1))))),
            "_places": F.transform(p, lambda x: x["place"]),
        })
        own = stage(own, "level-models")
        problems = problems.unionByName(own.where("_missing is not null").select("lsu", F.col("_missing").alias("problem")))
        name = lambda k: F.concat(F.col("lsu"), F.lit(f":{k}"))
        whole = own.where("_missing is null").select("lsu", "n", F.col("_sigmas").alias("sigmas"), F.col("_alphas").alias("alphas"), "rest", "_places")
        both = corr.unionByName(corr.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).groupBy("a", "b").agg(F.max("corr").alias("corr"))
        for a, b in ((1, 2), (1, 3), (2, 3)):
            whole = whole.withColumns({"_a": name(a), "_b": name(b)}).join(both.withColumnsRenamed({"a": "_a", "b": "_b", "corr": f"rho{a}{b}"}), ["_a", "_b"], "left").drop("_a", "_b")
        fit = fit_models(whole, quotes, alphas, long_alpha, joint).join(whole.select("lsu", "_places"), "lsu")
        each = fit.where("sigmas is not null").select("lsu", "loss", "_places", F.posexplode(F.arrays_zip("sigmas", "alphas")).alias("k", "x"))
        factor = (F.col("k") + 1).alias("factor")
        place = F.coalesce(F.get("_places", F.col("k")), F.concat("lsu", F.lit(":"), (F.col("k") + 1).cast("string")))
        fitted = stage(each.select("lsu", factor, "x.sigmas", "x.alphas", place.alias("place"), "loss").withColumnsRenamed({"sigmas": "sigma", "alphas": "alpha"}), "level-fits")
        problems = problems.unionByName(whole.select("lsu").join(fitted.select("lsu"), "lsu", "left_anti").select("lsu", F.lit("no quotes").alias("problem")))
        done = done.unionByName(fitted)
    return Calibration(done, problems, _model(done, rows, corr, given_rho))


def _model(fits: DataFrame, rows: DataFrame, measured: DataFrame, given_rho: DataFrame | None) -> Factors:
    """The model of all fits: a factor for each place, shared by all underlyings at it, and the correlations of factors."""
    own = fits.where(F.col("place") == F.concat_ws(":", "lsu", "factor"))
    factors = own.select(F.col("place").alias("idx"), "sigma", "alpha")
    bridge = fits.select(F.col("place").alias("idx"), "lsu", "factor")
    fixed = own.join(rows.where("fixed").select("lsu"), "lsu", "left_semi").select(F.col("place").alias("_f"))
    both = lambda x: x.select("a", "b", "corr").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).groupBy("a", "b").agg(F.max("corr").alias("corr"))
    touched = lambda x, how: x.join(fixed.withColumnRenamed("_f", "a"), "a", how)
    turned = lambda x: x.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    cells = touched(turned(touched(both(measured), "left_anti")), "left_anti").select("a", "b", "corr")
    if given_rho is not None:
        named = both(given_rho)
        one = touched(named, "left_semi").select("a", "b", "corr")
        cells = cells.unionByName(one.unionByName(turned(one)).distinct())
    known = own.select(F.col("place").alias("a"))
    cells = cells.where("a <> b").join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi")
    rho = cells.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("corr").alias("rho")).unionByName(own.select(F.col("place").alias("i"), F.col("place").alias("j"), F.lit(1.0).alias("rho")))
    return Factors(factors, bridge, rho)
