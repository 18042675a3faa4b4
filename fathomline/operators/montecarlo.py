"""Monte Carlo on path tables whose draws depend on the path number alone.

Draws come from a keyed hash of (seed, path, dimension), or from a Weyl sequence
that any engine can repeat. Either way results don't depend on partitioning, every
lost task can be run again, and scenarios share their draws. What is simulated are
rows of a table: each is dealt out in blocks of paths, and gets the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.normal import norm_cdf, norm_ppf

#: Steps of the Weyl sequence in each dimension: fractional parts of square roots of primes.
WEYL = tuple(p**0.5 % 1 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37))

#: Paths of a row that one task works on at a time.
BLOCK = 10_000


def uniform(path: Column, dimension: int, seed: int | None = None) -> Column:
    """A number in (0, 1) for a path and dimension: Weyl without a seed, hashed with one."""
    if seed is None:
        x = (path + 0.5) * F.lit(WEYL[dimension])
        return x - F.floor(x)
    return (F.pmod(F.xxhash64(F.lit(seed), path, F.lit(dimension)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def paths(spark: SparkSession, n: int, dimensions: int, seed: int | None = None, antithetic: bool = False) -> DataFrame:
    """(path, z0, z1, …): n rows of independent normals; with antithetic every second path mirrors the one before it (an odd n drops the last mirror)."""
    base = spark.range(n).withColumnRenamed("id", "path")
    own = F.floor(F.col("path") / 2) if antithetic else F.col("path")
    sign = F.when(antithetic & (F.col("path") % 2 == 1), -1.0).otherwise(1.0) if antithetic else F.lit(1.0)
    u = base.withColumns({f"_u{k}": uniform(own, k, seed) for k in range(dimensions)})
    return u.select("path", *[(sign * norm_ppf(F.col(f"_u{k}"))).alias(f"z{k}") for k in range(dimensions)])


def path_blocks(rows: DataFrame, n: int) -> DataFrame:
    """rows once for each block of n paths: columns _first and _n, the first path and the paths of the block; dealt out evenly. A row of no paths has none."""
    firsts = F.sequence(*[F.lit(x).cast("long") for x in (0, max(n - 1, 0) // BLOCK * BLOCK, BLOCK)])
    blocks = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_first", F.explode(firsts))
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a stated number: small as the blocks are, they aren't to be put together again
    blocks = blocks.withColumn("_n", F.least(F.lit(n) - F.col("_first"), F.lit(BLOCK)).cast("long")).where("_n > 0")
    return blocks.repartition(parts, "_row", "_first").drop("_row")


def deal_paths(deals: DataFrame, n: int, dimensions: int, seed: int | None = None, antithetic: bool = False) -> DataFrame:
    """deals with a row for each of n paths: path, u0, u1, … (uniform) and z0, z1, … (normal); see paths()."""
    rows = path_blocks(deals, n).withColumn("path", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))).drop("_first", "_n")
    own = F.floor(F.col("path") / 2) if antithetic else F.col("path")
    sign = F.when(F.col("path") % 2 == 1, -1.0).otherwise(1.0) if antithetic else F.lit(1.0)
    rows = rows.withColumns({f"u{k}": uniform(own, k, seed) for k in range(dimensions)})
    return rows.withColumns({f"z{k}": sign * norm_ppf(F.col(f"u{k}")) for k in range(dimensions)})


def correlated_three(rows: DataFrame, r01: Column, r02: Column, r12: Column) -> DataFrame:
    """Normals w0 to w2 whose correlations are columns of the rows; z0 to z2 are independent."""
    c = F.col
    rows = rows.withColumns({"_a": r01, "_b": r02}).withColumn("_c", (r12 - c("_a") * c("_b")) / F.sqrt(1 - c("_a") ** 2))
    rest = F.sqrt(1 - c("_b") ** 2 - c("_c") ** 2)
    return rows.withColumns({"w0": c("z0"), "w1": c("_a") * c("z0") + F.sqrt(1 - c("_a") ** 2) * c("z1"), "w2": c("_b") * c("z0") + c("_c") * c("z1") + rest * c("z2")}).drop("_a", "_b", "_c")


def correlated(rows: DataFrame, rho: list[list[float]], z: str = "z", out: str = "w") -> DataFrame:
    """Normals with a correlation matrix, by its Cholesky factor."""
    low = np.linalg.cholesky(np.array(rho, float))
    return rows.withColumns({f"{out}{i}": sum((F.lit(float(low[i, k])) * F.col(f"{z}{k}") for k in range(i + 1)), F.lit(0.0)) for i in range(len(rho))})


def terminal(forward: Column, vol: Column, t: Column, w: Column) -> Column:
    """A lognormal martingale at t."""
    return forward * F.exp(vol * F.sqrt(t) * w - vol * vol * t / 2)


def statistics(payoff: Column, population: bool = False) -> list[Column]:
    """Mean, its standard error (by the deviation of the sample, or of the population) and the number of paths."""
    deviation = (F.stddev_pop if population else F.stddev_samp)(payoff)
    return [F.avg(payoff).alias("value"), (deviation / F.sqrt(F.count(payoff))).alias("error"), F.count(payoff).alias("paths")]


def step_times(days: int, near: int = 60, far_step: int = 7) -> list[float]:
    """Years at which a simulation of so many days stops: every far_step days while more than `near` are left, then daily."""
    at, out = 0, []
    while at < days:
        at = min(at + far_step, days - near) if days - at > near else at + 1
        out.append(at / 365)
    return out


def with_bounds(deals: DataFrame, *names: str) -> DataFrame:
    """deals with the probabilities _x_low and _x_high of the ends x_low and x_high of each bounded normal x (x_mean, x_sd), worked out once a deal."""
    c = F.col
    return deals.withColumns({f"_{x}_{e}": norm_cdf((c(f"{x}_{e}") - c(f"{x}_mean")) / c(f"{x}_sd")) for x in names for e in ("low", "high")})


def with_truncated(rows: DataFrame, draws: dict[str, str]) -> DataFrame:
    """rows (see with_bounds) with a column for each bounded normal, drawn from the uniform column that it is given. Probabilities and normals are columns of projections of their own, so that each is worked out once."""
    c = F.col
    rows = rows.withColumns({f"_{x}_p": c(f"_{x}_low") + c(u) * (c(f"_{x}_high") - c(f"_{x}_low")) for x, u in draws.items()})
    rows = rows.withColumns({f"_{x}_z": norm_ppf(c(f"_{x}_p")) for x in draws})
    return rows.withColumns({x: c(f"{x}_mean") + c(f"{x}_sd") * c(f"_{x}_z") for x in draws}).drop(*[f"_{x}_{e}" for x in draws for e in "pz"])


def jump(u: Column, z: Column, probability: float, mean: float, sd: float) -> Column:
    """A normal jump that happens with a probability, 0 otherwise."""
    return F.when(u < probability, mean + sd * z).otherwise(0.0)


def spread_option(deals: DataFrame, by: list[str], rho: list[list[float]], n: int, seed: int | None = None, antithetic: bool = False, weights: list[float] | None = None, population: bool = False) -> DataFrame:
    """Value, error and paths of each deal: the right to a weighted sum of forwards (first minus the others by default) above a strike.

    deals: by, forwards f0, f1, …, volatilities v0, v1, …, strike, t, r; as many legs as
    rho has rows. A null in a deal gives it a null value.
    """
    weights = weights or [1.0, *[-1.0] * (len(rho) - 1)]
    rows = correlated(deal_paths(deals, n, len(rho), seed, antithetic), rho)
    ends = [terminal(F.col(f"f{i}"), F.col(f"v{i}"), F.col("t"), F.col(f"w{i}")) for i in range(len(rho))]
    total = sum((F.lit(w) * e for w, e in zip(weights, ends)), F.lit(0.0)) - F.col("strike")
    payoff = F.exp(-F.col("r") * F.col("t")) * F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))
    return rows.groupBy(*by).agg(*statistics(payoff, population))


def cargo_option(deals: DataFrame, by: list[str], rho: list[list[float]], jumps: list[tuple[float, float, float]], n: int, seed: int | None = None) -> DataFrame:
    """Cargoes that are delivered where they earn most: delivered price of what is left after boil-off, less a sloped index on what was loaded, freight and costs.

    deals: by, f0 to f2 and v0 to v2 (price, index, freight a day), r, t, days, boil_off
    (a day), start_mmbtu, slope, costs. jumps: (probability, mean, deviation) added to
    the price. Returns option value, intrinsic value, extrinsic value, forward margin
    and error of each.
    """
    c = F.col
    rows = correlated(deal_paths(deals, n, 3 + 2 * len(jumps), seed, antithetic=True), rho)
    ends = [terminal(c(f"f{i}"), c(f"v{i}"), c("t"), c(f"w{i}")) for i in range(3)]
    for j, (p, mean, sd) in enumerate(jumps):
        ends[0] = ends[0] + jump(norm_cdf(c(f"z{3 + 2 * j}")), c(f"z{4 + 2 * j}"), p, mean, sd)
    left = c("start_mmbtu") * (1 - c("days") * c("boil_off"))

    def margin(delivered: Column, index: Column, freight: Column) -> Column:
        return delivered * left - c("slope") * index * c("start_mmbtu") - freight * c("days") - c("costs")

    kept = F.exp(-c("r") * c("t"))
    plain = F.greatest(margin(c("f0"), c("f1"), c("f2")), F.lit(0.0)) * kept
    rows = rows.select(*by, margin(*ends).alias("_paid"), kept.alias("_kept"), plain.alias("_plain"))
    worth = F.greatest(c("_paid"), F.lit(0.0)) * c("_kept")
    out = rows.groupBy(*by).agg(F.avg(worth).alias("value"), (F.stddev_samp(worth) / F.sqrt(F.count("*"))).alias("error"), F.avg("_paid").alias("forward"), F.max("_plain").alias("intrinsic"))
    return out.select(*by, "value", "intrinsic", (c("value") - c("intrinsic")).alias("extrinsic"), "forward", "error")


def cancellation_option(deals: DataFrame, by: list[str], n: int, seed: int | None = 1) -> DataFrame:
    """Rights to cancel a cargo: sale price less freight on what is left, against what was paid.

    deals: by, bought, boil_off, days, net, and for each x of price and freight a bounded
    normal with jumps: x_low, x_high, x_mean, x_sd, x_chance, x_jump, x_jump_sd. Values are
    for a unit bought.
    """
    c, places = F.col, {"price": 0, "freight": 3}
    rows = path_blocks(with_bounds(deals, *places), n).withColumn("path", F.explode(F.sequence(c("_first"), c("_first") + c("_n") - 1)))
    rows = rows.withColumns({f"_u{k}": uniform(c("path"), k, seed) for k in range(6)})
    rows = with_truncated(rows, {x: f"_u{k}" for x, k in places.items()})
    # a jump's normal is only worked out where the jump happens
    jumps = {f"_{x}_jump": F.when(c(f"_u{k + 1}") < c(f"{x}_chance"), c(f"{x}_jump") + c(f"{x}_jump_sd") * norm_ppf(c(f"_u{k + 2}"))).otherwise(0.0) for x, k in places.items()}
    rows = rows.withColumns(jumps)
    price, freight = (c(x) + c(f"_{x}_jump") for x in places)
    left = 1 - c("days") * c("boil_off")
    margin = lambda price, freight: (price + c("net")) * left - freight * c("days") / 1e6 - c("bought")
    rows = rows.select(*by, margin(price, freight).alias("_x"), F.greatest(margin(c("price_mean"), c("freight_mean")), F.lit(0.0)).alias("_plain"))
    return rows.groupBy(*by).agg(*statistics(F.greatest("_x", F.lit(0.0))), F.avg("_x").alias("forward"), F.max("_plain").alias("intrinsic"))


def scenarios(deals: DataFrame, shifts: dict[str, dict[str, str]], legs: int = 3) -> DataFrame:
    """deals (…, f0…, v0…, t, r) in every scenario: a column scenario, 'base' or the name of additions to columns, given as SQL expressions of the deal. Volatilities stay above 0.01, times above a millionth."""
    names = [*(f"f{i}" for i in range(legs)), *(f"v{i}" for i in range(legs)), "t", "r"]
    least = {"v": 0.01, "t": 1e-6}

    def moved(c: str, add: dict[str, str]) -> Column:
        x = F.col(c) + F.expr(add[c]).cast("double") if c in add else F.col(c)
        return (F.greatest(x, F.lit(least[c[0]])) if c[0] in least else x).alias(c)

    each = F.array(*[F.struct(F.lit(name).alias("scenario"), *[moved(c, add) for c in names]) for name, add in {"base": {}, **shifts}.items()])
    others = [c for c in deals.columns if c not in names]
    return deals.select(*others, F.explode(each).alias("_s")).select(*others, "_s.*")


def least_values(rows: DataFrame, by: list[str], legs: int = 3) -> DataFrame:
    """Value, error and paths of the least of the legs, for each group; rows hold f0…, v0…, t, r and correlated normals w0…. Only a row for each group and task is shuffled."""
    least = F.least(*[terminal(F.col(f"f{i}"), F.col(f"v{i}"), F.col("t"), F.col(f"w{i}")) for i in range(legs)])
    return rows.groupBy(*by).agg(*statistics(F.exp(-F.col("r") * F.col("t")) * least))


def scenario_values(draws: DataFrame, scenarios: list[tuple], legs: int = 3) -> DataFrame:
    """Value of the least of the legs in each scenario, on common draws.

    scenarios: rows (scenario, f0…, v0…, t, r), as of shifted(); draws hold correlated
    normals w0…. Every draw is put into every scenario and summed up in the same task.
    """
    names = ["scenario", *(f"f{i}" for i in range(legs)), *(f"v{i}" for i in range(legs)), "t", "r"]
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, row)]) for row in scenarios])).alias("_s")
    return least_values(draws.select(*[f"w{i}" for i in range(legs)], each).select("*", "_s.*"), ["scenario"], legs)


def shifted(base: dict, shifts: dict[str, dict[str, float]]) -> list[tuple]:
    """Rows (scenario, f0, f1, f2, v0, v1, v2, t, r) of a base case and named additions to its figures; volatilities stay above 0.01."""
    names = ("f0", "f1", "f2", "v0", "v1", "v2", "t", "r")
    out = []
    for scenario, add in {"base": {}, **shifts}.items():
        x = {k: base[k] + add.get(k, 0.0) for k in names}
        out.append((scenario, *[max(0.01, x[k]) if k[0] == "v" else max(1e-6, x[k]) if k == "t" else x[k] for k in names]))
    return out


def finite_greeks(deals: DataFrame, by: list[str], rho: list[list[float]], n: int, bump_f: float = 0.01, bump_v: float = 0.001, bump_t: float = 1 / 365, seed: int | None = 42) -> DataFrame:
    """(by, greek, value) of the least-of-three by central differences on common draws; theta is the change of value a day later. deals: by, f0…, v0…, t, r."""
    shifts = {f"{k}{s}": {k: f"{s}CAST('{d!r}' AS DOUBLE)"} for k, d in [*((f"f{i}", bump_f) for i in range(3)), *((f"v{i}", bump_v) for i in range(3))] for s in "+-"}
    shifts["t-"] = {"t": f"-CAST('{bump_t!r}' AS DOUBLE)"}
    rows = scenarios(correlated(deal_paths(deals, n, 3, seed, True), rho).select(*deals.columns, "w0", "w1", "w2"), shifts)
    values = least_values(rows, [*by, "scenario"])
    name = F.regexp_replace("scenario", "[+-]$", "")
    size = F.when(name.startswith("f"), 2 * bump_f).otherwise(2 * bump_v)
    signed = F.when(F.col("scenario").endswith("+"), F.col("value")).otherwise(-F.col("value"))
    sides = values.withColumn("greek", F.when(F.col("scenario").isin("base", "t-"), "theta").otherwise(name))
    part = F.when(F.col("scenario") == "t-", F.col("value")).when(F.col("scenario") == "base", -F.col("value")).otherwise(signed / size)
    return sides.groupBy(*by, "greek").agg(F.sum(part).alias("value"))


def path_greeks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Deltas and vegas of the least-of-three of each group by the derivative along each path; rows hold f0…, v0…, t, r and w0…."""
    c, t, r = F.col, F.col("t"), F.col("r")
    rows = rows.withColumns({f"e{i}": terminal(c(f"f{i}"), c(f"v{i}"), t, c(f"w{i}")) for i in range(3)}).withColumn("_min", F.least("e0", "e1", "e2"))
    out = []
    for i in range(3):
        own = F.when(c(f"e{i}") == c("_min"), c(f"e{i}")).otherwise(0.0)
        out.append(F.avg(F.exp(-r * t) * own / c(f"f{i}")).alias(f"delta{i}"))
        out.append(F.avg(F.exp(-r * t) * own * (F.sqrt(t) * c(f"w{i}") - c(f"v{i}") * t)).alias(f"vega{i}"))
    return rows.groupBy(*by).agg(*out)


def implied_least_vol(draws: DataFrame, base: dict, price: float, low: float = 0.01, high: float = 2.0, steps: int = 5, grid: int = 9) -> float | None:
    """One volatility for all legs that gives the least-of-three this value: the bracket is cut by a grid of scenarios in each pass; None without a bracket."""
    for _ in range(steps):
        vols = np.linspace(low, high, grid)
        rows = [(f"{k:03d}", base["f0"], base["f1"], base["f2"], float(v), float(v), float(v), base["t"], base["r"]) for k, v in enumerate(vols)]
        values = [x.value - price for x in scenario_values(draws, rows).orderBy("scenario").collect()]  # grid rows
        turn = [k for k in range(grid - 1) if values[k] * values[k + 1] <= 0]
        if not turn:
            return None
        low, high = vols[turn[0]], vols[turn[0] + 1]
    return float((low + high) / 2)


def _draws(path: np.ndarray, step: int, factor: int, seed: int) -> np.ndarray:
    """Normals of many paths at a step, from a hash of their numbers (splitmix64 and the Box-Muller form)."""
    from fathomline.functions.hashing import mix64

    with np.errstate(over="ignore"):
        key = mix64(path.astype(np.uint64) + np.uint64(seed * 1_000_003 + step * 7919 + factor + 1) * np.uint64(0x9E3779B97F4A7C15))
        a, b = (key >> np.uint64(11)).astype(float) / 2**53, (mix64(key) >> np.uint64(11)).astype(float) / 2**53
    return np.sqrt(-2 * np.log(1 - a)) * np.cos(2 * np.pi * b)


def simulate_curve(models: DataFrame, by: str, n: int, seed: int = 1, normal: bool = False) -> DataFrame:
    """(by, path, step, tenor, price) of each curve: forwards that start at `starts` years, simulated over `times` by mean-reverting factors.

    models: by, arrays forwards, starts, times, sigmas and alphas, low and high (bounds,
    null: none), drift (a year). Blocks of paths are simulated with numpy in each task. A
    tenor that has begun keeps its price. Bounds clip prices but not the state behind
    them; normal moves are absolute, others relative.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f0, begin = np.array(row["forwards"], float), np.array(row["starts"], float)
                low, high = (x if row[k] is None else row[k] for k, x in (("low", -np.inf), ("high", np.inf)))
                for first in range(row["_first"], row["_first"] + row["_n"], 512):
                    path = np.arange(first, min(first + 512, row["_first"] + row["_n"]))
                    state, before = np.repeat(f0[None, :], len(path), 0), 0.0
                    for step, t in enumerate(row["times"]):
                        dt = t - before
                        loads = [s * np.exp(-a * np.maximum(begin - before, 0)) for s, a in zip(row["sigmas"], row["alphas"])]
                        move = np.full((len(path), len(f0)), (row["drift"] or 0.0) * dt)
                        for k, load in enumerate(loads):
                            move += load[None, :] * np.sqrt(dt) * _draws(path, step, k, seed)[:, None]
                        after = state + move if normal else state * np.exp(move - 0.5 * dt * sum(load**2 for load in loads)[None, :])
                        state = np.where((begin > before)[None, :], after, state)
                        before = t
                        price = np.clip(state, low, high)
                        columns = (np.repeat(path, len(f0)), np.full(price.size, step, np.int32), np.tile(np.arange(len(f0), dtype=np.int32), len(path)), price.reshape(-1))
                        yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * price.size, b.column(0).type), *map(pa.array, columns)], ["id", "path", "step", "tenor", "price"])

    rows = path_blocks(models.select(F.col(by).alias("id"), *[c for c in models.columns if c != by]), n)
    return rows.mapInArrow(run, f"id {models.schema[by].dataType.simpleString()}, path long, step int, tenor int, price double").withColumnRenamed("id", by)


def simulate_factors(models: DataFrame, by: str, times: list[float], n: int, seed: int = 1) -> DataFrame:
    """(by, path, step, factor, state): the mean-reverting factors of each model stepped exactly, mirrored paths in turn.

    models: by, arrays sigmas and alphas, rho (array of arrays).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s, a, r = np.array(row["sigmas"], float), np.array(row["alphas"], float), np.array(row["rho"], float)
                total = a[:, None] + a[None, :]
                for first in range(row["_first"], row["_first"] + row["_n"], 2048):
                    path = np.arange(first, min(first + 2048, row["_first"] + row["_n"]))
                    sign = np.where(path % 2 == 1, -1.0, 1.0)
                    x, before = np.zeros((len(path), len(s))), 0.0
                    for step, t in enumerate(times):
                        dt = t - before
                        low = np.linalg.cholesky(r * np.where(total < 1e-12, dt, -np.expm1(-total * dt) / np.where(total < 1e-12, 1, total)) + 1e-15 * np.eye(len(s)))
                        z = np.stack([sign * _draws(path // 2, step, k, seed) for k in range(len(s))], 1)
                        x = x * np.exp(-a * dt) + (z @ low.T) * s
                        before = t
                        columns = (np.repeat(path, len(s)), np.full(x.size, step, np.int32), np.tile(np.arange(len(s), dtype=np.int32), len(path)), x.reshape(-1))
                        yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * x.size, b.column(0).type), *map(pa.array, columns)], ["id", "path", "step", "factor", "state"])

    rows = path_blocks(models.select(F.col(by).alias("id"), "sigmas", "alphas", "rho"), n)
    return rows.mapInArrow(run, f"id {models.schema[by].dataType.simpleString()}, path long, step int, factor int, state double").withColumnRenamed("id", by)


def local_vol_spread(deals: DataFrame, by: str, grid1: tuple, grid2: tuple, steps: int | list[float], n: int, seed: int = 1, cap: float = 0.5) -> DataFrame:
    """Value, error and paths of each spread option when volatilities depend on price and time.

    deals: by, f1, f2, rho, strike, t, r. grids: (times, prices, vols) of a bounded table,
    looked up bilinearly with flat ends; a volatility that can't be found is the cap.
    steps: equal ones, or the years at which they end (see step_times()), the last of
    them t.
    """
    def look_up(grid, time, price):
        times, prices, vols = (np.asarray(x, float) for x in grid)
        i = np.clip(np.searchsorted(times, time) - 1, 0, len(times) - 2)
        u = np.clip((time - times[i]) / (times[i + 1] - times[i]), 0, 1)
        row = (1 - u) * vols[i] + u * vols[i + 1]
        return np.nan_to_num(np.interp(price, prices, row), nan=cap).clip(0, cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ends = [row["t"] * (k + 1) / steps for k in range(steps)] if isinstance(steps, int) else steps
                path = np.arange(row["_first"], row["_first"] + row["_n"])
                x, y, before = np.full(len(path), row["f1"], float), np.full(len(path), row["f2"], float), 0.0
                for k, end in enumerate(ends):
                    dt = end - before
                    z1, z2 = _draws(path, k, 0, seed), _draws(path, k, 1, seed)
                    z2 = row["rho"] * z1 + np.sqrt(1 - row["rho"] ** 2) * z2
                    v1, v2 = look_up(grid1, before, x), look_up(grid2, before, y)
                    before = end
                    x, y = x * np.exp(v1 * np.sqrt(dt) * z1 - v1 * v1 * dt / 2), y * np.exp(v2 * np.sqrt(dt) * z2 - v2 * v2 * dt / 2)
                payoff = np.exp(-row["r"] * row["t"]) * np.maximum(x - y - row["strike"], 0)
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * len(path), b.column(0).type), pa.array(payoff)], ["id", "payoff"])

    rows = path_blocks(deals.select(F.col(by).alias("id"), "f1", "f2", "rho", "strike", "t", "r"), n)
    found = rows.mapInArrow(run, f"id {deals.schema[by].dataType.simpleString()}, payoff double").groupBy("id").agg(*statistics(F.col("payoff")))
    return found.withColumnRenamed("id", by)


def fit_decay(history: DataFrame, by: list[str], tenor: str, vol: str, alphas: tuple[float, float] = (0.5, 2.0), level: tuple[float, float] = (0.0, 10.0), height: tuple[float, float] = (0.0, 10.0), grid: int = 151) -> DataFrame:
    """(by, mu, sigma, alpha, sse): best fit of vol = mu + sigma exp(-alpha (15 + 30 tenor) / 365) within bounds.

    For each alpha of an even grid between its bounds the least squares in mu and
    sigma, a convex problem in a box, are solved in closed form from sums: inside, or
    else on the best of the four edges.
    """
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: alphas[0] + (alphas[1] - alphas[0]) * i / (grid - 1))).alias("alpha")
    rows = history.select(*by, F.col(tenor).alias("_t"), F.col(vol).alias("_y")).where("_y is not null").select("*", each)
    rows = rows.withColumn("_x", F.exp(-F.col("alpha") * (15 + 30 * F.col("_t")) / 365))
    x, y, c = F.col("_x"), F.col("_y"), F.col
    sums = rows.groupBy(*by, "alpha").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))

    def at(mu, sigma):
        sse = c("yy") + c("n") * mu * mu + sigma * sigma * c("xx") - 2 * mu * c("y") - 2 * sigma * c("xy") + 2 * mu * sigma * c("x")
        return F.struct(F.greatest(sse, F.lit(0.0)).alias("sse"), mu.alias("mu"), sigma.alias("sigma"))

    def kept(v, ends):
        return F.greatest(F.lit(ends[0]), F.least(F.lit(ends[1]), v))

    det = c("n") * c("xx") - c("x") * c("x")
    sigma = F.try_divide(c("n") * c("xy") - c("x") * c("y"), det)
    mu = (c("y") - sigma * c("x")) / c("n")
    inside = mu.between(*level) & sigma.between(*height)
    edges = [at(F.lit(m), kept((c("xy") - m * c("x")) / c("xx"), height)) for m in level] + [at(kept((c("y") - s * c("x")) / c("n"), level), F.lit(s)) for s in height]
    best = F.when(F.coalesce(inside, F.lit(False)), at(mu, sigma)).otherwise(F.array_min(F.array(*edges)))
    out = sums.withColumn("_b", best).groupBy(*by).agg(F.min_by(F.struct("_b", "alpha"), F.struct(F.round("_b.sse", 9), "alpha")).alias("_b"))
    return out.select(*by, "_b._b.mu", "_b._b.sigma", "_b.alpha", "_b._b.sse")
