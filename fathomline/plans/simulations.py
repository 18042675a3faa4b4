"""Queries on Monte Carlo values, simulated curves and nested documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathomline.operators import montecarlo as mc, sketches as sk
from fathomline.plans.pricing import cdf, ppf
from fathomline.plans.registry import dated, query
from fathomline.sources import files
from fathomline.sources.files import table

RHO3 = [[1.0, 0.5, 0.3], [0.5, 1.0, 0.4], [0.3, 0.4, 1.0]]
#: Paths of spreads and baskets, of the least of three, of its scenarios, and of cancellations.
N, N_LEAST, N_SCENARIO, N_CANCEL = 100_000, 200_000, 50_000, 1_000_000


def _weyl(n: int, dims: int, mirror: bool = False) -> str:
    own = "floor(i / 2)" if mirror else "i"
    u = ", ".join(f"({own} + 0.5) * {mc.WEYL[k]!r} - floor(({own} + 0.5) * {mc.WEYL[k]!r}) AS u{k}" for k in range(dims))
    z = ", ".join(f"{'CASE WHEN i % 2 = 1 THEN -1 ELSE 1 END * ' if mirror else ''}{ppf(f'u{k}')} AS z{k}" for k in range(dims))
    return f"u AS (SELECT i, {u} FROM (SELECT CAST(unnest(range({n})) AS DOUBLE) AS i)), z AS (SELECT i, {z} FROM u)"


def _correlated(rho, dims: int) -> str:
    low = np.linalg.cholesky(np.array(rho))
    return "w AS (SELECT i, " + ", ".join(" + ".join(f"{float(low[a, k])!r} * z{k}" for k in range(a + 1)) + f" AS w{a}" for a in range(dims)) + " FROM z)"


def _stats(n: int = 4):
    return [F.round("value", n).alias("value"), F.round("error", n).alias("error"), "paths"]


def deals(spark, sf_dir, source: str, key: str, figures: dict[str, str]):
    """A deal for each row of a table: id, and figures as expressions of the key k, which Spark and DuckDB read alike."""
    return table(spark, sf_dir, source).selectExpr(f"CAST({key} AS INT) AS k").selectExpr("k AS id", *[f"{e} AS {c}" for c, e in figures.items()])


def _deals(source: str, key: str, figures: dict[str, str]) -> str:
    return f"deals AS (SELECT k AS id, {', '.join(f'{e} AS {c}' for c, e in figures.items())} FROM (SELECT CAST({key} AS INTEGER) AS k FROM {source}))"


#: A spread of three legs for each nation, and a choice of three for each region.
SPREADS = {"f0": "20e0 + k / 10e0", "f1": "12e0 + (k % 5) / 10e0", "f2": "6e0 - (k % 3) / 10e0", "v0": "0.3e0 + (k % 4) / 50e0", "v1": "0.25e0", "v2": "0.4e0 - (k % 3) / 20e0", "strike": "1e0 + (k % 2)", "t": "0.75e0 + (k % 5) / 4e0", "r": "0.03e0"}
BASE = {"f0": "80e0 + 2 * k", "f1": "81e0 + k", "f2": "79.5e0 + 3 * k", "v0": "0.3e0 + k / 50e0", "v1": "0.28e0 + k / 100e0", "v2": "0.32e0 - k / 50e0", "t": "0.5e0 + k / 10e0", "r": "0.04e0"}
NATIONS, REGIONS = ("nation", "n_nationkey", SPREADS), ("region", "r_regionkey", BASE)


def _leg(k: int) -> str:
    return f"(f{k} * exp(v{k} * sqrt(t) * w{k} - v{k} * v{k} * t / 2))"


def _figures(x: str = "x") -> str:
    return f"round(avg({x}), 4) AS value, round(stddev_samp({x}) / sqrt(count(*)), 4) AS error, count(*) AS paths"


_PAY = f"exp(-r * t) * greatest({_leg(0)} - {_leg(1)} - {_leg(2)} - strike, 0)"


@query("spread_simulation", f"WITH {_weyl(N, 3)}, {_correlated(RHO3, 3)}, {_deals(*NATIONS)}, p AS (SELECT id, {_PAY} AS x FROM w CROSS JOIN deals) SELECT id, {_figures()} FROM p GROUP BY 1")
def spread_simulation(spark, sf_dir):
    """A spread of three legs for each nation."""
    return mc.spread_option(deals(spark, sf_dir, *NATIONS), ["id"], RHO3, N).select("id", *_stats())


_BASKET = f"exp(-r * t) * greatest(1.1 * {_leg(0)} - 0.8 * {_leg(1)} - 0.5 * {_leg(2)} - strike, 0)"


@query("basket_simulation", f"WITH {_weyl(N, 3, True)}, {_correlated(RHO3, 3)}, {_deals(*NATIONS)}, p AS (SELECT id, {_BASKET} AS x FROM w CROSS JOIN deals) SELECT id, {_figures()} FROM p GROUP BY 1")
def basket_simulation(spark, sf_dir):
    """A weighted basket for each nation."""
    return mc.spread_option(deals(spark, sf_dir, *NATIONS), ["id"], RHO3, N, antithetic=True, weights=[1.1, -0.8, -0.5]).select("id", *_stats())


_EVERY = ("f0", "f1", "f2"), ("v0", "v1", "v2")
SHIFTS = {f"vol {d:+.0%}": dict.fromkeys(_EVERY[1], f"{d}e0") for d in (-0.05, -0.02, 0.0, 0.02, 0.05)}
SHIFTS |= {f"curve {d:+d}": dict.fromkeys(_EVERY[0], f"{d}e0") for d in (-5, -2, 0, 2, 5)}
SHIFTS |= {f"day {d:02d}": {"t": f"-{d} / 365e0"} for d in range(31)}
#: The named stresses of a curve, as offsets of the month before, the month and the month after; a flat curve has the middle month's price.
STRESSES = {
    "Base Case (Live)": ("0e0", "0e0", "0e0"),
    "Steep Backwardation": ("3e0", "1e0", "0e0"),
    "Mild Backwardation": ("1e0", "0.5e0", "0e0"),
    "Flat Curve": ("f1 - f0", "0e0", "f1 - f2"),
    "Mild Contango": ("0e0", "0.5e0", "1e0"),
    "Steep Contango": ("0e0", "1e0", "3e0"),
    "Bull Parallel +5": ("5e0", "5e0", "5e0"),
    "Bear Parallel -5": ("-5e0", "-5e0", "-5e0"),
}
SHIFTS |= {name: dict(zip(_EVERY[0], x)) for name, x in STRESSES.items()}
_LEAST = f"exp(-r * t) * least({_leg(0)}, {_leg(1)}, {_leg(2)})"


def _scenario_sql(shifts: dict) -> str:
    """SQL of deals in every scenario, as table s."""
    low = {"v": "0.01e0", "t": "1e-6"}

    def moved(c: str, add: dict) -> str:
        x = f"{c} + ({add[c]})" if c in add else c
        return f"greatest({low[c[0]]}, {x}) AS {c}" if c[0] in low else f"{x} AS {c}"

    return "s AS (" + " UNION ALL ".join(f"SELECT id, '{name}' AS scenario, {', '.join(moved(c, add) for c in BASE)} FROM deals" for name, add in {"base": {}, **shifts}.items()) + ")"


def choices(spark, sf_dir, n: int, antithetic: bool = True):
    """The regions' choices on n paths, with correlated normals."""
    rows = mc.correlated(mc.deal_paths(deals(spark, sf_dir, *REGIONS), n, 3, antithetic=antithetic), RHO3)
    return rows.select("id", *BASE, "w0", "w1", "w2")


@query("chooser_scenarios", f"WITH {_weyl(N_SCENARIO, 3, True)}, {_correlated(RHO3, 3)}, {_deals(*REGIONS)}, {_scenario_sql(SHIFTS)} SELECT id, scenario, {_figures(_LEAST)} FROM w CROSS JOIN s GROUP BY 1, 2")
def chooser_scenarios(spark, sf_dir):
    """The least of three forwards of each region under five shifts of volatility and of the curve, 30 days of decay and eight stresses."""
    return mc.least_values(mc.scenarios(choices(spark, sf_dir, N_SCENARIO), SHIFTS), ["id", "scenario"]).select("id", "scenario", *_stats())


@query("chooser_value", f"WITH {_weyl(N_LEAST, 3, True)}, {_correlated(RHO3, 3)}, {_deals(*REGIONS)}, x AS (SELECT id, {_LEAST} AS x, exp(-r * t) * least(f0, f1, f2) AS i FROM w CROSS JOIN deals) SELECT id, {_figures()}, round(max(i), 4) AS intrinsic, round(avg(x) - max(i), 4) AS time_value FROM x GROUP BY 1")
def chooser_value(spark, sf_dir):
    """The least of three forwards of each region, its intrinsic and its time value."""
    value = mc.least_values(choices(spark, sf_dir, N_LEAST), ["id"])
    plain = deals(spark, sf_dir, *REGIONS).selectExpr("id", "exp(-r * t) * least(f0, f1, f2) AS plain")
    return value.join(plain, "id").select("id", *_stats(), F.round("plain", 4).alias("intrinsic"), F.round(F.col("value") - F.col("plain"), 4).alias("time_value"))


_TURNS = (-0.1, -0.05, 0.0, 0.05, 0.1)


def _turned(shift: float) -> list[list[float]]:
    return [[1.0 if i == j else float(np.clip(RHO3[i][j] + shift, -0.99, 0.99)) for j in range(3)] for i in range(3)]


_TURNED = ", ".join(_correlated(_turned(d), 3).replace("w AS", f"w{k} AS", 1) for k, d in enumerate(_TURNS))


@query("chooser_correlations", f"WITH {_weyl(N_SCENARIO, 3, True)}, {_TURNED}, {_deals(*REGIONS)} " + " UNION ALL ".join(f"SELECT id, {d} AS shift, {_figures(_LEAST)} FROM w{k} CROSS JOIN deals GROUP BY 1" for k, d in enumerate(_TURNS)))
def chooser_correlations(spark, sf_dir):
    """The same with all correlations shifted and kept within 0.99: a row for each shift, each on the same draws."""
    shift = F.explode(F.array(*[F.lit(d) for d in _TURNS])).alias("shift")
    rows = mc.deal_paths(deals(spark, sf_dir, *REGIONS).select("*", shift), N_SCENARIO, 3, antithetic=True)
    moved = [F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.lit(RHO3[i][j]) + F.col("shift"))) for i, j in ((0, 1), (0, 2), (1, 2))]
    return mc.least_values(mc.correlated_three(rows, *moved), ["id", "shift"]).select("id", "shift", *_stats())


_BUMPS = {f"{k}{s}": {k: f"{s}{d}e0"} for k, d in [*((f"f{i}", 0.01) for i in range(3)), *((f"v{i}", 0.001) for i in range(3))] for s in "+-"} | {"t-": {"t": "-1 / 365e0"}}


@query("chooser_greeks", f"WITH {_weyl(N_LEAST, 3, True)}, {_correlated(RHO3, 3)}, {_deals(*REGIONS)}, {_scenario_sql(_BUMPS)}, v AS (SELECT id, scenario, avg({_LEAST}) AS value FROM w CROSS JOIN s GROUP BY 1, 2) SELECT id, substr(scenario, 1, 2) AS greek, round(sum(CASE WHEN scenario LIKE '%+' THEN value ELSE -value END) / CASE WHEN scenario LIKE 'f%' THEN 0.02 ELSE 0.002 END, 4) AS value FROM v WHERE scenario NOT IN ('base', 't-') GROUP BY 1, 2, scenario LIKE 'f%' UNION ALL SELECT id, 'theta', round(max(value) FILTER (scenario = 't-') - max(value) FILTER (scenario = 'base'), 4) FROM v GROUP BY 1")
def chooser_greeks(spark, sf_dir):
    """Greeks of each region's choice by differences on common draws."""
    return mc.finite_greeks(deals(spark, sf_dir, *REGIONS), ["id"], RHO3, N_LEAST, seed=None).select("id", "greek", F.round("value", 4).alias("value"))


_GREEKS = ", ".join(
    f"round(avg(exp(-r * t) * CASE WHEN e{i} = least(e0, e1, e2) THEN e{i} ELSE 0 END / f{i}), 6) AS delta{i}, round(avg(exp(-r * t) * CASE WHEN e{i} = least(e0, e1, e2) THEN e{i} ELSE 0 END * (sqrt(t) * w{i} - v{i} * t)), 5) AS vega{i}"
    for i in range(3)
)


@query("chooser_path_greeks", f"WITH {_weyl(N_LEAST, 3)}, {_correlated(RHO3, 3)}, {_deals(*REGIONS)}, e AS (SELECT *, {', '.join(f'{_leg(i)} AS e{i}' for i in range(3))} FROM w CROSS JOIN deals) SELECT id, {_GREEKS} FROM e GROUP BY 1")
def chooser_path_greeks(spark, sf_dir):
    rows = mc.path_greeks(choices(spark, sf_dir, N_LEAST, antithetic=False), ["id"])
    return rows.select("id", *[F.round(f"{g}{i}", k).alias(f"{g}{i}") for i in range(3) for g, k in (("delta", 6), ("vega", 5))])


#: A bounded normal for each region.
BOUNDED = {"x_low": "7e0 + k / 10e0", "x_high": "13.25e0 + k", "x_mean": "9e0 + k / 5e0", "x_sd": "2.5e0 - k / 10e0"}


@query("truncated_normal", f"WITH {_weyl(N, 1)}, {_deals('region', 'r_regionkey', BOUNDED)}, e AS (SELECT id, x_mean AS mean, x_sd AS sd, (x_low - x_mean) / x_sd AS a, (x_high - x_mean) / x_sd AS b FROM deals), c AS (SELECT id, mean, sd, {cdf('a')} AS pa, {cdf('b')} AS pb FROM e), x AS (SELECT id, mean, sd, pa + u0 * (pb - pa) AS p FROM u CROSS JOIN c) SELECT id, round(avg(mean + sd * {ppf('p')}), 6) AS mean, round(min(mean + sd * {ppf('p')}), 6) AS low, round(max(mean + sd * {ppf('p')}), 6) AS high FROM x GROUP BY 1")
def truncated_normal(spark, sf_dir):
    """Mean and ends of each region's bounded normal."""
    rows = mc.deal_paths(mc.with_bounds(deals(spark, sf_dir, "region", "r_regionkey", BOUNDED), "x"), N, 1)
    rows = mc.with_truncated(rows, {"x": "u0"})
    return rows.groupBy("id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


#: A right to cancel for each region: bounded normals with jumps for price and freight, and what was paid.
CANCELLED = {
    "price_low": "6e0", "price_high": "18e0", "price_mean": "10e0 + k / 10e0", "price_sd": "2e0 + k / 10e0", "price_chance": "0.1e0", "price_jump": "3e0 - k / 2e0", "price_jump_sd": "0.5e0",
    "freight_low": "20000e0", "freight_high": "150000e0", "freight_mean": "60000e0 + 2000 * k", "freight_sd": "20000e0", "freight_chance": "0.05e0 + k / 100e0", "freight_jump": "40000e0", "freight_jump_sd": "10000e0",
    "bought": "9.5e0", "boil_off": "0.001e0", "days": "15e0 + k", "net": "0.2e0",
}


def _drawn(x: str, k: int) -> str:
    """SQL of a bounded normal with jumps from u columns k to k + 2; its ends are columns a{k} and b{k}."""
    return f"{x}_mean + {x}_sd * {ppf(f'(a{k} + u{k} * (b{k} - a{k}))')} + CASE WHEN u{k + 1} < {x}_chance THEN {x}_jump + {x}_jump_sd * {ppf(f'u{k + 2}')} ELSE 0 END"


def _ends(x: str, k: int) -> str:
    return ", ".join(f"({x}_{e} - {x}_mean) / {x}_sd AS {c}{k}" for e, c in (("low", "x"), ("high", "y")))


@query("cancellation_option", f"""WITH {_weyl(N_CANCEL, 6)}, {_deals('region', 'r_regionkey', CANCELLED)}, e AS (SELECT *, {_ends('price', 0)}, {_ends('freight', 3)} FROM deals), c AS (SELECT *, {cdf('x0')} AS a0, {cdf('y0')} AS b0, {cdf('x3')} AS a3, {cdf('y3')} AS b3 FROM e),
d AS (SELECT id, bought, boil_off, days, net, price_mean, freight_mean, {_drawn('price', 0)} AS price, {_drawn('freight', 3)} AS freight FROM u CROSS JOIN c), p AS (SELECT id, (price + net) * (1 - days * boil_off) - freight * days / 1e6 - bought AS x, greatest((price_mean + net) * (1 - days * boil_off) - freight_mean * days / 1e6 - bought, 0) AS plain FROM d)
SELECT id, round(avg(greatest(x, 0)), 5) AS value, round(stddev_samp(greatest(x, 0)) / sqrt(count(*)), 5) AS error, count(*) AS paths, round(avg(x), 5) AS forward, round(max(plain), 5) AS intrinsic FROM p GROUP BY 1""")
def cancellation_option(spark, sf_dir):
    """The right to cancel a cargo of each region."""
    out = mc.cancellation_option(deals(spark, sf_dir, "region", "r_regionkey", CANCELLED), ["id"], N_CANCEL, seed=None)
    return out.select("id", F.round("value", 5).alias("value"), F.round("error", 5).alias("error"), "paths", F.round("forward", 5).alias("forward"), F.round("intrinsic", 5).alias("intrinsic"))


#: A cargo for each nation: price, index and freight a day, and its terms.
CARGOES = {"f0": "12e0 + k / 20e0", "f1": "80e0 - k / 5e0", "f2": "60000e0 + 500 * k", "v0": "0.4e0", "v1": "0.3e0 + (k % 3) / 50e0", "v2": "0.5e0", "r": "0.03e0", "t": "0.5e0 + (k % 4) / 8e0", "days": "20e0 + k % 7", "boil_off": "0.001e0", "start_mmbtu": "3400000e0", "slope": "0.12e0", "costs": "100000e0 + 10000 * (k % 3)"}
_JUMPS = [(0.05, 5.0, 1.0), (0.02, -4.0, 0.5)]
_CARGO_W = _correlated(RHO3, 3).replace("SELECT i, ", "SELECT i, z3, z4, z5, z6, ", 1)
_CARGO_END = _leg(0) + "".join(f" + CASE WHEN {cdf(f'z{3 + 2 * j}')} < {p} THEN {m} + {sd} * z{4 + 2 * j} ELSE 0 END" for j, (p, m, sd) in enumerate(_JUMPS))


@query("cargo_option", f"""WITH {_weyl(N, 7, True)}, {_CARGO_W}, {_deals('nation', 'n_nationkey', CARGOES)}, p AS (SELECT id, exp(-r * t) AS kept, ({_CARGO_END}) * start_mmbtu * (1 - days * boil_off) - slope * {_leg(1)} * start_mmbtu - {_leg(2)} * days - costs AS x, greatest(f0 * start_mmbtu * (1 - days * boil_off) - slope * f1 * start_mmbtu - f2 * days - costs, 0) * exp(-r * t) AS plain FROM w CROSS JOIN deals)
SELECT id, round(avg(greatest(x, 0) * kept), 0) AS value, round(max(plain), 0) AS intrinsic, round(avg(greatest(x, 0) * kept) - max(plain), 0) AS extrinsic, round(avg(x), 0) AS forward, round(stddev_samp(greatest(x, 0) * kept) / sqrt(count(*)), 0) AS error FROM p GROUP BY 1""")
def cargo_option(spark, sf_dir):
    """A cargo of each nation with two kinds of jumps of its price."""
    out = mc.cargo_option(deals(spark, sf_dir, "nation", "n_nationkey", CARGOES), ["id"], RHO3, _JUMPS, N)
    return out.select("id", *[F.round(c, 0).alias(c) for c in out.columns if c != "id"])


def curve_models(spark, sf_dir, bounded: bool = True):
    """A curve of three tenors for each region, with one factor."""
    k = F.col("r_regionkey")
    lists = {"forwards": [3.0 + k / 10.0, 3.2 + k / 10.0, 3.4 + k / 20.0], "starts": [F.lit(0.25), F.lit(0.5), F.lit(1.0)], "times": [F.lit(0.1), F.lit(0.3), F.lit(0.6)], "sigmas": [0.5 + k / 50.0], "alphas": [1.2 - k / 10.0]}
    low, high = (F.lit(x).cast("double") for x in ((0.5, 10.0) if bounded else (None, None)))
    return table(spark, sf_dir, "region").select(k.alias("id"), *[F.array(*x).alias(c) for c, x in lists.items()], low.alias("low"), high.alias("high"), F.lit(0.0).alias("drift"))


@query("curve_simulation")
def curve_simulation(spark, sf_dir):
    """Mean and deviation of simulated prices of each region's bounded curve."""
    rows = mc.simulate_curve(curve_models(spark, sf_dir), "id", 4000)
    return rows.groupBy("id", "step", "tenor").agg(F.round(F.avg("price"), 6).alias("mean"), F.round(F.stddev_samp("price"), 6).alias("sd"))


def factor_models(spark, sf_dir):
    """A model of two factors for each nation."""
    k = F.col("n_nationkey")
    rho = 0.8 - k / 50.0
    one = F.lit(1.0)
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.array(0.1 + k / 100.0, 0.15 + k / 200.0).alias("sigmas"), F.array(0.5 + k / 25.0, 10.0 - k / 5.0).alias("alphas"), F.array(F.array(one, rho), F.array(rho, one)).alias("rho"))


@query("factor_simulation")
def factor_simulation(spark, sf_dir):
    """Mean and variance of the factors of each nation's model at three times."""
    rows = mc.simulate_factors(factor_models(spark, sf_dir), "id", [0.1, 0.5, 2.0], 20_000)
    return rows.groupBy("id", "step", "factor").agg(F.round(F.avg("state"), 8).alias("mean"), F.round(F.var_samp("state"), 8).alias("variance"))


@query("local_vol_spread")
def local_vol_spread(spark, sf_dir):
    """A spread of each region whose volatilities depend on time and price."""
    grid = ([0.0, 0.5, 1.0], [50.0, 100.0, 150.0], [[0.4, 0.3, 0.28], [0.36, 0.28, 0.26], [0.34, 0.27, 0.25]])
    figures = {"f1": "100e0 + k", "f2": "90e0 - k", "rho": "0.6e0 - k / 10e0", "strike": "5e0", "t": "0.5e0", "r": "0.02e0"}
    return mc.local_vol_spread(deals(spark, sf_dir, "region", "r_regionkey", figures), "id", grid, grid, 25, 20_000).select("id", *_stats())


#: Distributions of a price for each nation: a bounded normal with jumps.
MODELLED = {"x_low": "6e0 + k / 10e0", "x_high": "18e0 + k / 5e0", "x_mean": "10e0 + k / 8e0", "x_sd": "2e0 + (k % 4) / 4e0", "x_chance": "0.1e0 + (k % 3) / 20e0", "x_jump": "3e0 - (k % 2)", "x_jump_sd": "0.5e0"}


@query("modelled_distribution", f"""WITH {_weyl(N, 3)}, {_deals('nation', 'n_nationkey', MODELLED)}, e AS (SELECT *, {_ends('x', 0)} FROM deals), c AS (SELECT *, {cdf('x0')} AS a0, {cdf('y0')} AS b0 FROM e), d AS (SELECT id, {_drawn('x', 0)} AS x FROM u CROSS JOIN c)
SELECT id, CAST(least(floor((x - 5) / 0.5), 39) AS INTEGER) AS bin, round(count(*) / {N}.0, 6) AS share FROM d WHERE x BETWEEN 5 AND 25 GROUP BY 1, 2""")
def modelled_distribution(spark, sf_dir):
    """Shares of each nation's modelled price in forty bins."""
    draws = sk.modelled(deals(spark, sf_dir, "nation", "n_nationkey", MODELLED), ["id"], "x", N)
    return sk.shares(draws, ["id"], "x", 5.0, 25.0, 40).select("id", "bin", F.round("share", 6).alias("share"))


@query("modelled_quantiles")
def modelled_quantiles(spark, sf_dir):
    """Quantiles of each nation's modelled price by sketches, in one pass; tests hold their ranks against the stated error."""
    draws = sk.modelled(deals(spark, sf_dir, "nation", "n_nationkey", MODELLED), ["id"], "x", N)
    return sk.quantiles(sk.sketched(draws, ["id"], "x"), [0.05, 0.25, 0.5, 0.75, 0.95])


def _edge(mu: str, sigma: str) -> str:
    return f"struct_pack(sse := greatest(yy + n * ({mu}) * ({mu}) + ({sigma}) * ({sigma}) * xx - 2 * ({mu}) * y - 2 * ({sigma}) * xy + 2 * ({mu}) * ({sigma}) * x, 0), mu := {mu}, sigma := {sigma})"


@query("decay_fit", f"""WITH d AS (SELECT event_type, CAST(user_id % 24 AS INTEGER) AS tenor, stddev_samp(value) / 20 AS v FROM events GROUP BY 1, 2), a AS (SELECT 0.5 + 1.5 * unnest(range(151)) / 150 AS alpha), x AS (SELECT event_type, alpha, v, exp(-alpha * (15 + 30 * tenor) / 365.0) AS e FROM d, a WHERE v IS NOT NULL),
t AS (SELECT event_type, alpha, CAST(count(*) AS DOUBLE) AS n, sum(e) AS x, sum(v) AS y, sum(e * e) AS xx, sum(e * v) AS xy, sum(v * v) AS yy FROM x GROUP BY 1, 2), u AS (SELECT *, (n * xy - x * y) / (n * xx - x * x) AS s FROM t), w AS (SELECT *, (y - s * x) / n AS m FROM u),
b AS (SELECT event_type, alpha, CASE WHEN m BETWEEN 0 AND 10 AND s BETWEEN 0 AND 10 THEN {_edge('m', 's')} ELSE list_min([{', '.join([_edge(f'CAST({k} AS DOUBLE)', f'greatest(0, least(10, (xy - {k} * x) / xx))') for k in (0, 10)] + [_edge(f'greatest(0, least(10, (y - {k} * x) / n))', f'CAST({k} AS DOUBLE)') for k in (0, 10)])}]) END AS b FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(b.sse, 9), alpha) AS k FROM b) SELECT event_type, round(b.mu, 4) AS mu, round(b.sigma, 4) AS sigma, round(alpha, 4) AS alpha, round(b.sse, 5) AS sse FROM k WHERE k = 1""")
def decay_fit(spark, sf_dir):
    """Volatility by tenor fitted with a level and a decay, all within bounds."""
    d = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 24).cast("int").alias("tenor")).agg((F.stddev_samp("value") / 20).alias("v"))
    return mc.fit_decay(d, ["event_type"], "tenor", "v").select("event_type", *[F.round(c, n).alias(c) for c, n in (("mu", 4), ("sigma", 4), ("alpha", 4), ("sse", 5))])


def documents(spark, sf_dir):
    """Release documents as JSON text, one for each order."""
    lines = table(spark, sf_dir, "lineitem")

    def point(x):
        day, quote = F.to_date(x["l_shipdate"]).cast("string"), x["l_extendedprice"]
        price = F.struct(quote.cast("string").alias("spark"), (quote - 1).cast("string").alias("sparkMin"), F.when(x["l_linenumber"] != 2, (quote + 1).cast("string")).otherwise("n/a").alias("sparkMax"))
        return F.struct(F.struct(day.alias("startAt"), day.alias("endAt"), F.concat(F.lit("M"), x["l_linenumber"].cast("string")).alias("name")).alias("deliveryPeriod"), F.struct(price.alias("usdPerDay"), price.alias("usdPerMMBtu")).alias("derivedPrices"))

    # lines are brought together as they are and written out as text afterwards
    rows = lines.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).cast("string").alias("releaseDate"), F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_shipdate")).alias("lines"))
    points = F.transform("lines", point).alias("dataPoints")
    return rows.select(F.to_json(F.struct("releaseDate", F.col("l_orderkey").cast("string").alias("contractId"), F.array(F.struct(points)).alias("data"))).alias("doc"))


def _points(docs):
    points = files.price_points(files.releases(docs))
    return points.withColumns({c: F.round(c, 6) for c in ("price", "low", "high")})


def _april(docs):
    points = files.in_month(files.price_points(files.releases(docs)), "Apr-1996")
    return points.select("contract_id", "period", F.round("price", 6).alias("price"))


@query("release_points", """WITH l AS (SELECT *, CAST(min(l_shipdate) OVER (PARTITION BY l_orderkey) AS DATE) AS rel FROM lineitem)
SELECT rel AS release_date, CAST(l_orderkey AS VARCHAR) AS contract_id, 'M' || l_linenumber AS period, CAST(l_shipdate AS DATE) AS start, round(l_extendedprice, 6) AS price, round(l_extendedprice - 1, 6) AS low, CASE WHEN l_linenumber <> 2 THEN round(l_extendedprice + 1, 6) END AS high FROM l""")
def release_points(spark, sf_dir):
    """Price points of the release documents of all orders."""
    return _points(documents(spark, sf_dir))


@query("release_month", """WITH l AS (SELECT * FROM lineitem WHERE strftime(l_shipdate, '%b-%Y') = 'Apr-1996') SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, 'M' || l_linenumber AS period, round(l_extendedprice, 6) AS price FROM l""")
def release_month(spark, sf_dir):
    """Points of a month from the release documents of all orders."""
    return _april(documents(spark, sf_dir))


@query("release_points_all", """WITH l AS (SELECT *, CAST(min(l_shipdate) OVER (PARTITION BY l_orderkey) AS DATE) AS rel FROM lineitem)
SELECT rel AS release_date, CAST(l_orderkey AS VARCHAR) AS contract_id, 'M' || l_linenumber AS period, CAST(l_shipdate AS DATE) AS start, round(l_extendedprice, 6) AS price, round(l_extendedprice - 1, 6) AS low, CASE WHEN l_linenumber <> 2 THEN round(l_extendedprice + 1, 6) END AS high FROM l""")
def release_points_all(spark, sf_dir):
    """Price points of all orders."""
    return _points(documents(spark, sf_dir))


@query("release_month_all", """SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, 'M' || l_linenumber AS period, round(l_extendedprice, 6) AS price FROM lineitem WHERE strftime(l_shipdate, '%b-%Y') = 'Apr-1996'""")
def release_month_all(spark, sf_dir):
    """Points of a month from all orders."""
    return _april(documents(spark, sf_dir))


@query("event_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    """Counts by a field of a JSON column."""
    return table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("quote_rules", "SELECT p_partkey AS id, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 9) AS vol, round(coalesce(ln(1 + q * 30 / 360) * 365 / 30, 0.05), 9) AS rate FROM (SELECT p_partkey, coalesce(CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END, 0.33) AS v, CASE WHEN p_size % 4 <> 0 THEN p_size / 1000.0 END AS q FROM part)")
def quote_rules(spark, sf_dir):
    """First volatility field that is there, per cent as fraction; continuous money-market rate or its default."""
    size = F.col("p_size")
    vol = files.implied_vol(F.when(size % 3 != 0, size.cast("double")), F.lit(0.33))
    rate = files.continuous_rate(F.when(size % 4 != 0, size / 1000.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(vol, 9).alias("vol"), F.round(rate, 9).alias("rate"))


@query("fallback_prices", "SELECT n_nationkey AS key, CASE WHEN n_regionkey = 1 THEN -1.0 ELSE CAST(n_nationkey AS DOUBLE) END AS value, n_regionkey = 1 AS from_fallback FROM nation")
def fallback_prices(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    live = n.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("double").alias("value"))
    return files.with_fallback(live, n.select(F.col("n_nationkey").alias("key"), F.lit(-1.0).alias("value")), ["key"], "value")


dated("release_date start", "release_points", "release_points_all")
