"""The pricing functions by name, for SQL.

Bodies are the SQL texts of the same columns that Python callers use, so that there is
one formula. They are inlined into the caller's plan by Catalyst: no Python worker but
for the one solver. Functions of many figures are table functions, called as
`FROM deals, LATERAL black76_risks(...)`; those of one figure stand anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import normal, options as op
from fathomline.operators.covariance import Factors
from fathomline.operators.staging import stage

_BLACK = "pricing_date DATE, expiry_date DATE, forward_price DOUBLE, strike DOUBLE, option_type STRING, vol DOUBLE"
_KIRK = "pricing_date DATE, expiry_date DATE, pos_forward_price DOUBLE, neg_forward_price DOUBLE, strike DOUBLE, option_type STRING, pos_vol DOUBLE, neg_vol DOUBLE, corr DOUBLE"
_RATE = ", r DOUBLE DEFAULT 0D"


def sql_text(rows: DataFrame, base: str) -> str:
    """A DataFrame made of projections over an empty one, as nested SELECTs over `base`."""
    def rendered(node) -> str:
        if node.nodeName() != "Project":
            return base
        items = node.projectList()
        return f"(SELECT {', '.join(items.apply(k).sql() for k in range(items.length()))} FROM {rendered(node.child())})"

    return rendered(rows._jdf.queryExecution().analyzed())


def _names(params: str) -> list[str]:
    return [p.split()[0] for p in params.split(", ")]


def _columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def scalar(spark: SparkSession, name: str, params: str, made: Callable[..., Column], defaults: str = "") -> None:
    """A function of one figure from a column of its parameters."""
    every = params + defaults.replace(" DEFAULT 0D", "")
    text = sql_text(spark.createDataFrame([], every).select(made(*_columns(*_names(every))).alias("v")), "")
    body = text[len("(SELECT ") : text.rindex(" AS v FROM ")] if " AS v FROM " in text else text[len("(SELECT ") : text.rindex(" AS `v` FROM ")]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}{defaults}) RETURNS DOUBLE RETURN {body}")


def table(spark: SparkSession, name: str, params: str, made: Callable[[DataFrame], DataFrame], figures: list[str], defaults: str = "") -> None:
    """A table function of one row from a DataFrame of projections over its parameters."""
    every = params + defaults.replace(" DEFAULT 0D", "")
    names = _names(every)
    # parameters are named with their function, lest a column be taken for one
    rows = made(spark.createDataFrame([], every)).select(*figures)
    base = f"(SELECT {', '.join(f'{name}.{n} AS `{n}`' for n in names)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}{defaults}) RETURNS TABLE({', '.join(f'{f} DOUBLE' for f in figures)}) RETURN SELECT {', '.join(f'`{f}`' for f in figures)} FROM {sql_text(rows, base)}")


def _black(rows: DataFrame) -> DataFrame:
    return op.with_black_dated(rows, *_columns("pricing_date", "expiry_date", "forward_price", "strike", "vol", "r", "option_type"))


def _kirk(rows: DataFrame) -> DataFrame:
    return op.with_kirk_dated(rows, *_columns("pricing_date", "expiry_date", "pos_forward_price", "neg_forward_price", "strike", "pos_vol", "neg_vol", "corr", "r", "option_type"))


#: Figures of the table functions, and the functions of one figure, or two, of them.
BLACK = {"price": "value", "delta": "delta", "gamma": "gamma", "vega": "vega", "theta": "theta"}
KIRK = ["value", "delta1", "delta2", "gamma1", "gamma2", "vega1", "vega2", "theta", "rho_sensitivity"]
KIRK_PAIRS = {"delta": ("delta1", "delta2"), "gamma": ("gamma1", "gamma2"), "vega_by_leg": ("vega1", "vega2")}
KIRK_ONE = {"price": "value", "theta": "theta", "corr_sensitivity": "rho_sensitivity"}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session and return their names.

    norm_pdf, norm_cdf and norm_ppf; black76_risks and black76_price, _delta, _gamma,
    _vega and _theta; kirk_risks and kirk_price, _theta, _corr_sensitivity and _vega
    (the sum of both legs); kirk_delta, kirk_gamma and kirk_vega_by_leg as table
    functions of two figures; black76_vol_from_premium. Years are of 365 days; the rate
    r may be left out. A null in an argument gives a null.
    """
    scalar(spark, "norm_pdf", "x DOUBLE", normal.norm_pdf)
    scalar(spark, "norm_cdf", "x DOUBLE", normal.norm_cdf)
    scalar(spark, "norm_ppf", "p DOUBLE", normal.norm_ppf)
    table(spark, "black76_risks", _BLACK, _black, list(BLACK.values()), _RATE)
    table(spark, "kirk_risks", _KIRK, _kirk, KIRK, _RATE)
    found = ["norm_pdf", "norm_cdf", "norm_ppf", "black76_risks", "kirk_risks"]

    def figure(name: str, params: str, source: str, text: str) -> None:
        args = ", ".join([*_names(params), "r"])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}{_RATE}) RETURNS DOUBLE RETURN SELECT {text} FROM {source}({args})")
        found.append(name)

    for short, f in BLACK.items():
        figure(f"black76_{short}", _BLACK, "black76_risks", f)
    for short, f in KIRK_ONE.items():
        figure(f"kirk_{short}", _KIRK, "kirk_risks", f)
    figure("kirk_vega", _KIRK, "kirk_risks", "vega1 + vega2")
    for short, two in KIRK_PAIRS.items():
        table(spark, f"kirk_{short}", _KIRK, _kirk, list(two), _RATE)
        found.append(f"kirk_{short}")
    spark.udf.register("_black76_forward_vol", op.forward_vol)
    call = lambda pricing_date, expiry_date, forward_price, strike, premium, option_type, r: op.call_from_put(premium, forward_price, strike, F.datediff(expiry_date, pricing_date) / 365, r, option_type)
    params = "pricing_date DATE, expiry_date DATE, forward_price DOUBLE, strike DOUBLE, premium DOUBLE, option_type STRING"
    scalar(spark, "_black76_call", params, call, _RATE)
    years = "datediff(expiry_date, pricing_date) / 365D"
    solved = f"_black76_forward_vol(_black76_call(pricing_date, expiry_date, forward_price, strike, premium, option_type, r) * exp(r * {years}), forward_price, strike, {years})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION black76_vol_from_premium({params}{_RATE}) RETURNS DOUBLE RETURN nanvl({solved}, CAST(NULL AS DOUBLE))")
    return [*found, "black76_vol_from_premium"]


def register_model(spark: SparkSession, model: Factors, name: str) -> list[str]:
    """A factor model under a name: the view `name`_pairs (lsu1, lsu2, pairs), and the table functions of one row
    `name`_vol(lsu, t, tau, span) -> vol and `name`_corr(lsu1, t1, d1, lsu2, t2, d2, t) -> corr, vol1, vol2: yearly
    volatilities until t of deliveries, and their correlation. An underlying that the model lacks has no row. The view
    is a staged table, so that a query reads it and doesn't work it out again.
    """
    pairs = model.pairs().groupBy("lsu1", "lsu2").agg(F.collect_list(F.struct("sigma1", "alpha1", "sigma2", "alpha2", "rho")).alias("pairs"))
    stage(pairs, f"{name}-pairs").createOrReplaceTempView(f"{name}_pairs")
    decay = lambda a, start, length: f"exp(-{a} * ({start} - {{f}}.t)) * CASE WHEN abs({a} * {length}) < 1e-12 THEN 1D ELSE -expm1(-{a} * {length}) / ({a} * {length}) END"

    def cov(f: str, array: str, t1: str, d1: str, t2: str, d2: str) -> str:
        a, b = decay("p.alpha1", f"{f}.{t1}", f"{f}.{d1}").format(f=f), decay("p.alpha2", f"{f}.{t2}", f"{f}.{d2}").format(f=f)
        kept = f"CASE WHEN p.alpha1 + p.alpha2 < 1e-12 THEN {f}.t ELSE -expm1(-(p.alpha1 + p.alpha2) * {f}.t) / (p.alpha1 + p.alpha2) END"
        return f"aggregate({array}, 0D, (s, p) -> s + p.rho * p.sigma1 * p.sigma2 * {a} * {b} * {kept})"

    vol, corr = f"{name}_vol", f"{name}_corr"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {vol}(lsu STRING, t DOUBLE, tau DOUBLE, span DOUBLE) RETURNS TABLE(vol DOUBLE) RETURN SELECT sqrt({cov(vol, 'm.pairs', 'tau', 'span', 'tau', 'span')} / {vol}.t) FROM {name}_pairs m WHERE m.lsu1 = {vol}.lsu AND m.lsu2 = {vol}.lsu")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {corr}(lsu1 STRING, t1 DOUBLE, d1 DOUBLE, lsu2 STRING, t2 DOUBLE, d2 DOUBLE, t DOUBLE) RETURNS TABLE(corr DOUBLE, vol1 DOUBLE, vol2 DOUBLE)
        RETURN SELECT c / sqrt(a * b), sqrt(a / {corr}.t), sqrt(b / {corr}.t) FROM (SELECT {cov(corr, 'x.pairs', 't1', 'd1', 't2', 'd2')} AS c, {cov(corr, 'y.pairs', 't1', 'd1', 't1', 'd1')} AS a, {cov(corr, 'z.pairs', 't2', 'd2', 't2', 'd2')} AS b
        FROM {name}_pairs x, {name}_pairs y, {name}_pairs z WHERE x.lsu1 = {corr}.lsu1 AND x.lsu2 = {corr}.lsu2 AND y.lsu1 = {corr}.lsu1 AND y.lsu2 = {corr}.lsu1 AND z.lsu1 = {corr}.lsu2 AND z.lsu2 = {corr}.lsu2)"""
    )
    return [vol, corr]
