"""Queries written as SQL text alone, by the functions that the catalog registers."""

from __future__ import annotations

from fathomline.functions import catalog
from fathomline.plans.mapping import trades
from fathomline.plans.pricing import _dated_trades, model
from fathomline.plans.registry import SQL, query


def _views(spark, sf_dir) -> None:
    catalog.register(spark)
    trades(spark, sf_dir).createOrReplaceTempView("fathomline_trades")
    _dated_trades(spark, sf_dir).createOrReplaceTempView("fathomline_dated")


@query("sql_black76", SQL["black76_dated"])
def sql_black76(spark, sf_dir):
    """Prices and greeks between two dates, from SQL."""
    _views(spark, sf_dir)
    return spark.sql("""
        SELECT d.id, round(x.value, 7) AS value, round(x.delta, 7) AS delta, round(x.gamma, 9) AS gamma, round(x.vega, 6) AS vega, round(x.theta, 7) AS theta
        FROM fathomline_dated d, LATERAL black76_risks(d.pricing, d.expiry, d.s, d.k, d.cp, d.vol, d.r) x""")


@query("sql_black76_figures", f"SELECT id, value AS price, delta, gamma, vega, theta FROM ({SQL['black76_dated']})")
def sql_black76_figures(spark, sf_dir):
    """The same by the functions of one figure."""
    _views(spark, sf_dir)
    digits = {"price": 7, "delta": 7, "gamma": 9, "vega": 6, "theta": 7}
    return spark.sql(f"SELECT id, {', '.join(f'round(black76_{f}(pricing, expiry, s, k, cp, vol, r), {n}) AS {f}' for f, n in digits.items())} FROM fathomline_dated")


@query("sql_kirk", f"SELECT id, value, delta1, delta2, vega1, vega2, rho_sensitivity, theta FROM ({SQL['kirk_dated']})")
def sql_kirk(spark, sf_dir):
    """All figures of spread options between two dates, from SQL."""
    _views(spark, sf_dir)
    digits = {"value": 6, "delta1": 7, "delta2": 7, "vega1": 5, "vega2": 5, "rho_sensitivity": 2, "theta": 7}
    return spark.sql(f"""
        SELECT d.id, {', '.join(f'round(x.{f}, {n}) AS {f}' for f, n in digits.items())}
        FROM fathomline_dated d, LATERAL kirk_risks(d.pricing, d.expiry, d.s, 0.9D * d.s, 5D, d.cp, d.vol, 0.25D, 0.6D, d.r) x""")


@query("sql_kirk_figures", f"SELECT id, value AS price, delta1, delta2, vega1, vega2, rho_sensitivity AS corr_sensitivity, theta FROM ({SQL['kirk_dated']})")
def sql_kirk_figures(spark, sf_dir):
    """The same by the functions of one figure and of two."""
    _views(spark, sf_dir)
    args = "{}.pricing, {}.expiry, {}.s, 0.9D * {}.s, 5D, {}.cp, {}.vol, 0.25D, 0.6D, {}.r".replace("{}", "d")
    return spark.sql(f"""
        SELECT d.id, round(kirk_price({args}), 6) AS price, round(a.delta1, 7) AS delta1, round(a.delta2, 7) AS delta2, round(b.vega1, 5) AS vega1, round(b.vega2, 5) AS vega2,
               round(kirk_corr_sensitivity({args}), 2) AS corr_sensitivity, round(kirk_theta({args}), 7) AS theta
        FROM fathomline_dated d, LATERAL kirk_delta({args}) a, LATERAL kirk_vega_by_leg({args}) b""")


@query("sql_normal", SQL["normal_functions"])
def sql_normal(spark, sf_dir):
    """The normal distribution, from SQL."""
    _views(spark, sf_dir)
    return spark.sql(f"""
        SELECT p_partkey AS id, round(norm_pdf((p_partkey % 401 - 200) / 25D), 9) AS pdf, round(norm_cdf((p_partkey % 401 - 200) / 25D), 9) AS cdf, round(norm_ppf((p_partkey % 999 + 1) / 1000D), 8) AS ppf
        FROM parquet.`{sf_dir}/part.parquet`""")


@query("sql_term_corr", SQL["factor_covariance"].replace("SELECT id, ", "SELECT id, ", 1))
def sql_term_corr(spark, sf_dir):
    """Volatilities and correlations of a factor model's deliveries, from SQL."""
    catalog.register_model(spark, model(spark), "fathomline_model")
    return spark.sql(f"""
        WITH q AS (SELECT p_partkey AS id, 0.05D + p_size / 50D AS t, 0.1D + p_size / 50D AS t1, 0.08D AS d1, 0.3D + p_size / 40D AS t2, 0.25D AS d2 FROM parquet.`{sf_dir}/part.parquet`)
        SELECT q.id, round(x.corr * x.vol1 * x.vol2 * q.t, 9) AS cov, round(x.vol1, 7) AS vol, round(x.corr, 7) AS corr
        FROM q, LATERAL fathomline_model_corr('A', q.t1, q.d1, 'B', q.t2, q.d2, q.t) x""")
