"""Queries on curves of many hubs and contracts seen from many days."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import tenor as tn
from fathomline.operators import curve, panels as pn, timeseries as ts
from fathomline.plans.calendar import _PERIODS
from fathomline.plans.registry import dated, query
from fathomline.sources.files import table

#: Monthly quotes of five hubs: unit prices of the suppliers' order lines, 30 years on.
HUBS = """hubs AS (SELECT 'H' || (s_nationkey % 5) AS hub, make_date(CAST(year(l_shipdate) + 30 AS INTEGER), CAST(month(l_shipdate) AS INTEGER), 1) AS start, avg(l_extendedprice / l_quantity) AS price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
#: Quotes of contract months on order days, by underlying.
OBS = """obs AS (SELECT 'U' || (s_nationkey % 3) AS lsu, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', l_shipdate) AS DATE) AS contract, avg(l_extendedprice / l_quantity) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
_AHEAD = "(year(contract) - year(d)) * 12 + month(contract) - month(d)"


def hubs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    start = F.make_date(F.year("l_shipdate") + 30, F.month("l_shipdate"), F.lit(1))
    return lines.groupBy(F.concat(F.lit("H"), (F.col("s_nationkey") % 5).cast("string")).alias("hub"), start.alias("start")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def observations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    keys = [F.concat(F.lit("U"), (F.col("s_nationkey") % 3).cast("string")).alias("lsu"), F.to_date("o_orderdate").alias("d"), F.trunc("l_shipdate", "MM").alias("contract")]
    return lines.groupBy(*keys).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def r(c, n=6):
    return F.round(c, n).alias(c)


def quotes(spark, sf_dir):
    """Months to 2027, quarters of 2028, years from 2029 on, of each hub."""
    y, yy = F.year("start"), F.date_format("start", "yy")
    quarter = F.concat(F.lit("Q"), F.quarter("start").cast("string"), F.lit("_"), yy)
    tenor = F.when(y <= 2027, tn.tenor_label(F.col("start"))).when(y == 2028, quarter).otherwise(F.concat(F.lit("Y_"), yy))
    return hubs(spark, sf_dir).groupBy("hub", tenor.alias("tenor")).agg(F.avg("price").alias("price"))


_CURVES = f"""WITH {HUBS}, {_PERIODS}, own AS (SELECT * FROM hubs WHERE year(start) <= 2027 AND start > DATE '2025-03-10'),
longer AS (SELECT hub, 'Q' || quarter(start) AS period, year(start) AS y, avg(price) AS price FROM hubs WHERE year(start) = 2028 GROUP BY 1, 2, 3 UNION ALL SELECT hub, 'Y', year(start), avg(price) FROM hubs WHERE year(start) >= 2029 GROUP BY 1, 2, 3),
whole AS (SELECT hub, period, year(start) - shift AS y, avg(price) AS mean, count(*) AS n FROM own JOIN members ON month(start) = m GROUP BY 1, 2, 3),
firsts AS (SELECT hub, w.period, min(y) AS y FROM whole w JOIN (SELECT period, count(*) AS size FROM members GROUP BY 1) s ON w.period = s.period AND n = size GROUP BY 1, 2),
shape AS (SELECT x.hub, b.period, b.k, o.price / w.mean AS ratio FROM firsts x JOIN members b ON x.period = b.period JOIN whole w ON w.hub = x.hub AND w.period = x.period AND w.y = x.y JOIN own o ON o.hub = x.hub AND o.start = make_date(CAST(x.y + b.shift AS INTEGER), b.m, 1)),
more AS (SELECT l.hub, make_date(CAST(l.y + b.shift AS INTEGER), b.m, 1) AS start, l.price * coalesce(s.ratio, 1) AS price FROM longer l JOIN members b ON l.period = b.period LEFT JOIN shape s ON s.hub = l.hub AND s.period = l.period AND s.k = b.k),
curves AS (SELECT * FROM own UNION ALL SELECT hub, start, price FROM more)"""


def curves(spark, sf_dir):
    return curve.monthly_curve(quotes(spark, sf_dir), "2025-03-10", by=["hub"])


@query("hub_curves", f"{_CURVES} SELECT hub, start, round(price, 6) AS price FROM curves")
def hub_curves(spark, sf_dir):
    """Monthly curves of all hubs, longer quotes shaped by their own months."""
    return curves(spark, sf_dir).select("hub", "start", r("price"))


_FXC = "fx AS (SELECT DISTINCT start, 0.8 + month(start) / 100.0 AS rate, 1.05 + month(start) / 200.0 AS eurusd, 1.25 + month(start) / 300.0 AS gbpusd FROM curves)"


def _fx(spark):
    """Rates of all months from 2020 to 2069: 600 rows."""
    start = F.add_months(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    m = F.month("start")
    return spark.range(600).select(start.alias("start")).select("start", (0.8 + m / 100.0).alias("rate"), (1.05 + m / 200.0).alias("eurusd"), (1.25 + m / 300.0).alias("gbpusd"))


@query("hub_spreads", f"""{_CURVES}, {_FXC}, v AS (SELECT c.hub, c.start, CASE WHEN c.hub = 'H1' THEN c.price * 0.01 / rate / 0.0293001 ELSE c.price END AS value, o.price AS ref FROM curves c JOIN curves o ON o.hub = 'H0' AND o.start = c.start LEFT JOIN fx ON fx.start = c.start WHERE c.hub <> 'H0')
SELECT hub, start, round(value, 6) AS value, round(ref - value, 6) AS spread, CASE WHEN hub = 'H1' THEN round(value * 0.985 - 1.24, 6) END AS floor FROM v""")
def hub_spreads(spark, sf_dir):
    return pn.hub_spreads(curves(spark, sf_dir), "hub", "H0", ["H1"], _fx(spark).select("start", "rate")).select("hub", "start", r("value"), r("spread"), r("floor"))


@query("import_floor", f"""{_CURVES}, {_FXC} SELECT b.start, round(b.price * 0.01 * gbpusd / eurusd / 0.0293001 * 0.985 - 0.45 / eurusd * 3.412142, 6) AS floor, round(c.price + d.price / -1000 / eurusd * 3.412142, 6) AS landed
FROM curves b JOIN curves c ON c.hub = 'H0' AND c.start = b.start JOIN curves d ON d.hub = 'H2' AND d.start = b.start JOIN fx ON fx.start = b.start WHERE b.hub = 'H1'""")
def import_floor(spark, sf_dir):
    c = curves(spark, sf_dir).withColumn("price", F.when(F.col("hub") == "H2", F.col("price") / -1000).otherwise(F.col("price")))
    return pn.import_floor(c, "hub", "H1", "H0", "H2", _fx(spark)).select("start", r("floor"), r("landed"))


@query("first_tenors", f"{_CURVES} SELECT hub, start, round(price, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY start) AS k FROM curves) WHERE k <= 24")
def first_tenors(spark, sf_dir):
    """The first 24 months of each curve."""
    return pn.first_tenors(curves(spark, sf_dir), ["hub"]).select("hub", "start", r("price"))


@query("synthetic_periods", f"""WITH {HUBS}, {_PERIODS}, w AS (SELECT hub, period, year(start) - shift AS y, avg(price) AS price, count(*) AS n FROM hubs JOIN members ON month(start) = m GROUP BY 1, 2, 3)
SELECT hub, w.period || '_' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS tenor, round(price, 6) AS price FROM w JOIN (SELECT period, count(*) AS size FROM members GROUP BY 1) s ON w.period = s.period AND n = size""")
def synthetic_periods(spark, sf_dir):
    return pn.synthetic_periods(hubs(spark, sf_dir), ["hub"]).select("hub", "tenor", r("price"))


@query("outright_prices", f"WITH {HUBS} SELECT s.hub, s.start, round(s.price + h.price, 6) AS price FROM hubs s JOIN hubs h ON h.hub = 'H0' AND h.start = s.start WHERE s.hub <> 'H0'")
def outright_prices(spark, sf_dir):
    h = hubs(spark, sf_dir)
    return pn.added(h.where("hub <> 'H0'"), h.where("hub = 'H0'"), ["start"], "price").select("hub", "start", r("price"))


@query("off_peak_prices", f"""WITH {HUBS} SELECT b.start, round((24 * 30 * b.price - 12 * 22 * p.price) / (24 * 30 - 12 * 22), 6) AS price FROM hubs b JOIN hubs p ON p.hub = 'H1' AND p.start = b.start WHERE b.hub = 'H0'""")
def off_peak_prices(spark, sf_dir):
    """Off-peak prices of months of 30 days with 22 workdays of 12 peak hours."""
    h = hubs(spark, sf_dir)
    rows = h.where("hub = 'H0'").select("start", F.col("price").alias("base")).join(h.where("hub = 'H1'").select("start", F.col("price").alias("peak")), "start")
    return rows.select("start", F.round(curve.off_peak(F.col("base"), F.col("peak"), F.lit(12.0 * 22), F.lit(24.0 * 30 - 12 * 22)), 6).alias("price"))


@query("relative_prices", f"""WITH {OBS}, t AS (SELECT *, {_AHEAD} AS ahead FROM obs), s AS (SELECT *, max(CAST(ahead = 1 AS INTEGER)) OVER (PARTITION BY lsu, d) AS has1, max(CAST(ahead = 2 AS INTEGER)) OVER (PARTITION BY lsu, d) AS has2 FROM t),
u AS (SELECT 1 AS first, lsu, d, ahead - 1 + has1 AS m, price FROM s UNION ALL SELECT 2, lsu, d, ahead - 2 + has2, price FROM s) SELECT first, lsu, d, m, round(price, 6) AS price FROM u WHERE m BETWEEN 1 AND 24""")
def relative_prices(spark, sf_dir):
    """Contract months numbered from each day, with the next month or the one after it as first."""
    o = observations(spark, sf_dir)
    both = [pn.relative_tenors(o, ["lsu"], "d", "contract", "price", first).withColumn("first", F.lit(first)) for first in (1, 2)]
    return both[0].unionByName(both[1]).select("first", "lsu", "d", "m", r("price"))


@query("relative_returns", f"""WITH {OBS} SELECT a.lsu, a.d, k, round(sqrt(365 / 7.0) * (ln(a.price) - ln(b.price)), 6) AS ret FROM (SELECT *, (year(contract) - year(d + 3)) * 12 + month(contract) - month(d + 3) AS k FROM obs) a
JOIN obs b ON a.lsu = b.lsu AND a.contract = b.contract AND a.d = b.d + 7 WHERE k BETWEEN 1 AND 3""")
def relative_returns(spark, sf_dir):
    """Annualised weekly log returns of the next three contracts, rolled three days before month end."""
    returns = pn.windowed_returns(observations(spark, sf_dir), ["lsu", "contract"], "d", "price", 7)
    return pn.relative_returns(returns, ["lsu"], "d", "contract", 3, 3).select("lsu", "d", "k", r("ret"))


@query("relative_vols", f"""WITH {OBS} SELECT a.lsu, k, count(*) AS n, round(stddev_samp(sqrt(365 / 7.0) * (a.price - b.price)), 4) AS vol FROM (SELECT *, {_AHEAD} AS k FROM obs) a
JOIN obs b ON a.lsu = b.lsu AND a.contract = b.contract AND a.d = b.d + 7 WHERE k BETWEEN 1 AND 3 GROUP BY 1, 2""")
def relative_vols(spark, sf_dir):
    """Normal volatility of the next three contracts."""
    returns = pn.windowed_returns(observations(spark, sf_dir), ["lsu", "contract"], "d", "price", 7, normal=True)
    return pn.relative_returns(returns, ["lsu"], "d", "contract", 3).groupBy("lsu", "k").agg(F.count("*").alias("n"), F.round(F.stddev_samp("ret"), 4).alias("vol"))


_BAD = f"{OBS}, q AS (SELECT lsu, d, contract, CASE WHEN day(d) % 7 = 0 THEN NULL WHEN day(d) % 11 = 0 THEN 0.0 ELSE price END AS price FROM obs)"


def _bad(spark, sf_dir):
    day = F.dayofmonth("d")
    return observations(spark, sf_dir).withColumn("price", F.when(day % 7 == 0, None).when(day % 11 == 0, 0.0).otherwise(F.col("price")))


@query("bad_quotes", f"WITH {_BAD} SELECT lsu, d, contract, price FROM q WHERE price < 1e-7")
def bad_quotes(spark, sf_dir):
    return pn.bad_quotes(_bad(spark, sf_dir), "price")


@query("quoted_rows", f"WITH {_BAD} SELECT lsu, d, contract, round(price, 6) AS price FROM q JOIN (SELECT d FROM q GROUP BY 1 HAVING count(price) > 0) USING (d)")
def quoted_rows(spark, sf_dir):
    """Days without any quote go."""
    return pn.quoted(_bad(spark, sf_dir), ["d"], "price").select("lsu", "d", "contract", r("price"))


@query("oldest_pairs", f"""WITH {OBS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY lsu ORDER BY d) AS k FROM obs)
SELECT lsu, contract, round(coalesce(max(price) FILTER (k = 1), 0), 6) AS previous, round(coalesce(max(price) FILTER (k = 2), 0), 6) AS current FROM k GROUP BY 1, 2""")
def oldest_pairs(spark, sf_dir):
    return pn.oldest_pair(observations(spark, sf_dir), ["lsu"], "contract", "d", "price").select("lsu", "contract", r("previous"), r("current"))


_NEW = f"""{OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY lsu, contract ORDER BY d DESC) AS k FROM obs), p AS (SELECT lsu, contract, max(price) FILTER (k = 1) AS a, max(price) FILTER (k = 2) AS b, count(*) AS n FROM k WHERE k <= 2 GROUP BY 1, 2),
pair AS (SELECT lsu, contract, CASE WHEN n = 2 OR year(contract) > 1997 THEN a ELSE 0 END AS current, CASE WHEN n = 2 THEN b WHEN year(contract) > 1997 THEN 0 ELSE a END AS previous FROM p)"""


@query("newest_pairs", f"WITH {_NEW} SELECT lsu, contract, round(current, 6) AS current, round(previous, 6) AS previous FROM pair")
def newest_pairs(spark, sf_dir):
    return pn.newest_pair(observations(spark, sf_dir), ["lsu"], "contract", "d", "price", 1997).select("lsu", "contract", r("current"), r("previous"))


@query("discount_panel", f"""WITH {_NEW} SELECT contract, {', '.join(f"round(max(current) FILTER (lsu = 'U{i}'), 6) AS current{i}, round(max(previous) FILTER (lsu = 'U{i}'), 6) AS previous{i}" for i in range(3))} FROM pair GROUP BY 1""")
def discount_panel(spark, sf_dir):
    """Current and previous quotes of three sources side by side, for every month that any of them has."""
    pairs = pn.newest_pair(observations(spark, sf_dir), ["lsu"], "contract", "d", "price", 1997)
    own = lambda c, i: F.round(F.max(F.when(F.col("lsu") == f"U{i}", F.col(c))), 6).alias(f"{c}{i}")
    return pairs.groupBy("contract").agg(*[own(c, i) for i in range(3) for c in ("current", "previous")])


@query("month_axis", f"WITH {OBS} SELECT contract, row_number() OVER (ORDER BY contract DESC) AS place FROM (SELECT DISTINCT contract FROM obs)")
def month_axis(spark, sf_dir):
    """Distinct months, newest first."""
    from pyspark.sql import Window

    months = observations(spark, sf_dir).select("contract").distinct()  # as many as there are months
    return months.select("contract", F.row_number().over(Window.orderBy(F.desc("contract"))).alias("place"))


@query("spread_distribution", f"""WITH {OBS}, s AS (SELECT a.d, a.contract, a.price - b.price * 0.01 / (0.8 + month(a.d) / 100.0) / 0.0293001 AS v FROM obs a JOIN obs b ON a.d = b.d AND a.contract = b.contract WHERE a.lsu = 'U0' AND b.lsu = 'U1')
SELECT contract, count(*) AS n, round(min(v), 5) AS low, round(quantile_cont(v, 0.25), 5) AS lower, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS upper, round(max(v), 5) AS high, round(arg_max(v, d), 5) AS last FROM s GROUP BY 1""")
def spread_distribution(spark, sf_dir):
    """Spreads of two underlyings in one unit, by contract month, over all days that quote both."""
    o = observations(spark, sf_dir)
    own = lambda lsu, name: o.where(F.col("lsu") == lsu).select("d", "contract", F.col("price").alias(name))
    value = F.col("a") - pn.to_euro_mwh(F.col("b"), 0.8 + F.month("d") / 100.0)
    rows = own("U0", "a").join(own("U1", "b"), ["d", "contract"]).select("d", "contract", value.alias("v"))
    return pn.distribution(rows, ["contract"], "d", "v").select("contract", "n", *[r(c, 5) for c in ("low", "lower", "median", "upper", "high", "last")])


_LAG3 = "(PARTITION BY hub ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query("lagged_average_vols", f"""WITH {HUBS}, a AS (SELECT hub, start, CASE WHEN count(price) OVER {_LAG3} = 3 THEN avg(price) OVER {_LAG3} END AS mean FROM hubs),
x AS (SELECT hub, ln(mean / lag(mean) OVER (PARTITION BY hub ORDER BY start)) AS ret FROM a) SELECT hub, round(stddev_samp(ret) * sqrt(12), 7) AS vol FROM x GROUP BY 1""")
def lagged_average_vols(spark, sf_dir):
    """Yearly volatility of three-month averages that end a month ago."""
    rows = ts.rolling_mean(hubs(spark, sf_dir), ["hub"], "start", "price", 3, 1)
    rets = ts.lag_returns(rows, ["hub"], "start", "mean")
    return rets.groupBy("hub").agg(F.round(ts.annualised("ret", 12), 7).alias("vol"))


def _literal(sql_list):
    return ", ".join(f"('{c}', '{p}')" for c, p in sql_list)


_LISTS = f"""codes(kind, rank, c, p, place) AS (SELECT kind, rank, c, p, row_number() OVER (PARTITION BY kind) FROM (VALUES {', '.join(f"('M', 1, '{c}', '{m}')" for c, m in zip(tn.MONTH_CODES, tn.MONTHS))}, {', '.join(f"('Q', 2, '{c}', '{p}')" for c, p in pn.QUARTERS.items())}, {', '.join(f"('S', 3, '{c}', '{p}')" for c, p in pn.SEASONS.items())}, ('Y', 4, 'F', 'Y')) AS v(kind, rank, c, p))"""


@query("ticker_list", f"""WITH {_LISTS}, n AS (SELECT n_name AS commodity, 'C' || n_nationkey AS base, n_regionkey % 2 = 0 AS suffix, n_nationkey % 3 AS k, 26 AS y0 FROM nation),
t AS (SELECT commodity, kind, rank, y, place, base || kind || c || y || CASE WHEN suffix THEN kind ELSE '' END AS ticker, p || '_' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS label FROM n, codes, (SELECT unnest([26, 27, 28]) AS y) WHERE kind = 'M' OR k > 0)
SELECT commodity, kind, CAST(row_number() OVER (PARTITION BY commodity ORDER BY rank, y, place) - 1 AS INTEGER) AS position, ticker, label FROM t""")
def ticker_list(spark, sf_dir):
    """Tickers of all kinds for the commodities of 25 places; those of every third have months only."""
    base, longer = F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), F.col("n_nationkey") % 3 > 0
    of = lambda kind: F.when(longer, F.concat(base, F.lit(kind)))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("commodity"), F.concat(base, F.lit("M")).alias("code"), of("Q").alias("quarter"), of("S").alias("season"), of("Y").alias("year"), (F.col("n_regionkey") % 2 == 0).alias("suffix"), F.lit(26).alias("start_year"))
    return pn.ticker_list(rows, 3)


@query("currency_tickers", f"""WITH p AS (SELECT n_name AS pair, make_date(2026, CAST(n_nationkey % 12 + 1 AS INTEGER), 1) AS start FROM nation), m AS (SELECT unnest([0, {', '.join(map(str, pn.PILLARS))}]) AS m, unnest(generate_series(0, {len(pn.PILLARS)})) AS position)
SELECT pair, CAST(position AS INTEGER) AS position, pair || CASE WHEN m = 0 THEN '' ELSE m || 'M' END || ' Curncy' AS ticker, strftime(start + to_months(m), '%b_%y') AS label FROM p, m""")
def currency_tickers(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("pair"), F.make_date(F.lit(2026), (F.col("n_nationkey") % 12 + 1).cast("int"), F.lit(1)).alias("start"))
    return pn.currency_tickers(rows, " Curncy")


_ROLLS = "rolls AS (SELECT DISTINCT contract, contract - 5 AS last FROM obs)"


@query("generic_contracts", f"""WITH {OBS}, {_ROLLS}, days AS (SELECT DISTINCT d FROM obs), j AS (SELECT d, contract, row_number() OVER (PARTITION BY d ORDER BY contract) AS k FROM days JOIN rolls ON last >= d AND contract < d + 200) SELECT d, k, contract FROM j WHERE k <= 3""")
def generic_contracts(spark, sf_dir):
    """The first three contracts on each day, by their last trading days."""
    o = observations(spark, sf_dir)
    return pn.generic_contracts(o.select("d").distinct(), o.select("contract").distinct().withColumn("last", F.date_sub("contract", 5)), "d", 3)


@query("roll_dates", f"WITH {OBS} SELECT contract, max(d) AS last, count(DISTINCT d) AS days FROM obs GROUP BY 1")
def roll_dates(spark, sf_dir):
    """Last trading day of each contract."""
    return observations(spark, sf_dir).groupBy("contract").agg(F.max("d").alias("last"), F.count_distinct("d").alias("days"))


@query("curve_on_day", f"WITH {OBS} SELECT lsu, contract, round(price, 6) AS price FROM obs WHERE d = (SELECT max(d) FROM obs)")
def curve_on_day(spark, sf_dir):
    """All contracts of the newest day; its date, one value, is found first."""
    o = observations(spark, sf_dir)
    day = o.agg(F.max("d")).first()[0]
    return o.where(F.col("d") == F.lit(day)).select("lsu", "contract", r("price"))


_SURFACE = "g AS (SELECT n_nationkey AS id, 100.0 AS f, 70.0 + 10 * i AS k, 0.25 * j AS t, 0.2 + n_nationkey / 200.0 + (i - 3) * (i - 3) / 400.0 + 0.02 / j AS v FROM nation, (SELECT unnest(range(7)) AS i), (SELECT unnest(range(1, 6)) AS j))"


@query("local_vols", f"""WITH {_SURFACE}, x AS (SELECT *, ln(k / f) AS m, v * v * t AS w FROM g), n AS (SELECT *, lag(m) OVER a AS m0, lead(m) OVER a AS m1, lag(w) OVER a AS w0, lead(w) OVER a AS w1, lag(t) OVER b AS t0, lead(t) OVER b AS t1, lag(w) OVER b AS v0, lead(w) OVER b AS v1 FROM x WINDOW a AS (PARTITION BY id, t ORDER BY k), b AS (PARTITION BY id, k ORDER BY t)),
d AS (SELECT *, (w1 - w) / (m1 - m) * (m - m0) / (m1 - m0) + (w - w0) / (m - m0) * (m1 - m) / (m1 - m0) AS s, 2 * ((w1 - w) / (m1 - m) - (w - w0) / (m - m0)) / (m1 - m0) AS c, (v1 - v0) / (t1 - t0) AS r FROM n), e AS (SELECT *, 1 - m / w * s + (-0.25 - 1 / w + m * m / (w * w)) * s * s / 4 + c / 2 AS q FROM d)
SELECT id, k, t, CASE WHEN q > 1e-12 AND r > 0 THEN round(sqrt(r / q), 7) END AS local_vol FROM e""")
def local_vols(spark, sf_dir):
    """Local volatilities of 25 grids of implied ones."""
    i, j = F.explode(F.sequence(F.lit(0), F.lit(6))), F.explode(F.sequence(F.lit(1), F.lit(5)))
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), i.alias("i")).select("id", "i", j.alias("j"))
    g = g.select("id", F.lit(100.0).alias("f"), (70.0 + 10 * F.col("i")).alias("k"), (0.25 * F.col("j")).alias("t"), (0.2 + F.col("id") / 200.0 + (F.col("i") - 3) * (F.col("i") - 3) / 400.0 + 0.02 / F.col("j")).alias("v"))
    return curve.local_vols(g, ["id"], "f", "k", "t", "v").select("id", "k", "t", F.round("local_vol", 7).alias("local_vol"))


dated("start", "hub_curves", "hub_spreads", "import_floor", "first_tenors", "outright_prices", "off_peak_prices")
dated("d", "relative_prices", "relative_returns")
dated("d contract", "bad_quotes", "quoted_rows", "generic_contracts")
dated("contract", "oldest_pairs", "newest_pairs", "discount_panel", "month_axis", "spread_distribution", "curve_on_day")
dated("contract last", "roll_dates")
