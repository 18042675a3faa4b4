"""Queries on price series and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import asof, panels as pn, timeseries as ts
from fathomline.plans.mapping import BARS, PRICES, bars, prices
from fathomline.plans.registry import dated, query
from fathomline.sources.files import table


def r(c: str, n: int = 9):
    return F.round(c, n).alias(c)


_LAG = "lag(price) OVER (PARTITION BY ticker ORDER BY d)"


@query("log_returns", f"WITH {PRICES} SELECT ticker, d, round(CASE WHEN price > 0 AND {_LAG} > 0 THEN ln(price / {_LAG}) END, 9) AS ret FROM prices")
def log_returns(spark, sf_dir):
    return ts.lag_returns(prices(spark, sf_dir), ["ticker"], "d", "price").select("ticker", "d", r("ret"))


@query("lead_differences", f"WITH {PRICES} SELECT ticker, d, round(price - lead(price) OVER (PARTITION BY ticker ORDER BY d), 9) AS ret FROM prices")
def lead_differences(spark, sf_dir):
    return ts.lag_returns(prices(spark, sf_dir), ["ticker"], "d", "price", "difference", lead=True).select("ticker", "d", r("ret"))


@query("calendar_lag_returns", f"WITH {PRICES} SELECT a.ticker, a.d, round(ln(a.price / b.price), 9) AS ret FROM prices a JOIN prices b ON a.ticker = b.ticker AND a.d = b.d + 7 WHERE a.price > 0 AND b.price > 0")
def calendar_lag_returns(spark, sf_dir):
    return ts.calendar_returns(prices(spark, sf_dir), ["ticker"], "d", "price", 7).select("ticker", "d", r("ret")).where("ret is not null")


_GAPS = f"{PRICES}, gaps AS (SELECT ticker, d, CASE WHEN day(d) % 3 = 0 THEN NULL ELSE price END AS price FROM prices)"


def _gaps(spark, sf_dir):
    return prices(spark, sf_dir).withColumn("price", F.when(F.dayofmonth("d") % 3 != 0, F.col("price")))


@query("forward_fill", f"WITH {_GAPS} SELECT ticker, d, round(last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS price FROM gaps")
def forward_fill(spark, sf_dir):
    return ts.filled(_gaps(spark, sf_dir), ["ticker"], "d", "price").select("ticker", "d", r("price"))


@query("backward_fill", f"WITH {_GAPS} SELECT ticker, d, round(first_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS price FROM gaps")
def backward_fill(spark, sf_dir):
    return ts.filled(_gaps(spark, sf_dir), ["ticker"], "d", "price", backward=True, descending=True).select("ticker", "d", r("price"))


_M3 = "(PARTITION BY ticker ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_M3L = "(PARTITION BY ticker ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query("rolling_mean", f"WITH {PRICES} SELECT ticker, d, round(CASE WHEN count(price) OVER {_M3} = 3 THEN avg(price) OVER {_M3} END, 9) AS mean FROM prices")
def rolling_mean(spark, sf_dir):
    return ts.rolling_mean(prices(spark, sf_dir), ["ticker"], "d", "price", 3).select("ticker", "d", r("mean"))


@query("lagged_mean", f"WITH {PRICES} SELECT ticker, d, round(CASE WHEN count(price) OVER {_M3L} = 3 THEN avg(price) OVER {_M3L} END, 9) AS mean FROM prices")
def lagged_mean(spark, sf_dir):
    return ts.rolling_mean(prices(spark, sf_dir), ["ticker"], "d", "price", 3, lag=1).select("ticker", "d", r("mean"))


_PAIR = f"{PRICES}, pair AS (SELECT a.d, a.price AS x, b.price AS y FROM prices a JOIN prices b ON a.d = b.d WHERE a.ticker = 'click' AND b.ticker = 'view')"


def _pair(spark, sf_dir):
    p = prices(spark, sf_dir)
    return p.where("ticker = 'click'").select("d", F.col("price").alias("x")).join(p.where("ticker = 'view'").select("d", F.col("price").alias("y")), "d")


@query("rolling_corr", f"WITH {_PAIR} SELECT d, round(CASE WHEN row_number() OVER (ORDER BY d) > 11 THEN corr(x, y) OVER (ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END, 7) AS corr FROM pair")
def rolling_corr(spark, sf_dir):
    rows = _pair(spark, sf_dir).withColumn("pair", F.lit("click-view"))
    return ts.rolling_corr(rows, ["pair"], "d", "x", "y", 10).select("d", r("corr", 7))


@query("monthly_mean", f"WITH {PRICES} SELECT ticker, last_day(d) AS month, round(avg(price), 9) AS price FROM prices GROUP BY 1, 2")
def monthly_mean(spark, sf_dir):
    return ts.monthly_mean(prices(spark, sf_dir), ["ticker"], "d", "price").select("ticker", "month", r("price"))


@query("daily_bars", f"WITH {BARS} SELECT * FROM bars")
def daily_bars(spark, sf_dir):
    return bars(spark, sf_dir)


_TR = f"{BARS}, tr AS (SELECT *, greatest(abs(high - low), coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY d))"


@query("true_range", f"WITH {_TR} SELECT instrument, d, round(tr, 9) AS tr FROM tr")
def true_range(spark, sf_dir):
    return ts.true_range(bars(spark, sf_dir), ["instrument"], "d").select("instrument", "d", r("tr"))


@query("wilder_mean", f"""WITH RECURSIVE {_TR}, n AS (SELECT instrument, d, tr, row_number() OVER (PARTITION BY instrument ORDER BY d) AS k FROM tr),
m AS (SELECT instrument, d, k, tr AS rma FROM n WHERE k = 1 UNION ALL SELECT n.instrument, n.d, n.k, m.rma + (n.tr - m.rma) / 14 FROM m JOIN n ON m.instrument = n.instrument AND n.k = m.k + 1)
SELECT instrument, d, round(rma, 7) AS rma FROM m""")
def wilder_mean(spark, sf_dir):
    tr = ts.true_range(bars(spark, sf_dir), ["instrument"], "d")
    return ts.wilder_mean(tr, ["instrument"], "d", "tr", 14).select("instrument", "d", r("rma", 7))


_RMA = f"""{_TR}, n AS (SELECT instrument, d, tr, row_number() OVER (PARTITION BY instrument ORDER BY d) AS k FROM tr),
m AS (SELECT instrument, d, k, tr AS rma FROM n WHERE k = 1 UNION ALL SELECT n.instrument, n.d, n.k, m.rma + (n.tr - m.rma) / 14 FROM m JOIN n ON m.instrument = n.instrument AND n.k = m.k + 1)"""


@query("volume_waves", f"""WITH RECURSIVE {_RMA}, b AS (SELECT bars.instrument, bars.d, k, close, rma, volume FROM bars JOIN m ON bars.instrument = m.instrument AND bars.d = m.d),
w AS (SELECT instrument, d, k, close AS lvl, 0 AS dir, volume AS total FROM b WHERE k = 1 UNION ALL
SELECT instrument, d, k, new, turn, CASE WHEN turn = dir THEN total + volume ELSE volume END FROM (SELECT *, CASE WHEN new > lvl THEN 1 WHEN new < lvl THEN -1 ELSE dir END AS turn
FROM (SELECT b.instrument, b.d, b.k, w.lvl, w.dir, w.total, b.volume, CASE WHEN b.close > w.lvl + b.rma OR b.close < w.lvl - b.rma THEN b.close ELSE w.lvl END AS new FROM w JOIN b ON w.instrument = b.instrument AND b.k = w.k + 1)))
SELECT instrument, d, round(lvl, 7) AS wave_close, dir AS direction, 1 AS wave_bars, round(total, 7) AS wave_volume FROM w""")
def volume_waves(spark, sf_dir):
    tr = ts.true_range(bars(spark, sf_dir), ["instrument"], "d")
    return ts.waves(ts.wilder_mean(tr, ["instrument"], "d", "tr", 14), ["instrument"], "d", "rma").select("instrument", "d", r("wave_close", 7), "direction", "wave_bars", r("wave_volume", 7))


@query("annual_vols", f"""WITH {PRICES}, a AS (SELECT ticker, ln(price / {_LAG}) AS ret, price - {_LAG} AS dif FROM prices WHERE price > 0)
SELECT ticker, round(stddev_samp(ret) * sqrt(252), 7) AS daily, round(stddev_samp(dif) * sqrt(52), 7) AS weekly, round(stddev_pop(ret) * sqrt(365), 7) AS population FROM a GROUP BY 1""")
def annual_vols(spark, sf_dir):
    rets = ts.lag_returns(prices(spark, sf_dir).where("price > 0"), ["ticker"], "d", "price")
    rets = ts.lag_returns(rets.withColumnRenamed("ret", "log"), ["ticker"], "d", "price", "difference")
    return rets.groupBy("ticker").agg(F.round(ts.annualised("log", 252), 7).alias("daily"), F.round(ts.annualised("ret", 52), 7).alias("weekly"), F.round(ts.annualised("log", 365, True), 7).alias("population"))


@query("monthly_vols", f"""WITH {PRICES}, a AS (SELECT ticker, last_day(d) AS month, ln(price / lead(price) OVER (PARTITION BY ticker, last_day(d) ORDER BY d)) AS ret FROM prices WHERE price > 0),
b AS (SELECT ticker, month, stddev_samp(ret) * sqrt(252) AS vol FROM a GROUP BY 1, 2) SELECT ticker, round(avg(vol), 7) AS vol FROM b GROUP BY 1""")
def monthly_vols(spark, sf_dir):
    """Mean of the volatilities of single months."""
    rows = prices(spark, sf_dir).where("price > 0").withColumn("month", F.last_day("d"))
    vols = ts.lag_returns(rows, ["ticker", "month"], "d", "price", lead=True).groupBy("ticker", "month").agg(ts.annualised("ret", 252).alias("vol"))
    return vols.groupBy("ticker").agg(F.round(F.avg("vol"), 7).alias("vol"))


_RETS = f"{PRICES}, rets AS (SELECT ticker, d, CASE WHEN price > 0 AND {_LAG} > 0 THEN ln(price / {_LAG}) END AS ret FROM prices)"


@query("return_corr", f"WITH {_RETS} SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round(corr(a.ret, b.ret), 7) AS corr FROM rets a JOIN rets b ON a.d = b.d WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def return_corr(spark, sf_dir):
    rets = ts.lag_returns(prices(spark, sf_dir), ["ticker"], "d", "price")
    return ts.pairwise_corr(rets, "ticker", "d").withColumn("corr", F.round("corr", 7))


@query("recent_corr", f"""WITH {_RETS}, t AS (SELECT ticker, d, ret FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM rets WHERE ret IS NOT NULL) WHERE k <= 20)
SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round(greatest(-0.9999, least(0.9999, corr(a.ret, b.ret))), 7) AS corr FROM t a JOIN t b ON a.d = b.d GROUP BY 1, 2 HAVING count(*) >= 10""")
def recent_corr(spark, sf_dir):
    rets = ts.lag_returns(prices(spark, sf_dir), ["ticker"], "d", "price").where("ret is not null")
    return ts.pairwise_corr(ts.last_rows(rets, ["ticker"], "d", 20), "ticker", "d", least=10, clip=0.9999).withColumn("corr", F.round("corr", 7))


@query("current_previous", f"WITH {PRICES}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM prices) SELECT ticker, round(max(price) FILTER (k = 1), 9) AS current, round(max(price) FILTER (k = 2), 9) AS previous FROM k GROUP BY 1")
def current_previous(spark, sf_dir):
    return ts.current_and_previous(prices(spark, sf_dir), ["ticker"], "d", "price").select("ticker", r("current"), r("previous"))


@query("last_rows", f"WITH {PRICES} SELECT ticker, d FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM prices) WHERE k <= 5")
def last_rows(spark, sf_dir):
    return ts.last_rows(prices(spark, sf_dir), ["ticker"], "d", 5).select("ticker", "d")


@query("value_histogram", "SELECT CAST(least(floor(value / 10), 9) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def value_histogram(spark, sf_dir):
    return ts.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10)


@query("period_averages", """WITH m AS (SELECT l_returnflag AS ticker, year(l_shipdate) AS y, month(l_shipdate) AS month, avg(l_extendedprice / l_quantity) AS price FROM lineitem WHERE NOT (l_returnflag = 'A' AND month(l_shipdate) = 5) GROUP BY 1, 2, 3)
SELECT ticker, y, 'Q' || ((month + 2) // 3) AS period, round(avg(price), 6) AS price FROM m GROUP BY 1, 2, 3 HAVING count(*) = 3""")
def period_averages(spark, sf_dir):
    """Quarters of each kind of order line whose months all have a price; one kind lacks every May."""
    d = F.col("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").where(~((F.col("l_returnflag") == "A") & (F.month(d) == 5)))
    months = lines.groupBy(F.col("l_returnflag").alias("ticker"), F.year(d).cast("long").alias("y"), F.month(d).alias("month")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    members = spark.createDataFrame([(f"Q{(m + 2) // 3}", m, 3) for m in range(1, 13)], "period string, month int, size int")
    return ts.composite(months, members, ["ticker", "y"], "month", "price").select("ticker", "y", "period", F.round("price", 6).alias("price"))


@query("longest_dated", f"""WITH t AS (SELECT event_type, CAST(ts AS DATE) AS d, arg_max(value, struct_pack(a := user_id, b := event_id)) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS k FROM t) SELECT event_type, round(avg(v), 9) AS value FROM k WHERE k <= 5 GROUP BY 1""")
def longest_dated(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return ts.longest_dated(rows, ["event_type"], "d", F.struct("user_id", "event_id"), "value", 5).select("event_type", r("value"))


@query("coverage", f"""WITH {PRICES} SELECT ticker, date_diff('day', DATE '2024-01-01', min(d)) <= 10 AS starts, date_diff('day', max(d), DATE '2024-01-31') <= 10 AS ends,
count(DISTINCT d) FILTER (isodow(d) < 6) >= 0.7 * 23 AS dense FROM prices WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1""")
def coverage(spark, sf_dir):
    return ts.coverage(prices(spark, sf_dir), ["ticker"], "d", "2024-01-01", "2024-01-31", 10, 0.7)


@query("missing_values", f"WITH {_GAPS} SELECT ticker, count(*) AS n, count(*) - count(price) AS missing FROM gaps GROUP BY 1")
def missing_values(spark, sf_dir):
    return ts.missing(_gaps(spark, sf_dir), ["ticker"], "price")


@query("marginal_ticker", f"WITH {PRICES}, s AS (SELECT ticker, d, price - 50 AS v FROM prices) SELECT d, round(min(v), 9) AS low, round(avg(v), 9) AS mean, round(max(v), 9) AS high, arg_min(ticker, struct_pack(a := abs(v), b := ticker)) AS marginal FROM s GROUP BY 1")
def marginal_ticker(spark, sf_dir):
    rows = prices(spark, sf_dir).withColumn("v", F.col("price") - 50)
    return ts.nearest_zero(rows, ["d"], "ticker", "v").select("d", r("low"), r("mean"), r("high"), "marginal")


@query("ticker_columns", f"WITH {PRICES} SELECT d, round(sum(price) FILTER (ticker = 'click'), 9) AS click, round(sum(price) FILTER (ticker = 'view'), 9) AS view FROM prices WHERE ticker IN ('click', 'view') GROUP BY 1 HAVING count(*) = 2")
def ticker_columns(spark, sf_dir):
    """Series side by side on the days that have both."""
    wide = prices(spark, sf_dir).groupBy("d").pivot("ticker", ["click", "view"]).agg(F.first("price")).dropna("any")
    return wide.select("d", r("click"), r("view"))


@query("selected_sums", "SELECT CAST(ts AS DATE) AS d, round(sum(value) FILTER (event_type IN ('click', 'view')), 6) AS total FROM events GROUP BY 1")
def selected_sums(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.round(F.sum(F.when(F.col("event_type").isin("click", "view"), F.col("value"))), 6).alias("total"))


@query("first_of_month", f"WITH {PRICES} SELECT ticker, last_day(d) AS month, round(arg_max(price, d), 9) AS price FROM prices GROUP BY 1, 2")
def first_of_month(spark, sf_dir):
    """Newest price of each calendar month."""
    return prices(spark, sf_dir).groupBy("ticker", F.last_day("d").alias("month")).agg(F.round(F.max_by("price", "d"), 9).alias("price"))


@query("spread_common_days", f"WITH {PRICES} SELECT a.d, round(a.price - 1.15 * b.price, 9) AS price FROM prices a JOIN prices b ON a.d = b.d WHERE a.ticker = 'click' AND b.ticker = 'view'")
def spread_common_days(spark, sf_dir):
    p = prices(spark, sf_dir)
    own = lambda t: p.where(F.col("ticker") == t).select("d", "price")
    return asof.spread(own("click"), own("view"), ["d"], "price", 1.15).select("d", r("price"))


@query("market_filter", f"WITH {PRICES} SELECT ticker, d, round(price * 0.01 / 0.85 / 0.0293001, 9) AS price FROM prices WHERE ticker IN ('click', 'purchase') AND d > DATE '2024-01-05'")
def market_filter(spark, sf_dir):
    """Chosen markets after a date, converted from pence a therm to euros a megawatt hour."""
    rows = prices(spark, sf_dir).where(F.col("ticker").isin("click", "purchase") & (F.col("d") > "2024-01-05"))
    return rows.select("ticker", "d", F.round(F.col("price") * 0.01 / 0.85 / 0.0293001, 9).alias("price"))


_FX = "fx AS (SELECT DISTINCT CAST(ts AS DATE) AS fd, CAST(day(CAST(ts AS DATE)) AS DOUBLE) AS rate FROM events WHERE day(CAST(ts AS DATE)) % 4 = 1)"


def _fx(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("fd")).distinct().where(F.dayofmonth("fd") % 4 == 1).select("fd", F.dayofmonth("fd").cast("double").alias("rate"))


@query("asof_backward", f"WITH {PRICES}, {_FX} SELECT p.ticker, p.d, f.fd AS fd_asof, f.rate FROM prices p ASOF LEFT JOIN fx f ON p.d >= f.fd")
def asof_backward(spark, sf_dir):
    return asof.asof(prices(spark, sf_dir).select("ticker", "d"), _fx(spark, sf_dir), "d", "fd", "rate")


_KNOWN = """q AS (SELECT o_orderpriority AS g, l_returnflag AS kind, CAST(o_orderdate AS DATE) AS v, CAST(o_orderdate AS DATE) + CAST(l_linenumber * l_linenumber AS INTEGER) AS k, l_extendedprice / l_quantity / 97 AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT DISTINCT o_orderpriority AS g, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(2 + 20 * unnest([0, 1]) AS INTEGER) AS seen FROM orders),
n AS (SELECT a.g, kind, d, seen, max(v) AS v FROM a JOIN q ON a.g = q.g AND q.v BETWEEN d - 7 AND d AND q.k <= seen GROUP BY ALL),
w AS (SELECT n.g, n.kind, d, seen, n.v, q.k, max(x) AS x, row_number() OVER (PARTITION BY n.g, n.kind, d, seen ORDER BY q.k DESC) AS i FROM n JOIN q ON q.g = n.g AND q.kind = n.kind AND q.v = n.v AND q.k <= seen GROUP BY n.g, n.kind, d, seen, n.v, q.k)"""


def known_quotes(spark, sf_dir, kind: str):
    """Questions on every order day, as known two and 22 days later, and quotes of one kind with their corrections."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == kind)  # noqa: E741
    day = F.to_date("o_orderdate")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    quotes = rows.select(F.col("o_orderpriority").alias("g"), day.alias("v"), F.date_add(day, (F.col("l_linenumber") * F.col("l_linenumber")).cast("int")).alias("k"), (F.col("l_extendedprice") / F.col("l_quantity") / 97).alias("x"))
    asked = o.select(F.col("o_orderpriority").alias("g"), day.alias("d")).distinct().select("g", "d", F.explode(F.array(F.date_add("d", 2), F.date_add("d", 22))).alias("seen"))
    return asked, quotes


@query("known_rates", f"""WITH {_KNOWN} SELECT a.g, a.d, a.seen, s.v, s.k, round(s.x, 6) AS spot, round(s.x + p.x / 10000, 6) AS forward FROM a LEFT JOIN (SELECT * FROM w WHERE i = 1 AND kind = 'N') s ON s.g = a.g AND s.d = a.d AND s.seen = a.seen
LEFT JOIN (SELECT * FROM w WHERE i = 1 AND kind = 'R') p ON p.g = a.g AND p.d = a.d AND p.seen = a.seen""")
def known_rates(spark, sf_dir):
    """Spot rates and forwards (spot plus points) as they were known two and 22 days after each day: later questions see corrections."""
    asked, spot = known_quotes(spark, sf_dir, "N")
    _, points = known_quotes(spark, sf_dir, "R")
    got = asof.known_asof(asked, spot, ["g"], "d", "seen", "v", "k", "x", 7)
    other = asof.known_asof(asked, points, ["g"], "d", "seen", "v", "k", "x", 7).select("g", "d", "seen", F.col("x").alias("points"))
    rate = pn.outright_rate(F.col("x"), F.col("points"))
    return got.join(other, ["g", "d", "seen"]).select("g", "d", "seen", "v", "k", F.round("x", 6).alias("spot"), F.round(rate, 6).alias("forward"))


@query("asof_forward", f"WITH {PRICES}, {_FX} SELECT p.ticker, p.d, f.fd AS fd_asof, f.rate FROM prices p ASOF LEFT JOIN fx f ON p.d <= f.fd")
def asof_forward(spark, sf_dir):
    return asof.asof(prices(spark, sf_dir).select("ticker", "d"), _fx(spark, sf_dir), "d", "fd", "rate", forward=True)


@query("history_stitch", f"""WITH {PRICES}, a AS (SELECT ticker, d, price FROM prices WHERE d >= DATE '2024-01-15'), b AS (SELECT ticker, d, price + 1 AS price FROM prices)
SELECT ticker, d, round(price, 9) AS price FROM a UNION ALL SELECT b.ticker, b.d, round(b.price, 9) FROM b LEFT JOIN (SELECT ticker, min(d) AS f FROM a GROUP BY 1) m USING (ticker) WHERE f IS NULL OR b.d < f""")
def history_stitch(spark, sf_dir):
    p = prices(spark, sf_dir)
    return asof.stitched(p.where("d >= '2024-01-15'"), p.withColumn("price", F.col("price") + 1), "d", ["ticker"]).select("ticker", "d", r("price"))


@query("series_override", f"WITH {PRICES} SELECT ticker, d, round(CASE WHEN ticker IN ('view') THEN price * 2 ELSE price END, 9) AS price FROM prices")
def series_override(spark, sf_dir):
    p = prices(spark, sf_dir)
    return asof.overridden(p, p.withColumn("price", F.col("price") * 2), ["ticker", "d"], "price", F.col("ticker").isin("view")).select("ticker", "d", r("price"))


dated("d seen v k", "known_rates")
dated("d", "log_returns", "lead_differences", "calendar_lag_returns", "forward_fill", "backward_fill", "rolling_mean", "lagged_mean", "rolling_corr", "daily_bars", "true_range", "wilder_mean", "volume_waves")
dated("d", "last_rows", "marginal_ticker", "ticker_columns", "selected_sums", "spread_common_days", "market_filter", "history_stitch", "series_override")
dated("month", "monthly_mean", "first_of_month")
dated("d fd_asof", "asof_backward", "asof_forward")
