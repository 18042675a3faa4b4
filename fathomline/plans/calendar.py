"""Queries on dates, tenors and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import tenor as tn
from fathomline.operators import asof, curve
from fathomline.plans.registry import dated, query
from fathomline.sources.files import table

_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query("tenor_labels", f"""WITH {_DAYS} SELECT d, strftime(d, '%b_%y') AS label, month(d) AS number, strftime(d, '%b') AS name,
CAST(date_trunc('month', d) AS DATE) AS start, strftime(d, '%Y%m%d') AS compact, substr('FGHJKMNQUVXZ', month(d), 1) || (year(d) % 10) AS code,
strftime(date_trunc('month', d + 3) + INTERVAL 2 MONTH, '%b_%y') AS second FROM days""")
def tenor_labels(spark, sf_dir):
    d = F.col("d")
    return _days(spark, sf_dir).select(
        "d", tn.tenor_label(d).alias("label"), tn.month_number(tn.month_name(F.month(d))).cast("long").alias("number"), tn.month_name(F.month(d)).alias("name"), F.trunc(d, "MM").alias("start"), tn.compact_date(d).alias("compact"), tn.contract_code(d).alias("code"), tn.contract_label(d, F.lit(2), 3).alias("second")
    )


@query("weekdays", f"""WITH {_DAYS} SELECT d, isodow(d) < 6 AS weekday, d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS previous,
d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS on_or_after,
d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS on_or_before FROM days""")
def weekdays(spark, sf_dir):
    d = F.col("d")
    return _days(spark, sf_dir).select("d", tn.is_weekday(d).alias("weekday"), tn.previous_weekday(d).alias("previous"), tn.next_weekday(d).alias("next"), tn.this_or_next_weekday(d).alias("on_or_after"), tn.this_or_previous_weekday(d).alias("on_or_before"))


@query("workday_counts", f"""WITH {_DAYS} SELECT d, CAST((SELECT count(*) FROM (SELECT unnest(generate_series(CAST(d AS TIMESTAMP), CAST(d + 45 AS TIMESTAMP), INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6) AS BIGINT) AS n FROM days""")
def workday_counts(spark, sf_dir):
    return _days(spark, sf_dir).select("d", tn.workdays(F.col("d"), F.date_add("d", 45)).alias("n"))


@query("workday_offset", f"""WITH {_DAYS}, b AS (SELECT d, d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS f FROM days)
SELECT d, f + 35 AS later FROM b""")
def workday_offset(spark, sf_dir):
    """25 weekdays on."""
    return _days(spark, sf_dir).select("d", tn.add_workdays(F.col("d"), 25).alias("later"))


@query("month_offsets", f"""WITH {_DAYS} SELECT d, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) + 14 AS fifteenth, CAST(date_trunc('month', d) + INTERVAL 3 MONTH AS DATE) AS third,
make_date(year(d) + 1, 2, 5) AS overflow, (1999 - year(d)) * 12 + 6 - month(d) AS apart FROM days""")
def month_offsets(spark, sf_dir):
    d = F.col("d")
    return _days(spark, sf_dir).select("d", tn.nth_of_next_month(d, F.lit(15)).alias("fifteenth"), tn.nth_of_month_ahead(d, F.lit(1), F.lit(3)).alias("third"), tn.date_with_overflow(F.year(d), F.lit(14), F.lit(5)).alias("overflow"), tn.months_apart(d, F.lit("1999-06-01").cast("date")).cast("long").alias("apart"))


@query("clock_changes", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), s AS (SELECT y, make_date(y, 3, 31) AS a, make_date(y, 10, 31) AS b FROM y)
SELECT y, a - CAST(isodow(a) % 7 AS INTEGER) AS starts, b - CAST(isodow(b) % 7 AS INTEGER) AS ends FROM s""")
def clock_changes(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct()
    y = F.col("y").cast("int")
    return years.select("y", tn.dst_start(y).alias("starts"), tn.dst_end(y).alias("ends"))


@query("serial_dates", f"WITH {_DAYS} SELECT d, CAST(date_diff('day', DATE '1980-01-01', d) + 29221 AS DOUBLE) AS serial, d AS back, date_diff('day', d, DATE '1999-01-01') / 365.0 AS years FROM days")
def serial_dates(spark, sf_dir):
    d = F.col("d")
    serial = tn.to_serial(d)
    return _days(spark, sf_dir).select("d", serial.alias("serial"), tn.from_serial(serial).alias("back"), tn.years_between(d, F.lit("1999-01-01").cast("date")).alias("years"))


_TEXTS = "texts AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CASE o_custkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y%m%d') ELSE 'n/a' END AS t FROM orders)"


@query("parsed_dates", f"WITH {_TEXTS} SELECT t, CASE WHEN t <> 'n/a' THEN d END AS parsed FROM texts GROUP BY ALL")
def parsed_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_custkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd-MMM-yyyy")).when(k == 3, F.concat(F.lit(" "), F.date_format(d, "yyyyMMdd"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select(text.alias("t")).distinct().select("t", tn.parse_date(F.col("t")).alias("parsed"))


#: Quotes from orders: prices of the months of 1995 and of early 1996, and of 1996 as a year, 30 years on.
_QUOTES = """rows AS (SELECT CASE WHEN o_orderdate < DATE '1996-04-01' THEN strftime(o_orderdate, '%b_') || (year(o_orderdate) + 30) % 100 END AS month, CASE WHEN year(o_orderdate) = 1996 THEN 'Y_26' END AS y, o_totalprice / 10000 AS p FROM orders WHERE year(o_orderdate) IN (1995, 1996)),
quotes AS (SELECT month AS tenor, avg(p) AS price FROM rows WHERE month IS NOT NULL GROUP BY 1 UNION ALL SELECT y, avg(p) FROM rows WHERE y IS NOT NULL GROUP BY 1)"""
#: Labels of all order days, of five kinds.
_LABELS = "t AS (SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN 'Q' || quarter(o_orderdate) || strftime(o_orderdate, '_%y') WHEN 1 THEN strftime(o_orderdate, 'WS_%y') WHEN 2 THEN strftime(o_orderdate, '%b_%y') WHEN 3 THEN strftime(o_orderdate, 'Y_%y') ELSE strftime(o_orderdate, 'odd_%y') END AS tenor FROM orders)"


def _labels(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_custkey") % 5
    yy = F.date_format(d, "yy")
    label = F.when(k == 0, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit("_"), yy)).when(k == 1, F.concat(F.lit("WS_"), yy)).when(k == 2, tn.tenor_label(d)).when(k == 3, F.concat(F.lit("Y_"), yy)).otherwise(F.concat(F.lit("odd_"), yy))
    return table(spark, sf_dir, "orders").select(label.alias("tenor")).distinct()


def _quotes(spark, sf_dir):
    d = F.col("o_orderdate")
    month = F.when(d < "1996-04-01", F.concat(F.date_format(d, "MMM_"), ((F.year(d) + 30) % 100).cast("string")))
    labels = F.array_compact(F.array(month, F.when(F.year(d) == 1996, "Y_26")))
    rows = table(spark, sf_dir, "orders").where(F.year(d).isin(1995, 1996)).select(F.explode(labels).alias("tenor"), (F.col("o_totalprice") / 10000).alias("price"))
    return rows.groupBy("tenor").agg(F.avg("price").alias("price"))


_MONTHS = "months(name, m) AS (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(tn.MONTHS, 1)) + ")"
_PERIODS = "members(period, k, m, shift) AS (VALUES " + ", ".join(f"('{p}', {k}, {(a - 1 + k) % 12 + 1}, {(a - 1 + k) // 12})" for p, (a, n) in tn.PERIODS.items() for k in range(n)) + ")"
_STARTS = "q AS (SELECT price, make_date(2000 + CAST(split_part(tenor, '_', 2) AS INTEGER), m, 1) AS start FROM quotes JOIN months ON split_part(tenor, '_', 1) = name)"
_RATIOS = """full_ AS (SELECT period, year(start) - shift AS y, avg(price) AS mean, count(*) AS n FROM members JOIN q ON month(start) = m GROUP BY 1, 2),
firsts AS (SELECT f.period, min(y) AS y FROM full_ f JOIN (SELECT period, count(*) AS size FROM members GROUP BY 1) s ON f.period = s.period AND n = size GROUP BY 1),
ratios AS (SELECT b.period, b.k, b.m, coalesce(q.price / f.mean, 1.0) AS ratio FROM members b LEFT JOIN firsts x ON b.period = x.period LEFT JOIN full_ f ON f.period = x.period AND f.y = x.y LEFT JOIN q ON q.start = make_date(CAST(x.y + b.shift AS INTEGER), b.m, 1))"""


@query("monthly_strip", f"WITH {_LABELS}, {_PERIODS}, {_MONTHS}, all_ AS (SELECT * FROM members UNION ALL SELECT name, 0, m, 0 FROM months) SELECT tenor, k, make_date(2000 + CAST(split_part(tenor, '_', 2) AS INTEGER) + shift, m, 1) AS month_start FROM t JOIN all_ ON split_part(tenor, '_', 1) = period")
def monthly_strip(spark, sf_dir):
    """Months of all labels of order days; labels that are no tenor have none."""
    return tn.monthly_strip(_labels(spark, sf_dir)).select("tenor", "k", "month_start")


@query("shape_ratios", f"WITH {_QUOTES}, {_MONTHS}, {_PERIODS}, {_STARTS}, {_RATIOS} SELECT period, m AS month, round(ratio, 9) AS ratio FROM ratios")
def shape_ratios(spark, sf_dir):
    """Shapes of quarters, seasons and years from the months of orders."""
    return curve.shape_ratios(_quotes(spark, sf_dir)).select("period", "month", F.round("ratio", 9).alias("ratio"))


_FILL = "rank_(period, rank) AS (VALUES " + ", ".join(f"('{p}', {i})" for i, p in enumerate(tn.PERIODS)) + ")"
_CURVE = f"""WITH {_QUOTES}, {_MONTHS}, {_PERIODS}, {_STARTS.replace("= name)", "= name WHERE make_date(2000 + CAST(split_part(tenor, '_', 2) AS INTEGER), m, 1) > DATE '2024-12-01')")}, {_RATIOS}, {_FILL},
more AS (SELECT make_date(2000 + CAST(split_part(tenor, '_', 2) AS INTEGER) + b.shift, b.m, 1) AS start, price * ratio AS price, rank FROM quotes JOIN members b ON split_part(tenor, '_', 1) = b.period JOIN ratios USING (period, k) JOIN rank_ USING (period)),
curve AS (SELECT start, price FROM q UNION ALL SELECT start, arg_min(price, rank) FROM more WHERE start NOT IN (SELECT start FROM q) GROUP BY 1)"""


@query("forward_curve", f"{_CURVE} SELECT start, round(price, 9) AS price FROM curve")
def forward_curve(spark, sf_dir):
    """The monthly curve of orders, a year shaped by the year before."""
    return curve.monthly_curve(_quotes(spark, sf_dir), "2024-12-01").select("start", F.round("price", 9).alias("price"))


@query("curve_lookup", f"""{_CURVE}, p AS (SELECT date_diff('day', DATE '2024-12-01', start + 14) / 365.0 AS x, price AS y FROM curve),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM p),
a AS (SELECT DISTINCT p_size / 20.0 AS t FROM part), k AS (SELECT t, coalesce((SELECT max(x0) FROM s WHERE x0 <= t AND x1 IS NOT NULL), (SELECT min(x0) FROM s)) AS x0 FROM a)
SELECT t, round(y0 + (y1 - y0) * (t - s.x0) / (x1 - s.x0), 9) AS price FROM k JOIN s USING (x0)""")
def curve_lookup(spark, sf_dir):
    """Prices of the curve at the times that parts ask for, those beyond its ends too."""
    at = table(spark, sf_dir, "part").select((F.col("p_size") / 20.0).alias("t")).distinct()
    points = curve.curve_times(curve.monthly_curve(_quotes(spark, sf_dir), "2024-12-01"), "2024-12-01")
    return asof.interpolate(at, points, "t", "x", "price").select("t", F.round("price", 9).alias("price"))


GRID = [(k, t, v) for k, row in ((80.0, (0.32, 0.30, 0.28)), (100.0, (0.25, 0.24, 0.23)), (120.0, (0.28, 0.27, 0.26))) for t, v in zip((0.25, 0.5, 1.0), row)]


@query("surface_vols", f"""WITH g(k, t, v) AS (VALUES {', '.join(map(str, GRID))}), q AS (SELECT p_partkey AS id, greatest(80.0, least(120.0, 60.0 + p_size * 1.5)) AS k, greatest(0.25, least(1.0, (p_partkey % 13) / 10.0)) AS t FROM part),
b AS (SELECT *, CASE WHEN k < 100 THEN 80.0 ELSE 100.0 END AS k0, CASE WHEN t < 0.5 THEN 0.25 ELSE 0.5 END AS t0 FROM q), c AS (SELECT *, k0 + 20 AS k1, CASE WHEN t0 = 0.25 THEN 0.5 ELSE 1.0 END AS t1 FROM b)
SELECT id, round((1 - (c.k - k0) / (k1 - k0)) * ((1 - (c.t - t0) / (t1 - t0)) * g00.v + (c.t - t0) / (t1 - t0) * g01.v) + (c.k - k0) / (k1 - k0) * ((1 - (c.t - t0) / (t1 - t0)) * g10.v + (c.t - t0) / (t1 - t0) * g11.v), 9) AS vol
FROM c JOIN g g00 ON g00.k = k0 AND g00.t = t0 JOIN g g01 ON g01.k = k0 AND g01.t = t1 JOIN g g10 ON g10.k = k1 AND g10.t = t0 JOIN g g11 ON g11.k = k1 AND g11.t = t1""")
def surface_vols(spark, sf_dir):
    grid = spark.createDataFrame(GRID, "k double, t double, vol double").withColumnsRenamed({"k": "gk", "t": "gt"})
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (60.0 + F.col("p_size") * 1.5).alias("strike"), ((F.col("p_partkey") % 13) / 10.0).alias("tenor"))
    return asof.bilinear(q, grid.withColumnsRenamed({"gk": "strike", "gt": "tenor"}), "strike", "tenor", "vol").select("id", F.round("vol", 9).alias("vol"))


@query("relative_tenors", f"""WITH {_DAYS}, k AS (SELECT unnest([1, 2, 3]) AS k), s AS (SELECT d, k, CAST(date_trunc('month', d + 5) + INTERVAL (k) MONTH AS DATE) AS a FROM days CROSS JOIN k)
SELECT d, k, round(date_diff('day', d, a) / 365.0, 9) AS start, round(date_diff('day', a, CAST(a + INTERVAL 1 MONTH AS DATE)) / 365.0, 9) AS length FROM s""")
def relative_tenors(spark, sf_dir):
    rows = _days(spark, sf_dir).select("d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    return rows.withColumn("x", tn.relative_times(F.col("d"), F.col("k"))).select("d", "k", F.round("x.start", 9).alias("start"), F.round("x.length", 9).alias("length"))


dated("d start", "tenor_labels")
dated("d previous next on_or_after on_or_before", "weekdays")
dated("d", "workday_counts", "relative_tenors")
dated("d later", "workday_offset")
dated("d fifteenth third overflow", "month_offsets")
dated("starts ends", "clock_changes")
dated("d back", "serial_dates")
dated("parsed", "parsed_dates")
dated("month_start", "monthly_strip")
dated("start", "forward_curve")
