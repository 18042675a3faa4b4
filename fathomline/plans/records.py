"""Queries on documents, text cells and market snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import convert as cn, tenor as tn
from fathomline.operators import timeseries as ts
from fathomline.plans.calendar import _DAYS, _days
from fathomline.plans.panels import OBS, observations, r
from fathomline.plans.registry import dated, query
from fathomline.sources import netbacks as nb
from fathomline.sources.files import table


def pages(spark, sf_dir):
    """Pages of netbacks, one for each order: its lines are terminals' figures."""
    lines = table(spark, sf_dir, "lineitem")

    def row(x):
        figure = {f: F.when((x["l_linenumber"] == 3) & (f == "gasInKind"), F.lit("n/a")).otherwise(F.round(x["l_extendedprice"] / 100 + i, 4).cast("string")).alias(f) for i, f in enumerate(nb.FIELDS)}
        day = F.to_date(x["l_shipdate"])
        return F.struct(day.cast("string").alias("releaseDate"), F.concat(F.lit("u"), (x["l_suppkey"] % 7).cast("string")).alias("terminalUuid"), F.concat(F.lit("M+"), x["l_linenumber"].cast("string")).alias("monthIndex"), F.trunc(day, "MM").cast("string").alias("deliveryMonth"), *figure.values())

    names = F.create_map(*[F.lit(x) for i in range(6) for x in (f"u{i}", f"Terminal {i}")])
    # lines are brought together as they are and written out as text afterwards
    docs = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")).alias("lines"))
    data = F.transform("lines", row).alias("data")
    return docs.select(F.to_json(F.struct(data, F.struct(names.alias("terminals")).alias("metaData"))).alias("doc"))


_NB = "nb AS (SELECT CAST(l_shipdate AS DATE) AS release_date, CASE WHEN l_suppkey % 7 < 6 THEN 'Terminal ' || (l_suppkey % 7) END AS terminal, 'M+' || l_linenumber AS month_index, CAST(date_trunc('month', l_shipdate) AS DATE) AS delivery_month, {} FROM lineitem)".format(
    ", ".join(f"{'CASE WHEN l_linenumber <> 3 THEN ' if f == 'gasInKind' else ''}round(l_extendedprice / 100 + {i}, 4){' END' if f == 'gasInKind' else ''} AS {f}" for i, f in enumerate(nb.FIELDS))
)
_VAR = "netbackTtfBasis + 2 * slotBerthUnloadStorageRegas + slotBerth"


@query("netback_rows", f"WITH {_NB} SELECT release_date, terminal, month_index, delivery_month, {', '.join(f'round({f}, 4) AS {f}' for f in nb.FIELDS)}, round({_VAR}, 4) AS variable_only FROM nb")
def netback_rows(spark, sf_dir):
    """Figures of all terminals from pages of netbacks."""
    rows = nb.netbacks(pages(spark, sf_dir))
    return rows.select("release_date", "terminal", "month_index", "delivery_month", *[F.round(f, 4).alias(f) for f in nb.FIELDS], F.round("variable_only", 4).alias("variable_only"))


_CARGO = "cargo AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'nwe' ELSE 'swe' END AS region, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS price FROM lineitem WHERE day(l_shipdate) % 4 = 0 GROUP BY 1, 2)"
_WTP = f"""{_NB}, {_CARGO}, own AS (SELECT release_date, terminal, max({_VAR}) AS v, CASE WHEN terminal IN ('Terminal 1', 'Terminal 3') THEN 'swe' ELSE 'nwe' END AS region FROM nb WHERE terminal IS NOT NULL GROUP BY 1, 2),
wtp AS (SELECT o.release_date, terminal, v - c.price AS wtp FROM own o ASOF LEFT JOIN cargo c ON o.region = c.region AND o.release_date <= c.d)"""


def _wtp(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.dayofmonth("l_shipdate") % 4 == 0)
    cargo = lines.groupBy(F.when(F.col("l_suppkey") % 2 == 0, "nwe").otherwise("swe").alias("region"), F.to_date("l_shipdate").alias("release_date")).agg(F.avg("l_quantity").alias("price"))
    regions = spark.createDataFrame([("Terminal 1", "swe"), ("Terminal 3", "swe"), ("Terminal 0", "nwe")], "terminal string, region string")
    return nb.willingness(nb.netbacks(pages(spark, sf_dir)).where("terminal is not null"), cargo, regions, "nwe")


@query("terminal_margins", f"WITH {_WTP} SELECT release_date, terminal, round(wtp, 6) AS wtp FROM wtp")
def terminal_margins(spark, sf_dir):
    """What a terminal's netback is above the cargo price of its region, that of the next day that has one."""
    return _wtp(spark, sf_dir).select("release_date", "terminal", F.round("wtp", 6).alias("wtp"))


@query("best_terminals", f"WITH {_WTP} SELECT release_date, round(avg(wtp), 6) AS mean, round(min(wtp), 6) AS low, round(max(wtp), 6) AS high, arg_min(terminal, struct_pack(v := -wtp, t := terminal)) AS best FROM wtp WHERE wtp IS NOT NULL GROUP BY 1")
def best_terminals(spark, sf_dir):
    """Mean and range over terminals on each day, and the marginal one."""
    return nb.across(_wtp(spark, sf_dir), "release_date", "wtp").select("release_date", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "best")


@query("month_elements", "WITH o AS (SELECT l_orderkey AS id, list(round(l_extendedprice, 2) ORDER BY l_linenumber, l_extendedprice) AS p FROM lineitem GROUP BY 1) SELECT id, CASE WHEN id % 4 < 3 THEN p[id % 4 + 1] END AS price FROM o")
def month_elements(spark, sf_dir):
    """The price of the month M+1, M+2 or M+3 of each order's delivery periods; M0 is none."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", F.round("l_extendedprice", 2).alias("p")))), lambda x: x["p"])
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(points.alias("points"))
    month = F.when(F.col("id") % 4 < 3, F.concat(F.lit("M+"), (F.col("id") % 4 + 1).cast("string"))).otherwise("M0")
    return orders.select("id", nb.month_price(F.col("points"), month).alias("price"))


def histories(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    value = F.struct(F.struct(F.struct(F.when((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1), "bad").otherwise(F.round("l_extendedprice", 2).cast("string")).alias("usdPerMMBtu")).alias("outright")).alias("neaMinusNwe"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", value.alias("v")))), lambda x: x["v"])
    docs = lines.groupBy("l_orderkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("releaseDate"), listed.alias("netbacks"))
    return docs.select("l_orderkey", F.to_json(F.struct("releaseDate", F.concat(F.lit("P"), (F.col("l_orderkey") % 5).cast("string")).alias("fobPort"), "netbacks")).alias("doc"))


@query("mean_netbacks", "WITH o AS (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS d, list(round(l_extendedprice, 2) ORDER BY l_linenumber, l_extendedprice) AS p, min(l_linenumber) AS f FROM lineitem GROUP BY 1) SELECT d AS release_date, 'P' || (k % 5) AS port, round(list_avg(p[1:2]), 4) AS value FROM o WHERE NOT (k % 11 = 0 AND f = 1)")
def mean_netbacks(spark, sf_dir):
    """Mean of the first two months of each document."""
    return nb.mean_netbacks(histories(spark, sf_dir), 2)[0].select("release_date", "port", F.round("value", 4).alias("value"))


@query("broken_netbacks", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 11 = 0 AND l_linenumber = 1")
def broken_netbacks(spark, sf_dir):
    """Orders whose documents have a figure that can't be read."""
    return nb.mean_netbacks(histories(spark, sf_dir), 2)[1].select("l_orderkey")


@query("freight_bleed", f"WITH {OBS}, m AS (SELECT contract, count(DISTINCT d) AS n, avg(price) AS price FROM obs GROUP BY 1) SELECT year(contract) AS year, round(sum(n * (price * 20 - 40000)), 2) AS value FROM m GROUP BY 1")
def freight_bleed(spark, sf_dir):
    """What days at freight prices earn above their cost, by year."""
    o = observations(spark, sf_dir).groupBy(F.col("contract").alias("month")).agg(F.count_distinct("d").alias("n"), (F.avg("price") * 20).alias("price"))
    return nb.bleed(o.select("month", "n"), o.select("month", "price")).select("year", r("value", 2))


_AS_OF = "(SELECT max(d) - 30 AS a FROM obs)"


@query("market_snapshot", f"""WITH {OBS}, a AS {_AS_OF}, p AS (SELECT lsu, d, avg(price) AS price FROM obs GROUP BY 1, 2), w AS (SELECT p.* FROM p, a WHERE d <= a), f AS (SELECT lsu, arg_max(price, d) AS forward, max(d) AS d FROM w GROUP BY 1),
x AS (SELECT lsu, ln(price / lag(price) OVER (PARTITION BY lsu ORDER BY d)) AS ret, row_number() OVER (PARTITION BY lsu ORDER BY d DESC) AS k FROM w), v AS (SELECT lsu, stddev_samp(ret) * sqrt(252) AS vol FROM x WHERE k <= 90 GROUP BY 1)
SELECT lsu, d AS quoted, round(forward, 4) AS forward, round(coalesce(vol, 0.33), 6) AS vol, round(ln(1 + 0.05 * 30 / 360) * 365 / 30, 9) AS rate FROM f JOIN v USING (lsu)""")
def market_snapshot(spark, sf_dir):
    """Forwards, volatilities of 90 days and a rate as of a day a month before the last; keyed by underlying."""
    from fathomline.sources.files import continuous_rate

    p = observations(spark, sf_dir).groupBy("lsu", "d").agg(F.avg("price").alias("price"))
    day = p.agg(F.date_sub(F.max("d"), 30)).first()[0]
    known = p.where(F.col("d") <= F.lit(day))
    f = known.groupBy("lsu").agg(F.max_by("price", "d").alias("forward"), F.max("d").alias("quoted"))
    recent = ts.last_rows(ts.lag_returns(known, ["lsu"], "d", "price"), ["lsu"], "d", 90)
    v = recent.groupBy("lsu").agg(ts.annualised("ret", 252).alias("vol"))
    return f.join(v, "lsu").select("lsu", "quoted", r("forward", 4), F.round(F.coalesce("vol", F.lit(0.33)), 6).alias("vol"), F.round(continuous_rate(F.lit(0.05)), 9).alias("rate"))


@query("snapshot_corr", f"""WITH {OBS}, a AS {_AS_OF}, p AS (SELECT lsu, d, avg(price) AS price FROM obs GROUP BY 1, 2), x AS (SELECT lsu, d, ln(price / lag(price) OVER (PARTITION BY lsu ORDER BY d)) AS ret FROM p, a WHERE d <= a)
SELECT x.lsu AS a, y.lsu AS b, count(*) AS n, round(greatest(-0.99, least(0.99, corr(x.ret, y.ret))), 7) AS corr FROM x JOIN x y USING (d) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def snapshot_corr(spark, sf_dir):
    """Correlations of the snapshot's underlyings, kept within 0.99."""
    p = observations(spark, sf_dir).groupBy("lsu", "d").agg(F.avg("price").alias("price"))
    day = p.agg(F.date_sub(F.max("d"), 30)).first()[0]
    rets = ts.lag_returns(p.where(F.col("d") <= F.lit(day)), ["lsu"], "d", "price")
    return ts.pairwise_corr(rets, "lsu", "d", clip=0.99).withColumn("corr", F.round("corr", 7))


@query("calendar_days", f"""WITH {_DAYS}, y AS (SELECT d, make_date(CAST(year(d) AS INTEGER), 3, 31) AS a, make_date(CAST(year(d) AS INTEGER), 10, 31) AS b FROM days) SELECT d, strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS midnight, d = a - CAST(isodow(a) % 7 AS INTEGER) AS starts, d = b - CAST(isodow(b) % 7 AS INTEGER) AS ends,
CAST(d + INTERVAL 3 MONTH AS DATE) AS ahead, CASE WHEN year(d) % 10 <= 5 THEN '3' ELSE '2' END || (year(d) % 10) AS digits, abs(date_diff('day', d, DATE '1998-06-01')) <= 100 AS near FROM y""")
def calendar_days(spark, sf_dir):
    """Clock changes, months ahead, year digits and windows of all days."""
    d = F.col("d")
    return _days(spark, sf_dir).select("d", F.date_format(tn.midnight(d), "yyyy-MM-dd HH:mm:ss").alias("midnight"), tn.is_dst_start(d).alias("starts"), tn.is_dst_end(d).alias("ends"), tn.month_from_code(d, F.lit("M3")).alias("ahead"), tn.two_digit_year(F.year(d) % 10).alias("digits"), tn.within_days(d, F.lit("1998-06-01").cast("date"), 100).alias("near"))


_FORMS = (("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%d/%m/%Y %H:%M", "dd/MM/yyyy HH:mm"), ("%Y%m%d %H:%M:%S", "yyyyMMdd HH:mm:ss"), ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), ("%Y/%m/%d %H:%M", "yyyy/MM/dd HH:mm"), ("%d-%m-%Y %H:%M:%S", "dd-MM-yyyy HH:mm:ss"))


@query("parsed_datetimes", "WITH t AS (SELECT event_id, date_trunc('minute', ts) AS m FROM events) SELECT event_id, strftime(m, '%Y-%m-%d %H:%M:%S') AS parsed FROM t")
def parsed_datetimes(spark, sf_dir):
    """Times of events written in six forms and read again."""
    k, m = F.col("event_id") % len(_FORMS), F.date_trunc("minute", "ts")
    text = F.coalesce(*[F.when(k == i, F.date_format(m, form)) for i, (_, form) in enumerate(_FORMS)])
    return table(spark, sf_dir, "events").select("event_id", F.date_format(tn.parse_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_DATES = (("%Y_%m_%d", "yyyy_MM_dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%Y-%b-%d", "yyyy-MMM-dd"), ("%a %d/%m/%Y", None), ("%Y-%m-%dT00:00:00", "yyyy-MM-dd'T00:00:00'"), ("%d-%b-%Y", "dd-MMM-yyyy"), ("%A, %B %-d, %Y", None))


@query("written_dates", f"WITH {_DAYS} SELECT d, d AS read, d AS long FROM days")
def written_dates(spark, sf_dir):
    """Days written in six forms, one with its weekday, and at length, and read again."""
    d, k = F.col("d"), F.dayofmonth("d") % 6
    forms = ["yyyy_MM_dd", "dd-MM-yyyy", "yyyy-MMM-dd", "E dd/MM/yyyy", "yyyy-MM-dd'T00:00:00'", "dd-MMM-yyyy"]
    text = F.coalesce(*[F.when(k == i, F.date_format(d, form)) for i, form in enumerate(forms)])
    return _days(spark, sf_dir).select("d", tn.parse_date(text).alias("read"), tn.long_date(F.date_format(d, "EEEE, MMMM d, yyyy")).alias("long"))


@query("month_texts", f"WITH {_DAYS} SELECT d, CASE WHEN year(d) >= 2000 THEN CAST(date_trunc('month', d) AS DATE) END AS month FROM days")
def month_texts(spark, sf_dir):
    """First days of months written like Jan-26; null for days before 2000, which that can't tell."""
    text = F.when(F.year("d") >= 2000, F.date_format("d", "MMM-yy"))
    return _days(spark, sf_dir).select("d", tn.parse_month(text).alias("month"))


@query("converted_cells", """WITH c AS (SELECT p_partkey AS id, p_size AS z FROM part) SELECT id, CASE z % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN z % 5 = 0 THEN NULL ELSE z + 0.5 END AS first, CASE WHEN z % 3 = 0 THEN 2 ELSE 3 END AS parts,
CASE z % 4 WHEN 0 THEN 'inf' WHEN 1 THEN '-inf' WHEN 2 THEN CAST(CAST(z AS DOUBLE) AS VARCHAR) END AS endless, CASE z % 3 WHEN 0 THEN 'Call' WHEN 1 THEN 'Put' END AS kind, CASE z % 2 WHEN 0 THEN CAST(z AS VARCHAR) ELSE 'Q1_26' END AS tenor, CASE WHEN z % 2 = 0 THEN '2026-01-31' ELSE '12.5' END AS day,
CASE z % 3 WHEN 0 THEN 'TTF' WHEN 1 THEN 'Brent' ELSE 'Other' END AS curve, 'C' || z AS code FROM c""")
def converted_cells(spark, sf_dir):
    """Typed values of text cells."""
    z = F.col("p_size")
    s = z.cast("string")
    flag = F.element_at(F.array(F.lit(" TRUE"), F.lit("no"), F.lit("maybe"), F.lit("")), z % 4 + 1)
    many = F.concat(F.when(z % 5 == 0, F.lit("x")).otherwise(F.concat(s, F.lit(".5"))), F.lit(" ;1;"), F.when(z % 3 == 0, F.lit("")).otherwise(F.lit(" 7")))
    end = F.element_at(F.array(F.lit("Inf"), F.lit(" -INF"), s, F.lit("none")), z % 4 + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        cn.boolean(flag).alias("flag"),
        F.get(cn.numbers(many), F.lit(0)).alias("first"),
        F.size(cn.numbers(many)).alias("parts"),
        cn.number_text(cn.number(end)).alias("endless"),
        cn.member(F.element_at(F.array(F.lit("CALL"), F.lit(" put"), F.lit("swap")), z % 3 + 1), ("Call", "Put")).alias("kind"),
        cn.tenor_text(F.when(z % 2 == 0, F.concat(s, F.lit(".0"))).otherwise(" Q1_26")).alias("tenor"),
        cn.date_text(F.when(z % 2 == 0, F.lit("31/01/2026")).otherwise("12.5")).alias("day"),
        cn.curve_name(F.element_at(F.array(F.lit("Dutch TTF Natural Gas Futures Forward"), F.lit("ICE Brent Forward"), F.lit("Other")), z % 3 + 1)).alias("curve"),
        cn.cleaned(F.concat(F.lit("C"), s, F.lit(" Comdty px")), " Comdty", " px").alias("code"),
    )


_CELLS = "cells AS (SELECT l_orderkey AS y, l_linenumber AS x, CASE WHEN l_orderkey % 5 = 0 OR l_linenumber = 4 THEN NULL WHEN l_quantity > 40 THEN ' ' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS v FROM lineitem)"


@query("filled_cells", f"WITH {_CELLS}, y AS (SELECT y FROM cells GROUP BY 1 HAVING count(CASE WHEN trim(v) <> '' THEN 1 END) > 0), x AS (SELECT x FROM cells WHERE y IN (SELECT y FROM y) GROUP BY 1 HAVING count(CASE WHEN trim(v) <> '' THEN 1 END) > 0) SELECT cells.y, cells.x, v FROM cells WHERE y IN (SELECT y FROM y) AND x IN (SELECT x FROM x)")
def filled_cells(spark, sf_dir):
    """Cells of a range without blank rows and columns."""
    v = F.when((F.col("l_orderkey") % 5 == 0) | (F.col("l_linenumber") == 4), None).when(F.col("l_quantity") > 40, " ").otherwise(F.col("l_quantity").cast("int").cast("string"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), v.alias("v"))
    return cn.without_blanks(cells, "y", "x", "v")


@query("shaped_quotes", "WITH q AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'PEAK' ELSE 'BASE' END AS shape, l_linenumber AS t, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS p FROM lineitem) SELECT id, count(DISTINCT shape) AS shapes, count(*) AS quotes, round(sum(p) FILTER (shape = 'BASE'), 4) AS base FROM (SELECT id, shape, t, max(p) AS p FROM q WHERE p IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1")
def shaped_quotes(spark, sf_dir):
    """Quotes of every order by load shape; those without one are base load."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(k % 3 == 0, "PEAK").when(k % 3 == 1, " ").alias("shape"), k.cast("string").alias("tenor"), F.when(k != 2, F.col("l_quantity")).alias("price"))
    maps = cn.shaped_quotes(rows, ["id"], "shape", "tenor", "price")
    base = F.aggregate(F.map_values(F.try_element_at("quotes", F.lit("BASE"))), F.lit(0.0), lambda a, x: a + x)
    count = F.aggregate(F.map_values("quotes"), F.lit(0), lambda a, m: a + F.size(m))
    return maps.select("id", F.size("quotes").cast("long").alias("shapes"), count.cast("long").alias("quotes"), F.round(base, 4).alias("base"))


dated("release_date delivery_month", "netback_rows")
dated("release_date", "terminal_margins", "best_terminals", "mean_netbacks")
dated("quoted", "market_snapshot")
dated("d ahead", "calendar_days")
dated("d read long", "written_dates")
dated("d month", "month_texts")
