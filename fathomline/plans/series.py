"""Queries that lay series side by side, and lists from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import montecarlo as mc, panels as pn, timeseries as ts
from fathomline.operators.intervals import overlaps
from fathomline.plans.mapping import PRICES, VISITS, prices, visits
from fathomline.plans.panels import HUBS, OBS, hubs, observations, r
from fathomline.plans.registry import dated, query
from fathomline.plans.simulations import _PAY, NATIONS, N, RHO3, _correlated, _deals, _weyl, deals
from fathomline.sources.files import table


@query("spread_error", f"WITH {_weyl(N, 3)}, {_correlated(RHO3, 3)}, {_deals(*NATIONS)}, p AS (SELECT id, {_PAY} AS x FROM w CROSS JOIN deals) SELECT id, round(avg(x), 4) AS value, round(stddev_pop(x) / sqrt(count(*)), 6) AS error, count(*) AS paths FROM p GROUP BY 1")
def spread_error(spark, sf_dir):
    """Simulated spreads of the nations with the error of the whole population of their paths."""
    out = mc.spread_option(deals(spark, sf_dir, *NATIONS), ["id"], RHO3, N, population=True)
    return out.select("id", r("value", 4), r("error", 6), "paths")


@query("histograms", """WITH v AS (SELECT event_type, CAST(least(floor(value / 10), 9) AS INTEGER) AS bin FROM events WHERE value BETWEEN 0 AND 100), n AS (SELECT event_type, count(*) AS n FROM v GROUP BY 1)
SELECT bin, round(coalesce(sum(1.0 / n) FILTER (event_type = 'click'), 0), 9) AS one, round(coalesce(sum(1.0 / n) FILTER (event_type = 'view'), 0), 9) AS other FROM v JOIN n USING (event_type) WHERE event_type IN ('click', 'view') GROUP BY 1""")
def histograms(spark, sf_dir):
    """Shares of two samples in the same bins."""
    e = table(spark, sf_dir, "events")
    own = lambda kind, name: ts.histogram(e.where(F.col("event_type") == kind), "value", 0.0, 100.0, 10).select("bin", F.col("n").alias(name))
    both = own("click", "one").join(own("view", "other"), "bin", "full_outer").select("bin", F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("other", F.lit(0)).alias("other"))
    total = both.agg(F.sum("one").alias("_one"), F.sum("other").alias("_other"))
    return both.crossJoin(F.broadcast(total)).select("bin", F.round(F.col("one") / F.col("_one"), 9).alias("one"), F.round(F.col("other") / F.col("_other"), 9).alias("other"))  # one row


@query("return_columns", f"""WITH {OBS}, p AS (SELECT lsu, d, avg(price) AS price FROM obs GROUP BY 1, 2), x AS (SELECT lsu, d, ln(price / lag(price) OVER (PARTITION BY lsu ORDER BY d)) AS ret FROM p)
SELECT d, {', '.join(f"round(max(ret) FILTER (lsu = 'U{i}'), 9) AS u{i}" for i in range(3))} FROM x GROUP BY 1 HAVING count(ret) > 0""")
def return_columns(spark, sf_dir):
    """Returns of all underlyings side by side, on every day that any of them has one."""
    p = observations(spark, sf_dir).groupBy("lsu", "d").agg(F.avg("price").alias("price"))
    rets = ts.lag_returns(p, ["lsu"], "d", "price").where("ret is not null")
    wide = rets.groupBy("d").pivot("lsu", ["U0", "U1", "U2"]).agg(F.max("ret"))
    return wide.select("d", *[F.round(f"U{i}", 9).alias(f"u{i}") for i in range(3)])


_MONTHS12 = ", ".join(f"round(max(price) FILTER (k = {k}), 6) AS m{k:02d}" for k in range(1, 13))


@query("front_months", f"""WITH {HUBS}, x AS (SELECT hub, year(start) AS y, month(start) AS k, price FROM hubs), l AS (SELECT max(y) AS last FROM x) SELECT hub, y, {_MONTHS12} FROM x, l WHERE y > last - 2 GROUP BY 1, 2""")
def front_months(spark, sf_dir):
    """The twelve months of the last two years, side by side."""
    h = hubs(spark, sf_dir).select("hub", F.year("start").cast("long").alias("y"), F.month("start").alias("k"), "price")
    last = h.agg(F.max("y")).first()[0]
    own = [F.round(F.max(F.when(F.col("k") == k, F.col("price"))), 6).alias(f"m{k:02d}") for k in range(1, 13)]
    return h.where(F.col("y") > F.lit(last or 0) - 2).groupBy("hub", "y").agg(*own)


@query("cargo_series", f"""WITH {OBS}, f AS (SELECT lsu, d, contract, price, row_number() OVER (PARTITION BY lsu, d ORDER BY contract) AS k FROM obs) SELECT lsu, d, contract, 'front' AS kind, round(price, 6) AS price FROM f WHERE k = 1 UNION ALL SELECT lsu, d, contract, 'forward', round(price, 6) FROM f WHERE k > 1 AND lsu <> 'U2'""")
def cargo_series(spark, sf_dir):
    """Front and forward prices as one series; one source has a front only."""
    o = observations(spark, sf_dir)
    first = o.groupBy("lsu", "d").agg(F.min("contract").alias("_first"))
    rows = o.join(first, ["lsu", "d"])
    front = rows.where("contract = _first").select("lsu", "d", "contract", F.lit("front").alias("kind"), r("price"))
    return front.unionByName(rows.where("contract > _first and lsu <> 'U2'").select("lsu", "d", "contract", F.lit("forward").alias("kind"), r("price")))


def _contracts(spark, sf_dir):
    """One document that lists contracts, and their ports and releases, for each region."""
    n = table(spark, sf_dir, "nation")
    port = F.struct(F.concat(F.lit("id"), F.col("n_nationkey").cast("string")).alias("uuid"), F.col("n_name").alias("name"), F.array(F.lit("cogh"), F.lit("panama")).alias("availableViaPoints"))
    docs = n.groupBy("n_regionkey").agg(F.collect_list(port).alias("ports"), F.collect_list(F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))).alias("releases"))
    return docs.select(F.to_json(F.struct(F.struct(F.col("ports").alias("fobPorts"), F.col("releases").alias("sparkReleases")).alias("staticData"))).alias("doc"))


_LIST = "staticData struct<fobPorts:array<struct<uuid:string,name:string,availableViaPoints:array<string>>>,sparkReleases:array<string>>"


@query("contract_list", "SELECT 'id' || n_nationkey AS id, n_name AS name, 2 AS ways FROM nation")
def contract_list(spark, sf_dir):
    """Ids, names and ways of all ports from documents."""
    found = _contracts(spark, sf_dir).select(F.from_json("doc", _LIST).alias("d"))
    return found.select(F.inline("d.staticData.fobPorts")).select(F.col("uuid").alias("id"), "name", F.size("availableViaPoints").alias("ways"))


@query("release_list", "SELECT 'r' || n_nationkey AS release FROM nation")
def release_list(spark, sf_dir):
    """All releases that documents list."""
    found = _contracts(spark, sf_dir).select(F.from_json("doc", _LIST).alias("d"))
    return found.select(F.explode("d.staticData.sparkReleases").alias("release"))


@query("on_water", f"WITH {VISITS}, s AS (SELECT DISTINCT arrival, departure, vessel, line, volume FROM visits WHERE departure <= arrival), e AS (SELECT CAST(departure AS DATE) AS d, volume AS v FROM s UNION ALL SELECT CAST(arrival AS DATE), -volume FROM s), n AS (SELECT d, sum(v) AS v FROM e GROUP BY 1), m AS (SELECT last_day(d) AS month, sum(v) AS v FROM n GROUP BY 1) SELECT month, round(sum(v) OVER (ORDER BY month), 3) AS volume FROM m")
def on_water(spark, sf_dir):
    """Volume between departure and arrival at each month's end: what has left less what has come in."""
    from pyspark.sql import Window

    s = visits(spark, sf_dir).where("departure <= arrival").select("arrival", "departure", "vessel", "line", "volume").distinct()
    moves = s.select(F.explode(F.array(F.struct(F.to_date("departure").alias("d"), F.col("volume").alias("v")), F.struct(F.to_date("arrival").alias("d"), (-F.col("volume")).alias("v")))).alias("m")).select("m.*")
    months = moves.groupBy(F.last_day("d").alias("month")).agg(F.sum("v").alias("v"))  # as many rows as there are months
    return months.select("month", F.round(F.sum("v").over(Window.orderBy("month")), 3).alias("volume"))


@query("overlapping_shapes", f"""WITH s AS (SELECT n_nationkey AS id, n_nationkey % 7 AS day, n_nationkey % 20 AS a, n_nationkey % 20 + 1 + n_nationkey % 8 AS b FROM nation) SELECT x.id, y.id AS other, least(x.b, y.b) - greatest(x.a, y.a) AS hours FROM s x JOIN s y ON x.day = y.day AND x.id <> y.id AND x.a < y.b AND y.a < x.b""")
def overlapping_shapes(spark, sf_dir):
    """Load shapes of the same weekday whose hours meet."""
    k = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(k.alias("id"), (k % 7).alias("day"), (k % 20).alias("a"), (k % 20 + 1 + k % 8).alias("b"))
    o = s.select(F.col("id").alias("other"), "day", F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = s.join(o, "day").where("id <> other and a < _b and _a < b")
    return met.select("id", "other", (F.least("b", "_b") - F.greatest("a", "_a")).alias("hours"))


@query("spread_pairs", f"WITH {PRICES}, x AS (SELECT d, max(price) FILTER (ticker = 'click') AS c, max(price) FILTER (ticker = 'view') AS v, max(price) FILTER (ticker = 'purchase') AS p FROM prices GROUP BY 1) SELECT d, round(c - 1.15 * v, 9) AS first, round(p - 0.115 * v, 9) AS second FROM x WHERE c IS NOT NULL AND v IS NOT NULL AND p IS NOT NULL")
def spread_pairs(spark, sf_dir):
    """Two spreads of three benchmarks, on the days that have all of them."""
    wide = prices(spark, sf_dir).groupBy("d").pivot("ticker", ["click", "view", "purchase"]).agg(F.max("price")).dropna("any")
    return wide.select("d", F.round(F.col("click") - 1.15 * F.col("view"), 9).alias("first"), F.round(F.col("purchase") - 0.115 * F.col("view"), 9).alias("second"))


@query("quoted_hubs", f"WITH {HUBS} SELECT start, count(*) AS hubs, round(avg(price), 6) AS mean FROM hubs GROUP BY 1 HAVING count(*) = 5")
def quoted_hubs(spark, sf_dir):
    """Mean prices of the months that all hubs quote."""
    return pn.quoted(hubs(spark, sf_dir), ["start"], "price").groupBy("start").agg(F.count("*").alias("hubs"), F.round(F.avg("price"), 6).alias("mean")).where("hubs = 5")


@query("calibrated_spread", f"""WITH {OBS}, p AS (SELECT lsu, d, avg(price) AS price FROM obs GROUP BY 1, 2), x AS (SELECT lsu, d, ln(price / lag(price) OVER (PARTITION BY lsu ORDER BY d)) AS ret FROM p),
c AS (SELECT (SELECT arg_max(price, d) FROM p WHERE lsu = 'U0') AS f0, (SELECT arg_max(price, d) FROM p WHERE lsu = 'U1') AS f1, (SELECT stddev_samp(ret) * sqrt(252) FROM x WHERE lsu = 'U0') AS v0, (SELECT stddev_samp(ret) * sqrt(252) FROM x WHERE lsu = 'U1') AS v1, (SELECT corr(a.ret, b.ret) FROM x a JOIN x b USING (d) WHERE a.lsu = 'U0' AND b.lsu = 'U1') AS rho),
{_weyl(N, 2)}, e AS (SELECT f0 * exp(v0 * 0.1 * z0 - v0 * v0 * 0.01 / 2) - f1 * exp(v1 * 0.1 * (rho * z0 + sqrt(1 - rho * rho) * z1) - v1 * v1 * 0.01 / 2) AS s FROM z, c) SELECT round(avg(greatest(s, 0)), 3) AS value, count(*) AS paths FROM e""")
def calibrated_spread(spark, sf_dir):
    """A spread of two underlyings over a hundredth of a year, with prices, volatilities and correlation measured from their history: one row that all paths get."""
    p = observations(spark, sf_dir).groupBy("lsu", "d").agg(F.avg("price").alias("price"))
    rets = ts.lag_returns(p, ["lsu"], "d", "price")
    own = lambda k, c: F.max(F.when(F.col("lsu") == f"U{k}", F.col(c)))
    each = rets.groupBy("lsu").agg(F.max_by("price", "d").alias("f"), ts.annualised("ret", 252).alias("v")).agg(own(0, "f").alias("f0"), own(1, "f").alias("f1"), own(0, "v").alias("v0"), own(1, "v").alias("v1"))
    corr = rets.groupBy("d").agg(own(0, "ret").alias("a"), own(1, "ret").alias("b")).agg(F.corr("a", "b").alias("rho"))
    rows = mc.paths(spark, N, 2).crossJoin(F.broadcast(each.crossJoin(corr)))  # one row
    t, c = F.lit(0.01), F.col
    ends = [mc.terminal(c("f0"), c("v0"), t, c("z0")), mc.terminal(c("f1"), c("v1"), t, c("rho") * c("z0") + F.sqrt(1 - c("rho") ** 2) * c("z1"))]
    return rows.agg(*mc.statistics(F.greatest(ends[0] - ends[1], F.lit(0.0)))).select(r("value", 3), "paths")


dated("d", "return_columns", "spread_pairs")
dated("d contract", "cargo_series")
dated("month", "on_water")

@query("overlapping_orders", """WITH o AS (SELECT o_custkey AS cust, o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 90 AS INTEGER) AS b FROM orders),
s AS (SELECT o_custkey AS cust, l_orderkey AS key, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity * (CASE WHEN l_linenumber = 1 THEN 20 ELSE 1 END) AS INTEGER) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT id, count(*) AS n, sum(least(o.b, s.b) - greatest(o.a, s.a)) AS days FROM o JOIN s ON o.cust = s.cust AND o.a < s.b AND s.a < o.b GROUP BY 1""")
def overlapping_orders(spark, sf_dir):
    """How many shipments of the same customer are under way during each order, and for how many days in all; some last very long."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    day = F.to_date("o_orderdate")
    own = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), day.alias("a"), F.date_add(day, (1 + F.col("o_orderkey") % 90).cast("int")).alias("b"))
    lasting = (F.col("l_quantity") * F.when(F.col("l_linenumber") == 1, 20).otherwise(1)).cast("int")
    ships = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cust"), F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), lasting).alias("b"))
    met = overlaps(own, ships, ("a", "b"), ("a", "b"), by=["cust"])
    days = F.datediff(F.least("l.b", "r.b"), F.greatest("l.a", "r.a"))
    return met.groupBy(F.col("l.id").alias("id")).agg(F.count("*").alias("n"), F.sum(days).alias("days"))


dated("start", "quoted_hubs")
