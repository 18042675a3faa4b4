"""Queries on cargo visits and order books."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import flows, orderbook
from fathomline.plans.mapping import AS_OF, ORDER_EVENTS, VISITS, order_events, visits
from fathomline.plans.registry import query
from fathomline.sources.files import page, table

#: Regions in the order of the matrix's columns.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
DAYS = [1, 7, 30]
AGES = {"0": 1, "20": 20, "30": 30}


@query("flow_table", f"""WITH {VISITS} SELECT origin_region AS origin, dest_region AS destination, round(sum(tonnes), 2) AS value
FROM visits WHERE lower(visit_type) = 'import' AND dest_region IS NOT NULL GROUP BY 1, 2 HAVING round(sum(tonnes), 2) > 0""")
def flow_table(spark, sf_dir):
    return flows.flow_table(visits(spark, sf_dir), "origin_region", "dest_region")


@query("imports_by_region", f"""WITH {VISITS}, a AS (SELECT dest_region, count(vessel) AS cargoes, round(sum(tonnes), 2) AS tonnes, round(sum(volume), 2) AS volume
FROM visits WHERE lower(visit_type) = 'import' AND arrival BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT 'TOTAL', CAST(sum(cargoes) AS BIGINT), sum(tonnes), sum(volume) FROM a""")
def imports_by_region(spark, sf_dir):
    return flows.by_region(visits(spark, sf_dir), "dest_region", "1996-01-01", "1997-12-31")


@query("recap_windows", f"""WITH {VISITS} SELECT dest_region, {', '.join(f"CAST(count(*) FILTER (arrival BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY AND TIMESTAMP '{AS_OF}') AS BIGINT) AS cargoes_{n}, round(coalesce(sum(tonnes) FILTER (arrival BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY AND TIMESTAMP '{AS_OF}'), 0), 2) AS tonnes_{n}" for n in DAYS)}
FROM visits WHERE lower(visit_type) = 'import' AND arrival BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1""")
def recap_windows(spark, sf_dir):
    return flows.recap(visits(spark, sf_dir), AS_OF, DAYS)


_CELLS = ", ".join(f"""coalesce(round(sum(tonnes) FILTER (dest_region = '{r}'), 2), 0) AS "{r}\"""" for r in REGIONS)
_ADD = " + ".join(f'"{r}"' for r in REGIONS)


@query("flow_matrix", f"""WITH {VISITS}, a AS (SELECT origin_country, {_CELLS} FROM visits WHERE lower(visit_type) = 'import' AND dest_region IS NOT NULL GROUP BY 1),
b AS (SELECT *, {_ADD} AS "TOTAL" FROM a) SELECT * FROM b UNION ALL SELECT 'TOTAL', {', '.join(f'sum("{r}")' for r in REGIONS)}, sum("TOTAL") FROM b""")
def flow_matrix(spark, sf_dir):
    return flows.matrix(visits(spark, sf_dir), "origin_country", REGIONS)


@query("flow_unpivot", f"""WITH {VISITS} SELECT origin_region AS origin, dest_region AS destination, round(sum(tonnes), 2) AS value
FROM visits WHERE lower(visit_type) = 'import' AND dest_region IS NOT NULL GROUP BY 1, 2""")
def flow_unpivot(spark, sf_dir):
    return flows.unpivot_matrix(flows.matrix(visits(spark, sf_dir), "origin_region", REGIONS), "origin_region")


@query("flow_totals", f"""WITH {VISITS}, f AS (SELECT origin_region, dest_region, round(sum(tonnes), 2) AS value FROM visits WHERE lower(visit_type) = 'import' AND dest_region IS NOT NULL GROUP BY 1, 2)
SELECT 'origin' AS side, origin_region AS name, round(sum(value), 2) AS value FROM f GROUP BY 2 UNION ALL SELECT 'destination', dest_region, round(sum(value), 2) FROM f GROUP BY 2""")
def flow_totals(spark, sf_dir):
    return flows.totals(flows.flow_table(visits(spark, sf_dir), "origin_region", "dest_region"))


@query("flow_layout", f"""WITH {VISITS}, f AS (SELECT origin_region AS name, round(sum(tonnes), 2) AS value FROM visits WHERE lower(visit_type) = 'import' AND dest_region IS NOT NULL GROUP BY 1),
g AS (SELECT 'origin' AS side, name, value, value / sum(value) OVER () AS share FROM f)
SELECT side, name, value, round(share, 9) AS share, round(coalesce(sum(share) OVER (ORDER BY value DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS begins FROM g""")
def flow_layout(spark, sf_dir):
    named = flows.totals(flows.flow_table(visits(spark, sf_dir), "origin_region", "dest_region")).where("side = 'origin'")
    return flows.share_layout(named).withColumn("share", F.round("share", 9)).withColumn("begins", F.round("begins", 9))


@query("transit_by_origin", f"""WITH {VISITS}, a AS (SELECT port_country, count(vessel) AS cargoes, round(sum(tonnes), 2) AS tonnes, round(sum(volume), 2) AS volume FROM visits WHERE lower(dest_port) LIKE '%transit%' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT 'TOTAL', CAST(sum(cargoes) AS BIGINT), sum(tonnes), sum(volume) FROM a""")
def transit_by_origin(spark, sf_dir):
    return flows.transit_by_origin(visits(spark, sf_dir))


@query("transit_ages", f"""WITH {VISITS}, t AS (SELECT * FROM visits WHERE lower(dest_port) LIKE '%transit%'),
z AS (SELECT port_country, count(*) AS cargoes_0, round(sum(tonnes), 2) AS tonnes_0 FROM t WHERE CAST(departure AS DATE) <= DATE '{AS_OF}' GROUP BY 1),
a AS (SELECT port_country, count(*) AS cargoes_20, round(sum(tonnes), 2) AS tonnes_20 FROM t WHERE CAST(departure AS DATE) <= DATE '{AS_OF}' - 19 GROUP BY 1),
b AS (SELECT port_country, count(*) AS cargoes_30, round(sum(tonnes), 2) AS tonnes_30 FROM t WHERE CAST(departure AS DATE) <= DATE '{AS_OF}' - 29 GROUP BY 1)
SELECT z.*, coalesce(cargoes_20, 0) AS cargoes_20, coalesce(tonnes_20, 0) AS tonnes_20, coalesce(cargoes_30, 0) AS cargoes_30, coalesce(tonnes_30, 0) AS tonnes_30
FROM z LEFT JOIN a USING (port_country) LEFT JOIN b USING (port_country)""")
def transit_ages(spark, sf_dir):
    return flows.transit_ages(visits(spark, sf_dir), AS_OF, AGES)


@query("transit_list", f"""WITH {VISITS} SELECT vessel, line, departure, dest_port, tonnes FROM visits WHERE lower(dest_port) LIKE '%transit%' AND arrival BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31'""")
def transit_list(spark, sf_dir):
    rows = visits(spark, sf_dir).where(flows.within("1998-01-01", "1998-01-31"))
    return flows.transit_list(rows, ["vessel", "line", "departure", "dest_port", "tonnes", "not_there"])


@query("scaled_columns", f"""WITH {VISITS} SELECT port_country, round(sum(tonnes) / 1e6, 9) AS "Mtonnes >0d" FROM visits WHERE lower(visit_type) = 'import' GROUP BY 1""")
def scaled_columns(spark, sf_dir):
    sums = visits(spark, sf_dir).where(F.lower("visit_type") == "import").groupBy("port_country").agg(F.sum("tonnes").alias("tonnes"), F.sum("volume").alias("Mcm"))
    return flows.scaled(sums, {"tonnes": "Mtonnes >0d"}, {"Mtonnes >0d": 1e6}, "mcm").withColumn("Mtonnes >0d", F.round("Mtonnes >0d", 9))


_LATEST = f"{ORDER_EVENTS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id) AS k FROM order_events) WHERE k = 1)"


def _latest(spark, sf_dir):
    return orderbook.latest(order_events(spark, sf_dir), ["order_id"], [F.desc("ts"), "event_id"])


@query("latest_orders", f"WITH {_LATEST} SELECT order_id, event_id, state, side, maker, CAST(qty AS DOUBLE) AS qty FROM latest")
def latest_orders(spark, sf_dir):
    return _latest(spark, sf_dir).select("order_id", "event_id", "state", "side", "maker", F.col("qty").cast("double").alias("qty"))


@query("open_orders", f"WITH {_LATEST} SELECT order_id, state FROM latest WHERE state NOT IN ('inactive', 'withdrawn')")
def open_orders(spark, sf_dir):
    return orderbook.without_states(_latest(spark, sf_dir), ["inactive", "withdrawn"]).select("order_id", "state")


_LEVELS = """book AS (SELECT side, round(CASE WHEN lower(side) LIKE '%bid%' THEN floor(round(price / 0.05, 9)) ELSE ceil(round(price / 0.05, 9)) END * 0.05, 6) AS level, maker, CAST(sum(qty) AS BIGINT) AS qty
FROM order_events WHERE state = 'active' AND qty IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2, 3)"""


def _book(spark, sf_dir):
    return orderbook.levels(order_events(spark, sf_dir).where("state = 'active'"), 0.05)


@query("book_levels", f"WITH {ORDER_EVENTS}, {_LEVELS} SELECT * FROM book")
def book_levels(spark, sf_dir):
    return _book(spark, sf_dir)


@query("book_levels_by_strip", f"WITH {ORDER_EVENTS}, {_LEVELS.replace('maker, CAST', 'maker, strip, CAST').replace('BY 1, 2, 3)', 'BY 1, 2, 3, 4)')} SELECT * FROM book")
def book_levels_by_strip(spark, sf_dir):
    return orderbook.levels(order_events(spark, sf_dir).where("state = 'active'"), 0.05, ("strip",))


_TOP = "top AS (SELECT side, level, maker, qty FROM (SELECT *, dense_rank() OVER (PARTITION BY side ORDER BY CASE WHEN lower(side) LIKE '%bid%' THEN -level ELSE level END) AS k FROM book) WHERE k <= 5)"


@query("book_top_levels", f"WITH {ORDER_EVENTS}, {_LEVELS}, {_TOP} SELECT * FROM top")
def book_top_levels(spark, sf_dir):
    return orderbook.top_levels(_book(spark, sf_dir), 5)


MAKERS = ["M0", "M1", "M2", "M3"]


@query("book_pivot", f"WITH {ORDER_EVENTS}, {_LEVELS}, {_TOP} SELECT side, level, {', '.join(f'CAST(coalesce(sum(qty) FILTER (maker = {chr(39)}{m}{chr(39)}), 0) AS BIGINT) AS {chr(34)}{m}{chr(34)}' for m in MAKERS)} FROM top GROUP BY 1, 2")
def book_pivot(spark, sf_dir):
    return orderbook.pivoted(orderbook.top_levels(_book(spark, sf_dir), 5), MAKERS)


@query("book_stacked", f"WITH {ORDER_EVENTS}, {_LEVELS} SELECT *, CAST(coalesce(sum(qty) OVER (PARTITION BY side, level ORDER BY maker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM book")
def book_stacked(spark, sf_dir):
    return orderbook.stacked(_book(spark, sf_dir))


@query("traded_by_price", f"WITH {ORDER_EVENTS} SELECT round(price, 6) AS price, CAST(sum(qty) AS DOUBLE) AS qty FROM order_events WHERE state = 'consummated' GROUP BY 1")
def traded_by_price(spark, sf_dir):
    return orderbook.traded(order_events(spark, sf_dir).withColumn("price", F.round("price", 6)).withColumn("qty", F.col("qty").cast("double")))


@query("events_per_order", f"WITH {ORDER_EVENTS} SELECT order_id, count(*) AS n FROM order_events GROUP BY 1")
def events_per_order(spark, sf_dir):
    return order_events(spark, sf_dir).groupBy("order_id").agg(F.count("*").alias("n"))


@query("book_all_levels", f"WITH {ORDER_EVENTS}, {_LEVELS} SELECT level FROM book WHERE side = 'Bid' UNION SELECT level FROM book WHERE side = 'Offer'")
def book_all_levels(spark, sf_dir):
    book = _book(spark, sf_dir)
    return book.where("side = 'Bid'").select("level").union(book.where("side = 'Offer'").select("level")).distinct()


@query("common_levels", f"WITH {ORDER_EVENTS}, {_LEVELS} SELECT level FROM book WHERE side = 'Bid' INTERSECT SELECT level FROM book WHERE side = 'Offer'")
def common_levels(spark, sf_dir):
    book = _book(spark, sf_dir)
    return book.where("side = 'Bid'").select("level").intersect(book.where("side = 'Offer'").select("level"))


@query("one_sided_levels", f"WITH {ORDER_EVENTS}, {_LEVELS} SELECT level FROM book WHERE side = 'Bid' EXCEPT SELECT level FROM book WHERE side = 'Offer'")
def one_sided_levels(spark, sf_dir):
    book = _book(spark, sf_dir)
    return book.where("side = 'Bid'").select("level").subtract(book.where("side = 'Offer'").select("level"))


@query("retained_levels", f"WITH {ORDER_EVENTS}, {_LEVELS}, {_TOP} SELECT event_id FROM order_events WHERE side = 'Bid' AND state = 'active' AND round(floor(round(price / 0.05, 9)) * 0.05, 6) IN (SELECT level FROM top WHERE side = 'Bid')")
def retained_levels(spark, sf_dir):
    top = orderbook.top_levels(_book(spark, sf_dir), 5).where("side = 'Bid'").select("level").distinct()
    bids = order_events(spark, sf_dir).where("side = 'Bid' and state = 'active'").withColumn("level", F.round(F.floor(F.round(F.col("price") / 0.05, 9)) * 0.05, 6))
    return bids.join(top, "level", "left_semi").select("event_id")


@query("makers_disjoint", f"WITH {ORDER_EVENTS} SELECT count(*) = 0 AS disjoint FROM (SELECT order_id FROM order_events WHERE maker = 'M0' INTERSECT SELECT order_id FROM order_events WHERE maker = 'M1')")
def makers_disjoint(spark, sf_dir):
    e = order_events(spark, sf_dir)
    both = e.where("maker = 'M0'").select("order_id").intersect(e.where("maker = 'M1'").select("order_id"))
    return both.agg((F.count("*") == 0).alias("disjoint"))


@query("events_page", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 30 OFFSET 60")
def events_page(spark, sf_dir):
    return page(table(spark, sf_dir, "events"), [F.desc("ts"), "event_id"], 30, 60).select("event_id", "event_type")


@query("order_grid", f"WITH {ORDER_EVENTS}, m AS (SELECT DISTINCT maker FROM order_events), s AS (SELECT DISTINCT strip FROM order_events) SELECT maker, strip, count(event_id) AS n FROM m CROSS JOIN s LEFT JOIN order_events USING (maker, strip) GROUP BY 1, 2")
def order_grid(spark, sf_dir):
    """All pairs of the few makers and strips, with their events."""
    e = order_events(spark, sf_dir)
    grid = e.select("maker").distinct().crossJoin(F.broadcast(e.select("strip").distinct()))
    counts = e.groupBy("maker", "strip").agg(F.count("*").alias("n"))
    return grid.join(counts, ["maker", "strip"], "left").fillna(0, subset=["n"])
