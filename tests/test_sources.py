"""Sources and sinks on files of their own, and streams against the batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline.plans import mapping
from fathomline.sources import files, netbacks
from fathomline.streaming import events as st

SF = "/root/testdata/sf0.001"


def test_visits_from_csv(spark, tmp_path):
    names = ["Imo", *files.VISIT_TEXT, *files.VISIT_DATES, *files.VISIT_NUMBERS]
    cell = lambda **x: ",".join(x.get(n, "") for n in names)
    rows = [cell(Imo="7", Vessel_Type="LNG Tanker", Arrival="2026-01-02", Departure="03/02/2026", Qtymtonnes="-5.5", Qtymcm="x"), cell(Imo="bad", Vessel_Type="lng tanker (small)", Arrival="never"), cell(Imo="9", Vessel_Type="Bulk"), cell(Imo="10")]
    path = tmp_path / "visits.csv"
    path.write_text("\n".join([",".join(names), *rows]) + "\n")
    found = {r.Imo: r for r in files.read_visits(spark, str(path)).collect()}
    assert set(found) == {7, None} and found[7].Qtymtonnes == 5.5 and found[7].Qtymcm is None and found[None].Arrival is None
    assert found[7].Arrival == dt.datetime(2026, 1, 2) and found[7].Departure == dt.datetime(2026, 2, 3)


def test_prices_to_and_from_csv(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2026, 1, d), "A", "px", float("nan") if d == 2 else float(d)) for d in range(1, 5)], "obs_date date, ticker string, field string, value double")
    files.write_csv(rows, str(tmp_path / "prices"))
    back = files.read_prices(spark, str(tmp_path / "prices"), "2026-01-02", "2026-01-03").orderBy("obs_date").collect()
    assert [(r.obs_date.day, r.value) for r in back] == [(2, None), (3, 3.0)]
    assert files.read_prices(spark, str(tmp_path / "prices")).count() == 4


def test_releases_broken_and_latest(spark):
    doc = '{"releaseDate": "2026-01-0%d", "contractId": "c%d", "data": [{"dataPoints": [{"deliveryPeriod": {"startAt": "2026-02-01", "endAt": "2026-02-28", "name": "M1"}, "derivedPrices": {"usdPerDay": {"spark": "1"}, "usdPerMMBtu": {"spark": "x", "sparkMin": "2"}}}]}, {"dataPoints": []}]}'
    docs = spark.createDataFrame([(doc % (1, 1),), (doc % (3, 1),), (doc % (2, 2),), ("{",), ('{"releaseDate": "2026-01-01"}',), (None,)], "doc string")
    assert files.broken(docs).count() == 3 and files.releases(docs).count() == 3
    newest = {r.release.contractId: r.release.releaseDate for r in files.latest_release(files.releases(docs)).collect()}
    assert newest == {"c1": "2026-01-03", "c2": "2026-01-02"}
    points = files.price_points(files.releases(docs), first_only=True).collect()
    assert len(points) == 3 and all(r.price is None and r.low == 2.0 and r.start == dt.date(2026, 2, 1) for r in points)


def test_netbacks_edges(spark):
    docs = spark.createDataFrame([("{",), (None,), ('{"data": []}',), ('{"data": [{"releaseDate": "2026-01-01", "terminalUuid": "u", "netbackTtfBasis": "1", "slotBerth": "2", "slotBerthUnloadStorageRegas": "x"}]}',)], "doc string")
    rows = netbacks.netbacks(docs).collect()
    assert len(rows) == 1 and rows[0].terminal is None and rows[0].variable_only is None and rows[0].netbackTtfBasis == 1.0
    good, bad = netbacks.mean_netbacks(docs, 3)
    assert good.count() == 0 and bad.count() == 4


@pytest.fixture
def stream(spark, tmp_path):
    """order events as a stream of a few files."""
    rows = mapping.order_events(spark, SF).select(F.col("order_id").cast("long"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "state", "side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))
    path = str(tmp_path / "events")
    rows.repartitionByRange(4, "ts").write.parquet(path)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), str(tmp_path / "checkpoint")


def run(spark, df, mode, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.table(name)
    return spark.createDataFrame(found.collect(), found.schema)


def test_streamed_bars_are_the_batch_bars(spark, stream):
    rows, streamed, checkpoint = stream
    got = run(spark, st.bars(streamed, "side", "ts", "price", late="400 days"), "update", "bars", checkpoint)
    w = got.groupBy("side", "start").agg(F.max("volume").alias("volume"))
    last = got.join(w, ["side", "start", "volume"]).select("side", "start", "open", "high", "low", "close", "volume").distinct()
    want = st.bars(rows, "side", "ts", "price")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_order_states_end_as_the_batch_does(spark, stream):
    rows, streamed, checkpoint = stream
    got = run(spark, st.order_states(streamed), "append", "states", checkpoint)
    newest = got.groupBy("order_id").agg(F.max("ts").alias("ts"))
    want = rows.groupBy("order_id").agg(F.max("ts").alias("ts"))
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))
    last = got.join(newest, ["order_id", "ts"]).select("order_id", "state").distinct()
    assert last.count() == want.count() and last.join(rows.join(want, ["order_id", "ts"]), ["order_id", "state"], "left_anti").count() == 0


def test_an_ended_order_does_not_come_back(spark, tmp_path):
    """An event older than the end changes nothing; a newer one is a new state; a batch after the watermark has passed drops what is late."""
    schema = "order_id long, ts timestamp, state string, side string, price double, qty double"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    parts = [
        [(1, at(1), "active", "Bid", 1.0, 1.0), (2, at(1), "active", "Bid", 1.0, 1.0)],
        [(1, at(5), "withdrawn", "Bid", 1.0, 1.0)],
        [(1, at(4, 30), "active", "Offer", 2.0, 1.0), (2, None, "withdrawn", "Bid", 1.0, 1.0)],
        [(2, at(9), "active", "Bid", 3.0, None)],
        [(1, at(5, 30), "active", "Offer", 4.0, 1.0), (2, at(9, 10), "consummated", "Bid", 3.0, None)],
        [(1, at(9, 20), "active", "Bid", 5.0, 1.0)],
    ]
    path, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    seen = []
    for k, rows in enumerate(parts):  # one run a part, each from where the one before stopped
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streamed = spark.readStream.schema(schema).parquet(path)
        q = st.order_states(streamed, late="2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        now = sorted((r.order_id, r.ts.hour, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        seen.append([x for x in now if x not in (seen[0] if k == 1 else sum(seen, []))])
    assert seen == [[(1, 1, "active"), (2, 1, "active")], [(1, 5, "withdrawn")], [], [(2, 9, "active")], [(2, 9, "consummated")], [(1, 9, "active")]]
