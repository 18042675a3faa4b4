"""Pages and files of differing columns: order, failures and restarts, broken documents."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fathomline.operators.numbering import numbered
from fathomline.sources import drift, paging


def test_places_within_groups_of_any_size(spark):
    rows = spark.range(3000, numPartitions=5).select(F.when(F.col("id") % 10 > 0, F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))).alias("g"), (F.col("id") * 7919 % 3000).alias("x"))
    got = numbered(rows, ["g"], [F.desc("x")])
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: -r.x):
        want.setdefault(r.g, []).append(r.x)
    assert sorted(((r.g, r.place, r.x) for r in got.collect()), key=repr) == sorted(((g, k, x) for g, xs in want.items() for k, x in enumerate(xs)), key=repr)
    spread = rows.where("g = 'hot'")
    assert numbered(rows.limit(0), ["g"], [F.asc("x")]).count() == 0
    assert numbered(spread, ["g"], [F.asc("x")]).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.fixture
def pages(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if k % 5 == 0 else f"q{k}\"") for k in range(25)] + [("b", 1, None, "x")], "s string, id int, d date, text string")
    path = str(tmp_path / "pages")
    paging.land_pages(rows, "s", [F.desc("d"), F.asc("id")], 10, path)
    return rows, path


def test_pages_hold_the_rows_in_order(spark, pages):
    _, path = pages
    found = paging.read_pages(spark, path)
    got = found.select("series", "page", "place", F.from_json("doc", "id int, d date, text string").alias("x"), "error").orderBy("series", "page", "place").collect()
    assert [(r.series, r.page, r.place, r.x.id) for r in got] == [("a", k // 10, k % 10, 24 - k) for k in range(25)] + [("b", 0, 0, 1)]
    assert got[0].x.text == 'q24"' and got[4].x.text is None and got[-1].x.d is None and all(r.error is None for r in got)
    some = paging.read_pages(spark, path, first=1, n=1)
    assert sorted((r.series, r.page) for r in some.select("series", "page").distinct().collect()) == [("a", 1)]
    assert "PartitionFilters: [isnotnull(page" in some._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="exists"):
        paging.land_pages(spark.createDataFrame([("a", 1)], "s string, id int"), "s", [F.asc("id")], 10, path)


def test_broken_and_empty_pages(spark, tmp_path):
    for k, text in enumerate(['{"data": [{"id": 1}, 5, null]}', '{"data": []}', "{", '{"error": 1}']):
        os.makedirs(tmp_path / f"series=a/page={k}")
        (tmp_path / f"series=a/page={k}/x.txt").write_text(text)
    rows = sorted((r.page, r.place, r.doc, (r.error or "")[:8]) for r in paging.read_pages(spark, str(tmp_path)).where("doc is not null or error is not null").collect() if r.doc or r.error)
    assert rows == [(0, 0, '{"id":1}', ""), (0, 1, "5", ""), (2, 0, None, "no page:"), (3, 0, None, "no page:")]


def test_a_stream_that_fails_and_starts_again_has_each_row_once(spark, pages, tmp_path):
    rows, path = pages
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sizes, failed = [], []

    def keep(batch, number):
        found = batch.collect()
        sizes.append(len({(r.series, r.page) for r in found}))
        if number == 1 and not failed:
            failed.append(sorted((r.series, r.page, r.place) for r in found))
            raise RuntimeError("killed")
        if failed and number == 1:
            assert sorted((r.series, r.page, r.place) for r in found) == failed[0]  # the same pages again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        q = paging.stream_pages(spark, path, 1).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert set(sizes) == {1} and len(sizes) == 5
    more = spark.createDataFrame([("c", 9, None, "new")], rows.schema)
    paging.land_pages(more, "s", [F.asc("id")], 10, path, mode="append")
    run()
    got = spark.read.parquet(out).select("series", F.get_json_object("doc", "$.id").cast("int").alias("id")).collect()
    assert sorted(map(tuple, got)) == sorted([("a", k) for k in range(25)] + [("b", 1), ("c", 9)])


def test_files_of_differing_columns(spark, tmp_path):
    files = {
        "a.csv": "Slot,Price\r\n1,2.5\r\n2,\r\n",
        "b.csv": "﻿price ,SLOT,Remark,Remark\n7,3,\"a, \"\"b\"\"\nc\",second\nx,4,,\n\n",
        "c.csv": "Slot\n",
        "d.csv": '{"errors":[{"code":"object_not_found"}]}',
        "e.csv": "Slot,Price\n1,2,3\n",
        "f.csv": "<html>",
        "h.csv": 'Slot\n"open',
        "sub/i.csv": "Other\n9\n",
    }
    os.makedirs(tmp_path / "sub")
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes(b"Slot\n\xff\xfe")
    (tmp_path / "empty.csv").write_bytes(b"")
    rows, broken = drift.read_drifting(spark, str(tmp_path), "slot long, price double")
    got = sorted((os.path.basename(r._path), r._row, r.slot, r.price, sorted(r._rest.items())) for r in rows.collect())
    assert got == [
        ("a.csv", 1, 1, 2.5, []),
        ("a.csv", 2, 2, None, []),
        ("b.csv", 1, 3, 7.0, [("Remark", 'a, "b"\nc')]),
        ("b.csv", 2, 4, None, []),
        ("i.csv", 1, None, None, [("Other", "9")]),
    ]
    assert sorted(os.path.basename(r._path) for r in broken.collect()) == ["d.csv", "e.csv", "f.csv", "g.csv", "h.csv"]
    assert sorted(map(tuple, drift.headers(drift.scan(spark, str(tmp_path))).collect())) == [("Other", 1), ("Price", 1), ("Remark", 1), ("SLOT", 1), ("Slot", 1), ("price", 1)]
