"""Importance resampling against brute force, and its quickselect against sorting."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from fathomline.llm import resampling

FOLD = {c: c + 32 for c in range(65, 91)}


def features(text, longest):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(FOLD))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) % 97 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest, percent, least):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text, longest)[1])
    for text in target:
        t.update(features(text, longest)[1])
    gain = [math.floor(1000 * math.log(((t[b] + 1) * float(s.total() + 97)) / ((s[b] + 1) * float(t.total() + 97)))) for b in range(97)]
    out = []
    for i, text in rows:
        words, own = features(text, longest)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"9:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return out, drawn


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("stretch", [7, 1 << 20])
def test_weights_scores_and_ranks(spark, sample, edges, edge_rows, monkeypatch, longest, stretch):
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    target = ["one two three Four", None, "", "the benchmark ITEM 漢字 é"]
    for docs, rows in ((sample, [(r.doc_id, r.text) for r in sample.collect()]), (edges, [r[:2] for r in edge_rows])):
        want, drawn = brute(rows, target, longest, 40, 3)
        kept = spark.createDataFrame([(t,) for t in target], "text string")
        got = resampling.resample(docs, kept, 40, 3, 9, longest, 97).collect()
        plain = lambda rows: sorted(map(repr, rows))
        assert plain(tuple(r)[:5] for r in got) == plain(want)
        ranks = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
        assert [r.rank for r in ranks] == list(range(1, len(drawn) + 1))
        assert [(r.score, r.doc_id) for r in ranks] == [(r[4], r[0]) for r in drawn]


def test_nothing(spark, nothing, edges):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, empty).count() == 0
    assert resampling.resample(edges, empty, percent=0).where("rank is not null").count() == 0
    every = resampling.resample(edges, empty, percent=100, least_words=0)
    assert every.where("rank is null").count() == 0 and every.agg(F.max("rank")).first()[0] == edges.count()


@pytest.mark.parametrize("n", [1, 5, 33, 5000])
def test_quickselect_is_a_place_in_the_sorted_rows(spark, n):
    rows = spark.range(n, numPartitions=4).select((F.xxhash64("id") % 3).alias("down"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("b"), F.col("id").cast("string").alias("c"))
    want = [tuple(r) for r in rows.orderBy("down", "b", "c").collect()]
    for k in {1, n, n // 2 + 1, min(n, 40)}:
        assert tuple(resampling.kth_key(rows, ["down", "b", "c"], k, 4).values()) == want[k - 1]


def test_ranks_follow_the_order_over_all_ranges(spark):
    rows = spark.range(3000, numPartitions=5).select((F.col("id") * 7919 % 3000).alias("x"))
    assert resampling.ranked(rows, ["x"]).where("rank <> x + 1").count() == 0
    assert resampling.ranked(rows.where("x < 0"), ["x"]).count() == 0
