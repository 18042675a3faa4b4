"""Removal of repeated byte strings against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from fathomline.llm import suffix_sort

NO_ID = (1 << 63) - 1


def brute(rows, depth):
    raw = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in raw:
        for p in range(len(t) - depth + 1):
            first[t[p : p + depth]] = min(i, first.get(t[p : p + depth], i))
    out = []
    for (i0, _), (i, t) in zip(rows, raw):
        mask = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if first[t[p : p + depth]] < i:
                mask[p : p + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(t)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((repr(i0), len(t), sum(mask), spans, bytes(b for b, m in zip(t, mask) if not m)))
    return sorted(out)


def found(docs, **more):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_sort.dedup_strings(docs, **more).collect())


@pytest.mark.parametrize("hot", [2, 4096])
def test_edges(edges, edge_rows, nothing, hot):
    assert found(edges, hot=hot) == brute([r[:2] for r in edge_rows], 50)
    assert found(nothing) == []


@pytest.mark.parametrize("hot", [3, 4096])
def test_sample(sample, hot):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    want = brute(rows, 50)
    assert found(sample, hot=hot) == want and sum(r[2] for r in want) > 10_000
    assert found(sample.repartition(7), hot=hot) == want


@pytest.mark.parametrize("depth", [24, 50, 61])
def test_made_texts(spark, monkeypatch, depth):
    """Overlaps, edges of blocks, runs of one letter, strings just too short, bytes of several a character."""
    rng = random.Random(depth)
    pool = ["".join(rng.choice("ab é漢") for _ in range(rng.choice([depth // 2, depth - 1, depth, depth + 1, 90, 400]))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) + rng.choice(["", "x", str(k)]) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [(k, "a" * n) for k, n in ((90, depth - 1), (91, depth), (92, 3 * depth), (93, 3000), (94, 2999))] + [(5, rows[9][1]), (None, rows[3][1]), (None, pool[-1] * 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    want = brute(rows, depth)
    monkeypatch.setattr(suffix_sort, "BLOCK_BYTES", 700)
    assert found(docs, depth=depth, hot=2) == want
    assert found(docs, depth=depth) == want


def test_long_text_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "z" * 3_000_000), (2, "z" * 2_000_000 + "q"), (3, "y" * 60)], "doc_id long, text string")
    assert [(r[2], r[3]) for r in found(docs)] == [(0, 0), (2_000_000, 1), (0, 0)]


def test_runs_hold_every_suffix_once():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 10, 49, 50, 51, 1000, 70_000, 0)]
    whole = b"\0".join([*texts, b""])
    import pyarrow as pa

    block = suffix_sort.Block({"block": 0, "size": len(whole), "data": pa.compress(whole, "zstd", asbytes=True), "ids": list(range(8)), "ends": np.cumsum([len(t) + 1 for t in texts]).tolist()})
    digit, place, length, text = suffix_sort.runs(block, 50)
    seen = np.concatenate([np.arange(p, p + n) for p, n in zip(place, length)])
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    assert seen.tolist() == [s + k for s, t in zip(start.tolist(), texts) for k in range(len(t) - 49)]
    assert length.max() <= suffix_sort.RUN and (block.starts[text] <= place).all()
    strings: dict[bytes, int] = {}
    for d, p, n in zip(digit.tolist(), place.tolist(), length.tolist()):
        for k in range(p, p + n):
            assert strings.setdefault(whole[k : k + 50], d) == d


def test_ids_and_depths_that_it_refuses(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        suffix_sort.dedup_strings(docs)
    with pytest.raises(ValueError):
        suffix_sort.dedup_strings(docs.selectExpr("1 as doc_id", "text"), depth=10)


def test_blocks_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a" * 70), (2, "b" * 60 + "a" * 60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = suffix_sort.dedup_strings(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(block#") == 2  # what is told to the blocks, not the blocks
        assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 60}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_phrases_shorter_than_a_long_gram_send_no_text(spark):
    """Texts that have only phrases of 20 bytes in common, as any large corpus has."""
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abcdefghij") * (n % 3) + chr(98 + rng.randrange(24)) for n in range(60)) + "this is the phrase, " + "".join(chr(97 + rng.randrange(26)) for _ in range(60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = suffix_sort.build_blocks(docs, "doc_id", "text")
    assert suffix_sort.shared_digits(suffix_sort.first_digits(blocks, 50, 4), 4096).count() == 0
    assert found(docs) == brute(rows, 50)


@pytest.mark.parametrize("turn", [1e9, 0.2])
def test_steps_keep_neither_shuffles_nor_replies(spark, monkeypatch, turn):
    """A corpus sorted in steps: the same rows, in one turn and in several, and nothing left of what was shuffled for them."""
    rng = random.Random(7)
    pool = ["".join(rng.choice("ab é漢") for _ in range(rng.choice([49, 50, 51, 90, 400]))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) + rng.choice(["", "x", str(k)]) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [(90, "a" * 49), (91, "a" * 3000), (92, "a" * 2999), (None, rows[3][1]), (5, rows[9][1]), (93, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    written, append = [], suffix_sort.bucketed
    monkeypatch.setattr(suffix_sort, "bucketed", lambda rows, name, n, mode="error": (written.append(name), append(rows, name, n, mode))[1])
    monkeypatch.setattr(suffix_sort, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffix_sort, "STEPS_FROM", 1)
    monkeypatch.setattr(suffix_sort, "TURN", turn)
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for hot in (2, 4096):
        before = {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
        got = suffix_sort.dedup_strings(docs, hot=hot)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == brute(rows, 50)
        since = {f.name.split("_")[1] for d in folders for f in Path(d).rglob("shuffle_*.data") if f not in before}
        assert len(since) <= 2  # the test's own and the sum of sizes
    assert (len([n for n in written if n.startswith("suffix_gone")]) > 2) == (turn < 1)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept
    assert not any(t.name.startswith("suffix_replies") for t in spark.catalog.listTables())
