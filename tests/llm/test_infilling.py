"""Fill-in-middle against a plain version, and its chunks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import infilling


def brute(rows, seed=1):
    out = []
    for i, text in rows:
        text = text or ""
        x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        if not text or any(y in text for y in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((repr(i), n, "plain", None, None, text, text))
        elif h4 % 100 < 20:
            out.append((repr(i), n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text))
        else:
            out.append((repr(i), n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text))
    return sorted(out, key=repr)


def found(docs):
    rows = infilling.fill_in_middle(docs).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    return sorted(((repr(r.doc_id), *tuple(r)[1:]) for r in rows.collect()), key=repr)


def test_edges_and_sample(edges, edge_rows, sample, nothing):
    assert found(edges) == brute([r[:2] for r in edge_rows])
    rows = brute([(r.doc_id, r.text) for r in sample.collect()])
    assert found(sample) == rows and {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert found(nothing) == []


def test_markers_and_their_parts(spark):
    texts = ["<P>", "a<S>b", "x<M>", "<", "<P", "P>", "<<S", "<S><", "S><M", "<M<P<S", "é<", "漢<P漢>"] * 20 + ["ab " * 3000 + "<M>" + " cd" * 3000]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_long_texts_share_chunks(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdé漢 \n") for _ in range(500_000))
    rows = [(k, "x" * k + shared + "y" * k) for k in range(6)] + [(9, "q" * 2_500_000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("stretch", [40, 1000, 1 << 20])
def test_chunks_are_cut_by_content(monkeypatch, stretch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8)
    want = infilling.chunk_ends(data)
    monkeypatch.setattr(infilling, "STRETCH", stretch)
    assert infilling.chunk_ends(data) == want and want[-1] == len(data)
    size = np.diff([0, *want])
    assert size[:-1].min() >= infilling.LEAST and size.max() <= infilling.MOST and 300 < size.mean() < 900
    moved = infilling.chunk_ends(np.r_[rng.integers(97, 123, 777, dtype=np.uint8), data])
    assert len({x + 777 for x in want} & set(moved)) > 0.95 * len(want)
    assert max(np.diff([0, *infilling.chunk_ends(np.full(50_000, 97, np.uint8))])) <= infilling.MOST and infilling.chunk_ends(data[:0]) == []


def test_summaries_are_remembered_within_a_bound():
    chunks = infilling.Chunks(1000)
    parts = [bytes([k]) * 300 for k in range(5)]
    for p in parts * 3:
        assert chunks.of(p) == infilling.summary(p) and chunks.held <= 1000
    data = ("é<" * 400 + "漢" * 200).encode()
    text = infilling.Counted(data, chunks)
    whole = data.decode()
    assert text.points == len(whole) and not text.marked
    assert [text.place(k) for k in range(0, len(whole) + 1, 7)] == [len(whole[:k].encode()) for k in range(0, len(whole) + 1, 7)]
