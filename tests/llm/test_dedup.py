"""Line windows, near duplicates and decontamination against brute force."""

import hashlib
import random
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chosen_path, line_windows, positions
from fathomline.llm.queries import ORACLE_SQL, QUERIES, op4_decontamination

SMALL = "/root/testdata/sf0.001"


def brute_lines(rows, window=3):
    """rows: distinct (id, text) in their order."""
    seen, out = set(), {}
    for key, text in rows:
        if text is None:
            out[key] = (0, 0, None)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(max(1, len(lines) - window + 1)):
            own = tuple(lines[i : i + window])
            if all(not x.strip(" ") for x in own):
                continue
            if own in seen:
                gone |= set(range(i, i + len(own)))
            seen.add(own)
        out[key] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines_are_brute_force(spark, edges, edge_rows):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randint(1, 9)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_windows.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    rows = [(r[0], r[1]) for r in edge_rows[:14] if r[0] != 3]
    part = edges.where("doc_id <> 3").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_windows.dedup_lines(part).collect()}
    assert got == brute_lines(rows)


def test_lines_edges(edges, nothing):
    out = line_windows.dedup_lines(edges)
    assert out.columns == [*edges.columns, "n_lines", "n_removed"] and out.count() == edges.count()
    assert line_windows.dedup_lines(nothing).count() == 0
    again = line_windows.dedup_lines(out.select("doc_id", "text", "n_lines"))
    assert again.columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_lines_sql(spark):
    name = "op5_line_dedup"
    assert compare.spark_rows(QUERIES[name](spark, SMALL)) == compare.sql_rows(ORACLE_SQL[name], SMALL)


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_near(rows):
    """rows: (id, text) with ids that may be repeated."""
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def near(docs):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(docs).collect())


def planted(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 90))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base[: 4 if i % 3 == 0 else None]))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 7 % n, " ".join(words)))
    return rows


def test_near_duplicates_are_brute_force(spark, edges, edge_rows):
    rows = planted(400, 1)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)
    assert near(edges.where("doc_id is not null")) == brute_near([(r[0], r[1]) for r in edge_rows if r[0] is not None])
    out = chosen_path.near_duplicates(edges.where("doc_id is null")).collect()
    assert len(out) == 2 and all(r.kept and r.component_id is None for r in out)


def test_near_duplicates_branch(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 8)
    monkeypatch.setattr(chosen_path, "DEPTH", 3)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rows = planted(300, 2)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_near_duplicates_of_named_documents(spark):
    rows = planted(120, 5)
    docs = spark.createDataFrame([(f"n{i:04}", t) for i, t in rows] + [(None, rows[0][1])], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id or "", r.kept) for r in chosen_path.near_duplicates(docs).collect())
    assert got[0] == ("", len(shingles(rows[0][1])), "", True)
    assert got[1:] == [(f"n{i:04}", n, f"n{c:04}", k) for i, n, c, k in brute_near(rows)]


def chain(n, size=60, step=8):
    """Texts of which neighbours are linked, by exactly 75 in 100, and no others."""
    words = [f"c{k}" for k in range(n * step + size)]
    return [(i, " ".join(words[i * step : i * step + size])) for i in range(n)]


def test_near_duplicates_of_few_long_texts(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 400)  # a cluster of several blocks by its shingles, not by its sets
    rows = chain(30)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(5, one), (7, one), (7, two), (9, two), (9, three), (11, three), (12, "no copy of any of these others")]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_components_of_a_hub_and_a_chain(spark):
    links = [(i, 0) for i in range(1, 500)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    found = chosen_path.components(spark.createDataFrame(links, "u long, v long").repartition(7))
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1, 500)] + [(1001 + i, 1000) for i in range(60)]


def staged(monkeypatch):
    """Labels of the tables that the operator stages from now on."""
    labels, real = [], chosen_path.stage
    monkeypatch.setattr(chosen_path, "stage", lambda df, label: labels.append(label) or real(df, label))
    return labels


def test_roots_of_chains_in_any_order():
    rng = np.random.default_rng(4)
    for n in (2, 3, 10, 101, 1000):
        names = rng.permutation(n)
        order = rng.permutation(n - 1)
        assert (chosen_path._roots(n, names[:-1][order], names[1:][order]) == 0).all()
    for n, m in ((50, 20), (200, 150), (500, 600)):
        left, right = rng.integers(0, n, (2, m))
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(left, right):
                want[a] = want[b] = min(want[a], want[b])
        assert (chosen_path._roots(n, left, right) == want).all()


def test_components_that_are_stars_take_no_step(spark, monkeypatch):
    labels = staged(monkeypatch)
    links = [(i, i % 3) for i in range(3, 300)] * 2
    found = chosen_path.components(spark.createDataFrame(links, "u long, v long").repartition(7))
    assert sorted(map(tuple, found.collect())) == [(i, i % 3) for i in range(3, 300)]
    assert labels == ["edges", "least"]


def test_near_duplicates_compare_nodes_of_all_levels_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "ALIKE", 2)  # no node is left whole before the last level
    labels = staged(monkeypatch)
    rows = planted(200, 3)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)
    levels = labels.count("nodes")
    assert levels == chosen_path.DEPTH + 1 and labels.count("links") == 2 and labels.count("alike") == levels - 1


def test_near_duplicates_join_parts_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 4)
    monkeypatch.setattr(chosen_path, "PIVOTS", 1)
    labels = staged(monkeypatch)
    rows = [(i * 37 % 101, t) for i, t in chain(101)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)
    assert labels.count("rest") == 1


def test_near_duplicates_sample(spark, sample, nothing):
    rows = sample.where("length(text) < 4000").select("doc_id", "text")
    assert near(rows) == brute_near([tuple(r) for r in rows.collect()])
    assert near(nothing) == []


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    own, hit, found = words(text), set(), set()
    at = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            at.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [str(item)])
    for size in {len(w) for w in at}:
        for i in range(len(own) - size + 1):
            if (ids := at.get(tuple(own[i : i + size]))) is not None:
                hit |= set(range(i, i + size))
                found |= ids
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("turn_bytes", [positions.TURN_BYTES, 120])
def test_decontamination_edges(spark, edges, nothing, turn_bytes):
    items = spark.createDataFrame([("a", "ONE two"), ("b", None), ("c", ""), ("d", "two three, four"), ("d", "x a b c y"), (None, "one"), ("e", "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha beta")], "item_id string, text string")
    want = sorted((repr(r.doc_id), *brute_hits(r.text, [tuple(x) for x in items.collect()])) for r in edges.collect())
    found = positions.decontaminate(edges, items, turn_bytes=turn_bytes).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in found) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in found)
    assert positions.decontaminate(nothing, items).count() == 0
    assert positions.decontaminate(edges, items.limit(0)).where("contaminated").count() == 0


def test_op4_is_brute_force(spark, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = []
    for r in sample.collect():
        n, hit, ids = brute_hits(r.text, items)
        want.append((r.doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    got = [tuple(r) for r in op4_decontamination(spark, SMALL).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got) == sorted(want) and any(w[-1] for w in want)


def test_proximity_and_phrases(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat x x x cat"), (3, "cat"), (None, "a cat on a mat")], "doc_id long, text string")
    index = positions.build_index(docs)
    found = positions.proximity_matches(index, [("q", [b"cat", b"mat"], 5)]).collect()
    assert sorted((r.doc_id or 0, r["first"], r["size"]) for r in found) == [(0, 1, 4), (1, 1, 5), (2, 0, 5)]
    exact = positions.phrase_matches(index, [("p", [b"on", b"the"])]).collect()
    assert [(r.doc_id, [(s["first"], s["last"]) for s in r.spans]) for r in exact] == [(1, [(3, 4)])]
    assert index.select(F.explode("doc_ids")).count() == 4
