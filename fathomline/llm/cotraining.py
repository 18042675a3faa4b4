"""Quality classification by co-training of a text view and a page-metadata view.

What makes a document good has several heads (by default: quality, and not being
toxic). For each head two naive Bayes classifiers over hashed features start from a
bounded labelled sample: one sees the words of the text, the other the page's
metadata (source, language, size and layout). In each round either one labels all
documents that it is sure of, and their features join the counts of the other. What
sure means is found on a part of the sample that is not counted: beyond which score
labels of a class hold with the precision SURE. The same part calibrates both views,
fits how their log-odds combine, and says which round to keep. A document's
probability to be good is the product over the heads.

Counts are sums over features, so a round is one pass over the staged features of all
documents and one aggregation; only features whose classes differ significantly leave
the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm._shared import by_bytes, mix64, stage, unstage
from fathomline.llm.positions import FOLD
from fathomline.llm.shingles import run_hashes

#: Labelled rows that are learned from at most: the documented bound of the sample. All other rows may get pseudo-labels.
SAMPLE = 12_000
ROUNDS = 3
#: Precision (by the rule of succession) from which the labels of a view are handed over, and deviations by which a feature's classes differ to count.
SURE, SIGNIFICANT = 0.9, 3.5
#: Slots of hashed features of either view.
TEXT_BITS, META_SLOTS = 18, 4096
#: Share of the sample kept for calibration: one in so many.
CALIBRATION = 4
VIEWS = ("text", "meta")
#: Bytes of text whose features are made at once.
PART_BYTES = 1 << 20

#: Classes of bytes: other, lower case, upper case, digit, space, newline, punctuation of prose, other punctuation, beyond ASCII.
_CLASS = np.zeros(256, np.int32)
for _k, _own in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:'\"-!?()", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASS[list(_own)] = _k
_FOLDED = np.frombuffer(FOLD, np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Bins of a layout value.
_EDGES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.36, 0.5, 0.7, 0.9])
BINS, LAYOUTS, SIZES = len(_EDGES) + 1, 14, 32


def _words(data: np.ndarray, blank: np.ndarray, first: np.ndarray, salt: int):
    """Words of joined texts: each text's number of words, hashes in order and their texts, and the distinct (text, hash) pairs with their counts."""
    hashes, start = run_hashes(data, blank)
    doc = np.searchsorted(first, start, side="right") - 1
    pairs = np.sort(doc.astype(np.uint64) << np.uint64(40) | mix64(hashes + np.uint64(salt)) >> np.uint64(24))
    new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return np.bincount(doc, minlength=len(first)), hashes, doc, pairs[new], np.diff(np.r_[new, len(pairs)])


def layout(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layout values (between 0 and 1) of texts, and the text features of all of them with their texts' places."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in raw])
    first = np.cumsum(sizes + 1) - sizes - 1
    n = len(raw)
    classes = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * 9, sizes + 1) + _CLASS[data], minlength=9 * n).reshape(n, 9).astype(float)
    classes[:, 5] -= 1
    folded = _FOLDED[data]
    words, hashes, doc, pairs, times = _words(folded, folded == 0x20, first, 1)
    written, _, _, forms, _ = _words(data, _BLANK[data], first, 2)
    owner = (pairs >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    many = np.maximum(words, 1)
    values = np.c_[classes / np.maximum(sizes, 1)[:, None], np.bincount(owner, minlength=n) / many, most / many, again / many, np.minimum(1, sizes / many / 20), np.minimum(1, np.abs(written - words) / many)]
    slots = mix64(np.r_[pairs, forms ^ np.uint64(1 << 63)] & np.uint64((1 << 40) - 1 | 1 << 63)) >> np.uint64(64 - TEXT_BITS)
    at = np.r_[owner, (forms >> np.uint64(40)).astype(np.int64)]
    order = np.argsort(at, kind="stable")
    return values, slots[order].astype(np.int32), np.searchsorted(at[order], np.arange(n + 1))


def features(texts: list, sources: list, langs: list, sizes: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By view: slots of the features of all rows, and each row's first place (one more than rows)."""
    values, text, edges = layout(texts)
    n = len(texts)
    bins = np.searchsorted(_EDGES, values, side="right") + np.arange(LAYOUTS) * BINS
    size = np.array([0 if s is None else 1 + min(SIZES - 2, int(2 * np.log2(max(s, 1)))) for s in sizes]) + LAYOUTS * BINS
    base = LAYOUTS * BINS + SIZES
    named = [[base + int.from_bytes((f"{kind}={v}").encode(), "big") % 1_000_003 % (META_SLOTS - base) if v is not None else -1 for v in own] for kind, own in (("source", sources), ("lang", langs))]
    meta = np.c_[bins, size, np.array(named, np.int64).reshape(2, n).T]
    known = meta >= 0
    return {"text": (text, edges), "meta": (meta[known].astype(np.int32), np.r_[0, np.cumsum(known.sum(1))])}


def _sums(weights: np.ndarray, slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(weights[slots], dtype=np.float64)]
    return total[edges[1:]] - total[edges[:-1]]


@dataclass
class Head:
    """A head: weights by view, calibration (slope and bias) by view, how the log-odds combine, and from which log-odds each class is sure. constant: the probability where the sample can't tell the classes apart."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, np.ndarray] = field(default_factory=lambda: {v: np.array([1.0, 0.0]) for v in VIEWS})
    combine: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0]))
    sure: dict[str, tuple[float, float]] = field(default_factory=lambda: {v: (np.inf, np.inf) for v in VIEWS})
    constant: float | None = None

    def odds(self, found: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Calibrated log-odds of rows, a column for each view."""
        return np.stack([self.scale[v][0] * _sums(self.weights[v], *found[v]) + self.scale[v][1] for v in VIEWS], axis=1)

    def good(self, odds: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(odds, -30, 30) @ self.combine[:2] + self.combine[2])


@dataclass
class Model:
    """The heads; bounded by the slots of the hashed features. rounds: the round that each head keeps."""

    heads: list[Head] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)

    def probabilities(self, found: dict[str, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Columns text, meta and good."""
        out = np.ones((n, 3))
        for h in self.heads:
            if h.constant is not None:
                out *= h.constant
            else:
                odds = h.odds(found)
                out *= np.c_[_sigmoid(odds), h.good(odds)]
        return out


def _columns(docs: DataFrame) -> DataFrame:
    """The columns that features come from; those that a table lacks are null."""
    have = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("text", "source", "lang", "n_chars")}
    return docs.select("doc_id", *[have[c].cast("string").alias(c) for c in ("text", "source", "lang")], have["n_chars"].try_cast("long").alias("n_chars"))


def _staged(docs: DataFrame, labels: DataFrame, heads: list[Column]) -> DataFrame:
    """(part, y, text, meta) of all documents, staged: part is train, calibration or pool; y has a bit for each head, text and meta hold the slots of features."""
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(h.cast("int")).alias(f"y{k}") for k, h in enumerate(heads)])
    named = named.where(" and ".join(f"y{k} is not null" for k in range(len(heads))))
    y = sum((F.col(f"y{k}") * (1 << k) for k in range(1, len(heads))), F.col("y0")).cast("int")
    chosen = stage(named.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_labelled"), y.alias("y")), "sample-ids")
    part = F.when(F.col("y").isNull(), "pool").when(F.pmod(F.xxhash64("_labelled", F.lit("part")), F.lit(CALIBRATION)) == 0, "calibration").otherwise("train")
    rows = _columns(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"), "left")  # SAMPLE rows at most
    names = ["part", "y", "text", "meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", PART_BYTES):
            part, y, *rest = b.columns
            found = features(*(c.to_pylist() for c in rest))
            lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(slots)) for slots, edges in (found[v] for v in VIEWS)]
            yield pa.RecordBatch.from_arrays([part, y, *lists], names)

    return stage(rows.select(part.alias("part"), "y", "text", "source", "lang", "n_chars").mapInArrow(run, "part string, y int, text array<int>, meta array<int>"), "features")


def _slots(b: pa.RecordBatch) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for v in VIEWS:
        column = b.column(b.schema.names.index(v))
        edges = np.asarray(column.offsets)
        out[v] = (np.asarray(column.values)[edges[0] : edges[-1]], edges - edges[0])
    return out


def _counts(table: DataFrame, heads: list[Head]) -> DataFrame:
    """(head, view, slot, bad, good, more_bad, more_good): documents of the training part, and of the pool as the other view's sure labels go, that have a feature; slot -1 counts the documents. Staged."""
    size = {"text": 1 << TEXT_BITS, "meta": META_SLOTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(k, v): np.zeros((4, size[VIEWS[v]] + 1), np.int32) for k in range(len(heads)) for v in range(2)}
        for b in batches:
            if not b.num_rows:
                continue
            found = _slots(b)
            part, y = np.array(b.column(0).to_pylist()), b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            owner = {v: np.repeat(np.arange(b.num_rows), np.diff(found[v][1])) for v in VIEWS}
            train, pool = part == "train", part == "pool"
            for k, h in enumerate(heads):
                own = y >> k & 1
                odds = h.odds(found) if h.weights else np.zeros((b.num_rows, 2))
                for v, view in enumerate(VIEWS):
                    bad, good = h.sure[VIEWS[1 - v]]
                    masks = (train & (own == 0), train & (own == 1), pool & (odds[:, 1 - v] <= -bad), pool & (odds[:, 1 - v] >= good))
                    for row, mask in zip(held[k, v], masks):
                        if mask.any():
                            row[: size[view]] += np.bincount(found[view][0][mask[owner[view]]], minlength=size[view]).astype(np.int32)
                            row[-1] += int(mask.sum())
        for (k, v), counts in held.items():
            at = np.flatnonzero(counts.any(0))
            if len(at):
                slot = np.where(at == counts.shape[1] - 1, -1, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), v, np.int32)), pa.array(slot), *(pa.array(c[at].astype(np.int64)) for c in counts)], names)

    names = ["head", "view", "slot", "bad", "good", "more_bad", "more_good"]
    rows = table.where("part <> 'calibration'").mapInArrow(run, "head int, view int, slot int, bad long, good long, more_bad long, more_good long")
    return stage(rows.groupBy("head", "view", "slot").agg(*[F.sum(c).alias(c) for c in names[3:]]), "counts")


def _weights(counts: DataFrame, heads: list[Head]) -> list[dict[str, np.ndarray]]:
    """By head and view the log-odds of features whose classes differ significantly. Pseudo-labels of a class weigh as much as its labels at most."""
    out = [{v: np.zeros(size) for v, size in (("text", 1 << TEXT_BITS), ("meta", META_SLOTS))} for _ in heads]
    totals = counts.where("slot = -1").select("head", "view", *[F.col(c).cast("double").alias(f"n_{c}") for c in ("bad", "good", "more_bad", "more_good")])
    rows = counts.where("slot >= 0").join(F.broadcast(totals), ["head", "view"])  # two rows for each head
    c = F.col
    for k in ("bad", "good"):
        share = F.when(c(f"n_more_{k}") > 0, F.least(F.lit(1.0), c(f"n_{k}") / c(f"n_more_{k}"))).otherwise(0.0)
        rows = rows.withColumn(f"c_{k}", c(k) + share * c(f"more_{k}")).withColumn(f"m_{k}", c(f"n_{k}") + share * c(f"n_more_{k}"))
    rows = rows.where("m_bad > 0 and m_good > 0")
    mean = (c("c_bad") + c("c_good")) / (c("m_bad") + c("m_good"))
    z = (c("c_good") / c("m_good") - c("c_bad") / c("m_bad")) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-9)) * (1 / c("m_good") + 1 / c("m_bad")))
    w = F.ln((c("c_good") + 0.5) / (c("m_good") + 1)) - F.ln((c("c_bad") + 0.5) / (c("m_bad") + 1))
    for r in rows.where(F.abs(z) >= SIGNIFICANT).select("head", "view", "slot", w.alias("w")).collect():  # bounded by the slots
        out[r["head"]][VIEWS[r["view"]]][r["slot"]] = r["w"]
    return out


def _sure(odds: np.ndarray, y: np.ndarray, of: int) -> float:
    """The least log-odds for class `of` beyond which its labels have the precision SURE; endless if there is none."""
    strength = odds if of else -odds
    order = np.argsort(-strength, kind="stable")
    right, n = np.cumsum(y[order] == of), np.arange(1, len(y) + 1)
    good = np.flatnonzero((right + 1) / (n + 2) >= SURE)
    return float(max(strength[order[good[-1]]], 0.0)) if len(good) else np.inf


def fit(docs: DataFrame, labels: DataFrame, heads: list[Column] | None = None, rounds: int = ROUNDS) -> Model:
    """A model from documents (doc_id, text, source, lang, n_chars) and labels (doc_id and what heads are made of).

    heads: conditions on labels that a good document meets, by default quality = 1
    and toxic = 0 (a null is taken for good). At most SAMPLE labelled rows are
    learned from, chosen by a hash of their id; every other document may get
    pseudo-labels in every round.

    Nulls and edges: labels without an id don't count; labels that share an id count
    as the worst of them; documents that share a labelled id all have its label;
    columns that docs lacks count as null. A head whose sample has one class only, or
    no row in either part, is constant: the share of good labels by the rule of
    succession, 1 without labels.
    """
    heads = [F.coalesce("quality", F.lit(1)) == 1, F.coalesce("toxic", F.lit(0)) == 0] if heads is None else heads
    table = _staged(docs, labels, heads)
    now = [Head() for _ in heads]
    best: list[tuple[float, Head, int] | None] = [None] * len(heads)
    held = table.where("part = 'calibration'").select("y", "text", "meta").toArrow().combine_chunks()  # part of the bounded sample
    held_rows = held.to_batches()[0] if held.num_rows else None
    totals = {r["y"]: r["n"] for r in table.where("y is not null").groupBy("y").agg(F.count("*").alias("n")).collect()}
    for t in range(rounds + 1):
        counts = _counts(table, now)
        weights = _weights(counts, now)
        unstage(counts)
        for k, w in enumerate(weights):
            seen = sum(totals.values())
            good = sum(n for y, n in totals.items() if y >> k & 1)
            if not 0 < good < seen or held_rows is None:
                now[k] = Head({v: np.zeros_like(x) for v, x in w.items()}, constant=(good + 1) / (seen + 2) if seen else 1.0)
                best[k] = (0.0, now[k], 0)
                continue
            y = (held_rows.column(0).to_numpy(zero_copy_only=False) >> k & 1).astype(float)
            h = Head(w)
            found = _slots(held_rows)
            h.scale = {v: _platt(_sums(w[v], *found[v]), y) for v in VIEWS}
            odds = h.odds(found)
            h.combine = _newton(odds, y)
            if h.combine[1] < 0:  # the metadata say nothing beyond the text
                h.combine = np.array([1.0, 0.0, 0.0])
            h.sure = {v: (_sure(odds[:, j], y, 0), _sure(odds[:, j], y, 1)) for j, v in enumerate(VIEWS)}
            p = h.good(odds)
            loss = -np.mean(np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-12)))
            if best[k] is None or loss <= best[k][0]:
                best[k] = (loss, h, t)
            now[k] = h
    unstage(table)
    return Model([b[1] for b in best], [b[2] for b in best])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A small logistic fit with Platt's targets: weights and bias."""
    x = np.c_[np.clip(x, -30, 30), np.ones(len(x))]
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-2 * w), -1, 1)
    return w


def _platt(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (0 at least) and bias that turn log-odds into calibrated ones; as they are without rows."""
    if not len(s):
        return np.array([1.0, 0.0])
    w = _newton(s[:, None], y)
    return w if w[0] > 0 else np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p_text, p_meta and p_good added: the views' own and the combined probability that a document is good.

    Nulls and edges: a null text counts as empty; a null source, lang or n_chars, or
    a table without such a column, has no weight; rows and other columns pass
    through, columns of the input with the added names are replaced.
    """
    added = ["p_text", "p_meta", "p_good"]
    docs = docs.select([c for c in docs.columns if c not in added])
    own = {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "source", "lang", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", PART_BYTES):
            columns = [b.column(k).to_pylist() if k is not None else [None] * b.num_rows for k in own.values()]
            p = model.probabilities(features(*columns), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(3))], [*b.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])
    return docs.mapInArrow(run, schema)
