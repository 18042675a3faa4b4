"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments. A segment holds some documents, the places where
each of them starts, and for every term of its texts the sorted places of its
occurrences; it knows nothing of what will be looked for. A phrase is found in a
segment by intersecting the lists of its terms, shifted by their offsets, from the
rarest term on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, stage, unstage

#: Words in a window of a benchmark item.
WINDOW = 10
#: Bytes of text in a segment, about.
SEGMENT_BYTES = 8 << 20
#: Bytes of test texts that are sent to every task at once; more are taken in several turns.
TURN_BYTES = 4 << 20

#: Lower-cases A-Z, keeps digits, a-z and all bytes of characters beyond ASCII, and makes all else a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The folded words of a text; none for null."""
    return (text or "").encode().translate(FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all documents and all their terms, written as a table in the shared folder.

    Columns: segment, doc_ids, starts (int32, one more than documents), terms,
    offsets and places (int32, differences within a list). A null or empty text is
    a document without words; ids may be null or repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(by_bytes(batches, "text", segment_bytes)):
            table: dict[bytes, int] = {}
            number = table.setdefault
            starts, found, at = [0], [], 0
            for text in b.column(1).to_pylist():
                own = words(text)
                found.append(np.fromiter([number(w, len(table)) for w in own], np.int32, len(own)))
                at += len(own)
                starts.append(at)
            ids = np.concatenate(found)
            places = np.argsort(ids, kind="stable").astype(np.int32)
            ids = ids[places]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
            delta = np.diff(places, prepend=np.int32(0)).astype(np.int32)
            delta[first] = places[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{n}"]),
                    pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)),
                    pa.array([np.array(starts, np.int32).tobytes()], pa.binary()),
                    pa.array([list(table)], pa.list_(pa.binary())),
                    pa.array([np.r_[first, len(ids)].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([delta.tobytes()], pa.binary()),
                ],
                ["segment", "doc_ids", "starts", "terms", "offsets", "places"],
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stage(texts.mapInArrow(run, f"segment string, doc_ids array<{kind}>, starts binary, terms array<binary>, offsets binary, places binary"), "postings")


class Segment:
    """The lists of one segment."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.offsets, self.delta = np.frombuffer(row["offsets"], np.int32), np.frombuffer(row["places"], np.int32)
        self.lists = dict(zip(row["terms"], range(len(row["terms"]))))
        self.open: dict[bytes, np.ndarray] = {}

    def count(self, term: bytes) -> int:
        k = self.lists.get(term)
        return 0 if k is None else int(self.offsets[k + 1] - self.offsets[k])

    def places(self, term: bytes) -> np.ndarray:
        if term not in self.open:
            k = self.lists[term]
            self.open[term] = np.cumsum(self.delta[self.offsets[k] : self.offsets[k + 1]])
        return self.open[term]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Places where the terms follow each other within one document."""
        counts = [self.count(t) for t in terms]
        if not terms or not min(counts):
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=counts.__getitem__)
        start = self.places(terms[order[0]]) - order[0]
        start = start[start >= 0]
        for k in order[1:]:
            if not len(start):
                return start
            own = self.places(terms[k])
            at = np.searchsorted(own, start + k)
            start = start[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == start + k)]
        doc = np.searchsorted(self.starts, start, side="right") - 1
        return start[start + len(terms) <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)]]

    def near(self, terms: list[bytes], within: int) -> list[tuple[int, int]]:
        """Shortest spans (place, words) of at most `within` words in one document that hold all the terms, one for each place of the rarest."""
        terms = list(dict.fromkeys(terms))
        counts = [self.count(t) for t in terms]
        if not terms or not min(counts):
            return []
        rare = min(range(len(terms)), key=counts.__getitem__)
        out = []
        for p in self.places(terms[rare]).tolist():
            doc = int(np.searchsorted(self.starts, p, side="right")) - 1
            low, high = max(p - within + 1, int(self.starts[doc])), min(p + within, int(self.starts[doc + 1]))
            here = {t: x[np.searchsorted(x, low) : np.searchsorted(x, high)] for t in terms for x in [self.places(t)]}
            if not all(len(x) for x in here.values()):
                continue
            best = None
            for first in sorted({p, *(int(y) for x in here.values() for y in x if y <= p)}, reverse=True):
                at = [np.searchsorted(x, first) for x in here.values()]
                if all(k < len(x) for k, x in zip(at, here.values())):
                    size = max(p, *(int(x[k]) for k, x in zip(at, here.values()))) - first + 1
                    if size <= within and (best is None or size < best[1]):
                        best = (first, size)
            if best:
                out.append(best)
        return out


def _search(index: DataFrame, find, extra: str) -> DataFrame:
    """Rows (segment, ordinal, doc_id, n_words, *extra) of find(segment) -> [(ordinal, *values)], which must name every document once with nulls."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"segment string, ordinal int, doc_id {kind}, n_words long, {extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([])
        for b in batches:
            kinds = [pa.string(), pa.int32(), b.schema.field("doc_ids").type.value_type, pa.int64(), *find.types]
            target = pa.schema(list(zip(find.names, kinds)))
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = Segment(row)
                sizes = np.diff(s.starts)
                found = [(row["segment"], k, s.doc_ids[k], int(sizes[k]), *v) for k, *v in find(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], schema=target)

    return index.mapInArrow(run, schema)


class _Phrases:
    names = ["segment", "ordinal", "doc_id", "n_words", "item_id", "spans"]
    types = [pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int | None, every: bool):
        self.items, self.window, self.every = items, window, every

    def __call__(self, s: Segment):
        hits: dict[tuple[int, str | None], list[tuple[int, int]]] = {}
        for item, own in self.items:
            size = min(self.window or len(own), len(own))
            have = [w in s.lists for w in own]
            missing = size - sum(have[:size]) if own else 1
            for i in range(len(own) - size + 1):
                if i:
                    missing += have[i - 1] - have[i + size - 1]
                if missing:
                    continue
                start = s.phrase(own[i : i + size])
                for d, p in zip((np.searchsorted(s.starts, start, side="right") - 1).tolist(), start.tolist()):
                    hits.setdefault((d, item), []).append((p - int(s.starts[d]), p - int(s.starts[d]) + size - 1))
        for (d, item), spans in hits.items():
            merged: list[list[int]] = []
            for a, b in sorted(set(spans)):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            yield d, item, [{"first": a, "last": b} for a, b in merged]
        if self.every:
            for d in range(len(s.doc_ids)):
                yield d, None, None


class _Near:
    names = ["segment", "ordinal", "doc_id", "n_words", "query", "first", "size"]
    types = [pa.string(), pa.int32(), pa.int32()]

    def __init__(self, groups: list[tuple[str, list[bytes], int]]):
        self.groups = groups

    def __call__(self, s: Segment):
        for name, terms, within in self.groups:
            for p, size in s.near(terms, within):
                d = int(np.searchsorted(s.starts, p, side="right")) - 1
                yield d, name, p - int(s.starts[d]), size


def phrase_matches(index: DataFrame, phrases: list[tuple[str | None, list[bytes]]], every: bool = False, window: int | None = None) -> DataFrame:
    """(segment, ordinal, doc_id, n_words, item_id, spans): merged word spans that the phrases of an item cover.

    window: every run of so many consecutive terms of a phrase is looked for, not
    the whole (a shorter phrase is one run). phrases is sent to every task: a
    bounded set, as decontaminate() takes them in turns. every adds a row with null
    spans for each document. An item without an id is found under a null id.
    """
    return _search(index, _Phrases(phrases, window, every), "item_id string, spans array<struct<first:int,last:int>>")


def proximity_matches(index: DataFrame, groups: list[tuple[str, list[bytes], int]]) -> DataFrame:
    """(…, query, first, size): for each (name, terms, within) the spans of at most `within` words that hold all the terms, in any order.

    One span, the shortest, for each place of the term that is rarest in the segment.
    """
    return _search(index, _Near(groups), "query string, first int, size int")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", turn_bytes: int = TURN_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, item_ids (sorted as text), spans (merged), contaminated.

    A word is hit if it lies in an occurrence of `window` consecutive words of an
    item; an item of fewer words, but not none, is one window. Every document is
    indexed with all its terms, once. The items are taken in turns of about
    turn_bytes of text, the matches of each turn written before the next, so that
    neither the driver nor a task holds more than one turn, however large the
    benchmark is.

    Nulls and edges: a null or empty text has no words; items with a null id count
    for n_hit and contaminated but have no id to be listed or counted in n_items;
    items that share an id are one item; document ids may be null or repeated, each
    row has its own result; an empty table gives no row; other columns are dropped.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    turns = max(1, math.ceil(size / turn_bytes))
    index, found = build_index(docs, id_col, text_col), None
    for k in range(turns):
        rows = [(r.item_id, words(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == k).collect()]
        here = stage(phrase_matches(index, rows, every=k == 0, window=window), "matches")
        found = here if found is None else found.unionByName(here)
    unstage(index)
    span = F.flatten(F.collect_list("spans"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("all_spans", lambda s: F.sequence(s["first"], s["last"])))))
    merged = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), span.alias("all_spans"))
    return merged.select(
        id_col, "n_words", hit.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.array_sort("all_spans").alias("spans"), (hit > 0).alias("contaminated")
    )
