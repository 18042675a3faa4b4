"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to order 5, learned from the training
texts of the whole corpus. Escapes are estimated as in method D, with a discount
in place of its half: in a context with n counted symbols of d kinds, a symbol
counted c times has (c-discount)/n and the escape discount*d/n.
After an escape the symbols of the longer context are excluded from n and d. At
the longest order counts are occurrences; below, a symbol counts once for each
longer context that has it (update exclusion). A text is preceded by five start
marks and followed by one end mark, which is coded too.

The corpus is cut into blocks of documents. A block's distinct six-byte strings
travel in buckets by the last three bytes of their context: a bucket has whole
subtries from order 3 on; orders 2 to 0 are one table of at most 2^24 strings of three
bytes, as many as the languages have, which all tasks get. A bucket's strings are
dealt into groups by the size of what blocks ask of it, for counting and for looking
up, so that a common context is no larger task than others and the model is copied
only once for each LOOKUP_BYTES of questions. Word counts for the base score take the
same way, in buckets by hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, mix64, stage

#: What the escape takes from each symbol's count (0.5 would be method D).
DISCOUNT = 0.4
#: Longest context in bytes.
ORDER = 5
#: Marks that no UTF-8 text has.
START, END = 0xFE, 0xFF
#: Symbols that can follow a context: all bytes but the start mark.
SYMBOLS = 255
#: Bytes of text in a block and in a part of it that is worked on at once.
BLOCK_BYTES, PART_BYTES = 32 << 20, 2 << 20
#: Buckets for so many bytes of text, and the least number.
BUCKET_BYTES, BUCKETS = 16 << 20, 64
#: Bytes of keys of a bucket that one task counts or looks up.
LOOKUP_BYTES = 48 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every byte and end mark, and the number of them in each text."""
    pad = bytes([START]) * ORDER
    data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    packed = np.zeros(len(data) - ORDER, np.int64) if len(data) else np.zeros(0, np.int64)
    for k in range(ORDER + 1):
        packed <<= 8
        packed |= data[k : len(data) - ORDER + k]
    ends = np.cumsum(sizes + ORDER)
    keep = np.ones(len(packed), bool)
    for k in range(ORDER):
        at = ends[:-1] - ORDER + k
        keep[at] = False
    return packed[keep], sizes


def tokens(text: bytes) -> list[bytes]:
    """Words of a folded text and one end, which is the empty word."""
    return [*text.lower().split(), b""]


def token_keys(words) -> np.ndarray:
    """64-bit hashes of words, as signed numbers."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def gram_bucket(packed: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the last three bytes of the context."""
    return (mix64((packed >> 8 & 0xFFFFFF).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def token_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, counts as 32-bit numbers (64 where they need it)."""
    small = not len(counts) or counts.max() < 1 << 31
    return np.diff(keys, prepend=np.int64(0)).tobytes(), counts.astype(np.int32 if small else np.int64).tobytes()


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.cumsum(np.frombuffer(keys, np.int64))
    wide = len(keys) and len(counts) == 8 * len(keys)
    return keys, np.frombuffer(counts, np.int64 if wide else np.int32).astype(np.int64)


def blocks(docs: DataFrame, training: Column, buckets: int) -> DataFrame:
    """The staged blocks: rows of kind d (documents), g (strings) and t (words).

    kind d: block, doc_ids, training flags and texts; g and t: block, bucket, the
    block's distinct keys there (held-out texts too) and their training counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "bucket", "doc_ids", "flags", "texts", "keys", "counts", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for number, b in enumerate(by_bytes(batches, "text", BLOCK_BYTES)):
            types = [pa.string(), pa.int32(), pa.list_(b.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.string()]
            block = f"{TaskContext.get().partitionId()}-{number}"
            found, words = [], Counter()
            for part in by_bytes(iter([b]), "text", PART_BYTES):
                texts = [t.encode() for t in part.column(1).fill_null("").to_pylist()]
                flags = part.column(2).to_pylist()
                yield row(block, 0, part.column(0).to_pylist(), flags, texts, None, None, "d")
                for flag in (True, False):
                    own = [t for t, f in zip(texts, flags) if f == flag]
                    if own:
                        keys, n = np.unique(grams(own)[0], return_counts=True)
                        found.append((keys, n if flag else np.zeros(len(keys), np.int64)))
                    for t in own:
                        words.update(tokens(t)) if flag else words.update(dict.fromkeys(tokens(t), 0))
                if len(found) > 8:
                    found = [summed(found)]
            keys = token_keys(words)
            order = np.argsort(keys, kind="stable")
            own = (keys[order], np.fromiter(words.values(), np.int64, len(words))[order])
            for name, (keys, n), bucket_of in (("g", summed(found), gram_bucket), ("t", own, token_bucket)):
                at = bucket_of(keys, buckets)
                for k in np.unique(at):
                    here = at == k
                    yield row(block, int(k), None, None, None, *pack(keys[here], n[here]), name)

    schema = f"block string, bucket int, doc_ids array<{kind}>, flags array<boolean>, texts array<binary>, keys binary, counts binary, kind string"
    return stage(docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(run, schema), "ppm-blocks", by="kind")


def groups(found: DataFrame) -> DataFrame:
    """(kind, bucket, groups): how many tasks share the keys of a bucket; a row for each bucket, staged."""
    size = F.sum(F.octet_length("keys") + F.octet_length("counts"))
    sizes = found.where("kind in ('g', 't')").groupBy("kind", F.col("bucket").cast("long").alias("bucket")).agg(size.alias("size"))
    return stage(sizes.select("kind", "bucket", F.ceil(F.col("size") / LOOKUP_BYTES).alias("groups")), "ppm-groups")


def asked(found: DataFrame, shared: DataFrame) -> DataFrame:
    """(block, kind, bucket, salt, keys, counts) of all blocks; blocks are dealt to the groups of a bucket."""
    rows = found.where("kind in ('g', 't')").select("block", "kind", F.col("bucket").cast("long").alias("bucket"), "keys", "counts")
    salt = F.pmod(F.xxhash64("block"), F.col("groups")).alias("salt")
    return rows.join(F.broadcast(shared), ["kind", "bucket"]).select("block", "kind", "bucket", salt, "keys", "counts")  # 2 * 65,536 rows at most


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Training counts of each bucket over all blocks: (kind, bucket, keys, counts). Each group of a bucket is folded as it comes, then the groups' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, least = None, [], 0, 0

        def done():
            keys, n = summed(held)
            keys, n = keys[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([*(pa.array([v]) for v in at[:2]), *(pa.array([x], pa.binary()) for x in pack(keys, n))], ["kind", "bucket", "keys", "counts"])

        for b in batches:
            for i in range(b.num_rows):
                kind, bucket, salt, keys, counts = (c[i].as_py() for c in b.columns)
                if at != (kind, bucket, salt):
                    if at is not None:
                        yield done()
                    at, held, size, least = (kind, bucket, salt), [], 0, 0
                held.append(unpack(keys, counts))
                size += len(held[-1][0])
                if size > 1_000_000 + 2 * least:
                    held = [summed(held)]
                    size = least = len(held[0][0])
        if at is not None:
            yield done()

    def folded(of: DataFrame) -> DataFrame:
        by = ("kind", "bucket", "salt")
        return of.select(*by, "keys", "counts").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "kind string, bucket long, keys binary, counts binary")

    return stage(folded(folded(rows).withColumn("salt", F.lit(0).cast("long"))), "ppm-counts")


def low_orders(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order-2 (two bytes, symbol) strings and their counts: one for each byte before them. At most 2^24."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fours = np.unique(unpack(keys, n)[0] & 0xFFFFFFFF)
                triples, n = np.unique(fours & 0xFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(triples.astype(np.int32)), pa.array(n.astype(np.int32))], ["triple", "n"])

    found = counts.where("kind = 'g'").select("keys", "counts").mapInArrow(run, "triple int, n int").groupBy("triple").agg(F.sum("n").cast("int").alias("n")).toArrow()
    triples, n = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("triple", "n"))
    order = np.argsort(triples)
    return triples[order], n[order]


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted_keys, -1 where it has none."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


class Level:
    """The contexts of one order: keys (context and symbol), counts, and for each context n, d and the count of its symbols one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, self.at = np.unique(keys >> 8, return_inverse=True)
        self.n = np.bincount(self.at, counts, len(self.contexts)).astype(np.int64)
        self.d = np.bincount(self.at, minlength=len(self.contexts))

    def shadow(self, below: np.ndarray) -> None:
        """below: the counts one order below of the symbols in keys."""
        self.excluded = np.bincount(self.at, below, len(self.contexts)).astype(np.int64)


def low_levels(triples: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 2 to 0 of the whole model."""
    levels, keys = [], triples
    for k in (2, 1, 0):
        levels.append(Level(keys, counts))
        if k:
            keys, at, counts = np.unique(keys & ((1 << 8 * k) - 1), return_inverse=True, return_counts=True)
            levels[-1].shadow(counts[at])
    return levels


class Trie:
    """The subtries of a bucket, and orders 2 to 0 of the whole model."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: list[Level]):
        self.levels = []
        for k in range(ORDER, 2, -1):
            self.levels.append(Level(keys, counts))
            own = keys & ((1 << 8 * k) - 1)
            if k > 3:
                keys, at, counts = np.unique(own, return_inverse=True, return_counts=True)
                self.levels[-1].shadow(counts[at])
            else:
                self.levels[-1].shadow(low[0].counts[_find(low[0].keys, own)] if len(own) else own)
        self.levels += low

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probabilities of packed (context, symbol) strings."""
        out = np.zeros(len(packed))
        todo = np.arange(len(packed))
        # kinds and counts that the longer context, if seen, excludes
        kinds, mass = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
        for k, level in zip(range(ORDER, -1, -1), self.levels):
            q = packed[todo] & ((1 << 8 * (k + 1)) - 1)
            context = _find(level.contexts, q >> 8)
            seen = context >= 0
            context = np.where(seen, context, 0)
            if not len(level.contexts):
                continue
            n, d = level.n[context] - mass[todo], level.d[context] - kinds[todo]
            at = _find(level.keys, q)
            hit = seen & (at >= 0)
            c = level.counts[np.where(hit, at, 0)]
            p = np.where(hit, c - DISCOUNT, DISCOUNT * d) / np.maximum(n, 1)
            coded = seen & (d > 0)
            out[todo[coded]] += np.log10(p[coded])
            kinds[todo] = np.where(seen, level.d[context], 0)
            if k:
                mass[todo] = np.where(seen, level.excluded[context], 0)
            todo = todo[~hit]
        out[todo] -= np.log10(SYMBOLS - kinds[todo])
        return out


def look_ups(rows: DataFrame, counts: DataFrame, shared: DataFrame, low: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(block, kind, bucket, values): for each block's keys in order their log10 probability (g) or training count (t)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = (left if left.num_rows else right).column("kind")[0].as_py()
        keys, n = unpack(right.column("keys")[0].as_py(), right.column("counts")[0].as_py()) if right.num_rows else summed([])
        trie = Trie(keys, n, low_levels(*low)) if kind == "g" and left.num_rows else None
        out = []
        for own in left.column("keys").to_pylist():
            wanted = np.cumsum(np.frombuffer(own, np.int64))
            if trie:
                out.append(trie.log10(wanted).tobytes())
            else:
                at = _find(keys, wanted)
                out.append((np.where(at >= 0, n[at], 0) if len(n) else np.zeros(len(wanted), np.int64)).astype(np.float64).tobytes())
        return pa.table([left.column("block"), left.column("kind"), left.column("bucket"), pa.array(out, pa.binary())], names=["block", "kind", "bucket", "values"])

    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt")
    model = counts.join(F.broadcast(shared), ["kind", "bucket"]).select("kind", "bucket", "keys", "counts", salts)
    by = ("kind", "bucket", "salt")
    return rows.drop("counts").groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(run, "block string, kind string, bucket long, values binary")


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score, n_symbols.

    training: which rows the model and the base learn from (null: not). score is
    the model's log10 probability of the text and its end, base_score the add-one
    unigram log10 probability of its folded words and one end. All training rows
    are learned from, all rows are scored.

    Nulls and edges: a null text counts as empty (its one token is the end); ids
    may be null or repeated, each row has its own result; with no training row
    every symbol has 1/255 and every word 1/(0+1*(0+1)). Words are told apart by
    64-bit hashes. Other columns are dropped.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training.alias("training"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(65536, max(BUCKETS, n_bytes // BUCKET_BYTES))
    found = blocks(docs, F.col("training"), buckets)
    shared = groups(found)
    rows = asked(found, shared)
    counts = bucket_counts(rows)
    low = low_orders(counts)
    words = counts.where("kind = 't'").select("counts", "keys").mapInArrow(_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total, kinds = int(words[0]), int(words[1])
    values = look_ups(rows, counts, shared, low)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_rows = right.to_pylist()
        value = {kind: {r["bucket"]: np.frombuffer(r["values"], np.float64) for r in found_rows if r["kind"] == kind} for kind in "gt"}
        parts = left.select(["doc_ids", "texts"]).to_pylist()

        def placed(keys, bucket_of, table):
            """The values of the block's distinct keys, which are sorted within each bucket."""
            at, out = bucket_of(keys, buckets), np.zeros(len(keys))
            for k, v in table.items():
                out[at == k] = v
            return out

        found = []
        words: dict[bytes, int] = {}
        for p in parts:
            packed, sizes = grams(p["texts"])
            own, at = np.unique(packed, return_inverse=True)
            found.append((own, at.astype(np.int32), np.cumsum(sizes) - sizes, sizes))
            for t in p["texts"]:
                words.update(dict.fromkeys(tokens(t)))
        uniq = np.unique(np.concatenate([own for own, *_ in found]))
        logs = placed(uniq, gram_bucket, value["g"])
        keys = token_keys(words)
        order = np.argsort(keys, kind="stable")
        known = np.zeros(len(keys))
        known[order] = placed(keys[order], token_bucket, value["t"])
        base = np.log10((known + 1) / (total + kinds + 1))
        for i, w in enumerate(words):
            words[w] = i
        out = []
        for p, (own, at, edges, sizes) in zip(parts, found):
            scores = np.add.reduceat(logs[np.searchsorted(uniq, own)][at], edges)
            for doc, t, size, s in zip(p["doc_ids"], p["texts"], sizes.tolist(), scores.tolist()):
                at = np.fromiter(map(words.__getitem__, own := tokens(t)), np.int64, len(own))
                out.append((doc, len(at), int((known[at] > 0).sum()), total, float(base[at].sum()), s, size))
        kinds_ = [left.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_symbols"])

    texts = found.where("kind = 'd'").select("block", "doc_ids", "texts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long")
    return scored.withColumnRenamed("doc_id", id_col)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys, n = unpack(keys, n)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(keys)])], ["n", "v"])
