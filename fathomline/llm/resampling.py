"""Importance resampling towards a target: rows are weighed by hashed runs of words and drawn by Gumbel scores.

The weights come from one array of gains, one a bucket. The draw is a distributed
quickselect: some random keys are pivots, all keys are counted below, at and above
them, and the stretch that holds the key looked for is taken on. No row is sorted
but those drawn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, stage, unstage
from fathomline.llm.positions import FOLD

#: Buckets of features; the only thing that the driver gets is a number for each.
BUCKETS = 10_000
#: Pivots of one turn of the quickselect.
PIVOTS = 32
#: Bytes of a text whose words are held at once, about.
STRETCH = 1 << 20


def stretches(text: str | None, longest: int = 1) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The folded words of a text in stretches: up to longest - 1 words before the stretch, and its own."""
    data, at, before = (text or "").encode().translate(FOLD), 0, []
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        own = data[at:end].split()
        yield before, own
        before = (before + own)[1 - longest :] if longest > 1 else []
        at = end


def feature_buckets(text: str | None, longest: int = 1, n_buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each stretch of a text its number of words, and the buckets of the runs of 1 to longest words that end in it."""
    for before, own in stretches(text, longest):
        found = [np.fromiter(map(crc32, own), np.int64, len(own))]
        for k in range(2, longest + 1):
            terms = before[max(len(before) - k + 1, 0) :] + own
            runs = [b" ".join(terms[i : i + k]) for i in range(len(terms) - k + 1)]
            found.append(np.fromiter(map(crc32, runs), np.int64, len(runs)))
        yield len(own), np.concatenate(found) % n_buckets


def bucket_counts(rows: DataFrame, text_col: str = "text", longest: int = 1, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; a null text has none. Each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in by_bytes(batches, "text"):
            for text in b.column(0):
                for _, found in feature_buckets(text.as_py(), longest, n_buckets):
                    total += np.bincount(found, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = rows.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 ln of the ratio of its smoothed shares in target and source)."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = ((target + 1).astype(float) * float(s + n)) / ((source + 1).astype(float) * float(t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, seed: int, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_hash, n_words, n_features, weight (floored mean gain, 0 without features), score (weight plus seeded Gumbel noise in thousandths)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            out = []
            for name, text in zip(b.column(1).to_pylist(), b.column(2)):
                words = features = total = 0
                for n, found in feature_buckets(text.as_py(), longest, len(gain)):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
                weight = total // features if features else 0
                out.append((words, features, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *(pa.array(c, pa.int64()) for c in zip(*out))], ["id", "text_hash", "n_words", "n_features", "weight", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return texts.mapInArrow(run, f"id {kind}, text_hash long, n_words long, n_features long, weight long, score long")


def kth_key(rows: DataFrame, key: list[str], k: int, n_pivots: int = PIVOTS) -> dict:
    """The k-th smallest (from 1) of the composite keys of rows, by quickselect; no two keys may be the same.

    Each turn takes the keys of n_pivots random rows, counts the keys below, at and
    between them in one pass, and goes on with the stretch that holds the k-th,
    written as a table. The driver gets the pivots and the counts only.
    """
    fields, turn, held = {c: rows.schema[c].dataType for c in key}, 0, None
    rows = rows.select(*key)
    while True:
        turn += 1
        picked = rows.orderBy(F.xxhash64(F.lit(turn), *key), *key).limit(n_pivots).orderBy(*key).collect()
        pivots = F.array(*[F.struct(*[F.lit(p[c]).cast(t).alias(c) for c, t in fields.items()]) for p in picked])
        own = F.struct(*key)
        place = F.size(F.filter(pivots, lambda p: p < own)) + F.size(F.filter(pivots, lambda p: p <= own))
        counts = {r.place: r["count"] for r in rows.select(place.alias("place")).groupBy("place").count().collect()}
        at = next(p for p in sorted(counts) if sum(n for q, n in counts.items() if q <= p) >= k)
        if at % 2:
            if held is not None:
                unstage(held)
            return picked[at // 2].asDict()
        k -= sum(n for q, n in counts.items() if q < at)
        inner = stage(rows.where(place == at), "narrowed")
        if held is not None:
            unstage(held)
        rows = held = inner


def ranked(rows: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in the order of the keys: dealt by ranges, sorted there, places added up over the ranges."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_place", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("_place", 33)
    starts, total = [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect()):
        starts.append((r.part, total))
        total += r["count"]
    first = spark.createDataFrame(starts or [(-1, 0)], "_part long, _first long")  # a row for each range
    return dealt.join(F.broadcast(first), part == F.col("_part")).withColumn(name, F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_part", "_first")


def order_key(id_col: Column) -> list[Column]:
    """The composite key of a draw: higher score, then smaller id (null last), then text and row."""
    return [(-F.col("score")).alias("down"), id_col.isNull().alias("unnamed"), id_col.alias("id"), F.col("text_hash"), F.col("row")]


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    longest: int = 1,
    n_buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null where it isn't drawn).

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond
    ASCII; features are runs of 1 to longest words, hashed to n_buckets. Of the N
    documents of at least least_words words, floor(percent * N / 100) are drawn:
    those of the highest scores, ties to the smaller id.

    Nulls and edges: a null or empty text has no features, weight 0, and can't be
    drawn unless least_words is 0; a null id counts as the empty text where noise
    is drawn and comes after all others in ties; rows that repeat an id are ordered
    by a hash of their texts and drawn one by one; an empty target or an empty
    docs table gives its smoothed gains or no rows; other columns are dropped.
    """
    gain = gains(bucket_counts(docs, text_col, longest, n_buckets), bucket_counts(target, target_col, longest, n_buckets))
    scored = stage(weigh(docs, gain, seed, longest, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    n = percent * scored.where(fit).count() // 100
    plain = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not n:
        return scored.select(*plain, none)
    keyed = order_key(F.col("id"))
    names = ["down", "unnamed", "id", "text_hash", "row"]
    last = kth_key(scored.where(fit).select(*keyed), names, n)
    bound = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in ((c, scored.select(*keyed).schema[c].dataType) for c in names)])
    drawn = fit & (F.struct(*keyed) <= bound)
    winners = ranked(scored.where(drawn).withColumns({"down": -F.col("score"), "unnamed": F.col("id").isNull()}), names)
    return winners.select(*plain, "rank").unionByName(scored.where(~drawn).select(*plain, none))
