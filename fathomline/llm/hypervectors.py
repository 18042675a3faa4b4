"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1; a trigram is the product of its
letters' vectors, the first rotated by two places and the second by one; a text or
a language is the sum of its trigrams' vectors. A text gets the language whose
prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes

#: Length of the vectors.
DIMENSIONS = 512
#: Languages that a model may have; the prototypes are held by the driver and by every task.
MAX_LANGUAGES = 4096
#: Distinct trigrams that a task sums up before it hands them on.
FLUSH = 1_000_000

_lower = np.full(0x110000, -1, np.int64)


@cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The vector of a code point; 0 stands for the edge of a word."""
    return (np.random.Generator(np.random.PCG64([code, 20011])).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


def letters(codes: np.ndarray) -> np.ndarray:
    """Code points of letters in lower case; 0 for what is no letter."""
    for c in np.unique(codes[_lower[codes] < 0]):
        x = chr(c)
        _lower[c] = ord(x.lower()[0]) if x.isalpha() else 0
    return _lower[codes]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed code (21 bits a letter) of every trigram with a letter in its middle."""
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    x = letters(codes)
    middle = np.flatnonzero(x[1:-1])
    return row[middle], x[middle] << 42 | x[middle + 1] << 21 | x[middle + 2]


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of packed trigrams, as rows of int8."""
    mask = (1 << 21) - 1
    out = None
    for turn, part in ((2, codes >> 42), (1, codes >> 21 & mask), (0, codes & mask)):
        alphabet, at = np.unique(part, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dimensions), turn) for c in alphabet])
        out = table[at] if out is None else out * table[at]
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): numbers of trigrams in the texts of each language, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                codes, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for b in by_bytes(batches, "text"):
            langs, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            row, code = trigrams(b.column(1).to_pylist())
            for k, lang in enumerate(langs):
                codes, n = np.unique(code[at[row] == k], return_counts=True)
                if len(codes):
                    parts = held.setdefault(lang, [])
                    parts.append((codes, n))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
            size = sum(len(c) for parts in held.values() for c, _ in parts)
            if size > FLUSH:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, code long, n long")


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from the columns text and lang of docs.

    All rows with a text and a language count. The driver receives one vector of
    `dimensions` whole numbers for each language, at most max_languages of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            codes, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i in range(0, len(codes), 20_000):
                part = slice(i, i + 20_000)
                vectors = trigram_vectors(codes[part], dimensions)
                for lang in set(langs[part]):
                    own = langs[part] == lang
                    total[lang] = total.get(lang, 0) + np.rint(n[part][own].astype(np.float64) @ vectors[own]).astype(np.int64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "dim", "v"])

    counts = trigram_counts(docs).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    found = sums.limit(max_languages * dimensions + 1).collect()
    if len(found) > max_languages * dimensions:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted({r.lang for r in found})
    at = {lang: i for i, lang in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for r in found:
        out[at[r.lang], r.dim] = r.v
    return langs, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (its cosine with the prototype, 0 at least).

    Only the text is read. Equal cosines go to the language first in order.
    lang_pred is `und` and the score 0 for a text that is null or has no letters,
    and for all texts if the model has no language.
    """
    langs, prototypes = model
    dimensions = prototypes.shape[1] if len(langs) else 0
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).T.astype(np.float32) if len(langs) else None

    def scored(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if unit is None:
            return best, score
        row, code = trigrams(texts)
        if not len(row):
            return best, score
        uniq, at = np.unique(code, return_inverse=True)
        have = np.bincount(row, minlength=len(texts)) > 0
        total = np.zeros((len(texts), dimensions), np.float32)
        width = max(1, min(len(uniq), 4_000_000 // len(texts)))
        for i in range(0, len(uniq), width):
            n = min(width, len(uniq) - i)
            own = slice(None) if n == len(uniq) else (at >= i) & (at < i + n)
            m = np.bincount(row[own] * n + at[own] - i, minlength=len(texts) * n).reshape(len(texts), n)
            total += m.astype(np.float32) @ trigram_vectors(uniq[i : i + n], dimensions).astype(np.float32)
        cosine = (total @ unit) / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        best[have] = cosine.argmax(1)[have]
        score[have] = np.clip(cosine.max(1), 0, 1)[have]
        return best, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*langs, "und"]
        for big in by_bytes(batches, "text", 2 << 20):
            for i in range(0, big.num_rows, 1024):
                b = big.slice(i, 1024)
                best, score = scored(b.column(1).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def learning_rows(docs: DataFrame, training: Column) -> DataFrame:
    """The texts and languages that a model may learn from."""
    return docs.where(training & F.col("lang").isNotNull()).select("text", "lang")
