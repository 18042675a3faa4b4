"""Token counts: Arrow functions that encode in batches and return lengths only."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import BATCH_BYTES, by_bytes

#: Longest run that is encoded at once, in characters, where a safe boundary allows.
PIECE_CHARS = 1 << 16
#: Units whose lengths a worker remembers, at most, and the longest that it does, in characters.
REMEMBERED, LONGEST = 600_000, 128
#: A single space before a character that isn't white space starts a pre-token, whatever stands before it.
BOUNDARY = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" (?:\s|$)")


@cache
def tokenizer(path: str):
    """The tokenizer of a file, once per worker, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def remembered(path: str) -> dict:
    return {}


def units(text: str) -> list[str]:
    """text cut at its safe boundaries; all but the first unit have lost a leading space."""
    return text.split(" ") if not UNSAFE.search(text) else BOUNDARY.split(text)


def pieces(first: str, rest: list[str], limit: int = PIECE_CHARS) -> Iterator[str]:
    """first and the units of rest, joined to pieces of about limit characters."""
    part, size = [first], len(first)
    for x in rest:
        if size > limit:
            yield "".join(part)
            part, size = [], 0
        part.append(" " + x)
        size += len(x) + 1
    yield "".join(part)


def lengths(texts: list[str], path: str) -> list[int]:
    """Numbers of tokens of whole texts.

    Units that recur in the batch are encoded once and remembered; the others of
    each text are joined again and encoded in pieces.
    """
    tok, known = tokenizer(path), remembered(path)
    split = [units(t) for t in texts]
    seen: Counter = Counter()
    for parts in split:
        seen.update(parts[1:])
    new = [x for x, n in seen.items() if n > 1 and len(x) <= LONGEST and x not in known]
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update(zip(new, map(len, tok.encode_batch_fast([" " + x for x in new], add_special_tokens=False))))
    out, todo, owner = [], [], []
    for i, parts in enumerate(split):
        counts = list(map(known.get, parts[1:]))
        out.append(sum(filter(None, counts)))
        for p in pieces(parts[0], [x for x, n in zip(parts[1:], counts) if n is None]):
            if p:
                todo.append(p)
                owner.append(i)
    for i, e in zip(owner, tok.encode_batch_fast(todo, add_special_tokens=False)):
        out[i] += len(e)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts are encoded by the tokenizers file at path (a byte-level BPE),
    without begin, end or added special tokens. Work goes in batches of about equal bytes, not
    rows; a text is cut only before a single space and a character that isn't
    white space, where this pre-tokenizer always starts a new token.

    Nulls and edges: a null text counts as empty, 0 bytes and 0 tokens; ids may be
    null or repeated, each row has its own result; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lengths(b.column(1).fill_null("").to_pylist(), path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = texts.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
