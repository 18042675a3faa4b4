"""Fill-in-middle transformation with remembered chunks.

A text is cut into chunks where a rolling hash of its last bytes says so, whatever
stands before. What is worked out of a chunk (its code points, the bytes at its
ends, whether it holds a marker) is remembered by its content, so that passages
which texts share are counted once a worker. The cuts of a document are found by
adding up the counts of its chunks, and by one look into the chunk of the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, mix64, utf8_view

#: Bytes of a chunk: on average between its least and most.
MEAN, LEAST, MOST = 512, 64, 4096
#: Bytes that the rolling hash sees.
SEEN = 32
#: Bytes of text that are hashed at once.
STRETCH = 1 << 20
#: Bytes of chunks that a worker remembers, at most.
REMEMBERED = 32 << 20
#: The markers; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: A random number for each byte.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text; none for an empty one.

    The rolling hash of a place is the sum of its last SEEN bytes' numbers, each
    shifted by its distance; it is built by doubling, over one stretch at a time.
    """
    ends, last = [], 0
    for at in range(0, len(data), STRETCH):
        first = max(at - SEEN + 1, 0)
        h = GEAR[data[first : at + STRETCH]]
        span = 1
        while span < SEEN:
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        here = np.flatnonzero((h[at - first :] >> np.uint32(16)) % MEAN == 0) + at + 1
        for end in here.tolist():
            if end - last >= LEAST:
                while end - last > MOST:
                    last += MOST
                    ends.append(last)
                if end - last >= LEAST:
                    ends.append(end)
                    last = end
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if len(data) > last:
        ends.append(len(data))
    return ends


class Summary(NamedTuple):
    """What a chunk adds to its text: code points that start in it, its first and last two bytes, whether a marker stands in it."""

    points: int
    head: bytes
    tail: bytes
    marked: bool


def marked(part: bytes) -> bool:
    return PREFIX in part or SUFFIX in part or MIDDLE in part


def starts(part: bytes) -> np.ndarray:
    """Places of the bytes where code points start."""
    return np.flatnonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)


def summary(part: bytes) -> Summary:
    return Summary(int(((np.frombuffer(part, np.uint8) & 0xC0) != 0x80).sum()), part[:2], part[-2:], marked(part))


class Chunks:
    """Summaries by content: found by hash, taken only where the bytes are the same (a dict compares them), within a bound of bytes."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit, self.held, self.known = limit, 0, {}

    def of(self, part: bytes) -> Summary:
        found = self.known.get(part)
        if found is None:
            found = summary(part)
            if self.held + len(part) > self.limit:
                self.known.clear()
                self.held = 0
            self.known[part] = found
            self.held += len(part)
        return found


@cache
def remembered() -> Chunks:
    return Chunks()


class Counted:
    """A text by its chunks: its code points, whether it holds a marker, and the byte where a code point starts."""

    def __init__(self, data: bytes, chunks: Chunks):
        self.data, self.ends = data, chunk_ends(np.frombuffer(data, np.uint8))
        found = [chunks.of(data[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.sums = np.cumsum([0, *(x.points for x in found)])
        self.points = int(self.sums[-1])
        self.marked = any(x.marked for x in found) or any(marked(a.tail + b.head) for a, b in pairwise(found))

    def place(self, point: int) -> int:
        """The byte where code point number `point` (from 0) starts; the length of the text for the one behind the last."""
        if point >= self.points:
            return len(self.data)
        k = int(np.searchsorted(self.sums, point, side="right")) - 1
        first = self.ends[k - 1] if k else 0
        return first + int(starts(self.data[first : self.ends[k]])[point - int(self.sums[k])])


def transform(data: bytes, name: str, chunks: Chunks, seed: int, plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, lengths of prefix and middle, and the output of one text."""
    text = Counted(data, chunks)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = text.points
    if not data or text.marked or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = text.place(a), text.place(b)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and form are drawn by sha256 of seed and id. In psm the prefix comes first,
    in spm the suffix; each part follows its marker, the middle last.

    Nulls and edges: a null text counts as empty; an empty text and one that holds a
    marker stay plain, with null lengths; a null id is drawn for as the empty text;
    rows that repeat an id have the same draws, each for its own text; other columns
    are dropped. A text of any length is hashed in stretches.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = remembered()
        for b in by_bytes(batches, "text"):
            data, at = utf8_view(b.column(2))
            rows = [transform(data[i:j].tobytes(), name, chunks, seed, plain_percent, spm_percent) for name, i, j in zip(b.column(1).to_pylist(), at[:-1], at[1:])]
            n, form, prefix, middle, output = zip(*rows)
            ints = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([b.column(0), ints[0], pa.array(form), ints[1], ints[2], pa.array(output, pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of; null where either is null. No marker can arise at the seams, so the first of each kind is the real one."""

    def parts(first: bytes, second: bytes) -> tuple[Column, Column, Column]:
        a = F.substring_index(F.substr(output, F.lit(4)), second.decode(), 1)
        rest = F.substr(output, F.length(a) + 7)
        b = F.substring_index(rest, MIDDLE.decode(), 1)
        return a, b, F.substr(rest, F.length(b) + 4)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).when(form == "plain", output)
