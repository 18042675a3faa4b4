"""Removal of repeated byte strings by a depth-limited, most-significant-digit radix sort of all suffixes.

Two places of a corpus hold the same string of `depth` bytes just when their
suffixes are equal through `depth` bytes, so suffixes are ordered that far and no
further. The digits, from the most significant on:

1. The least hash of the byte grams within the first `depth` bytes, grams of 24
   bytes (16 for small depths). It is a function of those bytes, so equal strings
   have it in common; neighbouring suffixes mostly share it, and such a run of
   suffixes travels as one piece of text. A digit that only one document holds ends
   the sort of its suffixes: for that, each block of texts sends the digits only,
   not the text. Short grams recur by chance, the more the larger the corpus is.
2. A digit with very many occurrences is followed by a hash of all `depth` bytes,
   so that its suffixes are dealt to many groups.
3. The bytes themselves, eight at a time. After each pass the groups that lie in
   one document are done with; those left after the last are the repeated strings.

Equal runs are one run with its smallest id before the last passes.

A large corpus is sorted in steps, each written to the shared folder before the
shuffles it came from are deleted, and its runs travel in turns, some buckets at a
time, so that the disk taken at once stays in proportion to the texts however many
of them repeat.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, mix64, partitions_for, shared_dir, unstage, utf8_view

#: Bytes that a string must have in common.
DEPTH = 50
#: Bytes of a gram of the first digit, and those from a depth of twice as many on.
GRAM, LONG_GRAM = 16, 24
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Occurrences from which a first digit is followed by a hash of the whole string.
HOT = 4096
#: Suffixes in a run, at most.
RUN = 256
#: Suffixes that the last passes order at once; the suffixes of one digit are never parted.
AT_ONCE = 1 << 17
#: Places whose grams are hashed at once.
PLACES = 1 << 15
#: Bytes of texts from which the sort goes in steps.
STEPS_FROM = 64 << 20
#: Bytes of runs that may travel in one turn, as a share of the texts' bytes.
TURN = 1.0
#: The id that a null one counts as: after all others.
NO_ID = (1 << 63) - 1

_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_PAD = bytes(64)


def build_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in blocks, written to the shared folder: block, ids, ends (places behind each text and one zero byte), size, data (compressed).

    A table bucketed by block: what is joined with the blocks goes to them, the blocks themselves are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(by_bytes(batches, "text", BLOCK_BYTES)):
            data, at = utf8_view(b.column(1))
            whole = b"\0".join([*(data[i:j].tobytes() for i, j in zip(at[:-1], at[1:])), b""])
            ends = at[1:] + np.arange(1, b.num_rows + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + n]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([len(whole)], pa.int64()), pa.array([squeezed(whole, 5)])],
                ["block", "ids", "ends", "size", "data"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = texts.mapInArrow(run, "block long, ids array<long>, ends array<long>, size long, data binary")
    # as many buckets as a shuffle has partitions, so that grouped replies lie as the blocks do
    return bucketed(blocks, f"suffix_blocks_{uuid.uuid4().hex}", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed(rows: DataFrame, name: str, n_buckets: int, mode: str = "error") -> DataFrame:
    """Rows written to (or added to) a table of the shared folder that is bucketed by block."""
    spark = rows.sparkSession
    written = rows.write.mode(mode).option("compression", "zstd").option("path", f"{shared_dir(spark)}/fathomline/{name}")
    written.bucketBy(n_buckets, "block").saveAsTable(name)
    return spark.table(name)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled is deleted when the query has ended; only for queries that write what they found."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Block:
    """One block: its bytes (padded), where texts start and end (without the zero byte), and their ids."""

    def __init__(self, row: dict):
        self.number, self.size = row["block"], row["size"]
        self.data = opened(row["data"], self.size) + _PAD
        self.ids = row["ids"]
        self.rank = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        self.starts = np.array([0, *row["ends"][:-1]], np.int64)
        self.ends = np.array(row["ends"], np.int64) - 1


def least_grams(data: bytes, first: int, n: int, depth: int) -> np.ndarray:
    """For n places from `first` the least hash of the grams within the depth bytes that start there."""
    gram = LONG_GRAM if depth >= 2 * LONG_GRAM else GRAM
    span = depth - gram + 1
    word = np.ndarray((n + span + gram - 9 + 8,), "<u8", data, first, (1,))
    m = word[: n + span - 1] * _A
    for k, factor in zip(range(8, gram, 8), (_B, _D)):
        m += word[k : n + span + k - 1] * factor
    m ^= m >> np.uint64(32)
    m *= _C
    m ^= m >> np.uint64(29)
    size = 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[span - size : span - size + n])


def runs(block: Block, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that share their text and first digit: digit, first place, suffixes in it, number of the text."""
    end = np.maximum(block.ends - depth + 1, block.starts)  # behind the last place that starts a whole string
    forced = np.unique(np.r_[block.starts, end])
    digits, places, before = [], [], np.uint64(0)
    for first in range(0, block.size, PLACES):
        n = min(PLACES, block.size - first)
        found = least_grams(block.data, first, n, depth) if first + n + 2 * len(_PAD) < block.size else least_grams(block.data[first:] + _PAD, 0, n, depth)
        new = np.empty(n, bool)
        new[0] = found[0] != before
        np.not_equal(found[1:], found[:-1], out=new[1:])
        lo, hi = np.searchsorted(forced, (first, first + n))
        new[forced[lo:hi] - first] = True
        at = np.flatnonzero(new)
        digits.append(found[at])
        places.append(at + first)
        before = found[-1]
    none = np.zeros(0, np.int64)
    digit, place = (np.concatenate(digits), np.concatenate(places)) if digits else (none.astype(np.uint64), none)
    length = np.diff(place, append=block.size)
    text = np.searchsorted(block.starts, place, side="right") - 1
    keep = place < end[text] if len(place) else np.zeros(0, bool)
    digit, place, length, text = mix64(digit[keep]), place[keep], length[keep], text[keep]
    if len(length) and length.max() > RUN:
        parts = -(-length // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        digit, text = np.repeat(digit, parts), np.repeat(text, parts)
        place, length = np.repeat(place, parts) + step * RUN, np.minimum(np.repeat(length, parts) - step * RUN, RUN)
    return digit, place, length, text


def groups(values: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def slices(part: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The slices of each part in a sorted array of numbers below n, empty ones left out."""
    at = np.searchsorted(part, np.arange(n + 1))
    return ((k, slice(int(at[k]), int(at[k + 1]))) for k in np.flatnonzero(np.diff(at)).tolist())


def squeezed(data: bytes | np.ndarray, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data if isinstance(data, bytes) else data.tobytes(), asbytes=True)


def opened(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed(block: Block, bucket: int, *columns: np.ndarray | bytes) -> tuple:
    return (block.number, bucket, *(c if isinstance(c, bytes) else c.tobytes() for c in columns))


def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("block", "bucket", "runs", "n") else pa.binary() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def first_digits(blocks: DataFrame, depth: int, n_buckets: int) -> DataFrame:
    """The first digits of every block by bucket: block, bucket, digits (upper 32 bits), times (uint16; the top bit says that several ids have it)."""
    names = ["block", "bucket", "digits", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                digit, _, _, text = runs(block, depth)
                order = np.argsort(digit)
                digit, own = digit[order], block.rank[text[order]]
                at = groups(digit)
                if not len(at):
                    continue
                times = np.minimum(np.diff(at, append=len(digit)), 0x7FFF).astype(np.uint16)
                times |= (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)).astype(np.uint16) << 15
                digit = digit[at]
                part = (digit % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                upper, times = (digit[order] >> np.uint64(32)).astype(np.uint32), times[order]
                yield batch([packed(block, k, upper[s], times[s]) for k, s in slices(part[order], n_buckets)], names)

    return blocks.mapInArrow(run, "block long, bucket long, digits binary, times binary")


def shared_digits(digits: DataFrame, hot: int) -> DataFrame:
    """What each block learns of its digits: block, bucket, shared and hot (upper 32 bits of digits that another block or text has too), runs (about as many as it will send)."""

    def run(table: pa.Table) -> pa.Table:
        block, bucket = table.column("block").to_numpy(), table.column("bucket")[0].as_py()
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("digits")]
        digit, times = np.concatenate(parts), np.frombuffer(b"".join(x.as_py() for x in table.column("times")), np.uint16)
        order = np.argsort(digit, kind="stable")
        at = groups(digit[order])
        n = np.diff(at, append=len(digit))
        alive = (n > 1) | (np.maximum.reduceat(times[order], at) >> 15 > 0)
        total = np.add.reduceat((times[order] & 0x7FFF).astype(np.int64), at)
        state = np.empty(len(digit), np.int8)
        state[order] = np.repeat(np.where(alive, 1 + (total >= hot), 0), n)
        rows, first = [], 0
        for number, part in zip(block.tolist(), parts):
            own, n_own = state[first : first + len(part)], times[first : first + len(part)] & 0x7FFF
            first += len(part)
            if own.any():
                # of a hot digit each suffix is a run
                rows.append((number, bucket, part[own == 1].tobytes(), part[own == 2].tobytes(), int(n_own[own == 1].sum()) + GRAM * int(n_own[own == 2].sum())))
        return pa.Table.from_batches([batch(rows, ["block", "bucket", "shared", "hot", "runs"])])

    return digits.groupBy("bucket").applyInArrow(run, "block long, bucket long, shared binary, hot binary, runs long")


def told(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a block: block and told, an array of structs of the columns."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("told"))


def states(digit: np.ndarray, replies: list[dict], n_buckets: int) -> np.ndarray:
    """0 for a digit of one text, 1 for a shared one, 2 for a hot one."""
    state = np.zeros(len(digit), np.int8)
    part = (digit % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found = dict(slices(part[order], n_buckets))
    for r in replies:
        own = order[found.get(r["bucket"], slice(0, 0))]
        upper = (digit[own] >> np.uint64(32)).astype(np.uint32)
        for value, name in ((1, "shared"), (2, "hot")):
            state[own[np.isin(upper, np.frombuffer(r[name], np.uint32))]] = value
    return state


def string_hashes(data: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the depth bytes at each place."""
    out = np.zeros(len(place), np.uint64)
    for at in range(0, len(place), AT_ONCE):
        rows = np.lib.stride_tricks.sliding_window_view(data, depth)[place[at : at + AT_ONCE]]
        rows = np.pad(rows, ((0, 0), (0, -depth % 8))).view("<u8")
        for k in range(rows.shape[1]):
            out[at : at + AT_ONCE] = mix64(out[at : at + AT_ONCE] * _A + rows[:, k] + _B)
    return out


def shared_runs(blocks: DataFrame, replies: DataFrame, depth: int, first_buckets: int, n_buckets: int) -> DataFrame:
    """The distinct runs of shared digits of every block, with all their occurrences, by bucket.

    replies: block and told (structs of bucket, shared, hot).

    Columns: block, bucket, digits (upper 32 bits: two that only differ below are ordered as one), lengths (uint16),
    text (lengths + depth - 1 bytes of each), times (int32, occurrences of each), places (int32, differences) and
    owners (int64) of all occurrences; all but digits and times compressed.
    """
    names = ["block", "bucket", "digits", "lengths", "text", "times", "places", "owners"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                digit, place, length, text = runs(block, depth)
                state = states(digit, row["told"], first_buckets)
                alone, hot = state == 1, state == 2
                n = length[hot]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = np.repeat(place[hot], n) + step  # each suffix of a hot digit is a run of its own
                digit = np.r_[digit[alone], string_hashes(np.frombuffer(block.data, np.uint8), each, depth)]
                place, length, text = np.r_[place[alone], each], np.r_[length[alone], np.ones_like(each)], np.r_[text[alone], np.repeat(text[hot], n)]
                if not len(digit):
                    continue
                order = np.argsort((digit % np.uint64(n_buckets)).astype(np.int64), kind="stable")
                digit, place, length, text = digit[order], place[order], length[order], text[order]
                rows, whole = [], block.data
                for k, s in slices((digit % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                    number: dict[bytes, int] = {}
                    own = np.fromiter((number.setdefault(whole[p : p + m], len(number)) for p, m in zip(place[s].tolist(), (length[s] + depth - 1).tolist())), np.int32, s.stop - s.start)
                    by = np.argsort(own, kind="stable")
                    at = groups(own[by])
                    first = by[at]
                    times = np.diff(at, append=len(by)).astype(np.int32)
                    rows.append(packed(block, k, (digit[s][first] >> np.uint64(32)).astype(np.uint32), squeezed(length[s][first].astype(np.uint16)), squeezed(b"".join(number)), times, squeezed(np.diff(place[s][by], prepend=0).astype(np.int32)), squeezed(block.rank[text[s][by]])))
                    if len(rows) == 64:
                        yield batch(rows, names)
                        rows = []
                if rows:
                    yield batch(rows, names)

    joined = blocks.join(replies.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block")).drop("_block")
    return joined.mapInArrow(run, "block long, bucket long, digits binary, lengths binary, text binary, times binary, places binary, owners binary")


def least_owners(words: np.ndarray, place: np.ndarray, group: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the least owner of the suffixes of its group that are equal to it through depth bytes.

    words: the eight bytes from each place on as a big-endian number; place: where the suffixes start; group: number of the digit, ascending.
    """
    least = owner.copy()
    alive = np.arange(len(place))
    for at in [*range(0, depth - 8, 8), depth - 8]:
        if not len(alive):
            break
        digit = words[place[alive] + at]
        order = np.argsort(digit)
        kind = np.uint16 if group[-1] < 1 << 16 else np.int64
        order = order[np.argsort(group[order].astype(kind), kind="stable")]
        digit, group, alive = digit[order], group[order], alive[order]
        first = np.flatnonzero(np.r_[True, (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])])
        n = np.diff(first, append=len(alive))
        own = owner[alive]
        low = np.minimum.reduceat(own, first)
        more = low != np.maximum.reduceat(own, first)
        least[alive] = np.repeat(low, n) if at == depth - 8 else own
        keep = np.repeat(more, n)
        alive, group = alive[keep], np.repeat(np.arange(more.sum()), n[more])
    return least


def covered(shared: DataFrame, depth: int) -> DataFrame:
    """What each block must remove: block, n, starts (int32, differences, ascending) and sizes (uint16) of n stretches of covered bytes, both compressed."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        parts = {c: [x.as_py() for x in table.column(c)] for c in ("digits", "lengths", "text", "times", "places", "owners")}
        digit, times = np.frombuffer(b"".join(parts["digits"]), np.uint32), [np.frombuffer(x, np.int32) for x in parts["times"]]
        lengths = [np.frombuffer(opened(x, 2 * len(n)), np.uint16).astype(np.int64) for x, n in zip(parts["lengths"], times)]
        places = [np.cumsum(np.frombuffer(opened(x, 4 * int(n.sum())), np.int32), dtype=np.int64) for x, n in zip(parts["places"], times)]
        n_places = [len(p) for p in places]
        owners = [np.frombuffer(opened(x, 8 * n), np.int64) for x, n in zip(parts["owners"], n_places)]
        text = b"".join([*(opened(x, int(n.sum()) + (depth - 1) * len(n)) for x, n in zip(parts["text"], lengths)), _PAD])
        place, owner, times = np.concatenate(places), np.concatenate(owners), np.concatenate(times)
        del parts
        low = np.minimum.reduceat(owner, np.cumsum(times) - times)  # of each distinct run of a block

        # equal runs of several blocks are one
        length = np.concatenate(lengths)
        end = np.cumsum(length + depth - 1)
        start = end - length - depth + 1
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(text[i:j], len(number)) for i, j in zip(start.tolist(), end.tolist())), np.int64, len(start))
        del number
        by = np.argsort(same, kind="stable")
        at = groups(same[by])
        one = by[at]  # a run for each text
        low = np.minimum.reduceat(low[by], at)

        order = np.argsort(digit[one], kind="stable")
        first = groups(digit[one][order])
        n = np.diff(first, append=len(order))
        mixed = np.repeat(n > 1, n)
        # a digit with one text: all its suffixes have that text's least owner
        runs_of, run_from, run_low = [order[~mixed]], [np.zeros((~mixed).sum(), np.int64)], [low[order[~mixed]]]
        words = np.ndarray((len(text) - 8,), ">u8", text, 0, (1,))
        todo = order[mixed]
        size = length[one][todo]
        group = np.cumsum(np.r_[False, digit[one][todo][1:] != digit[one][todo][:-1]]) if len(todo) else todo
        ends = np.cumsum(size)
        a = 0
        while a < len(todo):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE)), a + 1)
            b = int(np.searchsorted(group, group[b - 1], side="right"))
            own, n = todo[a:b], size[a:b]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(np.arange(b - a), n)
            at = start[one[own]][which] + step
            base = int(at.min())
            near = words[base : int(at.max()) + depth].astype(np.uint64)
            least = least_owners(near, at - base, (group[a:b] - group[a])[which], low[own][which], depth)
            new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (least[1:] != least[:-1])])
            runs_of.append(own[which[new]])
            run_from.append(step[new])
            run_low.append(least[new])
            a = b

        # stretches of a run with one least owner; then those of all its occurrences with a larger id
        of, since, least = np.concatenate(runs_of), np.concatenate(run_from), np.concatenate(run_low)
        by = np.lexsort((since, of))
        of, since, least = of[by], since[by], least[by]
        until = np.where(np.r_[of[1:] == of[:-1], False], np.r_[since[1:], 0], length[one][of])
        at = np.searchsorted(of, np.arange(len(one) + 1))
        run = same[np.repeat(np.arange(len(times)), times)]
        n = at[run + 1] - at[run]
        part = np.repeat(at[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(np.arange(len(run)), n)
        gone = least[part] < owner[which]
        part, which = part[gone], which[gone]
        from_, to = place[which] + since[part], place[which] + until[part] + depth - 1
        cut = np.searchsorted(which, np.cumsum([0, *n_places]))
        rows = []
        for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if j > i:
                by = i + np.argsort(from_[i:j], kind="stable")
                rows.append((int(block[k]), j - i, squeezed(np.diff(from_[by], prepend=0).astype(np.int32)), squeezed((to - from_)[by].astype(np.uint16))))
        return pa.Table.from_batches([batch(rows, ["block", "n", "starts", "sizes"])])

    return shared.groupBy("bucket").applyInArrow(run, "block long, n long, starts binary, sizes binary")


def covered_in_turns(blocks: DataFrame, size: int, depth: int, n_buckets: int, hot: int) -> DataFrame:
    """What `covered` finds, told to each block, from tables bucketed as the blocks are.

    Each shuffle is deleted once it is used. Buckets take turns, so that about TURN of the texts' bytes travel at once.
    """
    spark, name = blocks.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_deleted(spark):
        replies = bucketed(shared_digits(first_digits(blocks, depth, n_buckets).repartition(n_buckets, "bucket"), hot).repartition(n, "block"), f"suffix_replies_{name}", n)
        # a run has some (depth - LONG_GRAM) / 2 suffixes; its text is compressed to about half, its places and numbers take some 16 bytes
        sent = (replies.agg(F.sum("runs")).first()[0] or 0) * (0.75 * depth + 16)
        turns = min(max(1, math.ceil(sent / (TURN * size))), n_buckets)
        for turn in range(turns):
            own = replies.where(F.col("bucket") % turns == turn)
            shared = shared_runs(blocks, told(own, "bucket", "shared", "hot"), depth, n_buckets, n_buckets)
            found = covered(shared.repartition(n_buckets, "bucket"), depth).repartition(n, "block")
            gone = bucketed(found, f"suffix_gone_{name}", n, "append")
        unstage(replies)
        spark.sql(f"DROP TABLE suffix_replies_{name}")
    return told(gone, "n", "starts", "sizes")


def without(block: Block, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """For each text: id, bytes, removed bytes, removed runs, what is left."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64)) if len(ends) else ends
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, np.int64)
    starts, ends = starts[new], np.r_[ends[new[1:] - 1], ends[-1:]] if len(new) else ends
    first, last = np.searchsorted(starts, block.starts), np.searchsorted(starts, block.ends)
    out = []
    for k, (a, b, i, j) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), first.tolist(), last.tolist())):
        edges = [a, *(x for pair in zip(starts[i:j].tolist(), ends[i:j].tolist()) for x in pair), b]
        kept = b"".join(block.data[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((block.ids[k], b - a, b - a - len(kept), j - i, kept))
    return out


def dedup_strings(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the bytes left).

    A byte goes if it lies in a string of depth bytes (GRAM + 8 at least) that also
    starts in a document of a smaller id. Strings are judged on the input; they
    never cross documents, and may cut characters apart, hence the binary column.
    Ids must be whole numbers.

    Nulls and edges: a null or empty text has 0 bytes and nothing removed; a text
    shorter than depth is never cut; a null id comes after all others; rows that
    share an id don't cut each other, but are cut by, and cut, the same others;
    an empty table gives no rows; other columns are dropped. A digit or string that
    many documents share costs a row a block, not one for each pair.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number")
    if depth < GRAM + 8:
        raise ValueError(f"depth must be {GRAM + 8} at least")
    spark = docs.sparkSession
    blocks = build_blocks(docs, id_col, text_col)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    n_buckets = partitions_for(spark, size)
    if size >= STEPS_FROM:
        gone = covered_in_turns(blocks, size, depth, n_buckets, hot)
    else:
        replies = told(shared_digits(first_digits(blocks, depth, n_buckets), hot), "bucket", "shared", "hot")
        gone = told(covered(shared_runs(blocks, replies, depth, n_buckets, n_buckets), depth), "n", "starts", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                parts = row["told"] or []
                starts = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(opened(p["starts"], 4 * p["n"]), np.int32), dtype=np.int64) for p in parts)])
                sizes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(opened(p["sizes"], 2 * p["n"]), np.uint16) for p in parts)])
                columns = list(zip(*without(block, starts, starts + sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 4, pa.binary()))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = blocks.join(gone.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"), "left")
    found = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
