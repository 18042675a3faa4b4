"""Token-id files with an adaptive context-mixing range coder.

A file is coded as a stream of units, runs of ids such as those of a word, and a
dictionary of the ids of its units. A unit's first place in the stream is coded as
"new", later ones by number, so that the ids of rare units are coded once and those of
frequent ones need no coding after that. Stream and dictionary are coded alike.
Symbols are cut into blocks that share nothing but the table of symbols. A block's
model starts anew and learns from the symbols before: order 2 predicts the symbol that has
followed the same two symbols, with how sure it has been; order 1 the last two different
symbols that followed the same symbol; order 0 the distribution of the table.
The distributions are mixed with weights that adapt to how often each of them was
right in the like state, and the mixture drives a range coder. All blocks
are coded in step, as lanes of numpy arrays.

A file is a row of a Parquet table in the shared folder (part, file, data), as Spark has no
writer of plain binary objects. Its layout (little-endian): magic, documents, bytes of the stream,
units in the dictionary, bytes of their lengths (no units: the stream holds ids); for each document its
number of ids; the stream; how many ids each unit has and whether it comes again, deflated; the dictionary's
ids. Stream and ids of the dictionary have: symbols in a block, blocks, bytes of the
table; for each block its symbols, payload bytes and the crc32 of its symbols; the table, symbols
(as differences) and their counts, deflated; then the payloads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, partitions_for, stage, utf8_view
from fathomline.llm.token_counts import tokenizer

MAGIC = b"FLCM3\0\0\0"
#: Symbols in a block, at most and at least, and blocks that are wished for in a file.
BLOCK, LEAST, LANES = 8192, 512, 2048
#: Bytes of text in a file, about.
FILE_BYTES = 9 << 20
#: Bits of the numbers of a block's order-1 and order-2 contexts.
BITS1, BITS2 = 10, 12
#: Bits of the sum of a state's weights, how fast they adapt (a share of 1 / 2^RATE at a time), and how sure order 2 may be.
SUM_BITS, RATE, SUREST = 12, 5, 3
#: Units that a worker remembers, bytes of their texts and ids, and bytes of the longest.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 600_000, 32 << 20, 64
#: Units that the library encodes at a time, and those in a piece.
UNITS, PIECE = 16_000, 2000
#: Id that ends a document.
END_ID = 2
#: Registers have 60 bits and give out 16 at a time when a range is below _LOW. It may stay there as long as that is enough to be cut twice.
_TOP, _LOW = 1 << 60, 1 << 44


def start_cuts() -> np.ndarray:
    """Where the weights of (order 2, newest follower, follower before it, order 0) end, from 0 on, by state: how sure order 2 is (0: no prediction), and which followers it leaves open."""
    out = np.zeros((SUREST + 1, 2, 2, 8), np.int16)
    for sure in range(SUREST + 1):
        two = (0.0, 0.15, 0.5, 0.8)[sure]
        for newest in range(2):
            for older in range(2):
                one = (1 - two) * np.array([newest, older]) * (1 / 6, 1 / 12)
                ends = np.cumsum([two, *one]) * (1 << SUM_BITS)
                out[sure, newest, older, 1:4] = np.maximum(ends, [1, 2, 3])
    out[..., 4] = 1 << SUM_BITS
    return out.reshape(-1, 8)


def aims() -> np.ndarray:
    """What the cuts of a state move to, by which of the four was right; no weight falls to nothing."""
    out = np.zeros((4, 8), np.int16)
    for right in range(4):
        for k in range(1, 4):
            out[right, k] = k if k <= right else (1 << SUM_BITS) - 4 + k
    out[:, 4] = 1 << SUM_BITS
    return out


class Order0:
    """The distribution of a file's symbols (by place in its table) in whole numbers, and what place a number stands for."""

    def __init__(self, counts: np.ndarray):
        self.bits = max(16, int(2 * len(counts) - 1).bit_length() + 1)
        spare = (1 << self.bits) - len(counts)
        share = counts.astype(np.float64) / counts.sum()
        own = 1 + np.floor(share * spare).astype(np.int64)
        own[int(np.argmax(counts))] += (1 << self.bits) - own.sum()
        self.sizes = np.r_[own, 1 << self.bits]  # one more that stands for all
        self.first = np.r_[np.cumsum(own) - own, 0]
        self.place = np.repeat(np.arange(len(own), dtype=np.int32), own)


class Coder:
    """Range coders in step: to 16-bit words, or with data = (words, starts) from them. A range is cut into 2 ** bits parts at a time."""

    def __init__(self, n: int, bits: int, data: tuple[np.ndarray, np.ndarray] | None = None):
        self.least = min(_LOW, 1 << bits + 6)
        self.low, self.range = np.zeros(n, np.int64), np.full(n, _TOP - 1, np.int64)
        self.words: list[np.ndarray] = []
        self.code = None
        if data is not None:
            words, self.at = data[0], data[1] + 3
            begin = words[data[1][:, None] + np.arange(4)].astype(np.int64)
            self.code = begin[:, 0] << 44 | begin[:, 1] << 28 | begin[:, 2] << 12 | begin[:, 3] >> 4
            self.raw = (words[:-1] & 15) << 12 | words[1:] >> 4

    def turn_over(self, m: int) -> None:
        """Move settled words out of (or new ones into) the first m lanes."""
        wide = self.range[:m]
        while True:
            short = (wide < _LOW).astype(np.int64)
            bits = short << 4
            wide <<= bits
            if self.code is None:
                low = self.low[:m]
                word = (low >> 44) * short
                low -= word << 44
                low <<= bits
                self.words.append((word << 1 | short).astype(np.int32))
            else:
                code, at = self.code[:m], self.at[:m]
                code <<= bits
                code |= self.raw.take(at, mode="clip") * short
                at += short
            if np.minimum.reduce(wide) >= self.least:
                return

    def done(self) -> list[bytes]:
        """The bytes of each lane. A word may hold a carry for the word before it."""
        low = self.low
        self.words += [x.astype(np.int32) << 1 | 1 for x in (low >> 44, low >> 28 & 0xFFFF, low >> 12 & 0xFFFF, low << 4 & 0xFFFF)]
        table = np.zeros((len(low), len(self.words)), np.int32)  # word << 1, 1 more if it is one
        for t, w in enumerate(self.words):
            table[: len(w), t] = w
            self.words[t] = None
        self.words.clear()
        given = (table & 1).astype(bool)
        ends = np.cumsum(np.count_nonzero(given, axis=1))
        word = table[given] >> 1
        while (over := np.flatnonzero(word > 0xFFFF)).size:
            word[over] &= 0xFFFF
            word[over - 1] += 1  # the first word of a lane never has a carry
        raw = word.astype("<u2").tobytes()
        return [raw[2 * a : 2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def code_places(places: np.ndarray, sizes: np.ndarray, order0: Order0, data: tuple[np.ndarray, np.ndarray] | None = None) -> list[bytes] | None:
    """Code lanes x steps of places in the table; with data fill places in. Lanes lie by size, the longest first."""
    n, read = len(sizes), data is not None
    coder = Coder(n, SUM_BITS + order0.bits, data)
    columns = np.ascontiguousarray(places.T, np.int32)
    every = np.arange(n, dtype=np.int64)
    states = (SUREST + 1) * 4
    base1, base2, base_w, base_c = every << BITS1, every << BITS2, every * states, every * 8
    followers, second = np.zeros(n << BITS1, np.int64), np.zeros(n << BITS2, np.int32)  # newest follower | the one before it << 32; prediction << 2 | how sure
    cuts, aim = np.tile(start_cuts(), (n, 1)), aims().view(np.complex128).reshape(-1)
    whole_cuts = cuts.view(np.complex128).reshape(-1)  # a state's eight numbers as one
    which = np.array([3, 2, 1, 1, 0, 0, 0, 0])  # what was right, by order 2 << 2 | newest << 1 | the one before it
    gain, drop = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int32), np.array([1, 1, 0, 0, 0, 0, 0, 0], bool)  # how a prediction fares, by was right << 2 | how sure
    bits, others = order0.bits, len(order0.sizes) - 1
    one, hash_one = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = np.zeros((4, n), np.int32)  # what a lane's symbol may be
    lasting = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()

    for t, m in enumerate(lasting):
        h = one[:m] * 0x2545F491
        i1 = (h >> 9 & ((1 << BITS1) - 1)) + base1[:m]
        i2 = ((hash_one[:m] ^ h) >> 11 & ((1 << BITS2) - 1)) + base2[:m]
        pair, packed = followers.take(i1), second.take(i2)
        halves = pair.view(np.int32).reshape(m, 2)
        first, then = halves[:, 0].copy(), halves[:, 1].copy()
        guess, sure = packed >> 2, packed & SUREST
        row = ((first != guess) & (first != 0)).view(np.uint8) * np.uint8(2) + ((then != guess) & (then != 0)).view(np.uint8) + (sure << 2) + base_w[:m]
        own = whole_cuts.take(row).view(np.int16)

        # the mixture: parts of order 2, of the followers that order 2 didn't name, and of order 0
        wide = coder.range[:m]
        part = wide >> SUM_BITS
        if read:
            code, by_state = coder.code[:m], own.reshape(m, 8)
            right = (code >= part * by_state[:, 1]).astype(np.int64)
            right += code >= part * by_state[:, 2]
            right += code >= part * by_state[:, 3]
        else:
            small = columns[t, :m] + 1
            symbol = small.astype(np.int64)
            right = which.take((guess == small).view(np.uint8) * np.uint8(4) + (first == small).view(np.uint8) * np.uint8(2) + (then == small).view(np.uint8))
        at = right + base_c[:m]
        start = own.take(at)
        part2 = part * (own[1:].take(at, mode="clip") - start) >> bits
        if read:
            code -= part * start
            place = order0.place.take(code // part2, mode="clip")
            lines = found[:, :m]
            lines[0], lines[1], lines[2] = guess, first, then
            np.add(place, 1, out=lines[3], casting="unsafe")
            small = found.reshape(-1).take(right * n + every[:m])
            symbol = small.astype(np.int64)
            columns[t, :m] = small - 1
            place = np.where(right == 3, place, others)
            code -= part2 * order0.first.take(place)
        else:
            place = np.where(right == 3, columns[t, :m], others)
            low = coder.low[:m]
            low += part * start
            low += part2 * order0.first.take(place)
        np.multiply(part2, order0.sizes.take(place), out=wide)
        coder.turn_over(m)

        # the model learns: weights of what was right, then the predictions
        own += aim.take(right).view(np.int16) - own >> RATE
        whole_cuts[row] = own.view(np.complex128)
        fate = (guess == small) * np.int32(4) + sure
        second[i2] = np.where(drop.take(fate), small * np.int32(4) + np.int32(1), packed + gain.take(fate))
        followers[i1] = np.where(first == small, pair, pair << 32 | symbol)
        hash_one[:m] = h * 5 & 0x7FFFFFFFFFFF
        one[:m] = symbol
    if not read:
        return coder.done()
    places[:] = columns.T
    return None


def encode_symbols(symbols: np.ndarray) -> bytes:
    """Symbols in blocks, with their table."""
    length = min(BLOCK, max(LEAST, -(-len(symbols) // LANES)))
    n = -(-len(symbols) // length)
    times = np.bincount(symbols)
    names = np.flatnonzero(times)
    times = times[names]
    table = zlib.compress(np.diff(names, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 6) if n else b""
    head = struct.pack("<III", length, n, len(table))
    if not n:
        return head
    sizes = np.minimum(length, len(symbols) - np.arange(n) * length)
    grid = np.zeros((n, length), np.int32)
    numbers = np.zeros(int(names[-1]) + 1, np.int32)
    numbers[names] = np.arange(len(names))
    grid.reshape(-1)[: len(symbols)] = numbers[symbols]
    payloads = code_places(grid, sizes, Order0(times))
    rows = [struct.pack("<III", size, len(p), zlib.crc32(symbols[i * length : i * length + size].astype("<u4").tobytes())) for i, (size, p) in enumerate(zip(sizes.tolist(), payloads))]
    return b"".join([head, *rows, table, *payloads])


def decode_symbols(data: bytes) -> np.ndarray:
    """The symbols of blocks; ValueError if a block's checksum differs."""
    length, n, n_table = struct.unpack_from("<III", data)
    if not n:
        return np.zeros(0, np.uint32)
    rows = np.frombuffer(data, "<u4", 3 * n, 12).reshape(n, 3).astype(np.int64)
    at = 12 + 12 * n
    table = np.frombuffer(inflate(data[at : at + n_table]), "<u4").reshape(2, -1).astype(np.int64)
    at += n_table
    starts = np.cumsum(rows[:, 1]) - rows[:, 1]
    if (rows[:, 1] % 2).any() or rows[:, 0].max() > length or at + rows[:, 1].sum() > len(data):
        raise ValueError("the list of blocks is broken")
    words = np.frombuffer(data[at : at + int(rows[:, 1].sum())] + bytes(64), "<u2")  # a broken block may ask for more than there is
    names = np.cumsum(table[0]).astype(np.uint32)
    grid = np.zeros((n, length), np.int32)
    code_places(grid, rows[:, 0], Order0(table[1]), (words, starts // 2))
    out = []
    for i in range(n):
        own = names.take(grid[i, : rows[i, 0]], mode="clip")
        if zlib.crc32(own.astype("<u4").tobytes()) != rows[i, 2]:
            raise ValueError(f"block {i} is broken")
        out.append(own)
    return np.concatenate(out)


def inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        raise ValueError("a table is broken") from None


def runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of the pool, one after the other."""
    at = starts.astype(np.int32)
    lengths = lengths.astype(np.int32)
    at += lengths
    at -= np.cumsum(lengths, dtype=np.int32)
    at = np.repeat(at, lengths)
    at += np.arange(len(at), dtype=np.int32)
    return pool.take(at)


def encode_file(ids: np.ndarray, counts: list[int]) -> bytes:
    """A file of documents whose ids lie one after the other in ids, each of them a symbol."""
    stream = encode_symbols(ids)
    return b"".join([struct.pack("<8sIIII", MAGIC, len(counts), len(stream), 0, 0), np.array(counts, "<u4").tobytes(), stream])


def encode_units(stream: np.ndarray, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> bytes:
    """A file of documents as a stream of numbers of units, whose ids (lengths of them each) lie one after the other in ids; counts has the documents' ids."""
    first = np.full(len(lengths), -1, np.int32)
    first[stream[::-1]] = np.arange(len(stream) - 1, -1, -1, np.int32)  # the last to be set stays
    used = np.flatnonzero(first >= 0)
    used = used[np.argsort(first[used])]
    again = np.bincount(stream, minlength=len(lengths))[used] > 1
    symbols = np.zeros(len(lengths), np.int32)
    symbols[used[again]] = np.arange(1, np.count_nonzero(again) + 1)
    symbols = symbols[stream]
    symbols[first[used]] = 0
    coded = encode_symbols(symbols)
    own = lengths[used]
    about = zlib.compress(own.astype("<u4").tobytes() + np.packbits(again).tobytes(), 6)
    starts = np.cumsum(lengths) - lengths
    head = struct.pack("<8sIIII", MAGIC, len(counts), len(coded), len(used), len(about))
    return b"".join([head, np.asarray(counts, "<u4").tobytes(), coded, about, encode_symbols(runs(ids, starts[used], own))])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a file and the number of ids of each document; ValueError if a checksum differs."""
    magic, n_docs, n_stream, n_units, n_about = struct.unpack_from("<8sIIII", data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    counts = np.frombuffer(data, "<u4", n_docs, 24)
    at = 24 + 4 * n_docs
    symbols = decode_symbols(data[at : at + n_stream])
    if not n_units:
        return symbols, counts
    at += n_stream
    about = inflate(data[at : at + n_about])
    lengths = np.frombuffer(about, "<u4", n_units).astype(np.int32)
    again = np.flatnonzero(np.unpackbits(np.frombuffer(about, np.uint8, offset=4 * n_units), count=n_units))
    ids = decode_symbols(data[at + n_about :])
    units = np.r_[0, again].astype(np.int32)[symbols]
    units[symbols == 0] = np.arange(n_units)
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    return runs(ids, starts[units], lengths[units]), counts


#: Kinds of bytes: 1 letters, 2 digits, 4 other signs, 8 a space, 16 a line feed; 32 bytes that may begin white space, 64 others that don't; 0 controls.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 4
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x20], _KIND[0x0A] = 8, 16
_KIND[0x80:] = 64
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 32


def cut_units(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Units of texts, and how many each text has. Cuts are where the pre-tokenizer of byte-level vocabularies always begins anew, whatever stands around.

    That is before a single space and a sign, letter or digit; after a letter and before
    another ASCII character; after a sign and before a line feed or space; after a
    sign other than the apostrophe and before a letter; after a line feed between
    two ASCII characters that aren't white space. Texts with a special string are one unit.
    """
    data, offsets = utf8_view(texts)
    kind = _KIND[data]
    before, here = kind[:-1], kind[1:]
    solid = (kind & (1 | 2 | 4)) != 0
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        inner = cut[1:-1]
        inner |= (before == 1) & ((here & (2 | 4 | 16)) != 0)
        inner |= (before == 4) & ((here & (8 | 16)) != 0)
        inner |= (before == 4) & (data[:-1] != 0x27) & (here == 1)
        cut[:-2] |= (before == 8) & ((here & (1 | 2 | 4 | 64)) != 0)
        cut[2:-1] |= (before[1:] == 16) & solid[:-2] & solid[2:]
    for i in np.flatnonzero(np.any([pc.match_substring(texts.fill_null(""), x).to_numpy(zero_copy_only=False) for x in specials], axis=0)) if specials else ():
        cut[offsets[i] : offsets[i + 1]] = False
    filled = np.diff(offsets) > 0
    cut[offsets[:-1][filled]] = True
    cut[-1] = True
    bounds = np.flatnonzero(cut)
    found = np.searchsorted(bounds, offsets)
    ends = (bounds if len(data) else bounds[:0]).astype(np.int32)
    units = pa.StringArray.from_buffers(max(len(ends) - 1, 0), pa.py_buffer(ends if len(ends) else np.zeros(1, np.int32)), pa.py_buffer(data))
    return units, np.diff(found)


class Remembered:
    """Ids of units, within a number of units and bytes."""

    def __init__(self):
        self.forget()

    def __len__(self) -> int:
        return len(self.units)

    def find(self, units: pa.Array) -> np.ndarray:
        """Numbers of units, -1 for those that aren't there."""
        return pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy().copy()

    def keep(self, units: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Take the first of the units that aren't too long, as far as there is room."""
        size = pc.binary_length(units).to_numpy()
        small = np.flatnonzero(size <= LONGEST)
        room = np.searchsorted(np.cumsum(size[small] + 4 * lengths[small]), REMEMBERED_BYTES - self.size, side="right")
        room = max(0, min(room, REMEMBERED - len(self)))
        self.full = room < len(small)
        small = small[:room]
        if len(small):
            own = lengths[small]
            self.units = pa.concat_arrays([self.units, units.take(pa.array(small))])
            self.ids = np.r_[self.ids, runs(ids, (np.cumsum(lengths) - lengths)[small], own)]
            self.lengths = np.r_[self.lengths, own]
            self.size += int((size[small] + 4 * own).sum())

    def forget(self) -> None:
        self.units, self.ids, self.lengths, self.size, self.full = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64), 0, False


@cache
def remembered(path: str) -> Remembered:
    return Remembered()


@cache
def id_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for."""
    tok = tokenizer(path)
    special = {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
    return np.array([special.get(i) or len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size(with_added_tokens=True))], np.int64)


def library_ids(units: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units, one after the other, and how many each has.

    Words with a space before them begin a token wherever they stand: they are
    joined to pieces, and the ids of a piece are cut apart by their bytes. Other units are encoded alone.
    """
    tok, ids, lengths = tokenizer(path), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    joins = pc.match_substring_regex(units, "^ [!-~]").to_numpy(zero_copy_only=False)
    for i in range(0, len(units), UNITS):
        own = units[i : i + UNITS]
        join = joins[i : i + UNITS]
        words, others = own.filter(pa.array(join)), own.filter(pa.array(~join)).to_pylist()
        texts, ends = words.to_pylist(), np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
        found = [e.ids for e in tok.encode_batch_fast(["".join(texts[j : j + PIECE]) for j in range(0, len(texts), PIECE)] + others, add_special_tokens=False)]
        n_pieces = len(found) - len(others)
        pool = np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))
        n_joined = sum(map(len, found[:n_pieces]))
        cuts = np.searchsorted(np.cumsum(id_bytes(path)[pool[:n_joined]]), ends, side="left") + 1
        counts = np.zeros(len(own), np.int64)
        counts[join] = np.diff(cuts, prepend=0)
        counts[~join] = np.fromiter(map(len, found[n_pieces:]), np.int64, len(others))
        starts = np.zeros(len(own), np.int64)
        starts[join] = cuts - counts[join]
        starts[~join] = n_joined + np.cumsum(counts[~join]) - counts[~join]
        lengths.append(counts)
        ids.append(runs(pool, starts, counts))
    return np.concatenate(ids), np.concatenate(lengths)


def unit_ids(units: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different units, one after the other, and how many each has. Those that aren't remembered are encoded."""
    known = remembered(path)
    at = known.find(units)
    fresh = at < 0
    if known.full and 4 * np.count_nonzero(fresh) > 3 * len(units):
        known.forget()
        fresh[:] = True
    new = units.filter(pa.array(fresh))
    ids, lengths = library_ids(new, path)
    pool, pool_lengths = np.r_[known.ids, ids], np.r_[known.lengths, lengths]
    at[fresh] = len(known) + np.arange(len(new))
    starts = np.cumsum(pool_lengths) - pool_lengths
    known.keep(new, ids, lengths)
    return runs(pool, starts[at], pool_lengths[at]), pool_lengths[at].astype(np.int32)


@cache
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def numbered(texts: list[pa.Array], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the units of texts, how many each text has, and ids of the different units and how many each has."""
    found = [cut_units(t, list(specials(path))) for t in texts]
    coded = pa.chunked_array([u for u, _ in found], pa.string()).dictionary_encode().combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
    ids, lengths = unit_ids(coded.dictionary, path)
    return coded.indices.to_numpy(), np.concatenate([n for _, n in found]), ids, lengths


def text_ids(texts: list[str], path: str) -> list[bytes]:
    """32-bit ids of whole texts."""
    stream, n_units, ids, lengths = numbered([pa.array(texts, pa.string())], path)
    raw = runs(ids, (np.cumsum(lengths) - lengths)[stream], lengths[stream]).tobytes()
    ends = np.r_[0, np.cumsum(lengths[stream])][np.cumsum(n_units)].tolist()
    return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]


def encode_texts(texts: list[pa.Array], path: str, end_id: int = END_ID) -> tuple[bytes, int]:
    """A file of whole texts, each with an end, and how many ids it has."""
    stream, n_units, ids, lengths = numbered(texts, path)
    ends = np.cumsum(n_units + 1)
    ended = np.full(len(stream) + len(n_units), len(lengths), np.int32)  # the end is one more unit
    inner = np.ones(len(ended), bool)
    inner[ends - 1] = False
    ended[inner] = stream
    ids, lengths = np.r_[ids, np.int32(end_id)], np.r_[lengths, np.int32(1)]
    counts = np.diff(np.r_[0, np.cumsum(lengths[ended])][ends], prepend=0)
    del stream, inner
    pa.default_memory_pool().release_unused()  # texts and their units went through Arrow; coding needs the room
    return encode_units(ended, ids, lengths, counts), int(counts.sum())


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of all documents' ids in ascending id order, as a staged table (part, file, doc_ids, n_ids, data).

    part numbers ranges of ids, file the files in a range. Null texts are empty;
    null ids come first; rows that share an id are ordered by a hash of their text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = ("doc_id", F.xxhash64("text"))
    ranged = docs.repartitionByRange(partitions_for(docs.sparkSession, n_bytes), *order).sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def done():
            data, n_ids = encode_texts(texts, path, end_id)
            values = [part, number, pa.concat_arrays(ids).to_pylist(), n_ids, data]
            types = [pa.int64(), pa.int64(), pa.list_(ids[0].type), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["part", "file", "doc_ids", "n_ids", "data"])

        for b in by_bytes(batches, "text", 2 << 20):
            ids.append(b.column(0))
            texts.append(b.column(1))
            size += pc.sum(pc.binary_length(b.column(1))).as_py()
            if size >= FILE_BYTES:
                yield done()
                ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield done()

    return stage(ranged.mapInArrow(run, f"part long, file long, doc_ids array<{kind}>, n_ids long, data binary"), "token-ids")


def read_ids(files: DataFrame) -> DataFrame:
    """One row per document of written files: doc_id, start (ids before it), n_tokens, ids (32-bit little-endian bytes).

    Totals of the parts, one number each, go through the driver; starts within a
    part come from a window over its files.
    """
    from pyspark.sql import Window

    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(totals):
        before[p] = at
        at += totals[p]
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("start"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, start, doc_ids, data = (c[i] for c in b.columns)
                ids, counts = decode_file(data.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                first = before[part.as_py()] + start.as_py() + ends - counts
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, 4 * ends]), pa.py_buffer(np.asarray(ids, "<u4"))])
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first), pa.array(counts.astype(np.int64)), rows.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    joined = files.join(starts, ["part", "file"]).select("part", "start", "doc_ids", "data")
    return joined.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def id_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back."""
    return read_ids(write_ids(docs, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
