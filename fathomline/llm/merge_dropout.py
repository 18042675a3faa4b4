"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text, with one space put before it, is a row of characters. An agenda of adjacent
symbol pairs that form a piece is worked off, best piece first and leftmost first
among equals. A candidate merge is skipped if a keyed hash of (seed, document,
characters at which the pair begins, is joined and ends) falls below the dropout, so
every candidate of every occurrence has a draw of its own, whatever else is merged
before it. Characters without a piece become byte pieces.

No piece crosses a place whose two characters no piece has side by side: there a text
falls into parts. The agendas of all parts of a batch, grouped by length, are worked
off in step as columns of numpy arrays; only parts beyond LONG have an agenda alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import by_bytes, mix64

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Share of candidates that are skipped.
DROPOUT = 0.1
#: Longest part whose agenda is a column of an array, and lengths that such arrays have.
LONG = 64
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 40, LONG)
#: Columns that are worked on together, bytes of text in a batch, and characters of texts that are worked on at once.
COLUMNS, BYTES, CHARS = 8192, 1 << 20, 1 << 20
#: Factors of the three places of a candidate in its draw.
_PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_NONE, _LOW = 0xFFFFFF, 24
_OUT = np.int32(0x7FFFFFFF)


class Pairs:
    """A map from two symbols to the piece they form, in layers of open slots: what finds its slot taken lies in the next layer."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, symbols: int):
        self.symbols, self.layers = symbols, []
        packed = keys << _LOW | values
        while len(keys):
            bits = max(4, int(4 * len(keys)).bit_length())
            factor = np.int64(int(mix64(np.array([len(self.layers) + 1]))[0]) >> 1 | 1)
            slot = self._slot(keys, factor, bits)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, np.int64)
            table[slot[first]] = packed[first]
            self.layers.append((factor, bits, table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, packed = keys[rest], packed[rest]

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.int64, bits: int) -> np.ndarray:
        return (keys * factor).view(np.uint64) >> np.uint64(64 - bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair; _NONE if it forms none but lies in one, -1 if no piece has it."""
        keys = left.astype(np.int64) * self.symbols + right
        out = np.full(len(keys), -1, np.int32)
        at = None
        for factor, bits, table in self.layers:
            found = table[self._slot(keys, factor, bits)]
            hit = found >> _LOW == keys
            own = np.flatnonzero(hit)
            out[own if at is None else at[own]] = found[own] & _NONE
            rest = np.flatnonzero(~hit & (found >= 0))
            if not len(rest):
                break
            at = rest if at is None else at[rest]
            keys = keys[rest]
        return out


class Pieces:
    """The vocabulary of a model file. Symbols are the pieces by id, then characters that are only in longer pieces, then one for all other characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        score: dict[int, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                score[i] = -model.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        order = {s: k for k, s in enumerate(sorted(set(score.values())))}
        self.size = len(self.raw)
        symbol = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbol.setdefault(c, self.size + len(symbol) - len(self.ids))
        self.other = max([self.size - 1, *symbol.values()]) + 1
        self.rank = np.zeros(self.other + 1, np.int32)
        self.rank[list(score)] = [order[s] for s in score.values()]
        #: Symbols by code point; a space is the mark, a mark of a text is a character without a piece.
        self.char = np.full(0x110000, self.other, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = s
        self.char[ord(" ")], self.char[ord(MARK)] = self.char[ord(MARK)], self.other
        found: dict[tuple[int, int], int] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                found.setdefault((symbol[a], symbol[b]), _NONE)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    found[symbol[p[:k]], symbol[p[k:]]] = i
        #: Whether a piece goes on with a space after another character.
        self.crossed = any(b == MARK and a != MARK for p in self.ids for a, b in zip(p, p[1:]))
        both = np.array(list(found), np.int64).reshape(-1, 2)
        self.pairs = Pairs(both[:, 0] * (self.other + 1) + both[:, 1], np.array(list(found.values()), np.int64), self.other + 1)

    def bytes_of(self, char: str) -> list[int]:
        """Byte pieces of a character."""
        return [self.byte[b] for b in char.encode()]


@cache
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def draws(keys: np.ndarray, first: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit draws of candidates: a keyed hash of the characters at which a pair begins, is joined and ends."""
    places = (x.astype(np.uint64) * f for x, f in zip((first, middle, end), _PLACES))
    return mix64(keys + sum(places)) >> np.uint64(32)


def _in_step(pieces: Pieces, sym: np.ndarray, size: np.ndarray, start: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """Work off the agendas of parts, one a column; start: the character of the document at which a part begins. Symbols by place, -1 where merged away."""
    out, column = np.empty_like(sym), np.arange(sym.shape[1])
    width, m = sym.shape
    rows = np.arange(width, dtype=np.int32)[:, None]
    after = np.where(rows < size, np.minimum(rows + 1, size), size).astype(np.int32)
    before = np.broadcast_to(np.r_[rows - 1, [[width - 1]]], (width + 1, m)).astype(np.int32)
    joined, agenda = np.zeros((width, m), np.int32), np.full((width, m), _OUT, np.int32)

    def consider(place: np.ndarray, next_: np.ndarray, at: np.ndarray) -> None:
        """Put the pairs at (place, next_) of columns on the agenda, or take what is there off it."""
        here = place * m + at
        piece = pieces.pairs.find(sym.reshape(-1)[here], sym.reshape(-1)[next_ * m + at])
        good = (piece >= 0) & (piece != _NONE)
        if limit:
            own = np.flatnonzero(good)
            a, p, n = at[own], place[own], next_[own]
            s = start[a]
            good[own] = draws(keys[a], s + p, s + n, s + after.reshape(-1)[n * m + a]) >= limit
        agenda.reshape(-1)[here] = np.where(good, pieces.rank[piece * good] << 6 | place, _OUT)
        joined.reshape(-1)[here] = piece

    for i in range(width - 1):
        at = np.flatnonzero(size > i + 1)
        if len(at):
            consider(np.full(len(at), i, np.int32), np.full(len(at), i + 1, np.int32), at)
    while True:
        best = agenda.min(0)
        at = np.flatnonzero(best != _OUT)
        if len(at) < 0.75 * m:
            done = np.flatnonzero(best == _OUT)
            out[:, column[done]] = sym[:, done]
            column, size, start, keys, best, m = column[at], size[at], start[at], keys[at], best[at], len(at)
            sym, after, before, joined, agenda = (np.ascontiguousarray(x[:, at]) for x in (sym, after, before, joined, agenda))
            at = np.arange(m)
        if not len(at):
            return out
        place = best[at] & 63
        here = place * m + at
        gone = after.reshape(-1)[here]
        sym.reshape(-1)[here] = joined.reshape(-1)[here]
        sym.reshape(-1)[gone * m + at] = -1
        agenda.reshape(-1)[gone * m + at] = _OUT
        next_ = after.reshape(-1)[gone * m + at]
        after.reshape(-1)[here] = next_
        before.reshape(-1)[next_ * m + at] = place
        agenda.reshape(-1)[here] = _OUT
        prior = before.reshape(-1)[here]
        right, left = np.flatnonzero(next_ < size[at]), np.flatnonzero(prior >= 0)
        consider(np.r_[place[right], prior[left]], np.r_[next_[right], place[left]], np.r_[at[right], at[left]])


def _alone(pieces: Pieces, sym: np.ndarray, start: int, key: np.uint64, limit: int) -> np.ndarray:
    """As _in_step() for one part of any length, its agenda a heap."""
    own, n = sym.tolist(), len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    rank = pieces.rank

    def consider(first: np.ndarray, middle: np.ndarray) -> None:
        end = np.array([after[j] for j in middle.tolist()], np.int64)
        piece = pieces.pairs.find(np.array([own[i] for i in first.tolist()]), np.array([own[j] for j in middle.tolist()]))
        good = (piece >= 0) & (piece != _NONE)
        if limit:
            good &= draws(key, start + first, start + middle, start + end) >= limit
        for i, j, e, p in zip(first[good].tolist(), middle[good].tolist(), end[good].tolist(), piece[good].tolist()):
            heapq.heappush(agenda, (int(rank[p]), i, j, e, p))

    consider(np.arange(n - 1), np.arange(1, n))
    while agenda:
        _, i, j, e, p = heapq.heappop(agenda)
        if own[i] < 0 or own[j] < 0 or after[i] != j or after[j] != e:
            continue
        own[i], own[j], after[i] = p, -1, e
        if e < n:
            before[e] = i
        near = [(i, e)] * (e < n) + [(before[i], i)] * (before[i] >= 0)
        if near:
            consider(*np.array(near, np.int64).T)
    return np.array(own, np.int32)


def text_key(doc: object, text: str) -> bytes:
    """What the draws of a document depend on: its id as text, or its text where it has none."""
    return b"i" + str(doc).encode() if doc is not None else b"t" + text.encode()


def stretches(text: str, whole: bool) -> list[tuple[int, str]]:
    """A text with a space before it, cut into stretches of about CHARS characters, and where each begins: only before a space after another character, where no piece goes on. whole: it can't be cut."""
    spaced, out, first = " " + text, [], 0
    while not whole and len(spaced) - first > CHARS:
        at = spaced.find(" ", first + CHARS)
        while at > 0 and spaced[at - 1] == " ":
            at = spaced.find(" ", at + 1)
        if at < 0:
            break
        out.append((first, spaced[first:at]))
        first = at
    return [*out, (first, spaced[first:])]


def encode_batch(texts: list[str], path: str, seed: int, keys: list[bytes], dropout: float = DROPOUT) -> list[np.ndarray]:
    """Ids of texts. The draws depend on the seed, a text's key and the places of a candidate. Long texts are worked on in stretches."""
    whole = vocabulary(path).crossed
    parts = [(i, first, part) for i, t in enumerate(texts) if t for first, part in stretches(t, whole)]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        last, size = at, 0
        while last < len(parts) and (last == at or size + len(parts[last][2]) <= CHARS):
            size += len(parts[last][2])
            last += 1
        own = parts[at:last]
        for (i, _, _), ids in zip(own, _encode([p for _, _, p in own], [f for _, f, _ in own], path, seed, [keys[i] for i, _, _ in own], dropout)):
            found[i].append(ids)
        at = last
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in found]


def _encode(spaced: list[str], origins: list[int], path: str, seed: int, keys: list[bytes], dropout: float) -> list[np.ndarray]:
    """Ids of stretches of texts that begin at origins."""
    pieces, limit = vocabulary(path), int(dropout * 0x100000000)
    joined = "".join(spaced)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sym = pieces.char[points]
    edges = np.cumsum([0, *map(len, spaced)])
    key = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    digests = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=8, key=key).digest() for k in keys), np.uint64)

    cut = np.ones(len(sym) + 1, bool)
    cut[1:-1] = pieces.pairs.find(sym[:-1], sym[1:]) < 0
    cut[edges] = True
    first = np.flatnonzero(cut)
    first, sizes = first[:-1], np.diff(first)
    doc = np.searchsorted(edges, first, side="right") - 1
    start, own_keys = first - edges[doc] + np.array(origins)[doc], digests[doc]
    low = 2
    for width in WIDTHS:
        group = np.flatnonzero((sizes >= low) & (sizes <= width))
        low = width + 1
        for k in range(0, len(group), COLUMNS):
            own = group[k : k + COLUMNS]
            size = sizes[own].astype(np.int32)
            places = first[own] + np.minimum(np.arange(width)[:, None], size - 1)
            found = _in_step(pieces, np.ascontiguousarray(sym[places]), size, start[own], own_keys[own], limit)
            inside = np.arange(width)[:, None] < size
            sym[places[inside]] = found[inside]
    for i in np.flatnonzero(sizes > LONG).tolist():
        a, b = int(first[i]), int(first[i] + sizes[i])
        sym[a:b] = _alone(pieces, sym[a:b], int(start[i]), own_keys[i], limit)

    at = np.flatnonzero(sym >= 0)
    ids = sym[at]
    raw = np.flatnonzero(ids >= pieces.size)
    edges = np.searchsorted(at, edges)
    if len(raw):
        cached = {p: pieces.bytes_of(chr(p)) for p in np.unique(points[at[raw]]).tolist()}
        spelt = [cached[p] for p in points[at[raw]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[raw] = [len(x) for x in spelt]
        ends = np.cumsum(times)
        ids = np.repeat(ids, times)
        inside = np.repeat(ends[raw] - times[raw], times[raw]) + np.concatenate([np.arange(len(x)) for x in spelt])
        ids[inside] = np.concatenate(spelt)
        edges = np.r_[0, ends][edges]
    return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def decode(ids: list[int] | np.ndarray, path: str) -> str:
    """The text of ids, without the space that encoding put before it."""
    raw = vocabulary(path).raw
    found = b"".join(map(raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return (found[1:] if found[:1] == b" " else found).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, seed: int = 0, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (array of int), lossless (decoding gives the text again).

    Each candidate merge is drawn for by the seed, the document's id as text (its
    text where the id is null) and its place, so all occurrences differ while every
    run with the same seed gives the same ids on any cluster. With dropout 0 the ids
    are those of the sentencepiece library (for texts without U+2581, which is encoded
    as bytes here so that it is not taken for a space).

    Nulls and edges: null and empty texts have no ids; ids may be null or repeated,
    each row has its own result (rows that repeat id and text the same); texts may be
    of any length; an empty table gives no row; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BYTES):
            texts = b.column(1).fill_null("").to_pylist()
            rows = encode_batch(texts, path, seed, [text_key(d, t) for d, t in zip(b.column(0).to_pylist(), texts)], dropout)
            sizes = np.array([len(r) for r in rows], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(rows)))
            same = pa.array([decode(ids, path) == t for ids, t in zip(rows, texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists, same], ["doc_id", "n_tokens", "ids", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean").withColumnRenamed("doc_id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): decoded texts of an array column; null ids give a null text, an empty array an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else decode(x, path) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string").withColumnRenamed("doc_id", id_col)
