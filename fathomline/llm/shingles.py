"""Sets of word shingles of whole texts, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from fathomline.llm._shared import mix64

#: Words in a shingle.
WORDS = 5
_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not len(_POWERS) or len(_POWERS["up"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def run_hashes(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the runs of bytes that aren't blank; the last byte is blank."""
    up, down = _powers(len(data) + 1)
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start]), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded texts, and where each text's words start (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    found, start = run_hashes(data, _SPACE[data])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return found, np.searchsorted(start, first)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer words than a shingle make one shingle, no words none."""
    words, at = word_hashes([(t or "").encode() for t in texts])
    n = len(words) - WORDS + 1
    if n > 0:
        windows = np.zeros(n, np.uint64)
        for k, f in enumerate(_FACTORS):
            windows += mix64(words[k : n + k] * f)
        windows = mix64(windows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                x += mix64(words[a + k : a + k + 1] * _FACTORS[k])
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
