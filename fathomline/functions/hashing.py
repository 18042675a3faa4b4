"""Hash of whole numbers for draws that depend on a number alone."""

from __future__ import annotations

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    """The finisher of the splitmix64 generator on unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ x >> np.uint64(31)
