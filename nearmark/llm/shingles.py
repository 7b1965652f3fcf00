"""Word shingles as sorted arrays of 64-bit hashes, in NumPy; used inside Arrow batch functions."""

from __future__ import annotations

import numpy as np

#: The odd multiplier of word sequences, and the two of the 64-bit finaliser.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] = _FOLD[97:123]  # A-Z count as a-z


class WordHashes:
    """64-bit hashes of a text's words, A-Z lower-cased, cut at the six blanks; all words of a text at once.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from prefix sums, and then mixed."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            back = np.uint64(pow(int(STEP), -1, 1 << 64))
            n = max(n, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, STEP)]), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, back)]), dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = len(raw)
        if not n:
            return np.empty(0, np.uint64)
        self._grow(n)
        blank = np.ones(n + 2, np.int8)
        blank[1:-1] = _BLANK[raw]
        edges = np.diff(blank)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLD[raw] * self.powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * MIX_1)


def sequence_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; for fewer words one of the whole sequence; none for none."""
    if not len(w):
        return w
    k, n = min(k, len(w)), len(w)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * STEP + w[i : n - k + 1 + i]
    return mix(h)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    return np.unique(sequence_hashes(w, k))
