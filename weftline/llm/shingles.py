"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 62)) * 4 + 3


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = self.series(_BASE, size)
            self.down = self.series(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down

    @staticmethod
    def series(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes (one more than bytes), and the factors that make places comparable."""
    up, down = POWERS.upto(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * up[: len(raw)], out=out[1:])
    return out, down


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's runs of ``words`` words, ascending; of all its words if it has fewer; none without words.

    A-Z are lower-cased; words stand between blanks and the controls 9 to 13. Equal hashes are taken
    for equal shingles (two different ones among a billion meet with a chance of one in forty).
    """
    text = b" ".join(raw.translate(_LOWER).split())
    if not text:
        return np.zeros(0, dtype=np.uint64)
    hashes, down = prefix_hashes(text)
    blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(text)]])
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix((hashes[ends] - hashes[starts]) * down[starts]))
