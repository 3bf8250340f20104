"""Vectorised word and shingle hashing over whole texts, used inside Spark tasks.

A word is a maximal run of characters outside space and TAB..CR; A-Z are lower-cased and nothing
else is changed, so everything can be done on the UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240521)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS[name]
    if len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    raw = LOWER[raw]
    edge = np.diff(np.concatenate(([0], ~WHITE[raw], [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(raw) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[raw] * _powers("up", _BASE, n - 1), out=total[1:])
    own = (total[end] - total[start]) * _powers("down", _INV, n)[start]
    return mix(own ^ (end - start).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; with fewer words, of the whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return np.unique(out)
