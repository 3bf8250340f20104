"""Fast similarity sketching (Dahlgaard, Knudsen and Thorup): t bins filled in rounds.

In round i < t each element falls into one hashed bin with the value i + fraction; in round t + j all
elements go to bin j. A bin keeps its least value, and the rounds end when every bin is filled, so
every coordinate is set, an early one costs one hash an element, and the share of equal coordinates
of two sketches concentrates about the Jaccard similarity as for independent draws.
"""

from __future__ import annotations

import numpy as np

from .words import mix

EMPTY = np.uint64(2**64 - 1)
ONE, FORTY, FRACTION, STEP = np.uint64(1), np.uint64(40), np.uint64((1 << 40) - 1), np.uint64(0xD1342543DE82EF95)


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: one 64-bit value a bin, round in the top bits.

    Rounds are taken together, as many as make about eight draws a bin, and only draws that hit a bin
    still empty at their start count: a later round never undercuts an earlier one.
    """
    out = np.full(bins, EMPTY, np.uint64)
    wide = max(1, 8 * bins // len(elements))
    for first in range(0, bins, wide):
        rounds = np.arange(first, min(bins, first + wide), dtype=np.uint64)[:, None]
        h = mix(elements[None, :] + (rounds + ONE) * STEP)
        where = ((h >> FORTY) * np.uint64(bins) >> np.uint64(24)).astype(np.int64).ravel()
        value = ((rounds << FORTY) | (h & FRACTION)).ravel()
        if first:
            open_ = out[where] == EMPTY
            where, value = where[open_], value[open_]
        np.minimum.at(out, where, value)
        if not (out == EMPTY).any():
            return out
    for j in np.flatnonzero(out == EMPTY):
        i = np.array([bins + j], np.uint64)
        out[j] = ((i << FORTY) | (mix(elements + (i + ONE) * STEP) & FRACTION)).min()
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """For sketches (one a row), signed 64-bit keys of each run of ``rows`` coordinates; a key depends on its band."""
    bands = values[:, : values.shape[1] // rows * rows].reshape(len(values), -1, rows)
    out = np.repeat(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)[None, :], len(values), axis=0)
    for k in range(rows):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + bands[:, :, k])
    return out.view(np.int64)
