"""A wavelet matrix over token ids: bit planes with rank and select, one compressed row of a shard file each.

Plane k holds bit ``levels - 1 - k`` of every id, after the ids were stably parted by the bits above. Rank
directories hold the ones before every 512 bits and are stored beside the planes, so access, counting and
lookup touch one block a plane. All of them take arrays of positions.
"""

from __future__ import annotations

import numpy as np

_STEP = 512
_BYTES = _STEP // 8


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits, and the whole at the end."""
    whole = np.zeros(-(-len(plane) // _BYTES) * _BYTES, np.uint8)
    whole[: len(plane)] = plane
    out = np.zeros(len(whole) // _BYTES + 1, np.uint32)
    np.cumsum(np.bitwise_count(whole.view(np.uint64)).reshape(-1, _BYTES // 8).sum(1, dtype=np.uint32), out=out[1:])
    return out


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], n: int, zeros: list[int]):
        self.planes, self.ranks, self.n, self.zeros = planes, ranks, n, zeros

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        kind = np.uint16 if levels <= 16 else np.uint32
        planes, zeros, now = [], [], np.asarray(ids).astype(kind)
        for k in reversed(range(levels)):
            one = (now & kind(1 << k)).astype(bool)
            planes.append(np.packbits(one))
            left = now.take(np.flatnonzero(~one))
            zeros.append(len(left))
            now = np.concatenate((left, now.take(np.flatnonzero(one))))
        return cls(planes, [_directory(p) for p in planes], len(now), zeros)

    def to_row(self) -> tuple[bytes, bytes, list[int], int]:
        """Planes, rank directories (little-endian unsigned 32-bit), zeros of each plane, length."""
        return b"".join(p.tobytes() for p in self.planes), b"".join(r.astype("<u4").tobytes() for r in self.ranks), self.zeros, self.n

    @classmethod
    def from_row(cls, planes: bytes, ranks: bytes, zeros: list[int], n: int) -> WaveletMatrix:
        """The matrix over a stored row; nothing is copied or built anew."""
        width, blocks = -(-n // 8), -(-n // _STEP) + 1
        raw, table = np.frombuffer(planes, np.uint8), np.frombuffer(ranks, "<u4")
        each = range(len(zeros))
        return cls([raw[i * width : (i + 1) * width] for i in each], [table[i * blocks : (i + 1) * blocks] for i in each], n, list(zeros))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of plane k."""
        plane, block = self.planes[k], at // _STEP
        out = self.ranks[k][block].astype(np.int64)
        byte = at >> 3
        for j in range(_BYTES):
            own = block * _BYTES + j
            full = own < byte
            if not full.any():
                break
            out[full] += np.bitwise_count(plane[own[full]])
        part = (at & 7) > 0
        out[part] += np.bitwise_count(plane[byte[part]] >> (8 - (at[part] & 7)).astype(np.uint8))
        return out

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.int64)
        for k, plane in enumerate(self.planes):
            bit = (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            ones = self._ones(k, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        at = np.array([start, end], np.int64)
        levels = len(self.planes)
        if token < 0 or token >> levels:
            return 0, 0
        for k in range(levels):
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if token >> (levels - 1 - k) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of the token in [start, end)."""
        i, j = self._range(token, start, self.n if end is None else end)
        return j - i

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) such bits of plane k: the block by its directory, then the bit within."""
        ones = self.ranks[k].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * _STEP - ones
        block = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for i in range(0, len(nth), 4096):
            own, inverse = np.unique(block[i : i + 4096], return_inverse=True)
            raw = np.zeros((len(own), _BYTES), np.uint8)
            for row, b in enumerate(own.tolist()):
                piece = self.planes[k][b * _BYTES : (b + 1) * _BYTES]
                raw[row, : len(piece)] = piece
            sums = np.cumsum(np.unpackbits(raw, axis=1) == bit, axis=1, dtype=np.int16)
            want = nth[i : i + 4096] - before[block[i : i + 4096]] + 1
            out[i : i + 4096] = block[i : i + 4096] * _STEP + (sums[inverse] < want[:, None]).sum(1)
        return out

    def find(self, token: int) -> np.ndarray:
        """Positions of all occurrences of the token, ascending."""
        i, j = self._range(token, 0, self.n)
        return self._up(token, np.arange(i, j))

    def select(self, token: int, nth: int) -> int:
        """Position of the token's nth occurrence, from 0; -1 if there are fewer."""
        i, j = self._range(token, 0, self.n)
        return -1 if nth < 0 or i + nth >= j else int(self._up(token, np.array([i + nth]))[0])

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        levels = len(self.planes)
        for k in reversed(range(levels)):
            bit = token >> (levels - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the partings undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        low = np.zeros(self.n, kind)
        for k in reversed(range(len(self.planes))):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            # places are faster than masks, whose bits no branch predictor foresees
            up[np.flatnonzero(~one)] = low[: self.zeros[k]]
            up[np.flatnonzero(one)] = low[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            low = up
        return low
