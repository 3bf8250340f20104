"""Operator 5: approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import pair_up, ranked, searched, tables, valid


@cache
def probe_order(hashes: int, most: int) -> np.ndarray:
    """Sets of border crossings in the order of expected success: rows of flags over the 2 * hashes crossings.

    Crossings are named by their rank in distance. For uniform offsets the square of the jth smallest of
    them is expected to be as below, and crossing 2 * hashes - 1 - j is the other border of j's coordinate.
    Sets grow from a heap by shifting or extending their last element; those that move one coordinate both
    ways are skipped. As the order needs ranks only, it is made once, not for each query.
    """
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate((near, far)).tolist()
    out = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        score, own = heapq.heappop(heap)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*own, last + 1)))
        if all(2 * m - 1 - i not in own for i in own):
            out.append(own)
    flags = np.zeros((len(out), 2 * m), np.int64)
    for row, own in enumerate(out):
        flags[row, list(own)] = 1
    return flags


class PStable:
    """Tables of floor((a . x + b) / width) over several Gaussian a, made from dimension and seed alone.

    For the largest inner product, x is scaled by the largest norm and gets one more component that makes
    it a unit vector, and the query one of 0: then nearer is the same as larger.
    """

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, hashes))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.mixer = rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1
        self.width, self.hashes = width, hashes

    def keys(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit name of each row's bucket."""
        norms = np.linalg.norm(vectors, axis=1)
        scaled = vectors / max(norms.max(), 1e-300)
        full = np.hstack((scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]))
        return np.floor((full @ self.a[table] + self.b[table]) / self.width).astype(np.int64) @ self.mixer

    def probes(self, queries: np.ndarray, table: int, most: int) -> np.ndarray:
        """For each query the names of the ``most`` buckets that are likeliest to hold its neighbours, the own one first."""
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        at = (unit @ self.a[table][:-1] + self.b[table]) / self.width
        base = np.floor(at)
        left = at - base
        # crossings sorted by distance: below half a cell the nearer border of each coordinate, then the farther ones
        down = left <= 0.5
        order = np.argsort(np.where(down, left, 1 - left), axis=1, kind="stable")
        step = np.take_along_axis(np.where(down, -1, 1) * self.mixer, order, 1)
        moves = np.hstack((step, -step[:, ::-1]))
        return (base.astype(np.int64) @ self.mixer)[:, None] + moves @ probe_order(self.hashes, most).T


class PStableIndex:
    """A shard's rows by bucket in every table."""

    def __init__(self, vectors: np.ndarray, hashing: PStable, tables: int):
        self.hashing, self.tables = hashing, []
        for t in range(tables):
            names, at = np.unique(hashing.keys(vectors, t), return_inverse=True)
            self.tables.append((names, at.ravel()))

    def visited(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Which rows each query reaches: the merged rows of the visited buckets of all tables."""
        hit = np.zeros((len(queries), len(self.tables[0][1])), bool)
        for t, (names, of) in enumerate(self.tables):
            asked = self.hashing.probes(queries, t, most)
            at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            query, probe = np.nonzero(names[at] == asked)
            open_ = np.zeros((len(queries), len(names)), bool)
            open_[query, at[query, probe]] = True
            hit |= open_[:, of]
        return hit


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, tables_: int = 8, hashes: int = 6, width: float = 1.5, most_probes: int = 120, shard_rows: int = 16_384, query_rows: int = 16_384, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score for rows of ``vectors(vec_id, embedding)`` with vec_id divisible by ``every``.

    Every valid row is indexed, in its shard's own tables; each query visits ``most_probes`` buckets of each
    table, in the order of estimated success, and the merged candidates are ranked by the exact inner product of
    the original vectors, in double precision. If that finds fewer than k others in a shard, the shard is ranked
    whole. Queries go through a shard in blocks: where they visit much of it their products are one matrix
    product, of which only the visited entries count.

    Rows that are null, zero or hold null or non-finite components take no part; repeated rows count once, a
    vec_id with several vectors by its best score (as a query, by its least vector); ties go to the smaller
    vec_id; vectors of another length are another search; an empty table gives no rows; other columns are not
    read. No row is left out of the index; the recall is measured in the tests.
    """
    rows = valid(vectors, F.col("v")).where(F.exists("v", lambda x: x != 0))
    cands, queries, n, m = tables(rows, every, k)

    def search(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        several = len(np.unique(ids)) < len(ids)
        index = PStableIndex(v, PStable(v.shape[1], tables_, hashes, width, seed), tables_)
        block = max(1, (8 << 20) // len(ids))
        for at in range(0, len(qids), block):
            own = q[at : at + block]
            hit = index.visited(own, most_probes)
            hit &= ids[None, :] != qids[at : at + block, None]
            dense = hit.mean() > 0.1
            products = own @ v.T if dense else None
            for i in range(len(own)):
                found = np.flatnonzero(hit[i])
                if (len(np.unique(ids[found])) if several else len(found)) < k:
                    found = np.flatnonzero(ids != qids[at + i])
                s = products[i, found] if dense else v[found] @ own[i]
                if len(found) > 4 * k and not several:
                    keep = s >= np.partition(s, -2 * k)[-2 * k]
                    found, s = found[keep], s[keep]
                # the score is the plain sum in double precision, whatever the order in which blocks add
                yield at + i, found, (v[found] * own[i]).sum(1)

    return ranked(searched(pair_up(cands, queries, n, m, shard_rows, query_rows), search, k, "double"), k)
