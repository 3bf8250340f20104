"""Operator 9: exact top-k inner products by ball-tree branch and bound in every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .vectors import pair_up, ranked, searched, tables, valid


class BallTree:
    """Nodes with centre and radius; with ``several``, a vec_id may have more vectors than one. A node's inner products with q are at most q . centre + |q| radius."""

    def __init__(self, v: np.ndarray, leaf: int = 64, several: bool = False):
        self.several = several
        self.order = np.arange(len(v))
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []
        todo = [(0, len(v), -1)]
        while todo:
            i, j, parent = todo.pop()
            own = v[self.order[i:j]]
            centre = own.mean(0)
            far = np.linalg.norm(own - centre, axis=1)
            me = len(self.nodes)
            self.nodes.append((i, j, -1, -1))
            centres.append(centre)
            radii.append(far.max())
            if parent >= 0:
                a, b, x, y = self.nodes[parent]
                self.nodes[parent] = (a, b, me, y) if x < 0 else (a, b, x, me)
            if j - i > leaf and far.max() > 0:
                one = own[far.argmax()]
                two = own[np.linalg.norm(own - one, axis=1).argmax()]
                side = (own - (one + two) / 2) @ (two - one)
                mid = (j - i) // 2
                self.order[i:j] = self.order[i:j][np.argpartition(side, mid)]
                todo += [(i, i + mid, me), (i + mid, j, me)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, v: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that hold the k best; nodes below the kth score so far, ``floor`` included, are never opened."""
        bound = self.centres @ q + np.linalg.norm(q) * self.radii
        bound += 1e-9 * np.abs(bound) + 1e-6
        heap = [(-bound[0], 0)]
        at_all, s_all, kth = [], [], floor
        best: list[float] = []
        own_best: dict[int, float] = {}
        while heap:
            up, node = heapq.heappop(heap)
            if -up < kth:
                break
            i, j, x, y = self.nodes[node]
            if x >= 0:
                for c in (x, y):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            at = self.order[i:j]
            at = at[ids[at] != own]
            s = v[at] @ q
            good = s >= kth
            at_all.append(at[good])
            s_all.append(s[good])
            if self.several:
                for one, x in zip(ids[at[good]].tolist(), s[good].tolist(), strict=True):
                    own_best[one] = max(x, own_best.get(one, x))
                best = heapq.nsmallest(k, heapq.nlargest(k, own_best.values()))
            for x in () if self.several else s[good].tolist():
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
            if len(best) == k:
                kth = max(kth, best[0])
        return np.concatenate([np.zeros(0, np.int64), *at_all]), np.concatenate([np.zeros(0), *s_all])


def top_inner_products(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x), exactly.

    Each shard has its ball tree. In the first round each query searches one shard; its kth score there
    bounds from below what can be among its k best anywhere, and goes with the query into every other
    shard as the score that nodes must reach. Products are taken in doubles, which hold every integer
    below 2**53 exactly; where sizes could pass that, in Python integers (a score must fit a long).
    Rows that are null or hold null or non-finite components take no part; repeated rows count once, and a
    vec_id with several vectors counts by its best score (as a query, by its least vector). Ties go to the
    smaller vec_id; an empty table gives no rows; other columns are not read.
    """
    rows = valid(vectors, F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")))
    cands, queries, n, m = tables(rows, every, k)

    def search(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if np.abs(v).max() * np.abs(q).max() * v.shape[1] >= 2**53:
            whole = np.vectorize(int, otypes=[object])
            for i in range(len(qids)):
                at = np.flatnonzero(ids != qids[i])
                yield i, at, (whole(v[at]) * whole(q[i])).sum(1).astype(np.int64)
            return
        tree = BallTree(v, several=len(np.unique(ids)) < len(ids))
        for i in range(len(qids)):
            at, s = tree.search(v, ids, q[i], qids[i], k, floor[i])
            yield i, at, s.astype(np.int64)

    home = written(searched(pair_up(cands, queries, n, m, shard_rows, query_rows, home=True), search, k, "long"), "home")
    kth = ranked(home, k).groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    floored = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    paired = pair_up(cands, floored, n, m, shard_rows, query_rows, floors="kth", home=False)
    return ranked(home.union(searched(paired, search, k, "long")), k)
