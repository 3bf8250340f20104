"""What the cells of a block of sources need lies with them: histories, counts and vectors come once a block, no frame of cells is joined to another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DAY
from . import arrays
from .attention import SQUARE, Group
from .features import transitions
from .stats import activity_cuts, dst_stats

#: Cells of a block, about.
CELLS = 1 << 17


def block_of(cands: DataFrame, bits: int = 0) -> Column:
    """The block of ``src``, some ``CELLS`` cells each; sources that differ in the last ``bits`` only lie together."""
    return F.pmod(F.hash(F.shiftright("src", bits)), F.lit(max(1, -(-cands.count() // CELLS))))


def place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in ``known``, ascending; -1 for what is not there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


class Known:
    """The rows of one kind that a block knows; shorter lists end in zeros."""

    def __init__(self, given: list[pa.RecordBatch], kind: int):
        rows = [b for b in (b.filter(pa.array(arrays.numbers(b, "kind") == kind)) for b in given) if b.num_rows]
        all_of = lambda c: np.concatenate([arrays.numbers(b, c) for b in rows]) if rows else np.empty(0, np.int64)
        self.src, self.cand, self.qid = (all_of(c) for c in ("src", "cand", "qid"))
        self.lens = np.concatenate([b.column("x").value_lengths().to_numpy(zero_copy_only=False) for b in rows]) if rows else np.empty(0, np.int64)
        self.x = np.zeros((len(self.src), int(self.lens.max(initial=0))))
        if rows:
            self.x[np.arange(self.x.shape[1]) < self.lens[:, None]] = np.concatenate([arrays.numbers_of(b, "x") for b in rows])

    def by(self, key: str) -> Known:
        """Sorted by a key that is there once."""
        order = np.argsort(getattr(self, key))
        self.src, self.cand, self.qid, self.lens, self.x = (a[order] for a in (self.src, self.cand, self.qid, self.lens, self.x))
        return self


class Pairs:
    """Rows by two integers."""

    def __init__(self, a: np.ndarray, b: np.ndarray, x: np.ndarray):
        self.a, self.b = np.unique(a), np.unique(b)
        key = self._key(a, b)
        order = np.argsort(key)
        self.keys, self.x = key[order], x[order]

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = place(self.a, a), place(self.b, b)
        return np.where((i >= 0) & (j >= 0), i * len(self.b) + j, -1)

    def of(self, a: np.ndarray, b: np.ndarray, width: int = 1) -> np.ndarray:
        """The rows of the pairs, 0 for those that are not there."""
        out = np.zeros((len(a), self.x.shape[1] if len(self.keys) else width))
        if len(self.keys):
            at = place(self.keys, self._key(a, b))
            out[at >= 0] = self.x[at[at >= 0]]
        return out


def dots(a: Known, i: np.ndarray, b: Known, j: np.ndarray, dims: tuple[int, ...]) -> np.ndarray:
    """Products of the first d factors for each d, summed in order; 0 where one is missing."""
    out, wide = np.zeros((len(i), len(dims))), min(a.x.shape[1], b.x.shape[1])
    both = np.flatnonzero((i >= 0) & (j >= 0))
    if wide and len(both):
        i, j = i[both], j[both]
        sums = np.cumsum(a.x[i, :wide] * b.x[j, :wide], axis=1)
        for k, d in enumerate(dims):
            out[both, k] = np.where(np.minimum(a.lens[i], d) == np.minimum(b.lens[j], d), sums[:, min(d, wide) - 1], 0.0)
    return out


def at_nine(x: np.ndarray) -> np.ndarray:
    """As ``at_digits`` with nine digits."""
    y = x * 1e9
    return np.copysign(np.floor(np.abs(y) + 0.5), y) / 1e9


def _whole(vectors: DataFrame) -> DataFrame:
    """Those without a null, as doubles ``x``."""
    return vectors.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).withColumn("x", F.col("vec").cast("array<double>"))


def vector_frames(cells: DataFrame, users: DataFrame, items: DataFrame, block: Column, more: DataFrame | None = None) -> list[DataFrame]:
    """Vectors of sources, and of the items that a block's cells, or ``more(src, cand)``, hold; a block gets an item once."""
    pairs = cells.select(block.alias("block"), "cand").distinct()
    if more is not None:
        pairs = pairs.union(more.select(block.alias("block"), "cand").distinct()).distinct()
    own = _whole(users).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("cand"), "x")
    return [own, pairs.join(_whole(items).select(F.col("id").alias("cand"), "x"), "cand").select("block", F.lit(0).cast("long").alias("src"), "cand", "x")]


class Sources:
    """Histories, counts and vectors of a block of sources, for the components and static features of its cells."""

    KINDS = 8

    def __init__(self, given: list[pa.RecordBatch], sizes: tuple[int, ...], dims: tuple[int, ...], first: int = 0):
        self.sizes, self.dims = sizes, dims
        edge, hist, active, pair, item, following, user, vec = (Known(given, -k) for k in range(first, first + self.KINDS))
        self.active, self.item, self.user, self.vec = active.by("src"), item.by("cand"), user.by("src"), vec.by("cand")
        self.pair, self.next = Pairs(pair.src, pair.cand, pair.x), Pairs(following.src, following.cand, following.x)
        self.square = self.vec.x @ self.vec.x.T if 0 < len(self.vec.cand) <= SQUARE else None
        time = lambda k: k.x[:, 0].astype(np.int64) if len(k.src) else np.empty(0, np.int64)
        t = time(edge)
        order = np.lexsort((edge.qid, t, edge.src))
        self.time, self.of_item = t[order], place(self.vec.cand, edge.cand[order])
        self.srcs = np.unique(edge.src)
        self.first, self.span = (int(t.min()), int(t.max() - t.min()) + 2) if len(t) else (0, 1)
        self.key = place(self.srcs, edge.src[order]) * self.span + self.time - self.first
        t = time(hist)
        order = np.lexsort((hist.qid, t, hist.src))
        src, cand, t = hist.src[order], hist.cand[order], t[order]
        ends = np.flatnonzero(np.append(src[1:] != src[:-1], True)) if len(src) else np.empty(0, np.int64)
        self.known, self.last = src[ends], cand[ends]
        self.edges, self.latest = np.diff(np.append(-1, ends)), t[ends]
        items = np.unique(cand)
        key, at, n = np.unique(place(self.known, src) * max(len(items), 1) + place(items, cand), return_inverse=True, return_counts=True)
        latest = np.full(len(key), np.iinfo(np.int64).min)
        np.maximum.at(latest, at, t)
        one, two = np.divmod(key, max(len(items), 1))
        self.seen = Pairs(self.known[one], items[two], np.stack([n, latest], 1).astype(float)) if len(key) else Pairs(src, cand, np.empty((0, 2)))

    def _attention(self, src: np.ndarray, cand: np.ndarray, time: np.ndarray, cells: arrays.Cells) -> np.ndarray:
        src, time = src[cells.starts], time[cells.starts]
        at = place(self.srcs, src)
        begin = np.where(at >= 0, np.searchsorted(self.key, at * self.span), 0)
        end = np.where(at >= 0, np.searchsorted(self.key, at * self.span + np.clip(time - self.first, 0, self.span - 1)), 0)
        back = end[:, None] - 1 - np.arange(max(self.sizes))
        there, back = back >= begin[:, None], np.maximum(back, 0)
        g = Group(max(self.sizes))
        g.open, g.ids, g.vecs, g.square, g.qids = False, self.vec.cand, self.vec.x, self.square, np.arange(len(src))
        g.item, g.gap = np.full(back.shape, -1), np.zeros(back.shape)
        if len(self.time):
            g.item = np.where(there, self.of_item[back], -1)
            g.gap = np.where(there, np.log1p(np.where(there, time[:, None] - self.time[back], 0)), 0.0)
        return g.scores(cells.query, cand, np.ones(len(cand), bool), self.sizes, 0.1)

    def static(self, src: np.ndarray, cand: np.ndarray, time: np.ndarray) -> dict[str, np.ndarray]:
        """The columns of ``causal_features``."""
        own, item = place(self.known, src), self.item.x[place(self.item.cand, cand)]
        pair = self.seen.of(src, cand, 2)
        of_src = np.stack([np.where(own >= 0, x[own], 0) if len(x) else np.zeros(len(src)) for x in (self.edges, self.latest)], 1)
        out = {}
        for k, x in (("pair", pair), ("src", of_src), ("dst", item[:, 1:3])):
            ago = np.log1p(np.maximum(time - x[:, 1], 0) / float(DAY))
            out |= {f"{k}_log_count": np.log1p(x[:, 0]), f"{k}_recency": np.where(x[:, 0] > 0, 1.0 / (1.0 + ago), 0.0), f"{k}_seen": (x[:, 0] > 0).astype(float)}
        return out | {f"pair_share_{k}": pair[:, 0] / np.maximum(x, 1) for k, x in (("src", of_src[:, 0]), ("dst", item[:, 1]))}

    def components(self, src: np.ndarray, cand: np.ndarray, time: np.ndarray, base: np.ndarray, cells: arrays.Cells) -> np.ndarray:
        """The columns of ``component_names``."""
        item, vec = self.item.x[place(self.item.cand, cand)], place(self.vec.cand, cand)
        own = place(self.known, src)
        last = np.where(own >= 0, self.last[own], 0) if len(self.known) else np.zeros(len(src), np.int64)
        prev = np.where(own >= 0, place(self.vec.cand, last), -1)
        after = np.where(own >= 0, self.next.of(last, cand)[:, 0], 0.0)
        mf, moved = dots(self.user, place(self.user.src, src), self.vec, vec, self.dims), dots(self.vec, prev, self.vec, vec, self.dims)
        n, pool = self.pair.of(src, cand)[:, 0], item[:, 0]
        rows, total, low, high = self.active.x[place(self.active.src, src)].T
        width = (cells.sizes - 1)[cells.query]
        expected, rest, obs = width * rows * pool / total, width * (rows - 1) * pool / total, n - 1.0
        lift = np.log((obs + 0.5) / (rest + 0.5))
        deviance = np.sign(obs - rest) * np.sqrt(np.maximum(2 * ((obs + 0.5) * lift - (obs - rest)), 0.0))
        bands = [np.where(on, deviance, 0.0) for on in (rows <= low, (rows > low) & (rows <= high), rows > high)]
        bias = item[:, 3]
        return np.stack([*self._attention(src, cand, time, cells), *(mf.T + bias), *(moved.T + bias), pool, base, np.log1p(after), np.log1p(n), (n - expected) / np.sqrt(expected + 1.0), lift, deviance, *bands], 1)


    def rounded(self, src: np.ndarray, cand: np.ndarray, time: np.ndarray, cells: arrays.Cells) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The static columns, and the components over these at nine digits."""
        static = self.static(src, cand, time)
        base = 3.0 * static["pair_seen"] + static["pair_recency"] + static["pair_log_count"]
        return static, at_nine(self.components(src, cand, time, base, cells))


def timed(cands: DataFrame) -> DataFrame:
    """The cells with their time alone."""
    return cands.select("qid", "col", "src", "cand", F.array(F.col("time").cast("double")).alias("x"))


def source_frames(cands: DataFrame, edges: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, block: Column) -> list[DataFrame]:
    """What ``Sources`` knows, of ``cands(qid, src, time, col, cand)``: edges, history, activity, pairs, items, transitions and vectors."""
    log = lambda df: df.select(F.col("seq").alias("qid"), "src", F.col("dst").alias("cand"), F.array(F.col("time").cast("double")).alias("x"))
    doubles = lambda *cols: F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols)).alias("x")
    queries = cands.select("src", "qid").distinct()
    one = F.broadcast(cands.agg(F.count("*").alias("total")).crossJoin(F.broadcast(activity_cuts(queries))))
    active = queries.groupBy("src").agg(F.count("*").alias("rows")).crossJoin(one).select("src", F.lit(0).cast("long").alias("cand"), doubles("rows", "total", "cut_1", "cut_2"))
    pairs = cands.groupBy("src", "cand").agg(F.count("*").alias("n")).select("src", "cand", doubles("n"))
    held = cands.select(block.alias("block"), "cand").distinct()
    stats = cands.groupBy("cand").agg(F.count("*").alias("pool")).join(dst_stats(hist).withColumnRenamed("dst", "cand"), "cand", "left")
    stats = stats.join(items.select(F.col("id").alias("cand"), "bias"), "cand", "left").select("cand", doubles("pool", "dst_cnt", "dst_last", "bias"))
    item = held.join(stats, "cand").select("block", F.lit(0).cast("long").alias("src"), "cand", "x")
    prev = hist.groupBy("src").agg(F.max_by("dst", F.struct("time", "seq")).alias("prev")).select(block.alias("block"), "prev").distinct()
    following = prev.join(transitions(hist), "prev").withColumnRenamed("next", "cand").join(held, ["block", "cand"], "left_semi")
    following = following.select("block", F.col("prev").alias("src"), "cand", doubles("cnt"))
    return [log(edges), log(hist), active, pairs, item, following, *vector_frames(cands, users, items, block, edges.select("src", F.col("dst").alias("cand")))]
