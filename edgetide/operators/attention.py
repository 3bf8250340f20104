"""Candidate-conditioned attention over as-of histories, counted in arrays: no row for each cell and item of its history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import history_asof

#: Queries of one group, which share the vectors they need; and the most vectors whose products are all taken at once.
GROUP, SQUARE, STEP = 256, 1024, 1 << 15


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _longs(column: pa.Array) -> np.ndarray:
    """The values as integers of 64 bits, 0 for nulls: without this a null would make doubles of all."""
    return column.fill_null(0).to_numpy(zero_copy_only=False)


class Group:
    """Vectors and histories of a group of queries; histories as a matrix of queries by places, the newest item first."""

    def __init__(self, most: int):
        self.most, self.parts, self.rows, self.open = most, [], [], True

    def close(self) -> None:
        self.open = False
        ids, vecs = zip(*self.parts, strict=True) if self.parts else ((np.empty(0, np.int64),), (np.empty((0, 1)),))
        ids, vecs = np.concatenate(ids), np.concatenate(vecs)
        order = np.argsort(ids)
        self.ids, self.vecs = ids[order], vecs[order]
        self.square = self.vecs @ self.vecs.T if len(ids) <= SQUARE else None
        self.qids = np.concatenate([q for q, *_ in self.rows]) if self.rows else np.empty(0, np.int64)
        self.item, self.gap = np.full((len(self.qids), self.most), -1), np.zeros((len(self.qids), self.most))
        at = 0
        for qids, lens, items, past, gaps in self.rows:
            row = np.repeat(np.arange(len(qids)), lens)
            newest = np.repeat(np.cumsum(lens), lens) - 1 - np.arange(len(row))
            self.item[at + row, newest], self.gap[at + row, newest] = np.where(past, self.place(items), -1), gaps
            at += len(qids)
        order = np.argsort(self.qids)
        self.qids, self.item, self.gap = self.qids[order], self.item[order], self.gap[order]
        self.parts = self.rows = []

    def place(self, items: np.ndarray) -> np.ndarray:
        """Places of the items' vectors, -1 without one."""
        if not len(self.ids):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.ids, items), len(self.ids) - 1)
        return np.where(self.ids[at] == items, at, -1)

    def scores(self, qids: np.ndarray, cands: np.ndarray, there: np.ndarray, sizes: tuple[int, ...], tau: float) -> np.ndarray:
        """Attention of each cell by sizes, 0 without a vector or history."""
        if self.open:
            self.close()
        out = np.zeros((len(sizes), len(qids)))
        own = self.place(cands)
        row = np.minimum(np.searchsorted(self.qids, qids), max(len(self.qids) - 1, 0))
        some = np.flatnonzero(there & (own >= 0) & (self.qids[row] == qids)) if len(self.qids) else np.empty(0, np.int64)
        for a in range(0, len(some), STEP // self.most):
            cells = some[a : a + STEP // self.most]
            c, h = own[cells], self.item[row[cells]]
            known = h >= 0
            if self.square is not None:
                qh = self.square[c[:, None], h]
            else:
                qh = np.einsum("cd,ckd->ck", self.vecs[c], self.vecs[h])
            weight = np.where(known, qh / np.sqrt(self.vecs.shape[1]) - tau * self.gap[row[cells]], -np.inf)
            for i, k in enumerate(sizes):
                top = weight[:, :k].max(1, keepdims=True)
                e = np.exp(weight[:, :k] - np.where(np.isfinite(top), top, 0.0))
                total = e.sum(1)
                out[i, cells] = np.where(total > 0, (e * np.where(known[:, :k], qh[:, :k], 0.0)).sum(1) / np.where(total > 0, total, 1.0), 0.0)
        return out


def _streamed(sizes: tuple[int, ...], tau: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            n = batch.num_rows
            deal, part, kind, qid, item, col = (_longs(batch[c]) for c in ("deal", "part", "kind", "qid", "item", "col"))
            there = batch["item"].is_valid().to_numpy(zero_copy_only=False)
            lens, items = _flat(batch["items"])
            wide, numbers = _flat(batch["numbers"])
            past, items, numbers = items.is_valid().to_numpy(zero_copy_only=False), _longs(items), numbers.to_numpy(zero_copy_only=False)
            ends, tops = np.r_[0, np.cumsum(lens)], np.r_[0, np.cumsum(wide)]
            change = np.flatnonzero((deal[1:] != deal[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            out = []
            for a, b in zip(np.r_[0, change].tolist(), np.r_[change, n].tolist(), strict=True) if n else ():
                now = (int(deal[a]), int(part[a]))
                if now != key:
                    key, group = now, Group(max(sizes))
                mine = numbers[tops[a] : tops[b]]
                if kind[a] == 0:
                    group.parts.append((item[a:b], mine.reshape(b - a, -1)))
                elif kind[a] == 1:
                    group.rows.append((qid[a:b], lens[a:b], items[ends[a] : ends[b]], past[ends[a] : ends[b]], mine))
                else:
                    out.append((qid[a:b], col[a:b], group.scores(qid[a:b], item[a:b], there[a:b], sizes, tau)))
            if out:
                got = np.concatenate([x for *_, x in out], axis=1)
                yield pa.RecordBatch.from_pydict({"qid": np.concatenate([x[0] for x in out]), "col": np.concatenate([x[1] for x in out]).astype(np.int32), **{f"attention_{k}": got[i] for i, k in enumerate(sizes)}})

    return run


def attended(cands: DataFrame, edges: DataFrame, items: DataFrame, sizes: tuple[int, ...], tau: float = 0.1) -> DataFrame:
    """(qid, col, attention_<k>) of every cell: softmax_j(<q, h_j> / sqrt(d) - tau gap_j) over the last k items before the query, value <q, h_j>.

    Queries are dealt out in groups of some ``GROUP`` by source, those of a source with more over several. A group gets each
    vector that it needs once, its histories and its cells, sorted in this order, and streams the cells past them.
    ``items(id, vec)`` have vectors of one length.
    """
    queries = cands.select("qid", "src", "time").distinct()
    hist = history_asof(queries, edges, max(sizes))
    per = queries.groupBy("src").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    deals = F.broadcast(queries.agg(F.greatest(F.ceil(F.count("*") / GROUP), F.lit(1)).alias("deals")))
    where = per.crossJoin(deals).select("src", "parts", F.pmod(F.xxhash64("src"), "deals").alias("deal"))
    dealt = lambda df: df.join(where, "src").withColumn("part", F.pmod(F.xxhash64("qid"), "parts"))
    none = lambda kind: F.lit(None).cast(kind)
    asked = dealt(hist).select("deal", "part", F.lit(1).alias("kind"), "qid", none("long").alias("item"), none("int").alias("col"), "items", F.col("gaps").alias("numbers"))
    cells = dealt(cands.select("qid", "src", "col", "cand")).select("deal", "part", F.lit(2).alias("kind"), "qid", F.col("cand").alias("item"), "col", none("array<long>").alias("items"), none("array<double>").alias("numbers"))
    whole = items.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).select(F.col("id").alias("item"), F.transform("vec", lambda x: x.cast("double")).alias("numbers"))
    needed = cells.select("deal", "part", "item").union(asked.select("deal", "part", F.explode("items"))).distinct()
    vectors = needed.join(whole, "item").select("deal", "part", F.lit(0).alias("kind"), none("long").alias("qid"), "item", none("int").alias("col"), none("array<long>").alias("items"), "numbers")
    rows = vectors.union(asked).union(cells).repartition("deal", "part").sortWithinPartitions("deal", "part", "kind")
    fields = ", ".join(f"attention_{k} double" for k in sizes)
    return rows.mapInArrow(_streamed(sizes, tau), f"qid long, col int, {fields}")
