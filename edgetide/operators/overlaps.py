"""Item sets of sources met candidate by candidate, without a row for each common item.

A candidate's member sets and the cells' own sets flow, sorted, through tasks that hold one candidate's member sets and count
in arrays. Cells of a hot candidate are dealt out over blocks, each of which gets the candidate's sets once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a set in one row, cells of a candidate in one block, and numbers in one step of counting.
CHUNK, BLOCK, STEP = 256, 4096, 1 << 21


def item_sets(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, size, items, vals) from distinct ``pairs(k, o)``: the set of each k, in rows of some ``CHUNK`` items; vals are
    the items' weights. A null item counts in the size and is met by nothing."""
    size = pairs.groupBy("k").agg(F.count("*").alias("size"))
    value = F.lit(None).cast("double") if weight is None else F.col(weight).cast("double")
    part = F.when(F.col("size") <= CHUNK, 0).otherwise(F.pmod(F.xxhash64("o"), F.ceil(F.col("size") / CHUNK)))
    rows = pairs.where("o is not null").join(size, "k").groupBy("k", "size", part.alias("part")).agg(F.collect_list(F.struct("o", value.alias("x"))).alias("l"))
    return rows.select(F.col("k").alias("id"), "size", F.col("l.o").alias("items"), (F.lit(None).cast("array<double>") if weight is None else F.col("l.x")).alias("vals"))


class Candidate:
    """Member sets of one candidate as a matrix of items by members, and values of items for it."""

    def __init__(self):
        self.kinds: tuple[list, list] = ([], [])
        self.open = True

    def add(self, kind: int, ids, sizes, lens, items, vals) -> None:
        self.kinds[kind].append((ids, sizes, lens, items, vals))

    def close(self) -> None:
        self.open = False
        joined = [[np.concatenate([part[i] for part in parts]) for i in range(5)] if parts else None for parts in self.kinds]
        self.kinds = ([], [])
        none = np.empty(0, np.int64)
        self.known, self.value = none, np.empty(0)
        if joined[0] is not None:
            order = np.argsort(joined[0][3], kind="stable")
            self.known, self.value = joined[0][3][order], joined[0][4][order]
        self.members, self.sizes, self.items, self.weights = none, none, none, np.empty(0)
        self.has = np.zeros((0, 0), np.uint8)
        if joined[1] is not None:
            ids, sizes, lens, items, vals = joined[1]
            self.members, first, member = np.unique(ids, return_index=True, return_inverse=True)
            self.sizes = sizes[first]
            self.items, at = np.unique(items, return_inverse=True)
            self.has = np.zeros((len(self.items), len(self.members)), np.uint8)
            self.has[at, np.repeat(member, lens)] = 1
            self.weights = np.empty(len(self.items))
            self.weights[at] = vals

    def _found(self, known, run, flat):
        """Places in ``known`` of the items that are there, their runs without repeats, and where these begin."""
        if not len(known) or not len(flat):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        at, run = at[hit], run[hit]
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
        return at, run[begin], begin

    def totals(self, n: int, run, flat) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n sets, the sum and the greatest of its items' values."""
        at, runs, begin = self._found(self.known, run, flat)
        total, most = np.zeros(n), np.zeros(n)
        if len(at):
            total[runs], most[runs] = np.add.reduceat(self.value[at], begin), np.maximum.reduceat(self.value[at], begin)
        return total, most

    def common(self, n: int, run, flat, weighted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each of n sets by members: the number of common items, and the sum of their weights."""
        at, runs, begin = self._found(self.items, run, flat)
        both = np.zeros((n, len(self.members)))
        rare = np.zeros_like(both) if weighted else None
        stop = np.r_[begin[1:], len(at)] if len(at) else begin
        a = 0
        while a < len(runs):
            b = max(a + 1, int(np.searchsorted(stop, begin[a] + STEP // max(1, len(self.members)), "right")))
            rows = self.has[at[begin[a] : stop[b - 1]]].astype(np.float64)
            both[runs[a:b]] = np.add.reduceat(rows, begin[a:b] - begin[a], axis=0)
            if weighted:
                rows *= self.weights[at[begin[a] : stop[b - 1]], None]
                rare[runs[a:b]] = np.add.reduceat(rows, begin[a:b] - begin[a], axis=0)
            a = b
        return both, rare


def _lists(column: pa.ListArray, lens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column; nulls have none, or with ``lens`` values that are not numbers."""
    if lens is not None and column.null_count:
        parts = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid else np.full(n, np.nan) for x, n in zip(column, lens.tolist(), strict=True)] if column.null_count < len(column) else [np.full(int(lens.sum()), np.nan)]
        return lens, np.concatenate(parts) if parts else np.empty(0)
    got = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return got, column.flatten().to_numpy(zero_copy_only=False)


def _streamed(score: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, Candidate(), None

        def scored(cand, ids, sizes, lens, flat):
            begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            runs = np.repeat(np.cumsum(np.r_[False, ids[1:] != ids[:-1]]), lens)
            if state.open:
                state.close()
            cols = score(state, ids[begin], sizes[begin], runs, flat)
            return {"src": ids[begin], "cand": np.full(len(begin), cand), **cols}

        for batch in batches:
            out = []
            cands, blocks, kinds, every, sizes = (batch[c].to_numpy(zero_copy_only=False) for c in ("cand", "block", "kind", "id", "size"))
            lens, items = _lists(batch["items"])
            _, vals = _lists(batch["vals"], lens)
            ends = np.r_[0, np.cumsum(lens)]
            n = len(cands)
            change = np.flatnonzero((cands[1:] != cands[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.r_[0, change].tolist(), np.r_[change, n].tolist(), strict=True) if n else ():
                now, flat = (int(cands[a]), int(blocks[a])), items[ends[a] : ends[b]]
                if now != key:
                    if held is not None:
                        out.append(scored(key[0], *held))
                    key, state, held = now, Candidate(), None
                if kinds[a] < 2:
                    state.add(int(kinds[a]), every[a:b], sizes[a:b], lens[a:b], flat, vals[ends[a] : ends[b]])
                    continue
                rows = [every[a:b], sizes[a:b], lens[a:b], flat]
                if held is not None:
                    rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
                if b == n:
                    cut = int(np.searchsorted(rows[0], rows[0][-1]))
                    at = int(rows[2][:cut].sum())
                    held = [x[cut:] for x in rows[:3]] + [rows[3][at:]]
                    rows = [x[:cut] for x in rows[:3]] + [rows[3][:at]]
                if len(rows[0]):
                    out.append(scored(key[0], *rows))
            if out:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([o[c] for o in out]) for c in out[0]})
        if held is not None:
            yield pa.RecordBatch.from_pydict(scored(key[0], *held))

    return run


def met_by_candidate(cells: DataFrame, own: DataFrame, sets: DataFrame, values: DataFrame | None, score: Callable, fields: str) -> DataFrame:
    """(src, cand, <fields>) of the distinct ``cells(src, cand)`` whose source has a set.

    ``own(id, size, items, vals)`` are ``item_sets``; ``sets`` the same with the candidate that each is a member of, and
    ``values(cand, item, value)`` numbers of items for a candidate. ``score(candidate, ids, sizes, run, flat)`` gives the fields as
    arrays over ids: ``flat`` are the items of all sets, ``run`` the place of the set that each belongs to.
    """
    blocks = cells.groupBy("cand").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    columns = ("cand", "block", "kind", "id", "size", "items", "vals")
    each = lambda df: df.join(blocks, "cand").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = cells.join(blocks, "cand").withColumn("block", F.pmod(F.xxhash64("src"), "blocks")).withColumnRenamed("src", "id").join(own.drop("vals"), "id")
    rows = each(sets).withColumn("kind", F.lit(1)).select(*columns)
    rows = rows.union(dealt.withColumns({"kind": F.lit(2), "vals": F.lit(None).cast("array<double>")}).select(*columns))
    if values is not None:
        one = values.select("cand", F.col("item").alias("id"), F.lit(0).cast("long").alias("size"), F.array("item").alias("items"), F.array(F.col("value").cast("double")).alias("vals"))
        rows = rows.union(each(one).withColumn("kind", F.lit(0)).select(*columns))
    return rows.repartition("cand", "block").sortWithinPartitions("cand", "block", "kind", "id").mapInArrow(_streamed(score), f"src long, cand long, {fields}")
