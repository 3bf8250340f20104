"""Whole queries as arrays: cells are dealt once, then normalised and ranked, all columns at a time, a few queries after the other.

A window sorts the cells anew for each order and carries every column through each of its sorts; an equi-join of wide
frames shuffles both. Here a task sees some whole queries of its sorted share at a time, whatever the size of the share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block of sources that one task takes; a block of more is dealt by query too.
SHARE = 1 << 20


class Cells:
    """Some whole queries, the cells of each in the order of their columns."""

    def __init__(self, qid: np.ndarray):
        self.starts = np.flatnonzero(np.append(True, qid[1:] != qid[:-1]))
        self.sizes = np.diff(np.append(self.starts, len(qid)))
        self.query = np.repeat(np.arange(len(self.starts)), self.sizes)

    def z(self, x: np.ndarray, eps_mode: str = "add") -> np.ndarray:
        """As ``rank.z``; from the query's first value, so that a constant column has no deviation at all."""
        per = self.sizes.reshape(-1, *(1 for _ in x.shape[1:]))
        y = x - x[self.starts][self.query]
        y -= (np.add.reduceat(y, self.starts) / per)[self.query]
        std = np.sqrt(np.add.reduceat(y * y, self.starts) / per)
        return y / (std + 1e-6 if eps_mode == "add" else np.maximum(std, 1e-6))[self.query]

    def top(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, self.starts)[self.query]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Ascending place from 0 within the query, ties by column."""
        order = np.lexsort((x, self.query))
        out = np.empty(len(x), np.int64)
        out[order] = np.arange(len(x)) - self.starts[self.query]
        return out

    def share(self, place: np.ndarray) -> np.ndarray:
        """Places as shares of the last one; 0 for a single cell."""
        return place / np.maximum(self.sizes - 1, 1)[self.query]


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of lists of one length as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def numbers_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of a column of lists, one after the other."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def lists(x: np.ndarray) -> pa.ListArray:
    """Rows as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


def side_by_side(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The cells of kind 1 and of kind 2, which must be the same."""
    kind = numbers(batch, "kind")
    one, two = (batch.filter(pa.array(kind == k)) for k in (1, 2))
    if not all(np.array_equal(numbers(one, c), numbers(two, c)) for c in ("qid", "col")):
        raise ValueError("the frames are not of the same cells")
    return one, two


def whole_queries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by qid, cut anew so that no query is divided."""
    rest = None
    for part in parts:
        if not part.num_rows:
            continue
        part = part if rest is None else pa.concat_batches([rest, part])
        qid = numbers(part, "qid")
        cut = len(qid) - int((qid[::-1] != qid[-1]).argmax()) if qid[0] != qid[-1] else 0
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None:
        yield rest


def by_query(df: DataFrame, fn: Callable[[pa.RecordBatch, Cells], list[np.ndarray]], schema: str) -> DataFrame:
    """``fn`` of some whole queries at a time, their cells sorted by column; one shuffle, one sort.

    Cells of several frames may lie side by side, told apart by ``kind``; the queries are then those of kind 1.
    """
    names, many = [c.split()[0] for c in schema.split(", ")], "kind" in df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_queries(parts):
            qid = numbers(batch, "qid")
            out = fn(batch, Cells(qid[numbers(batch, "kind") == 1] if many else qid))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=names)

    return df.repartition("qid").sortWithinPartitions("qid", "col", *(["kind"] if many else [])).mapInArrow(run, schema)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """(known, cells): all rows that a block's cells look up, the same list for the whole block, and some whole queries of it."""
    known: list[pa.RecordBatch] = []
    rest, at = None, None
    for part in parts:
        n = part.num_rows
        if not n:
            continue
        block, share, cell = numbers(part, "block"), numbers(part, "part"), numbers(part, "kind") > 0
        new = np.append(True, (block[1:] != block[:-1]) | (share[1:] != share[:-1]) | (cell[1:] != cell[:-1]))
        edges = [*np.flatnonzero(new).tolist(), n]
        for i, j in zip(edges, edges[1:]):
            if at != (block[i], share[i]):
                if rest is not None:
                    yield known, rest
                known, rest, at = [], None, (block[i], share[i])
            rows = part.slice(i, j - i)
            if not cell[i]:
                known.append(rows)
                continue
            rows = rows if rest is None else pa.concat_batches([rest, rows])
            cut = int(np.searchsorted(numbers(rows, "qid"), numbers(rows, "qid")[-1]))
            if cut:
                yield known, rows.slice(0, cut)
            rest = rows.slice(cut)
    if rest is not None:
        yield known, rest


def by_source(cells: list[DataFrame], known: list[DataFrame], block: Column, learn: Callable, fn: Callable, schema: str, share: int = SHARE) -> DataFrame:
    """``fn(learned, batch, Cells)`` of some whole queries at a time, with ``learn(batches)`` of what their block of sources knows.

    ``cells(qid, col, src, cand, x)``, of one source a query, and ``known(src, cand, x)`` meet in the block of their source, in one shuffle and no join,
    so that what belongs to a pair is shuffled once a pair, not once a cell. ``x`` are arrays of doubles; cells of several
    frames lie side by side, ``kind`` 1, 2 and so on, and known rows have 0, -1 and so on; these may name their ``block`` and a ``qid`` themselves. A task holds what one block knows.
    Blocks of more than ``share`` cells, of which there are at most as many as shares, are dealt by query too.
    """
    whole = "src is not null and cand is not null"
    count = cells[0].where(whole).groupBy(block.alias("block")).agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    hot = F.broadcast(count.where("parts > 1"))
    columns = ["block", "part", "kind", "qid", "col", "src", "cand", "x"]
    rows = []
    for i, df in enumerate(known):
        df = df.where(whole) if "block" in df.columns else df.where(whole).withColumn("block", block)
        df = (df if "qid" in df.columns else df.withColumn("qid", F.lit(0).cast("long"))).join(hot, "block", "left")
        part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        rows.append(df.select("block", part.alias("part"), F.lit(-i).alias("kind"), "qid", F.lit(0).alias("col"), "src", "cand", "x"))
    for i, df in enumerate(cells, 1):
        df = df.where(whole).withColumn("block", block).join(hot, "block", "left")
        rows.append(df.withColumns({"part": F.pmod(F.hash("qid"), F.coalesce("parts", F.lit(1))), "kind": F.lit(i)}).select(*columns))
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    names, many = [c.split()[0] for c in schema.split(", ")], len(cells) > 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, learned = None, None
        for given, batch in _blocks(parts):
            if given is not last:
                last, learned = given, learn(given)
            first = batch.filter(pa.array(numbers(batch, "kind") == 1)) if many else batch
            out = fn(learned, batch, Cells(numbers(first, "qid")))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=names)

    dealt = union.withColumn("__cell", F.col("kind") > 0).repartition("block", "part").sortWithinPartitions("block", "part", "__cell", "qid", "col", "kind")
    return dealt.drop("__cell").mapInArrow(run, schema)
