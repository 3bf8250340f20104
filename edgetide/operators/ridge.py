"""L-3: reconstruction of a source's profile from its items, as item-item ridge regression on blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense_index
from ..functions.tables import written

_BLOCKS = "bi long, bj long, m binary"


def item_places(weights: DataFrame, block: int) -> DataFrame:
    """(dst, bi, r): each item's block and its place in it."""
    return dense_index(weights, "dst").select("dst", F.floor(F.col("idx") / block).alias("bi"), (F.col("idx") % block).cast("int").alias("r"))


def profiles(weights: DataFrame, places: DataFrame) -> DataFrame:
    """(src, bi, xs): a source's weights in one block of items, at most a block's length of them."""
    rows = weights.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(places, "dst")
    return rows.groupBy("src", "bi").agg(F.collect_list(F.struct("r", "w")).alias("xs"))


def _list(column: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = column[k].values
    return own.field("r").to_numpy(), own.field("w").to_numpy()


def _streamed(keys: list[str], block: int, add: Callable[[np.ndarray, pa.RecordBatch, int], None]):
    """One dense block at a time over rows sorted by ``keys``, the first two of which are bi and bj."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["bi", "bj", "m"])

        for part in parts:
            named = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True))
            for k, key in enumerate(named):
                if key != now:
                    if now is not None:
                        yield out()
                    now, total = key, np.zeros((block, block))
                add(total, part, k)
        if now is not None:
            yield out()

    return run


def gram_blocks(xs: DataFrame, block: int, salts: int = 8) -> DataFrame:
    """(bi, bj, m): dense blocks of the Gram matrix of ``profiles``, for bi <= bj.

    Each source gives one row a pair of its blocks. Rows are dealt by (bi, bj, salt of the source), so a pair of blocks that
    everybody has is shared out; a task holds one dense block at a time, and the salts' blocks are added in a second pass.
    """

    def outer(total: np.ndarray, part: pa.RecordBatch, k: int) -> None:
        (ra, wa), (rb, wb) = _list(part.column("xs"), k), _list(part.column("ys"), k)
        total[np.ix_(ra, rb)] += np.outer(wa, wb)

    def added(total: np.ndarray, part: pa.RecordBatch, k: int) -> None:
        total += np.frombuffer(part.column("m")[k].as_buffer()).reshape(block, block)

    keys = ["bi", "bj", "salt"]
    pairs = xs.join(xs.select("src", F.col("bi").alias("bj"), F.col("xs").alias("ys")), "src").where("bi <= bj").withColumn("salt", F.pmod(F.hash("src"), F.lit(salts)))
    parts = pairs.select(*keys, "xs", "ys").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_streamed(keys, block, outer), _BLOCKS)
    return parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_streamed(keys[:2], block, added), _BLOCKS)


def _mapped(fn: Callable[[dict], np.ndarray]):
    """A ``mapInArrow`` function that gives each row (bi, bj) the block that ``fn`` makes of its columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                row = {n: part.column(n)[k].as_py() for n in part.schema.names}
                yield pa.RecordBatch.from_arrays([pa.array([row["bi"]], pa.int64()), pa.array([row["bj"]], pa.int64()), pa.array([np.ascontiguousarray(fn(row)).tobytes()], pa.binary())], names=["bi", "bj", "m"])

    return run


def inverse_blocks(gram: DataFrame, items: int, ridge: float, block: int) -> DataFrame:
    """(bi, bj, m), all of both triangles: the inverse of Gram + ridge, by block Gauss-Jordan steps.

    Step p inverts the one block (p, p) and updates every other block from its own row's and column's block of p: two joins
    on block numbers, no task with more than three blocks, and a written table a step. The matrix is positive
    definite, so no pivoting is needed. Places beyond the last item are an identity of their own.
    """
    shape = (block, block)
    of = lambda x: np.frombuffer(x).reshape(shape)
    count = -(-items // block)

    def full(row: dict) -> np.ndarray:
        m = of(row["m"]) if row["m"] is not None else np.zeros(shape)
        m = m.T if row["turned"] else m
        if row["bi"] == row["bj"]:
            pad = np.arange(block) + row["bi"] * block >= items
            m = m + np.diag(np.where(pad, 1.0, ridge))
        return m

    spark = gram.sparkSession
    grid = spark.range(count).select(F.col("id").alias("bi")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")))
    half = gram.select(F.col("bi").alias("x"), F.col("bj").alias("y"), "m")
    where = (F.least("bi", "bj") == F.col("x")) & (F.greatest("bi", "bj") == F.col("y"))
    now = written(grid.join(half, where, "left").withColumn("turned", F.col("bi") > F.col("bj")).select("bi", "bj", "m", "turned").mapInArrow(_mapped(full), _BLOCKS), "ridge-blocks")
    for p in range(count):
        pivot = now.where((F.col("bi") == p) & (F.col("bj") == p)).mapInArrow(_mapped(lambda row: np.linalg.inv(of(row["m"]))), _BLOCKS)
        held = of(pivot.first()["m"])

        def step(row: dict, p: int = p, held: np.ndarray = held) -> np.ndarray:
            i, j, m = row["bi"], row["bj"], of(row["m"])
            if i == p and j == p:
                return held
            if i == p:
                return held @ m
            if j == p:
                return -m @ held
            return m - of(row["left"]) @ held @ of(row["right"])

        left = now.where(F.col("bj") == p).select("bi", F.col("m").alias("left"))
        right = now.where(F.col("bi") == p).select("bj", F.col("m").alias("right"))
        now = written(now.join(left, "bi").join(right, "bj").mapInArrow(_mapped(step), _BLOCKS), "ridge-blocks")
    return now


def reconstruction_blocks(inverse: DataFrame, block: int) -> DataFrame:
    """(bi, bj, m) of the weights: minus the inverse over its diagonal, by column, and 0 on the diagonal."""
    of = lambda x: np.frombuffer(x).reshape(block, block)

    def scaled(row: dict) -> np.ndarray:
        m = -of(row["m"]) / np.diag(of(row["own"]))
        if row["bi"] == row["bj"]:
            np.fill_diagonal(m, 0.0)
        return m

    own = inverse.where("bi = bj").select("bj", F.col("m").alias("own"))
    return inverse.join(own, "bj").mapInArrow(_mapped(scaled), _BLOCKS)


def fit_profile_ridge(weights: DataFrame, *, ridge: float = 10.0, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """``places`` of the items and ``blocks`` of the weights that give each item of ``weights(src, dst, w)`` from the others.

    The weights minimise the squared error of every source's profile plus ``ridge`` times their squares, none from an item to
    itself; they follow from the inverse of the Gram matrix in closed form.
    """
    places = written(item_places(weights, block), "item-places")
    items = places.count()
    gram = gram_blocks(written(profiles(weights, places), "profiles"), block)
    return places, written(reconstruction_blocks(inverse_blocks(gram, items, ridge, block), block), "ridge-weights")


def _scorer(block: int):
    """The block of weights comes first, then the profiles that ask it for candidates."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            src, at, made = [], [], []
            for k in range(part.num_rows):
                if (m := part.column("m")[k]).is_valid:
                    held = np.frombuffer(m.as_buffer()).reshape(block, block)
                    continue
                (ra, wa), (rb, _) = _list(part.column("xs"), k), _list(part.column("cs"), k)
                src.append(np.full(len(rb), part.column("src")[k].as_py()))
                at.append(part.column("bj")[k].as_py() * block + rb.astype(np.int64))
                made.append(wa @ held[np.ix_(ra, rb)])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (src, at, made)], names=["src", "idx", "part"])

    return run


def ridge_scores(cands: DataFrame, weights: DataFrame, places: DataFrame, blocks: DataFrame, *, block: int = 256, salts: int = 8) -> DataFrame:
    """(qid, col, cand, score): the source's profile times the candidate's column of weights; 0 without either.

    For distinct (source, candidate): each profile block meets each block of candidates of its source at the weights' block,
    whose copies, one a salt, share out the sources; the parts are added by (source, candidate).
    """
    xs = profiles(weights, places)
    asked = cands.select("src", F.col("cand").alias("dst")).distinct().join(places, "dst").groupBy("src", F.col("bi").alias("bj")).agg(F.collect_list(F.struct("r", F.lit(0.0).alias("w"))).alias("cs"))
    keys = ["bi", "bj", "salt"]
    rows = xs.join(asked, "src").select("bi", "bj", F.pmod(F.hash("src"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "src", "xs", "cs", F.lit(None).cast("binary").alias("m"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    held = blocks.select("bi", "bj", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), none("src"), none("xs"), none("cs"), "m")
    parts = rows.union(held).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_scorer(block), "src long, idx long, part double")
    total = parts.groupBy("src", "idx").agg(F.sum("part").alias("score")).join(places.select("dst", (F.col("bi") * block + F.col("r")).alias("idx")), "idx")
    return cands.select("qid", "col", "src", "cand").join(total.select("src", F.col("dst").alias("cand"), "score"), ["src", "cand"], "left").select("qid", "col", "cand", F.coalesce("score", F.lit(0.0)).alias("score"))
