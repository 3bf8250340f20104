"""What both vector searches share: valid rows, equal vectors, blocks of queries against shards, and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import groups, written


def valid(vectors: DataFrame, value: Column) -> DataFrame:
    """vec_id, v, dim of rows with an id and only finite components; ``value`` makes v from the array ``v``."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0").where(F.forall("v", fine))
    return rows.select("vec_id", value.alias("v"), F.size("v").alias("dim"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, those with the k + 1 smallest ids: no other can be among a query's k best.

    The rank limit is applied in each task before the shuffle, so a vector that a third of all rows
    share moves k + 1 rows a task.
    """
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def pair_up(cands: DataFrame, queries: DataFrame, n_cands: int, n_queries: int, shard_rows: int, query_rows: int, floors: str = "cast(null as double)", home: bool | None = None) -> DataFrame:
    """Rows of (dim, shard, qblock, is_query, vec_id, v, floor), sorted so that each triple is one run.

    Every query block meets every shard (with ``home`` true, each query only one shard of its own, with
    false all but that); shards and blocks have bounded rows, so a task holds one of each whatever the
    table's size.
    """
    shards, blocks = max(1, -(-n_cands // shard_rows)), max(1, -(-n_queries // query_rows))
    hashed = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cands.withColumn("shard", hashed(shards, 1)).withColumn("qblock", every(blocks)).selectExpr("dim", "shard", "qblock", "false is_query", "vec_id", "v", "cast(null as double) floor")
    right = queries.withColumn("shard", hashed(shards, 2) if home else every(shards)).where(F.lit(True) if home is not False else F.col("shard") != hashed(shards, 2)).withColumn("qblock", hashed(blocks, 3)).selectExpr("dim", "shard", "qblock", "true is_query", "vec_id", "v", f"{floors} floor")
    keys = ["dim", "shard", "qblock"]
    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "is_query", "vec_id")


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def searched(paired: DataFrame, search: Search, k: int, score: str) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query from each shard, by ``search`` in the task."""
    whole = score == "long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, ["dim", "shard", "qblock"]):
            dim = g.column("dim")[0].as_py()
            ids = g.column("vec_id").to_numpy()
            v = g.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n = int(np.searchsorted(g.column("is_query").to_numpy(zero_copy_only=False).astype(np.int8), 1))
            if n == 0 or n == len(ids):
                continue
            floor = g.column("floor").to_numpy(zero_copy_only=False)[n:].astype(float)
            out: list[list] = [[], [], []]
            for q, at, s in search(ids[:n], v[:n], ids[n:], v[n:], np.where(np.isnan(floor), -np.inf, floor)):
                best = np.lexsort((ids[at], -s))
                best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])][:k]
                out[0] += [int(ids[n + q])] * len(best)
                out[1] += ids[at[best]].tolist()
                out[2] += s[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64() if whole else pa.float64())], names=["query_id", "vec_id", "score"])

    return paired.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards, ties to the smaller id; a vec_id with several vectors has its best score."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def tables(rows: DataFrame, every: int, k: int, value: Column | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Candidates, queries and their numbers, after repeated rows are dropped; a query is its vec_id's least vector."""
    rows = written(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    cands = written(candidates(rows, k), "candidates")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = written(queries, "queries")
    return cands, queries, cands.count(), queries.count()
