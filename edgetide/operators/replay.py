"""Deterministic candidate sets: the positive at a hashed column, the rest drawn by hash from a pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dense_index, draw, drawn_place, in_ranges, running


def slots(targets: DataFrame, width: int, seed: int) -> DataFrame:
    """(qid, src, time, positive, label_col, col) for every column of every target ``(qid, src, time, dst)``."""
    rows = targets.select("qid", "src", "time", F.col("dst").alias("positive"), (draw(F.col("qid"), 777, seed) % width).cast("int").alias("label_col"))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def _done(rows: DataFrame, drawn: Column) -> DataFrame:
    cand = F.when(F.col("col") == F.col("label_col"), F.col("positive")).otherwise(drawn)
    return rows.select("qid", "src", "time", "col", cand.alias("cand"), (F.col("col") == F.col("label_col")).alias("is_pos"))


def _followed(pool: DataFrame, n: Column, *by: str) -> DataFrame:
    """The pool's (by, idx, __a) with __b, the item of the next place, the first after the last: met over items, not over cells."""
    after = pool.select(*by, F.pmod(F.col("idx") - 1, n).alias("idx"), F.col("dst").alias("__b"))
    return pool.select(*by, "idx", F.col("dst").alias("__a")).join(after, [*by, "idx"])


def from_index(rows: DataFrame, pool: DataFrame, n: DataFrame, seed: int, repair: bool = True) -> DataFrame:
    """Cells by index into ``pool(dst, idx)``; a draw equal to the positive moves to the next place of the pool.

    ``n`` is one row with the pool's size; a pool of that one item alone leaves the draw as it is.
    """
    size = F.broadcast(n.select(F.col("n").alias("__n")))
    at = rows.crossJoin(size).withColumn("idx", drawn_place(F.col("qid"), F.col("col"), seed, F.col("__n")))
    if not repair:
        return _done(at.join(pool.select(F.col("dst").alias("__a"), "idx"), "idx", "left"), F.col("__a"))
    got = at.join(_followed(pool.crossJoin(size), F.col("__n")), "idx", "left")
    return _done(got, F.when(F.col("__a") == F.col("positive"), F.col("__b")).otherwise(F.col("__a")))


def sample_groups(targets: DataFrame, edges: DataFrame, width: int, seed: int) -> DataFrame:
    """Negatives from the pool with multiplicity: an edge's destination for each edge; a positive drawn takes the next other item.

    A destination is one interval as long as its count, so no edge is numbered, hot destination or not.
    """
    return replay_weighted(targets, edges.groupBy("dst").agg(F.count("*").alias("w")), width, seed)


def replay_history(targets: DataFrame, hist: DataFrame, width: int, seed: int) -> DataFrame:
    """Uniform over distinct historical destinations."""
    pool = dense_index(hist, "dst")
    return from_index(slots(targets, width, seed), pool, pool.agg(F.count("*").alias("n")), seed)


def replay_history_cold(targets: DataFrame, hist: DataFrame, cold: DataFrame, width: int, seed: int, share: float = 0.15) -> DataFrame:
    """A second hash sends that share of the cells to ids never seen."""
    warm, new = dense_index(hist, "dst"), dense_index(cold, "dst")
    sizes = warm.agg(F.count("*").alias("nw")).crossJoin(F.broadcast(new.agg(F.count("*").alias("nc"))))
    rows = slots(targets, width, seed).crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("is_cold", (draw(F.col("qid"), F.col("col"), seed + 1) % 1000 < int(share * 1000)) & (F.col("nc") > 0))
    rows = rows.withColumn("idx", drawn_place(F.col("qid"), F.col("col"), seed, F.when(F.col("is_cold"), F.col("nc")).otherwise(F.col("nw"))))
    size = F.when(F.col("is_cold"), F.col("nc")).otherwise(F.col("nw"))
    pool = warm.withColumn("is_cold", F.lit(False)).union(new.withColumn("is_cold", F.lit(True))).crossJoin(F.broadcast(sizes))
    found = rows.join(_followed(pool, size, "is_cold"), ["is_cold", "idx"])
    return _done(found, F.when(F.col("__a") == F.col("positive"), F.col("__b")).otherwise(F.col("__a")))


def replay_weighted(targets: DataFrame, weights: DataFrame, width: int, seed: int) -> DataFrame:
    """Draws in proportion to ``weights(dst, w)``: intervals of the running total, found by an equi-join on a grid cell.

    w is a positive integer. The point is a hash below the total; a draw of the positive takes the item whose
    interval follows (the first after the last), which intervals learn from each other before any cell meets them. The grid
    has some four cells an item, and 4096 at least, so a point meets about one and few items still make many keys.
    """
    at = running(in_ranges(weights, "dst", "__range"), "w", ["dst"], F.col("__range"), "low").select("dst", "low", (F.col("low") + F.col("w")).alias("high"))
    total = F.broadcast(weights.agg(F.sum("w").alias("total"), F.count("*").alias("items")))
    step = F.floor(F.col("total") / F.greatest(4 * F.col("items"), F.lit(4096))) + 1
    after = at.select(F.col("low").alias("__from"), F.col("dst").alias("__b"))
    at = at.crossJoin(total).withColumn("__from", F.col("high") % F.col("total")).join(after, "__from")
    grid = at.select(F.col("dst").alias("__a"), "__b", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))).alias("cell"))
    rows = slots(targets, width, seed).crossJoin(total).withColumn("p", drawn_place(F.col("qid"), F.col("col"), seed, F.col("total")))
    found = rows.withColumn("cell", F.floor(F.col("p") / step)).join(grid, "cell").where("low <= p and p < high")
    return _done(found, F.when(F.col("__a") == F.col("positive"), F.col("__b")).otherwise(F.col("__a")))


def popularity_hard_weights(hist: DataFrame) -> DataFrame:
    """Destinations with counts from the 80 % quantile up, weight count^0.75 in thousandths."""
    counts = hist.groupBy("dst").agg(F.count("*").alias("cnt"))
    least = F.broadcast(counts.agg(F.percentile("cnt", 0.8).alias("q")))
    return counts.crossJoin(least).where("cnt >= q").select("dst", F.floor(F.pow("cnt", F.lit(0.75)) * 1000).alias("w"))


def replay_uniform(targets: DataFrame, n: int, width: int, seed: int) -> DataFrame:
    """Ids 1..n by hash alone; a draw may equal the positive."""
    rows = slots(targets, width, seed)
    return _done(rows, (draw(F.col("qid"), F.col("col"), seed) % n + 1).cast("long"))


def replay_rows(targets: DataFrame, queries: DataFrame, seed: int) -> DataFrame:
    """Whole rows: a hashed existing query's candidates (``queries(qid, cands)``) with the positive put in."""
    pool = dense_index(queries.select("qid"), "qid").join(queries.select("qid", "cands"), "qid").select("idx", "cands")
    n = F.broadcast(pool.agg(F.count("*").alias("__n")))
    rows = targets.crossJoin(n).withColumn("idx", drawn_place(F.col("qid"), 5, seed, F.col("__n"))).join(pool, "idx")
    rows = rows.withColumn("label_col", (draw(F.col("qid"), 777, seed) % F.size("cands")).cast("int"))
    put = F.transform("cands", lambda x, i: F.when(i == F.col("label_col"), F.col("dst")).otherwise(x))
    return rows.select("qid", "src", "time", "label_col", put.alias("cands"))


def validate_groups(cands: DataFrame) -> DataFrame:
    """Queries in which the positive does not occur exactly once."""
    pos = cands.groupBy("qid").agg(F.max(F.when(F.col("is_pos"), F.col("cand"))).alias("positive"))
    n = cands.join(pos, "qid").groupBy("qid", "positive").agg(F.count_if(F.col("cand") == F.col("positive")).alias("n"))
    return n.where("n <> 1")
