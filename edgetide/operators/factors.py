"""L-5: source and item vectors by sampled softmax, as gradient steps over factor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Q, dot, draw
from ..functions.tables import written
from .replay import replay_weighted


def start_vectors(ids: DataFrame, dim: int, seed: int, spread: float = 0.05) -> DataFrame:
    """(id, vec, bias, acc): hashed entries evenly in ±spread * sqrt(3), bias 0 and no squared gradients yet."""
    unit = lambda d: (draw(F.col("id"), d, seed) / F.lit(float(1 << 30)) - 1.0) * (spread * 3**0.5)
    zero = F.transform(F.sequence(F.lit(0), F.lit(dim)), lambda _: F.lit(0.0))
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), unit).alias("vec"), F.lit(0.0).alias("bias"), zero.alias("acc"))


def sampled_cells(edges: DataFrame, pool: DataFrame, negatives: int, seed: int) -> DataFrame:
    """(qid, src, cand, is_pos, log_q): each edge's item and ``negatives`` items of ``pool(dst, w)`` drawn in proportion to w.

    Draws are places in the running total of the weights, met by an equi-join on a grid (the distribution an alias table has,
    without one task that builds it). ``log_q`` is the log of the item's share; an item outside the pool has the least one.
    """
    total = pool.agg(F.sum("w").cast("double").alias("__total"), F.min("w").alias("__least"))
    cells = replay_weighted(edges.select(F.col("seq").alias("qid"), "src", "time", "dst"), pool, negatives + 1, seed)
    shares = cells.join(pool.select(F.col("dst").alias("cand"), "w"), "cand", "left").crossJoin(F.broadcast(total))
    return shares.select("qid", "src", "cand", "is_pos", F.log(F.coalesce("w", "__least") / F.col("__total")).alias("log_q"))


def gradients(cells: DataFrame, users: DataFrame, items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Sums over the cells of d loss / d vector by user and by item (its bias last), as (id, grad array).

    The loss is the softmax cross entropy of each edge's item among its cells, with log q taken off every score. Sums are
    partial before they are shuffled, so a hot item costs one row a task.
    """
    rows = cells.join(users.select(F.col("id").alias("src"), F.col("vec").alias("u")), "src")
    rows = rows.join(items.select(F.col("id").alias("cand"), F.col("vec").alias("v"), F.col("bias").alias("b")), "cand")
    rows = rows.withColumn("s", dot("u", "v") + F.col("b") - F.col("log_q"))
    rows = rows.withColumn("e", F.exp(F.col("s") - F.max("s").over(Q())))
    rows = written(rows.select("src", "cand", "u", "v", (F.col("e") / F.sum("e").over(Q()) - F.col("is_pos").cast("double")).alias("g")), "softmax-cells")
    summed = lambda key, vec: rows.groupBy(F.col(key).alias("id")).agg(*(F.sum(F.col("g") * F.col(vec)[d]).alias(f"d{d}") for d in range(dim)), F.sum("g").alias(f"d{dim}"))
    as_array = lambda df, n: df.select("id", F.array(*(F.col(f"d{d}") for d in range(n))).alias("grad"))
    return as_array(summed("src", "v"), dim), as_array(summed("cand", "u"), dim + 1)


def _moved(table: DataFrame, grad: DataFrame, dim: int, rate: float, decay: float, biased: bool) -> DataFrame:
    """One Adagrad step of the rows that have a gradient; the others stay."""
    rows = table.join(grad, "id", "left")
    own = F.concat("vec", F.array("bias"))
    full = F.when(F.col("grad").isNull(), None).otherwise(F.concat("grad", F.array()) if biased else F.concat("grad", F.array(F.lit(0.0))))
    slope = F.zip_with(full, own, lambda g, x: g + decay * x)
    acc = F.zip_with("acc", slope, lambda a, g: a + g * g)
    step: Column = F.zip_with(own, F.zip_with(slope, acc, lambda g, a: F.when(a > 0, g / F.sqrt(a)).otherwise(0.0)), lambda x, s: x - rate * s)
    kept = F.col("grad").isNull()
    return rows.select("id", F.when(kept, F.col("vec")).otherwise(F.slice(step, 1, dim)).alias("vec"), F.when(kept, F.col("bias")).otherwise(step[dim] if biased else F.col("bias")).alias("bias"), F.when(kept, F.col("acc")).otherwise(acc).alias("acc"))


def fit_sampled_softmax(edges: DataFrame, pool: DataFrame, *, dim: int = 16, negatives: int = 8, blocks: int = 3, epochs: int = 2, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """User and item factors as (id, vec, bias) of ``edges(src, dst, time, seq)`` with negatives from ``pool(dst, w)``.

    An epoch takes the edges in ``blocks`` hashed blocks, another split and other negatives each time; a block is one step:
    its cells meet the factor tables in two joins, gradients are summed by id, and rows with a gradient move (Adagrad).
    Tables are written after each step, so a step's plan is as long as the first's. Items are those of the edges and the pool.
    """
    items = edges.select(F.col("dst").alias("id")).union(pool.select("dst")).distinct()
    users = written(start_vectors(edges.select(F.col("src").alias("id")).distinct(), dim, seed), "user-factors")
    items = written(start_vectors(items, dim, seed + 1), "item-factors")
    for epoch in range(epochs):
        for k in range(blocks):
            step = seed + 101 * (epoch * blocks + k)
            some = edges.where(draw(F.col("seq"), epoch, seed) % blocks == k)
            by_user, by_item = gradients(sampled_cells(some, pool, negatives, step), users, items, dim)
            users, items = written(_moved(users, by_user, dim, rate, decay, False), "user-factors"), written(_moved(items, by_item, dim, rate, decay, True), "item-factors")
    return users.drop("acc"), items.drop("acc")
