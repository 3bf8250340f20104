"""Normalisation, ranking and row-wise operators inside a query; ties always go to the lower column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Q


def CELL():  # noqa: N802
    return Window.partitionBy("qid", "cand")


def z(col: str | Column, eps_mode: str = "add", window: Window | None = None) -> Column:
    """(x - mean) / deviation in the query, population moments; ``eps_mode`` says how 1e-6 keeps it finite."""
    window = Q() if window is None else window
    x = F.col(col) if isinstance(col, str) else col
    mean, std = F.avg(x).over(window), F.stddev_pop(x).over(window)
    down = {"add": std + 1e-6, "max": F.greatest(std, F.lit(1e-6)), "sqrt": F.sqrt(std * std + 1e-6)}[eps_mode]
    return (x - mean) / down


def qnorm(df: DataFrame, cols: list[str], eps_mode: str = "add") -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols], *(z(c, eps_mode).alias(c) for c in cols))


def rank_pct(df: DataFrame, col: str, ties: str = "column", out: str = "pct") -> DataFrame:
    """Ascending rank in [0, 1]; ``average`` gives equal scores the mean of their ranks."""
    order = Window.partitionBy("qid").orderBy(col, "col")
    rows = df.withColumn("__r", F.row_number().over(order).cast("double"))
    if ties == "average":
        rows = rows.withColumn("__r", F.avg("__r").over(Window.partitionBy("qid", col)))
    return rows.withColumn(out, F.coalesce((F.col("__r") - 1) / F.nullif(F.count("*").over(Q()) - 1, F.lit(0)), F.lit(0.0))).drop("__r")


def query_expand(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every column raw, as a z-score and as a rank."""
    for c in cols:
        df = rank_pct(df, c, out=f"{c}_rank")
    return df.select(*df.columns, *(z(c).alias(f"{c}_z") for c in cols))


def strict_slots(df: DataFrame, col: str = "score") -> DataFrame:
    """position 0 for the best, and slot from 1 down to 0 in equal steps."""
    order = Window.partitionBy("qid").orderBy(F.desc(col), "col")
    rows = df.withColumn("position", F.row_number().over(order) - 1)
    return rows.withColumn("slot", 1.0 - F.coalesce(F.col("position") / F.nullif(F.count("*").over(Q()) - 1, F.lit(0)), F.lit(0.0)))


def softmax(col: str | Column) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    e = F.exp(x - F.max(x).over(Q()))
    return e / F.sum(e).over(Q())


def softmaxed(df: DataFrame, col: str = "score", out: str = "prob") -> DataFrame:
    rows = df.withColumn("__e", F.exp(F.col(col) - F.max(col).over(Q())))
    return rows.withColumn(out, F.col("__e") / F.sum("__e").over(Q())).drop("__e")


def margins(df: DataFrame, col: str = "score") -> DataFrame:
    """from_top: the best minus own; winner_gap: own minus the best of the others; margin: first minus second."""
    order = Window.partitionBy("qid").orderBy(F.desc(col), "col")
    rows = df.withColumn("__r", F.row_number().over(order))
    nth = lambda r: F.max(F.when(F.col("__r") == r, F.col(col))).over(Q())
    second = F.coalesce(nth(2), nth(1))
    other = F.when(F.col("__r") == 1, second).otherwise(nth(1))
    return rows.select(*df.columns, (nth(1) - F.col(col)).alias("from_top"), (F.col(col) - other).alias("winner_gap"), (nth(1) - second).alias("margin"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Per cell whether its id repeats in the row, and whether the row has any repeat."""
    rows = df.withColumn("dup_cell", (F.count("*").over(CELL()) > 1).cast("int"))
    return rows.withColumn("dup_row", F.max("dup_cell").over(Q()))


def canonicalize(df: DataFrame, col: str = "score") -> DataFrame:
    """Repeated ids take the first column's score."""
    first = F.first(col).over(CELL().orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(col, first)


def group_mean(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.avg(col).over(CELL()))


def reorder_unseen(df: DataFrame, score: str, residual: str, alpha: float, seen: str = "seen") -> DataFrame:
    """position: rank by ``score``, in which unseen cells swap their slots by score + alpha * residual; seen ones stay.

    The ranks of the unseen cells by the new key are joined to the unseen slots in order: two row numbers
    over one key and an equi-join.
    """
    base = df.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "col")) - 1)
    mixed = base.withColumn("key", F.col(score) + F.lit(float(alpha)) * F.col(residual))
    part = Window.partitionBy("qid", seen)
    rows = mixed.withColumn("by_key", F.row_number().over(part.orderBy(F.desc("key"), "col"))).withColumn("by_slot", F.row_number().over(part.orderBy("slot")))
    slots = rows.select("qid", F.col(seen), F.col("by_slot").alias("by_key"), F.col("slot").alias("new_slot"))
    out = rows.join(slots, ["qid", seen, "by_key"])
    return out.select(*df.columns, F.when(F.col(seen) == 1, F.col("slot")).otherwise(F.col("new_slot")).alias("position"))


def remap_slots(df: DataFrame, base: str, score: str, fallback: Column | None = None, out: str = "mapped") -> DataFrame:
    """The base's values of the query dealt out in the order of the score; rows under ``fallback`` keep theirs."""
    rows = df.withColumn("__b", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(base), "col"))).withColumn("__s", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "col")))
    values = rows.select("qid", F.col("__b").alias("__s"), F.col(base).alias("__v"))
    mapped = rows.join(values, ["qid", "__s"])
    value = F.col("__v") if fallback is None else F.when(fallback, F.col(base)).otherwise(F.col("__v"))
    return mapped.select(*df.columns, value.alias(out))


def unique_max(df: DataFrame, col: str, among: Column) -> DataFrame:
    """is_unique_max: the one cell of ``among`` with the query's positive maximum; tied_max: all of them, ties: how many."""
    top = F.max(F.when(among, F.col(col))).over(Q())
    hit = among & (F.col(col) == top) & (top > 0)
    rows = df.withColumn("tied_max", F.coalesce(hit, F.lit(False)).cast("int"))
    rows = rows.withColumn("ties", F.sum("tied_max").over(Q()))
    return rows.withColumn("is_unique_max", ((F.col("tied_max") == 1) & (F.col("ties") == 1)).cast("int"))


def new_seen_gap(df: DataFrame, col: str = "score", seen: str = "seen", clip: float = 4.0) -> DataFrame:
    """Per query: best unseen minus best seen, clipped; +clip without seen cells, -clip without unseen; and the seen share."""
    rows = df.groupBy("qid").agg(F.max(F.when(F.col(seen) == 0, F.col(col))).alias("new"), F.max(F.when(F.col(seen) == 1, F.col(col))).alias("old"), F.avg(seen).alias("seen_share"))
    gap = F.when(F.col("old").isNull(), clip).when(F.col("new").isNull(), -clip).otherwise(F.greatest(F.least(F.col("new") - F.col("old"), F.lit(clip)), F.lit(-clip)))
    return rows.select("qid", gap.alias("gap"), "seen_share")


def hard_negatives(df: DataFrame, base: str, graph: str, k: int = 16, k_graph: int = 20) -> DataFrame:
    """hard: the k best unseen by the base, the best by the graph score, and the positive."""
    rows = df.withColumn("__b", F.row_number().over(Window.partitionBy("qid", "seen").orderBy(F.desc(base), "col"))).withColumn("__g", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(graph), "col")))
    hard = ((F.col("seen") == 0) & (F.col("__b") <= k)) | (F.col("__g") <= k_graph) | F.col("is_pos")
    return rows.withColumn("hard", hard.cast("int")).drop("__b", "__g")


def topk(df: DataFrame, k: int, col: str = "score") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(col), "col")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def family_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation over a family of component columns, cell by cell."""
    n = float(len(cols))
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / n
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in cols), F.lit(0.0)) / n
    return df.withColumn("family_mean", mean).withColumn("family_std", F.sqrt(var))
