"""History cuts, time splits, vocabularies and deterministic samples of ``edges(src, dst, time, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DAY, dense_index, draw, running


def history(edges: DataFrame, cutoff: int) -> DataFrame:
    """Strictly before the cutoff; the comparison reaches the scan."""
    return edges.where(F.col("time") < cutoff)


def time_slice(edges: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(history before start, targets in [start, end))."""
    return edges.where(F.col("time") < start), edges.where((F.col("time") >= start) & (F.col("time") < end))


def placed(edges: DataFrame) -> DataFrame:
    """``place``: rank from 0 in (time, seq) order, by day buckets; ``total``: all edges."""
    rows = running(edges.withColumn("one", F.lit(1)), "one", ["time", "seq"], F.floor(F.col("time") / DAY), "place").drop("one")
    return rows.crossJoin(F.broadcast(edges.agg(F.count("*").alias("total"))))


def split_edges(edges: DataFrame, share: float = 0.8) -> DataFrame:
    """part: history, train or valid: a share of all, then the share of the rest, in (time, seq) order."""
    rows = placed(edges)
    first = F.floor(F.col("total") * share)
    second = first + F.floor((F.col("total") - first) * share)
    return rows.withColumn("part", F.when(F.col("place") < first, "history").when(F.col("place") < second, "train").otherwise("valid")).drop("place", "total")


def segments(edges: DataFrame, shares: tuple[float, ...] = (0.5, 0.1, 0.15, 0.1, 0.15)) -> DataFrame:
    """segment: 0..n-1 in (time, seq) order, ends at the half-even rounded cumulative shares."""
    rows, at, number = placed(edges), 0.0, F.lit(0)
    for s in shares[:-1]:
        at += s
        number = number + F.when(F.col("place") >= F.rint(F.col("total") * round(at, 10)), 1).otherwise(0)
    return rows.withColumn("segment", number).drop("place", "total")


def segment_history(segmented: DataFrame, segment: int) -> DataFrame:
    return segmented.where(F.col("segment") < segment)


def timestamp_safe_cuts(edges: DataFrame, shares: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """One row (cut_1, cut_2): first times of the second and third part, so that no timestamp is divided.

    The wanted row's timestamp itself starts the later part (left edge), unless that would leave the part
    before without any row; then the next timestamp does.
    """
    counts = edges.groupBy("time").agg(F.count("*").alias("n"))
    at = running(counts, "n", ["time"], F.floor(F.col("time") / DAY), "before")
    total = F.broadcast(edges.agg(F.count("*").alias("total"), F.min("time").alias("least")))
    rows = at.crossJoin(total)
    wanted = [F.floor(F.col("total") * s) for s in shares]
    holds = [(F.col("before") <= w) & (w < F.col("before") + F.col("n")) & (F.col("time") > F.col("least")) for w in wanted]
    cuts = [F.coalesce(F.min(F.when(h, F.col("time"))), F.min(F.when(F.col("time") > F.col("least"), F.col("time")))) for h in holds]
    return rows.agg(cuts[0].alias("cut_1"), cuts[1].alias("cut_2"))


def by_cuts(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """part 0, 1 or 2 by a one-row frame of cuts."""
    part = F.when(F.col("time") < F.col("cut_1"), 0).when(F.col("time") < F.col("cut_2"), 1).otherwise(2)
    return edges.crossJoin(F.broadcast(cuts)).withColumn("part", part).drop("cut_1", "cut_2")


def vocabulary(hist: DataFrame, mode: str = "bipartite") -> DataFrame:
    """(side, id, idx) with idx from 1; 0 is left for unknown ids. ``shared``: one space for both sides."""
    if mode == "shared":
        both = hist.select(F.col("src").alias("id")).union(hist.select(F.col("dst").alias("id")))
        return dense_index(both, "id").select(F.lit("both").alias("side"), "id", (F.col("idx") + 1).alias("idx"))
    sides = [dense_index(hist.select(F.col(c).alias("id")), "id").select(F.lit(c).alias("side"), "id", (F.col("idx") + 1).alias("idx")) for c in ("src", "dst")]
    return sides[0].union(sides[1])


def encode(rows: DataFrame, vocab: DataFrame, col: str, side: str) -> DataFrame:
    """``<col>_idx``: the place in the vocabulary, 0 for unknown."""
    own = vocab.where(F.col("side") == side).select(F.col("id").alias(col), F.col("idx").alias("__idx"))
    return rows.join(own, col, "left").withColumn(f"{col}_idx", F.coalesce("__idx", F.lit(0)).cast("long")).drop("__idx")


def sample_targets(edges: DataFrame, n: int, seed: int, key: str = "seq") -> DataFrame:
    """The n rows with the least hash of their key; ``orderBy().limit`` keeps n rows a task."""
    return edges.withColumn("__h", draw(F.col(key), 0, seed)).orderBy("__h", key).limit(n).drop("__h")


def history_boundary(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: last training time, first query time, and whether queries strictly follow."""
    a = edges.agg(F.max("time").alias("last_train"))
    b = queries.agg(F.min("time").alias("first_query"))
    return a.crossJoin(F.broadcast(b)).withColumn("ok", F.col("last_train") < F.col("first_query"))


def decay(time: Column, origin: int, scale: float) -> Column:
    return F.exp((time - F.lit(origin)) / F.lit(float(scale)))
