"""Statistics over a stream of edges: counts by key, popularity in event-time windows, and their results by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_stats(edges: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Count, first and last time by key over ``edges(src, dst, ts, seq)``; a seq delivered twice within the lateness counts once.

    In update mode a batch gives the keys that it changed, each with its totals so far. State is one row a key, as the
    statistics are; the seqs are let go after the lateness.
    """
    rows = edges.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["seq"])
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def stream_popularity(edges: DataFrame, width: str = "7 days", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Count by destination in tumbling or sliding windows. In append mode a window is given once, when the watermark has
    passed its end, and its state is dropped then; complete mode would keep all of it."""
    rows = edges.withWatermark("ts", lateness)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "dst").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "dst", "cnt")


def kept_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch under its own number, in place of what an earlier try left there."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of batches kept in update mode, each key's row of the last batch that changed it."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__row"))
    return newest.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))
