"""Streams in several batches, with rows out of order and late: the batch operators' results, and state that is let go."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgetide import streaming
from edgetide.functions.tables import folder
from edgetide.operators import features
from edgetide.streaming.asof import stream_history_asof

DAY = 86_400
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def batches(rows, late, seed):
    """Rows in order of time moved by up to ``late`` seconds, in files of their own."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[2] + rng.randrange(late))
    return [rows[k::1][: len(rows) // 4 + 1] for k in range(0, len(rows), len(rows) // 4 + 1)]


def put(spark, parts, schema, path):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("time")).drop("time").coalesce(1).write.mode("append").parquet(f"{path}/part={k}")


def test_histories_over_a_stream(spark, rocks):
    rng = random.Random(2)
    edges = [(rng.randrange(3), rng.randrange(9), rng.randrange(8 * DAY), i) for i in range(240)]
    queries = [(q, rng.randrange(4), rng.randrange(8 * DAY)) for q in range(60)]
    end = [(99, 0, 40 * DAY, 10_000)]
    mixed = [(s, d, t, n, 1) for s, d, t, n in edges] + [(s, None, t, q, 0) for q, s, t in queries]
    parts = [*batches(mixed, DAY // 2, 1), [(*e, 1) for e in end]]
    path, out = folder(spark, "asof-in"), folder(spark, "asof-out")
    put(spark, parts, "src long, dst long, time long, seq long, kind int", path)
    read = spark.readStream.schema("src long, dst long, seq long, kind int, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(path)
    found = stream_history_asof(read.where("kind = 1"), read.where("kind = 0").withColumnRenamed("seq", "qid"), 3)
    q = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", folder(spark, "asof-state")).trigger(availableNow=True).start()
    q.awaitTermination(150)
    got = {r.qid: (r.src, r.time, r["items"], [round(g, 9) for g in r.gaps]) for r in spark.read.parquet(out).collect()}
    want = features.history_asof(spark.createDataFrame(queries, "qid long, src long, time long"), spark.createDataFrame(edges, "src long, dst long, time long, seq long"), 3)
    assert got == {r.qid: (r.src, r.time, r["items"], [round(g, 9) for g in r.gaps]) for r in want.collect()}
    assert len([p for p in q.recentProgress if p.numInputRows]) > 3


def test_windows_are_given_once_and_let_go(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3), rng.randrange(4), rng.randrange(20 * DAY), i) for i in range(200)]
    parts = [*batches(edges, DAY // 2, 5), [(0, -1, 60 * DAY, 9999)]]
    path, out = folder(spark, "pop-in"), folder(spark, "pop-out")
    put(spark, parts, "src long, dst long, time long, seq long", path)
    read = spark.readStream.schema("src long, dst long, seq long, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(path)
    popular = streaming.stream_popularity(read, "2 days")
    q = popular.writeStream.outputMode("append").foreachBatch(streaming.kept_batches(out)).option("checkpointLocation", folder(spark, "pop-state")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = spark.read.parquet(out).select(F.unix_timestamp("start").alias("s"), "dst", "cnt").collect()
    want = Counter((t // (2 * DAY) * 2 * DAY, d) for _, d, t, _ in edges)
    assert {(r.s, r.dst): r.cnt for r in got} == want and len(got) == len(want)
    rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    assert rows[-1] <= 1 < max(rows) < len(want)
