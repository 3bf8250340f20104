"""Bucketed stores: lookups, pivots and windows that leave the store where it lies."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from edgetide import sources
from edgetide.operators import features, stats
from edgetide.operators.rank import z

BUCKETS = 8


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def tree(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|single)", tree(df)))


def log(spark):
    edges = spark.range(4000).select((F.col("id") % 37).alias("src"), (F.col("id") * 7 % 101).alias("dst"), F.col("id").alias("time"), F.col("id").alias("seq"))
    cands = spark.range(900).select((F.col("id") / 3).cast("long").alias("qid"), (F.col("id") % 40).alias("src"), (F.col("id") + 5000).alias("time"), (F.col("id") % 3).cast("int").alias("col"), (F.col("id") % 110).alias("cand"))
    return edges, cands


def test_store_is_not_shuffled(no_broadcast):
    spark = no_broadcast
    edges, cands = log(spark)
    sources.save_bucketed(stats.pair_stats(edges), "t_pairs", ["src", "dst"], BUCKETS)
    pairs = spark.table("t_pairs").withColumnRenamed("dst", "cand")
    joined = cands.join(pairs, ["src", "cand"], "left")
    assert exchanges(joined) == 1 and "Bucketed: true" in tree(joined)
    assert joined.count() == 900


def test_features_from_stores_equal_those_from_the_log(no_broadcast):
    spark = no_broadcast
    edges, cands = log(spark)
    names = {"f_pairs": (stats.pair_stats(edges), ["src", "dst"]), "f_srcs": (stats.src_stats(edges), ["src"]), "f_dsts": (stats.dst_stats(edges), ["dst"])}
    for name, (df, keys) in names.items():
        sources.save_bucketed(df, name, keys, BUCKETS)
    got = features.stored_features(cands, *(spark.table(n) for n in names), 4000)
    assert exchanges(got) == 3  # the cells alone, by each of the three keys
    want = features.causal_features(cands, edges, 4000)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_scores_are_met_and_normalised_in_place(no_broadcast):
    spark = no_broadcast
    rows = [(q, c, s, p, float(q * c + len(s))) for q in range(50) for c in range(4) for s in ("a", "bb") for p in ("x", "y") if not (s == "bb" and c == 3)]
    long = spark.createDataFrame(rows, "qid long, col int, strategy string, split string, score double")
    sources.save_bucketed(long, "t_scores", ["qid"], BUCKETS, by=["strategy", "split"])
    wide = sources.wide_scores(spark, "t_scores", ["a", "bb"], "y")
    assert exchanges(wide.withColumn("n", z("a"))) == 0
    got = {(r.qid, r.col): (r.a, r.bb) for r in wide.collect()}
    assert got == {(q, c): (q * c + 1.0, None if c == 3 else q * c + 2.0) for q in range(50) for c in range(4)}


def test_empty_and_replaced_stores(spark):
    edges, _ = log(spark)
    sources.save_bucketed(stats.src_stats(edges), "t_again", ["src"], BUCKETS)
    sources.save_bucketed(stats.src_stats(edges.limit(0)), "t_again", ["src"], BUCKETS)
    assert spark.table("t_again").count() == 0


def test_digits_are_those_of_the_sql_engine(spark):
    """Values whose seventh digit is a lone 5: the decimal text rounds some of them otherwise."""
    import duckdb

    from edgetide.plans.catalog import rounded

    values = [n / 1e7 for n in range(5, 400_000, 10)] + [3.0 + n / 1e7 for n in range(5, 400_000, 10)]
    engine = duckdb.connect().execute("SELECT i, round(v, 6) FROM (SELECT unnest(range(len($v))) AS i, unnest($v) AS v) ORDER BY i", {"v": values}).fetchall()
    got = rounded(spark.createDataFrame(list(enumerate(values)), "i long, v double")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in engine]
