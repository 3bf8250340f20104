"""Ids spread over 64 bits: hashed draws, dense places and replay; audits that find what was planted."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from edgetide.functions import dense_index, draw, drawn_place, in_ranges
from edgetide.operators import learn, metrics, replay
from edgetide.plans import catalog, frames, score_catalog  # noqa: F401

EXTREME = [0, 1, 2**31 - 1, 2**31, 2**33 + 5, 2**62 + 12345, 2**63 - 1, -1, -(2**33) - 7, -(2**63)]


def drawn(a, b, seed):
    low, high = a % 2**31, (a >> 31) % 2**31
    return (low * 1103515245 + high * 69069 + b % 2**31 * 12345 + seed * 2654435) % 2**31 * 48271 % (2**31 - 1)


def test_draws_take_any_long(spark):
    df = spark.createDataFrame([(a, b) for a in EXTREME for b in EXTREME], "a long, b long")
    for r in df.select("a", "b", draw(F.col("a"), F.col("b"), 3).alias("d"), drawn_place(F.col("a"), F.col("b"), 3, F.lit(10**12)).alias("p"), drawn_place(F.col("a"), F.col("b"), 3, F.lit(1000)).alias("q")).collect():
        assert r.d == drawn(r.a, r.b, 3) and 0 <= r.p < 10**12 and r.q == r.d % 1000
    far = df.select(F.max(drawn_place(F.col("a"), F.col("b"), 3, F.lit(10**12)))).first()[0]
    assert far > 2**32


def hashed(n, seed=4):
    rng = random.Random(seed)
    return [rng.getrandbits(62) * rng.choice([1, 1, 1, -1]) for _ in range(n)]


def test_dense_places_of_sparse_ids(spark):
    ids = hashed(5000) + [2**63 - 1, -(2**63)] + [7] * 3000
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long").repartition(6)
    assert {r.id: r.idx for r in dense_index(df, "id").collect()} == {x: k for k, x in enumerate(sorted(set(ids)))}
    spread = in_ranges(df.where("id is not null").distinct(), "id", "part").groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("part").collect()
    assert len(spread) > 200 and max(r.n for r in spread) < 60
    assert all(x.b < y.a for x, y in zip(spread, spread[1:]))
    assert dense_index(df.limit(0), "id").count() == 0


def test_replay_of_hashed_ids(spark):
    rng = random.Random(6)
    users, items = hashed(40, 1), sorted(set(hashed(200, 2)))
    hot = items[17]
    edges = [(rng.choice(users), hot if rng.random() < 0.5 else rng.choice(items), t, (t % 3) * 2**33 + t) for t in range(2000)]
    hist = spark.createDataFrame(edges[:1500], "src long, dst long, time long, seq long")
    targets = spark.createDataFrame([(q, s, t, d) for s, d, t, q in edges[1500:]], "qid long, src long, time long, dst long")
    pool = sorted({e[1] for e in edges[:1500]})
    for r in replay.replay_history(targets, hist, 8, 1).collect():
        if not r.is_pos:
            assert r.cand == pool[drawn(r.qid, r.col, 1) % len(pool)] or r.cand == pool[(drawn(r.qid, r.col, 1) + 1) % len(pool)]
    flat = sorted(e[1] for e in edges[:1500])
    positive = {q: d for s, d, t, q in edges[1500:]}
    ends = {d: max(i for i, x in enumerate(flat) if x == d) + 1 for d in set(flat)}
    got = replay.sample_groups(targets, hist, 8, 1).collect()
    for r in got:
        if not r.is_pos:
            first = flat[drawn(r.qid, r.col, 1) % 1500]
            assert r.cand == (flat[ends[first] % 1500] if first == positive[r.qid] else first)
    assert len(got) == 500 * 8 and sum(r.is_pos for r in got) == 500


def test_audits_find_what_was_planted(spark, tables):
    run = lambda name: catalog.QUERIES[name](spark, tables).collect()
    assert all(r.ok for r in run("e8_leakage_audit"))
    assert [r.block for r in run("e8_leakage_late_cut") if not r.ok] == [2]
    assert all(r.ok and r.n for r in run("e8_perturbation_frozen"))
    assert all(not r.ok and r.changed for r in run("e8_perturbation_leak"))
    whole, broken = run("e7_order_preserved")[0], run("e7_order_broken")[0]
    assert whole.n == whole.kept and 0 < broken.kept < broken.n
    assert run("e9_permutation_check")[0].changed == 0 and run("e9_permutation_by_column")[0].changed > 0


@pytest.mark.parametrize("by_column", [False, True])
def test_a_learned_scorer_under_permutations(spark, tables, by_column):
    rows, names = frames.causal(spark, tables), ["pair_log_count", "dst_log_count", "pair_recency"]
    weights = learn.fit_listwise(rows, names, steps=3)
    score = lambda df: learn.score_listwise(df, names, weights).withColumn("score", F.col("score") + (F.col("col") * 1e-3 if by_column else 0.0))
    r = metrics.permutation_check(rows, score).first()
    assert (r.changed > 0) == by_column and r.cells == rows.count()
