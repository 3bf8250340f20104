"""Queries as arrays: the same results as windows, in one shuffle of narrow cells."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgetide.operators import arrays, components, fusion, graph, rank, stats, support, tuning

CELLS = "qid long, src long, time long, col int, cand long"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-9, 40), rng.randrange(60), rng.randrange(90_000), i) for i in range(500)]
    cells = [(q, s, 90_000 + q, c, rng.randrange(70)) for q in range(60) for s in [3 if q % 2 else rng.randrange(-9, 50)] for c in range(1 + q % 5)]
    return spark.createDataFrame(edges, "src long, dst long, time long, seq long"), spark.createDataFrame(cells, CELLS), cells


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hierarchy_meets_cells_without_windows(log):
    assert "Window" not in plan(stats.hierarchy_features(log[0], log[1]))


@pytest.mark.parametrize("share", [7, 1 << 20])
def test_hot_blocks_are_dealt_by_query(spark, log, monkeypatch, share):
    monkeypatch.setattr(arrays.by_source, "__defaults__", (share,))
    shift, levels = (1, 2), ((1, 2), (3, 2), (2, 4))
    got = {(r.qid, r.col): tuple(r)[3:] for r in stats.hierarchy_features(log[0], log[1], levels, ((2, 4),), (40_000,), share == 7).collect()}
    assert len(got) == len(log[2]) and shift == stats.Hierarchy(levels, ((2, 4),), (40_000,)).shift
    edges = [tuple(r) for r in log[0].collect()]
    end = max(e[2] for e in edges)
    kept = [(a, b, None) for a, b in levels] + [(2, 4, 40_000)]

    def raw(src, cand):
        out = []
        for a, b, w in kept:
            e = [(s >> a, d >> b) for s, d, t, _ in edges if w is None or t > end - w]
            both, s, d = e.count((src >> a, cand >> b)), sum(x == src >> a for x, _ in e), sum(y == cand >> b for _, y in e)
            out += [np.log1p(both), np.log(both + 0.25) + np.log(len(e) + 1.0) - np.log(s + 1.0) - np.log(d + 1.0)]
        return out

    for q in range(60):
        x = np.array([raw(c[1], c[4]) for c in log[2] if c[0] == q])
        want = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
        assert np.array([got[q, c] for c in range(len(x))]) == pytest.approx(want, abs=1e-8)


def test_whole_queries_over_batches(spark, log):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = log[1].select("qid", "col", "cand")
        fn = lambda b, c: [arrays.numbers(b, "qid"), arrays.numbers(b, "col"), c.z(arrays.numbers(b, "cand").astype(float)), c.share(c.place(arrays.numbers(b, "cand")))]
        got = {(r.qid, r.col): (r.z, r.pct) for r in arrays.by_query(df, fn, "qid long, col int, z double, pct double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rank.rank_pct(df.withColumn("z", rank.z("cand")), "cand").collect()
    assert len(got) == len(want) and all(got[r.qid, r.col] == pytest.approx((r.z, r.pct), abs=1e-6) for r in want)


def test_supports_join_nothing_back(log):
    """cells are dealt once by item and bucket, not joined to counts of theirs."""
    got = support.windowed_support(log[1], {"near": (-30, 30)}, False)
    assert "Join" not in plan(got)
    rows = {(q, s, t, c) for q, s, t, _, c in log[2]}
    want = {(q, c): sum(c2 == c and s2 != s and abs(t - t2) <= 30 for _, s2, t2, c2 in rows) for q, s, t, c in rows}
    assert {(r.qid, r.cand): r.near for r in got.collect()} == want


def test_sets_and_meta_have_no_windows(spark, log):
    """no window and no join of cells, and 0 for pairs without neighbours."""
    cells = log[1].selectExpr("*", "0 pair_seen", "cast(cand as double) a", "cand % 3 s")
    assert "Window" not in plan(components.set_features(cells, ["a"], ["s"]))
    assert components.set_features(cells, ["a"], ["s"], cells.select("qid", "col", "s")).count() == len(log[2])
    near = spark.createDataFrame([(3, 5, 2.0), (3, 7, 1.0)], "src long, cand long, n double")
    h = stats.Hierarchy(((1, 2),), (), ())
    got = fusion.meta_table(h, log[0], cells.select("qid", "src", "time", "col", "cand", "pair_seen", "a"), cells.select("qid", "src", "col", "cand", F.col("a").alias("b")), "a", near)
    assert "Window" not in plan(got) and "qid" not in "".join(x for x in plan(got).splitlines() if "Join" in x)
    want = cells.join(near, ["src", "cand"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    want = want.select("qid", "col", rank.z("n", "max").alias("n"), rank.z("a", "max").alias("a"), (1 - (F.row_number().over(W.partitionBy("qid").orderBy(F.desc("a"), "col")) - 1) / F.greatest(F.count("*").over(W.partitionBy("qid")) - 1, F.lit(1))).alias("slot"))
    got = {(r.qid, r.col): (r.neighbor_n, r.component_a, r.static_b, r.rank_slot) for r in got.collect()}
    assert all(got[r.qid, r.col] == pytest.approx((r.n, r.a, r.a, r.slot), abs=1e-9) for r in want.collect())


def test_slices_take_models_with_the_cells(spark, log):
    """models that lie with the cells are not joined to them."""
    cells = log[1].withColumn("a", F.col("cand").cast("double"))
    n = spark.createDataFrame([(60,)], "n_items long")
    one = components.slice_features(cells, log[0], None, {"a": 1.0}, n, 90_000)
    two = components.slice_features(log[1], log[0], cells.select("qid", "col", "a"), {"a": 1.0}, n, 90_000)
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == len(log[2])


def test_weights_compare_at_twelve_digits(spark):
    """equal but for the last bit is equal, as in the SQL; queries without a positive take no part."""
    rows = spark.createDataFrame([(1, 0, True, 0.3), (1, 1, False, 0.1 + 0.2), (1, 2, False, 0.0), (2, 0, False, 1.0)], "qid long, col int, is_pos boolean, a double").withColumn("b", F.col("a"))
    got = fusion.tune_weight(rows, "a", "b", 2)
    assert [tuple(r) for r in got.collect()] == [(0.0, 1.0), (0.5, 1.0), (1.0, 1.0)]


def test_supports_keep_columns(log):
    """the score goes with the cells instead of being joined to them again."""
    got = support.source_support(log[1].withColumn("score", F.lit(1.0)), "score")
    assert plan(got).split("== Initial Plan ==")[-1].count("Join") == 1 and got.where("score = 1").count() == len(log[2])


def test_base_features_look_up_pairs(log, monkeypatch):
    """statistics meet distinct pairs, not cells."""
    real, seen = graph._activity, []
    monkeypatch.setattr(graph, "_activity", lambda c, h: (seen.append(c.columns), real(c, h))[1])
    assert graph.base_features(log[1], log[0]).count() == len(log[2]) and "qid" not in seen[0]


def test_policies_count_in_arrays(spark, monkeypatch):
    """no row for each query and point of the grid."""

    def never(*_):
        raise AssertionError("a point by itself")

    for name in ("filter", "posexplode", "transform"):
        monkeypatch.setattr(F, name, never)
    rows = [(q, c, c == q % 4, (q + c) % 2, float((q * 7 + c * 3) % 5), float((q + c * c) % 3), float(c)) for q in range(30) for c in range(4)]
    df = spark.createDataFrame(rows, "qid long, col int, is_pos boolean, seen int, s double, a double, b double")
    assert tuning.tune_policy(df, "s", "a", "b").count() == 5
    assert [r.mrr for r in tuning.tune_policy(df.where("qid < 0"), "s", "a", "b").collect()] == [0.0] * 5


def test_slices_take_factors_without_components(spark, log):
    """models that are products of factors come from vectors a block, equal to those of the component table; cells carry no item's columns."""
    rng = random.Random(7)
    vecs = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0.25) for i in range(0, 60, 2)], "id long, vec array<double>, bias double")
    blend, n = {"mf_4": 0.5, "mf_8": 0.5}, spark.createDataFrame([(60,)], "n_items long")
    pairs = components.pair_components(log[1].select("src", "cand").distinct(), log[0], vecs, vecs, (4, 8)).select("src", "cand", "mf_4", "mf_8")
    models = log[1].join(pairs, ["src", "cand"]).select("qid", "col", "mf_4", "mf_8")
    want = {(r.qid, r.col): tuple(r) for r in components.slice_features(log[1], log[0], models, blend, n, 90_000).collect()}
    found = components.slice_features(log[1], log[0], None, blend, n, 90_000, factors=(vecs, vecs))
    got = {(r.qid, r.col): tuple(r) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == len(log[2])
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)
