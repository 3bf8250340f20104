"""Small golden inputs: expected results worked out by hand or by brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from edgetide import sources
from edgetide.functions import dense_index
from edgetide.operators import features, fusion, history, metrics, rank, replay, stats, support

EDGES = "src long, dst long, time long, seq long"
ROWS = [(1, 10, 1), (1, 11, 2), (2, 13, 3), (2, 14, 4), (1, 10, 10), (1, 11, 11), (2, 12, 12), (2, 13, 13), (1, 10, 14), (2, 11, 15)]


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGES)


def test_strict_cut_statistics_and_cold_pool(spark):
    e = edges(spark, ROWS)
    h = history.history(e, 10)
    assert h.count() == 4
    assert stats.pair_stats(h).where("src = 1 and dst = 10").first()[2:] == (1, 1, 1)
    assert stats.hot_threshold(stats.src_stats(h), "src_cnt").first()[0] == 2
    assert [r[0] for r in features.cold_pool(h).collect()] == [12]


def test_causal_features_do_not_see_later_edges(spark):
    e = edges(spark, ROWS)
    cells = spark.createDataFrame([(0, 1, 10, 0, 10), (0, 1, 10, 1, 13), (1, 99, 12, 0, 77)], "qid long, src long, time long, col int, cand long")
    one = features.causal_features(cells, history.history(e, 10), 10).orderBy("qid", "col").collect()
    more = features.causal_features(cells, history.history(e.union(spark.createDataFrame([(1, 10, 10, 99)], EDGES)), 10), 10).orderBy("qid", "col").collect()
    assert one == more
    assert [r.pair_seen for r in one] == [1, 0, 0] and one[2].src_recency == 0.0
    with pytest.raises(PySparkException):
        features.causal_features(cells, h := history.history(e, 10), 11).collect() if e else h


def test_asof_history_with_equal_times(spark):
    rows = [(10, 11, 2), (10, 12, 4), (10, 13, 4), (20, 10, 5), (10, 14, 7), (20, 15, 8)]
    q = spark.createDataFrame([(0, 10, 4), (1, 10, 7), (2, 20, 7), (3, 99, 9)], "qid long, src long, time long")
    got = {r.qid: (r["items"], [round(2.718281828459045**g - 1) for g in r.gaps]) for r in features.history_asof(q, edges(spark, rows), 3).collect()}
    assert got == {0: ([11], [2]), 1: ([11, 12, 13], [5, 3, 3]), 2: ([10], [2]), 3: ([], [])}


def test_asof_history_of_unordered_input(spark):
    e = edges(spark, [(2, 100, 5), (1, 101, 3), (2, 102, 1), (1, 103, 2)])
    q = spark.createDataFrame([(0, 2, 6), (1, 1, 3), (2, 1, 2)], "qid long, src long, time long")
    got = {r.qid: r["items"] for r in features.history_asof(q, e, 2).collect()}
    assert got == {0: [102, 100], 1: [103], 2: []}
    assert {r.qid: r["items"] for r in features.history_asof(q, history.history(e, 3), 2).collect()}[0] == [102]


def test_nearest_repeat(spark):
    rows = [(0, 1, 100, 0, 10), (0, 1, 100, 1, 20), (1, 1, 103, 0, 10), (1, 1, 103, 1, 30), (2, 1, 110, 0, 10), (2, 1, 110, 1, 20)]
    cells = spark.createDataFrame(rows, "qid long, src long, time long, col int, cand long")
    got = {(r.qid, r.cand): r.gap for r in support.nearest_repeat(cells).withColumn("gap", F.round(F.exp(1 / F.nullif("repeat", F.lit(0.0)) - 1) - 1)).collect()}
    assert got == {(0, 10): 3, (1, 10): 3, (2, 10): 7, (0, 20): 10, (2, 20): 10, (1, 30): None}


def test_ranks_and_mrr(spark):
    rows = [(q, c, s, c == label) for q, (scores, label) in enumerate([([0.0, 1.0, 0.0], 1), ([0.0, 0.0, 0.0], 2)]) for c, s in enumerate(scores)]
    cells = spark.createDataFrame(rows, "qid long, col int, score double, is_pos boolean")
    got = metrics.ranks(cells)
    assert {r.qid: r["rank"] for r in got.collect()} == {0: 1.0, 1: 3.0}
    m = metrics.mrr(got).first()
    assert round(m.mrr, 6) == 0.666667 and m.top1 == 0.5
    assert {r.qid: r["rank"] for r in metrics.ranks(cells, ties="optimistic").collect()} == {0: 1.0, 1: 1.0}
    assert {r.qid: r["rank"] for r in metrics.ranks(cells, ties="mid").collect()} == {0: 1.0, 1: 2.0}


def test_slot_preserving_reorder(spark):
    rng = random.Random(5)
    rows = [(q, c, float(rng.randint(-2, 2)), rng.random(), int(c == 0 or rng.random() < 0.2)) for q in range(20) for c in range(10)]
    cells = spark.createDataFrame(rows, "qid long, col int, score double, residual double, seen int")
    before = {(r.qid, r.col): r.position for r in rank.strict_slots(cells).collect()}
    assert {(r.qid, r.col): r.position for r in rank.reorder_unseen(cells, "score", "residual", 0.0).collect()} == before
    after = rank.reorder_unseen(cells, "score", "residual", 0.8).collect()
    assert all(r.position == before[r.qid, r.col] for r in after if r.seen)
    for q in range(20):
        assert sorted(r.position for r in after if r.qid == q) == list(range(10))


def test_calibration_permutes_and_bands_add_up(spark):
    rng = random.Random(2)
    rows = [(q, q % 3, 5 * q, c, rng.randint(1, 9)) for q in range(12) for c in range(4)]
    cells = spark.createDataFrame(rows, "qid long, src long, time long, col int, cand long")
    turned = cells.withColumn("col", 3 - F.col("col"))
    key = lambda df, f: {(r.qid, f(r.col)): (round(r.lift, 9), round(r.deviance, 9), round(r.band_0 + r.band_1 + r.band_2, 9)) for r in support.loo_calibration(df, (2, 4)).collect()}
    one = key(cells, lambda c: c)
    assert one == key(turned, lambda c: 3 - c)
    assert all(b == c and (a == 0 or (a > 0) == (b > 0)) for a, b, c in one.values())


def test_calibration_by_hand(spark):
    """Three rows of one source, width 4: an item in two of them, one in all, one alone."""
    rows = [(0, 1, 0, i, c) for i, c in enumerate((7, 8, 1, 2, 3))] + [(1, 1, 5, i, c) for i, c in enumerate((7, 8, 4, 5, 6))] + [(2, 1, 9, i, c) for i, c in enumerate((8, 10, 11, 12, 13))]
    got = {(r.qid, r.cand): r for r in support.loo_calibration(spark.createDataFrame(rows, "qid long, src long, time long, col int, cand long"), (2, 5)).collect()}
    for cand, count in ((7, 2), (8, 3), (1, 1)):
        r, expected = got[0, cand], 4 * 2 * count / 15
        o, e = count - 1 + 0.5, expected + 0.5
        assert r.lift == pytest.approx(math.log(o / e))
        deviance = math.copysign(math.sqrt(max(0.0, 2 * (o * math.log(o / e) - (o - e)))), count - 1 - expected)
        assert r.deviance == pytest.approx(deviance) and (r.band_0, r.band_1, r.band_2) == (0, pytest.approx(deviance), 0)


def test_rows_keep_their_files_order(spark, tmp_path):
    """Files of very different sizes, which Spark packs largest first: rows still go by path, then place."""
    want = []
    for name, n in (("a", 5), ("b", 4000), ("c", 300), ("d", 1)):
        rows = [(len(want) + i, 2, 3, 0) for i in range(n)]
        want += [r[0] for r in rows]
        (tmp_path / f"{name}.csv").write_text("src,dst,time,split\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    got = sources.read_edges(spark, str(tmp_path)).orderBy("seq").select("src").collect()
    assert [r.src for r in got] == want
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r.src for r in sources.read_edges(spark, str(tmp_path)).orderBy("seq").select("src").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_gate_is_open_for_wide_or_unchanged_rows(spark):
    rows = [(0, 0, 1.0, 5.0, 0.9), (0, 1, 0.0, 9.0, 0.9), (1, 0, 1.0, 5.0, 0.1), (1, 1, 0.0, 9.0, 0.1), (2, 0, 1.0, 9.0, 0.1), (2, 1, 0.0, 5.0, 0.1)]
    cells = spark.createDataFrame(rows, "qid long, col int, old double, new double, gate double")
    got = {(r.qid, r.col): r.score for r in fusion.row_gate(cells, "old", "new", "gate", 0.5).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 9.0, (1, 0): 1.0, (1, 1): 0.0, (2, 0): 9.0, (2, 1): 5.0}


def test_matrix_format(spark):
    q = spark.createDataFrame([(0,), (1,)], "qid long")
    good = ",".join(["0.01000000"] * 100)
    bad = {"format": good.replace("0.01000000", "1e-2", 1), "width": good.rsplit(",", 1)[0], "sum": good.replace("0.01000000", "0.02000000", 1)}
    lines = lambda x: spark.createDataFrame([(0, x), (1, good)], "qid long, line string")
    assert sources.validate_matrix(lines(good), q, 100).count() == 0
    for problem, text in bad.items():
        assert [tuple(r) for r in sources.validate_matrix(lines(text), q, 100).collect()] == [(0, problem)]
    assert [tuple(r) for r in sources.validate_matrix(lines(good).where("qid = 0"), q, 100).collect()] == [(1, "missing")]


def test_sources_reject_what_breaks_the_contract(spark, tmp_path):
    for name, text in {"header": "src,dst,when,split\n1,2,3,0\n", "text": "src,dst,time,split\n1,x,3,0\n", "range": "src,dst,time,split\n1,5000000000,3,0\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            sources.read_edges(spark, str(tmp_path / f"{name}.csv")).collect()
    (tmp_path / "ok.csv").write_text("src,dst,time,split\n1,2,3,0\n1,2,9,1\n")
    assert sources.edge_contract(sources.read_edges(spark, str(tmp_path / "ok.csv"))).first().ok


def test_splits_do_not_divide_a_timestamp(spark):
    e = edges(spark, [(1, i, t) for i, t in enumerate([1, 1, 1, 2, 2, 2, 2, 3, 4, 5])])
    parts = history.by_cuts(e, history.timestamp_safe_cuts(e, (0.5, 0.8))).groupBy("time").agg(F.count_distinct("part").alias("n"))
    assert parts.where("n > 1").count() == 0
    assert history.timestamp_safe_cuts(e, (0.5, 0.8)).first()[:] == (2, 4)


def test_dense_index_over_several_buckets(spark):
    ids = [5, 70_000, 3, 200_000, 70_001, 5]
    got = {r.id: r.idx for r in dense_index(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(ids)))}


def test_replay_has_the_positive_once_and_repairs(spark):
    h = edges(spark, [(1, d, 1) for d in (10, 11, 12)])
    t = spark.createDataFrame([(q, 1, 50, 10 + q % 3) for q in range(50)], "qid long, src long, time long, dst long")
    cells = replay.replay_history(t, h, 3, 4)
    assert cells.count() == 150 and replay.validate_groups(cells).count() == 0
    again = replay.replay_history(t, h, 3, 4)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, again.collect()))


def test_windowed_support_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(q, rng.randint(0, 3), rng.randint(0, 200), c, rng.randint(0, 5)) for q in range(40) for c in range(3)]
    times = {q: (rng.randint(0, 3), rng.randint(0, 200)) for q in range(40)}
    rows = [(q, *times[q], c, cand) for q, _, _, c, cand in rows]
    cells = spark.createDataFrame(rows, "qid long, src long, time long, col int, cand long")
    occ = {(q, s, t, cand) for q, s, t, _, cand in rows}
    got = {(r.qid, r.cand): (r.past, r.future) for r in support.directional_support(cells, 30, False).collect()}
    for q, s, t, cand in occ:
        others = [u for p, o, u, x in occ if x == cand and o != s]
        assert got[q, cand] == (sum(t - 30 <= u < t for u in others), sum(t < u <= t + 30 for u in others))
