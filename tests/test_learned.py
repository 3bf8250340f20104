"""Learned scorers against dense arrays: sampled softmax, boosted trees, ridge reconstruction."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.operators import factors, learn, metrics, replay, ridge, stats, trees
from edgetide.plans import frames

EDGES = "src long, dst long, time long, seq long"


@pytest.fixture(scope="module")
def clustered():
    """Sources of two tastes over 40 items of even popularity."""
    rng = random.Random(3)
    out = []
    for n in range(3000):
        src = rng.randrange(60)
        out.append((src, rng.randrange(20) * 2 + (src % 2 if rng.random() < 0.9 else 1 - src % 2), n, n))
    return out


def test_sampled_softmax_gradient(spark, clustered):
    edges = spark.createDataFrame(clustered[:400], EDGES)
    pool = spark.createDataFrame(list(Counter(e[1] for e in clustered).items()), "dst long, w long")
    users = factors.start_vectors(edges.select(F.col("src").alias("id")).distinct(), 4, 1, 0.5)
    items = factors.start_vectors(pool.select(F.col("dst").alias("id")), 4, 2, 0.5).withColumn("bias", F.col("id") / 100.0)
    cells = factors.sampled_cells(edges, pool, 5, 9).persist()
    by_user, by_item = factors.gradients(cells, users, items, 4)
    u = {r.id: np.array(r.vec) for r in users.collect()}
    v = {r.id: (np.array(r.vec), r.bias) for r in items.collect()}
    per: dict = {}
    for r in cells.collect():
        per.setdefault(r.qid, []).append(r)
    du, dv = {k: np.zeros(4) for k in u}, {k: np.zeros(5) for k in v}
    weight = Counter(e[1] for e in clustered)
    for rows in per.values():
        assert len(rows) == 6 and sum(r.is_pos for r in rows) == 1
        assert all(r.log_q == pytest.approx(math.log(weight[r.cand] / 3000)) for r in rows)
        s = np.array([u[r.src] @ v[r.cand][0] + v[r.cand][1] - r.log_q for r in rows])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        for r, g in zip(rows, p - np.array([r.is_pos for r in rows])):
            du[r.src] += g * v[r.cand][0]
            dv[r.cand] += g * np.append(u[r.src], 1.0)
    assert all(np.allclose(r.grad, du[r.id]) for r in by_user.collect())
    got = {r.id: r.grad for r in by_item.collect()}
    assert all(np.allclose(g, dv[i]) for i, g in got.items()) and all(not dv[i].any() for i in set(dv) - set(got))


def test_sampled_softmax_beats_popularity(spark, clustered):
    edges = spark.createDataFrame(clustered, EDGES)
    pool = edges.groupBy("dst").agg(F.count("*").alias("w"))
    users, items = factors.fit_sampled_softmax(edges, pool, dim=4, negatives=6, blocks=2, epochs=3, rate=0.3)
    cells = replay.replay_history(edges.where("seq % 10 = 0").withColumnRenamed("seq", "qid"), edges, 10, 5)
    fitted = cells.join(users.select(F.col("id").alias("src"), F.col("vec").alias("u")), "src").join(items.select(F.col("id").alias("cand"), F.col("vec").alias("v"), "bias"), "cand")
    by_fit = metrics.mrr(metrics.ranks(fitted.withColumn("score", F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.col("bias"), lambda a, x: a + x)))).first()
    by_pool = metrics.mrr(metrics.ranks(cells.join(pool.withColumnRenamed("dst", "cand"), "cand").withColumn("score", F.col("w").cast("double")))).first()
    assert by_fit.n == by_pool.n == 300 and by_fit.mrr > by_pool.mrr + 0.1


NAMES = ["pair_log_count", "src_log_count", "dst_log_count", "dst_recency", "pair_share_src"]


def test_first_splits_by_brute_force(spark, tables):
    rows = frames.causal(spark, tables)
    forest = trees.fit_trees(rows, NAMES, trees=2, depth=2, bins=8, rate=0.5)
    data = rows.select("qid", "col", "is_pos", *NAMES).toPandas()
    x = np.stack([np.searchsorted(forest.cuts[i], data[c], side="left") for i, c in enumerate(NAMES)], axis=1)
    score = np.zeros(len(data))
    for tree in forest.trees:
        e = np.exp(score - data.assign(s=score).groupby("qid").s.transform("max"))
        p = e / data.assign(e=e).groupby("qid").e.transform("sum")
        g, h = (p - data.is_pos).to_numpy(), (p * (1 - p)).to_numpy()
        node = np.ones(len(data), int)
        for level in range(2):
            for n in range(1 << level, 2 << level):
                at = node == n
                gains = {}
                for f in range(len(NAMES)):
                    for cut in range(x[:, f].max()):
                        left = at & (x[:, f] <= cut)
                        right = at & ~left
                        if h[left].sum() >= 1e-3 and h[right].sum() >= 1e-3:
                            gains[f, cut] = sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + 1)
                if n in tree.splits:
                    assert gains[tree.splits[n]] == pytest.approx(max(gains.values()))
                else:
                    assert not gains or max(gains.values()) < 1e-6
            for n, (f, cut) in tree.splits.items():
                if n >> level == 1:
                    node = np.where(node == n, 2 * n + (x[:, f] > cut), node)
        want = {n: -0.5 * g[node == n].sum() / (h[node == n].sum() + 1) for n in set(node.tolist())}
        assert tree.leaves == pytest.approx(want)
        score += np.array([want[n] for n in node.tolist()])
    got = trees.score_trees(forest, rows).select("qid", "col", "score").toPandas().sort_values(["qid", "col"])
    assert np.allclose(got.score.to_numpy(), data.assign(s=score).sort_values(["qid", "col"]).s.to_numpy())


def test_trees_hold_what_a_line_cannot(spark):
    """The positive is the candidate in the middle of one feature: no linear ranker finds it."""
    rng = random.Random(4)
    rows = []
    for q in range(400):
        pos = rng.randrange(6)
        for col in range(6):
            v = rng.uniform(0.4, 0.6) if col == pos else rng.choice([rng.uniform(0, 0.4), rng.uniform(0.6, 1)])
            rows.append((q, col, col == pos, v, rng.random(), None if col == 3 else 1.0))
    df = spark.createDataFrame(rows, "qid long, col int, is_pos boolean, a double, b double, c double")
    train, test = df.where("qid % 2 = 0"), df.where("qid % 2 = 1")
    tree = metrics.mrr(metrics.ranks(trees.score_trees(trees.fit_trees(train, ["a", "b", "c"], trees=4, depth=3), test))).first().mrr
    line = metrics.mrr(metrics.ranks(learn.score_listwise(test, ["a", "b"], learn.fit_listwise(train, ["a", "b"])))).first().mrr
    assert tree > 0.9 > line + 0.2


def test_trees_not_below_the_linear_ranker(spark, tables):
    rows = frames.causal(spark, tables)
    train, test = rows.where("qid % 2 = 0"), rows.where("qid % 2 = 1")
    mrr = lambda df: metrics.mrr(metrics.ranks(df)).first().mrr
    assert mrr(trees.score_trees(trees.fit_trees(train, NAMES, rate=0.1), test)) >= mrr(learn.score_listwise(test, NAMES, learn.fit_listwise(train, NAMES))) - 0.01
    assert trees.score_trees(trees.fit_trees(train.limit(0), NAMES, trees=1), test).agg(F.max(F.abs("score"))).first()[0] == 0


@pytest.mark.parametrize("block", [16, 128])
def test_ridge_equals_a_dense_solve(spark, tables, block):
    weights = stats.user_item_weights(frames.hist(spark, tables), frames.ORIGIN, 30.0 * frames.history.DAY)
    data = weights.collect()
    users, items = sorted({r.src for r in data}), sorted({r.dst for r in data})
    x = np.zeros((len(users), len(items)))
    for r in data:
        x[users.index(r.src), items.index(r.dst)] += r.w
    inv = np.linalg.inv(x.T @ x + 10.0 * np.eye(len(items)))
    b = -inv / np.diag(inv)
    np.fill_diagonal(b, 0.0)
    places, blocks = ridge.fit_profile_ridge(weights, ridge=10.0, block=block)
    at = {r.bi * block + r.r: items.index(r.dst) for r in places.collect()}
    got = np.zeros((len(items), len(items)))
    for r in blocks.collect():
        m = np.frombuffer(r.m).reshape(block, block)
        for i in range(block):
            for j in range(block):
                p, q = at.get(r.bi * block + i), at.get(r.bj * block + j)
                if p is not None and q is not None:
                    got[p, q] = m[i, j]
    assert np.allclose(got, b, atol=1e-9)
    cells = frames.cands(spark, tables)
    dense = x @ b
    for r in ridge.ridge_scores(cells, weights, places, blocks, block=block).join(cells.select("qid", "col", "src"), ["qid", "col"]).collect():
        want = dense[users.index(r.src), items.index(r.cand)] if r.src in users and r.cand in items else 0.0
        assert r.score == pytest.approx(want, abs=1e-9)
