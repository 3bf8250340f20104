"""Wide tables against arrays, on hand-made cells with repeated items, unknown ids and a constant column."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from edgetide.functions import at_digits
from edgetide.operators import components, fusion, stats
from edgetide.operators.features import CAUSAL, causal_features

DAY = 86_400


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    edges = [(int(s), int(d), int(t), i) for i, (s, d, t) in enumerate(zip(rng.integers(0, 5, 90), rng.integers(0, 7, 90), np.sort(rng.integers(0, 60 * DAY, 90)), strict=True))]
    cells, qid = [], 0
    for t in np.sort(rng.integers(60 * DAY, 260 * DAY, 30)):
        src = int(rng.choice([0, 1, 2, 9]))
        for col in range(6):
            cells.append((qid, src, int(t), col, int(rng.integers(0, 9)), col == 0))
        qid += 1
    vecs = [(i, [float(x) for x in rng.normal(size=8)], 0.5) for i in range(6)]
    return {
        "edges": spark.createDataFrame(edges, "src long, dst long, time long, seq long"), "cands": spark.createDataFrame(cells, "qid long, src long, time long, col int, cand long, is_pos boolean"),
        "vecs": spark.createDataFrame(vecs, "id long, vec array<double>, bias double"), "raw": (edges, cells, {i: np.array(v) for i, v, _ in vecs}),
    }


def table(log, sizes=(2, 4), dims=(4, 8)):
    causal = causal_features(log["cands"], log["edges"], 60 * DAY)
    return components.component_table(causal, log["edges"], log["edges"], log["vecs"], log["vecs"], sizes, dims)


def test_components_equal_arrays(log):
    edges, cells, vecs = log["raw"]
    got = {(r.qid, r.col): r for r in table(log).collect()}
    assert len(got) == len(cells)
    rows = {}
    for q, s, *_ in cells:
        rows.setdefault(s, set()).add(q)
    activity = np.sort([len(rows[s]) for s in rows for _ in rows[s]])
    cut = [int(np.quantile(activity, x, method="higher")) for x in (0.5, 0.9)]
    for qid, src, time, col, cand, _ in cells:
        r = got[qid, col]
        own = sorted((t, i, d) for s, d, t, i in edges if s == src)
        for k in (2, 4):
            past = [(vecs[d], np.log1p(time - t)) for t, _, d in own[-k:] if d in vecs and cand in vecs]
            qh = np.array([vecs[cand] @ h for h, _ in past])
            e = np.exp(qh / np.sqrt(8) - 0.1 * np.array([g for _, g in past]))
            assert r[f"attention_{k}"] == pytest.approx(float((e * qh).sum() / e.sum()) if past else 0.0)
        for d in (4, 8):
            at = lambda a: float(vecs[a][:d] @ vecs[cand][:d]) if a in vecs and cand in vecs else 0.0  # noqa: B023, E731
            bias = 0.5 if cand in vecs else 0.0
            assert r[f"mf_{d}"] == pytest.approx(at(src) + bias)
            assert r[f"transition_mf_{d}"] == pytest.approx((at(own[-1][2]) if own else 0.0) + bias)
        pool, n = sum(c[4] == cand for c in cells), sum(c[1] == src and c[4] == cand for c in cells)
        share, nr = 5 * pool / len(cells), len(rows[src])
        assert r.pool_frequency == pool and r.pool_source_log == pytest.approx(np.log1p(n))
        assert r.pool_source_excess == pytest.approx((n - share * nr) / np.sqrt(share * nr + 1))
        o, x = n - 1 + 0.5, share * (nr - 1) + 0.5
        dev = np.sign(o - x) * np.sqrt(max(2 * (o * np.log(o / x) - (o - x)), 0))
        assert r.pool_lift == pytest.approx(np.log(o / x)) and r.pool_deviance == pytest.approx(dev)
        band = 0 if nr <= cut[0] else 1 if nr <= cut[1] else 2
        assert [r.pool_deviance_low, r.pool_deviance_mid, r.pool_deviance_high] == pytest.approx([dev if i == band else 0.0 for i in range(3)])


def z(x):
    return (x - x.mean()) / (x.std() + 1e-6)


def test_slices_equal_arrays(spark, log):
    edges, cells, _ = log["raw"]
    models = log["cands"].selectExpr("qid", "col", "cast(cand as double) a", "1.0d b")
    n_items = spark.createDataFrame([(7,)], "n_items long")
    blend = {"a": 0.3, "b": 0.7}
    got = {(r.qid, r.col): r for r in components.slice_features(log["cands"], log["edges"], models, blend, n_items, 60 * DAY).collect()}
    qid, src, time, col, cand = (np.array([c[i] for c in cells]) for i in range(5))
    day = (time - time.min()) // DAY

    def count(*keys):
        k = np.stack(keys)
        return np.array([(k == k[:, [i]]).all(axis=0).sum() for i in range(len(cells))])

    def normed(x):
        out = np.empty(len(cells))
        for q in set(qid):
            out[qid == q] = z(np.asarray(x, float)[qid == q])
        return out

    half = lambda w, *key: (normed(np.log1p(count(*key, day // w))) + normed(np.log1p(count(*key, (day + w // 2) // w)))) / 2
    rolled = lambda b, a: normed(np.log1p([((cand == cand[i]) & (day >= day[i] - b) & (day <= day[i] + a)).sum() for i in range(len(cells))]))
    level = (len(cells) - len(set(qid))) / 7
    last = {d: t for _, d, t, _ in edges}
    trend = lambda n: np.array([sum(np.exp((t - 60 * DAY) / (n * DAY)) for _, d, t, _ in edges if d == c) for c in cand])
    want = {"a": normed(cand), "b": normed(np.ones(len(cells))), "pool_log": normed(np.log1p(count(cand))), "pool_linear": normed(count(cand)), "source_count": normed(count(src, cand)), "pop_log": normed(np.log1p([sum(e[1] == c for e in edges) for c in cand])),
        "freshness": normed([-np.log1p((60 * DAY - last[c]) / DAY) if c in last else -30.0 for c in cand])}
    want |= {f"bucket_{w}": half(w, cand) for w in components.BUCKETS} | {f"source_bucket_{w}": half(w, src, cand) for w in components.SOURCE_BUCKETS}
    want |= {k: rolled(*v) for k, v in components.ROLLING.items()} | {f"pop_{n}": normed(np.log1p(trend(n))) for n in components.POPULARITY}
    want |= {k: normed(np.maximum(count(cand) - level - x * np.sqrt(level), 0)) for k, x in components.EXCESS.items()}
    want["blend"] = normed(0.3 * want["a"] + 0.7 * want["b"] + 0.07 * want["pool_log"])
    assert set(want) == set(components.slice_names(list(blend)))
    for i in range(len(cells)):
        for k, v in want.items():
            assert got[qid[i], col[i]][k] == pytest.approx(v[i], abs=1e-6), k


def test_set_features_equal_arrays(spark, log):
    rows = log["cands"].selectExpr("qid", "col", "cast(cand as double) a", "0 pair_seen", "cand - 2 s")
    got = {(r.qid, r.col): r for r in components.set_features(rows, ["a"], ["s"]).collect()}
    for q in {k[0] for k in got}:
        a = np.array([float(c[4]) for c in log["raw"][1] if c[0] == q])
        order = np.argsort(a, kind="stable")
        at = np.empty(6)
        at[order] = np.linspace(0, 1, 6)
        s = z(np.log1p(np.maximum(a - 2, 0)))
        for i in range(6):
            r = got[q, i]
            assert (r.a_z, r.a_rank, r.a_gap, r.s) == pytest.approx((z(a)[i], at[i], z(a)[i] - z(a).max(), s[i]))


def test_empty_cells_and_history(spark, log):
    none = log["edges"].limit(0)
    assert table(log | {"cands": log["cands"].limit(0)}).count() == 0
    got = table(log | {"edges": none}).collect()
    assert len(got) == len(log["raw"][1]) and all(r.attention_4 == r.transition_count == r.pair_seen_recency == 0 for r in got)
    assert components.set_supports(log["cands"].limit(0)).count() == 0


def test_slices_shuffle_days_once_a_key(log):
    rows = log["cands"].selectExpr("qid", "src", "cand", "time div 86400 as day")
    plan = components._daily(rows, ["cand"], components.BUCKETS, "pool", components.ROLLING)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2


def test_components_are_neither_joined_nor_written(spark, log):
    """sets and meta features equal those of the component table, and no frame of cells is joined or written on the way."""
    names, cands, vecs = components.component_names(), log["cands"].drop("is_pos"), log["vecs"]
    causal = causal_features(cands, log["edges"], 60 * DAY)
    table = components.component_table(causal, log["edges"], log["edges"], vecs, vecs)
    table = table.withColumns({n: at_digits(n, 9) for n in names}).withColumn("base", F.col("pair_seen_recency")).localCheckpoint()
    near = spark.createDataFrame([(1, 5, 2.0), (2, 7, 1.0)], "src long, cand long, n double")
    h = stats.Hierarchy(((2, 2),), (), ())
    static = causal.select("qid", "src", "col", "cand", *CAUSAL)
    given = (cands, log["edges"], log["edges"], vecs, vecs)
    for want, found in (
        (components.set_features(table, [*names, "base"], components.SET_SUPPORTS, components.set_supports(table)), components.component_sets(*given)),
        (fusion.meta_table(h, log["edges"], table.drop("base"), static, "pair_seen_recency", near), fusion.component_meta(h, *given, "pair_seen_recency", near)),
    ):
        assert want.columns == found.columns
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "qid" in x]
        assert not joins
        got = {(r.qid, r.col): tuple(r) for r in found.collect()}
        rows = want.collect()
        assert len(got) == len(rows) == len(log["raw"][1])
        assert all(got[r.qid, r.col] == pytest.approx(tuple(r), abs=2e-3) for r in rows)
