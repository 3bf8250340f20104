"""Sets met candidate by candidate: against plain sets, over blocks and chunks, and without a row for each pair of sources."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from edgetide.operators import graph, overlaps

EDGES = "src long, dst long, time long, seq long"
CELLS = "qid long, src long, time long, col int, cand long"


def _made(df):
    """The most rows that any join of the executed plan made."""
    df.collect()
    most = [0]

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and metric.isDefined():
            most[0] = max(most[0], metric.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return most[0]


@pytest.mark.parametrize(("chunk", "block"), [(256, 4096), (3, 2)])
def test_similarities_and_overlaps_equal_plain_sets(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(overlaps, "CHUNK", chunk)
    monkeypatch.setattr(overlaps, "BLOCK", block)
    rng = random.Random(5)
    edges = [(rng.randrange(30), None if rng.random() < 0.02 else rng.randrange(20), n, n) for n in range(400)]
    cells = [(q, rng.randrange(32), 0, c, rng.randrange(22)) for q in range(40) for c in range(5)]
    hist, cands = spark.createDataFrame(edges, EDGES), spark.createDataFrame(cells, CELLS)
    sets, last = defaultdict(set), {}
    for s, d, t, _ in edges:
        sets[s].add(d)
        last[s, d] = t
    latest = {v: sorted((s for s in sets if v in sets[s]), key=lambda s: (-last[s, v], s))[:4] for v in range(22)}
    wide = {v: sum(v in x for x in sets.values()) for v in range(22)}
    got = {(r.qid, r.col): r for r in graph.neighbor_similarity(cands, hist, 4).collect()}
    assert len(got) == len(cells)
    for q, u, _, col, v in cells:
        met = []
        for n in latest[v]:
            both = (sets[u] & sets[n]) - {None}
            if n != u and both:
                met.append((len(both) / math.sqrt(len(sets[u]) * len(sets[n])), len(both) / (len(sets[u]) + len(sets[n]) - len(both)), sum(1 / math.sqrt(wide[w] + 1) for w in both), len(both) >= 2))
        cos = sorted((m[0] for m in met), reverse=True)
        want = (max(cos, default=0), max((m[1] for m in met), default=0), sum(cos[:3]), max((m[2] for m in met), default=0), math.log1p(sum(m[3] for m in met)))
        assert tuple(got[q, col][c] for c in ("max_cos", "max_jac", "top3", "max_rare", "log_near")) == pytest.approx(want)

    outs, ins = ({k: {o for *_, o in sorted(((t, n, o) for s, d, t, n in edges for kk, o in [(s, d) if side else (d, s)] if kk == k), key=lambda x: x[:2], reverse=True)[:8]} for k in range(32)} for side in (1, 0))
    got = {(r.qid, r.col): r for r in graph.cf_overlap(cands, hist, 8).collect()}
    for q, u, _, col, v in cells:
        item = [len(ins[w] & ins[v]) for w in outs[u] if w is not None]
        user = [len((outs[z] & outs[u]) - {None}) for z in ins[v]]
        want = (math.log1p(sum(item)), math.log1p(max(item, default=0)), sum(item) / ((len(outs[u]) + 1) * math.sqrt(len(ins[v]) + 1)), math.log1p(sum(user)), math.log1p(max(user, default=0)))
        assert tuple(got[q, col][c] for c in ("item_sum", "item_max", "item_norm", "user_sum", "user_max")) == pytest.approx(want)


@pytest.mark.parametrize("features", [graph.neighbor_similarity, graph.cf_overlap])
def test_no_row_for_each_pair_of_sources(spark, features):
    """600 sources of all 20 items: cells and their items are rows, pairs of sources with their common items are not."""
    edges = spark.createDataFrame([(u, i, u, 20 * u + i) for u in range(600) for i in range(20)], EDGES)
    cells = spark.createDataFrame([(u, u, 0, c, (u + c) % 20) for u in range(600) for c in range(4)], CELLS)
    assert 0 < _made(features(cells, edges, 16)) <= 600 * 4 * 20


def test_sketches_meet_pairs_not_cells(spark):
    """A pair in many cells is estimated once: the last join of all goes by source and candidate."""
    edges = spark.createDataFrame([(u, (u + i) % 9, u, 9 * u + i) for u in range(12) for i in range(4)], EDGES)
    cells = spark.createDataFrame([(q, q % 12, 0, c, c) for q in range(240) for c in range(5)], CELLS)
    df = graph.cf_sketch(cells, edges, dim=8)
    rows = {(r.qid % 12, r.cand): tuple(r[3:]) for r in df.collect()}
    assert len(rows) == 60 and all(tuple(r[3:]) == rows[r.qid % 12, r.cand] for r in df.collect())
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "src" in joins[0] and "cand" in joins[0]
