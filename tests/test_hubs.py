"""Walks through an item that all sources share, and hierarchies on every level at once."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from edgetide.operators import graph, stats

EDGES = "src long, dst long, time long, seq long"


@pytest.mark.parametrize("heavy", [0, 3, 10_000])
def test_walks_through_a_hub(spark, heavy):
    rng = random.Random(4)
    edges = [(u, 0, u, u) for u in range(60)] + [(rng.randrange(60), rng.randrange(1, 25), 100 + n, 100 + n) for n in range(260)]
    cells = [(q, rng.randrange(62), 0, c, rng.randrange(26)) for q in range(40) for c in range(5)]
    f = Counter((s, d) for s, d, _, _ in edges)
    dn, di, into = Counter(s for s, *_ in edges), Counter(d for _, d, *_ in edges), defaultdict(set)
    for s, d in f:
        into[d].add(s)
    got = {(r.qid, r.col): (r.rp3_log, r.rp3) for r in graph.rp3(spark.createDataFrame(cells, "qid long, src long, time long, col int, cand long"), spark.createDataFrame(edges, EDGES), 0.5, 4096, heavy).collect()}
    for q, u, _, col, v in cells:
        count = walk = 0.0
        for (s, i), fu in f.items():
            if s == u:
                for n in into[i]:
                    if n != u and (n, v) in f:
                        count += fu * f[n, i] * f[n, v]
                        walk += fu * f[n, i] * f[n, v] / (di[i] * dn[n])
        assert got[q, col] == (pytest.approx(math.log1p(count)), pytest.approx(walk / math.sqrt(di[v]) if count else 0.0))


def test_walks_to_a_candidate_of_many_edges(spark):
    """No candidate is left out for its edges: 5,000 to item 1 by five sources, all of which share item 2."""
    edges = [(n % 5, 1, n, n) for n in range(5000)] + [(u, 2, 0, 6000 + u) for u in range(5)]
    cells = [(0, 0, 0, 0, 1)]
    got = graph.rp3(spark.createDataFrame(cells, "qid long, src long, time long, col int, cand long"), spark.createDataFrame(edges, EDGES)).first()
    count = sum(f * g * 1000 for f, g in ((1000, 1000), (1, 1))) * 4
    walk = (1000 * 1000 * 1000 / (5000 * 1001) + 1000 / (5 * 1001)) * 4
    assert (got.rp3_log, got.rp3) == (pytest.approx(math.log1p(count)), pytest.approx(walk / math.sqrt(5000)))


def test_no_two_sources_meet_at_a_hub(spark):
    """With n sources at one item, joins make rows in proportion to n: twice the sources, about twice the rows."""

    def made(n):
        edges = spark.createDataFrame([(u, 0, u, u) for u in range(n)] + [(u, 1 + u % 5, u, n + u) for u in range(n)], EDGES)
        cells = spark.createDataFrame([(u, u, 0, 0, 1 + (u + 1) % 5) for u in range(n)], "qid long, src long, time long, col int, cand long")
        df = graph.rp3(cells, edges, heavy=16, max_degree=0)
        df.collect()
        whole = graph.rp3(cells, edges, heavy=16)
        whole.collect()
        plan = whole._jdf.queryExecution().executedPlan()
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

        walk(plan)
        return most[0]

    small, large = made(200), made(400)
    assert 0 < small and large <= 2.6 * small


def test_all_levels_equal_one_level_at_a_time(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.getrandbits(14), rng.getrandbits(14), rng.randrange(30_000), n) for n in range(3000)], EDGES)
    cells = spark.createDataFrame([(q, rng.getrandbits(14), 0, c, rng.getrandbits(14)) for q in range(30) for c in range(6)], "qid long, src long, time long, col int, cand long")
    got = {(r.qid, r.col): r for r in stats.hierarchy_features(edges, cells).collect()}
    assert len(got) == 180 and len(next(iter(got.values()))) == 3 + 34
    for (a, b), w in [((4, 6), None), ((8, 8), None), ((6, 6), 21_600), ((8, 8), 1800)]:
        name = f"{a}_{b}" + (f"_w{w}" if w else "")
        raw = defaultdict(dict)
        for r in stats.bucket_pmi(edges, cells, a, b, w).collect():
            raw[r.qid][r.col] = (r.log_pair, r.pmi)
        for q, cols in raw.items():
            for k, kind in enumerate(("pair", "pmi")):
                x = [cols[c][k] for c in range(6)]
                mean = sum(x) / 6
                std = max(math.sqrt(sum((v - mean) ** 2 for v in x) / 6), 1e-6)
                assert [got[q, c][f"{kind}_{name}"] for c in range(6)] == pytest.approx([(v - mean) / std for v in x], abs=1e-7)
