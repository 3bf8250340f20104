"""Windows over time when one item or source has half of all rows: results by brute force, and plans in which no task holds a whole key."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from edgetide.functions.tables import written
from edgetide.operators import features, graph, support

DAY = 86_400
CELLS = "qid long, src long, time long, col int, cand long"
EDGES = "src long, dst long, time long, seq long"


@pytest.fixture(scope="module")
def cells():
    """Half of all cells hold item 1, within hours and over 40 days, some at one second; repeated items in a row."""
    rng = random.Random(1)
    out = []
    for q in range(300):
        src, time = rng.randrange(4), rng.choice([rng.randrange(40 * DAY), 20 * DAY + rng.randrange(5000), 20 * DAY, -rng.randrange(9000)])
        for col in range(4):
            out.append((q, src, time, col, 1 if col < 2 and rng.random() < 0.9 else rng.randrange(2, 9)))
    return out


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    return [(0 if rng.random() < 0.6 else rng.randrange(1, 5), rng.randrange(12), rng.choice([rng.randrange(20 * DAY), 7 * DAY + rng.randrange(600), 7 * DAY, 8 * DAY - 1]), i) for i in range(900)]


def windows(df):
    """Keys by which rows meet under a window, as in the physical plan."""
    return re.findall(r"\(\d+\) Window\n.*?\nArguments: \[.*?\], \[(.*?)\], \[", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"), re.S)


@pytest.mark.parametrize("frames", [{"near": (-900, 900)}, {"past": (-7200, -1), "future": (1, 7200)}, {"a": (0, 0), "b": (-DAY, DAY), "c": (-3, 5 * DAY)}])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("own_pool", [True, False])
def test_support_of_a_hot_item(spark, cells, frames, same, own_pool):
    df = spark.createDataFrame(cells, CELLS)
    pool = None if own_pool else df.where("qid % 3 = 0")
    got = support.windowed_support(df, frames, same, pool)
    found = {(q, s, t, c) for q, s, t, _, c in cells}
    others = [x for x in found if own_pool or x[0] % 3 == 0]
    want = {(q, c): tuple(sum(c2 == c and t + a <= t2 <= t + b and (s == s2) == same for _, s2, t2, c2 in others) for a, b in frames.values()) for q, s, t, c in found}
    assert {(r.qid, r.cand): tuple(r)[2:] for r in got.collect()} == want
    assert windows(got) and all("__bucket" in w for w in windows(got))


def test_consensus_and_rings_of_a_hot_item(spark, cells):
    df = spark.createDataFrame(cells, CELLS)
    found = {(q, s, t, c) for q, s, t, _, c in cells}
    got = {(r.qid, r.cand): (r.sources, r.times, r.rows) for r in support.consensus(df, 3600).collect()}
    of = lambda c: [x for x in found if x[3] == c]
    assert got == {(q, c): (len({x[1] for x in of(c)}), len({x[2] for x in of(c) if abs(x[2] - t) <= 3600}), len(of(c)) - 1) for q, s, t, c in found}
    rings = support.RINGS
    got = {(r.qid, r.cand): tuple(r)[2:] for r in support.ring_support(df).collect()}
    assert got == {(q, c): tuple(sum(x[1] == s and a < abs(x[2] - t) <= b for x in of(c)) for a, b in zip(rings, rings[1:])) for q, s, t, c in found}


@pytest.mark.parametrize("width", [600, DAY])
def test_histories_of_a_hot_source(spark, edges, width):
    rng = random.Random(5)
    queries = [(q, rng.choice([0, 0, 1, 4, 77]), rng.choice([rng.randrange(21 * DAY), 7 * DAY, 7 * DAY + 300, 8 * DAY, 0, -5])) for q in range(250)]
    df = features.history_asof(spark.createDataFrame(queries, "qid long, src long, time long"), spark.createDataFrame(edges, EDGES), 5, width)
    by = {s: sorted((t, n, d) for s2, d, t, n in edges if s2 == s) for s in range(5)}
    want = {q: [(d, t) for t, _, d in by.get(s, []) if t < at][-5:] for q, s, at in queries}
    rows = df.collect()
    assert {r.qid: r["items"] for r in rows} == {q: [d for d, _ in w] for q, w in want.items()}
    when = {q: at for q, _, at in queries}
    assert {r.qid: [round(2.718281828459045**g - 1) for g in r.gaps] for r in rows} == {q: [when[q] - t for _, t in w] for q, w in want.items()}
    assert len(rows) == len(queries)


def test_transitions_and_session_graph_of_a_hot_source(spark, edges):
    df = spark.createDataFrame(edges, EDGES)
    pairs, near = Counter(), Counter()
    for s in range(5):
        own = sorted((t, n, d) for s2, d, t, n in edges if s2 == s)
        pairs.update((a[2], b[2]) for a, b in zip(own, own[1:]) if b[0] > a[0])
        for i, x in enumerate(own):
            for y in own[max(0, i - 4) : i]:
                if x[0] - y[0] <= 1800:
                    near.update([(x[2], y[2]), (y[2], x[2])])
    got = features.transitions(df)
    assert {(r.prev, r.next): r.cnt for r in got.collect()} == pairs
    graphs = graph.session_graph(df)
    assert {(r.i, r.j): r.cnt for r in graphs.collect()} == near
    assert all(re.search(r"\bat#", w) for w in windows(graphs))


def test_counts_are_differences_of_running_totals(spark, cells):
    """A frame with both ends is summed anew for each row, which is quadratic in a hot item's seconds."""
    df = spark.createDataFrame(cells, CELLS)
    for rows in (support.near_support(df, 900, False), support.ring_support(df), support.consensus(df, 3600)):
        plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        found = re.findall(r"specifiedwindowframe\(RangeFrame, (.*?), ", plan)
        assert found and set(found) == {"unboundedpreceding$()"}


def test_occurrences_are_dealt_out_before_they_are_folded(spark, cells):
    """No aggregate holds a whole split of the cells: the shuffle lies below both."""
    df = support.distinct_occurrences(spark.createDataFrame(cells, CELLS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning") > plan.rindex("HashAggregate")
    assert df.count() == len({(q, c) for q, *_, c in cells})


def test_community_pairs_are_rows_once_however_often_they_meet(spark, monkeypatch):
    """12 sources meet at 40 times with random items, in blocks of five: brute force, and one row for two sources, not for a meeting."""
    rng = random.Random(5)
    vecs = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(12)}
    cells = [(q, q % 14, q // 14, c, x) for q in range(14 * 40) for c, x in enumerate(rng.choices(range(6), k=4))]
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(support, "written", counted)
    cands = spark.createDataFrame(cells, "qid long, src long, time long, col int, cand long")
    users = spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")
    got = {tuple(r) for r in support.community_presence(cands, users, block=5, parts=3).collect()}

    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    cos = lambda a, b: round(sum(x * y for x, y in zip(norm(vecs[a]), norm(vecs[b]))), 9)
    rows = sorted({(t, x, q, s) for q, s, t, _, x in cells if s in vecs})
    met = [(cos(a[3], b[3]), a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[:2] == b[:2] and a[3] != b[3]]
    level = float(np.quantile([m[0] for m in met], 0.9))
    good = {(x[2], x[1]) for c, *two in met if c >= level for x in two}
    assert got == {(q, c, x) for q, s, _, c, x in cells if (q, x) in good}
    assert len(met) > 2000 and sizes["similar"] == 66
