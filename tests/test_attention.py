"""Attention counted in arrays: against plain sums with null items and hot sources, and without a row for each cell and item."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from edgetide.operators import attention

from test_overlaps import CELLS, EDGES, _made


@pytest.mark.parametrize("group", [256, 2])
def test_attention_equals_plain_sums(spark, monkeypatch, group):
    monkeypatch.setattr(attention, "GROUP", group)
    rng = random.Random(8)
    big = 1 << 60
    edges = [(rng.randrange(5), None if rng.random() < 0.05 else big + rng.randrange(12), rng.randrange(1000), n) for n in range(120)]
    asked = [(big + q, rng.randrange(7), rng.randrange(1100)) for q in range(40)]
    cells = [(q, u, t, c, None if rng.random() < 0.05 else big + rng.randrange(14)) for q, u, t in asked for c in range(4)]
    vecs = {big + i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(9)}
    items = spark.createDataFrame([*vecs.items(), (big + 9, None), (big + 10, [1.0, None, 0.0])], "id long, vec array<double>")
    got = {(r.qid, r.col): (r.attention_2, r.attention_5) for r in attention.attended(spark.createDataFrame(cells, CELLS), spark.createDataFrame(edges, EDGES), items, (2, 5)).collect()}
    assert len(got) == len(cells)
    for q, u, t, col, v in cells:
        past = sorted(((et, n, d) for s, d, et, n in edges if s == u and et < t), reverse=True)
        want = []
        for k in (2, 5):
            met = [(sum(x * y for x, y in zip(vecs[v], vecs[d])), math.log1p(t - et)) for et, _, d in past[:k] if v in vecs and d in vecs]
            e = [math.exp(qh / math.sqrt(3) - 0.1 * gap) for qh, gap in met]
            want.append(sum(x * qh for x, (qh, _) in zip(e, met)) / sum(e) if met else 0.0)
        assert got[q, col] == pytest.approx(tuple(want))


def test_no_row_for_each_cell_and_item(spark):
    """100 queries of 20 cells after 32 items each: 64,000 meetings, none of them a row."""
    edges = spark.createDataFrame([(u, i, i, 40 * u + i) for u in range(100) for i in range(32)], EDGES)
    cells = spark.createDataFrame([(u, u, 100, c, (u + c) % 40) for u in range(100) for c in range(20)], CELLS)
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "id long, vec array<double>")
    assert 0 < _made(attention.attended(cells, edges, items, (8, 32))) <= 100 * 40


def test_many_vectors_as_few(monkeypatch):
    """Products taken one by one, where a group has too many vectors for all of them, give the same."""
    rng = np.random.default_rng(3)
    ids, vecs = np.arange(50), rng.normal(size=(50, 4))
    found = []
    for square in (1024, 0):
        monkeypatch.setattr(attention, "SQUARE", square)
        group = attention.Group(6)
        group.parts.append((ids, vecs))
        group.rows.append((np.array([7, 3]), np.array([6, 2]), np.array([1, 2, 60, 4, 5, 6, 7, 8]), np.ones(8, bool), np.arange(8.0)))
        found.append(group.scores(np.array([3, 7, 9, 7]), np.array([1, 2, 3, 70]), np.ones(4, bool), (2, 6), 0.1))
    assert found[0][:, :2].all() and not found[0][:, 2:].any()
    np.testing.assert_allclose(found[0], found[1])
