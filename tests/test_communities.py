"""Sources that meet at one time: counts of similarities leave a task, not pairs of sources."""

from __future__ import annotations

import numpy as np
import pytest

from edgetide.functions.tables import written
from edgetide.operators import support


@pytest.mark.parametrize("share", [25, 1 << 20])
def test_similarities_are_counted_not_listed(spark, monkeypatch, share):
    """60 sources with four vectors among them have 1,770 pairs and seven similarities at most; hot times are dealt by query."""
    rng = np.random.default_rng(3)
    sizes = {}
    monkeypatch.setattr(support, "written", lambda df, name: (lambda out: (sizes.update({name: out.count()}), out)[1])(written(df, name)))
    kinds = rng.normal(size=(4, 3))
    cells = [(q, q % 60, int(q >= 100), c, int(x)) for q in range(140) for c, x in enumerate(rng.integers(0, 9, 3))]
    cands = spark.createDataFrame(cells, "qid long, src long, time long, col int, cand long")
    users = spark.createDataFrame([(i, kinds[i % 4].tolist()) for i in range(60)], "id long, vec array<double>")
    got = [tuple(r) for r in support.community_presence(cands, users, share=share, block=16).collect()]
    unit = kinds / np.linalg.norm(kinds, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    rows = sorted({(t, x, q, s) for q, s, t, _, x in cells})
    met = [(cos[a[3] % 4, b[3] % 4], a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[:2] == b[:2] and a[3] != b[3]]
    level = np.quantile([m[0] for m in met], 0.9)
    good = {(x[2], x[1]) for c, *two in met if c >= level for x in two}
    assert sorted(got) == sorted((q, c, x) for q, _, _, c, x in cells if (q, x) in good)
    assert sizes["similar"] <= 7
