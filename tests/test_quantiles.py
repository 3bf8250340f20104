"""Exact quantiles against dense ones."""

from __future__ import annotations

import numpy as np
import pytest

from edgetide.functions import quantiles

SHARES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q99": 0.99, "top": 1.0}


@pytest.mark.parametrize("kind", ["normal", "outliers", "equal", "single", "few"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=20_000), "outliers": np.append(rng.normal(size=5_000), [1e12, -1e12, 1e9]), "equal": np.ones(100), "single": np.array([3.5]), "few": np.array([1.0, 2.0, 2.0, 9.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    got = quantiles(df, "x", SHARES).first()
    assert list(got) == pytest.approx(list(np.quantile(values, list(SHARES.values()))), rel=1e-9, abs=1e-12)


def test_weights_count_as_repeated_rows(spark):
    rng = np.random.default_rng(6)
    values, counts = rng.normal(size=500).round(1), rng.integers(1, 40, 500)
    df = spark.createDataFrame([(float(v), int(n)) for v, n in zip(values, counts, strict=True)], "x double, n long")
    got = quantiles(df, "x", SHARES, "n").first()
    assert list(got) == pytest.approx(list(np.quantile(np.repeat(values, counts), list(SHARES.values()))), abs=1e-12)


def test_no_rows_give_nulls(spark):
    assert list(quantiles(spark.createDataFrame([], "x double"), "x", SHARES).first()) == [None] * len(SHARES)
