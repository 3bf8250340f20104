"""Registered queries against the comparison engine, and the shape of their plans."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from edgetide.plans import catalog, frames, score_catalog  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """s6_bucketed_store s7_bucketed_scores f3_split_edges f4_segments f5_timestamp_safe_cuts f7_vocabulary a5_activity_cuts a12_bm25_confidence a14_bucket_pmi j1_causal_features j4_history_asof j6_transition_score
j8_near_support_pool j10_ring_support j12_community_presence j16_segments g3_cf_overlap g10_rp3 g11_neighbor_similarity g13_session_features g14_gcn_propagate w2_rank_pct_average w10_nearest_repeat
w13_loo_calibration w17_remap_slots r1_sample_groups r3_replay_history_cold r4_replay_popularity_hard r7_replay_rows m2_residual_logits m13_row_gate m15_apply_gate m17_component_scores m18_meta_features m19_slice_features m20_set_features m21_near_ring_lift e2_segment_metrics e3_paired_compare
e7_order_broken e8_leakage_late_cut e8_perturbation_leak e9_permutation_by_column r2_replay_from_files e8_effect_by_time e10_tolerance_checks m7_fit_gate m10_structural_chain m22_weight_families s4_edge_contract s9_validate_matrix x1_stream_stats x2_stream_popularity""".split()


@pytest.fixture(scope="module")
def engine(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool | int) else str(v)


def rows(names, got):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in got)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_the_comparison(spark, tables, engine, name):
    df = catalog.QUERIES[name](spark, tables)
    want = engine.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry_and_registration(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["j1_causal_features", "j4_history_asof", "j9_directional_support", "g10_rp3", "w6_margins", "r2_replay_history", "w13_loo_calibration"])
def test_plans_have_no_products_or_python(spark, tables, name):
    plan = catalog.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan
    assert os.linesep not in name


def test_history_filter_reaches_the_scan(spark, tables):
    plan = frames.edges(spark, tables).select("src", "seq").where("seq < 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,5)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


@pytest.mark.parametrize("name", ["l1_fit_mf", "l6_ranker_listwise"])
def test_learned_scorers_beat_chance(spark, tables, name):
    got = catalog.QUERIES[name](spark, tables).first()
    assert got.mrr > sum(1 / i for i in range(1, frames.WIDTH + 1)) / frames.WIDTH - 0.03
