"""Registered queries, one or more an operator, each with SQL for comparison where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, at_digits
from ..operators import features, graph, history, rank, stats, support
from . import frames
from .frames import CUTOFF, ORIGIN
from .sql import draw, log1p, query, recency, z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero."""
    return df.select(*((at_digits(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, body: str | None = None, *needs: str, ctes: str = "", doubles: str = ""):
    """Register the function under the name, and the SQL if there is a body."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if body is not None:
            SQL[name] = query(body, *needs, ctes=ctes, doubles=doubles)
        return fn

    return add


E, H, T, C, K, S = frames.edges, frames.hist, frames.targets, frames.cands, frames.causal, frames.scored

# 2.2 history, splits, vocabularies

register("f1_history", "SELECT * FROM hist", "hist")(H)
register("f2_time_slice", f"SELECT 'history' AS part, count(*) AS n, min(time) AS t0, max(time) AS t1 FROM edges WHERE time < {CUTOFF} UNION ALL SELECT 'target', count(*), min(time), max(time) FROM edges WHERE time >= {CUTOFF} AND time < {CUTOFF + 7 * DAY}", "edges")(
    lambda s, d: (lambda a, b: a.select(F.lit("history").alias("part"), "time").union(b.select(F.lit("target"), "time")).groupBy("part").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1")))(*history.time_slice(E(s, d), CUTOFF, CUTOFF + 7 * DAY))
)
_PLACED = "placed AS (SELECT *, row_number() OVER (ORDER BY time, seq) - 1 AS place, count(*) OVER () AS total FROM {t})"
register("f3_split_edges", "SELECT src, dst, time, seq, CASE WHEN place < floor(total * 0.8) THEN 'history' WHEN place < floor(total * 0.8) + floor((total - floor(total * 0.8)) * 0.8) THEN 'train' ELSE 'valid' END AS part FROM placed", "buys", ctes=_PLACED.format(t="buys"))(lambda s, d: history.split_edges(frames.purchases(s, d)))
register("f4_segments", "SELECT src, dst, time, seq, CAST(place >= round_even(total * 0.5, 0) AS INTEGER) + CAST(place >= round_even(total * 0.6, 0) AS INTEGER) + CAST(place >= round_even(total * 0.75, 0) AS INTEGER) + CAST(place >= round_even(total * 0.85, 0) AS INTEGER) AS segment FROM placed", "edges", ctes=_PLACED.format(t="edges"))(lambda s, d: history.segments(E(s, d)))
_CUTS = "counts AS (SELECT time, count(*) AS n FROM buys GROUP BY time), upto AS (SELECT *, sum(n) OVER (ORDER BY time) - n AS before FROM counts), whole AS (SELECT sum(n) AS total, min(time) AS least FROM counts), cuts AS (SELECT " + ", ".join(f"coalesce(min(CASE WHEN before <= floor(total * {q}) AND floor(total * {q}) < before + n AND time > least THEN time END), min(CASE WHEN time > least THEN time END)) AS cut_{i}" for i, q in ((1, 0.7), (2, 0.85))) + " FROM upto, whole)"
register("f5_timestamp_safe_cuts", "SELECT CASE WHEN time < cut_1 THEN 0 WHEN time < cut_2 THEN 1 ELSE 2 END AS part, count(*) AS n, min(time) AS t0, max(time) AS t1 FROM buys, cuts GROUP BY 1", "buys", ctes=_CUTS)(
    lambda s, d: (lambda e: history.by_cuts(e, history.timestamp_safe_cuts(e)).groupBy("part").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1")))(frames.purchases(s, d))
)
register("f6_segment_history", "SELECT src, dst, time, seq FROM placed WHERE place < round_even(total * 0.75, 0)", "edges", ctes=_PLACED.format(t="edges"))(lambda s, d: history.segment_history(history.segments(E(s, d)), 3).select("src", "dst", "time", "seq"))
register("f7_vocabulary", "SELECT t.seq, coalesce(v.i, 0) AS src_idx, coalesce(w.i, 0) AS dst_idx FROM tgt t LEFT JOIN (SELECT src, row_number() OVER (ORDER BY src) AS i FROM (SELECT DISTINCT src FROM hist)) v ON v.src = t.src LEFT JOIN (SELECT dst, row_number() OVER (ORDER BY dst) AS i FROM (SELECT DISTINCT dst FROM hist)) w ON w.dst = t.dst", "hist", "tgt")(
    lambda s, d: (lambda v: history.encode(history.encode(T(s, d), v, "src", "src"), v, "dst", "dst").select(F.col("qid").alias("seq"), "src_idx", "dst_idx"))(history.vocabulary(H(s, d)))
)
register("f7_vocabulary_shared", "SELECT id, row_number() OVER (ORDER BY id) AS idx FROM (SELECT src AS id FROM hist UNION SELECT dst FROM hist)", "hist")(lambda s, d: history.vocabulary(H(s, d), "shared").select("id", "idx"))
register("f8_sample_targets", f"SELECT src, dst, time, seq FROM (SELECT *, {draw('seq', 0, 3)} AS h FROM tgt) ORDER BY h, seq LIMIT 500", "tgt")(lambda s, d: history.sample_targets(E(s, d).where(F.col("time") >= CUTOFF), 500, 3))
register("s5_history_boundary", "SELECT (SELECT max(time) FROM hist) AS last_train, (SELECT min(time) FROM tgt) AS first_query, (SELECT max(time) FROM hist) < (SELECT min(time) FROM tgt) AS ok", "hist", "tgt")(lambda s, d: history.history_boundary(H(s, d), T(s, d)))

# 2.3 aggregates

register("a1_src_stats", "SELECT src, n AS src_cnt, last AS src_last FROM ss", "stats")(lambda s, d: stats.src_stats(H(s, d)))
register("a2_dst_stats", "SELECT dst, n AS dst_cnt, last AS dst_last FROM ds", "stats")(lambda s, d: stats.dst_stats(H(s, d)))
register("a3_pair_stats", "SELECT src, dst, n AS pair_cnt, first AS pair_first, last AS pair_last FROM ps", "stats")(lambda s, d: stats.pair_stats(H(s, d)))
register("a4_hot_threshold", "SELECT CAST(greatest(1, ceil(quantile_cont(n, 0.8))) AS BIGINT) AS hot FROM ds", "stats")(lambda s, d: stats.hot_threshold(stats.dst_stats(H(s, d)), "dst_cnt"))
register("a5_activity_cuts", "SELECT min(CASE WHEN r = CAST(ceil((t - 1) * 0.5) AS BIGINT) THEN n END) AS cut_1, min(CASE WHEN r = CAST(ceil((t - 1) * 0.9) AS BIGINT) THEN n END) AS cut_2 FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS t FROM (SELECT count(*) OVER (PARTITION BY src) AS n FROM tgt))", "tgt")(lambda s, d: stats.activity_cuts(T(s, d)))
register("a6_dst_histograms", "SELECT dst, 'hour' AS kind, (time % 86400) // 3600 AS slot, count(*) AS cnt FROM hist GROUP BY ALL UNION ALL SELECT dst, 'dow', (time // 86400) % 7, count(*) FROM hist GROUP BY ALL", "hist")(lambda s, d: stats.dst_histograms(H(s, d)))
register("a7_pool_freq", f"SELECT cand, count(*) AS cnt, {log1p('count(*)')} AS log_freq FROM cands GROUP BY cand", "cands", doubles="log_freq")(lambda s, d: stats.pool_freq(C(s, d)))
register("a8_src_pool_freq", f"SELECT src, cand, count(*) AS cnt, {log1p('count(*)')} AS log_freq FROM cands GROUP BY src, cand HAVING count(*) > 1", "cands", doubles="log_freq")(lambda s, d: stats.src_pool_freq(C(s, d)))
_POP = ", ".join(f"sum(exp((time - {ORIGIN}) / {float(n * DAY)}::DOUBLE)) AS pop_{n}" for n in (30, 90, 365))
register("a9_decayed_popularity", f"SELECT dst, {_POP} FROM hist GROUP BY dst", "hist", doubles="pop_30 pop_90 pop_365")(lambda s, d: stats.decayed_popularity(H(s, d), ORIGIN))
register("a10_item_freshness", f"SELECT c.cand, coalesce(-ln(1 + ({ORIGIN} - ds.last) / 86400.0::DOUBLE), -30) AS freshness FROM (SELECT DISTINCT cand FROM cands) c LEFT JOIN ds ON ds.dst = c.cand", "cands", "stats", doubles="freshness")(lambda s, d: stats.item_freshness(H(s, d), C(s, d), ORIGIN))
_UIW = f"uiw AS (SELECT src, dst, sum(exp((time - {ORIGIN}) / {30.0 * DAY}::DOUBLE)) AS w FROM hist GROUP BY src, dst)"
register("a11_user_item_weights", "SELECT * FROM uiw", "hist", ctes=_UIW, doubles="w")(lambda s, d: stats.user_item_weights(H(s, d), ORIGIN, 30.0 * DAY))
register(
    "a12_bm25_confidence", "SELECT src, dst, least(greatest(raw / avg(raw) OVER (), 0.05), 20) AS confidence FROM raws", "hist", doubles="confidence",
    ctes=_UIW + ", users AS (SELECT src, sum(w) AS len FROM uiw GROUP BY src), items AS (SELECT dst, count(*) AS df FROM uiw GROUP BY dst), whole AS (SELECT avg(len) AS mean, count(*) AS n FROM users), raws AS (SELECT src, dst, w * 101 / (100 * (0.2::DOUBLE + 0.8::DOUBLE * len / mean) + w) * (ln(n::DOUBLE) - ln(1.0::DOUBLE + df)) AS raw FROM uiw JOIN users USING (src) JOIN items USING (dst), whole)",
)(lambda s, d: stats.bm25_confidence(stats.user_item_weights(H(s, d), ORIGIN, 30.0 * DAY)))
register("a13_popularity", f"SELECT qid, col, cand, {log1p('coalesce(ds.n, 0)')} AS log_pop FROM cands LEFT JOIN ds ON ds.dst = cand", "cands", "stats", doubles="log_pop")(lambda s, d: stats.popularity(H(s, d), C(s, d)))


def _pmi(where: str) -> dict:
    return {
        "doubles": "log_pair pmi",
        "ctes": f"hh AS (SELECT src >> 2 AS sb, dst >> 3 AS db FROM hist {where}), b2 AS (SELECT sb, db, count(*) AS n FROM hh GROUP BY ALL), b1 AS (SELECT sb, count(*) AS n FROM hh GROUP BY ALL), b0 AS (SELECT db, count(*) AS n FROM hh GROUP BY ALL), bt AS (SELECT count(*) AS n FROM hh)",
    }


_PMI = f"SELECT qid, col, cand, {log1p('coalesce(b2.n, 0)')} AS log_pair, ln(coalesce(b2.n, 0) + 0.25::DOUBLE) + ln(bt.n + 1.0::DOUBLE) - ln(coalesce(b1.n, 0) + 1.0::DOUBLE) - ln(coalesce(b0.n, 0) + 1.0::DOUBLE) AS pmi FROM cands c LEFT JOIN b2 ON b2.sb = c.src >> 2 AND b2.db = c.cand >> 3 LEFT JOIN b1 ON b1.sb = c.src >> 2 LEFT JOIN b0 ON b0.db = c.cand >> 3, bt"
register("a14_bucket_pmi", _PMI, "cands", **_pmi(""))(lambda s, d: stats.bucket_pmi(H(s, d), C(s, d), 2, 3))
register("a14_bucket_pmi_window", _PMI, "cands", **_pmi("WHERE time > (SELECT max(time) FROM hist) - 21600"))(lambda s, d: stats.bucket_pmi(H(s, d), C(s, d), 2, 3, 21_600))


def _hierarchy() -> tuple[str, list[str]]:
    """Expressions up to ``hier(qid, col, cand, <columns>)``, one set of counts a level and window, and the columns."""
    parts, joins, raw, names = ["he AS (SELECT max(time) AS t1 FROM hist)"], [], [], []
    for w, levels in [(None, stats.FULL_LEVELS), *((w, stats.RECENT_LEVELS) for w in stats.RECENT_WINDOWS)]:
        for a, b in levels:
            k, name = f"{a}_{b}_{w or 0}", f"{a}_{b}" + (f"_w{w}" if w else "")
            inside = "TRUE" if w is None else f"time > t1 - {w}"
            for p, by in (("p", "sb, db"), ("s", "sb"), ("d", "db")):
                parts.append(f"{p}{k} AS (SELECT {by}, count(*) AS n FROM (SELECT src >> {a} AS sb, dst >> {b} AS db FROM hist, he WHERE {inside}) GROUP BY ALL)")
            parts.append(f"t{k} AS (SELECT count(*) AS n FROM hist, he WHERE {inside})")
            joins.append(f"LEFT JOIN p{k} ON p{k}.sb = c.src >> {a} AND p{k}.db = c.cand >> {b} LEFT JOIN s{k} ON s{k}.sb = c.src >> {a} LEFT JOIN d{k} ON d{k}.db = c.cand >> {b} CROSS JOIN t{k}")
            raw += [f"{log1p(f'coalesce(p{k}.n, 0)')} AS pair_{name}", f"ln(coalesce(p{k}.n, 0) + 0.25::DOUBLE) + ln(t{k}.n + 1.0::DOUBLE) - ln(coalesce(s{k}.n, 0) + 1.0::DOUBLE) - ln(coalesce(d{k}.n, 0) + 1.0::DOUBLE) AS pmi_{name}"]
            names += [f"pair_{name}", f"pmi_{name}"]
    parts.append(f"hraw AS (SELECT c.src, c.cand, {', '.join(raw)} FROM (SELECT DISTINCT src, cand FROM cands) c {' '.join(joins)})")
    z_ = ", ".join(f"({n} - avg({n}) OVER q) / greatest(stddev_pop({n}) OVER q, 1e-6) AS {n}" for n in names)
    parts.append(f"hier AS (SELECT qid, col, cand, {z_} FROM cands JOIN hraw USING (src, cand) WINDOW q AS (PARTITION BY qid))")
    return ", ".join(parts), names


_HIER, HIER_NAMES = _hierarchy()
register("a14_hierarchy", "SELECT * FROM hier", "cands", "hist", ctes=_HIER, doubles=" ".join(HIER_NAMES))(lambda s, d: stats.hierarchy_features(H(s, d), C(s, d), one_source=True))
register("a15_standardize", "SELECT qid, col, " + ", ".join(f"greatest(least(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-6), 8), -8) AS {c}" for c in "abc") + " FROM scored", "scored", doubles="a b c")(lambda s, d: stats.standardize(S(s, d).select("qid", "col", "a", "b", "c"), ["a", "b", "c"]))
register("a16_pool_excess", "SELECT cand, n AS cnt, " + ", ".join(f"greatest(n - lv - {float(t)}::DOUBLE * sqrt(lv), 0) AS excess_{i}" for i, t in enumerate((-1, 0, 0.5, 1, 1.5, 2))) + " FROM (SELECT cand, count(*) AS n FROM cands GROUP BY cand), lvl", "cands", ctes="lvl AS (SELECT ((SELECT count(*) FROM cands) - (SELECT count(DISTINCT qid) FROM cands))::DOUBLE / (SELECT n FROM npool) AS lv)", doubles=" ".join(f"excess_{i}" for i in range(6)))(
    lambda s, d: stats.pool_excess(C(s, d), H(s, d).agg(F.count_distinct("dst").alias("n_items")))
)
register("a17_score_quantiles", "SELECT " + ", ".join(f"quantile_cont(score, {q}) AS q{round(100 * q):02d}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)) + " FROM scored", "scored", doubles="q01 q10 q50 q90 q99")(lambda s, d: stats.score_quantiles(S(s, d)))

# 2.4 lookups

register("j1_causal_features", "SELECT * FROM feat", "feat", doubles=" ".join(c for c in features.CAUSAL if not c.endswith("_seen")))(frames.features_of)
register("j2_pair_seen", "SELECT qid, col, cand, CAST(EXISTS (SELECT 1 FROM hist h WHERE h.src = c.src AND h.dst = c.cand) AS INTEGER) AS seen FROM cands c", "cands")(lambda s, d: features.pair_seen(C(s, d), H(s, d)).select("qid", "col", "cand", "seen"))
register("j3_reverse_pair", f"SELECT qid, col, {log1p('coalesce(ps.n, 0)')} AS back_log_count, CASE WHEN ps.n IS NULL THEN 0 ELSE {recency('c.time - ps.last')} END AS back_recency FROM cands c LEFT JOIN ps ON ps.src = c.cand AND ps.dst = c.src", "cands", "stats", doubles="back_log_count back_recency")(lambda s, d: features.reverse_pair(C(s, d), H(s, d)))
_ASOF = "past AS (SELECT t.seq AS qid, t.src, t.time, e.dst, e.time AS et, e.seq AS es, row_number() OVER (PARTITION BY t.seq ORDER BY e.time DESC, e.seq DESC) AS r FROM tgt t LEFT JOIN edges e ON e.src = t.src AND e.time < t.time)"
_ASOF_BODY = "SELECT qid, src, time, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY et, es) FILTER (WHERE dst IS NOT NULL), '') AS items, coalesce(sum(ln(1.0::DOUBLE + time - et)), 0) AS gap_sum FROM past WHERE r <= 5 GROUP BY qid, src, time"
register("j4_history_asof", _ASOF_BODY, "tgt", ctes=_ASOF, doubles="gap_sum")(
    lambda s, d: features.history_asof(T(s, d), E(s, d), 5).select("qid", "src", "time", F.array_join("items", ",").alias("items"), F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x).alias("gap_sum"))
)
register("j5_history_static", "SELECT src, r - 1 AS pos, dst AS item, exp(-(r - 1) / 3.0::DOUBLE) AS weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY time DESC, seq DESC) AS INTEGER) AS r FROM hist) WHERE r <= 8", "hist", doubles="weight")(lambda s, d: features.history_static(H(s, d)))
_TRANS = "trans AS (SELECT dst AS prev, nx AS next, count(*) AS n FROM (SELECT dst, time, lead(dst) OVER w AS nx, lead(time) OVER w AS nt FROM hist WINDOW w AS (PARTITION BY src ORDER BY time, seq)) WHERE nt > time GROUP BY ALL), lasts AS (SELECT src, arg_max(dst, (time, seq)) AS prev FROM hist GROUP BY src)"
register("j6_transition_score", f"SELECT qid, col, cand, {log1p('coalesce(t.n, 0)')} AS transition FROM cands c LEFT JOIN lasts l ON l.src = c.src LEFT JOIN trans t ON t.prev = l.prev AND t.next = c.cand", "cands", ctes=_TRANS, doubles="transition")(lambda s, d: features.transition_score(C(s, d), H(s, d)))
register("j7_cross_exact", "SELECT qid, cand, count(*) OVER (PARTITION BY time, cand) - count(*) OVER (PARTITION BY src, time, cand) AS \"cross\" FROM occ", "occ")(lambda s, d: support.cross_exact(C(s, d)))


def _win(a: int, b: int, key: str) -> str:
    bound = lambda x: f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"coalesce(count(*) OVER (PARTITION BY {key} ORDER BY time RANGE BETWEEN {bound(a)} AND {bound(b)}), 0)"


register("j8_near_support_same", f"SELECT qid, cand, {_win(-3600, 3600, 'cand, src')} AS near FROM occ", "occ")(lambda s, d: support.near_support(C(s, d), 3600, True))
register("j8_near_support_other", f"SELECT qid, cand, {_win(-900, 900, 'cand')} - {_win(-900, 900, 'cand, src')} AS near FROM occ", "occ")(lambda s, d: support.near_support(C(s, d), 900, False))
register("j8_near_support_pool", "SELECT o.qid, o.cand, (SELECT count(*) FROM hist h WHERE h.dst = o.cand AND h.time BETWEEN o.time - 86400 * 10 AND o.time + 86400 * 10) AS near FROM occ o", "occ")(
    lambda s, d: (lambda pool: support.windowed_support(C(s, d), {"near": (-10 * DAY, 10 * DAY)}, False, pool))(H(s, d).select((-F.col("seq") - 1).alias("qid"), (-F.col("src") - 1).alias("src"), "time", F.col("dst").alias("cand"), F.lit(0).alias("col")))
)
register("j9_directional_support", f"SELECT qid, cand, {_win(-3600, -1, 'cand')} - {_win(-3600, -1, 'cand, src')} AS past, {_win(1, 3600, 'cand')} - {_win(1, 3600, 'cand, src')} AS future FROM occ", "occ")(lambda s, d: support.directional_support(C(s, d), 3600, False))
register("j10_ring_support", "SELECT qid, cand, " + ", ".join(f"{_win(-b, b, 'cand, src')} - {_win(-a, a, 'cand, src')} AS ring_{i}" for i, (a, b) in enumerate(zip(support.RINGS, support.RINGS[1:], strict=False))) + " FROM occ", "occ")(lambda s, d: support.ring_support(C(s, d)))
register("j11_consensus", "SELECT o.qid, o.cand, s.n AS sources, t.n AS times, s.r - 1 AS rows FROM occ o JOIN (SELECT cand, count(DISTINCT src) AS n, count(*) AS r FROM occ GROUP BY cand) s USING (cand) JOIN (SELECT cand, time, count(*) OVER (PARTITION BY cand ORDER BY time RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) AS n FROM (SELECT DISTINCT cand, time FROM occ)) t USING (cand, time)", "occ")(lambda s, d: support.consensus(C(s, d), 3600))


def _day_cands(s: SparkSession, d: str) -> DataFrame:
    """Cells with times cut to the hour, so that rows share their times."""
    return C(s, d).withColumn("time", F.floor(F.col("time") / 3600) * 3600)


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
register(
    "j12_community_presence", "SELECT c.qid, c.col, c.cand FROM cands c WHERE (c.qid, c.cand) IN (SELECT (qa, cand) FROM good UNION SELECT (qb, cand) FROM good)", "occ",
    ctes=f"hocc AS (SELECT qid, src, time // 3600 AS time, cand FROM occ), pairs AS (SELECT x.cand, x.qid AS qa, y.qid AS qb, round({_COS}, 9) AS cs FROM hocc x JOIN hocc y ON x.time = y.time AND x.cand = y.cand AND x.qid < y.qid AND x.src <> y.src JOIN embeddings a ON a.vec_id = x.src JOIN embeddings b ON b.vec_id = y.src), good AS (SELECT * FROM pairs WHERE cs >= (SELECT quantile_cont(cs, 0.9) FROM pairs))",
)(lambda s, d: support.community_presence(_day_cands(s, d), frames.vectors(s, d)))
_DOT = "list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_UV = "FROM cands c LEFT JOIN embeddings u ON u.vec_id = c.src LEFT JOIN embeddings v ON v.vec_id = c.cand * 7"
_items = frames.item_vectors
register("j13_embedding_score", f"SELECT qid, col, cand, CASE WHEN ps.n IS NOT NULL THEN -20 WHEN u.vec_id IS NULL OR v.vec_id IS NULL THEN -12 ELSE {_DOT} END AS score {_UV} LEFT JOIN ps ON ps.src = c.src AND ps.dst = c.cand", "cands", "stats", doubles="score")(lambda s, d: features.embedding_score(C(s, d), frames.vectors(s, d), _items(s, d), H(s, d)))
register("j14_mf_score", f"SELECT qid, col, cand, coalesce({_DOT}, 0) AS score {_UV}", "cands", doubles="score")(lambda s, d: features.mf_score(C(s, d), frames.vectors(s, d), _items(s, d)))
_some = lambda s, d: H(s, d).where("dst % 3 <> 1")
register("j15_cold_pool", "SELECT CAST(r.range AS BIGINT) AS dst FROM range((SELECT min(dst) FROM hist WHERE dst % 3 <> 1), (SELECT max(dst) + 1 FROM hist WHERE dst % 3 <> 1)) r WHERE r.range NOT IN (SELECT dst FROM hist WHERE dst % 3 <> 1)", "hist")(lambda s, d: features.cold_pool(_some(s, d)))
_SEG = "segs AS (SELECT c.qid, " + ", ".join(
    f"CAST(coalesce({e}, FALSE) AS INTEGER) AS {n}"
    for n, e in (("src_warm", "ss.n IS NOT NULL"), ("src_cold", "ss.n IS NULL"), ("src_hot", "ss.n >= hs.hot"), ("dst_warm", "ds.n IS NOT NULL"), ("dst_cold", "ds.n IS NULL"), ("dst_hot", "ds.n >= hd.hot"), ("dst_tail", "ds.n < hd.hot"), ("pair_seen", "ps.n IS NOT NULL"), ("pair_new", "ps.n IS NULL"))
) + " FROM cands c LEFT JOIN ss ON ss.src = c.src LEFT JOIN ds ON ds.dst = c.cand LEFT JOIN ps ON ps.src = c.src AND ps.dst = c.cand, (SELECT greatest(1, ceil(quantile_cont(n, 0.8))) AS hot FROM ss) hs, (SELECT greatest(1, ceil(quantile_cont(n, 0.8))) AS hot FROM ds) hd WHERE c.is_pos)"


def segments(s: SparkSession, d: str) -> DataFrame:
    h = H(s, d)
    return features.segments_of(C(s, d), h, stats.hot_threshold(stats.src_stats(h), "src_cnt"), stats.hot_threshold(stats.dst_stats(h), "dst_cnt"))


register("j16_segments", "SELECT * FROM segs", "cands", "stats", ctes=_SEG)(segments)

# 2.5 graph features

_OUTIN = "ro AS (SELECT DISTINCT src AS k, dst AS o FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 64), ri AS (SELECT DISTINCT dst AS k, src AS o FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 64)"
register("g1_recent_neighbors", "SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY r) AS outs FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 64 GROUP BY src", "hist")(lambda s, d: graph.recent_neighbors(H(s, d))[0].select("src", F.array_join("outs", ",").alias("outs")))
_LISTS = _OUTIN + ", lo AS (SELECT k, list(o) AS l FROM ro GROUP BY k), li AS (SELECT k, list(o) AS l FROM ri GROUP BY k), cell AS (SELECT src, cand, coalesce(uo.l, []) AS uo, coalesce(ui.l, []) AS ui, coalesce(vo.l, []) AS vo, coalesce(vi.l, []) AS vi FROM (SELECT DISTINCT src, cand FROM cands) c LEFT JOIN lo uo ON uo.k = c.src LEFT JOIN li ui ON ui.k = c.src LEFT JOIN lo vo ON vo.k = c.cand LEFT JOIN li vi ON vi.k = c.cand), over AS (SELECT src, cand, CAST(list_contains(vi, src) AS INTEGER) AS in_hit, CAST(len(list_intersect(uo, vi)) AS INTEGER) AS two_hop, CAST(len(list_intersect(uo, vo)) AS INTEGER) AS out_out, CAST(len(list_intersect(ui, vi)) AS INTEGER) AS in_in, len(list_intersect(uo, vi))::DOUBLE / sqrt((len(uo) + 1.0::DOUBLE) * (len(vi) + 1)) AS two_hop_norm FROM cell)"
register("g2_overlap_features", "SELECT qid, col, cand, in_hit, two_hop, out_out, in_in, two_hop_norm FROM cands JOIN over USING (src, cand)", "cands", ctes=_LISTS, doubles="two_hop_norm")(lambda s, d: graph.overlap_features(C(s, d), H(s, d)))
_CF = _OUTIN + """, cell AS (SELECT DISTINCT src, cand FROM cands),
cw AS (SELECT x.k AS w, y.k AS v, count(*) AS c FROM ri x JOIN ri y ON x.o = y.o GROUP BY ALL), cz AS (SELECT x.k AS z, y.k AS u, count(*) AS c FROM ro x JOIN ro y ON x.o = y.o GROUP BY ALL),
im AS (SELECT c.src, c.cand, CAST(sum(cw.c) AS BIGINT) AS item_sum, max(cw.c) AS item_max FROM cell c JOIN ro ON ro.k = c.src JOIN cw ON cw.w = ro.o AND cw.v = c.cand GROUP BY ALL),
us AS (SELECT c.src, c.cand, CAST(sum(cz.c) AS BIGINT) AS user_sum, max(cz.c) AS user_max FROM cell c JOIN ri ON ri.k = c.cand JOIN cz ON cz.z = ri.o AND cz.u = c.src GROUP BY ALL), sz AS (SELECT k, count(*) AS n FROM ro GROUP BY k), vz AS (SELECT k, count(*) AS n FROM ri GROUP BY k)"""
register(
    "g3_cf_overlap",
    "SELECT qid, col, cand, ln(1.0::DOUBLE + coalesce(item_sum, 0)) AS item_sum, ln(1.0::DOUBLE + coalesce(item_max, 0)) AS item_max, "
    "coalesce(item_sum, 0)::DOUBLE / ((coalesce(sz.n, 0) + 1) * sqrt(coalesce(vz.n, 0) + 1.0::DOUBLE)) AS item_norm, "
    "ln(1.0::DOUBLE + coalesce(user_sum, 0)) AS user_sum, ln(1.0::DOUBLE + coalesce(user_max, 0)) AS user_max "
    "FROM cands c LEFT JOIN im USING (src, cand) LEFT JOIN us USING (src, cand) LEFT JOIN sz ON sz.k = c.src LEFT JOIN vz ON vz.k = c.cand",
    "cands", ctes=_CF, doubles="item_sum item_max item_norm user_sum user_max",
)(lambda s, d: graph.cf_overlap(C(s, d), H(s, d)))
_SIGN = f"CASE WHEN {draw('o', 'd', 11)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END"
_SK = _OUTIN + f""", dm AS (SELECT range AS d FROM range(64)),
so AS (SELECT k, d, sum({_SIGN}) AS s FROM ro, dm GROUP BY ALL), si AS (SELECT k, d, sum({_SIGN}) AS s FROM ri, dm GROUP BY ALL),
pu AS (SELECT ro.k, si.d, sum(si.s) AS s FROM ro JOIN si ON si.k = ro.o GROUP BY ALL), pv AS (SELECT ri.k, so.d, sum(so.s) AS s FROM ri JOIN so ON so.k = ri.o GROUP BY ALL),
cell AS (SELECT DISTINCT src, cand FROM cands),
it AS (SELECT c.src, c.cand, greatest(sum(pu.s * si.s) / 64, 0) AS e FROM cell c JOIN pu ON pu.k = c.src JOIN si ON si.k = c.cand AND si.d = pu.d GROUP BY ALL),
ut AS (SELECT c.src, c.cand, greatest(sum(so.s * pv.s) / 64, 0) AS e FROM cell c JOIN so ON so.k = c.src JOIN pv ON pv.k = c.cand AND pv.d = so.d GROUP BY ALL),
du AS (SELECT k, count(*) AS n FROM ro GROUP BY k), dv AS (SELECT k, count(*) AS n FROM ri GROUP BY k),
es AS (SELECT qid, col, cand, coalesce(it.e, 0) AS i, coalesce(ut.e, 0) AS u, coalesce(du.n, 0) + 1.0::DOUBLE AS a, coalesce(dv.n, 0) + 1.0::DOUBLE AS b
  FROM cands c LEFT JOIN it USING (src, cand) LEFT JOIN ut USING (src, cand) LEFT JOIN du ON du.k = c.src LEFT JOIN dv ON dv.k = c.cand)"""
register(
    "g4_cf_sketch",
    "SELECT qid, col, cand, ln(1 + i) AS item_log, i / (a * sqrt(b)) AS item_norm, ln(1 + u) AS user_log, u / (b * sqrt(a)) AS user_norm, ln(1 + i + u) AS both_log FROM es",
    "cands", ctes=_SK, doubles="item_log item_norm user_log user_norm both_log",
)(lambda s, d: graph.cf_sketch(C(s, d), H(s, d)))
_ACT = ", ".join([
    f"{log1p('coalesce(ps.n, 0)')} AS pair_log", f"CASE WHEN ps.n IS NULL THEN 0 ELSE {recency('c.time - ps.last')} END AS pair_gap",
    f"{log1p('coalesce(rp.n, 0)')} AS back_log", f"CASE WHEN rp.n IS NULL THEN 0 ELSE {recency('c.time - rp.last')} END AS back_gap",
    f"{log1p('coalesce(ss.n, 0)')} AS src_log", f"{log1p('coalesce(ds.n, 0)')} AS dst_log",
    f"CASE WHEN ss.n IS NULL THEN 0 ELSE {recency('c.time - ss.last')} END AS src_gap", f"CASE WHEN ds.n IS NULL THEN 0 ELSE {recency('c.time - ds.last')} END AS dst_gap",
    f"{log1p('count(*) OVER (PARTITION BY c.cand)')} AS pool_freq",
    f"CASE WHEN count(*) OVER (PARTITION BY c.src, c.cand) > 1 THEN {log1p('count(*) OVER (PARTITION BY c.src, c.cand)')} ELSE 0 END AS src_freq",
])
_FROM = "FROM cands c LEFT JOIN ps ON ps.src = c.src AND ps.dst = c.cand LEFT JOIN ps rp ON rp.src = c.cand AND rp.dst = c.src LEFT JOIN ss ON ss.src = c.src LEFT JOIN ds ON ds.dst = c.cand"
_BASE = _LISTS + f""", rt AS (SELECT src, dst, max(r) - 1 AS at FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 64 GROUP BY ALL),
b AS (SELECT qid, col, c.cand, {_ACT}, CAST(rt.at IS NOT NULL AS INTEGER) AS recent, coalesce(exp(-rt.at / 8.0::DOUBLE), 0) AS recent_decay, CAST(c.src = c.cand AS INTEGER) AS self_loop,
  {log1p('coalesce(vs.n, 0)')} AS as_src_log, CASE WHEN vs.n IS NULL THEN 0 ELSE {recency('c.time - vs.last')} END AS as_src_gap,
  {log1p('least(coalesce(vs.n, 0), 64)')} AS out_log, {log1p('least(coalesce(ds.n, 0), 64)')} AS in_log,
  in_hit, ln(1.0::DOUBLE + two_hop) AS two_hop, ln(1.0::DOUBLE + out_out) AS out_out, ln(1.0::DOUBLE + in_in) AS in_in, two_hop_norm
  {_FROM} LEFT JOIN ss vs ON vs.src = c.cand LEFT JOIN rt ON rt.src = c.src AND rt.dst = c.cand JOIN over o ON o.src = c.src AND o.cand = c.cand)"""
register(
    "g5_base_features",
    "SELECT *, 3 * pair_log + 2 * pair_gap + 1.4::DOUBLE * recent_decay + 1.1::DOUBLE * in_hit + 1.4::DOUBLE * two_hop + 0.8::DOUBLE * out_out + 0.7::DOUBLE * in_in "
    "+ 0.9::DOUBLE * back_log + 0.45::DOUBLE * dst_log + 0.35::DOUBLE * pool_freq + 0.75::DOUBLE * src_freq AS hand FROM b",
    "cands", "stats", ctes=_BASE,
    doubles="pair_log pair_gap src_log dst_log src_gap dst_gap back_log back_gap recent_decay pool_freq as_src_log as_src_gap out_log in_log src_freq two_hop out_out in_in two_hop_norm hand",
)(lambda s, d: graph.base_features(C(s, d), H(s, d)))
_AFF = "ln(1.0::DOUBLE + CASE WHEN ts.l IS NULL THEN 1 ELSE {} * coalesce({}.n::DOUBLE / ds.n, 0) END)"
register(
    "g6_periodicity",
    "SELECT qid, col, CASE WHEN ps.n > 1 AND ps.last > ps.first THEN 1 / (1 + abs(greatest(c.time - ps.last, 0) / ((ps.last - ps.first)::DOUBLE / (ps.n - 1)) - 1)) ELSE 0 END AS interval_fit, "
    "CAST(coalesce(ps.n > 1 AND ps.last > ps.first, FALSE) AS INTEGER) AS has_interval, "
    f"{_AFF.format(24, 'hh')} AS hour_affinity, {_AFF.format(7, 'hd')} AS dow_affinity, "
    "coalesce(len(list_filter(ts.l, lambda t: c.time - t BETWEEN 0 AND 86400)) / 64.0::DOUBLE, 0) AS within_1d, coalesce(len(list_filter(ts.l, lambda t: c.time - t BETWEEN 0 AND 604800)) / 64.0::DOUBLE, 0) AS within_7d "
    "FROM cands c LEFT JOIN ps ON ps.src = c.src AND ps.dst = c.cand LEFT JOIN ds ON ds.dst = c.cand LEFT JOIN hh ON hh.dst = c.cand AND hh.h = (c.time % 86400) // 3600 LEFT JOIN hd ON hd.dst = c.cand AND hd.h = (c.time // 86400) % 7 LEFT JOIN ts ON ts.dst = c.cand",
    "cands", "stats", doubles="interval_fit hour_affinity dow_affinity within_1d within_7d",
    ctes="hh AS (SELECT dst, (time % 86400) // 3600 AS h, count(*) AS n FROM hist GROUP BY ALL), hd AS (SELECT dst, (time // 86400) % 7 AS h, count(*) AS n FROM hist GROUP BY ALL), ts AS (SELECT dst, list(time) AS l FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 64 GROUP BY dst)",
)(lambda s, d: features.periodicity(C(s, d), H(s, d)))


def props(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Source and item vectors and their one-hop means."""
    h, users, items = H(s, d), frames.vectors(s, d), _items(s, d)
    return users, items, graph.propagate(h, items, "src", "dst", 64), graph.propagate(h, users, "dst", "src", 64)


_DP = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])), 0)"
_PROP = "un AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), im AS (SELECT id // 7 AS id, v FROM un WHERE id % 7 = 0), " + ", ".join(
    f"{n}0 AS (SELECT h.{k} AS id, f.i, avg(f.x) AS x FROM hist h JOIN (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM {t}) f ON f.id = h.{o} GROUP BY ALL), {n} AS (SELECT id, list(x ORDER BY i) AS v FROM {n}0 GROUP BY id)" for n, k, o, t in (("pu", "src", "dst", "im"), ("pv", "dst", "src", "un"))
) + f""", dots AS (SELECT c.src, c.cand, {_DP.format(a='pu.v', b='iv.v')} AS x1, {_DP.format(a='uv.v', b='pv.v')} AS x2, {_DP.format(a='pu.v', b='pv.v')} AS x3
  FROM (SELECT DISTINCT src, cand FROM cands) c LEFT JOIN un uv ON uv.id = c.src LEFT JOIN im iv ON iv.id = c.cand LEFT JOIN pu ON pu.id = c.src LEFT JOIN pv ON pv.id = c.cand),
s AS (SELECT qid, col, cand, {z('x1')} AS s1, {z('x2')} AS s2, {z('x3')} AS s3 FROM cands JOIN dots USING (src, cand) WINDOW q AS (PARTITION BY qid)),
pp AS (SELECT qid, col, cand, s1, s2, s3, {z('(s1 + s2 + 0.5::DOUBLE * s3)')} AS prop FROM s WINDOW q AS (PARTITION BY qid))"""
register("g7_fast_features", f"SELECT f.*, prop, s1, s2, s3 FROM (SELECT qid, col, c.cand, {_ACT} {_FROM}) f JOIN pp USING (qid, col)", "cands", "stats", ctes=_PROP, doubles="pair_log pair_gap back_log back_gap src_log dst_log src_gap dst_gap pool_freq src_freq prop s1 s2 s3")(lambda s, d: (lambda u, v, pu, pv: graph.fast_features(C(s, d), H(s, d), u, v, pu, pv))(*props(s, d)))
register("g8_propagate", "SELECT h.dst AS id, avg(CAST(e.embedding[1] AS DOUBLE)) AS x0, avg(CAST(e.embedding[64] AS DOUBLE)) AS x63 FROM hist h JOIN embeddings e ON e.vec_id = h.src GROUP BY h.dst", "hist", doubles="x0 x63")(lambda s, d: graph.propagate(H(s, d), frames.vectors(s, d), "dst", "src", 64).select("id", F.col("vec")[0].alias("x0"), F.col("vec")[63].alias("x63")))
register("g9_prop_score", "SELECT qid, col, cand, prop FROM pp", "cands", ctes=_PROP, doubles="prop")(lambda s, d: (lambda u, v, pu, pv: graph.prop_score(C(s, d), u, v, pu, pv))(*props(s, d)))
_RP3 = """fq AS (SELECT src, dst, count(*)::DOUBLE AS f FROM hist GROUP BY ALL), dn AS (SELECT src, sum(f) AS d FROM fq GROUP BY src), di AS (SELECT dst, sum(f) AS d FROM fq GROUP BY dst),
un AS (SELECT a.src AS u, b.src AS n, sum(a.f * b.f) AS c, sum(a.f * b.f / (di.d * dn.d)) AS w FROM fq a JOIN fq b ON a.dst = b.dst AND a.src <> b.src JOIN di ON di.dst = a.dst JOIN dn ON dn.src = b.src GROUP BY ALL),
walk AS (SELECT c.src, c.cand, ln(1 + sum(un.c * v.f)) AS rp3_log, sum(un.w * v.f) / pow(any_value(di.d), 0.5) AS rp3 FROM (SELECT DISTINCT src, cand FROM cands) c JOIN fq v ON v.dst = c.cand JOIN un ON un.u = c.src AND un.n = v.src JOIN di ON di.dst = c.cand GROUP BY ALL)"""
register("g10_rp3", "SELECT qid, col, cand, coalesce(rp3_log, 0) AS rp3_log, coalesce(rp3, 0) AS rp3 FROM cands LEFT JOIN walk USING (src, cand)", "cands", ctes=_RP3, doubles="rp3_log rp3")(lambda s, d: graph.rp3(C(s, d), H(s, d)))
_NS = """pr AS (SELECT src, dst, max(time) AS last FROM hist GROUP BY ALL), dg AS (SELECT src, count(*) AS n FROM pr GROUP BY src), wd AS (SELECT dst, count(*) AS n FROM pr GROUP BY dst), cell AS (SELECT DISTINCT src, cand FROM cands),
lt AS (SELECT dst, src AS n, row_number() OVER (PARTITION BY dst ORDER BY last DESC, src) AS r FROM pr),
nr AS (SELECT c.src, c.cand, lt.n FROM cell c JOIN lt ON lt.dst = c.cand AND lt.n <> c.src WHERE lt.r <= 32),
cm AS (SELECT a.src AS u, b.src AS n, count(*) AS c, sum(1 / sqrt(wd.n + 1.0::DOUBLE)) AS rare FROM pr a JOIN pr b ON a.dst = b.dst AND a.src <> b.src JOIN wd ON wd.dst = a.dst GROUP BY ALL),
xx AS (SELECT nr.src, nr.cand, cm.c, cm.rare, cm.c / sqrt(x.n::DOUBLE * y.n) AS cs, cm.c::DOUBLE / (x.n + y.n - cm.c) AS jac, row_number() OVER (PARTITION BY nr.src, nr.cand ORDER BY cm.c / sqrt(x.n::DOUBLE * y.n) DESC, nr.n) AS k FROM nr JOIN cm ON cm.u = nr.src AND cm.n = nr.n JOIN dg x ON x.src = nr.src JOIN dg y ON y.src = nr.n),
ag AS (SELECT src, cand, max(cs) AS max_cos, max(jac) AS max_jac, sum(cs) FILTER (WHERE k <= 3) AS top3, max(rare) AS max_rare, ln(1.0::DOUBLE + count(*) FILTER (WHERE c >= 2)) AS log_near FROM xx GROUP BY ALL)"""
register("g11_neighbor_similarity", "SELECT qid, col, cand, coalesce(max_cos, 0) AS max_cos, coalesce(max_jac, 0) AS max_jac, coalesce(top3, 0) AS top3, coalesce(max_rare, 0) AS max_rare, coalesce(log_near, 0) AS log_near FROM cands LEFT JOIN ag USING (src, cand)", "cands", ctes=_NS, doubles="max_cos max_jac top3 max_rare log_near")(lambda s, d: graph.neighbor_similarity(C(s, d), H(s, d)))
_SG = "lg AS (SELECT dst AS i, time, " + ", ".join(f"lag(dst, {k}) OVER w AS d{k}, time - lag(time, {k}) OVER w AS g{k}" for k in range(1, 5)) + " FROM hist WINDOW w AS (PARTITION BY src ORDER BY time, seq)), one AS (" + " UNION ALL ".join(f"SELECT i, d{k} AS j FROM lg WHERE g{k} BETWEEN 0 AND {6 * 3600}" for k in range(1, 5)) + "), sg AS (SELECT i, j, count(*) AS cnt FROM (SELECT i, j FROM one UNION ALL SELECT j, i FROM one) GROUP BY ALL)"
register("g12_session_graph", "SELECT * FROM sg", "hist", ctes=_SG)(lambda s, d: graph.session_graph(H(s, d), 4, 6 * 3600))
_SF = _SG + f""", fr AS (SELECT dst, greatest(count(*), 1)::DOUBLE AS n FROM hist GROUP BY dst), ww AS (SELECT sg.i, sg.j, ln(1.0::DOUBLE + cnt) AS a, ln(1 + 1e4 * cnt / sqrt(x.n * y.n)) AS b FROM sg JOIN fr x ON x.dst = sg.i JOIN fr y ON y.dst = sg.j),
l8 AS (SELECT src, dst AS i, r - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, seq DESC) AS r FROM hist) WHERE r <= 8),
sa AS (SELECT c.src, c.cand, sum(pow(0.72, pos) * a) AS ra, max(a) AS rm, sum(pow(0.72, pos) * b) AS na, max(b) AS nm FROM (SELECT DISTINCT src, cand FROM cands) c JOIN l8 ON l8.src = c.src JOIN ww ON ww.i = l8.i AND ww.j = c.cand GROUP BY ALL),
sz AS (SELECT qid, col, cand, CAST(ra IS NOT NULL AS INTEGER) AS hit, coalesce(ra, 0) AS ra, coalesce(rm, 0) AS rm, coalesce(na, 0) AS na, coalesce(nm, 0) AS nm FROM cands LEFT JOIN sa USING (src, cand)),
sq AS (SELECT qid, col, cand, hit, {z('ra')} AS raw_sum, {z('rm')} AS raw_max, {z('na')} AS norm_sum, {z('nm')} AS norm_max FROM sz WINDOW q AS (PARTITION BY qid))"""
register(
    "g13_session_features", f"SELECT *, {z('(raw_sum + norm_max)')} AS hybrid FROM sq WINDOW q AS (PARTITION BY qid)", "cands", ctes=_SF, doubles="raw_sum raw_max norm_sum norm_max hybrid",
)(lambda s, d: (lambda h: graph.session_features(C(s, d), graph.session_graph(h, 4, 6 * 3600), stats.dst_stats(h), features.history_asof(T(s, d), h, 8)))(H(s, d)))


def gcn_nodes(s: SparkSession, d: str) -> DataFrame:
    return frames.vectors(s, d).select("id", F.transform("vec", lambda x: x.cast("double") + 1.0).alias("features"))


_GCN = """two AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM hist UNION ALL SELECT dst, src FROM hist) WHERE src <> dst AND src IN (SELECT vec_id FROM embeddings) AND dst IN (SELECT vec_id FROM embeddings)), adj AS (SELECT * FROM two UNION ALL SELECT vec_id, vec_id FROM embeddings), deg AS (SELECT src, count(*) AS d FROM adj GROUP BY src),
ww AS (SELECT a.src, a.dst, 1 / sqrt(x.d::DOUBLE * y.d) AS w FROM adj a JOIN deg x ON x.src = a.src JOIN deg y ON y.src = a.dst),
n0 AS (SELECT vec_id AS id, (CAST(embedding[1] AS DOUBLE) + 1) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1)) AS x FROM embeddings), n1 AS (SELECT ww.dst AS id, sum(w * x) AS x FROM ww JOIN n0 ON n0.id = ww.src GROUP BY ww.dst), n2 AS (SELECT ww.dst AS id, sum(w * x) AS x FROM ww JOIN n1 ON n1.id = ww.src GROUP BY ww.dst)"""
register("g14_gcn_propagate", "SELECT id, x AS x0 FROM n2", "hist", ctes=_GCN, doubles="x0")(lambda s, d: graph.gcn_propagate(gcn_nodes(s, d), H(s, d), 64).select("id", F.col("vec")[0].alias("x0")))

# 2.6 windows

_Q = " WINDOW q AS (PARTITION BY qid)"
for _mode, _down in (("add", "stddev_pop(a) OVER q + 1e-6"), ("max", "greatest(stddev_pop(a) OVER q, 1e-6)"), ("sqrt", "sqrt(pow(stddev_pop(a) OVER q, 2) + 1e-6)")):
    register(f"w1_qnorm_{_mode}", f"SELECT qid, col, (a - avg(a) OVER q) / ({_down}) AS a FROM scored{_Q}", "scored", doubles="a")(lambda s, d, m=_mode: rank.qnorm(S(s, d).select("qid", "col", "a"), ["a"], m))
_PCT = "(row_number() OVER (PARTITION BY qid ORDER BY score, col) - 1)::DOUBLE"
register("w2_rank_pct", f"SELECT qid, col, {_PCT} / (count(*) OVER (PARTITION BY qid) - 1) AS pct FROM scored", "scored", doubles="pct")(lambda s, d: rank.rank_pct(S(s, d), "score").select("qid", "col", "pct"))
register("w2_rank_pct_average", f"SELECT qid, col, avg(r) OVER (PARTITION BY qid, score) / (count(*) OVER (PARTITION BY qid) - 1) AS pct FROM (SELECT *, {_PCT} AS r FROM scored)", "scored", doubles="pct")(lambda s, d: rank.rank_pct(S(s, d), "score", "average").select("qid", "col", "pct"))
register("w3_query_expand", f"SELECT qid, col, a, (row_number() OVER (PARTITION BY qid ORDER BY a, col) - 1)::DOUBLE / (count(*) OVER q - 1) AS a_rank, {z('a')} AS a_z FROM scored{_Q}", "scored", doubles="a a_rank a_z")(lambda s, d: rank.query_expand(S(s, d).select("qid", "col", "a"), ["a"]))
_POS = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, col)"
register("w4_strict_slots", f"SELECT qid, col, CAST({_POS} - 1 AS INTEGER) AS position, 1 - ({_POS} - 1)::DOUBLE / (count(*) OVER (PARTITION BY qid) - 1) AS slot FROM scored", "scored", doubles="slot")(lambda s, d: rank.strict_slots(S(s, d)).select("qid", "col", "position", "slot"))
register("w5_softmax", f"SELECT qid, col, exp(score - m) / sum(exp(score - m)) OVER q AS prob FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM scored){_Q}", "scored", doubles="prob")(lambda s, d: rank.softmaxed(S(s, d)).select("qid", "col", "prob"))
_M = "mm AS (SELECT *, max(CASE WHEN r = 1 THEN score END) OVER q AS s1, max(CASE WHEN r = 2 THEN score END) OVER q AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, col) AS r FROM scored) WINDOW q AS (PARTITION BY qid))"
register("w6_margins", "SELECT qid, col, s1 - score AS from_top, score - CASE WHEN r = 1 THEN s2 ELSE s1 END AS winner_gap, s1 - s2 AS margin FROM mm", "scored", ctes=_M, doubles="from_top winner_gap margin")(lambda s, d: rank.margins(S(s, d)).select("qid", "col", "from_top", "winner_gap", "margin"))
_BC = f"(time - (SELECT min(time) FROM cands) + {{}}) // {7 * DAY}"
_BN = "ln(1.0::DOUBLE + count(*) OVER (PARTITION BY {}, cand))"
register(
    "w7_bucket_count", f"SELECT qid, col, cand, ({z('n0')} + {z('n1')}) / 2 AS bucket_count FROM (SELECT *, {_BN.format(_BC.format(0))} AS n0, {_BN.format(_BC.format(3 * DAY))} AS n1 FROM cands) WINDOW q AS (PARTITION BY qid)",
    "cands", doubles="bucket_count",
)(lambda s, d: support.bucket_count(C(s, d), 7))
register("w8_source_bucket_count", f"SELECT qid, col, cand, count(*) OVER (PARTITION BY src, {_BC.format(0)}, cand) AS source_bucket_count FROM cands", "cands")(lambda s, d: support.source_bucket_count(C(s, d), 7))
_RC = {"around_2": (2, 2), "past_3": (3, 0), "future_3": (0, 3)}
_AGE = "(time - (SELECT min(time) FROM cands)) // 86400"
register(
    "w9_rolling_count", "SELECT qid, col, cand, " + ", ".join(f"{z(n)} AS {n}" for n in _RC) + " FROM (SELECT c.qid, c.col, c.cand, " + ", ".join(f"ln(1.0::DOUBLE + d.{n}) AS {n}" for n in _RC) + f" FROM (SELECT *, {_AGE} AS day FROM cands) c JOIN rolled d USING (cand, day)) WINDOW q AS (PARTITION BY qid)",
    "cands", doubles=" ".join(_RC),
    ctes="rolled AS (SELECT cand, day, " + ", ".join(f"sum(n) OVER (PARTITION BY cand ORDER BY day RANGE BETWEEN {b} PRECEDING AND {a} FOLLOWING) AS {n}" for n, (b, a) in _RC.items()) + f" FROM (SELECT cand, {_AGE} AS day, count(*) AS n FROM cands GROUP BY ALL))",
)(lambda s, d: support.rolling_count(C(s, d), _RC))
register("w10_nearest_repeat", "SELECT c.qid, c.col, c.cand, coalesce(1 / (1 + ln(1.0::DOUBLE + g.gap)), 0) AS repeat FROM cands c LEFT JOIN (SELECT qid, cand, least(time - lag(time) OVER w, lead(time) OVER w - time) AS gap FROM occ WINDOW w AS (PARTITION BY src, cand ORDER BY time, qid)) g USING (qid, cand)", "occ", doubles="repeat")(lambda s, d: support.nearest_repeat(C(s, d)))
register("w11_exact_group_support", "SELECT c.qid, c.col, c.cand, g.n AS group_support FROM cands c JOIN (SELECT qid, cand, count(*) OVER (PARTITION BY src, time // 3600, cand) - 1 AS n FROM occ) g USING (qid, cand)", "occ")(lambda s, d: support.exact_group_support(_day_cands(s, d)))
_W12 = "su AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, col) AS r FROM (SELECT qid, col, cand, count(*) OVER (PARTITION BY src, cand) AS support FROM cands)), sup AS (SELECT qid, col, cand, support, max(CASE WHEN r = 1 THEN col END) OVER q AS winner, max(CASE WHEN r = 1 THEN support END) OVER q AS top, max(CASE WHEN r = 1 THEN support END) OVER q - coalesce(max(CASE WHEN r = 2 THEN support END) OVER q, 0) AS lead FROM su WINDOW q AS (PARTITION BY qid))"
register("w12_source_support", "SELECT * FROM sup", "cands", ctes=_W12)(lambda s, d: support.source_support(C(s, d)))
_LOO = "lo AS (SELECT qid, col, cand, nr, cnt - 1.0::DOUBLE AS obs, width * (nr - 1)::DOUBLE * pool / total AS ex FROM (SELECT *, count(*) OVER (PARTITION BY qid) - 1 AS width, count(*) OVER (PARTITION BY cand) AS pool, count(*) OVER () AS total, count(*) OVER (PARTITION BY src, cand) AS cnt FROM cands) JOIN (SELECT src, count(DISTINCT qid) AS nr FROM cands GROUP BY src) USING (src)), lf AS (SELECT *, ln((obs + 0.5::DOUBLE) / (ex + 0.5::DOUBLE)) AS lift, sign(obs - ex) * sqrt(greatest(2 * ((obs + 0.5::DOUBLE) * ln((obs + 0.5::DOUBLE) / (ex + 0.5::DOUBLE)) - (obs - ex)), 0)) AS deviance FROM lo)"
register("w13_loo_calibration", "SELECT qid, col, cand, lift, deviance, CASE WHEN nr <= 20 THEN deviance ELSE 0 END AS band_0, CASE WHEN nr > 20 AND nr <= 30 THEN deviance ELSE 0 END AS band_1, CASE WHEN nr > 30 THEN deviance ELSE 0 END AS band_2 FROM lf", "cands", ctes=_LOO, doubles="lift deviance band_0 band_1 band_2")(lambda s, d: support.loo_calibration(C(s, d), (20, 30)))
register("w14_duplicate_rows", "SELECT qid, col, cand, dup_cell, max(dup_cell) OVER (PARTITION BY qid) AS dup_row FROM (SELECT *, CAST(count(*) OVER (PARTITION BY qid, cand) > 1 AS INTEGER) AS dup_cell FROM cands)", "cands")(lambda s, d: rank.duplicate_rows(C(s, d)).select("qid", "col", "cand", "dup_cell", "dup_row"))
_noisy = lambda s, d: S(s, d).withColumn("score", F.col("score") + F.col("col") / 100.0)
register("w14_canonicalize", "SELECT qid, col, cand, score, first_value(score) OVER (PARTITION BY qid, cand ORDER BY col) AS canon FROM (SELECT qid, col, cand, score + col / 100.0::DOUBLE AS score FROM scored)", "scored", doubles="score canon")(lambda s, d: rank.canonicalize(_noisy(s, d).withColumn("canon", F.col("score")), "canon").select("qid", "col", "cand", "score", "canon"))
register("w14_group_mean", "SELECT qid, col, cand, avg(score + col / 100.0::DOUBLE) OVER (PARTITION BY qid, cand) AS score FROM scored", "scored", doubles="score")(lambda s, d: rank.group_mean(_noisy(s, d), "score").select("qid", "col", "cand", "score"))
register("w15_distinct_occurrences", "SELECT * FROM occ", "occ")(lambda s, d: support.distinct_occurrences(C(s, d)))
def reordered(alpha: str) -> str:
    """CTE ``ro16``: each cell's position after unseen cells swapped their slots by score + alpha * a."""
    return f"k16 AS (SELECT *, row_number() OVER (PARTITION BY qid, seen ORDER BY score + {alpha}::DOUBLE * a DESC, col) AS bk, row_number() OVER (PARTITION BY qid, seen ORDER BY pos) AS bs FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, col) - 1 AS pos FROM scored)), ro16 AS (SELECT x.*, CAST(CASE WHEN x.seen = 1 THEN x.pos ELSE y.pos END AS INTEGER) AS position FROM k16 x JOIN k16 y ON x.qid = y.qid AND x.seen = y.seen AND y.bs = x.bk)"


register("w16_reorder_unseen", "SELECT qid, col, seen, position FROM ro16", "scored", ctes=reordered("0.8"))(lambda s, d: rank.reorder_unseen(S(s, d), "score", "a", 0.8).select("qid", "col", "seen", "position"))
register("w17_remap_slots", "SELECT x.qid, x.col, CASE WHEN x.seen = 1 THEN x.score ELSE y.score END AS mapped FROM rr x JOIN rr y ON y.qid = x.qid AND y.rb = x.rs", "scored", ctes="rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, col) AS rb, row_number() OVER (PARTITION BY qid ORDER BY a DESC, col) AS rs FROM scored)", doubles="mapped")(lambda s, d: rank.remap_slots(S(s, d), "score", "a", F.col("seen") == 1).select("qid", "col", "mapped"))
_UM = "um AS (SELECT *, sum(tied_max) OVER (PARTITION BY qid) AS ties FROM (SELECT *, CAST(coalesce(seen = 0 AND a = m AND m > 0, FALSE) AS INTEGER) AS tied_max FROM (SELECT *, max(CASE WHEN seen = 0 THEN a END) OVER (PARTITION BY qid) AS m FROM scored)))"
register("w18_unique_max", "SELECT qid, col, tied_max, CAST(ties AS BIGINT) AS ties, CAST(tied_max = 1 AND ties = 1 AS INTEGER) AS is_unique_max FROM um", "scored", ctes=_UM)(lambda s, d: rank.unique_max(S(s, d), "a", F.col("seen") == 0).select("qid", "col", "tied_max", "ties", "is_unique_max"))
register("w19_new_seen_gap", "SELECT qid, CASE WHEN o IS NULL THEN 4 WHEN n IS NULL THEN -4 ELSE greatest(least(n - o, 4), -4) END AS gap, seen_share FROM (SELECT qid, max(CASE WHEN seen = 0 THEN score END) AS n, max(CASE WHEN seen = 1 THEN score END) AS o, avg(seen) AS seen_share FROM scored GROUP BY qid)", "scored", doubles="gap seen_share")(lambda s, d: rank.new_seen_gap(S(s, d)))
register("w20_hard_negatives", "SELECT qid, col, CAST((seen = 0 AND rb <= 5) OR rg <= 3 OR is_pos AS INTEGER) AS hard FROM (SELECT *, row_number() OVER (PARTITION BY qid, seen ORDER BY score DESC, col) AS rb, row_number() OVER (PARTITION BY qid ORDER BY a DESC, col) AS rg FROM scored)", "scored")(lambda s, d: rank.hard_negatives(S(s, d), "score", "a", 5, 3).select("qid", "col", "hard"))
register("w21_topk", f"SELECT qid, col, cand, CAST(r AS INTEGER) AS position FROM (SELECT *, {_POS} AS r FROM scored) WHERE r <= 5", "scored")(lambda s, d: rank.topk(S(s, d), 5).select("qid", "col", "cand", "position"))
register("w22_family_stats", "SELECT qid, col, m AS family_mean, sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3) AS family_std FROM (SELECT *, (a + b + c) / 3 AS m FROM scored)", "scored", doubles="family_mean family_std")(lambda s, d: rank.family_stats(S(s, d), ["a", "b", "c"]).select("qid", "col", "family_mean", "family_std"))
