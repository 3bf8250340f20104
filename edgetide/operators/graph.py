"""Bipartite-graph features: neighbours, overlaps, short walks, sketches, session graphs and propagation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot, draw, recency
from .overlaps import Candidate, item_sets, met_by_candidate
from .rank import qnorm
from .stats import dst_stats, pair_stats, src_stats


def recent_edges(hist: DataFrame, key: str, cap: int) -> DataFrame:
    """The ``cap`` newest edges of each key, pos 0 the newest; the limit applies before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("time"), F.desc("seq"))
    return hist.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < cap)


def recent_neighbors(hist: DataFrame, cap: int = 64) -> tuple[DataFrame, DataFrame]:
    """(src, outs) and (dst, ins): neighbours newest first, repeats kept; the set is ``array_distinct``."""

    def side(key: str, other: str, name: str) -> DataFrame:
        got = recent_edges(hist, key, cap).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(other).alias("id")))).alias("l"))
        return got.select(key, F.transform("l", lambda x: x["id"]).alias(name))

    return side("src", "dst", "outs"), side("dst", "src", "ins")


def overlap_features(cands: DataFrame, hist: DataFrame, cap: int = 64) -> DataFrame:
    """in_hit, two_hop, out_out, in_in and the normalised two_hop, over neighbour sets in one id space.

    Sets meet once for each distinct (src, cand), source by source; only the numbers are joined back to the cells.
    """
    rows = cands.select("qid", "col", "src", "cand").join(pair_overlaps(cands.select("src", "cand").distinct(), hist, cap), ["src", "cand"])
    return rows.select("qid", "col", "cand", *_OVERLAPS)


_OVERLAPS = ("in_hit", "two_hop", "out_out", "in_in", "two_hop_norm")


def pair_overlaps(pairs: DataFrame, hist: DataFrame, cap: int = 64) -> DataFrame:
    """(src, cand, <the five of overlap_features>) of distinct ``pairs(src, cand)``."""
    outs, ins = recent_neighbors(hist, cap)
    outs, ins = outs.withColumn("outs", F.array_distinct("outs")), ins.withColumn("ins", F.array_distinct("ins"))
    nodes = outs.select(F.col("src").alias("id"), "outs").join(ins.select(F.col("dst").alias("id"), "ins"), "id", "full")
    none = F.array().cast("array<long>")
    side = lambda key, k: nodes.select(F.col("id").alias(key), F.coalesce("outs", none).alias(f"{k}_out"), F.coalesce("ins", none).alias(f"{k}_in"))
    pairs = pairs.select("src", "cand").join(side("src", "u"), "src", "left").join(side("cand", "v"), "cand", "left")
    pairs = pairs.select("src", "cand", *(F.coalesce(c, none).alias(c) for c in ("u_out", "u_in", "v_out", "v_in")))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    pairs = pairs.select(
        "src", "cand", F.array_contains("v_in", F.col("src")).cast("int").alias("in_hit"), both("u_out", "v_in").alias("two_hop"), both("u_out", "v_out").alias("out_out"), both("u_in", "v_in").alias("in_in"),
        F.sqrt((F.size("u_out") + 1.0) * (F.size("v_in") + 1.0)).alias("scale"),
    )
    return pairs.select("src", "cand", "in_hit", "two_hop", "out_out", "in_in", (F.col("two_hop") / F.col("scale")).alias("two_hop_norm"))


def _capped_pairs(hist: DataFrame, key: str, other: str, cap: int) -> DataFrame:
    return recent_edges(hist, key, cap).select(F.col(key).alias("k"), F.col(other).alias("o")).distinct()


def cf_overlap(cands: DataFrame, hist: DataFrame, cap: int = 64) -> DataFrame:
    """Five columns. item_sum, item_max (as log1p), item_norm: of |in(w) & in(v)| over the source's items w; user_sum, user_max (as log1p): of |out(z) & out(u)| over v's sources z.

    item_norm divides the plain sum by (|out(u)| + 1) * sqrt(|in(v)| + 1).

    |in(w) & in(v)| is counted once for each needed (w, v), from joins of capped neighbour lists. Sets of the sources z meet
    u's own in arrays, candidate by candidate (``overlaps``): pairs (z, u) grow with all sources, whatever the cap.
    """
    outs, ins = _capped_pairs(hist, "src", "dst", cap), _capped_pairs(hist, "dst", "src", cap)
    cells = cands.select("src", "cand").distinct()
    of = lambda df, k, o: df.select(F.col("k").alias(k), F.col("o").alias(o))
    pairs = cells.join(of(outs, "src", "w"), "src").select("w", "cand").distinct()
    common = pairs.join(of(ins, "w", "n"), "w").join(of(ins, "cand", "n"), ["cand", "n"]).groupBy("cand", F.col("w").alias("item")).agg(F.count("*").alias("value"))
    own = item_sets(outs)
    widths = ins.groupBy("k").agg(F.count("*").alias("size")).withColumnRenamed("k", "cand")
    sets = of(ins, "cand", "id").join(own.drop("size"), "id").join(widths, "cand")
    met = met_by_candidate(cells, own, sets, common, _cf_overlaps, "items long, sources long, item_sum double, item_max double, user_sum double, user_max double")
    size = (F.col("items") + 1.0) * F.sqrt(F.col("sources") + 1.0)
    met = met.select("src", "cand", F.log1p("item_sum").alias("item_sum"), F.log1p("item_max").alias("item_max"), (F.col("item_sum") / size).alias("item_norm"), F.log1p("user_sum").alias("user_sum"), F.log1p("user_max").alias("user_max"))
    rows = cands.select("qid", "col", "src", "cand").join(met, ["src", "cand"], "left")
    return rows.select("qid", "col", "cand", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("item_sum", "item_max", "item_norm", "user_sum", "user_max")))


def _cf_overlaps(candidate: Candidate, ids: np.ndarray, sizes: np.ndarray, run: np.ndarray, flat: np.ndarray) -> dict[str, np.ndarray]:
    n = len(ids)
    total, most = candidate.totals(n, run, flat)
    both, _ = candidate.common(n, run, flat)
    return {"items": sizes, "sources": np.full(n, candidate.sizes[0] if len(candidate.sizes) else 0), "item_sum": total, "item_max": most, "user_sum": both.sum(1), "user_max": both.max(1, initial=0.0)}


def _signs(id_: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.when(draw(id_, d, 11) % 2 == 0, 1.0).otherwise(-1.0))


def _array_sum(df: DataFrame, key: str, col: str, dim: int) -> DataFrame:
    """Elementwise sums of arrays by key: dim plain sums, which combine before the shuffle."""
    sums = df.groupBy(key).agg(*(F.sum(F.col(col)[d]).alias(f"d{d}") for d in range(dim)))
    return sums.select(key, F.array(*(F.col(f"d{d}") for d in range(dim))).alias(col))


def cf_sketch(cands: DataFrame, hist: DataFrame, cap: int = 64, dim: int = 64) -> DataFrame:
    """The same overlaps estimated from sign-hash sketches: dot products over dim, clipped at 0. Five columns: log1p and
    normalised item overlap, the same of user overlap, and log1p of both together.

    A node's sketch sums the signs of its neighbours; its profile sums its neighbours' sketches, so item_sum is
    one dot product for each distinct (src, cand) instead of a three-way join. Sums of signs are small whole numbers
    and go with the pairs as such; cells meet only the estimates.
    """
    outs, ins = _capped_pairs(hist, "src", "dst", cap), _capped_pairs(hist, "dst", "src", cap)
    signed = lambda df: _array_sum(df.select("k", _signs(F.col("o"), dim).alias("s")), "k", "s", dim)
    out_sketch, in_sketch = signed(outs), signed(ins)
    profile = lambda df, sk: _array_sum(df.join(sk.select(F.col("k").alias("o"), "s"), "o"), "k", "s", dim)
    items, users = profile(outs, in_sketch), profile(ins, out_sketch)
    pick = lambda df, k, name: df.select(F.col("k").alias(k), F.col("s").alias(name))
    degree = lambda df, k, name: df.groupBy("k").agg(F.count("*").alias(name)).withColumnRenamed("k", k)
    small = lambda df, *names: df.withColumns({n: F.col(n).cast("array<int>") for n in names})
    of_u = small(degree(outs, "src", "d_u").join(pick(items, "src", "p_u"), "src", "left").join(pick(out_sketch, "src", "s_u"), "src", "left"), "p_u", "s_u")
    of_v = small(degree(ins, "cand", "d_v").join(pick(in_sketch, "cand", "s_v"), "cand", "left").join(pick(users, "cand", "p_v"), "cand", "left"), "s_v", "p_v")
    pairs = cands.select("src", "cand").distinct().join(of_u, "src", "left").join(of_v, "cand", "left")
    est = lambda a, b: F.greatest(F.coalesce(dot(a, b) / dim, F.lit(0.0)), F.lit(0.0))
    pairs = pairs.select("src", "cand", est("p_u", "s_v").alias("item"), est("s_u", "p_v").alias("user"), *((F.coalesce(c, F.lit(0)) + 1.0).alias(c) for c in ("d_u", "d_v")))
    pairs = pairs.select("src", "cand", F.log1p("item").alias("item_log"), (F.col("item") / (F.col("d_u") * F.sqrt("d_v"))).alias("item_norm"), F.log1p("user").alias("user_log"), (F.col("user") / (F.col("d_v") * F.sqrt("d_u"))).alias("user_norm"), F.log1p(F.col("item") + F.col("user")).alias("both_log"))
    rows = cands.select("qid", "col", "src", "cand").join(pairs, ["src", "cand"], "left")
    return rows.select("qid", "col", "cand", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("item_log", "item_norm", "user_log", "user_norm", "both_log")))


def _pool_frequency(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cand, pool_freq): log1p of the candidate's cells, and (src, cand, src_freq): the same under one source, 0 for a single one."""
    freq = cands.groupBy("cand").agg(F.log1p(F.count("*")).alias("pool_freq"))
    own = cands.groupBy("src", "cand").agg(F.count("*").alias("__n")).select("src", "cand", F.when(F.col("__n") > 1, F.log1p("__n")).otherwise(0.0).alias("src_freq"))
    return freq, own


def _activity(cands: DataFrame, hist: DataFrame) -> tuple[DataFrame, Callable]:
    """The cells with counts and last times of the pair, the reverse pair, the source, the candidate as destination and as source; and the recency of such a column."""
    pair = pair_stats(hist)
    rows = cands.join(pair.select("src", F.col("dst").alias("cand"), F.col("pair_cnt").alias("pc"), F.col("pair_last").alias("pl")), ["src", "cand"], "left")
    rows = rows.join(pair.select(F.col("src").alias("cand"), F.col("dst").alias("src"), F.col("pair_cnt").alias("rc"), F.col("pair_last").alias("rl")), ["src", "cand"], "left")
    src = src_stats(hist)
    rows = rows.join(src.select("src", F.col("src_cnt").alias("sc"), F.col("src_last").alias("sl")), "src", "left")
    rows = rows.join(dst_stats(hist).select(F.col("dst").alias("cand"), F.col("dst_cnt").alias("dc"), F.col("dst_last").alias("dl")), "cand", "left")
    rows = rows.join(src.select(F.col("src").alias("cand"), F.col("src_cnt").alias("vc"), F.col("src_last").alias("vl")), "cand", "left")
    return rows, lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(recency(F.col("time") - F.col(c)))


def base_features(cands: DataFrame, hist: DataFrame, cap: int = 64) -> DataFrame:
    """The base ranker's 22 columns and the pool's ``src_freq``: counts and recencies of the pair, its reverse, both ends and
    the candidate as a source; whether and how far back the candidate is among the source's latest; neighbour lists and
    overlaps; pool frequency; and the hand-weighted score of all that.

    All but what depends on the query's time is looked up for distinct (src, cand), which the cells meet in one join."""
    pairs = cands.groupBy("src", "cand").agg(F.count("*").alias("own"))
    rows, gap = _activity(pairs, hist)
    lg = lambda c: F.log1p(F.coalesce(c, F.lit(0)))
    freq = pairs.groupBy("cand").agg(F.sum("own").alias("freq"))
    latest = recent_edges(hist, "src", cap)
    at = latest.groupBy("src", F.col("dst").alias("cand")).agg(F.max("pos").alias("at"))
    sizes = latest.groupBy(F.col("src").alias("cand")).agg(F.count("*").alias("n_out")), recent_edges(hist, "dst", cap).groupBy(F.col("dst").alias("cand")).agg(F.count("*").alias("n_in"))
    rows = rows.join(at, ["src", "cand"], "left").join(pair_overlaps(pairs, hist, cap), ["src", "cand"]).join(sizes[0], "cand", "left").join(sizes[1], "cand", "left").join(freq, "cand")
    rows = cands.select("qid", "time", "col", "src", "cand").join(rows, ["src", "cand"])
    rows = rows.select(
        "qid", "col", "cand", lg("pc").alias("pair_log"), gap("pl").alias("pair_gap"), lg("sc").alias("src_log"), lg("dc").alias("dst_log"), gap("sl").alias("src_gap"), gap("dl").alias("dst_gap"),
        lg("rc").alias("back_log"), gap("rl").alias("back_gap"), F.col("at").isNotNull().cast("int").alias("recent"), F.when(F.col("at").isNull(), 0.0).otherwise(F.exp(-F.col("at") / 8.0)).alias("recent_decay"),
        F.log1p("freq").alias("pool_freq"), (F.col("src") == F.col("cand")).cast("int").alias("self_loop"), lg("vc").alias("as_src_log"), gap("vl").alias("as_src_gap"), lg("n_out").alias("out_log"), lg("n_in").alias("in_log"),
        F.when(F.col("own") > 1, F.log1p("own")).otherwise(0.0).alias("src_freq"), *_OVERLAPS,
    )
    rows = rows.withColumns({c: F.log1p(c) for c in ("two_hop", "out_out", "in_in")})
    weights = {"pair_log": 3.0, "pair_gap": 2.0, "recent_decay": 1.4, "in_hit": 1.1, "two_hop": 1.4, "out_out": 0.8, "in_in": 0.7, "back_log": 0.9, "dst_log": 0.45, "pool_freq": 0.35, "src_freq": 0.75}
    return rows.withColumn("hand", sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def propagate(edges: DataFrame, vecs: DataFrame, key: str, other: str, dim: int) -> DataFrame:
    """(id, vec): mean of the other side's vectors, an edge as often as it occurs."""
    rows = edges.select(F.col(key).alias("id"), F.col(other).alias("o")).join(vecs.select(F.col("id").alias("o"), "vec"), "o")
    means = rows.groupBy("id").agg(*(F.avg(F.col("vec")[d].cast("double")).alias(f"d{d}") for d in range(dim)))
    return means.select("id", F.array(*(F.col(f"d{d}") for d in range(dim))).alias("vec"))


def prop_parts(cands: DataFrame, users: DataFrame, items: DataFrame, user_props: DataFrame, item_props: DataFrame) -> DataFrame:
    """s1, s2, s3: z(p_u . v), z(u . p_v), z(p_u . p_v), unknown vectors giving 0; prop: z of s1 + s2 + s3 / 2."""
    pick = lambda df, k, name: df.select(F.col("id").alias(k), F.col("vec").alias(name))
    rows = cands.select("qid", "col", "src", "cand").join(pick(users, "src", "u"), "src", "left").join(pick(user_props, "src", "pu"), "src", "left").join(pick(items, "cand", "v"), "cand", "left").join(pick(item_props, "cand", "pv"), "cand", "left")
    d = lambda a, b: F.coalesce(dot(a, b), F.lit(0.0))
    rows = qnorm(rows.select("qid", "col", "cand", d("pu", "v").alias("s1"), d("u", "pv").alias("s2"), d("pu", "pv").alias("s3")), ["s1", "s2", "s3"])
    return qnorm(rows.withColumn("prop", F.col("s1") + F.col("s2") + 0.5 * F.col("s3")), ["prop"])


def prop_score(cands: DataFrame, users: DataFrame, items: DataFrame, user_props: DataFrame, item_props: DataFrame) -> DataFrame:
    """z of z(p_u . v) + z(u . p_v) + .5 z(p_u . p_v)."""
    return prop_parts(cands, users, items, user_props, item_props).select("qid", "col", "cand", "prop")


def rp3(cands: DataFrame, hist: DataFrame, beta: float = 0.5, max_degree: int | None = None, heavy: int = 64) -> DataFrame:
    """Walks u -> i <- n -> v with n other than u: log1p of the count, and the degree-weighted walk over deg(v)^beta.

    Walks start from distinct (src, cand) cells; with a ``max_degree`` a candidate of more edges has none.
    Through an item of up to ``heavy`` sources, walks are folded to one row for each (u, n) and go on along n's own items, so
    that a candidate's in-edges never meet its cells. Through a heavier one no two sources meet: its walks to v are summed
    over n for each (i, v), a row for each item of each n, and u's own share is taken off afterwards. Joins grow with the
    edges of hubs, not with their squares.
    """
    freq = hist.groupBy("src", "dst").agg(F.count("*").cast("double").alias("f"))
    deg_n = freq.groupBy("src").agg(F.sum("f").alias("dn"))
    deg_i = freq.groupBy("dst").agg(F.sum("f").alias("di"), F.count("*").alias("sources"))
    ends = deg_i if max_degree is None else deg_i.where(F.col("di") <= max_degree)
    ends = ends.select(F.col("dst").alias("cand"), F.col("di").alias("dv"))
    cells = cands.select("src", "cand").distinct().join(ends, "cand", "left_semi").withColumnRenamed("src", "u")
    items = deg_i.select(F.col("dst").alias("i"), "di", (F.col("sources") > heavy).alias("hub"))
    first = freq.join(cells.select(F.col("u").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("i"), F.col("f").alias("fu")).join(items, "i")
    second = freq.join(deg_n, "src").select(F.col("src").alias("n"), F.col("dst").alias("i"), F.col("f").alias("fn"), "dn").join(items.select("i", "hub"), "i")
    into = freq.select(F.col("src").alias("n"), F.col("dst").alias("cand"), F.col("f").alias("fv"))

    to_n = first.where("not hub").drop("hub").join(second.where("not hub").drop("hub"), "i").where("u <> n").groupBy("u", "n").agg(F.sum(F.col("fu") * F.col("fn")).alias("c"), F.sum(F.col("fu") * F.col("fn") / (F.col("di") * F.col("dn"))).alias("w"))
    light = to_n.join(into, "n").join(cells, ["u", "cand"]).select("u", "cand", (F.col("c") * F.col("fv")).alias("c"), (F.col("w") * F.col("fv")).alias("w"))

    over = second.where("hub").join(into.join(cells.select("cand").distinct(), "cand", "left_semi"), "n").groupBy("i", "cand").agg(F.sum(F.col("fn") * F.col("fv")).alias("c"), F.sum(F.col("fn") * F.col("fv") / F.col("dn")).alias("w"))
    over = over.join(items.select("i", "di"), "i").select("i", "cand", "c", (F.col("w") / F.col("di")).alias("w"))
    through = cells.join(first.where("hub").select("u", "i", "fu"), "u").join(over, ["i", "cand"]).groupBy("u", "cand").agg(F.sum(F.col("fu") * F.col("c")).alias("c"), F.sum(F.col("fu") * F.col("w")).alias("w"))
    twice = F.col("fu") * F.col("fu")
    back = first.where("hub").groupBy("u").agg(F.sum(twice).alias("bc"), F.sum(twice / F.col("di")).alias("bw"))
    own = freq.join(deg_n, "src").select(F.col("src").alias("u"), F.col("dst").alias("cand"), F.col("f").alias("fo"), "dn")
    less = own.join(back, "u").select("u", "cand", (F.col("fo") * F.col("bc")).alias("oc"), (F.col("fo") * F.col("bw") / F.col("dn")).alias("ow"))
    part = lambda a, b: (F.col(a) - F.coalesce(F.col(b), F.lit(0.0))).alias(a)
    hubs = through.join(less, ["u", "cand"], "left").select("u", "cand", part("c", "oc"), part("w", "ow"))

    walks = light.union(hubs).groupBy("u", "cand").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).where("c > 0.5").join(ends, "cand")
    walks = walks.select(F.col("u").alias("src"), "cand", F.log1p("c").alias("rp3_log"), (F.col("w") / F.pow("dv", F.lit(beta))).alias("rp3"))
    found = cands.select("qid", "col", "src", "cand").join(walks, ["src", "cand"], "left")
    return found.select("qid", "col", "cand", F.coalesce("rp3_log", F.lit(0.0)).alias("rp3_log"), F.coalesce("rp3", F.lit(0.0)).alias("rp3"))


def pair_similarity(cands: DataFrame, hist: DataFrame, cap: int = 32) -> DataFrame:
    """(src, cand, <five columns>) of the pairs of ``neighbor_similarity`` that have any."""
    pairs = hist.groupBy("src", "dst").agg(F.max("time").alias("last"))
    rare = pairs.groupBy("dst").agg((1.0 / F.sqrt(F.count("*") + 1.0)).alias("rare"))
    own = item_sets(pairs.join(rare, "dst", "left").select(F.col("src").alias("k"), F.col("dst").alias("o"), "rare"), "rare")
    latest = pairs.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("last"), "src"))).where(F.col("r") <= cap)
    sets = latest.select(F.col("dst").alias("cand"), F.col("src").alias("id")).join(own, "id")
    return met_by_candidate(cands.select("src", "cand").distinct(), own, sets, None, _similarities, ", ".join(f"{c} double" for c in _SIMILAR))


_SIMILAR = ("max_cos", "max_jac", "top3", "max_rare", "log_near")


def neighbor_similarity(cands: DataFrame, hist: DataFrame, cap: int = 32) -> DataFrame:
    """Five columns over the candidate's ``cap`` latest sources n but the own one: max cosine, max Jaccard, sum of the top 3 cosines, max rare overlap, log1p of how many share two items."""
    out = cands.select("qid", "col", "src", "cand").join(pair_similarity(cands, hist, cap), ["src", "cand"], "left")
    return out.select("qid", "col", "cand", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in _SIMILAR))


def _similarities(candidate: Candidate, ids: np.ndarray, sizes: np.ndarray, run: np.ndarray, flat: np.ndarray) -> dict[str, np.ndarray]:
    both, rare = candidate.common(len(ids), run, flat, True)
    other = ids[:, None] != candidate.members[None, :]
    both, rare = both * other, rare * other
    cos = both / np.sqrt(sizes[:, None].astype(float) * candidate.sizes[None, :])
    jac = both / (sizes[:, None] + candidate.sizes[None, :] - both)
    top = lambda x: x.max(1, initial=0.0)
    return {"max_cos": top(cos), "max_jac": top(jac), "top3": -np.sort(-cos, 1)[:, :3].sum(1), "max_rare": top(rare), "log_near": np.log1p((both >= 2).sum(1))}


def session_graph(hist: DataFrame, lags: int = 4, window: int = 1800) -> DataFrame:
    """(i, j, cnt): items of a source at most ``lags`` apart in order and ``window`` seconds in time, both directions.

    A source is met in buckets of time with the ``window`` seconds before each copied in: an earlier row is too far away.
    """
    width = max(4 * window, 3600)
    own = F.floor(F.col("time") / width)
    rows = hist.select("src", "time", "seq", "dst", own.alias("b"), F.explode(F.sequence(own, F.floor((F.col("time") + window) / width))).alias("at"))
    order = Window.partitionBy("src", "at").orderBy("time", "seq")
    steps = range(1, lags + 1)
    wide = rows.select("b", "at", F.col("dst").alias("i"), *(F.lag("dst", k).over(order).alias(f"j{k}") for k in steps), *((F.col("time") - F.lag("time", k).over(order)).alias(f"gap{k}") for k in steps)).where("b = at")
    near = F.explode(F.array(*(F.struct(F.col(f"j{k}").alias("j"), F.col(f"gap{k}").alias("gap")) for k in steps)))
    found = wide.select("i", near.alias("e")).where(F.col("e.gap").between(0, window)).select("i", "e.j")
    return found.union(found.select("j", "i")).groupBy("i", "j").agg(F.count("*").alias("cnt"))


def session_features(cands: DataFrame, graph: DataFrame, items: DataFrame, asof: DataFrame, fade: float = 0.72) -> DataFrame:
    """Over the items before the query (``asof(qid, items)``, oldest first): faded sum and plain maximum of log1p(cnt) and of
    log1p(1e4 cosine), normalised in the query, a hit, and the normalised sum of the count's sum and the cosine's maximum.

    The cosine divides by the root of both items' numbers of edges, ``items(dst, dst_cnt)``. Rows are made for
    cells whose item has an edge with one of the query's, not for all pairs.
    """
    size = lambda k, name: items.select(F.col("dst").alias(k), F.greatest("dst_cnt", F.lit(1)).cast("double").alias(name))
    g = graph.join(size("i", "di"), "i").join(size("j", "dj"), "j").select("i", F.col("j").alias("cand"), F.log1p("cnt").alias("a"), F.log1p(1e4 * F.col("cnt") / F.sqrt(F.col("di") * F.col("dj"))).alias("b"))
    before = asof.select("qid", F.posexplode(F.reverse("items")).alias("pos", "i"))
    rows = cands.select("qid", "cand").distinct().join(before, "qid").join(g, ["i", "cand"])
    w = F.pow(F.lit(fade), F.col("pos"))
    agg = rows.groupBy("qid", "cand").agg(F.sum(w * F.col("a")).alias("raw_sum"), F.max("a").alias("raw_max"), F.sum(w * F.col("b")).alias("norm_sum"), F.max("b").alias("norm_max"))
    names = ["raw_sum", "raw_max", "norm_sum", "norm_max"]
    full = cands.select("qid", "col", "cand").join(agg, ["qid", "cand"], "left")
    full = full.select("qid", "col", "cand", F.col("raw_sum").isNotNull().cast("int").alias("hit"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    return qnorm(qnorm(full, names).withColumn("hybrid", F.col("raw_sum") + F.col("norm_max")), ["hybrid"])


def gcn_propagate(nodes: DataFrame, edges: DataFrame, dim: int, hops: int = 2) -> DataFrame:
    """(id, vec): features, first scaled to sum 1, times the symmetrically normalised adjacency with self loops, hops times.

    ``edges(src, dst)`` are taken in both directions, once each.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    adj = both.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").union(loops)
    deg = adj.groupBy("src").agg(F.count("*").alias("d"))
    w = adj.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").select("src", "dst", (1.0 / F.sqrt(F.col("d").cast("double") * F.col("d2"))).alias("w"))
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    now = nodes.select("id", F.transform("features", lambda x: F.coalesce(x / F.nullif(total, F.lit(0.0)), F.lit(0.0))).alias("vec"))
    for _ in range(hops):
        rows = w.join(now.select(F.col("id").alias("src"), "vec"), "src").groupBy("dst").agg(*(F.sum(F.col("w") * F.col("vec")[d]).alias(f"d{d}") for d in range(dim)))
        now = rows.select(F.col("dst").alias("id"), F.array(*(F.col(f"d{d}") for d in range(dim))).alias("vec"))
    return now


def fast_features(cands: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, user_props: DataFrame, item_props: DataFrame) -> DataFrame:
    """The compact ranker's 14 columns: counts and recencies of the pair, its reverse and both ends, pool frequencies, the fused propagation score and its three normalised dots."""
    rows, gap = _activity(cands, hist)
    freq, own = _pool_frequency(cands)
    lg = lambda c, n: F.log1p(F.coalesce(c, F.lit(0))).alias(n)
    rows = rows.join(freq, "cand").join(own, ["src", "cand"])
    rows = rows.select("qid", "col", "cand", lg("pc", "pair_log"), gap("pl").alias("pair_gap"), lg("rc", "back_log"), gap("rl").alias("back_gap"), lg("sc", "src_log"), lg("dc", "dst_log"), gap("sl").alias("src_gap"), gap("dl").alias("dst_gap"), "pool_freq", "src_freq")
    return rows.join(prop_parts(cands, users, items, user_props, item_props).drop("cand"), ["qid", "col"])
