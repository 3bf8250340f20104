"""Lookups of history statistics for candidate cells: causal features, as-of histories, transitions, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, day_of_week, dot, hour_of_day, recency
from .stats import dst_histograms, dst_stats, pair_stats, src_stats

CAUSAL = ["pair_log_count", "pair_recency", "pair_seen", "src_log_count", "src_recency", "src_seen", "dst_log_count", "dst_recency", "dst_seen", "pair_share_src", "pair_share_dst"]


def _looked_up(cands: DataFrame, pairs: DataFrame, srcs: DataFrame, dsts: DataFrame) -> DataFrame:
    rows = cands.join(pairs.withColumnRenamed("dst", "cand"), ["src", "cand"], "left").join(srcs, "src", "left")
    return rows.join(dsts.withColumnRenamed("dst", "cand"), "cand", "left")


def causal_features(cands: DataFrame, hist: DataFrame, cutoff: int) -> DataFrame:
    """The cells' columns and 11 causal columns; a query before the cutoff is an error."""
    return stored_features(cands, pair_stats(hist), src_stats(hist), dst_stats(hist), cutoff)


def stored_features(cands: DataFrame, pairs: DataFrame, srcs: DataFrame, dsts: DataFrame, cutoff: int) -> DataFrame:
    """The same from statistics frozen at the cutoff, such as stores bucketed by their keys, which are then read in place."""
    time = F.when(F.col("time") >= cutoff, F.col("time")).otherwise(F.raise_error(F.lit("a query lies before the cutoff")).cast("long"))
    rows = _looked_up(cands, pairs, srcs, dsts).withColumn("__t", time)
    z = lambda c: F.coalesce(c, F.lit(0))
    triple = lambda k: [F.log1p(z(f"{k}_cnt")).alias(f"{k}_log_count"), F.when(F.col(f"{k}_cnt").isNull(), 0.0).otherwise(recency(F.col("__t") - F.col(f"{k}_last"))).alias(f"{k}_recency"), F.col(f"{k}_cnt").isNotNull().cast("int").alias(f"{k}_seen")]
    share = lambda k: (z("pair_cnt") / F.greatest(z(f"{k}_cnt"), F.lit(1))).alias(f"pair_share_{k}")
    return rows.select(*cands.columns, *triple("pair"), *triple("src"), *triple("dst"), share("src"), share("dst"))


def pair_seen(cands: DataFrame, hist: DataFrame) -> DataFrame:
    pairs = hist.select("src", F.col("dst").alias("cand")).distinct().withColumn("__seen", F.lit(1))
    return cands.join(pairs, ["src", "cand"], "left").withColumn("seen", F.coalesce("__seen", F.lit(0))).select(*cands.columns, "seen")


def reverse_pair(cands: DataFrame, hist: DataFrame) -> DataFrame:
    """Edges from the candidate to the source: log count and recency."""
    back = pair_stats(hist).select(F.col("src").alias("cand"), F.col("dst").alias("src"), F.col("pair_cnt").alias("__n"), F.col("pair_last").alias("__last"))
    rows = cands.join(back, ["src", "cand"], "left")
    return rows.select("qid", "col", F.log1p(F.coalesce("__n", F.lit(0))).alias("back_log_count"), F.when(F.col("__n").isNull(), 0.0).otherwise(recency(F.col("time") - F.col("__last"))).alias("back_recency"))


def history_asof(queries: DataFrame, edges: DataFrame, k: int, width: int = DAY) -> DataFrame:
    """(qid, src, time, items, gaps): the last k items of the source strictly before the query, oldest first, with log1p(seconds ago).

    Time is cut into buckets of ``width`` seconds, and no task holds more of a source than one of them. Within a bucket one
    sort of edges and queries together tells how many of its edges precede each query, and lists are made for those
    places only. What a bucket starts with are the last k edges of the nearest bucket before it that has any, found over
    one row a bucket. Linear in edges and queries. Queries without history have empty lists.
    """
    bucket = F.floor(F.col("time") / width).alias("b")
    item = F.struct("time", "seq", F.col("dst").alias("item"))
    clipped = lambda a: F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, F.lit(k))
    edges, queries = edges.select("src", bucket, "time", "seq", "dst"), queries.select("src", bucket, "time", "qid")

    newest = Window.partitionBy("src", "b").orderBy(F.desc("time"), F.desc("seq"))
    tails = edges.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= k).groupBy("src", "b").agg(F.array_sort(F.collect_list(item)).alias("tail"))
    buckets = Window.partitionBy("src").orderBy("b")
    upto = tails.select("src", "b", clipped(F.flatten(F.collect_list("tail").over(buckets.rowsBetween(-(k - 1), 0)))).alias("upto"), F.lit(False).alias("asked"))
    marks = upto.union(queries.select("src", "b").distinct().select("src", "b", F.lit(None), F.lit(True)))
    carried = marks.withColumn("carried", F.last("upto", True).over(buckets.rangeBetween(Window.unboundedPreceding, -1))).where("asked").select("src", "b", "carried")

    none = F.lit(None).cast("long")
    both = edges.select("*", F.lit(1).alias("kind"), none.alias("qid")).union(queries.select("src", "b", "time", none, none, F.lit(0), "qid"))
    before = Window.partitionBy("src", "b").orderBy("time", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("n", F.sum("kind").over(before))
    asked = placed.where("kind = 0").select("qid", "src", "b", "time", "n")
    wanted = asked.where("n > 0").select("src", "b", F.col("n").alias("upto")).distinct()
    wanted = wanted.select("src", "b", "upto", F.explode(F.sequence(F.greatest(F.col("upto") - (k - 1), F.lit(1)), "upto")).alias("n"))
    lists = wanted.join(placed.where("kind = 1").select("src", "b", "n", item.alias("e")), ["src", "b", "n"]).groupBy("src", "b", F.col("upto").alias("n")).agg(F.array_sort(F.collect_list("e")).alias("own"))
    empty = F.array().cast("array<struct<time:bigint,seq:bigint,item:bigint>>")
    recent = clipped(F.concat(F.coalesce("carried", empty), F.coalesce("own", empty)))
    found = asked.join(lists, ["src", "b", "n"], "left").join(carried, ["src", "b"], "left").withColumn("recent", recent)
    return found.select("qid", "src", "time", F.transform("recent", lambda x: x["item"]).alias("items"), F.transform("recent", lambda x: F.log1p(F.col("time") - x["time"])).alias("gaps"))


def history_static(hist: DataFrame, k: int = 8) -> DataFrame:
    """(src, pos, item, weight): the last k edges of each source, pos 0 the newest, weight exp(-pos / 3)."""
    order = Window.partitionBy("src").orderBy(F.desc("time"), F.desc("seq"))
    rows = hist.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < k)
    return rows.select("src", "pos", F.col("dst").alias("item"), F.exp(-F.col("pos") / 3.0).alias("weight"))


def transitions(hist: DataFrame, width: int = DAY) -> DataFrame:
    """(prev, next, cnt) of adjacent items of a source where the later is strictly later.

    Neighbours within a bucket of ``width`` seconds are met in it, those across buckets by one row a bucket.
    """
    rows = hist.select("src", F.floor(F.col("time") / width).alias("b"), "time", "seq", "dst")
    order = Window.partitionBy("src", "b").orderBy("time", "seq")
    inner = rows.select(F.col("dst").alias("prev"), F.lead("dst").over(order).alias("next"), "time", F.lead("time").over(order).alias("next_time")).where("next_time > time").select("prev", "next")
    whole = F.struct("time", "seq", "dst")
    ends = rows.groupBy("src", "b").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    across = ends.select(F.col("last.dst").alias("prev"), F.lead("first").over(Window.partitionBy("src").orderBy("b")).alias("next")).where("next is not null")
    return inner.union(across.select("prev", "next.dst")).groupBy("prev", "next").agg(F.count("*").alias("cnt"))


def transition_score(cands: DataFrame, hist: DataFrame) -> DataFrame:
    last = hist.groupBy("src").agg(F.max_by("dst", F.struct("time", "seq")).alias("prev"))
    rows = cands.join(last, "src", "left").join(transitions(hist).withColumnRenamed("next", "cand"), ["prev", "cand"], "left")
    return rows.select("qid", "col", "cand", F.log1p(F.coalesce("cnt", F.lit(0))).alias("transition"))


def embedding_score(cands: DataFrame, users: DataFrame, items: DataFrame, hist: DataFrame, unknown: float = -12.0, seen: float = -20.0) -> DataFrame:
    """<u, v> + bias of ``users/items(id, vec, bias)``; unknown ids and pairs already seen have fixed scores."""
    u = users.select(F.col("id").alias("src"), F.col("vec").alias("__u"))
    v = items.select(F.col("id").alias("cand"), F.col("vec").alias("__v"), F.col("bias").alias("__b"))
    rows = pair_seen(cands, hist).join(u, "src", "left").join(v, "cand", "left")
    own = F.when(F.col("__u").isNull() | F.col("__v").isNull(), unknown).otherwise(dot("__u", "__v") + F.coalesce("__b", F.lit(0.0)))
    return rows.select("qid", "col", "cand", F.when(F.col("seen") == 1, seen).otherwise(own).alias("score"))


def mf_score(cands: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """<u, v> + bias, where an unknown id adds nothing."""
    u = users.select(F.col("id").alias("src"), F.col("vec").alias("__u"))
    v = items.select(F.col("id").alias("cand"), F.col("vec").alias("__v"), F.col("bias").alias("__b"))
    rows = cands.join(u, "src", "left").join(v, "cand", "left")
    return rows.select("qid", "col", "cand", (F.coalesce(dot("__u", "__v"), F.lit(0.0)) + F.coalesce("__b", F.lit(0.0))).alias("score"))


def cold_pool(hist: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Ids inside the historical range of destinations that never occur: the range, made in blocks by tasks, less the ids."""
    ends = hist.agg(F.min("dst").alias("low"), F.max("dst").alias("high")).where("low is not null")
    at = lambda c: F.floor(F.col(c) / block)
    blocks = ends.withColumn("at", F.explode(F.sequence(at("low"), at("high")))).repartition("at")
    ids = blocks.select(F.explode(F.sequence(F.greatest(F.col("at") * block, "low"), F.least(F.col("at") * block + (block - 1), "high"))).alias("dst"))
    return ids.join(hist.select("dst").distinct(), "dst", "left_anti")


def segments_of(cands: DataFrame, hist: DataFrame, src_hot: DataFrame, dst_hot: DataFrame) -> DataFrame:
    """Per query, whether its positive is of each segment: source and destination warm, cold, hot; tail; pair seen, new."""
    rows = _looked_up(cands.where("is_pos"), pair_stats(hist), src_stats(hist), dst_stats(hist)).crossJoin(F.broadcast(src_hot.select(F.col("hot").alias("__s")))).crossJoin(F.broadcast(dst_hot.select(F.col("hot").alias("__d"))))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.select(
        "qid", flag(F.col("src_cnt").isNotNull()).alias("src_warm"), flag(F.col("src_cnt").isNull()).alias("src_cold"), flag(F.col("src_cnt") >= F.col("__s")).alias("src_hot"),
        flag(F.col("dst_cnt").isNotNull()).alias("dst_warm"), flag(F.col("dst_cnt").isNull()).alias("dst_cold"), flag(F.col("dst_cnt") >= F.col("__d")).alias("dst_hot"),
        flag(F.col("dst_cnt") < F.col("__d")).alias("dst_tail"), flag(F.col("pair_cnt").isNotNull()).alias("pair_seen"), flag(F.col("pair_cnt").isNull()).alias("pair_new"),
    )


def periodicity(cands: DataFrame, hist: DataFrame, cap: int = 64) -> DataFrame:
    """Six columns: fit to the pair's mean interval, has one, log1p of the hour's and weekday's affinity (1 is the even share, and that of an unknown candidate), and the share, of ``cap``, of the latest in-events at most 1 and 7 days before."""
    pairs = pair_stats(hist).withColumnRenamed("dst", "cand")
    hist_rows = dst_histograms(hist).join(dst_stats(hist), "dst").select(F.col("dst").alias("cand"), "kind", "slot", (F.col("cnt") / F.col("dst_cnt")).alias("share"))
    order = Window.partitionBy("dst").orderBy(F.desc("time"), F.desc("seq"))
    times = hist.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).groupBy("dst").agg(F.collect_list("time").alias("__times")).withColumnRenamed("dst", "cand")
    slot = lambda kind, name: hist_rows.where(F.col("kind") == kind).select("cand", F.col("slot").alias(f"__{kind}"), F.col("share").alias(name))
    rows = cands.withColumn("__hour", hour_of_day()).withColumn("__dow", day_of_week()).join(pairs, ["src", "cand"], "left").join(slot("hour", "__hs"), ["cand", "__hour"], "left").join(slot("dow", "__ds"), ["cand", "__dow"], "left").join(times, "cand", "left")
    mean = (F.col("pair_last") - F.col("pair_first")) / (F.col("pair_cnt") - 1)
    has = (F.col("pair_cnt") > 1) & (F.col("pair_last") > F.col("pair_first"))
    age = lambda t: F.col("time") - t
    within = lambda s: F.coalesce(F.size(F.filter("__times", lambda t: age(t).between(0, s))) / float(cap), F.lit(0.0))
    affinity = lambda share, n: F.log1p(F.when(F.col("__times").isNull(), 1.0).otherwise(n * F.coalesce(share, F.lit(0.0))))
    gap = F.greatest(F.col("time") - F.col("pair_last"), F.lit(0))
    return rows.select(
        "qid", "col", F.coalesce(F.when(has, 1.0 / (1.0 + F.abs(gap / mean - 1.0))), F.lit(0.0)).alias("interval_fit"), F.coalesce(has, F.lit(False)).cast("int").alias("has_interval"),
        affinity("__hs", 24.0).alias("hour_affinity"), affinity("__ds", 7.0).alias("dow_affinity"), within(86_400).alias("within_1d"), within(604_800).alias("within_7d"),
    )


def match_history(cands: DataFrame, asof: DataFrame) -> DataFrame:
    """Exact matches of each candidate in the as-of history: count, and the sum of 1 / (1 + log gap)."""
    rows = cands.join(asof.select("qid", "items", "gaps"), "qid", "left")
    hits = F.filter(F.arrays_zip("items", "gaps"), lambda x: x["items"] == F.col("cand"))
    n = F.coalesce(F.size(hits), F.lit(0))
    return rows.select("qid", "col", F.when(n > 0, n).otherwise(0).cast("long").alias("match_count"), F.when(n > 0, F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + 1.0 / (1.0 + x["gaps"]))).otherwise(0.0).alias("match_recency"))


def base_score() -> Column:
    """The simple heuristic over causal features: seen counts three times, then recency and log count."""
    return 3.0 * F.col("pair_seen") + F.col("pair_recency") + F.col("pair_log_count")
