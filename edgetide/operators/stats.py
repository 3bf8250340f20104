"""Aggregates of a history, and of the pool of candidate cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import DAY, day_of_week, hour_of_day, quantiles, running
from . import arrays
from .history import decay
from .rank import qnorm


def src_stats(hist: DataFrame) -> DataFrame:
    return hist.groupBy("src").agg(F.count("*").alias("src_cnt"), F.max("time").alias("src_last"))


def dst_stats(hist: DataFrame) -> DataFrame:
    return hist.groupBy("dst").agg(F.count("*").alias("dst_cnt"), F.max("time").alias("dst_last"))


def pair_stats(hist: DataFrame) -> DataFrame:
    return hist.groupBy("src", "dst").agg(F.count("*").alias("pair_cnt"), F.min("time").alias("pair_first"), F.max("time").alias("pair_last"))


def hot_threshold(stats: DataFrame, cnt: str) -> DataFrame:
    """One row: max(1, ceil of the linear 80 % quantile of the counts)."""
    return stats.agg(F.greatest(F.lit(1), F.ceil(F.percentile(cnt, 0.8))).cast("long").alias("hot"))


def activity_cuts(queries: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row of source activities at row-weighted quantiles, the value at rank ceil(q (n - 1))."""
    per = queries.groupBy("src").agg(F.count("*").alias("cnt"))
    levels = per.groupBy("cnt").agg((F.count("*") * F.col("cnt")).alias("w"))
    upto = running(levels, "w", ["cnt"], F.floor(F.log2("cnt")), "before").crossJoin(F.broadcast(queries.agg(F.count("*").alias("n"))))
    at = [F.ceil((F.col("n") - 1) * q) for q in shares]
    return upto.agg(*(F.min(F.when(F.col("before") + F.col("w") > a, F.col("cnt"))).alias(f"cut_{i + 1}") for i, a in enumerate(at)))


def dst_histograms(hist: DataFrame) -> DataFrame:
    """(dst, kind, slot, cnt) in long form: kind hour (24 slots) or dow (7)."""
    slots = hist.select("dst", F.explode(F.array(F.struct(F.lit("hour").alias("kind"), hour_of_day().alias("slot")), F.struct(F.lit("dow").alias("kind"), day_of_week().alias("slot")))).alias("s"))
    return slots.groupBy("dst", "s.kind", "s.slot").agg(F.count("*").alias("cnt"))


def pool_freq(cands: DataFrame) -> DataFrame:
    return cands.groupBy("cand").agg(F.count("*").alias("cnt")).withColumn("log_freq", F.log1p("cnt"))


def src_pool_freq(cands: DataFrame) -> DataFrame:
    """Candidates that repeat under a source."""
    return cands.groupBy("src", "cand").agg(F.count("*").alias("cnt")).where("cnt > 1").withColumn("log_freq", F.log1p("cnt"))


def decayed_popularity(hist: DataFrame, origin: int, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    return hist.groupBy("dst").agg(*(F.sum(decay(F.col("time"), origin, d * DAY)).alias(f"pop_{d}") for d in days))


def item_freshness(hist: DataFrame, cands: DataFrame, origin: int) -> DataFrame:
    """Distinct candidates with -log1p(days since last), -30 where never seen."""
    items = cands.select("cand").distinct().join(dst_stats(hist).withColumnRenamed("dst", "cand"), "cand", "left")
    return items.select("cand", F.coalesce(-F.log1p((F.lit(origin) - F.col("dst_last")) / F.lit(float(DAY))), F.lit(-30.0)).alias("freshness"))


def user_item_weights(hist: DataFrame, origin: int, scale: float) -> DataFrame:
    return hist.groupBy("src", "dst").agg(F.sum(decay(F.col("time"), origin, scale)).alias("w"))


def bm25_confidence(weights: DataFrame, k1: float = 100.0, b: float = 0.8) -> DataFrame:
    """BM25 of ``weights(src, dst, w)``, divided by its mean and clipped to [0.05, 20]."""
    users = weights.groupBy("src").agg(F.sum("w").alias("length"))
    items = weights.groupBy("dst").agg(F.count("*").alias("df"))
    whole = F.broadcast(users.agg(F.avg("length").alias("mean_length"), F.count("*").alias("n_users")))
    rows = weights.join(users, "src").join(items, "dst").crossJoin(whole)
    norm = 1 - F.lit(b) + F.lit(b) * F.col("length") / F.col("mean_length")
    raw = F.col("w") * (k1 + 1) / (F.lit(k1) * norm + F.col("w")) * (F.log(F.col("n_users").cast("double")) - F.log1p("df"))
    rows = rows.select("src", "dst", raw.alias("raw"))
    mean = F.broadcast(rows.agg(F.avg("raw").alias("mean_raw")))
    return rows.crossJoin(mean).select("src", "dst", F.least(F.greatest(F.col("raw") / F.col("mean_raw"), F.lit(0.05)), F.lit(20.0)).alias("confidence"))


def popularity(hist: DataFrame, cands: DataFrame) -> DataFrame:
    stats = dst_stats(hist).select(F.col("dst").alias("cand"), "dst_cnt")
    return cands.join(stats, "cand", "left").select("qid", "col", "cand", F.log1p(F.coalesce("dst_cnt", F.lit(0))).alias("log_pop"))


def bucket_pmi(hist: DataFrame, cands: DataFrame, src_shift: int, dst_shift: int, window: int | None = None) -> DataFrame:
    """log1p of the bucket pair's count and its PMI for each cell, ids put into buckets by right shift.

    With a window only edges that recent before the end of the history count.
    """
    if window is not None:
        hist = hist.crossJoin(F.broadcast(hist.agg(F.max("time").alias("__end")))).where(F.col("time") > F.col("__end") - window).drop("__end")
    rows = hist.select(F.shiftright("src", src_shift).alias("sb"), F.shiftright("dst", dst_shift).alias("db"))
    pair = rows.groupBy("sb", "db").agg(F.count("*").alias("both"))
    one, two = pair.groupBy("sb").agg(F.sum("both").alias("sn")), pair.groupBy("db").agg(F.sum("both").alias("dn"))
    total = F.broadcast(pair.agg(F.coalesce(F.sum("both"), F.lit(0)).alias("total")))
    cells = cands.select("qid", "col", "cand", F.shiftright("src", src_shift).alias("sb"), F.shiftright("cand", dst_shift).alias("db"))
    out = cells.join(pair, ["sb", "db"], "left").join(one, "sb", "left").join(two, "db", "left").crossJoin(total)
    z = lambda c: F.coalesce(c, F.lit(0))
    pmi = F.log(z("both") + 0.25) + F.log(F.col("total") + 1.0) - F.log(z("sn") + 1.0) - F.log(z("dn") + 1.0)
    return out.select("qid", "col", "cand", F.log1p(z("both")).alias("log_pair"), pmi.alias("pmi"))


#: Published right shifts (source, destination) over the whole history and over its last seconds.
FULL_LEVELS = ((2, 2), (4, 4), (6, 6), (8, 8), (10, 10), (12, 12), (14, 14), (4, 6), (6, 4), (6, 8), (8, 6))
RECENT_LEVELS = ((4, 4), (6, 6), (8, 8))
RECENT_WINDOWS = (1800, 21_600)


class Hierarchy:
    """The levels and windows of ``hierarchy_features``; all of its counts belong to blocks of the finest shifts."""

    def __init__(self, full: tuple = FULL_LEVELS, recent: tuple = RECENT_LEVELS, windows: tuple = RECENT_WINDOWS):
        self.levels = list(dict.fromkeys([*full, *recent]))
        self.spans = [None, *windows]
        self.kept = [(i, k) for i, level in enumerate(self.levels) for k in range(len(self.spans)) if level in (full if k == 0 else recent)]
        self.shift = min(a for a, _ in self.levels), min(b for _, b in self.levels)
        names = ["_".join(map(str, self.levels[i])) + (f"_w{self.spans[k]}" if k else "") for i, k in self.kept]
        self.names = [f"{kind}_{name}" for name in names for kind in ("pair", "pmi")]

    def counts(self, hist: DataFrame, cands: DataFrame) -> DataFrame:
        """(src, cand, x): for each block with cells, by one source and item of it, the counts of its pair, source and
        destination on every kept level, and the totals of each window.

        Edges and cells are folded to blocks first; each is put into its bucket on every level by one expand, a level's counts
        are aggregates by (level, bucket), and blocks meet them in three joins whatever the number of levels.
        """
        (a0, b0), spans = self.shift, self.spans
        end = F.broadcast(hist.agg(F.max("time").alias("__end")))
        inside = lambda w: F.lit(True) if w is None else F.col("time") > F.col("__end") - w
        counts = [f"c{k}" for k in range(len(spans))]
        fold = lambda df, item: df.withColumns({"sb": F.shiftright("src", a0), "db": F.shiftright(item, b0)})
        pairs = fold(hist.crossJoin(end), "dst").groupBy("sb", "db").agg(*(F.count_if(inside(w)).alias(c) for w, c in zip(spans, counts, strict=True)))
        total = F.broadcast(pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in counts)))
        on_levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("sb", a - a0).alias("sb"), F.shiftright("db", b - b0).alias("db")) for i, (a, b) in enumerate(self.levels)))).alias("x")
        sums = lambda df, *by, name: df.groupBy("level", *by).agg(*(F.sum(c).alias(f"{name}{c}") for c in counts))
        each = sums(pairs.select(on_levels, *counts).select("x.*", *counts), "sb", "db", name="")
        ones, twos = sums(each, "sb", name="s"), sums(each, "db", name="d")
        blocks = fold(cands, "cand").where("sb is not null and db is not null").select("sb", "db").distinct()
        cells = blocks.select(F.col("sb").alias("src"), F.col("db").alias("cand"), on_levels).select("src", "cand", "x.*")
        rows = cells.join(each, ["level", "sb", "db"], "left").join(ones, ["level", "sb"], "left").join(twos, ["level", "db"], "left")
        at = lambda i, c: F.max(F.when(F.col("level") == i, F.coalesce(F.col(c), F.lit(0))))
        wide = rows.groupBy("src", "cand").agg(F.array(*(at(i, f"{p}c{k}") for p in ("", "s", "d") for i, k in self.kept)).alias("x")).crossJoin(total)
        x = F.concat("x", F.array(*(f"all_{c}" for c in counts))).cast("array<double>")
        return wide.select(F.shiftleft("src", a0).alias("src"), F.shiftleft("cand", b0).alias("cand"), x.alias("x"))

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The named columns from rows of counts."""
        n = len(self.kept)
        both, src, dst, total = x[:, :n], x[:, n : 2 * n], x[:, 2 * n : 3 * n], x[:, [3 * n + k for _, k in self.kept]]
        out = np.empty((len(x), 2 * n))
        out[:, ::2] = np.log1p(both)
        out[:, 1::2] = np.log(both + 0.25) + np.log(total + 1.0) - np.log(src + 1.0) - np.log(dst + 1.0)
        return out

    def learn(self, cand: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cand)
        return cand[order] >> self.shift[1], self.columns(x[order])

    def of(self, learned: tuple[np.ndarray, np.ndarray], cand: np.ndarray) -> np.ndarray:
        return learned[1][np.searchsorted(learned[0], cand >> self.shift[1])]


def hierarchy_features(hist: DataFrame, cands: DataFrame, full: tuple = FULL_LEVELS, recent: tuple = RECENT_LEVELS, windows: tuple = RECENT_WINDOWS, one_source: bool = False) -> DataFrame:
    """log1p of the bucket pair's count and its PMI, as in ``bucket_pmi``, on every level and window, normalised in the query.

    Counts are made for blocks of the finest shifts and meet the cells in the block of their source (``arrays.by_source``). Where every
    query has ``one_source``, that is where they are normalised, and no cell is shuffled with its columns; else they go on
    to their query. Columns are named pair_<source shift>_<destination shift> and pmi_..., with _w<seconds> for windows.
    """
    h = Hierarchy(full, recent, windows)

    def learn(given: list) -> tuple[np.ndarray, np.ndarray]:
        return h.learn(np.concatenate([arrays.numbers(b, "cand") for b in given]), np.concatenate([arrays.matrix(b, "x") for b in given]))

    keys = lambda batch: [arrays.numbers(batch, c) for c in ("qid", "col", "cand")]
    schema = ", ".join(["qid long, col int, cand long", *(f"{n} double" for n in h.names)])
    given = cands.select("qid", "col", "src", "cand", F.lit(None).cast("array<double>").alias("x"))
    meet = lambda fn, out: arrays.by_source([given], [h.counts(hist, cands)], F.shiftright("src", h.shift[0]), learn, fn, out)
    if one_source:
        return meet(lambda learned, batch, cells: [*keys(batch), *cells.z(h.of(learned, arrays.numbers(batch, "cand")), "max").T], schema)
    rows = meet(lambda learned, batch, _: [*keys(batch), arrays.lists(h.of(learned, arrays.numbers(batch, "cand")))], "qid long, col int, cand long, x array<double>")
    return arrays.by_query(rows, lambda batch, cells: [*keys(batch), *cells.z(arrays.matrix(batch, "x"), "max").T], schema)


def standardize(features: DataFrame, cols: list[str], clip: float = 8.0) -> DataFrame:
    """(x - mean) / (std + 1e-6) over all cells, clipped; the one row of moments is broadcast."""
    moments = F.broadcast(features.agg(*(f(c).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop)))))
    z = lambda c: F.greatest(F.least((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6), F.lit(clip)), F.lit(-clip))
    return features.crossJoin(moments).select(*[c for c in features.columns if c not in cols], *(z(c).alias(c) for c in cols))


def pool_excess(cands: DataFrame, n_items: DataFrame, thetas: tuple[float, ...] = (-1, 0, 0.5, 1, 1.5, 2)) -> DataFrame:
    """max(count - level - theta sqrt(level), 0) for each pool item; level: cells but one a row, by items.

    ``n_items`` is a frame of one row with a column n_items.
    """
    rows = cands.groupBy("qid").agg((F.count("*") - 1).alias("n"))
    level = F.broadcast(rows.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n_items)).select((F.col("n") / F.col("n_items")).alias("level")))
    counts = cands.groupBy("cand").agg(F.count("*").alias("cnt")).crossJoin(level)
    return counts.select("cand", "cnt", *(F.greatest(F.col("cnt") - F.col("level") - F.lit(float(t)) * F.sqrt("level"), F.lit(0.0)).alias(f"excess_{i}") for i, t in enumerate(thetas)))


def score_quantiles(scores: DataFrame, col: str = "score") -> DataFrame:
    return quantiles(scores, col, {f"q{round(100 * q):02d}": q for q in (0.01, 0.1, 0.5, 0.9, 0.99)})

