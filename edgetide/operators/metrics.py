"""Reciprocal-rank metrics, segment tables, paired comparisons and audits of score tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, Q, draw, running
from .rank import topk


def ranks(scores: DataFrame, col: str = "score", ties: str = "column") -> DataFrame:
    """(qid, rank) of the positive cell (``is_pos``): one aggregate over each query, no sort.

    ``column``: equal scores in lower columns come first; ``optimistic``: none do; ``mid``: half of them.
    """
    pos = F.max(F.when(F.col("is_pos"), F.struct(F.col(col).alias("s"), F.col("col").alias("c")))).over(Q())
    rows = scores.select("qid", "col", F.col(col).alias("__s"), "is_pos", pos.alias("__p")).where("__p is not null")
    above, tied = F.col("__s") > F.col("__p.s"), (F.col("__s") == F.col("__p.s")) & ~F.col("is_pos")
    extra = {"column": (tied & (F.col("col") < F.col("__p.c"))).cast("double"), "optimistic": F.lit(0.0), "mid": tied.cast("double") / 2}[ties]
    return rows.groupBy("qid").agg((F.sum(F.when(above, 1.0).otherwise(0.0) + extra) + 1.0).alias("rank"))


def mrr(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("n"), F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"))


def segment_metrics(ranked: DataFrame, flags: DataFrame) -> DataFrame:
    """MRR and top-1 for every segment flag and for all."""
    names = [c for c in flags.columns if c != "qid"]
    rows = ranked.join(flags, "qid")
    each = F.explode(F.array(F.struct(F.lit("all").alias("segment"), F.lit(1).alias("on")), *(F.struct(F.lit(n).alias("segment"), F.col(n).alias("on")) for n in names)))
    return rows.select("rank", each.alias("s")).where("s.on = 1").groupBy("s.segment").agg(F.count("*").alias("n"), F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"))


def paired_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """b against a, two (qid, rank) tables: mean change of the reciprocal rank, its standard error, shares up and down, top-1 changes."""
    rows = a.select("qid", F.col("rank").alias("ra")).join(b.select("qid", F.col("rank").alias("rb")), "qid").withColumn("d", 1.0 / F.col("rb") - 1.0 / F.col("ra"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.count("*").alias("n"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), share(F.col("d") > 0).alias("up"), share(F.col("d") < 0).alias("down"), share((F.col("ra") == 1) != (F.col("rb") == 1)).alias("top1_changed"))


def topk_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of the k best cells that two score tables have in common."""
    both = topk(a, k).select("qid", "col").join(topk(b, k).select("qid", "col").withColumn("__in", F.lit(1)), ["qid", "col"], "left")
    per = both.groupBy("qid").agg((F.count("__in") / F.count("*")).alias("share"))
    return per.agg(F.count("*").alias("n"), F.avg("share").alias("overlap"))


def support_audit(cells: DataFrame, col: str) -> DataFrame:
    """Rates of support over cells and over positives, enrichment, rows with any, and the mean."""
    has = (F.col(col) > 0).cast("double")
    rows = cells.groupBy("qid").agg(F.avg(has).alias("cell"), F.max(F.when(F.col("is_pos"), has)).alias("label"), F.max(has).alias("any"), F.avg(col).alias("mean"))
    out = rows.agg(F.avg("cell").alias("cell_rate"), F.avg("label").alias("label_rate"), F.avg("any").alias("row_rate"), F.avg("mean").alias("mean_support"))
    return out.withColumn("enrichment", F.col("label_rate") / F.nullif(F.col("cell_rate"), F.lit(0.0)))


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose best cell changed, the old rank of the new best, the largest change of a score and of a row's sum."""
    first = lambda df, n: df.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "col"))).select("qid", "col", F.col("score").alias(f"s{n}"), F.col("r").alias(f"r{n}"))
    rows = first(before, 0).join(first(after, 1), ["qid", "col"])
    per = rows.groupBy("qid").agg(F.max(F.when(F.col("r1") == 1, F.col("r0"))).alias("old_rank"), F.max(F.abs(F.col("s1") - F.col("s0"))).alias("moved"), F.abs(F.sum("s1") - F.sum("s0")).alias("sum_error"))
    return per.agg(F.count("*").alias("rows"), F.count_if(F.col("moved") > 1e-12).alias("changed"), F.count_if(F.col("old_rank") > 1).alias("best_changed"), F.avg("old_rank").alias("mean_old_rank"), F.max("moved").alias("max_moved"), F.max("sum_error").alias("max_sum_error"))


def order_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries in which cells other than the new best keep their relative order; one row of counts."""
    best = topk(after, 1).select("qid", F.col("col").alias("best"))
    place = lambda df, n: df.join(best, "qid").where("col <> best").select("qid", "col", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "col")).alias(n))
    per = place(before, "a").join(place(after, "b"), ["qid", "col"]).groupBy("qid").agg(F.bool_and(F.col("a") == F.col("b")).alias("same"))
    return per.agg(F.count("*").alias("n"), F.count_if("same").alias("kept"))


def time_blocks(queries: DataFrame, blocks: int = 4) -> DataFrame:
    """The queries with ``block``: which of equal parts of their time span."""
    limits = F.broadcast(queries.agg(F.min("time").alias("__t0"), F.max("time").alias("__t1")))
    share = F.floor((F.col("time") - F.col("__t0")) * blocks / F.greatest(F.col("__t1") - F.col("__t0"), F.lit(1)))
    return queries.crossJoin(limits).withColumn("block", F.least(share, F.lit(blocks - 1))).drop("__t0", "__t1")


def leakage_audit(edges: DataFrame, blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per block of ``blocks(block, time, ...)``: queries, first query, the last edge that the block's cut of ``cuts(block, cutoff)``
    lets in, and whether it lies strictly before the first query. Cuts are given apart from the queries, so a late one shows.

    Cuts are few rows; an edge is counted at the first cut that lets it in and carried on to later ones.
    """
    per = blocks.groupBy("block").agg(F.min("time").alias("first_query"), F.count("*").alias("n")).join(cuts, "block", "left")
    ordered = per.select("cutoff").where("cutoff is not null").distinct().agg(F.array_sort(F.collect_list("cutoff")).alias("__cuts"))
    first = F.element_at(F.filter("__cuts", lambda c: c > F.col("time")), 1)
    seen = edges.select("time").crossJoin(F.broadcast(ordered)).withColumn("cutoff", F.when(F.col("time") < F.array_max("__cuts"), first)).where("cutoff is not null")
    last = seen.groupBy("cutoff").agg(F.max("time").alias("__last"))
    carried = per.join(last, "cutoff", "left").withColumn("last_edge", F.max("__last").over(Window.orderBy("cutoff")))
    ok = F.coalesce(F.col("last_edge") < F.col("first_query"), F.col("cutoff").isNotNull())
    return carried.select("block", "n", "first_query", "cutoff", "last_edge", ok.alias("ok"))


def perturbation_audit(build: Callable[[DataFrame, DataFrame], DataFrame], edges: DataFrame, blocks: DataFrame, cuts: list[tuple[int, int]], shift: int = 1) -> DataFrame:
    """Whether a feature frame of a block changes when edges from the block's cut on are changed: rows, changed rows, ok.

    ``build(queries, edges)`` gives one row a ``qid`` with any further columns; it is run for each (block, cut) of ``cuts`` on the
    log as it is and on one whose edges at the cut or later lead to another destination. Rows are held against each other
    by a hash of all their columns. A frame that looks past the cut in any way that matters shows here.
    """
    out = None
    for block, cut in cuts:
        queries = blocks.where(F.col("block") == block).drop("block")
        moved = edges.withColumn("dst", F.when(F.col("time") >= cut, F.col("dst") + shift).otherwise(F.col("dst")))
        found = [build(queries, log) for log in (edges, moved)]
        marks = [df.select("qid", F.xxhash64(*sorted(c for c in df.columns if c != "qid")).alias(f"m{i}")) for i, df in enumerate(found)]
        differs = ~F.col("m0").eqNullSafe(F.col("m1"))
        one = marks[0].join(marks[1], "qid", "full").agg(F.count("*").alias("n"), F.count_if(differs).alias("changed"))
        one = one.select(F.lit(block).cast("long").alias("block"), F.lit(cut).cast("long").alias("cutoff"), "n", "changed", (F.col("changed") == 0).alias("ok"))
        out = one if out is None else out.union(one)
    return out


def effect_by_time(a: DataFrame, b: DataFrame, queries: DataFrame, parts: int = 3) -> DataFrame:
    """b against a, as in ``paired_compare``, in equal parts of the queries in order of time and for all of them (part -1)."""
    placed = running(queries.select("qid", "time", F.lit(1).alias("__one")), "__one", ["time", "qid"], F.floor(F.col("time") / DAY), "__at")
    size = F.broadcast(queries.agg(F.count("*").alias("__n")))
    rows = placed.crossJoin(size).select("qid", F.expr(f"__at * {parts} div __n").alias("part"))
    both = a.select("qid", (1.0 / F.col("rank")).alias("ra")).join(b.select("qid", (1.0 / F.col("rank")).alias("rb")), "qid").join(rows, "qid")
    each = both.select(F.explode(F.array(F.col("part"), F.lit(-1).cast("long"))).alias("part"), "ra", "rb", (F.col("rb") - F.col("ra")).alias("d"))
    share = lambda c: F.avg(c.cast("double"))
    return each.groupBy("part").agg(F.count("*").alias("n"), F.avg("ra").alias("before"), F.avg("rb").alias("after"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), share(F.col("d") > 0).alias("up"), share(F.col("d") < 0).alias("down"))


def permutation_check(cands: DataFrame, scorer: Callable[[DataFrame], DataFrame], seed: int = 1, digits: int = 9) -> DataFrame:
    """Cells whose score changes when each query's columns are put in a hashed order of its own; one row of counts."""
    order = Window.partitionBy("qid").orderBy(draw(F.col("qid"), F.col("col"), seed), "col")
    turned = cands.withColumn("__was", F.col("col")).withColumn("col", F.row_number().over(order) - 1)
    back = scorer(turned.drop("__was")).select("qid", "col", F.col("score").alias("other")).join(turned.select("qid", "col", "__was"), ["qid", "col"])
    rows = scorer(cands).select("qid", "col", "score").join(back.select("qid", F.col("__was").alias("col"), "other"), ["qid", "col"])
    return rows.agg(F.count("*").alias("cells"), F.count_if(F.round("score", digits) != F.round("other", digits)).alias("changed"))


def acceptance(report: DataFrame, least: float = 0.003, errors: float = 2.0, most_down: float = 0.5) -> DataFrame:
    """PASS or NO_GO of a paired comparison."""
    ok = (F.col("delta") >= least) & (F.col("delta") > errors * F.col("se")) & (F.col("down") <= most_down)
    return report.withColumn("decision", F.when(ok, "PASS").otherwise("NO_GO"))


#: Published tolerances: overall over the history's pool and over the test pool, and of segments.
TOLERANCE = {"history": 0.0005, "test_pool": 0.001}
SEGMENT_TOLERANCE = 0.003


def tolerance_checks(before: DataFrame, after: DataFrame, segments: tuple[str, ...] = ("pair_new", "pair_seen", "src_hot"), overall: float = TOLERANCE["history"], each: float = SEGMENT_TOLERANCE) -> DataFrame:
    """Segment tables (``segment_metrics``) before and after: whether the MRR of all and of each named segment fell by no more
    than its tolerance; one row a segment that has queries, and ``decision`` over all of them."""
    pick = lambda df, n: df.where(F.col("segment").isin("all", *segments)).select("segment", F.col("mrr").alias(n))
    rows = pick(before, "before").join(pick(after, "after"), "segment").withColumn("tolerance", F.when(F.col("segment") == "all", overall).otherwise(each))
    rows = rows.withColumn("ok", F.col("after") >= F.col("before") - F.col("tolerance"))
    every = F.broadcast(rows.agg(F.bool_and("ok").alias("__all")))
    return rows.crossJoin(every).withColumn("decision", F.when(F.col("__all"), "PASS").otherwise("NO_GO")).drop("__all")


def component_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of every two component columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs)))
    return one.select(each.alias("x")).select("x.*")


def accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("mask").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
