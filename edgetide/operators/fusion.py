"""Score fusion and policies over wide component tables ``(qid, col, is_pos, seen, <components>)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, Q, quantiles
from . import arrays, blocks
from .components import DIMS, SIZES, component_names
from .features import CAUSAL
from .rank import margins, qnorm, reorder_unseen, softmaxed, unique_max, z
from .stats import Hierarchy
from .support import supported


def mix(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of per-query z-scores."""
    rows = qnorm(df, list(weights))
    return rows.withColumn(out, sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def residual_logits(df: DataFrame, base: str, signals: dict[str, float], out: str = "score") -> DataFrame:
    """softmax(z(log base) + sum of w * z(signal)) with the base clipped at 1e-12."""
    rows = df.withColumn("__base", F.log(F.greatest(F.col(base), F.lit(1e-12))))
    rows = rows.withColumn("__logit", z("__base") + sum((F.lit(float(w)) * z(c) for c, w in signals.items()), F.lit(0.0)))
    return softmaxed(rows, "__logit", out).drop("__base", "__logit")


def bounded_residual(df: DataFrame, base: str, signal: str, weight: float, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.col(base) + weight * F.tanh(z(signal, "max") / 2.0))


def gated_mix(df: DataFrame, base: str, mixed: str, seen_alpha: float, new_alpha: float, out: str = "score") -> DataFrame:
    alpha = F.when(F.col("seen") == 1, seen_alpha).otherwise(new_alpha)
    return df.withColumn(out, F.col(base) + alpha * (F.col(mixed) - F.col(base)))


def _frame(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


def tune_weight(df: DataFrame, a: str, b: str, steps: int = 20) -> DataFrame:
    """MRR of (1 - w) a + w b on a grid of w, in one job without a window: a task hands on two numbers a weight.

    Mixes are compared at 12 digits, equal ones go to the lower column. Queries without a positive take no part.
    """
    grid = [i / steps for i in range(steps + 1)]

    def counted(batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        x, col, pos = cells.z(np.stack([arrays.numbers(batch, "a"), arrays.numbers(batch, "b")], 1)), arrays.numbers(batch, "col"), arrays.numbers(batch, "is_pos").astype(bool)
        at, has = cells.top(np.where(pos, col, -1)), np.logical_or.reduceat(pos, cells.starts)
        sums = []
        for w in grid:
            v = np.round((1 - w) * x[:, 0] + w * x[:, 1], 12)
            best = cells.top(np.where(pos, v, -np.inf))
            ranks = np.add.reduceat(((v > best) | ((v == best) & (col < at))).astype(np.int64), cells.starts) + 1
            sums.append((1.0 / ranks[has]).sum())
        return [np.arange(len(grid)).astype(np.int32), np.array(sums), np.full(len(grid), has.sum())]

    rows = arrays.by_query(df.select("qid", "col", "is_pos", F.col(a).alias("a"), F.col(b).alias("b")), counted, "i int, s double, n long")
    found = {r.i: r.m for r in rows.groupBy("i").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m")).collect()}
    return _frame(df, [{"w": w, "mrr": found.get(i) or 0.0} for i, w in enumerate(grid)], "w double, mrr double")


def promote_winner(df: DataFrame, logit: str, least: int = 4, lead: int = 2, out: str = "score") -> DataFrame:
    """The support winner's logit becomes the query's maximum + 1 where its support and lead suffice and it is not the best yet; then softmax."""
    top = F.max(logit).over(Q())
    own = F.col("col") == F.col("winner")
    enough = own & (F.col("top") >= least) & (F.col("lead") >= lead) & (F.col(logit) < top)
    return softmaxed(df.withColumn("__l", F.when(enough, top + 1.0).otherwise(F.col(logit))), "__l", out).drop("__l")


def compose(df: DataFrame, base: str, residual: str, weight: float, mode: str = "all", out: str = "score") -> DataFrame:
    """Residual on all, seen or unseen cells; rows with repeated ids keep the base (``dup_row``)."""
    on = {"all": F.lit(True), "pair_seen": F.col("seen") == 1, "pair_new": F.col("seen") == 0}[mode]
    return df.withColumn(out, F.when(on & (F.col("dup_row") == 0), F.col(base) + weight * F.col(residual)).otherwise(F.col(base)))


def row_gate(df: DataFrame, base: str, new: str, gate: str, threshold: float, keep_same_best: bool = True, out: str = "score") -> DataFrame:
    """The new scores in rows whose ``gate`` value reaches the threshold or, with ``keep_same_best``, whose best cell stays the same; else the base."""
    best = lambda c: F.max_by("col", F.struct(F.col(c), -F.col("col"))).over(Q())
    same = best(base) == best(new) if keep_same_best else F.lit(False)
    rows = df.withColumn("__same", same)
    return rows.withColumn(out, F.when((F.col(gate) >= threshold) | F.col("__same"), F.col(new)).otherwise(F.col(base))).drop("__same")


def escape_policy(df: DataFrame, gaps: DataFrame, control: str, residual: str, margin: float, slot_alpha: float, escape_alpha: float, out: str = "value") -> DataFrame:
    """In rows whose new-seen gap reaches the margin, control + escape_alpha * residual on unseen cells; else the slot,
    from 1 down to 0 in equal steps, after unseen cells were reordered by ``slot_alpha``. With an escape_alpha of 0, slots everywhere."""
    rows = reorder_unseen(df, control, residual, slot_alpha)
    slot = 1.0 - F.coalesce(F.col("position") / F.nullif(F.count("*").over(Q()) - 1, F.lit(0)), F.lit(0.0))
    if escape_alpha <= 0:
        return rows.withColumn(out, slot).drop("position")
    direct = F.col(control) + F.when(F.col("seen") == 0, escape_alpha * F.col(residual)).otherwise(0.0)
    rows = rows.withColumn("__slot", slot).join(gaps.select("qid", "gap"), "qid")
    return rows.withColumn(out, F.when(F.col("gap") >= margin, direct).otherwise(F.col("__slot"))).drop("position", "__slot", "gap")


def apply_gate(df: DataFrame, base: str, new: str, gate: str, out: str = "score") -> DataFrame:
    """gate: all, pair_new (unseen cells), row_no_seen (rows without a seen cell) or low_margin (up to the median margin)."""
    if gate == "low_margin":
        df = margins(df.withColumn("__b", F.col(base)), "__b").drop("from_top", "winner_gap", "__b")
        median = quantiles(df.groupBy("qid").agg(F.first("margin").alias("m")), "m", {"__median": 0.5})
        df = df.crossJoin(F.broadcast(median))
        on = F.col("margin") <= F.col("__median")
    else:
        on = {"all": F.lit(True), "pair_new": F.col("seen") == 0, "row_no_seen": F.max("seen").over(Q()) == 0}[gate]
    return df.withColumn(out, F.when(on, F.col(new)).otherwise(F.col(base))).drop("__median", "margin")


def ensemble(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Long ``scores(qid, col, component, score)`` to one score: mean or median of z-scores, or z of the mean."""
    by = Window.partitionBy("qid", "component")
    normed = scores.withColumn("n", z("score", "add", by))
    if how == "z_of_mean":
        return qnorm(scores.groupBy("qid", "col").agg(F.avg("score").alias("score")), ["score"])
    agg = F.avg("n") if how == "mean" else F.percentile("n", 0.5)
    return normed.groupBy("qid", "col").agg(agg.alias("score"))


def near_ring_lift(df: DataFrame, base: str, ring: str, weight: float = 0.4, least: float = 0.25, out: str = "score") -> DataFrame:
    """Tied unseen maxima of the ring get weight * z(log1p(ring)) when maximum / ties is large enough."""
    rows = unique_max(df, ring, F.col("seen") == 0).withColumn("__l", F.log1p(ring))
    lifted = F.col(base) + weight * z("__l")
    return rows.withColumn(out, F.when((F.col("tied_max") == 1) & (F.col(ring) / F.greatest("ties", F.lit(1)) >= least), lifted).otherwise(F.col(base))).drop("__l", "tied_max", "ties", "is_unique_max")


#: Published weights: supports at the very time and within the session, directional supports of unseen cells, rings of 15 minutes to a day.
CHAIN = {"cross": 0.10, "session": 0.05}
CHAIN_UNSEEN = {"cross_past_1": -0.10, "future_1": 0.225, "future_300": 0.30, "past_300": 0.305}
CHAIN_RINGS = {"ring_past": 0.2625, "ring_future": 0.28, "ring_sum": -0.0525}
TIE_SCALE = 0.2


def chain_supports(cands: DataFrame) -> DataFrame:
    """The cells, with all of their columns, and the columns of the chain: one pass over the pool's frames."""
    own = {"w": (-300, 300), "now": (0, 0), "future_1": (1, 1), "future_300": (1, 300), "past_300": (-300, -1), "p0": (-900, -1), "f0": (1, 900), "p1": (-DAY, -1), "f1": (1, DAY)}
    rows = supported(cands, own, {"cross": (0, 0), "cross_past_1": (-1, -1)})
    ring = {"ring_past": F.col("p1") - F.col("p0"), "ring_future": F.col("f1") - F.col("f0")}
    rows = rows.select(*cands.columns, (F.col("w") - F.col("now")).alias("session"), "future_1", "future_300", "past_300", "cross", "cross_past_1", *(e.alias(k) for k, e in ring.items()))
    return rows.withColumn("ring_sum", F.col("ring_past") + F.col("ring_future"))


def structural_chain(df: DataFrame, base: str) -> DataFrame:
    """Cross and session support, directional supports of unseen cells, the ring residual for a unique ring winner; where a
    row has none, its two or more tied winners are lifted together by a fifth of their ring's z-score.

    ``df`` holds the base score, ``seen`` and the columns of ``chain_supports``.
    """
    lg = lambda c: z(F.log1p(F.col(c)))
    part = lambda weights: sum((w * lg(c) for c, w in weights.items()), F.lit(0.0))
    unseen = F.when(F.col("seen") == 0, part(CHAIN_UNSEEN)).otherwise(0.0)
    rows = unique_max(df.withColumns({"__c3": F.col(base) + part(CHAIN) + unseen, "__ring": part(CHAIN_RINGS), "__lift": TIE_SCALE * lg("ring_sum")}), "ring_sum", F.col("seen") == 0)
    lift = F.when(F.col("is_unique_max") == 1, F.col("__ring")).when(F.col("tied_max") == 1, F.col("__lift")).otherwise(0.0)
    return softmaxed(rows.withColumn("__c5", F.col("__c3") + lift), "__c5", "score").drop("__c3", "__c5", "__ring", "__lift", "tied_max", "ties", "is_unique_max")


def component_scores(df: DataFrame, components: list[str]) -> DataFrame:
    """Every component as a z-score, and their plain mean."""
    rows = qnorm(df, components)
    return rows.withColumn("fused", sum((F.col(c) for c in components), F.lit(0.0)) / float(len(components)))


def meta_table(hierarchy: Hierarchy, hist: DataFrame, components: DataFrame, static: DataFrame, base: str, neighbors: DataFrame) -> DataFrame:
    """The wide table of the meta ranker, a row a cell: hierarchy columns, component_<name>, static_<name>, rank_slot (strict
    slots of ``base``), pair_seen and neighbor_<name>.

    ``components(qid, src, time, col, cand, pair_seen, <names>)`` hold the column ``base``, ``static(qid, src, col, cand, <names>)`` are of the same cells,
    ``neighbors(src, cand, <names>)`` of pairs, 0 where there are none. All but the slots is normalised in the query with the larger of
    deviation and 1e-6. A query has one source. All meet in the block of the source, in one shuffle: no two frames of cells are joined.
    """
    cell = ("qid", "col", "src", "time", "cand", "is_pos")
    parts = [[c for c in components.columns if c not in (*cell, "pair_seen")], [c for c in static.columns if c not in cell], [c for c in neighbors.columns if c not in cell]]
    wide = len(parts[2])
    x = lambda df, *cols: df.select(*(c for c in ("qid", "col", "src", "cand") if c in df.columns), F.array(*(F.col(c).cast("double") for c in cols)).alias("x"))
    at = parts[0].index(base)

    def learn(given: list) -> tuple:
        of_kind = lambda k: [b for b in (b.filter(pa.array(arrays.numbers(b, "kind") == k)) for b in given) if b.num_rows]
        levels, near = of_kind(0), of_kind(-1)
        both = lambda rows, c: np.concatenate([arrays.numbers(b, c) for b in rows])
        learned = hierarchy.learn(both(levels, "cand"), np.concatenate([arrays.matrix(b, "x") for b in levels]))
        if not near:
            return learned, None
        src, cand = both(near, "src"), both(near, "cand")
        items = np.unique(cand)
        key = (src - src.min()) * len(items) + np.searchsorted(items, cand)
        order = np.argsort(key)
        return learned, (src.min(), items, key[order], np.concatenate([arrays.matrix(b, "x") for b in near])[order])

    def found(near: tuple | None, src: np.ndarray, cand: np.ndarray) -> np.ndarray:
        out = np.zeros((len(src), wide))
        if near is not None:
            least, items, keys, rows = near
            place = np.minimum(np.searchsorted(items, cand), len(items) - 1)
            key = (src - least) * len(items) + place
            hit = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (items[place] == cand) & (src >= least) & (keys[hit] == key)
            out[there] = rows[hit[there]]
        return out

    def row(learned: tuple, batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        kind = arrays.numbers(batch, "kind")
        first, second = batch.filter(pa.array(kind == 1)), batch.filter(pa.array(kind == 2))
        qid, col, src, cand = (arrays.numbers(first, c) for c in ("qid", "col", "src", "cand"))
        if not (np.array_equal(qid, arrays.numbers(second, "qid")) and np.array_equal(col, arrays.numbers(second, "col"))):
            raise ValueError("components and static features are not of the same cells")
        own = arrays.matrix(first, "x")
        seen, own = own[:, 0].astype(np.int32), own[:, 1:]
        normed = [cells.z(m, "max").T for m in (hierarchy.of(learned[0], cand), own, arrays.matrix(second, "x"), found(learned[1], src, cand))]
        return [qid, col, cand, *normed[0], *normed[1], *normed[2], 1.0 - cells.share(cells.place(-own[:, at])), seen, *normed[3]]

    named = lambda prefix, cols: [f"{prefix}_{c} double" for c in cols]
    schema = ["qid long", "col int", "cand long", *(f"{n} double" for n in hierarchy.names), *named("component", parts[0]), *named("static", parts[1]), "rank_slot double", "pair_seen int", *named("neighbor", parts[2])]
    known = [hierarchy.counts(hist, components), x(neighbors, *parts[2])]
    return arrays.by_source([x(components, "pair_seen", *parts[0]), x(static, *parts[1])], known, F.shiftright("src", hierarchy.shift[0]), learn, row, ", ".join(schema))


def component_meta(hierarchy: Hierarchy, cands: DataFrame, edges: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, base: str, neighbors: DataFrame) -> DataFrame:
    """``meta_table`` of the components and static features of ``cands(qid, src, time, col, cand)``, which are made in the block of the source.

    A query has one source. Neither components nor static features are written or shuffled, only the cells with their times.
    """
    names, near = component_names(), [c for c in neighbors.columns if c not in ("src", "cand")]
    (a, b), at, wide = hierarchy.shift, names.index(base), len(near)
    block = blocks.block_of(cands, a)

    def learn(given: list) -> tuple:
        levels, met = blocks.Known(given, 0), blocks.Known(given, -1)
        return blocks.Pairs(levels.src >> a, levels.cand >> b, hierarchy.columns(levels.x)), blocks.Pairs(met.src, met.cand, met.x), blocks.Sources(given, SIZES, DIMS, 2)

    def row(learned: tuple, batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        levels, met, sources = learned
        qid, col, src, cand = (arrays.numbers(batch, c) for c in ("qid", "col", "src", "cand"))
        static, made = sources.rounded(src, cand, arrays.matrix(batch, "x")[:, 0].astype(np.int64), cells)
        parts = levels.of(src >> a, cand >> b), made, np.stack([static[c] for c in CAUSAL], 1), met.of(src, cand, wide)
        normed = [cells.z(m, "max").T for m in parts]
        return [qid, col, cand, *normed[0], *normed[1], *normed[2], 1.0 - cells.share(cells.place(-made[:, at])), static["pair_seen"].astype(np.int32), *normed[3]]

    named = lambda prefix, cols: [f"{prefix}_{c} double" for c in cols]
    schema = ["qid long, col int, cand long", *(f"{n} double" for n in hierarchy.names), *named("component", names), *named("static", CAUSAL), "rank_slot double", "pair_seen int", *named("neighbor", near)]
    known = [hierarchy.counts(hist, cands), neighbors.select("src", "cand", F.array(*(F.col(c).cast("double") for c in near)).alias("x"))]
    return arrays.by_source([blocks.timed(cands)], known + blocks.source_frames(cands, edges, hist, users, items, block), block, learn, row, ", ".join(schema))
