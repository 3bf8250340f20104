"""Searches for fusion weights, gates and policies by mean reciprocal rank (M-5..M-8, M-22, M-23).

A query's cells are kept as one row of differences to its positive, so that any linear score needs no window and no
shuffle: a sweep counts, for every point of a grid, the cells above the positive, and only the grid's means reach the driver.
A list is as long as a query's candidates. Scores closer than 1e-9 are equal; the lower column is then first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Q
from . import arrays
from .rank import qnorm

TIE = 1e-9
#: Published step ladders of the convex search.
LADDERS = [[k * s for k in range(1, 11)] for s in (0.05, 0.02, 0.01, 0.005, 0.002, 0.001)]
#: Published signed steps of the residual search, coarse and fine.
SIGNED = [[k * 0.025 for k in range(-4, 9) if k], [k * 0.01 for k in range(-4, 9) if k]]
#: Published radii and steps of the gate's grids.
RADII = ((1.0, 0.1), (0.1, 0.02), (0.02, 0.005))


def _of_positive(c: Column | str) -> Column:
    return F.max(F.when(F.col("is_pos"), F.col(c) if isinstance(c, str) else c)).over(Q())


def difference_lists(df: DataFrame, names: list[str]) -> DataFrame:
    """(qid, cells): each cell's components minus the positive's, and the ``edge`` that a lead must pass. Queries without a positive go."""
    edge = F.when(F.col("col") < _of_positive("col"), -TIE).when(_of_positive("col").isNotNull(), TIE)
    rows = df.select("qid", edge.alias("edge"), *((F.col(c) - _of_positive(c)).cast("double").alias(c) for c in names))
    return rows.where("edge is not null").groupBy("qid").agg(F.collect_list(F.struct("edge", *names)).alias("cells"))


def linear_mrr(lists: DataFrame, names: list[str], grid: list[list[float]]) -> list[float]:
    """MRR of every weight vector of the grid, in one job: a task counts over all cells of a batch of queries at once and
    hands on two numbers a vector. A sweep is short, so its tasks are as few as the cores ask for; batches stream through."""

    def counted(batches):
        sums, queries = np.zeros(len(grid)), 0
        for batch in batches:
            cells = batch.column("cells")
            flat = cells.flatten()
            if not len(flat):
                continue
            column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
            edge, parts = column("edge"), [column(c) for c in names]
            ends = cells.offsets.to_numpy() - cells.offsets[0].as_py()
            for g, p in enumerate(grid):
                lead = sum((w * x for w, x in zip(p, parts, strict=True)), 0.0)
                upto = np.concatenate(([0], np.cumsum(lead > edge)))
                sums[g] += (1.0 / (1 + upto[ends[1:]] - upto[ends[:-1]])).sum()
            queries += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(sums), pa.array([queries] * len(grid), pa.int64())], ["i", "s", "n"])

    some = lists.select("cells").coalesce(2 * lists.sparkSession.sparkContext.defaultParallelism)
    rows = some.mapInArrow(counted, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m")).collect()
    return [round(r.m or 0.0, 12) for r in sorted(rows, key=lambda r: r.i)] or [0.0] * len(grid)


def _climb(lists: DataFrame, names: list[str], at: list[float], movable: list[int], ladders: list[list[float]], move: Callable[[list[float], int, float], list[float]]) -> tuple[list[float], float]:
    """The best move of a sweep over (component, step) is taken as long as one gains more than 1e-10, ladder after ladder."""
    best = linear_mrr(lists, names, [at])[0]
    for steps in ladders:
        while True:
            tries = [move(at, i, s) for i in movable for s in steps]
            found = linear_mrr(lists, names, tries)
            top = max(range(len(tries)), key=lambda t: (found[t], -t), default=None)
            if top is None or found[top] <= best + 1e-10:
                break
            at, best = tries[top], found[top]
    return at, best


def _toward(at: list[float], i: int, step: float) -> list[float]:
    return [(1 - step) * w + step * (k == i) for k, w in enumerate(at)]


def _added(at: list[float], i: int, step: float) -> list[float]:
    return [w + step * (k == i) for k, w in enumerate(at)]


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _weights(df: DataFrame, names: list[str], at: list[float], best: float) -> DataFrame:
    total = sum(at) or 1.0
    return _table(df, [(c, float(w / total), best) for c, w in zip(names, at, strict=True)], "component string, weight double, mrr double")


def tune_convex(df: DataFrame, components: list[str], ladders: list[list[float]] = LADDERS) -> DataFrame:
    """Convex weights of the z-scored components: from the best single one, steps toward one component, six ladders down to
    .001, each until a whole sweep brings nothing."""
    lists = difference_lists(qnorm(df.select("qid", "col", "is_pos", *components), components), components).persist()
    alone = [[float(k == i) for k in range(len(components))] for i in range(len(components))]
    found = linear_mrr(lists, components, alone)
    start = alone[max(range(len(alone)), key=lambda i: (found[i], -i))]
    at, best = _climb(lists, components, start, list(range(len(components))), ladders, _toward)
    lists.unpersist()
    return _weights(df, components, at, best)


def tune_innovations(df: DataFrame, control: dict[str, float], innovations: list[str], base: str | None = None, seen_alpha: float = 1.0, new_alpha: float = 1.0, ladders: list[list[float]] = LADDERS) -> DataFrame:
    """Steps toward innovations only, from a fitted control whose weights keep their proportions; scored behind the gate
    base + alpha * (mix - base) where a ``base`` is given."""
    names = [*control, *(c for c in innovations if c not in control)]
    every = list(dict.fromkeys([*names, *([base] if base else [])]))
    rows = qnorm(df.select("qid", "col", "is_pos", "seen", *every), every)
    if base:
        alpha = F.when(F.col("seen") == 1, float(seen_alpha)).otherwise(float(new_alpha))
        rows = rows.select("qid", "col", "is_pos", *((F.col(base) + alpha * (F.col(c) - F.col(base))).alias(c) for c in names))
    lists = difference_lists(rows, names).persist()
    total = sum(control.values())
    start = [control.get(c, 0.0) / total for c in names]
    at, best = _climb(lists, names, start, [names.index(c) for c in innovations], ladders, _toward)
    lists.unpersist()
    return _weights(df, names, at, best)


def _axis(at: float, radius: float, step: float) -> list[float]:
    low, high = max(0.0, at - radius), min(1.0, at + radius)
    return [low + k * step for k in range(int((high - low) / step + 0.5) + 1)]


def fit_gate(df: DataFrame, base: str, mixed: str, radii: tuple[tuple[float, float], ...] = RADII) -> DataFrame:
    """(radius, seen_alpha, new_alpha, mrr): the best gate of a full grid from (0, 0), then of ever finer ones round the best
    so far. Equal gains go to the smaller sum of both, then to the smaller seen_alpha."""
    gap = F.col(mixed) - F.col(base)
    rows = df.select("qid", "col", "is_pos", F.col(base).alias("b"), F.when(F.col("seen") == 1, gap).otherwise(0.0).alias("s"), F.when(F.col("seen") == 1, 0.0).otherwise(gap).alias("n"))
    lists, at, out = difference_lists(rows, ["b", "s", "n"]).persist(), (0.0, 0.0), []
    for radius, step in radii:
        grid = [(s, n) for s in _axis(at[0], radius, step) for n in _axis(at[1], radius, step)]
        found = linear_mrr(lists, ["b", "s", "n"], [[1.0, s, n] for s, n in grid])
        value, at = max(zip(found, grid, strict=True), key=lambda x: (x[0], -round(sum(x[1]), 9), -x[1][0]))
        out.append((float(radius), *at, value))
    lists.unpersist()
    return _table(df, out, "radius double, seen_alpha double, new_alpha double, mrr double")


def tune_residual(df: DataFrame, control: str, signals: list[str], gates: dict[str, Column] | None = None, keep: int = 4, ladders: list[list[float]] = SIGNED) -> DataFrame:
    """Signed weights of z-scored signals added to a control where a gate is open: for each gate two ladders until a sweep
    brings nothing, then the ``keep`` largest weights alone; the best gate's weights, or zeros where none helps."""
    names, best = [control, *signals], None
    for gate, on in (gates or {"all": F.lit(True)}).items():
        rows = qnorm(df.withColumn("__on", on), signals)
        rows = rows.select("qid", "col", "is_pos", control, *(F.when(F.col("__on"), F.col(c)).otherwise(0.0).alias(c) for c in signals))
        lists = difference_lists(rows, names).persist()
        zero = [1.0] + [0.0] * len(signals)
        best = best or (linear_mrr(lists, names, [zero])[0], zero, "all")
        at, value = _climb(lists, names, zero, list(range(1, len(names))), ladders, _added)
        largest = sorted(range(1, len(names)), key=lambda i: (-abs(at[i]), i))[:keep]
        if any(abs(w) > 1e-12 and i not in largest for i, w in enumerate(at) if i):
            at = [w if i == 0 or i in largest else 0.0 for i, w in enumerate(at)]
            value = linear_mrr(lists, names, [at])[0]
        if value > best[0] + 1e-10:
            best = (value, at, gate)
        lists.unpersist()
    return _table(df, [(c, float(w), best[2], best[0]) for c, w in zip(names, best[1], strict=True)], "component string, weight double, gate string, mrr double")


def weight_families(members: dict[str, str]) -> dict[str, dict[str, float]]:
    """Weights of members in two groups ``{member: group}``: equal, each left out, each group alone, and four shares of the first group."""
    out = {"equal": dict.fromkeys(members, 1 / len(members))}
    for m in members:
        out[f"without_{m}"] = {k: 0.0 if k == m else 1 / (len(members) - 1) for k in members}
    groups = list(dict.fromkeys(members.values()))
    size = {g: sum(v == g for v in members.values()) for g in groups}
    for g in groups:
        out[f"only_{g}"] = {k: float(v == g) / size[g] for k, v in members.items()}
    for share in (0.25, 0.375, 0.625, 0.75):
        out[f"{groups[0]}_{share:g}"] = {k: (share if v == groups[0] else (1 - share) / (len(groups) - 1)) / size[v] for k, v in members.items()}
    return out


def evaluate_families(df: DataFrame, members: dict[str, str]) -> DataFrame:
    """MRR of each family over z-scored members, all in one job."""
    names, families = list(members), weight_families(members)
    lists = difference_lists(qnorm(df.select("qid", "col", "is_pos", *names), names), names)
    found = linear_mrr(lists, names, [[w[c] for c in names] for w in families.values()])
    return _table(df, list(zip(families, found, strict=True)), "family string, mrr double")


#: Published grid of the policy.
NEW_WEIGHTS = [k / 4 for k in range(5)]
SLOT_ALPHAS = [k / 20 for k in range(41)]
MARGINS = [0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]
ESCAPES = [k / 10 for k in range(1, 16)]


def _policy_sums(df: DataFrame, control: str, old: str, new: str) -> tuple[int, int, dict[str, np.ndarray]]:
    """Numbers of queries, and of those whose positive is seen, and sums of the positive's reciprocal ranks over all (place 0)
    and over those alone (place 1): ``before``; under every slot alpha (W-16: unseen cells deal their slots among themselves),
    ``slots`` over all queries and ``under`` over those whose gap is below each margin; under every escape alpha (residual added to
    unseen cells), ``direct``, over those whose gap reaches it. Any pair of slots and escapes is a sum of the two: queries are
    gone through once, and a task hands on as many numbers as the grid has."""
    alphas, margins, escapes, n = np.array(SLOT_ALPHAS), np.array(MARGINS), np.array(ESCAPES), len(NEW_WEIGHTS)
    shapes = {"queries": (2,), "before": (2,), "slots": (2, n, len(alphas)), "under": (2, n, len(alphas), len(margins)), "direct": (2, n, len(escapes), len(margins))}

    def counted(batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        col, pos, seen, c = arrays.numbers(batch, "col"), arrays.numbers(batch, "is_pos").astype(bool), arrays.numbers(batch, "seen") == 1, arrays.numbers(batch, "c")
        own = lambda x: cells.top(np.where(pos, x, -np.inf))
        has = np.logical_or.reduceat(pos, cells.starts)
        edge = np.where(col < own(col), -TIE, TIE)
        open_ = ~seen & has[cells.query]
        lead = np.where(has[cells.query], c - np.where(has[cells.query], own(c), 0), -np.inf)
        above = lambda lift, only: np.add.reduceat(((lead + lift > edge) & only).astype(np.int64), cells.starts)
        every, pos_seen = np.ones(len(col), bool), np.maximum.reduceat(np.where(pos & seen, 1, 0), cells.starts) == 1
        place, free = cells.place(-c), np.flatnonzero(open_)
        free = free[np.lexsort((place[free], cells.query[free]))]
        first = np.searchsorted(cells.query[free], np.arange(len(cells.starts)))
        best = lambda flags: np.maximum.reduceat(np.where(flags, c, -np.inf), cells.starts)
        a, b = best(~seen), best(seen)
        with np.errstate(invalid="ignore"):
            gap = np.where(np.isneginf(b), 4.0, np.where(np.isneginf(a), -4.0, np.clip(a - b, -4.0, 4.0)))
        reach = gap[:, None] >= margins
        groups = np.stack([has, has & pos_seen]).astype(float)
        slot_of = free if len(free) else np.zeros(1, np.int64)
        control_rank = above(np.zeros(len(col)), every)
        sums = {"queries": groups.sum(1), "before": groups @ (1.0 / (1 + control_rank))} | {k: np.zeros(s) for k, s in shapes.items() if k not in ("queries", "before")}
        for w, share in enumerate(NEW_WEIGHTS):
            lift = np.where(seen, 0.0, cells.z((1 - share) * arrays.numbers(batch, "a") + share * arrays.numbers(batch, "b")))
            lift = lift - np.where(has[cells.query], own(lift), 0)
            for i, alpha in enumerate(alphas):
                dealt = place[slot_of[np.minimum(first + above(alpha * lift, open_), len(slot_of) - 1)]]
                r = 1.0 / (1 + np.where(pos_seen, control_rank, dealt))
                sums["slots"][:, w, i], sums["under"][:, w, i] = groups @ r, (groups * r) @ ~reach
            for i, alpha in enumerate(escapes):
                sums["direct"][:, w, i] = (groups / (1.0 + above(alpha * lift, every))) @ reach
        flat = np.concatenate([sums[k].reshape(-1) for k in shapes])
        return [np.arange(len(flat)).astype(np.int32), flat]

    rows = arrays.by_query(df.select("qid", "col", "is_pos", "seen", *(F.col(x).alias(k) for k, x in (("c", control), ("a", old), ("b", new)))), counted, "i int, s double")
    found = rows.groupBy("i").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
    for r in found:
        flat[r.i] = r.s
    out, at = {}, 0
    for k, s in shapes.items():
        out[k], at = flat[at : at + int(np.prod(s))].reshape(s), at + int(np.prod(s))
    return int(out["queries"][0]), int(out["queries"][1]), out


def tune_policy(df: DataFrame, control: str, old: str, new: str, most_loss: float = 0.001) -> DataFrame:
    """The nested policy grid, one row a residual weight: its best slot alpha, then its best escape (margin, alpha) among those
    that cost seen positives at most ``most_loss`` of the control's MRR, or none (0, margin 4); ``chosen`` marks the best row."""
    queries, of_seen, sums = _policy_sums(df, control, old, new)
    mean = lambda x, n: round(float(x) / max(n, 1), 12)
    alphas, n = len(SLOT_ALPHAS), len(NEW_WEIGHTS)
    slot = [[mean(sums["slots"][0, w, a], queries) for a in range(alphas)] for w in range(n)]
    best = [max(range(alphas), key=lambda a, w=w: (slot[w][a], -a)) for w in range(n)]
    trial = lambda k, w, m, e: mean(sums["direct"][k, w, e, m] + sums["under"][k, w, best[w], m], (queries, of_seen)[k])
    least, out = mean(sums["before"][1], of_seen) - most_loss, []
    for w in range(n):
        allowed = [(m, e) for m in range(len(MARGINS)) for e in range(len(ESCAPES)) if not of_seen or trial(1, w, m, e) >= least]
        found = [(slot[w][best[w]], 0.0, 4.0)] + [(trial(0, w, m, e), ESCAPES[e], MARGINS[m]) for m, e in allowed]
        value, escape, margin = max(found, key=lambda x: (x[0], -x[1], x[2]))
        out.append((NEW_WEIGHTS[w], SLOT_ALPHAS[best[w]], margin, escape, value))
    top = max(range(n), key=lambda w: (out[w][4], -w))
    return _table(df, [(*r, w == top) for w, r in enumerate(out)], "new_weight double, slot_alpha double, escape_margin double, escape_alpha double, mrr double, chosen boolean")
