"""The wide tables of the later stages: components of a cell (M-17), slice features (M-19), set-level features (M-20)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, dot
from . import arrays, blocks
from .features import base_score, transitions
from .history import decay
from .stats import pool_excess
from .support import supported

#: History sizes of the attention components, and leading factors of the factor components.
SIZES = (2, 4, 8, 16, 32)
DIMS = (8, 16, 32, 64)
POOL = ["pool_source_log", "pool_source_excess", "pool_lift", "pool_deviance", "pool_deviance_low", "pool_deviance_mid", "pool_deviance_high"]


def component_names(sizes: tuple[int, ...] = SIZES, dims: tuple[int, ...] = DIMS) -> list[str]:
    """23 of them with the given sizes and dimensions."""
    return [*(f"attention_{k}" for k in sizes), *(f"mf_{d}" for d in dims), *(f"transition_mf_{d}" for d in dims), "pool_frequency", "pair_seen_recency", "transition_count", *POOL]


def pair_components(pairs: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, dims: tuple[int, ...] = DIMS) -> DataFrame:
    """(src, cand, mf_<d>, transition_mf_<d>, transition_count) of distinct ``pairs(src, cand)``.

    ``users/items(id, vec, bias)`` are nested factors, of which a component takes the first d; transitions go from the
    source's last item in the history. What is unknown adds nothing. Products of the last item and the candidate are taken once
    for each two items, and no vector goes with the pairs but that of a source that has one.
    """
    last = hist.groupBy("src").agg(F.max_by("dst", F.struct("time", "seq")).alias("prev"))
    u = users.select(F.col("id").alias("src"), F.col("vec").alias("u"))
    v = items.select(F.col("id").alias("cand"), F.col("vec").alias("v"), F.col("bias").alias("b"))
    p = items.select(F.col("id").alias("prev"), F.col("vec").alias("p"))
    first = lambda c, d: F.slice(c, 1, d)
    part = lambda a, d, name: F.coalesce(dot(first(a, d), first("v", d)), F.lit(0.0)).alias(f"{name}_{d}")
    own = pairs.join(u, "src").join(v, "cand").select("src", "cand", *(part("u", d, "mf") for d in dims))
    rows = pairs.join(last, "src", "left")
    after = rows.where("prev is not null").select("prev", "cand").distinct().join(p, "prev", "left").join(v, "cand", "left").join(transitions(hist).withColumnRenamed("next", "cand"), ["prev", "cand"], "left")
    after = after.select("prev", "cand", *(part("p", d, "transition_mf") for d in dims), "cnt")
    rows = rows.join(after, ["prev", "cand"], "left").join(own, ["src", "cand"], "left").join(v.select("cand", "b"), "cand", "left")
    products = (f"{name}_{d}" for name in ("mf", "transition_mf") for d in dims)
    return rows.select("src", "cand", *((F.coalesce(c, F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias(c) for c in products), F.log1p(F.coalesce("cnt", F.lit(0))).alias("transition_count"))


def component_table(causal: DataFrame, edges: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, sizes: tuple[int, ...] = SIZES, dims: tuple[int, ...] = DIMS) -> DataFrame:
    """The cells of ``causal`` (with the columns of ``causal_features``) and every component of ``component_names``, as they are.

    A query has one source. All is made in the block of the source (``blocks.Sources``), in one shuffle of the cells. ``component_scores`` normalises and fuses.
    """
    block = blocks.block_of(causal)
    cells = causal.select("qid", "col", "src", "cand", F.array(*(c.cast("double") for c in (F.col("time"), F.col("pair_seen"), base_score()))).alias("x"))

    def row(learned: blocks.Sources, batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        qid, col, src, cand = (arrays.numbers(batch, c) for c in ("qid", "col", "src", "cand"))
        time, seen, base = arrays.matrix(batch, "x").T
        time = time.astype(np.int64)
        return [qid, src, time, col, cand, seen.astype(np.int32), *learned.components(src, cand, time, base, cells).T]

    schema = ", ".join(["qid long, src long, time long, col int, cand long, pair_seen int", *(f"{c} double" for c in component_names(sizes, dims))])
    known = blocks.source_frames(causal.select("qid", "src", "time", "col", "cand"), edges, hist, users, items, block)
    return arrays.by_source([cells], known, block, lambda given: blocks.Sources(given, sizes, dims), row, schema)


#: Widths of the buckets in days, rolling frames in days before and after, and thresholds of the excess.
BUCKETS = (60, 14, 30, 90, 180)
ROLLING = {"roll_30": (30, 30), "roll_60": (60, 60), "roll_90": (90, 90), "past_60": (60, 0), "future_60": (0, 60)}
EXCESS = {"excess_m1": -1.0, "excess_0": 0.0, "excess_1": 1.0, "excess_2": 2.0}
SOURCE_BUCKETS = (60, 180)
POPULARITY = (30, 90, 365)


def slice_names(models: list[str]) -> list[str]:
    """28 of them with three models."""
    return [*models, "blend", "pool_log", "pool_linear", "bucket_60", "source_count", "pop_log", *(f"pop_{d}" for d in POPULARITY), "freshness", *(f"bucket_{w}" for w in BUCKETS[1:]), *ROLLING, *EXCESS, *(f"source_bucket_{w}" for w in SOURCE_BUCKETS)]


def _daily(rows: DataFrame, keys: list[str], widths: tuple[int, ...], total: str, rolling: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, day, total, b<w>_now, b<w>_moved, <rolling>) from the counts of a day.

    Buckets are whole days wide and shifted by whole days, so every count is a sum of daily ones: the cells are
    shuffled once, by the keys, and each window over these finds its rows in place. A key has one row a day.
    """
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("n")).repartition(*keys)
    over = lambda *more: Window.partitionBy(*keys, *more)
    at = lambda w, off: F.floor((F.col("day") + off) / w)
    sums = {total: F.sum("n").over(over())}
    for w in widths:
        sums |= {f"b{w}_{k}": F.sum("n").over(over(at(w, off))) for k, off in (("now", 0), ("moved", w // 2))}
    sums |= {k: F.sum("n").over(over().orderBy("day").rangeBetween(-b, a)) for k, (b, a) in rolling.items()}
    return days.select(*keys, "day", *(e.alias(k) for k, e in sums.items()))


def slice_features(cands: DataFrame, hist: DataFrame, models: DataFrame | None, blend: dict[str, float], n_items: DataFrame, origin: int, pool_weight: float = 0.07, factors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, col, <slice_names>), all normalised in the query.

    ``models(qid, col, <names of blend>)`` are fitted scores, blended by their weights with the pool's log count, or None where
    the cells have them, or where they are the mf_<d> of ``factors``, the users and items of ``pair_components``, at nine digits; ``n_items`` is one row with the number of items that candidates are drawn from. Counts of the pool are
    over the whole pool of cells, so over later ones too; popularity and freshness are of the history before ``origin``.
    A query has one source. What belongs to an item and day, or to an item, comes once to each block of sources that holds it, what belongs to a source once; cells carry their day and given models only.
    """
    first = F.broadcast(cands.agg(F.min("time").alias("__t0")))
    day = F.floor((F.col("time") - F.col("__t0")) / DAY).alias("day")
    cells = cands if models is None else cands.join(models, ["qid", "col"])
    given = [] if factors else list(blend)
    cells = cells.crossJoin(first).select("qid", "src", "col", "cand", day, *given)
    days = cands.crossJoin(first).select("src", "cand", day).groupBy("src", "cand", "day").agg(F.count("*").alias("n"))
    block = blocks.block_of(cands)
    rows = cands.crossJoin(first).select("cand", day)
    popular = hist.groupBy(F.col("dst").alias("cand")).agg(F.count("*").alias("pop"), F.max("time").alias("last"), *(F.sum(decay(F.col("time"), origin, d * DAY)).alias(f"pop_{d}") for d in POPULARITY))
    excess = pool_excess(cands, n_items, tuple(EXCESS.values())).drop("cnt").withColumnsRenamed({f"excess_{i}": f"__{k}" for i, k in enumerate(EXCESS)})
    halves = [f"b{w}_{k}" for w in BUCKETS for k in ("now", "moved")]
    age = F.when(F.col("last").isNull(), -1.0).otherwise(F.greatest(F.lit(origin) - F.col("last"), F.lit(0)) / float(DAY))
    raw = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("pool", "pop", *(f"pop_{d}" for d in POPULARITY), *halves, *ROLLING)} | {"age": age} | {k: F.col(f"__{k}") for k in EXCESS}
    by_item = _daily(rows, ["cand"], BUCKETS, "pool", ROLLING).join(excess.join(popular, "cand", "left"), "cand").select("cand", "day", F.array(*(e.cast("double") for e in raw.values())).alias("item"))
    held = cells.select(block.alias("block"), "cand", "day").distinct().join(by_item, ["cand", "day"])
    held = held.select("block", F.col("day").cast("long").alias("qid"), F.lit(0).cast("long").alias("src"), "cand", F.col("item").alias("x"))
    cells = cells.select("qid", "col", "src", "cand", F.array(*(F.col(c).cast("double") for c in ("day", *given))).alias("x"))
    at = {k: i for i, k in enumerate(raw)}
    dims = tuple(int(k.removeprefix("mf_")) for k in blend) if factors else ()
    moves = [(w, off) for w in SOURCE_BUCKETS for off in (0, w // 2)]

    def learn(rows: list) -> tuple:
        known, held = blocks.Known(rows, 0), blocks.Known(rows, -1)
        vecs = [blocks.Known(rows, -2).by("src"), blocks.Known(rows, -3).by("cand"), blocks.Known(rows, -4).by("cand")] if dims else []
        (day, n), items = known.x.T, np.unique(known.cand)
        src, day = known.src, day.astype(np.int64)
        pair = (np.searchsorted(np.unique(src), src)) * len(items) + np.searchsorted(items, known.cand)

        def within(bucket: np.ndarray) -> np.ndarray:
            _, group = np.unique(np.stack([pair, bucket]), axis=1, return_inverse=True)
            return np.bincount(group.reshape(-1), n)[group.reshape(-1)]

        counts = np.stack([within(np.zeros_like(day)), *(within((day + off) // w) for w, off in moves)], 1)
        key = pair * (day.max() + 1) + day
        order = np.argsort(key)
        return np.unique(src), items, day.max() + 1, key[order], counts[order], blocks.Pairs(held.cand, held.qid, held.x), vecs

    def features(learned: tuple, batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        sources, items, span, keys, counts, held, vecs = learned
        src, cand, x = arrays.numbers(batch, "src"), arrays.numbers(batch, "cand"), arrays.matrix(batch, "x")
        day = x[:, 0].astype(np.int64)
        own = counts[np.searchsorted(keys, (np.searchsorted(sources, src) * len(items) + np.searchsorted(items, cand)) * span + day)]
        m = held.of(cand, day)
        models = x[:, 1:].T
        if dims:
            user, item, bias = vecs
            at_bias = blocks.place(bias.cand, cand)
            products = blocks.dots(user, blocks.place(user.src, src), item, blocks.place(item.cand, cand), dims)
            models = blocks.at_nine(products + (np.where(at_bias >= 0, bias.x[at_bias, 0], 0.0)[:, None] if len(bias.cand) else 0.0)).T
        models = dict(zip(blend, models, strict=True))
        of, log = lambda k: models[k] if k in models else m[:, at[k]], lambda k: np.log1p(m[:, at[k]])
        out = {k: of(k) for k in blend} | {"pool_log": log("pool"), "pool_linear": of("pool"), "source_count": own[:, 0], "pop_log": log("pop")}
        out |= {f"pop_{d}": log(f"pop_{d}") for d in POPULARITY} | {"freshness": np.where(of("age") < 0, -30.0, -np.log1p(np.maximum(of("age"), 0)))}
        out |= {k: log(k) for k in ROLLING} | {k: of(k) for k in EXCESS} | {h: log(h) for h in halves} | {f"s{w}_{off}": np.log1p(own[:, i]) for i, (w, off) in enumerate(moves, 1)}
        out = dict(zip(out, cells.z(np.stack(list(out.values()), 1)).T, strict=True))
        out |= {f"bucket_{w}": (out[f"b{w}_now"] + out[f"b{w}_moved"]) / 2.0 for w in BUCKETS} | {f"source_bucket_{w}": (out[f"s{w}_0"] + out[f"s{w}_{w // 2}"]) / 2.0 for w in SOURCE_BUCKETS}
        out["blend"] = cells.z(sum((w * out[k] for k, w in blend.items()), pool_weight * out["pool_log"]))
        return [arrays.numbers(batch, "qid"), arrays.numbers(batch, "col"), *(out[k] for k in names)]

    names = slice_names(list(blend))
    known = days.select("src", "cand", F.array(F.col("day").cast("double"), F.col("n").cast("double")).alias("x"))
    known = [known, held]
    if factors:
        users, vectors = factors
        biased = vectors.where("bias <> 0").select(F.col("id").alias("cand"), F.array(F.col("bias").cast("double")).alias("x"))
        known += blocks.vector_frames(cands, users, vectors, block)
        known.append(cands.select(block.alias("block"), "cand").distinct().join(biased, "cand").select("block", F.lit(0).cast("long").alias("src"), "cand", "x"))
    return arrays.by_source([cells], known, block, learn, features, ", ".join(["qid long, col int", *(f"{k} double" for k in names)]))


#: Published rings in seconds, of the own source and of others; others also at the very time.
OWN_RINGS = (0, 300, 900, 3600, 21_600, 86_400)
CROSS_RINGS = (300, 900, 3600)
SET_SUPPORTS = [*(f"source_{a}_{b}" for a, b in zip(OWN_RINGS, OWN_RINGS[1:])), "cross_exact", *(f"cross_{a}_{b}" for a, b in zip(CROSS_RINGS, CROSS_RINGS[1:]))]


def set_supports(cands: DataFrame, *keep: str) -> DataFrame:
    """(qid, col, cand, <keep>, <SET_SUPPORTS>): pool rows with the item by distance in time, one pass over the pool's frames."""
    frames = lambda kind, radii: {f"{kind}{r}": (-r, r) for r in radii}
    ring = lambda short, kind, radii: [(F.col(f"{short}{b}") - F.col(f"{short}{a}")).alias(f"{kind}_{a}_{b}") for a, b in zip(radii, radii[1:])]
    rows = supported(cands.select("qid", "src", "time", "col", "cand"), frames("s", OWN_RINGS), frames("o", (0, *CROSS_RINGS)))
    return rows.select("qid", "col", "cand", *keep, *ring("s", "source", OWN_RINGS), F.col("o0").alias("cross_exact"), *ring("o", "cross", CROSS_RINGS))


def set_features(df: DataFrame, scores: list[str], supports: list[str], apart: DataFrame | None = None) -> DataFrame:
    """Set-level columns of ``df(qid, col, pair_seen, ...)``: of every score (components and the base) <name>_z, <name>_rank (in
    [0, 1], ties by column) and <name>_gap (z less the query's largest z), pair_seen, and of every support z(log1p).

    Supports may be a frame of their own, ``apart(qid, col, <supports>)`` of the same cells: both are dealt by query, side by side.
    """
    x = lambda rows, kind, names: rows.select("qid", "col", F.lit(kind).alias("kind"), F.array(*(F.col(c).cast("double") for c in names)).alias("x"))
    rows = x(df, 1, ["pair_seen", *scores]).unionByName(x(df if apart is None else apart, 2, supports))

    def features(batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        own, near = arrays.side_by_side(batch)
        m = arrays.matrix(own, "x")
        return [arrays.numbers(own, "qid"), arrays.numbers(own, "col"), *_set_columns(m[:, 0], m[:, 1:], arrays.matrix(near, "x"), cells)]

    return arrays.by_query(rows, features, _set_schema(scores, supports))


def _set_columns(seen: np.ndarray, m: np.ndarray, near: np.ndarray, cells: arrays.Cells) -> list[np.ndarray]:
    normed = cells.z(m)
    ranks = [cells.share(cells.place(c)) for c in m.T]
    return [seen.astype(np.int32), *(c for pair in zip(normed.T, ranks, strict=True) for c in pair), *(normed - cells.top(normed)).T, *cells.z(np.log1p(np.maximum(near, 0))).T]


def _set_schema(scores: list[str], supports: list[str]) -> str:
    kept = [f"{c}_{k}" for c in scores for k in ("z", "rank")] + [f"{c}_gap" for c in scores] + list(supports)
    return ", ".join(["qid long, col int, pair_seen int", *(f"{c} double" for c in kept)])


def component_sets(cands: DataFrame, edges: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``set_features`` of the components of ``component_names`` at nine digits, the base and ``set_supports``, of ``cands(qid, src, time, col, cand)``.

    A query has one source. Components are made and ranked in the block of the source, so they are neither written nor shuffled; the supports meet the cells there.
    """
    block, base = blocks.block_of(cands), component_names().index("pair_seen_recency")
    near = set_supports(cands, "src").select("qid", "col", "src", "cand", F.array(*(F.col(c).cast("double") for c in SET_SUPPORTS)).alias("x"))

    def row(learned: blocks.Sources, batch: pa.RecordBatch, cells: arrays.Cells) -> list[np.ndarray]:
        own, near = arrays.side_by_side(batch)
        qid, col, src, cand = (arrays.numbers(own, c) for c in ("qid", "col", "src", "cand"))
        static, made = learned.rounded(src, cand, arrays.matrix(own, "x")[:, 0].astype(np.int64), cells)
        return [qid, col, *_set_columns(static["pair_seen"], np.column_stack([made, made[:, base]]), arrays.matrix(near, "x"), cells)]

    known = blocks.source_frames(cands, edges, hist, users, items, block)
    return arrays.by_source([blocks.timed(cands), near], known, block, lambda given: blocks.Sources(given, SIZES, DIMS), row, _set_schema([*component_names(), "base"], SET_SUPPORTS))
