"""Support of a cell by other cells of the candidate pool, in time windows; whole-pool and so transductive.

No range joins: cells are deduplicated and folded to seconds, and frames over (item, bucket of time; order by seconds) count
them. With a pool of its own, pool rows (weight 1) and probes (weight 0) are one union under the same frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, range_counts
from ..functions.tables import groups, written
from .rank import qnorm


def distinct_occurrences(cands: DataFrame) -> DataFrame:
    """One row for each item of a query row, with its first column.

    Cells are dealt out first: hardly any repeats, so folding them where they lie would only hold a whole split of the input,
    tens of millions of rows where these compress well, in one task's memory.
    """
    return cands.repartition("qid", "cand").groupBy("qid", "src", "time", "cand").agg(F.min("col").alias("col"))


def cross_exact(cands: DataFrame) -> DataFrame:
    """Other sources' query rows with the item at the very time."""
    cells = distinct_occurrences(cands)
    every = cells.groupBy("time", "cand").agg(F.count("*").alias("n_all"))
    own = cells.groupBy("src", "time", "cand").agg(F.count("*").alias("n_own"))
    return cells.join(every, ["time", "cand"]).join(own, ["src", "time", "cand"]).select("qid", "cand", (F.col("n_all") - F.col("n_own")).alias("cross"))


def supported(cells: DataFrame, own: dict[str, tuple[int, int]], others: dict[str, tuple[int, int]]) -> DataFrame:
    """The cells, with all of their columns, and the names of ``own`` and ``others``: rows of the pool with the item whose time is in
    [t + a, t + b], of the same source or of others. The own row counts, a repeated item of a row counts once; ``first`` marks the
    one that does.

    Cells are dealt once, by item and bucket of time, and copied into the buckets that see them; the running totals of an item
    and of each of its sources are windows over that one share, and nothing is joined back.
    """
    every = {**own, **others}
    low, high = min(0, *(a for a, _ in every.values())), max(0, *(b for _, b in every.values()))
    width = max(2 * (high - low), 3600)
    at = lambda shift: F.floor((F.col("time") + F.lit(shift)) / width)
    seen = cells.withColumn("__bucket", F.explode(F.sequence(at(-high), at(-low)))).withColumn("__own", F.col("__bucket") == at(0))
    rest = [c for c in cells.columns if c not in ("qid", "src", "time", "cand")]
    seen = seen.withColumns({c: F.when(F.col("__own"), F.col(c)) for c in rest}).repartition("cand", "__bucket")
    item, source = Window.partitionBy("cand", "__bucket"), Window.partitionBy("cand", "__bucket", "src")
    rows = seen.withColumn("first", F.coalesce(F.lag("qid").over(source.orderBy("time", "qid")) != F.col("qid"), F.lit(True)))
    ends = lambda frames: sorted({e for a, b in frames.values() for e in (a - 1, b)})
    place = {e: i for i, e in enumerate(ends(every))}
    upto = lambda by, e: F.coalesce(F.sum(F.col("first").cast("int")).over(by.orderBy("time").rangeBetween(Window.unboundedPreceding, e)), F.lit(0))
    rows = rows.select("*", *(upto(source, e).alias(f"__s{i}") for e, i in place.items()))
    rows = rows.select("*", *(upto(item, e).alias(f"__i{place[e]}") for e in ends(others)))
    count = lambda k, a, b: F.col(f"__{k}{place[b]}") - F.col(f"__{k}{place[a - 1]}")
    names = [count("s", *f).alias(n) for n, f in own.items()] + [(count("i", *f) - count("s", *f)).alias(n) for n, f in others.items()]
    return rows.where("__own").select(*cells.columns, "first", *names)


def windowed_support(cands: DataFrame, frames: dict[str, tuple[int, int]], same_source: bool, pool: DataFrame | None = None) -> DataFrame:
    """(qid, cand, <frame names>): pool rows with the item whose time is in [t + a, t + b], of the own source or of others.

    The own row is among those counted if 0 is in the frame. With a pool of its own, counts are made for distinct (item, source,
    second) and, for others, (item, second), in buckets of time, and joined back to the cells.
    """
    if pool is None:
        rows = supported(cands.select("qid", "src", "time", "cand"), *((frames, {}) if same_source else ({}, frames)))
        return rows.where("first").select("qid", "cand", *frames)
    cells = distinct_occurrences(cands)
    point = lambda df, n, probe: df.select("cand", "src", "time", F.lit(n).alias("n"), F.lit(probe).alias("probe"))
    points = point(cells, 0, 1).union(point(distinct_occurrences(pool), 1, 0))
    own = range_counts(points, ["cand", "src"], frames)
    if same_source:
        return cells.join(own, ["cand", "src", "time"]).select("qid", "cand", *frames)
    own = own.withColumnsRenamed({n: f"__{n}" for n in frames})
    every = range_counts(points, ["cand"], frames)
    return cells.join(own, ["cand", "src", "time"]).join(every, ["cand", "time"]).select("qid", "cand", *((F.col(n) - F.col(f"__{n}")).alias(n) for n in frames))


def near_support(cands: DataFrame, w: int, same_source: bool, pool: DataFrame | None = None) -> DataFrame:
    return windowed_support(cands, {"near": (-w, w)}, same_source, pool)


def directional_support(cands: DataFrame, w: int, same_source: bool, pool: DataFrame | None = None) -> DataFrame:
    return windowed_support(cands, {"past": (-w, -1), "future": (1, w)}, same_source, pool)


RINGS = (0, 300, 900, 3600, 21_600, 86_400)


def ring_support(cands: DataFrame, same_source: bool = True, rings: tuple[int, ...] = RINGS) -> DataFrame:
    """ring_i: support at distances in (rings[i], rings[i + 1]], both directions; differences of one window's frames."""
    rows = windowed_support(cands, {f"w{i}": (-r, r) for i, r in enumerate(rings)}, same_source)
    return rows.select("qid", "cand", *((F.col(f"w{i + 1}") - F.col(f"w{i}")).alias(f"ring_{i}") for i in range(len(rings) - 1)))


def consensus(cands: DataFrame, w: int) -> DataFrame:
    """Of the item in the pool: distinct sources, distinct times within w seconds, distinct query rows but the own."""
    cells = distinct_occurrences(cands)
    sources = cells.groupBy("cand").agg(F.count_distinct("src").alias("sources"), (F.count("*") - 1).alias("rows"))
    times = range_counts(cells.select("cand", "time", F.lit(1).alias("n"), F.lit(1).alias("probe")).distinct(), ["cand"], {"times": (-w, w)})
    return cells.join(sources, "cand").join(times, ["cand", "time"]).select("qid", "cand", "sources", "times", "rows")


def _from_first(cands: DataFrame) -> DataFrame:
    """The cells with ``__age``: seconds from the first query of all."""
    return cands.crossJoin(F.broadcast(cands.agg(F.min("time").alias("__t0")))).withColumn("__age", F.col("time") - F.col("__t0")).drop("__t0")


def bucket_count(cands: DataFrame, days: int) -> DataFrame:
    """Cells with the candidate in the tumbling bucket, as log1p normalised in the query, averaged with the same for
    buckets shifted by half the width in whole days."""
    rows = _from_first(cands)
    for name, off in (("now", 0), ("moved", days // 2 * DAY)):
        at = F.floor((F.col("__age") + off) / (days * DAY))
        counts = rows.groupBy(at.alias("__at"), "cand").agg(F.log1p(F.count("*")).alias(name))
        rows = rows.withColumn("__at", at).join(counts, ["__at", "cand"]).drop("__at")
    rows = qnorm(rows.select("qid", "col", "cand", "now", "moved"), ["now", "moved"])
    return rows.select("qid", "col", "cand", ((F.col("now") + F.col("moved")) / 2.0).alias("bucket_count"))


def source_bucket_count(cands: DataFrame, days: int) -> DataFrame:
    rows = _from_first(cands).withColumn("__at", F.floor(F.col("__age") / (days * DAY)))
    counts = rows.groupBy("src", "__at", "cand").agg(F.count("*").alias("source_bucket_count"))
    return rows.join(counts, ["src", "__at", "cand"]).select("qid", "col", "cand", "source_bucket_count")


def rolling_count(cands: DataFrame, frames: dict[str, tuple[int, int]]) -> DataFrame:
    """Cells with the candidate on days [d - before, d + after], days from the first query on, from daily counts; as log1p, normalised in the query."""
    rows = _from_first(cands).withColumn("__day", F.floor(F.col("__age") / DAY))
    daily = rows.groupBy("cand", "__day").agg(F.count("*").alias("n"))
    rolled = daily.select("cand", "__day", *(F.log1p(F.sum("n").over(Window.partitionBy("cand").orderBy("__day").rangeBetween(-b, a))).alias(name) for name, (b, a) in frames.items()))
    return qnorm(rows.join(rolled, ["cand", "__day"]).select("qid", "col", "cand", *frames), list(frames))


def nearest_repeat(cands: DataFrame) -> DataFrame:
    """1 / (1 + log1p(gap)) to the nearest other row of the source with the item, 0 without; only repeated pairs are sorted."""
    cells = distinct_occurrences(cands)
    repeated = cells.groupBy("src", "cand").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = Window.partitionBy("src", "cand").orderBy("time", "qid")
    before, after = F.col("time") - F.lag("time").over(order), F.lead("time").over(order) - F.col("time")
    gaps = cells.join(repeated, ["src", "cand"], "left_semi").select("qid", "cand", F.least(before, after).alias("gap"))
    return cands.select("qid", "col", "cand").join(gaps, ["qid", "cand"], "left").select("qid", "col", "cand", F.coalesce(1.0 / (1.0 + F.log1p("gap")), F.lit(0.0)).alias("repeat"))


def exact_group_support(cands: DataFrame) -> DataFrame:
    """Other rows of the same source and time that hold the item, each counted once."""
    cells = distinct_occurrences(cands)
    n = cells.groupBy("src", "time", "cand").agg((F.count("*") - 1).alias("group_support"))
    return cands.select("qid", "col", "src", "time", "cand").join(n, ["src", "time", "cand"]).select("qid", "col", "cand", "group_support")


def source_support(cands: DataFrame, *keep: str) -> DataFrame:
    """Cells of the source with the item (the own one too), and per query the winner's column, maximum and gap to the second;
    with the columns to ``keep``, so that they need not be joined to the result."""
    counts = cands.groupBy("src", "cand").agg(F.count("*").alias("support"))
    rows = cands.join(counts, ["src", "cand"]).select("qid", "col", "cand", "support", *keep)
    best = Window.partitionBy("qid").orderBy(F.desc("support"), "col")
    rows = rows.withColumn("r", F.row_number().over(best))
    q = Window.partitionBy("qid")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c))).over(q)
    return rows.select("qid", "col", "cand", "support", at(1, "col").alias("winner"), at(1, "support").alias("top"), (at(1, "support") - F.coalesce(at(2, "support"), F.lit(0))).alias("lead"), *keep)


def loo_calibration(cands: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    """Leave-one-out Poisson lift: observed = count under the source - 1, expected = cells a row * (rows - 1) * p.

    Both are smoothed by a half: lift is the log of their ratio, deviance that of the smoothed values, signed by the
    side of the plain ones, and its band is that of the source's activity (rows up to the first cut, up to the
    second, more).
    """
    width = cands.groupBy("qid").agg((F.count("*") - 1).alias("width"))
    pool = cands.groupBy("cand").agg(F.count("*").alias("pool"))
    total = F.broadcast(cands.agg(F.count("*").alias("total")))
    per_src = cands.select("src", "qid").distinct().groupBy("src").agg(F.count("*").alias("n_rows"))
    seen = cands.groupBy("src", "cand").agg(F.count("*").alias("cnt"))
    rows = cands.select("qid", "src", "col", "cand").join(width, "qid").join(pool, "cand").crossJoin(total).join(per_src, "src").join(seen, ["src", "cand"])
    rows = rows.withColumn("obs", F.col("cnt") - 1.0).withColumn("exp", F.col("width") * (F.col("n_rows") - 1) * F.col("pool") / F.col("total"))
    lift = F.log((F.col("obs") + 0.5) / (F.col("exp") + 0.5))
    dev = 2 * ((F.col("obs") + 0.5) * lift - (F.col("obs") - F.col("exp")))
    band = F.when(F.col("n_rows") <= cuts[0], 0).when(F.col("n_rows") <= cuts[1], 1).otherwise(2)
    rows = rows.select("qid", "col", "cand", lift.alias("lift"), (F.signum(F.col("obs") - F.col("exp")) * F.sqrt(F.greatest(dev, F.lit(0.0)))).alias("deviance"), band.alias("band"))
    return rows.select("qid", "col", "cand", "lift", "deviance", *(F.when(F.col("band") == i, F.col("deviance")).otherwise(0.0).alias(f"band_{i}") for i in range(3)))


#: Sources and items of a tile, cells of a time that meet in one task, and the numbers of a bucket of similarities in their last digit.
_TILE, _ITEMS, _SHARE, _WIDE = 1024, 2048, 1 << 20, 1 << 15
_ONE = 1_000_000_000


class _Meeting:
    """The cells of one time in two of its blocks, folded to sources and items, and similarities by tiles of sources."""

    def __init__(self, g: pa.RecordBatch, tile: int):
        known, cells = (g.filter(pa.array(g.column("kind").to_numpy() == k)) for k in (0, 1))
        self.tile, self.apart = tile, g.column("ba")[0].as_py() != g.column("bb")[0].as_py()
        self.ids, rows = np.unique(known.column("src").to_numpy(), return_index=True)
        vecs = known.column("vec").take(pa.array(rows))
        self.lens = vecs.value_lengths().to_numpy(zero_copy_only=False)
        self.vecs = np.zeros((len(self.ids), int(self.lens.max(initial=1))))
        self.vecs[np.arange(self.vecs.shape[1]) < self.lens[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
        self.vecs /= np.sqrt((self.vecs * self.vecs).sum(1, keepdims=True))
        src = cells.column("src").to_numpy()
        at = np.minimum(np.searchsorted(self.ids, src), max(len(self.ids) - 1, 0))
        self.cells = cells.filter(pa.array(self.ids[at] == src if len(self.ids) else np.zeros(len(src), bool)))
        qid, cand, side = (self.cells.column(c).to_numpy() for c in ("qid", "cand", "side"))
        source = np.searchsorted(self.ids, self.cells.column("src").to_numpy())
        self.items, item = np.unique(cand, return_inverse=True)
        wide = max(len(self.items), 1)
        _, first = np.unique(np.unique(qid, return_inverse=True)[1] * wide + item, return_index=True)
        key = (side * len(self.ids) + source) * wide + item
        self.folded, self.n = np.unique(key[first], return_counts=True)
        self.entry = np.searchsorted(self.folded, key)
        self.row, self.item = np.divmod(self.folded, wide)
        self.hit = np.zeros(len(self.folded), bool)

    def _tiles(self, side: int) -> list[tuple[int, int, np.ndarray]]:
        """(first entry, end, sources) of each tile of the side."""
        begin, end = np.searchsorted(self.row, (side * len(self.ids), (side + 1) * len(self.ids))).tolist()
        sources = np.unique(self.row[begin:end])
        parts = [sources[i : i + self.tile] for i in range(0, len(sources), self.tile)]
        return [(*np.searchsorted(self.row, (s[0], s[-1] + 1)).tolist(), s) for s in parts]

    def pairs(self) -> Iterator[tuple]:
        """Each two tiles that meet, with their sources' similarities at nine digits and which of these count, a pair of sources once."""
        first = self._tiles(0)
        for i, x in enumerate(first):
            for y in self._tiles(1) if self.apart else first[i:]:
                a, b = x[2] % len(self.ids), y[2] % len(self.ids)
                cos = self.vecs[a] @ self.vecs[b].T
                cos *= _ONE
                keys = np.where(np.isnan(cos), 2.0 * _ONE, np.rint(cos, out=cos)).astype(np.int64)
                counts = a[:, None] < b if x is y else a[:, None] != b
                yield x, y, keys, counts & (self.lens[a][:, None] == self.lens[b])

    def dense(self, x: tuple, y: tuple) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """(entries, rows, columns, counts as a matrix) of both tiles, for a stretch of their common items at a time."""
        both = np.intersect1d(self.item[x[0] : x[1]], self.item[y[0] : y[1]])
        for k in range(0, len(both), _ITEMS):
            items = both[k : k + _ITEMS]
            out = []
            for begin, end, sources in (x, y):
                col = np.minimum(np.searchsorted(items, self.item[begin:end]), len(items) - 1)
                at = begin + np.flatnonzero(items[col] == self.item[begin:end])
                row, col = np.searchsorted(sources, self.row[at]), col[at - begin]
                m = np.zeros((len(sources), len(items)))
                m[row, col] = self.n[at]
                out.append((at, row, col, m))
            yield out

    def weighed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Similarities and how often rows of the two sources meet."""
        for x, y, keys, counts in self.pairs():
            n = sum((a[3] @ b[3].T for a, b in self.dense(x, y)), np.zeros(keys.shape))
            met = counts & (n > 0)
            yield keys[met] + _ONE, n[met]

    def marked(self, level: float) -> np.ndarray:
        """Which cells meet a source of at least the level; tiles that have all of theirs marked are left."""
        for x, y, keys, counts in self.pairs():
            if self.hit[x[0] : x[1]].all() and self.hit[y[0] : y[1]].all():
                continue
            good = (counts & (keys / _ONE >= level)).astype(np.float32)
            for a, b in self.dense(x, y):
                for own, other, near in ((a, b, good), (b, a, good.T)):
                    self.hit[own[0]] |= (near @ (other[3] > 0).astype(np.float32))[own[1], own[2]] > 0
        return self.hit[self.entry]


def _meetings(parts: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[pa.RecordBatch, _Meeting]]:
    for g in groups(parts, ["time", "ba", "bb"]):
        yield g, _Meeting(g, tile)


def _sums(tile: int, name: str):
    """(name, n): how many meetings have their similarity in a bucket, or, of the buckets from ``low`` to ``high``, each similarity; summed within the task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, base = np.zeros(0), 0
        for g, meeting in _meetings(parts, tile):
            if name == "bucket":
                most, of = 3 * _ONE // _WIDE + 1, lambda keys: keys // _WIDE
            else:
                low, high = (g.column(c)[0].as_py() for c in ("low", "high"))
                base, most, of = low * _WIDE, 2 * _WIDE, lambda keys: np.where(keys // _WIDE == low, keys - base, np.where(keys // _WIDE == high, keys - high * _WIDE + _WIDE, -1))  # noqa: B023
            sums = sums if len(sums) else np.zeros(most)
            for keys, n in meeting.weighed():
                at = of(keys)
                sums += np.bincount(at[at >= 0], n[at >= 0], most)
        at = np.flatnonzero(sums)
        value = at if name == "bucket" or not len(at) else np.where(at < _WIDE, base + at, high * _WIDE + at - _WIDE)
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(sums[at].astype(np.int64))], names=[name, "n"])

    return run


def _marks(tile: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, meeting in _meetings(parts, tile):
            level = g.column("level")[0].as_py()
            if level is not None:
                yield meeting.cells.select(["qid", "col", "cand"]).filter(pa.array(meeting.marked(level)))

    return run


def community_presence(cands: DataFrame, users: DataFrame, top: float = 0.1, block: int = _TILE, parts: int = 1, share: int = _SHARE) -> DataFrame:
    """Cells whose item another source has at the same time, for the most similar share of such pairs of sources.

    Pairs of rows with one time and item, different known sources; their user vectors' cosine must reach the
    value at the top share (linear quantile over pairs of rows). All cells of a time lie in one task, with a vector once a source, and
    sources meet there as matrices, ``block`` by ``block``; a time of more than ``share`` cells is dealt by query over blocks
    (``parts`` at least), of which each two meet in a task. No row is made for two sources: similarities leave a task as
    counts of a bounded number of buckets, then those of the one or two buckets with the wanted places at full digits. Returns
    the marked (qid, col), repeated items of a row included.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    u = users.where(norm > 0).select(F.col("id").alias("src"), "vec")
    whole = cands.where("src is not null and time is not null and cand is not null")
    times = whole.groupBy("time").agg(F.greatest(F.ceil(F.count("*") / share), F.lit(parts)).cast("int").alias("parts"))
    hot = written(times.where("parts > 1"), "times")
    several = hot.head() is not None
    dealt = whole.join(F.broadcast(hot), "time", "left") if several else whole.withColumn("parts", F.lit(1))
    own = F.pmod(F.hash("qid"), F.coalesce("parts", F.lit(1))).alias("own")
    dealt = dealt.select("time", own, F.coalesce("parts", F.lit(1)).alias("parts"), "src", "qid", "col", "cand")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ba, bb = F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb")
    unit = lambda df: df.select("*", other) if several else df.withColumn("other", F.lit(0))
    cells = unit(dealt).select("time", ba, bb, F.lit(1).alias("kind"), (F.col("own") > F.col("other")).cast("int").alias("side"), "src", "qid", "col", "cand", F.lit(None).cast(u.schema["vec"].dataType).alias("vec"))
    none = F.lit(0).cast("long")
    known = unit(dealt.select("time", "own", "parts", "src").distinct().join(u, "src"))
    known = known.select("time", ba, bb, F.lit(0).alias("kind"), F.lit(0).alias("side"), "src", none.alias("qid"), F.lit(0).alias("col"), none.alias("cand"), "vec")
    rows = known.union(cells).repartition("time", "ba", "bb")
    together = lambda df: df.sortWithinPartitions("time", "ba", "bb", "kind")

    similar = written(together(rows).mapInArrow(_sums(block, "bucket"), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "similar")
    up = lambda c: Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("all") - 1) * F.lit(1.0 - top)
    total = F.broadcast(similar.agg(F.sum("n").alias("all")))
    upto = similar.withColumn("upto", F.sum("n").over(up("bucket"))).crossJoin(total).where((F.col("upto") > F.floor(place)) & (F.col("upto") - F.col("n") <= F.floor(place) + 1))
    wanted = F.broadcast(upto.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.min(F.col("upto") - F.col("n")).alias("before"), F.max("all").alias("all")).where("low is not null"))
    exact = together(rows.crossJoin(wanted.select("low", "high"))).mapInArrow(_sums(block, "key"), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    exact = exact.withColumn("upto", F.sum("n").over(up("key"))).crossJoin(wanted).withColumn("upto", F.col("before") + F.col("upto"))
    value = lambda p: F.min(F.when(F.col("upto") > p, (F.col("key") - _ONE) / _ONE))
    level = exact.agg(value(F.floor(place)).alias("a"), value(F.least(F.floor(place) + 1, F.col("all") - 1)).alias("b"), F.max(place - F.floor(place)).alias("part"))
    level = F.broadcast(level.select((F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("level")))
    marked = together(rows.crossJoin(level)).mapInArrow(_marks(block), "qid long, col int, cand long")
    return marked.distinct() if several else marked


def support_features(cands: DataFrame, same_source: bool = True) -> DataFrame:
    """Ring supports as log1p, normalised in the query."""
    rows = cands.select("qid", "col", "cand").join(ring_support(cands, same_source), ["qid", "cand"])
    names = [f"ring_{i}" for i in range(len(RINGS) - 1)]
    return qnorm(rows.select("qid", "col", "cand", *(F.log1p(n).alias(n) for n in names)), names)
