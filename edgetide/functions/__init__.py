"""Column expressions that the operators share; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
def Q():  # noqa: N802
    """The window of one query's cells."""
    return Window.partitionBy("qid")


_LANE = 1 << 31


def draw(a: Column, b: Column | int, seed: int) -> Column:
    """A 31-bit arithmetic hash of two integers of 64 bits, equal in any engine with 64-bit integers.

    Both halves of ``a`` and the low one of ``b`` are reduced before each product, so nothing leaves a long.
    """
    b = b if isinstance(b, Column) else F.lit(b)
    low, high = F.pmod(a, F.lit(_LANE)), F.pmod(F.shiftright(a.cast("long"), 31), F.lit(_LANE))
    first = (low * F.lit(1103515245) + high * F.lit(69069) + F.pmod(b, F.lit(_LANE)) * F.lit(12345) + F.lit(seed * 2654435)) % F.lit(_LANE)
    return (first * F.lit(48271)) % F.lit(_LANE - 1)


def drawn_place(a: Column, b: Column | int, seed: int, n: Column) -> Column:
    """A hashed place in 0..n-1: ``draw % n``, widened by a second draw where n is more than one draw can reach."""
    wide = draw(a, b, seed + 7777) % F.ceil(n / F.lit(float(_LANE - 1)))
    return (draw(a, b, seed) + wide * F.lit(_LANE - 1)) % n


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def at_digits(x: str | Column, digits: int) -> Column:
    """Rounded half away from zero in binary, as SQL engines on doubles do; ``round`` goes by the decimal text, which parts from
    it where the last digit kept is in a tie."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def recency(delta: Column) -> Column:
    """1 / (1 + log1p(days)) of a gap in seconds, negative gaps as 0."""
    return 1.0 / (1.0 + F.log1p(F.greatest(delta, F.lit(0)) / F.lit(float(DAY))))


def hour_of_day(time: str = "time") -> Column:
    return F.floor((F.col(time) % DAY) / 3600)


def day_of_week(time: str = "time") -> Column:
    """0 is Thursday, the first day of the epoch."""
    return F.floor(F.col(time) / DAY) % 7


def running(rows: DataFrame, value: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """``name``: total of ``value`` over all rows before this one in the order, which must refine the bucket's.

    Two levels, buckets and rows within a bucket, so that no task sees all rows; only one row a bucket
    meets in one place.
    """
    rows = rows.withColumn("__bucket", bucket)
    totals = rows.groupBy("__bucket").agg(F.sum(value).alias("__sum"))
    up = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__bucket", F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals, "__bucket").withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.drop("__bucket", "__base")


def range_counts(points: DataFrame, keys: list[str], frames: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, time, <frame names>) of probes: the weight of the key's points at times in [time + a, time + b].

    ``points(keys, time, n, probe)`` are folded to one row a second of a key, so that a hot key costs seconds, not rows. Time
    is cut into buckets as long as the frames reach, and a row is copied into the one neighbour that can see it; a task then
    holds one (key, bucket), at most two reaches of seconds. A count is the difference of two running totals, up to time + b and
    up to time + a - 1: a frame with no lower end only grows, while one with both ends is summed anew for each row.
    """
    low, high = min(0, *(a for a, _ in frames.values())), max(0, *(b for _, b in frames.values()))
    width = max(high - low, 3600)
    at = lambda shift: F.floor((F.col("time") + F.lit(shift)) / width)
    folded = points.groupBy(*keys, "time").agg(F.sum("n").alias("n"), F.max("probe").alias("probe"))
    seen = folded.withColumn("__bucket", F.explode(F.sequence(at(-high), at(-low))))
    order = Window.partitionBy(*keys, "__bucket").orderBy("time")
    upto = {end: f"__upto_{i}" for i, end in enumerate(sorted({e for a, b in frames.values() for e in (a - 1, b)}))}
    totals = (F.coalesce(F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, end)), F.lit(0)).alias(c) for end, c in upto.items())
    rows = seen.select(*keys, "time", "probe", (F.col("__bucket") == at(0)).alias("__own"), *totals).where("__own and probe = 1")
    return rows.select(*keys, "time", *((F.col(upto[b]) - F.col(upto[a - 1])).alias(name) for name, (a, b) in frames.items()))


def in_ranges(rows: DataFrame, col: str, name: str, side: int = 16) -> DataFrame:
    """The rows with ``name``: the number, below side^2, of the range of values that ``col`` falls in.

    The ends are approximate percentiles of the rows themselves, one row of a bounded array, so ranges hold about equally many
    rows however the values are spread; values are placed by two rounds of ``side`` comparisons.
    """
    parts = side * side
    cuts = rows.agg(F.percentile_approx(col, [k / parts for k in range(1, parts)], 40 * parts).alias("__cuts"))
    tops = F.array(*(F.col("__cuts")[side * j - 1] for j in range(1, side)))
    lows = F.array(*(F.slice("__cuts", side * j + 1, side - 1) for j in range(side)))
    cuts = cuts.select(tops.alias("__tops"), lows.alias("__lows"))
    upto = lambda ends: F.coalesce(F.size(F.filter(ends, lambda x: x <= F.col(col))), F.lit(0))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("__top", upto("__tops"))
    return placed.withColumn(name, (F.col("__top") * side + upto(F.col("__lows")[F.col("__top")])).cast("long")).drop("__tops", "__lows", "__top")


def dense_index(ids: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Distinct integer ids, of any spread over 64 bits, with their place from 0 in ascending order."""
    one = ids.select(col).where(F.col(col).isNotNull()).distinct().withColumn("__one", F.lit(1))
    return running(in_ranges(one, col, "__range"), "__one", [col], F.col("__range"), name).select(col, F.col(name).cast("long").alias(name))


def quantiles(rows: DataFrame, col: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row of exact linear quantiles ``{name: share}``; ``weight``: how often a row counts. Null values take no part.

    Equal-width buckets between two approximate percentiles are counted first; only the values of buckets that hold a wanted
    place are put in order, so no task sees all values.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    values = rows.select(F.col(col).cast("double").alias("v"), one.alias("w")).where("v is not null")
    ends = F.broadcast(values.agg(F.percentile_approx("v", [0.001, 0.999], 1000).alias("e"), F.sum("w").alias("n")))
    step = F.coalesce((F.col("v") - F.col("e")[0]) / F.nullif(F.col("e")[1] - F.col("e")[0], F.lit(0.0)), F.lit(0.0))
    placed = values.crossJoin(ends).select("v", "w", F.floor(F.greatest(F.least(step, F.lit(1.0)), F.lit(0.0)) * 4096).alias("b"))
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("b").agg(F.sum("w").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(up), F.lit(0)))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = [F.struct(F.lit(name).alias("name"), F.floor(place(q)).alias("at"), F.lit(k).alias("k")) for name, q in shares.items() for k in (0, 1)]
    targets = ends.select(F.explode(F.array(*wanted)).alias("t"), "n").select("t.name", "t.k", F.least(F.col("t.at") + F.col("t.k"), F.col("n") - 1).alias("at"))
    picks = F.broadcast(buckets.crossJoin(F.broadcast(targets)).where("before <= at and at < before + s").select("name", "k", "at", "b", "before"))
    near = placed.join(picks.select("b").distinct(), "b", "left_semi").groupBy("b", "v").agg(F.sum("w").alias("w"))
    near = near.withColumn("upto", F.sum("w").over(Window.partitionBy("b").orderBy("v")))
    found = near.join(picks, "b").where("before + upto - w <= at and at < before + upto")
    value = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("k") == k), F.col("v")))
    pairs = found.agg(*(value(name, k).alias(f"{name}_{k}") for name in shares for k in (0, 1))).crossJoin(ends.select("n"))
    return pairs.select(*((F.col(f"{name}_0") + (place(q) - F.floor(place(q))) * (F.col(f"{name}_1") - F.col(f"{name}_0"))).alias(name) for name, q in shares.items()))
