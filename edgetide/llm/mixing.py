"""Operator 4 [native]: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Fixed value: round(2**31 / golden ratio), made odd; its multiples modulo 2**31 are the schedule's points.
_GOLDEN = 1327217885
_SPAN = 1 << 31
_CELLS = 1024


def _sources(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row a source: sid (code-point order, null last), weight, source_size, target.

    Targets are min(cap * size, level * weight) for the one level at which they add up: what resharing
    the excess by weight ends in. A row a source meets in one place here, never a row a document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.select("source", "source_size", (F.row_number().over(order) - 1).alias("sid"), F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).alias("weight"))
    steps = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    capped = F.coalesce(F.sum("limit").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(steps.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("limit", F.col("source_size") * cap).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("level", (F.lit(share) * F.col("all") - capped) / open_)
    level = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("limit_at", "level"))).over(Window.partitionBy())["level"]
    per = per.withColumn("limit_at", F.row_number().over(steps)).withColumn("chosen", level)
    return per.select("source", "sid", "weight", "source_size", F.coalesce(F.least(F.col("limit").cast("double"), F.col("chosen") * F.col("weight")), F.lit(0.0)).alias("target"))


def _before(rows: DataFrame, key: str, value: str, order: list) -> tuple[DataFrame, Column]:
    """Running total of ``value`` before each row of its source in the order (bucket, *order).

    Two levels: within (source, bucket), and over the buckets' totals; no task sees a whole source.
    """
    totals = rows.groupBy("sid", key).agg(F.sum(value).alias("__sum"))
    up = Window.partitionBy("sid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", key, F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__base"))
    within = Window.partitionBy("sid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals, ["sid", key]), F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block: int = 256, slots: int = 1 << 18, seed: str = "mix", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, size, source, source_size, target, taken, first_slot, n_slots for every row of ``docs``.

    Each source's documents, in the order of md5(seed, doc_id), form one stream of words, cut into blocks of
    equal length: ``block`` words, or fewer where the whole mix would have under ``slots`` blocks. Slot i of the
    schedule is the point i * golden ratio modulo 1; the sources' target shares divide the unit interval, so the
    point alone names the source, and the slot's rank among the source's slots names the block, going round the
    stream again after its end, ``cap`` times at most. Being of low discrepancy, the points give each source its
    target to within a few blocks. ``first_slot`` is the first slot that takes words of the row, null without
    any, and ``n_slots`` the number of those slots.

    A null or empty text has size 0 and is taken 0 times; null doc_ids and repeated rows are rows like
    others; null is a source of its own. Other columns are not read, so clashing names do no harm. An empty
    table gives an empty result. Only DataFrame functions are used; runs agree with each other.
    """
    spark = docs.sparkSession
    keep = tuple(keep)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = written(docs.select(*(F.col(k).alias(f"__{k}") for k in keep), "source", size.alias("size"), digest.alias("digest")), "sizes")
    sources = _sources(sized, weights, share, cap).withColumn("take", F.round("target").cast("long"))
    sources = written(sources, "sources")
    rows = sized.join(sources.withColumnRenamed("source", "__source"), sized["source"].eqNullSafe(F.col("__source"))).drop("__source", "take", "weight").withColumn("bucket", F.substring("digest", 1, 3))
    rows, start = _before(rows, "bucket", "size", ["digest", *(f"__{k}" for k in keep), "size"])
    rows = written(rows.withColumn("start", start).drop("digest", "bucket", "__base"), "placed")

    total = sources.agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]
    block = max(1, min(block, total // slots))
    edge = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    low = F.floor(F.coalesce(F.sum("take").over(edge), F.lit(0)).cast("double") / float(max(total, 1)) * float(_SPAN))
    wanted = sources.select("sid", F.ceil(F.col("source_size") / block).alias("blocks"), low.alias("low"))
    wanted = wanted.withColumn("high", F.lead("low", 1, _SPAN).over(Window.orderBy("sid"))).where("low < high")

    cell = _SPAN // _CELLS
    lanes = wanted.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    points = spark.range(-(-total // block)).select(F.col("id").alias("slot"), (F.pmod("id", F.lit(_SPAN)) * _GOLDEN % _SPAN).alias("point"))
    named = points.withColumn("cell", F.floor(F.col("point") / cell)).join(lanes, "cell").where("point >= low and point < high")
    named = named.select("sid", "blocks", "slot", F.floor(F.col("slot") / 4096).alias("chunk"), F.lit(1).alias("one"))
    named, rank = _before(named, "chunk", "one", ["slot"])
    schedule = named.withColumn("rank", rank).where(F.col("rank") < cap * F.col("blocks"))
    schedule = schedule.groupBy("sid", F.pmod("rank", "blocks").alias("number")).agg(F.count("*").alias("times"), F.min("slot").alias("slot"))

    parts = rows.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("number"))
    a = F.greatest(F.col("start") - F.col("number") * block, F.lit(0))
    b = F.least(F.col("start") + F.col("size") - F.col("number") * block, F.lit(block))
    got = parts.join(schedule, ["sid", "number"]).groupBy("sid", "start").agg(F.sum((b - a) * F.col("times")).alias("got"), F.min("slot").alias("first_slot"), F.sum("times").alias("n_slots"))
    some = F.col("size") > 0
    return rows.join(got, ["sid", "start"], "left").select(
        *(F.col(f"__{k}").alias(k) for k in keep), "size", "source", "source_size", "target", F.when(some, F.coalesce("got", F.lit(0))).otherwise(0).cast("long").alias("taken"),
        F.when(some, F.col("first_slot")).alias("first_slot"), F.when(some, F.coalesce("n_slots", F.lit(0))).otherwise(0).cast("long").alias("n_slots"),
    )
