"""Reading edges and queries under a fixed contract, stores of statistics and scores, and the matrix sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField(c, T.LongType(), True) for c in ("src", "dst", "time", "split")])
UINT32 = (1 << 32) - 1


def query_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType(), True) for c in ("src", "time", *(f"c{i}" for i in range(1, width + 1)))])


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """FAILFAST and a checked header: another header, a non-integer or a missing column is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def _checked(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values must be unsigned 32-bit; the check runs where the value is read."""
    wrong = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > UINT32)
    return df.withColumns({c: F.when(wrong(c), F.raise_error(F.lit(f"{c} is not an unsigned 32-bit integer")).cast("long")).otherwise(F.col(c)) for c in cols})


def _in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a file source with ``name``: growing in the order of file path, then place in the file.

    A split's rows keep their order in the task that reads it; the splits, one row each, are numbered by path and
    first byte, and a row's number is its split's and its place in the task.
    """
    inside = (1 << 33) - 1
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().bitwiseAND(F.lit(inside)).alias("__row"))
    splits = placed.select("__file", "__block").distinct()
    splits = splits.withColumn("__split", (F.row_number().over(Window.orderBy("__file", "__block")) - 1).cast("long"))
    return placed.join(F.broadcast(splits), ["__file", "__block"]).withColumn(name, F.col("__split") * F.lit(inside + 1) + F.col("__row")).drop("__file", "__block", "__split", "__row")


def read_edges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``edges(src, dst, time, split, seq)``; seq keeps the file order of equal times.

    CSV files get it from path and place in the file; Parquet must carry a seq column.
    """
    if fmt == "parquet":
        return _checked(spark.read.parquet(path), EDGES.names)
    return _checked(_in_file_order(_csv(spark, path, EDGES), "seq"), EDGES.names)


def read_queries(spark: SparkSession, path: str, width: int = 100) -> DataFrame:
    """``queries(qid, src, time, cands)``, qid in file order."""
    schema = query_schema(width)
    rows = _checked(_in_file_order(_csv(spark, path, schema), "qid"), schema.names)
    return rows.select("qid", "src", "time", F.array(*(f"c{i}" for i in range(1, width + 1))).alias("cands"))


def explode_candidates(queries: DataFrame) -> DataFrame:
    """Wide rows to cells (qid, src, time, col, cand)."""
    return queries.select("qid", "src", "time", F.posexplode("cands").alias("col", "cand"))


def edge_contract(edges: DataFrame) -> DataFrame:
    """One row: counts and time ranges by split, whether split 0 ends before split 1 starts, whether time never falls in seq order.

    Order is checked by minima and maxima of runs of 65536 seq values and by lag inside a run, so nothing is sorted in one place.
    """
    run = F.floor(F.col("seq") / 65_536)
    prev = F.lag("time").over(Window.partitionBy(run).orderBy("seq"))
    falls = edges.select(run.alias("run"), "time", (F.col("time") < prev).alias("falls"))
    runs = falls.groupBy("run").agg(F.count_if("falls").alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    mono = runs.withColumn("before", F.max("hi").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if(F.col("lo") < F.col("before")) == 0).alias("monotone"))
    part = lambda s, f, c: f(F.when(F.col("split") == s, F.col(c)))
    one = edges.agg(*(x for s in (0, 1) for x in (F.count_if(F.col("split") == s).alias(f"n_{s}"), part(s, F.min, "time").alias(f"min_{s}"), part(s, F.max, "time").alias(f"max_{s}"))), F.count_if(~F.col("split").isin(0, 1)).alias("n_other"))
    ok = (F.col("n_other") == 0) & (F.col("n_0") > 0) & (F.col("n_1") > 0) & (F.col("max_0") < F.col("min_1"))
    return one.crossJoin(F.broadcast(mono)).withColumn("ok", F.coalesce(ok, F.lit(False)) & F.col("monotone"))


def save_store(stats: DataFrame, path: str, cutoff: int) -> None:
    """Statistics frozen at a cutoff, in a directory of their own."""
    stats.write.mode("overwrite").parquet(f"{path.rstrip('/')}/cutoff={cutoff}")


def load_store(spark: SparkSession, path: str, cutoff: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/cutoff={cutoff}")


def save_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("strategy", "split").parquet(path)


def load_scores(spark: SparkSession, path: str, strategy: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("strategy") == strategy) & (F.col("split") == split)).drop("strategy", "split")


def save_bucketed(stats: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, by: list[str] | None = None) -> None:
    """A table laid out by ``keys``: rows are shuffled once, here, and every later join, window or aggregate by the keys reads
    them in place.

    One task writes a bucket, so there is one file a bucket (and value of the partition columns ``by``). ``buckets`` should
    be at least the shuffle partitions of the sessions that read, or Spark may prefer to shuffle again, and enough for
    a bucket to fit a task. Rows of one key stay together: lay out by keys that no one value dominates. An empty
    frame gives an empty table. A table of the name is replaced.
    """
    writer = stats.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if by:
        writer = writer.partitionBy(*by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def wide_scores(spark: SparkSession, table: str, strategies: list[str], split: str) -> DataFrame:
    """(qid, col, <strategies>) of a long bucketed score table, null where a strategy lacks the cell.

    All strategies of a bucket are read by one task, and a cell's are met by an aggregate in place; per-query
    windows over the result need no shuffle either.
    """
    rows = spark.table(table).where((F.col("split") == split) & F.col("strategy").isin(strategies))
    return rows.groupBy("qid", "col").agg(*(F.max(F.when(F.col("strategy") == s, F.col("score"))).alias(s) for s in strategies))


def matrix_lines(scores: DataFrame, col: str = "score") -> DataFrame:
    """(qid, line): the query's scores in column order as %.8f, comma-joined."""
    cells = F.array_sort(F.collect_list(F.struct("col", F.format_string("%.8f", F.col(col)).alias("v"))))
    return scores.groupBy("qid").agg(F.array_join(F.transform(cells, lambda x: x["v"]), ",").alias("line"))


def write_matrix(scores: DataFrame, path: str, col: str = "score") -> None:
    """Headerless lines in qid order: range-partitioned files whose names keep the order."""
    matrix_lines(scores, col).orderBy("qid").select("line").write.mode("overwrite").text(path)


def validate_lines(lines: DataFrame, width: int, scale: str = "prob", tol: float = 1e-5) -> DataFrame:
    """(qid, problem) of ``lines(qid, line)`` that break the format: width, value text, range, and for ``prob`` the sum."""
    cells = F.split("line", ",")
    text = F.forall(cells, lambda x: x.rlike(r"^-?\d+\.\d{8}$"))
    values = F.transform(cells, lambda x: F.try_to_number(x, F.lit("S999999990.99999999")).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(float("nan"))))
    outside = F.exists(values, lambda x: (x < 0) | (x > 1))
    bad = F.when(F.size(cells) != width, "width").when(~text, "format")
    if scale == "prob":
        bad = bad.when(outside, "range").when(F.abs(total - 1) > tol, "sum")
    return lines.withColumn("problem", bad).where("problem is not null").select("qid", "problem")


def validate_matrix(lines: DataFrame, queries: DataFrame, width: int, scale: str = "prob", tol: float = 1e-5) -> DataFrame:
    """Format violations, and queries without a line."""
    missing = queries.select("qid").join(lines.select("qid"), "qid", "left_anti").withColumn("problem", F.lit("missing"))
    return validate_lines(lines, width, scale, tol).union(missing)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, digest): row count, and the order-free exclusive or of the rows' 64-bit hashes."""
    cols: list[str | Column] = sorted(df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("digest"))


def diff_rows(a: DataFrame, b: DataFrame, col: str = "score", tol: float = 0.0) -> DataFrame:
    """Cells of two score tables that differ or stand in one only: (qid, col, before, after)."""
    rows = a.select("qid", "col", F.col(col).alias("before")).join(b.select("qid", "col", F.col(col).alias("after")), ["qid", "col"], "full_outer")
    return rows.where(F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("before") - F.col("after")) > tol))
