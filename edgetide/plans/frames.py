"""The driver's tables as interaction logs: edges, history, targets, candidate cells and scored cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import at_digits
from ..functions.tables import folder
from ..operators import components as wide
from ..operators import features, history, replay

#: 2024-01-21 UTC, about two thirds of the log.
CUTOFF = 1_705_795_200
#: End of the log's month, the origin of decays.
ORIGIN = 1_706_659_200
WIDTH = 20
SEED = 1


_KEPT: dict[tuple[str, str, str], str] = {}


def _kept(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The frame as a table, written once an application and folder of tables, so that plans that branch off it read it
    instead of computing it for each branch; written again where the table is gone."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key in _KEPT:
            try:
                return spark.read.parquet(_KEPT[key])
            except AnalysisException:
                del _KEPT[key]
        path = folder(spark, build.__name__)
        build(spark, sf_dir).write.parquet(path)
        _KEPT[key] = path
        return spark.read.parquet(path)

    return read


def _epoch(col: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, time, seq) from ``events``: user, item k of props, epoch second, event_id."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), _epoch("ts").alias("time"), F.col("event_id").alias("seq"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, time, seq) from ``lineitem`` and ``orders``, with many equal times."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), _epoch("o_orderdate").alias("time"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(edges(spark, sf_dir), CUTOFF)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the cutoff on: qid, src, time, dst."""
    return edges(spark, sf_dir).where(F.col("time") >= CUTOFF).withColumnRenamed("seq", "qid")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, src, time, col, cand, is_pos): the positive and negatives uniform over the history's items."""
    return replay.replay_history(targets(spark, sf_dir), hist(spark, sf_dir), WIDTH, SEED)


cands = _kept(replayed)


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.causal_features(cands(spark, sf_dir), hist(spark, sf_dir), CUTOFF)


causal = _kept(features_of)


def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with seen, the simple heuristic ``score`` and the components a, b, c, all rounded to 9 digits."""
    c = lambda x: at_digits(x, 9)
    return causal(spark, sf_dir).select("qid", "src", "time", "col", "cand", "is_pos", F.col("pair_seen").alias("seen"), c(features.base_score()).alias("score"), c("dst_log_count").alias("a"), c("pair_share_src").alias("b"), c("dst_recency").alias("c"))


scored = _kept(scored_cells)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, vec, bias): ids serve as sources and as items."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0.0).cast("float").alias("bias"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector, numbered anew: items without one are the rule."""
    return vectors(spark, sf_dir).where("id % 7 = 0").withColumn("id", (F.col("id") / 7).cast("long"))


def component_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with pair_seen and the 23 components, rounded to nine digits."""
    rows = wide.component_table(causal(spark, sf_dir), edges(spark, sf_dir), hist(spark, sf_dir), vectors(spark, sf_dir), item_vectors(spark, sf_dir))
    return rows.withColumns({n: at_digits(n, 9) for n in wide.component_names()})


components = _kept(component_cells)
