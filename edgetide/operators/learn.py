"""Learned scorers on distributed MLlib, and a listwise linear ranker trained by DataFrame aggregates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Q
from .attention import attended
from .stats import bm25_confidence, pair_stats, user_item_weights


def _factors(rows: DataFrame, user: str, item: str, value: str, rank: int, seed: int, iterations: int) -> tuple[DataFrame, DataFrame]:
    """Implicit ALS factors as (id, vec, bias); ids must fit 32 bits, as ALS asks."""
    data = rows.select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), F.col(value).cast("float").alias("r"))
    model = ALS(userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, rank=rank, seed=seed, maxIter=iterations).fit(data)
    as_vec = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("features").alias("vec"), F.lit(0.0).cast("float").alias("bias"))
    return as_vec(model.userFactors), as_vec(model.itemFactors)


def fit_mf(hist: DataFrame, rank: int = 16, seed: int = 7, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    return _factors(pair_stats(hist), "src", "dst", "pair_cnt", rank, seed, iterations)


def fit_bm25_mf(hist: DataFrame, origin: int, scale: float, rank: int = 32, seed: int = 7, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    return _factors(bm25_confidence(user_item_weights(hist, origin, scale)), "src", "dst", "confidence", rank, seed, iterations)


def fit_profile_mf(hist: DataFrame, origin: int, scale: float, rank: int = 16, seed: int = 7, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    return _factors(user_item_weights(hist, origin, scale), "src", "dst", "w", rank, seed, iterations)


def fit_transition_mf(transitions: DataFrame, rank: int = 16, seed: int = 7, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    return _factors(transitions, "prev", "next", "cnt", rank, seed, iterations)


def row_context(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row mean and maximum of each feature, and the score's distance from the row's best."""
    return df.select("*", *(F.avg(c).over(Q()).alias(f"{c}_mean") for c in cols), *(F.max(c).over(Q()).alias(f"{c}_max") for c in cols), *((F.col(c) - F.max(c).over(Q())).alias(f"{c}_top") for c in cols))


def row_weights(queries: DataFrame, src_cnt: DataFrame, known_items: DataFrame, hot: DataFrame, weight: float = 2.0) -> DataFrame:
    """(qid, w): 0 where the positive is no known item, ``weight`` for hot sources, else 1."""
    rows = queries.select("qid", "src", F.col("dst")).join(src_cnt.select("src", "src_cnt"), "src", "left").join(known_items.select("dst").distinct().withColumn("__k", F.lit(1)), "dst", "left").crossJoin(F.broadcast(hot))
    return rows.select("qid", F.when(F.col("__k").isNull(), 0.0).when(F.col("src_cnt") >= F.col("hot"), weight).otherwise(1.0).alias("w"))


def fit_ranker(df: DataFrame, features: list[str], kind: str = "logistic", seed: int = 7):
    """A pointwise classifier of ``is_pos``, positives weighted up to the negatives' number."""
    n = df.agg(F.count("*"), F.count_if("is_pos")).first()
    up = (n[0] - n[1]) / max(n[1], 1)
    data = df.withColumn("label", F.col("is_pos").cast("double")).withColumn("w", F.when(F.col("is_pos"), up).otherwise(1.0))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(data)
    make = {"logistic": LogisticRegression(weightCol="w", regParam=0.01, maxIter=30), "gbt": GBTClassifier(weightCol="w", maxIter=10, maxDepth=3, seed=seed)}[kind]
    return make.fit(rows)


def score_ranker(model, df: DataFrame, features: list[str]) -> DataFrame:
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _linear(features: list[str], weights: list[float]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in zip(features, weights, strict=True)), F.lit(0.0))


def fit_listwise(df: DataFrame, features: list[str], steps: int = 15, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Group-softmax linear ranker: each step's gradient is one aggregate of sum(p x) - x_pos, so only one row moves."""
    rows = df.select("qid", "is_pos", *features).persist()
    n = rows.select("qid").distinct().count() or 1
    weights = [0.0] * len(features)
    for _ in range(steps):
        scored = rows.withColumn("__s", _linear(features, weights))
        soft = scored.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(Q()))).withColumn("__p", F.col("__e") / F.sum("__e").over(Q()))
        g = soft.agg(*(F.sum((F.col("__p") - F.col("is_pos").cast("double")) * F.col(c)).alias(c) for c in features)).first()
        weights = [w - rate * ((g[c] or 0.0) / n + ridge * w) for c, w in zip(features, weights, strict=True)]
    rows.unpersist()
    return weights


def score_listwise(df: DataFrame, features: list[str], weights: list[float]) -> DataFrame:
    return df.withColumn("score", _linear(features, weights))


def attention_score(cands: DataFrame, edges: DataFrame, items: DataFrame, k: int = 8, tau: float = 0.1) -> DataFrame:
    """Candidate-conditioned attention over the as-of history: softmax_j(<q, h_j> / sqrt(d) - tau gap_j), value <q, h_j>."""
    got = attended(cands, edges, items, (k,), tau).withColumnRenamed(f"attention_{k}", "score")
    return cands.select("qid", "col", "cand").join(got, ["qid", "col"])


def fit_node_classifier(nodes: DataFrame, reg: float = 0.001):
    """Multinomial regression on ``nodes(id, vec, label, mask)``, rows of mask train."""
    rows = nodes.where("mask = 'train'").select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(regParam=reg, maxIter=50, family="multinomial").fit(rows)


def classify_nodes(model, nodes: DataFrame) -> DataFrame:
    rows = nodes.withColumn("features", array_to_vector("vec"))
    return model.transform(rows).select("id", "label", "mask", F.col("prediction").cast("int").alias("prediction"))
