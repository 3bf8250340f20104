"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

toxicity rejects documents, near_dedup keeps one document of each class, secrets masks credentials in use,
mixing repeats or leaves out documents towards the sources' target weights, and bpe encodes what is left.
Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgetide.llm import bpe
from edgetide.llm.mixing import mix
from edgetide.llm.near_dup import near_duplicates
from edgetide.llm.secrets import redact, scan_secrets
from edgetide.llm.store import written
from edgetide.llm.toxicity import fit_toxicity, without_toxic


_WORDS = "[^\\x20\\x09-\\x0D]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a chance of being toxic under one half, by a model fitted on the labelled documents.

    Each row goes by its own text, whatever its doc_id; null and empty texts stay; an empty table stays empty.
    """
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: five-word shingles, similarity of 0.8 or more.

    That row has the class's least doc_id, then the least hash of its text; of wholly repeated rows, and rows that
    differ in other columns only, one stays. Rows without words or without a doc_id are in no class and stay.
    """
    found = near_duplicates(docs)
    row = ("doc_id", "mark")
    rest = docs.withColumn("__mark", F.xxhash64("text"))
    plain = F.coalesce(F.col("text"), F.lit("")).rlike(_WORDS) & F.col("doc_id").isNotNull()
    one = found.where("kept and class is not null").groupBy("class").agg(F.min(F.struct(*row)).alias("r")).select("r.*").distinct()
    one = one.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of"))
    mine = rest.where(plain).join(one, (F.col("doc_id") == F.col("__id")) & (F.col("__mark") == F.col("__of")), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy(*others, "__mark"))
    mine = mine.withColumn("__place", place).where("__place = 1")
    return mine.select(*docs.columns).unionByName(rest.where(~plain).select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the credentials masked that few sources hold; null and empty texts and repeated rows stay as they are."""
    return redact(docs, scan_secrets(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: taken / size, a fraction rounded by a hash of doc_id.

    Rows with one doc_id, source and text share one number of copies; rows without words, null texts among them, are
    kept once. The rows' expected words are the mix's.
    """
    key = ["doc_id", "source", "mark"]
    docs_ = docs.withColumn("mark", F.xxhash64("text"))
    taken = mix(docs_, keep=("doc_id", "mark")).groupBy(*key).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    part = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + part)).otherwise(1).cast("int")
    copied = taken.select(F.struct(*key, copies.alias("copies")).alias("m"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & F.xxhash64("d.text").eqNullSafe(F.col("m.mark"))
    joined = rows.join(copied, same).where("m.copies > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("m.copies"))))
    return joined.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, n_tokens, ids_sha256 and whether decoding gives the text (null: empty) back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs, path, keep=("doc_id", "source", "text"))
    decoded = bpe.decode(encoded, path, text="decoded", keep=("doc_id", "source", "text", "ids"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", encoding)]

#: Neither the toxicity model nor the vocabulary can be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
