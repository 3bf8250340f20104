"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, token_files
from .ann import nearest
from .conversations import conversation_digests, plan_repairs, repair_report, repaired_rows
from .licenses import scan_licenses
from .lm import score_documents
from .mixing import mix
from .near_dup import near_duplicates
from .secrets import KINDS, scan_secrets
from .simhash import simhash_duplicates
from .topk import top_inner_products
from .toxicity import fit_toxicity, score_toxicity
from .whitening import whiten_embeddings


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 100 * intersection >= 85 * union."""
    return near_duplicates(_documents(spark, sf_dir), shingle=3, num=85, den=100).drop("mark", "class")


def op2_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back with the 50k byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(_documents(spark, sf_dir), path)
    decoded = bpe.decode(encoded, path, keep=("doc_id", "ids"))
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_token_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard files with the 49k word vocabulary, written, then read back."""
    path = token_files.token_path(spark, "tokens")
    token_files.write_token_files(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in the sources' order, 150 % of all words, at most twice a source's size."""
    return mix(_documents(spark, sf_dir)).drop("source")


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product for every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model fitted on the labelled ones."""
    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_lm_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document; fold 2 of 7 is held out."""
    return score_documents(_documents(spark, sf_dir))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, their digest, and with them the values that few owners have."""
    scanned = scan_secrets(_documents(spark, sf_dir))
    base = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    own = F.transform("live", lambda s: F.struct(s["start"], F.lit(3).alias("kind"), s["end"]))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.array_sort(F.concat(base, own))).alias("spans"), F.size("live").cast("long").alias("n_live"),
    )


def op9_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products for every hundredth vector."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template matches of every document."""
    found = scan_licenses(_documents(spark, sf_dir))
    place = lambda f: F.when(F.size("places") > 0, f("places"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"), "base_labels", "labels", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls as one space; a dropped row stays as
    ``gone`` so that its conversation does."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("hit"))
    rows = rows.select("conv_id", "turn", "role", "text", "hit", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = plan_repairs(rows)
    digests = conversation_digests(repaired_rows(rows, plans)).withColumnRenamed("sha256", "repaired_sha256")
    found = repair_report(plans).join(digests, ["has_id", "id"], "left").drop("has_id", "id")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op12_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most two differing bits."""
    found = simhash_duplicates(_documents(spark, sf_dir), shingle=3, apart=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every vector."""
    rows, m = whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=64, shift=1_000_000, most=16)
    shares = [float(e) / m.trace for e in m.values] if m else []
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place") + 1)
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(m.n if m else 0).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(m.identity_error if m else None).cast("double").alias("identity_error"),
    )


def queries() -> dict:
    found = (
        op1_minhash_near_dedup, op2_bpe_forced_boundaries, op3_token_wavelet_files, op4_source_mixing, op5_multiprobe_ann,
        op6_toxicity_ordinal, op7_lm_backoff_automaton, op8_secret_ownership, op9_ball_tree_topk, op10_license_templates,
        op11_conversation_repair, op12_simhash_covering, op13_bit_sliced_whitening,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id""",
    "op4_source_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 2 * source_size AS lim, sum(source_size) OVER () AS total,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS place FROM per),
levels AS (SELECT *, (1.5::DOUBLE * total - capped) / open_weight AS level FROM steps),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= lim / weight),
targets AS (SELECT l.source, l.source_size, coalesce(least(CAST(l.lim AS DOUBLE), c.level * l.weight), 0) AS target FROM levels l, chosen c),
lanes AS (
  SELECT *, CAST(round(target) AS BIGINT) AS take, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM targets),
mixed AS (SELECT CAST(sum(take) AS BIGINT) AS words, greatest(1, least(256, CAST(sum(take) AS BIGINT) // 262144)) AS block FROM lanes),
edges AS (
  SELECT l.*, m.block, (l.source_size + m.block - 1) // m.block AS blocks,
    CAST(floor(CAST(coalesce(sum(take) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / m.words * 2147483648.0) AS BIGINT) AS low
  FROM lanes l, mixed m),
spans AS (SELECT *, lead(low, 1, 2147483648) OVER (ORDER BY sid) AS high FROM edges),
points AS (SELECT slot, slot % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range((words + block - 1) // block)) AS slot FROM mixed)),
named AS (
  SELECT s.sid, s.blocks, p.slot, row_number() OVER (PARTITION BY s.sid ORDER BY p.slot) - 1 AS rank
  FROM points p JOIN spans s ON p.point >= s.low AND p.point < s.high),
schedule AS (
  SELECT sid, rank % blocks AS number, count(*) AS times, min(slot) AS slot FROM named WHERE rank < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target, t.block, s.digest,
    sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.digest, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN spans t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT sid, start, size, block, unnest(range(CAST(start AS BIGINT) // block, (CAST(start AS BIGINT) + size - 1) // block + 1)) AS number FROM placed WHERE size > 0),
got AS (
  SELECT p.sid, p.start, sum((least(p.start + p.size - p.number * p.block, p.block) - greatest(p.start - p.number * p.block, 0)) * c.times) AS got,
    min(c.slot) AS first_slot, sum(c.times) AS n_slots
  FROM parts p JOIN schedule c ON p.sid = c.sid AND p.number = c.number GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(CASE WHEN p.size > 0 THEN coalesce(g.got, 0) ELSE 0 END AS BIGINT) AS taken,
  CASE WHEN p.size > 0 THEN g.first_slot END AS first_slot, CAST(CASE WHEN p.size > 0 THEN coalesce(g.n_slots, 0) ELSE 0 END AS BIGINT) AS n_slots
FROM placed p LEFT JOIN got g ON p.sid = g.sid AND p.start = g.start""",
    "op9_ball_tree_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
asked AS (SELECT vec_id, min(w) AS w FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT)) AS score
  FROM asked q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hits AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS hit
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 0 THEN [] WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hits),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
faulty AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault FROM ordered),
told AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
inserted(s, mid, cost, letters, put) AS (VALUES
  (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
edits(letter, c, mid, goes, cost, said) AS (VALUES
  ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
  ('R', NULL, 0, 2, 3, 'user'), ('R', NULL, 1, 2, 3, 'user'), ('R', NULL, 3, 2, 3, 'user'), ('R', NULL, 2, 3, 3, 'assistant')),
paths(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])} FROM conversations
  UNION ALL
  SELECT conv_id, i, goes, min(best) FROM (
    SELECT p.conv_id, f.i, p.state AS goes, {'cost': p.best.cost + 4, 'audit': p.best.audit || 'D', 'said': p.best.said} AS best
    FROM paths p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
    UNION ALL
    SELECT p.conv_id, f.i, e.goes, {'cost': p.best.cost + n.cost + e.cost + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END,
      'audit': p.best.audit || n.letters || e.letter, 'said': list_append(list_concat(p.best.said, CAST(n.put AS VARCHAR[])), coalesce(e.said, f.role) || ':' || f.text)} AS best
    FROM paths p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 AND f.fault IN ('ok', 'truncated')
    JOIN inserted n ON n.s = p.state JOIN edits e ON e.mid = n.mid AND (e.c IS NULL OR e.c = f.c)) GROUP BY ALL),
ended AS (
  SELECT p.conv_id, min({'cost': p.best.cost + n.cost, 'audit': p.best.audit || n.letters, 'said': list_concat(p.best.said, CAST(n.put AS VARCHAR[]))}) AS best
  FROM paths p LEFT JOIN told t ON p.conv_id IS NOT DISTINCT FROM t.conv_id JOIN inserted n ON n.s = p.state AND n.mid IN (0, 3)
  WHERE p.i = coalesce(t.n, 0) GROUP BY p.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.said, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN told t ON e.conv_id IS NOT DISTINCT FROM t.conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
