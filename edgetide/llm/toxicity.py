"""Operator 6: toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import batches, slices

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Word beginnings of 4 to 6 letters (shorter words whole): stems count whatever their ending."""
    words = set(_WORD.findall((text or "").lower()))
    return {w[:k] for w in words for k in (4, 5, 6)}


class CumulativeLink:
    """P(grade >= k) = sigmoid(w . x - threshold_k): one weight a feature, shared by all thresholds."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    @classmethod
    def fit(cls, vocabulary: dict[str, int], rows: list[list[int]], grades: np.ndarray, levels: int, steps: int = 300, ridge: float = 0.05) -> CumulativeLink:
        """Full-batch Adam on the log-likelihood of the ordinal model; deterministic."""
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(row) else np.zeros(0, np.int64)
        n, width = max(len(rows), 1), len(vocabulary)
        above = [np.mean(grades >= k) if len(grades) else 0.0 for k in range(1, levels)]
        first = -np.log((np.clip(above, 1e-4, 1 - 1e-4)) / (1 - np.clip(above, 1e-4, 1 - 1e-4)))
        p = np.concatenate((np.zeros(width), [first[0]], np.log(np.maximum(np.diff(first), 0.1))))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            gaps = np.exp(p[width + 1 :])
            cut = p[width] + np.concatenate(([0.0], np.cumsum(gaps)))
            s = np.bincount(row, p[col], n)[: len(rows)]
            up = np.vstack([np.ones(len(s)), *(1 / (1 + np.exp(np.clip(c - s, -60, 60))) for c in cut), np.zeros(len(s))])
            hi, lo = np.take_along_axis(up, grades[None], 0)[0], np.take_along_axis(up, grades[None] + 1, 0)[0]
            like = np.maximum(hi - lo, 1e-9)
            ds = (hi * (1 - hi) - lo * (1 - lo)) / like
            g = np.zeros_like(p)
            g[:width] = np.bincount(col, -ds[row], width) / n + ridge * p[:width] / n
            by_cut = np.array([np.sum((grades == k) * up[k] * (1 - up[k]) / like - (grades == k - 1) * up[k] * (1 - up[k]) / like) for k in range(1, levels)]) / n
            g[width] = by_cut.sum()
            for k in range(1, levels - 1):
                g[width + k] = by_cut[k:].sum() * gaps[k - 1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(vocabulary, p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :])))))

    def above(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of a whole text; 0 without any word."""
        own = features(text)
        if not own:
            return np.zeros(len(self.thresholds))
        at = [i for f in own if (i := self.vocabulary.get(f)) is not None]
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[at].sum(), -60, 60)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, most_features: int = 2_000, min_count: int = 3) -> CumulativeLink:
    """Fit on at most ``most_rows`` labelled documents (those with the least hash of doc_id), ``labels(doc_id, toxic)``.

    Grades: 0 for documents labelled clean; toxic ones are 1, or 2 if they hold more telling features
    than the median toxic document. Features are the ``most_features`` with the largest chi-square of
    those in ``min_count`` sampled toxic or clean documents (held-out hits at sf 0.1: 0.82 with 2,000, 0.85 with
    100, 0.65 with 10,000; with 100 a labelled clean document of sf 0.001 is rejected). What reaches the driver
    is bounded by both. Labels with a null doc_id or value are left out, several of one doc_id count as the highest;
    without toxic or without clean labels nothing, or everything, is toxic. Texts are read whole.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for b in slices(parts):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update(features(text))
                rows[toxic > 0] += 1
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(["", *names]), "clean": pa.array([rows[0], *(seen[0][x] for x in names)], pa.int64()), "toxic": pa.array([rows[1], *(seen[1][x] for x in names)], pa.int64())})

    counts = texts.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).persist()
    whole = counts.where("feature = ''").first()
    nc, nt = (whole["c"], whole["t"]) if whole else (0, 0)
    if not nc or not nt:
        counts.unpersist()
        return CumulativeLink({}, np.zeros(0), np.array([-20.0 if nt else 20.0, 30.0]))
    chi = F.pow(F.col("t") * F.lit(float(nc)) - F.col("c") * F.lit(float(nt)), 2) / ((F.col("t") + F.col("c")) * (F.lit(nt + nc + 1.0) - F.col("t") - F.col("c")))
    chosen = counts.where(f"feature <> '' and t + c >= {min_count}").orderBy(chi.desc(), "feature").limit(most_features).collect()
    counts.unpersist()
    vocabulary = {r["feature"]: i for i, r in enumerate(chosen)}
    odds = np.array([np.log((r["t"] + 0.5) / (nt + 1)) - np.log((r["c"] + 0.5) / (nc + 1)) for r in chosen])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("at", pa.list_(pa.int32())), ("toxic", pa.int32())])
    fn = batches(lambda c: {"at": [sorted(held.value[f] for f in features(t) if f in held.value) for t in c["text"]], "toxic": c["toxic"]}, schema)
    got = sorted((list(r["at"]), r["toxic"]) for r in texts.mapInArrow(fn, "at array<int>, toxic int").toLocalIterator())
    told = np.array([int((odds[at] > 2).sum()) for at, _ in got])
    toxic = np.array([t > 0 for _, t in got])
    grades = np.where(toxic, np.where(told > np.median(told[toxic]), 2, 1), 0)
    return CumulativeLink.fit(vocabulary, [at for at, _ in got], grades, 3)


def score_toxicity(docs: DataFrame, model: CumulativeLink, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest count of passed thresholds), p_toxic, toxic; a row a document.

    A text without words, null and empty ones among them, has severity 0. Each row is scored by its own text, so
    null or repeated doc_ids and repeated rows are rows like others; other columns are not read, so clashing
    names do no harm; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def run(c: dict[str, list]) -> dict[str, list]:
        p = [held.value.above(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "severity": [float(x.sum()) for x in p], "grade": [int((x >= threshold).sum()) for x in p], "p_toxic": [float(x[0]) for x in p], "toxic": [bool(x[0] >= threshold) for x in p]}

    return docs.select("doc_id", "text").mapInArrow(batches(run, schema), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: CumulativeLink, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose own text is not toxic, all columns as they are; decided row by row, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            yield part.filter(pa.array([bool(held.value.above(t)[0] < threshold) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
