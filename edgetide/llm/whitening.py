"""Operator 13: whitening of embeddings from a bit-sliced, exact scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

_ROWS = 1 << 15
#: Entries beyond this leave a long when they are shifted.
_MOST = 2.0**61
#: Eigenvalues up to this share of the largest are rounding, not variance.
_NONE = 1e-12


@dataclass
class Whitening:
    """What a fit leaves on the driver, bounded by the square of the dimensions: counts and sums are exact integers."""

    n: int
    low: list[int]
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None


def quantized(df: DataFrame, column: str, scale: int, shift: int) -> DataFrame:
    """The frame with ``x``: floor(scale * entry) + shift as longs, of rows that have a vector to take."""
    v = F.transform(column, lambda c: c.cast("double"))
    fits = F.size(column) > 0
    fits &= F.forall(v, lambda c: c.isNotNull() & (F.abs(c) * scale < _MOST))
    return df.where(F.col(column).isNotNull() & fits).withColumn("x", F.transform(v, lambda c: F.floor(c * scale) + shift))


def _matrix(part: pa.RecordBatch, d: int) -> np.ndarray:
    x = part.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)


def _planes(rows: np.ndarray, bits: int) -> np.ndarray:
    """(bits, dimensions, words): bit p of each dimension over the rows, 64 rows in a word."""
    n, d = rows.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.uint64)
    padded[:n] = rows
    bit = lambda p: ((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
    return np.stack([np.ascontiguousarray(np.packbits(bit(p), axis=0).T).view(np.uint64) for p in range(bits)])


def _slicer(low: list[int], bits: int):
    """Counts of a task's rows: of set bits by (dimension, plane), and of bits set in both by (dimensions, p + q)."""
    d = len(low)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, both, n = np.zeros((d, bits), np.int64), np.zeros((d, d, 2 * bits - 1), np.int64), 0
        for part in parts:
            for at in range(0, part.num_rows, _ROWS):
                rows = (_matrix(part.slice(at, _ROWS), d) - np.array(low, np.int64)).astype(np.uint64)
                planes = _planes(rows, bits)
                n += len(rows)
                ones += np.bitwise_count(planes).sum(2, dtype=np.int64).T
                for p in range(bits):
                    for q in range(bits):
                        for i in range(d):
                            both[i, i:, p + q] += np.bitwise_count(planes[p, i] & planes[q, i:]).sum(1, dtype=np.int64)
        if n:
            i, j, k = np.nonzero(both)
            si, sp = np.nonzero(ones)
            cols = [np.concatenate(c) for c in ((i, si, [-1]), (j, np.full(len(si), -1), [-1]), (k, sp, [0]), (both[i, j, k], ones[si, sp], [n]))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int32, np.int64), strict=True)], names=["i", "j", "weight", "count"])

    return run


def _eigh(spark: SparkSession, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of one symmetric matrix, in a task: there one thread does it, beside no other of the driver's."""
    d = len(v)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _ in range(part.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in map(np.ascontiguousarray, np.linalg.eigh(v))], names=["values", "vectors"])

    row = spark.range(1).mapInArrow(run, "values binary, vectors binary").first()
    return np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(d, d)


def _spectrum(spark: SparkSession, n: int, low: list[int], sums: list[int], cross: dict[tuple[int, int], int], most: int) -> Whitening:
    """Eigenvectors of the covariance: n times the cross-products less the product of sums, as integers, over n squared."""
    d = len(low)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * cross.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = _eigh(spark, v)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > _NONE * values[-1] and values[k] > 0][:most]
    return Whitening(n, low, sums, vectors[:, order], values[order], float(np.trace(v)))


def fit_whitening(fit: DataFrame, *, most: int = 16) -> Whitening | None:
    """Components of the distinct integer vectors ``fit(x)``, all of one length; None without rows.

    Every dimension is shifted by its least value; each task packs its bit planes over rows into 64-bit words and counts the
    bits set in both of two planes, so that the products of two dimensions are counts weighted by 2^(p + q). Tasks give
    counts by (dimension, dimension, p + q), summed by Spark; the driver gets at most dimensions^2 * 2 * bits of them and
    goes on in whole numbers of any size until the covariance, centred exactly, goes to ``eigh``.
    Components whose eigenvalue is rounding only (up to 1e-12 of the largest) are left out.
    """
    ranges = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("dim").collect()
    if not ranges:
        return None
    low = [r.low for r in ranges]
    bits = max(1, max((r.high - r.low).bit_length() for r in ranges))
    counts = fit.select("x").mapInArrow(_slicer(low, bits), "i int, j int, weight int, count long").groupBy("i", "j", "weight").agg(F.sum("count").alias("count"))
    n, sums, cross = 0, [0] * len(low), {}
    for r in counts.toLocalIterator():
        if r.i < 0:
            n = r["count"]
        elif r.j < 0:
            sums[r.i] += r["count"] << r.weight
        else:
            cross[r.i, r.j] = cross.get((r.i, r.j), 0) + (r["count"] << r.weight)
    return _spectrum(fit.sparkSession, n, low, sums, cross, most)


def _whitened(rows: np.ndarray, m: Whitening) -> np.ndarray:
    """Centred rows on the components, over the root of their eigenvalue; the shift by the least value keeps all digits."""
    centred = (rows - np.array(m.low, np.int64)).astype(float) - np.array([s / m.n for s in m.sums])
    return centred @ m.vectors / np.sqrt(m.values)


def _deviations(rows: np.ndarray, m: Whitening) -> list[int | None]:
    """Sum of (n * x - S)^2 over the dimensions; null where it leaves a long."""
    shifted = rows - np.array(m.low, np.int64)
    widest = max((m.n * int(shifted.max(initial=0)) + max(m.sums)), 1)
    if widest * widest * rows.shape[1] < 2**63:
        apart = shifted * m.n - np.array(m.sums, np.int64)
        return (apart * apart).sum(1).tolist()
    made = (sum((m.n * x - s) ** 2 for x, s in zip(row, m.sums, strict=True)) for row in shifted.tolist())
    return [x if x < 2**63 else None for x in made]


def _moments(m: Whitening):
    """Sums of a task's whitened rows and of their products, by pair of components."""
    k = m.vectors.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = np.zeros(k), np.zeros((k, k))
        for part in parts:
            y = _whitened(_matrix(part, len(m.low)), m)
            total += y.sum(0)
            both += y.T @ y
        i, j = np.indices((k, k)).reshape(2, -1)
        cols = [np.concatenate(c) for c in ((i, range(k)), (j, np.full(k, -1)), (both.ravel(), total))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, float), strict=True)], names=["i", "j", "total"])

    return run


def identity_error(fit: DataFrame, m: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity, measured over them."""
    k = m.vectors.shape[1]
    if not k:
        return None
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in fit.select("x").mapInArrow(_moments(m), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        if r.j < 0:
            mean[r.i] = r.total / m.n
        else:
            cov[r.i, r.j] = r.total / m.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, m: Whitening, id_column: str) -> DataFrame:
    """(id, deviation, whitened) for rows of ``quantized``; whitened is an array of doubles, a component each."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part, len(m.low))
            y = _whitened(x, m)
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            flat = pa.array(np.ascontiguousarray(y).ravel())
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(_deviations(x, m), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=[id_column, "deviation", "whitened"])

    return rows.select(id_column, "x").mapInArrow(run, f"{id_column} {kind}, deviation long, whitened array<double>")


def whiten_embeddings(df: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", scale: int = 64, shift: int = 1_000_000, most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """Whitened rows (id, deviation, whitened) of ``df`` and the fit, from distinct vectors of whole numbers.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do entries of 2^61 / ``scale`` and
    more, which no long holds. Where vectors differ in length those of the most frequent length (the longer of equals) are
    taken. Repeated rows and equal vectors count once in the fit, aggregated before they are shuffled, and all come out.
    Fit rows go to the shared folder once; no row goes to the driver. A null id stays null; other columns are ignored;
    an empty table, or one without variance, gives no rows. A deviation beyond a long is null.
    """
    rows = quantized(df.select(id_column, column), column, scale, shift).select(id_column, "x")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.select(id_column, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0), None
    rows = rows.where(F.size("x") == lengths.d)
    fit = written(rows.select("x").distinct(), "fit-rows")
    m = fit_whitening(fit, most=most)
    m.identity_error = identity_error(fit, m)
    if m.identity_error is None:
        return rows.select(id_column, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0), m
    return whiten(rows, m, id_column), m
