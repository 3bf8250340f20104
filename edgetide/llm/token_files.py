"""Operator 3: token ids in wavelet-matrix shard files, written and read by Spark."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TwoAges, byte_names
from .store import shared_dir, slices
from .wavelet import WaveletMatrix

_ROW = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()), ("ranks", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_ROW_SQL = "part long, shard long, start long, n long, zeros array<long>, planes binary, ranks binary, doc_ids array<long>, lengths array<long>"
#: ASCII punctuation that stands alone between a letter or digit and white space is a token group of its own.
_TAIL = re.compile(rb"([,.])(?<=[0-9a-z][,.])(?=[\x09-\x0d\x20]|\Z)")
#: Lower-case letters up to U+00FF, then ASCII marks but the apostrophe: one token group each that normalising leaves as it is.
_GROUPS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """The tokenizers library on words: its pre-tokens never span ASCII white space, so each distinct word is encoded once."""

    def __init__(self, text: str, cached: int = 150 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.chars = str.maketrans({chr(b): c for c, b in byte_names().items()})
        self.lowers = '"Lowercase"' in text
        self.cache = TwoAges(cached, self._words)

    def _merged(self, group: bytes) -> list[int]:
        return [x.id for x in self.model.tokenize(group.decode("latin-1").translate(self.chars))]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Plain words, with marks after them or without, by the merges alone, others by the whole of the library."""
        out = []
        for w in words:
            m = _GROUPS.fullmatch(w) if len(w) <= 64 else None
            ids = [] if m is None else self._merged(m[1]) + self._merged(m[2]) if m[2] else self._merged(m[1])
            out.append(array("I", ids).tobytes())
        rest = [i for i, x in enumerate(out) if not x]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", x.ids).tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        if self.lowers and b"<|" not in raw:
            raw = _TAIL.sub(rb" \1", raw.lower())
        return b"".join(self.cache.filled(raw.split()))


_BUILT: dict[int, WordEncoder] = {}


def _built(text: str) -> WordEncoder:
    key = zlib.crc32(text.encode())
    if key not in _BUILT:
        _BUILT[key] = WordEncoder(text)
    return _BUILT[key]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, shard_tokens: int = 1 << 17, partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write shards in ascending doc_id order to ``path``.

    Texts are range-partitioned and sorted by doc_id (ties by text), encoded where they land, and every
    ``shard_tokens`` ids, at the next document's end, a shard leaves the task: bounded memory however
    large the partition. A null or empty text is just its end id; a null doc_id sorts first and is kept,
    as repeated rows are. Other columns are not read. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _built(spec.value), np.array([end_id], "<u4").tobytes()
        part, done, shard = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list = []

        def full() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(held), "<u4")
            planes, ranks, zeros, n = WaveletMatrix.build(all_ids, max(16, int(all_ids.max()).bit_length())).to_row()
            row = (part, shard, done, n, zeros, planes, ranks, ids, [len(x) // 4 for x in held])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ROW, strict=True)], schema=_ROW)

        size = 0
        for b in slices(parts):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append(encoder.encode(text.as_py()) + end)
                ids.append(doc)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield full()
                    done, shard, size = done + size, shard + 1, 0
                    held.clear()
                    ids = []
        if held:
            yield full()

    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(run, _ROW_SQL).write.option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``offset``: ids before the row's part.

    Only the parts' totals, one row a part, meet in one place, to turn starts in a part into starts in all.
    """
    files = spark.read.schema(_ROW_SQL).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(totals.select("part", before.alias("offset"))), "part").withColumn("start", F.col("start") + F.col("offset"))


def _matrix(b: pa.RecordBatch, i: int) -> WaveletMatrix:
    return WaveletMatrix.from_row(*(b.column(c)[i].as_py() for c in ("planes", "ranks", "zeros", "n")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in range(b.num_rows):
                raw = _matrix(b, row).all().astype("<u4").tobytes()
                lengths = b.column("lengths")[row].values
                n = lengths.to_numpy()
                ends = np.cumsum(n)
                cuts = pa.py_buffer(np.concatenate(([0], 4 * ends)).astype("<i4"))
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, cuts, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[row].values, pa.array(ends - n + b.column("start")[row].as_py()), lengths, ids], schema=schema)

    return _shards(spark, path).select("start", "n", "zeros", "planes", "ranks", "doc_ids", "lengths").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for the distinct ``positions(position)``, numbered over all files; others are left out.

    Positions meet their shard through a grid of cells of 2**17 ids; each shard answers from its planes and
    directories, all of its positions (no more than it has ids) at once.
    """
    cell = 1 << 17
    shards = _shards(spark, path)
    grid = shards.select("part", "shard", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("n") - 1) / cell))).alias("cell"))
    asked = positions.select(F.col("position").cast("long")).distinct().withColumn("cell", F.floor(F.col("position") / cell)).join(grid, "cell")
    asked = asked.where("position >= start and position < start + n").groupBy("part", "shard").agg(F.collect_list(F.col("position") - F.col("start")).alias("at"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in range(b.num_rows):
                at = b.column("at")[row].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(at + b.column("start")[row].as_py()), pa.array(_matrix(b, row).access(at))], names=["position", "token"])

    return shards.join(asked.select("part", "shard", "at"), ["part", "shard"]).select("start", "n", "zeros", "planes", "ranks", "at").mapInArrow(run, "position long, token long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n) over all files, by two ranks a plane in each shard; tokens that do not occur have no row."""
    tokens = sorted(set(tokens))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in range(b.num_rows):
                w = _matrix(b, row)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([w.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    files = spark.read.schema(_ROW_SQL).parquet(path).select("n", "zeros", "planes", "ranks")
    return files.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position) of every occurrence of the token over all files, by selects from the last plane up."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_matrix(b, row).find(token) + b.column("start")[row].as_py())], names=["position"])

    return _shards(spark, path).select("start", "n", "zeros", "planes", "ranks").mapInArrow(run, "position long")


def token_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/edgetide/{name}-{uuid.uuid4().hex}"
