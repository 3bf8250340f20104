"""Tables between steps of iterative work, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the whole cluster shares; a local one only where none is named and there is no cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/edgetide/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table: its lineage ends here, and a lost executor costs no earlier step."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in batches sorted by them, each whole; a run may cross batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        n = part.num_rows
        if not n:
            continue
        cols = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [*([0] if last is not None and first != last else []), *np.flatnonzero(new).tolist()]
        at = 0
        for cut in cuts:
            if cut > at:
                rest.append(part.slice(at, cut - at))
            if rest:
                yield _joined(rest)
            rest, at = [], cut
        rest.append(part.slice(at))
        last = tuple(c[-1] for c in cols)
    if rest:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
