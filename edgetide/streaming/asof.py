"""J-4 over streams: each query's last k items strictly before it, once the watermark says that they have all arrived."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EDGE = "ms long, seq long, dst long"
_QUERY = "ms long, qid long"
_OUT = "qid long, src long, time long, items array<long>, gaps array<double>"


class AsOfHistory(StatefulProcessor):
    """State of one source: its edges that some open or coming query can still need, and its open queries.

    A query waits behind an event-time timer at its own time. When the watermark has passed it, no edge before the query
    can come any more, so its answer is final and given once. Of the edges that lie before the watermark only the last k
    can matter to later queries; the others are dropped there and then, so state does not grow with the log.
    """

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getListState("edges", _EDGE)
        self.queries = handle.getListState("queries", _QUERY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        edges, queries = [], []
        for r in rows:
            if r.kind:
                edges.append((r.ms, r.seq, r.dst))
            else:
                queries.append((r.ms, r.seq))
        if edges:
            self.edges.appendList(edges)
        if queries:
            self.queries.appendList(queries)
            for ms in {ms for ms, _ in queries}:
                self.handle.registerTimer(max(ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        edges = sorted(tuple(e) for e in self.edges.get())
        open_ = [tuple(q) for q in self.queries.get()]
        for ms, qid in open_:
            if ms <= now:
                last = [e for e in edges if e[0] < ms][-self.k :]
                yield Row(qid=qid, src=key[0], time=ms // 1000, items=[e[2] for e in last], gaps=[math.log1p((ms - e[0]) // 1000) for e in last])
        waiting = [q for q in open_ if q[0] > now]
        settled = [e for e in edges if e[0] < min([now, *(q[0] for q in waiting)])]
        if edges:
            self.edges.put(settled[-self.k :] + edges[len(settled) :])
        if waiting:
            self.queries.put(waiting)
        else:
            self.queries.clear()

    def close(self) -> None:
        pass


def stream_history_asof(edges: DataFrame, queries: DataFrame, k: int, lateness: str = "1 day") -> DataFrame:
    """(qid, src, time, items, gaps) as in ``history_asof``, over streams ``edges(src, dst, ts, seq)`` and ``queries(qid, src, ts)``.

    Rows may be late by ``lateness``; later ones are dropped. Answers come in append mode, each once, after the watermark
    has passed the query. Needs the RocksDB state store provider.
    """
    ms = F.unix_millis("ts").alias("ms")
    a = edges.select("src", "ts", ms, "seq", "dst", F.lit(1).alias("kind"))
    b = queries.select("src", "ts", ms, F.col("qid").alias("seq"), F.lit(None).cast("long").alias("dst"), F.lit(0).alias("kind"))
    rows = a.union(b).withWatermark("ts", lateness)
    return rows.groupBy("src").transformWithState(statefulProcessor=AsOfHistory(k), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
