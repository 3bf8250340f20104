"""Operator 1: MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketch import band_keys, sketch
from .store import batches, groups, slices, written
from .words import mix, shingles

_SKETCHED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("coords", pa.binary()), ("parity", pa.binary())])
_SKETCHED_SQL = "doc_id long, mark long, n_shingles long, node binary, bands array<long>, coords binary, parity binary"
_BITS = 1024


def _sketcher(size: int, bins: int, rows: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, size) for t in cols["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        out = {"doc_id": cols["doc_id"], "mark": cols["mark"], "n_shingles": [len(s) for s in sets]} | {k: [None] * len(sets) for k in ("node", "bands", "coords", "parity")}
        if full:
            made = np.stack([sketch(sets[i], bins) for i in full])
            keys, low = band_keys(made, rows), (mix(made) & np.uint64(255)).astype(np.uint8)
            for k, i in enumerate(full):
                out["bands"][i], out["coords"][i] = keys[k], low[k].tobytes()
                out["parity"][i] = np.packbits(np.bincount((mix(sets[i]) >> np.uint64(54)).astype(np.int64), minlength=_BITS) & 1).tobytes()
                out["node"][i] = b"".join(x.sum(dtype=np.uint64).tobytes() for x in (mix(sets[i]), mix(~sets[i])))
        return out

    return run


def _linked(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Whether two full sets meet the threshold; an empty one meets none."""
    if not len(p) or not len(q) or min(len(p), len(q)) * den < num * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, True))
    return den * both >= num * (len(p) + len(q) - both)


def _matcher(size: int, num: int, den: int):
    """Of pairs with both texts, those whose full shingle sets meet the threshold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, np.ndarray] = {}

        def of(doc: bytes, text: str) -> np.ndarray:
            if doc not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[doc] = shingles(text, size)
            return kept[doc]

        for part in slices(parts):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            good = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if _linked(of(x, part.column("text_a")[i].as_py()), shingles(part.column("text_b")[i].as_py(), size), num, den):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.binary()) for x in (a, b)], names=["a", "b"])

    return run


def _texts(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """One text for each of the asked nodes, by the node's own (doc_id, mark)."""
    return docs.join(nodes.join(asked, "node", "left_semi"), ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs of nodes that meet the threshold on their full sets.

    The members' texts travel once for each pair, the hubs' are joined beside them; a hot hub's partition is split.
    """
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs)
    side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_matcher(size, num, den), "a binary, b binary")


_OPEN_SQL = "key long, bi int, bj int, side int, doc binary, hub binary, comp binary, n long, coords binary, parity binary, bands array<long>"


def _likely(g: pa.RecordBatch, num: int, den: int, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs (row, later rows) of two blocks of a bucket that are of different components, not tested yet and likely.

    Of the buckets that a pair shares only the one with the least key has it: where components differ, each of
    them is open or has tested the pair. A pair whose sizes cannot meet the threshold is out, so is one whose
    parity bitmaps differ in more bits than a linked pair may have elements apart (both exact bounds), then one
    whose sketches agree in far too few coordinates.
    """
    n, side = (g.column(k).to_numpy() for k in ("n", "side"))
    names = [g.column(k).to_pylist() for k in ("doc", "comp", "hub")]
    place = {x: i for i, x in enumerate(sorted(set().union(*names)))}
    doc, comp, hub = (np.array([place[x] for x in own]) for own in names)
    coords = np.frombuffer(b"".join(g.column("coords").to_pylist()), np.uint8).reshape(len(doc), -1)
    parity = np.frombuffer(b"".join(g.column("parity").to_pylist()), np.uint64).reshape(len(doc), -1)
    bands = g.column("bands").flatten().to_numpy().reshape(len(doc), -1)
    need = coords.shape[1] * (num / den - slack)
    key, none = g.column("key")[0].as_py(), np.iinfo(np.int64).max
    alone = g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
    for i in range(len(doc)):
        ok = (comp != comp[i]) & (doc != hub) & (doc > doc[i]) if alone else (comp != comp[i]) & (doc != hub) & (side > side[i])
        ok &= (np.minimum(n, n[i]) * den >= num * np.maximum(n, n[i])) & (doc[i] != hub[i])
        at = np.flatnonzero(ok)
        if len(at):
            first = np.where(bands[at] == bands[i], bands[at], none).min(1)
            at = at[(first == key) | (first == none)]
            apart = np.bitwise_count(parity[at] ^ parity[i]).sum(1, dtype=np.int64)
            at = at[apart * (num + den) <= (den - num) * (n[at] + n[i])]
            at = at[(coords[at] == coords[i]).sum(1) >= need]
        if len(at):
            yield i, at


def _with_partner(num: int, den: int, slack: float):
    """Rows of the blocks that are in some likely pair, the only ones whose texts are needed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, ["key", "bi", "bj"]):
            asked = np.zeros(g.num_rows, bool)
            for i, at in _likely(g, num, den, slack):
                asked[i] = asked[at] = True
            if asked.any():
                yield g.filter(pa.array(asked))

    return run


def _joining(size: int, num: int, den: int, slack: float, most: int = 64 << 20):
    """Links by which components of two blocks come together: each likely pair is met on its full sets, unless its
    components have met before, so a group of r rows gives r - 1 links at most. ``most`` bytes of sets are kept.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, ["key", "bi", "bj"]):
            text, doc, comp = g.column("text"), g.column("doc").to_pylist(), g.column("comp").to_pylist()
            above = {c: c for c in comp}
            kept: dict[int, np.ndarray] = {}
            held, out = 0, []

            def top(c: bytes) -> bytes:
                while above[c] != c:
                    above[c] = c = above[above[c]]
                return c

            for i, at in _likely(g, num, den, slack):
                for j in at.tolist():
                    a, b = top(comp[i]), top(comp[j])
                    if a == b:
                        continue
                    for k in (i, j):
                        if k not in kept:
                            if held > most:
                                kept, held = {x: s for x, s in kept.items() if x == i}, 0
                            kept[k] = shingles(text[k].as_py(), size)
                            held += kept[k].nbytes
                    if _linked(kept[i], kept[j], num, den):
                        above[b] = a
                        out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, bins: int = 160, rows: int = 5, block: int = 512, slack: float = 0.16) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept, mark, class.

    Sets of ``shingle`` words are sketched (fast similarity sketching, ``bins`` coordinates), bands of
    ``rows`` coordinates give buckets, and only pairs with den * intersection >= num * union on their
    full sets are linked. At 160 coordinates and rows of 5 a pair at 0.85 shares no band with a chance
    under 1e-8, one at 0.8 under 4e-6.

    * Equal sets are one node, named by a 128-bit digest, so thousands of copies cost one node.
    * In each bucket every member is first checked against the least one; components follow. Members
      of a bucket that is then all one component need no more, so a large group of near copies costs
      rows in proportion. Otherwise members outside the bucket's largest component are compared with all
      others in blocks of ``block``, by exact size and bitmap bounds and then by sketch within the task.
      Rows of likely pairs get their texts and meet once more in their blocks, where each such pair of
      components still apart is verified; only the links that join components leave the task, fewer than
      its rows. No bucket is capped. ``slack`` is five standard deviations of the sketch's estimate at
      0.8, so that bound loses a linked pair with a chance under 1e-6.
    * Null or empty texts and texts without words have the empty set and are linked with nothing.
      ``component_id`` is the least doc_id of any row in the class; each row follows the set of its own
      text, also where rows share a doc_id. A row with a null doc_id takes no part: its component is null
      and it is kept. ``mark`` is a hash of the row's text and ``class`` the digest that names its class, null
      without one. Repeated rows get equal results. Other columns are ignored; an empty table gives an empty
      result.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    table = written(docs.mapInArrow(batches(_sketcher(shingle, bins, rows), _SKETCHED), _SKETCHED_SQL), "sketches")
    full = table.where("n_shingles > 0 and doc_id is not null")
    nodes = written(full.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("r")).select("node", "r.doc_id", "r.mark"), "nodes")
    docs = docs.where("text is not null and doc_id is not null")
    reps = full.join(nodes, ["node", "doc_id", "mark"], "left_semi")
    exploded = reps.select("node", F.explode("bands").alias("key")).distinct()
    hubs = exploded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = written(exploded.join(hubs, "key").select("key", F.col("node").alias("doc"), "hub", "m"), "members")
    first = members.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    edges = written(_verified(first, nodes, docs, shingle, num, den), "edges")
    labels = components(edges)

    placed = members.where("m > 2").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "hub", "m", F.coalesce("component", "doc").alias("comp"))
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("own"), F.first("m").alias("m"))
    top = per.groupBy("key").agg(F.max(F.struct("own", "comp")).alias("t"), F.first("m").alias("m")).where("t.own < m")
    top = top.select("key", F.col("t.comp").alias("top"), F.ceil((F.col("m") - F.col("t.own")) / block).cast("int").alias("rest"), F.ceil(F.col("t.own") / block).cast("int").alias("mass"))
    sketches = reps.select(F.col("node").alias("doc"), F.col("n_shingles").alias("n"), "coords", "parity", "bands").dropDuplicates(["doc"])
    in_top, spread = F.col("comp") == F.col("top"), lambda n: F.pmod(F.hash("doc"), F.col(n))
    sides = F.when(in_top, F.col("rest") + spread("mass")).otherwise(spread("rest"))
    others = F.when(in_top, F.col("rest")).otherwise(F.col("rest") + F.col("mass"))
    open_ = (
        placed.drop("m").join(top, "key").join(sketches, "doc")
        .withColumn("side", sides).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select("key", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "doc", "hub", "comp", "n", "coords", "parity", "bands")
    )
    blocks = lambda rows: rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    likely = written(blocks(open_).mapInArrow(_with_partner(num, den, slack), _OPEN_SQL), "likely")
    texts = _texts(likely.select(F.col("doc").alias("node")).distinct(), nodes, docs).withColumnRenamed("node", "doc")
    more = written(blocks(likely.join(texts, "doc").select(*likely.columns, "text")).mapInArrow(_joining(shingle, num, den, slack), "a binary, b binary").distinct(), "edges")
    if not more.isEmpty():
        labels = components(edges.union(more))
    labels = written(labels, "labels")
    least = labels.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = labels.join(least, "component").select("node", "component", "least")
    return (
        table.join(nodes.select("node", F.col("doc_id").alias("rep")), "node", "left").join(linked, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("class"))
    )
