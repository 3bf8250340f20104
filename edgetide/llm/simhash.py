"""Operator 12: SimHash near-duplicates by anchors of a covering code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import slices, written

SEED = 42
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_PIECE = 1 << 20
_FLUSH = 1 << 15
#: Homes times rows that are compared at once.
_AT_ONCE = 1 << 22


def _word_runs(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in runs of bounded length, each run opened by the last size - 1 words of the one before."""
    carry: list[bytes] = []
    at = 0
    while at < len(raw):
        cut = _WHITE.search(raw, min(len(raw), at + _PIECE))
        end = cut.start() if cut else len(raw)
        words = carry + raw[at:end].lower().split()
        yield words
        carry, at = words[max(0, len(words) - size + 1) :], end


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes: a bit is set where over half the shingles' XXH64 have it.

    Shingles are ``size`` words joined by one space, repeats included; a text of fewer words is one shingle, one without
    words has the fingerprint zero.
    """
    ones, n, held, short = np.zeros(64, np.int64), 0, [], []
    hashed = xxhash.xxh64_intdigest

    def flush() -> None:
        nonlocal ones
        if held:
            ones = ones + np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
            held.clear()

    for words in _word_runs(raw or b"", size):
        short = words
        for k in range(len(words) - size + 1):
            held.append(hashed(b" ".join(words[k : k + size]), SEED))
            if len(held) == _FLUSH:
                flush()
                n += _FLUSH
    if not n and not held and short:
        held.append(hashed(b" ".join(short), SEED))
    n += len(held)
    flush()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _printer(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            made = [fingerprint(t.as_py(), size) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return run


def _syndromes() -> np.ndarray:
    """For each 16-bit half of a word the exclusive or of the places (1 to 31) of its set bits; bit 31 has no place."""
    low = np.zeros(1 << 16, np.uint64)
    for bit in range(16):
        low[(np.arange(1 << 16) >> bit) & 1 == 1] ^= np.uint64(bit + 1)
    return low


_LOW = _syndromes()
_SHIFTED = np.array([0, *(1 << k for k in range(31))], np.uint64)


def nearest_anchor(words: np.ndarray) -> np.ndarray:
    """The codeword at distance 0 or 1 from each 32-bit word, in the perfect Hamming code on bits 0..30 with bit 31 as it is."""
    low = words & np.uint64(0x7FFFFFFF)
    high = low >> np.uint64(16)
    s = _LOW[low & np.uint64(0xFFFF)] ^ _LOW[high]
    s ^= np.where(np.bitwise_count(high) & 1, np.uint64(16), np.uint64(0))
    return words ^ _SHIFTED[s]


def anchors(words: np.ndarray, within: int) -> np.ndarray:
    """Every codeword within 1 + ``within`` of each word, one row a word, repeats included; the first column is its own."""
    flips = [sum(1 << b for b in c) for k in range(within + 1) for c in combinations(range(32), k)]
    return np.stack([nearest_anchor(words ^ np.uint64(f)) for f in flips], axis=1)


def _placer(apart: int):
    """(anchor, home, print): a fingerprint at each anchor that it has to be compared at; home marks its nearest one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, 4096):
            prints = part.column("print").to_numpy().view(np.uint64)
            for half in (0, 1):
                made = anchors((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), apart // 2)
                home = made[:, 0].copy()
                made.sort(axis=1)
                keep = np.ones(made.shape, bool)
                keep[:, 1:] = made[:, 1:] != made[:, :-1]
                row, col = np.nonzero(keep)
                at = made[row, col]
                names = ["anchor", "home", "print"]
                yield pa.RecordBatch.from_arrays([pa.array((at | np.uint64(half << 32)).view(np.int64)), pa.array(at == home[row]), pa.array(prints[row].view(np.int64))], names=names)

    return run


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the given links that is not the least of its component, with the least."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        np.minimum.at(label, label[x], label[y])
        np.minimum.at(label, label[y], label[x])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _comparer(apart: int):
    """Links between the homes of a group and all its rows, as the least fingerprint of each linked set."""

    def linked(key: list[np.ndarray], home: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0)))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(prints)))
        group = np.cumsum(new) - 1
        asked = np.flatnonzero(home & (size[group] > 1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        upto = np.concatenate(([0], np.cumsum(size[group[asked]])))
        at = 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + _AT_ONCE, "right")) - 1)
            some = asked[at:to]
            n = size[group[some]]
            left = np.repeat(some, n)
            right = np.arange(len(left)) - np.repeat(upto[at:to] - upto[at], n) + np.repeat(first[group[some]], n)
            near = (np.bitwise_count(prints[left] ^ prints[right]) <= apart) & (prints[left] != prints[right])
            if near.any():
                found.append(_least(prints[left[near]], prints[right[near]]))
            at = to
        if not found:
            return None
        a, b = _least(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for part in parts:
            if not part.num_rows:
                continue
            now = [part.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "bi", "bj", "home", "print")]
            now[-1] = now[-1].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = np.flatnonzero(np.any([k != k[-1] for k in now[:3]], axis=0))
            cut = last[-1] + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            if cut and (out := linked([x[:cut] for x in now[:3]], now[3][:cut], now[4][:cut])):
                yield out
        if rest is not None and (out := linked(rest[:3], *rest[3:])):
            yield out

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, print) of ``docs(doc_id, text)``: the fingerprint as a signed long; texts go to Python as UTF-8 bytes."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_printer(size), "doc_id long, print long")


def simhash_duplicates(docs: DataFrame, *, shingle: int = 3, apart: int = 2, block: int = 4096) -> DataFrame:
    """SimHash classes of ``docs(doc_id, text)``: doc_id, print (the 64-bit fingerprint as a signed long), component_id.

    Fingerprints that differ in at most ``apart`` bits (3 at most) are linked. Of two such fingerprints one 32-bit half
    differs in ``apart // 2`` bits or fewer. For each half the anchors are the words of the perfect Hamming code on 31
    bits, the last bit kept, whose covering radius is 1: a fingerprint has its home at the nearest anchor and is replicated
    to every anchor within 1 + apart // 2 (17 at most at apart 2), so it meets the home of each fingerprint that it is
    linked with, and only homes are compared with an anchor's rows, on all 64 bits.

    * Equal fingerprints are one node, aggregated before anything is replicated.
    * Anchors of more than ``block`` rows are met in blocks of homes by blocks of rows, spread over tasks; nothing is capped.
      A task gives each linked fingerprint the least one of its set, not all pairs.
    * Null or empty texts and texts without words have the fingerprint zero, linked like any other; long texts are read in
      runs of about a megabyte, all of them. ``component_id`` is the least doc_id of any row in the class. Repeated rows get
      equal results; a row with a null doc_id has its fingerprint, takes no part in links and has a null component. Other
      columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= apart <= 3:
        raise ValueError("the anchors serve up to three differing bits")
    table = written(fingerprints(docs, shingle), "prints")
    nodes = written(table.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    placed = nodes.select("print").mapInArrow(_placer(apart), "anchor long, home boolean, print long")
    large = written(placed.groupBy("anchor").agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).where(F.col("m") > block), "anchors")
    one = F.lit(0)
    if large.isEmpty():
        blocks = placed.select("anchor", one.alias("bi"), one.alias("bj"), "home", "print")
    else:
        counted = placed.join(large, "anchor", "left")
        parts = lambda c: F.coalesce(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
        counted = counted.withColumn("rows", parts("m")).withColumn("lots", F.greatest(parts("homes"), F.lit(1)))
        own = lambda n: F.pmod(F.hash("print"), F.col(n))
        every = lambda n: F.sequence(one, F.col(n) - 1)
        as_row = counted.select("anchor", F.explode(every("lots")).alias("bi"), own("rows").alias("bj"), F.lit(False).alias("home"), "print")
        as_home = counted.where("home").select("anchor", own("lots").alias("bi"), F.explode(every("rows")).alias("bj"), F.lit(True).alias("home"), "print")
        blocks = as_row.union(as_home)
    ordered = blocks.repartition("anchor", "bi", "bj").sortWithinPartitions("anchor", "bi", "bj")
    labels = components(written(ordered.mapInArrow(_comparer(apart), "a long, b long"), "print-links"))
    labels = written(labels, "print-labels")
    least = labels.join(nodes, labels["node"] == nodes["print"]).groupBy("component").agg(F.min("least").alias("lowest"))
    linked = labels.join(least, "component").select(F.col("node").alias("print"), "lowest")
    of_node = written(nodes.join(linked, "print", "left").select("print", F.coalesce("lowest", "least").alias("component")), "print-classes")
    return table.join(of_node, "print", "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
