"""Operator 8: secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import batches, written

#: The base patterns, in the order in which kinds are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "live")
#: Words that a dummy value consists of, whole or part by part.
_DUMMY = frozenset("example sample dummy changeme placeholder your my the password passwd secret token key api apikey access auth id test testing foo bar foobar default none null undefined redacted".split())
_RUNS = ("0123456789012345", "abcdefghijklmnopqrstuvwxyz", "qwertyuiop")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value may be a credential in use: random for its length, and not made of dummy words or runs alone.

    Entropy is held against the most that the value's length (or an alphabet of 64) allows.
    """
    if len(value) < 2 or _entropy(value) < 0.6 * log2(min(len(value), 64)):
        return False
    parts = [x for x in re.split(r"[^0-9a-z]+", value.lower()) if x]
    return not all(x in _DUMMY or any(x in run for run in _RUNS) for x in parts)


def find(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) of the base spans, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("own", pa.int32()), ("digest", pa.string()), ("strong", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("spans", pa.list_(_SPAN))])
_FOUND_SQL = "doc_id long, mark long, repo string, owner string, spans array<struct<start:int,kind:int,end:int,own:int,digest:string,strong:boolean>>"


def _scan(c: dict[str, list]) -> dict[str, list]:
    spans = []
    for text in c["text"]:
        one = []
        for start, kind, end, own in find(text or ""):
            value = text[own:end]
            one.append({"start": start, "kind": kind, "end": end, "own": own, "digest": hashlib.sha256(value.encode()).hexdigest(), "strong": looks_live(value)})
        spans.append(one)
    return c | {"spans": spans}


def scan_secrets(docs: DataFrame, *, owner: Column | None = None, repo: Column | None = None, few: int = 2) -> DataFrame:
    """doc_id, mark (hash of the text), spans and live for every row of ``docs(doc_id, text, source, lang)``.

    ``spans`` are the base matches; ``live`` holds (start, end, owners, repos) of their values that look
    like a credential in use (``looks_live``) and that one owner alone has, in however many repositories,
    or at most ``few`` owners with no more than ``few`` repositories between them, over the whole corpus. What
    many share is an example and stays out. The owner is ``source`` and the repository (source, lang) unless
    other columns are given.

    Texts are scanned once, where they lie; after that only the few rows with candidates move. Owners
    are counted per digest from distinct (digest, owner) rows, pre-aggregated before each shuffle, so a
    secret that a third of all documents hold costs one row a task. A null or empty text has no spans;
    rows with one doc_id and text share their spans, and each stays in the result. Columns beside those four are
    not read, so clashing names do no harm; an empty table gives an empty result.
    """
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repo = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))) if repo is None else repo
    given = docs.select("doc_id", F.xxhash64("text").alias("mark"), repo.alias("repo"), owner.alias("owner"), "text")
    found = written(given.mapInArrow(batches(_scan, _FOUND), _FOUND_SQL), "secrets")
    each = found.where("size(spans) > 0").select("doc_id", "mark", "repo", "owner", F.explode("spans").alias("s")).select("doc_id", "mark", "repo", "owner", "s.*")
    pairs = each.where("strong").groupBy("digest", "owner", "repo").agg(F.lit(1).alias("x"))
    by_owner = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    known = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).where((F.col("owners") == 1) | (F.col("owners") <= few) & (F.col("repos") <= few))
    spans = each.where("strong").join(known, "digest").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct(F.col("own").alias("start"), "end", "owners", "repos"))).alias("live"))
    joined = found.alias("f").join(spans.alias("l"), F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("f.mark").eqNullSafe(F.col("l.mark")), "left")
    return joined.select("f.doc_id", "f.mark", "f.spans", F.coalesce("live", F.array().cast("array<struct<start:int,end:int,owners:long,repos:long>>")).alias("live"))


def redact(docs: DataFrame, scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the live spans of each text masked and n_chars following; all rows and columns stay."""
    names = docs.columns
    live = scanned.where("size(live) > 0").select("doc_id", "mark", F.col("live").alias("spans")).dropDuplicates(["doc_id", "mark"]).select(F.struct("doc_id", "mark", "spans").alias("l"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    joined = rows.join(live, F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("l.mark")), "left")
    by_end = F.array_sort("l.spans", lambda a, b: b["end"] - a["end"])
    start = F.struct(F.col("d.text").alias("t"), F.lit(1 << 30).alias("at"))

    def step(acc, s):
        end = F.least(s["end"], acc["at"])
        cut = F.concat(F.substr(acc["t"], F.lit(1), s["start"]), F.lit(mask), F.substr(acc["t"], end + 1))
        return F.when(s["start"] < acc["at"], F.struct(cut.alias("t"), s["start"].alias("at"))).otherwise(acc)

    text = F.when(F.col("l").isNotNull(), F.aggregate(by_end, start, step)["t"]).otherwise(F.col("d.text"))
    masked = joined.select("d", "l", text.alias("t"))
    length = F.when(F.col("l").isNotNull(), F.length("t").cast("long")).otherwise(F.col("d.n_chars")) if "n_chars" in names else None
    new = {"text": F.col("t"), "n_chars": length}
    return masked.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in names))
