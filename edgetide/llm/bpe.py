"""Operator 2: byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up within one token, so a cut there is
certain. Whole texts are first cut at such pairs before white space, where a pre-token ends too. Pieces that
are not one short word are parted into pre-tokens, and these are cut at every such pair, in any script and
without white space. Each distinct fragment is encoded once, on its own, and the results are concatenated.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import slices
from .words import WHITE


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoAges:
    """A cache bounded by bytes: when it is full, its entries become the old ones, which are asked before a miss."""

    #: Bytes of an entry beside those of key and value, and the longest key that is kept.
    ENTRY, LONGEST = 200, 256

    def __init__(self, most: int, make):
        self.most, self.make, self.new, self.old, self.held = most, make, {}, {}, 0

    def filled(self, keys: list) -> list:
        """The values of all keys; those that are missing are made together, each distinct one once."""
        out = list(map(self.new.get, keys))
        if None not in out:
            return out
        at = [i for i, v in enumerate(out) if v is None]
        missing = {keys[i] for i in at}
        known = {k: v for k in missing if (v := self.old.get(k)) is not None}
        if unknown := [k for k in missing if k not in known]:
            known.update(zip(unknown, self.make(unknown), strict=True))
        for i in at:
            out[i] = known[keys[i]]
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        for k, v in known.items():
            if len(k) <= self.LONGEST:
                self.new[k] = v
                self.held += len(k) + len(v) + self.ENTRY
        return out


_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
_MARK = rb"[!-&(-/:-@\[-`{-~]"
#: Latin letters (up to U+024F), digits and ASCII marks but the apostrophe, after at most one space; and their pre-tokens.
_SIMPLE = re.compile(rb" ?(?:" + _LETTER + rb"|[0-9]|" + _MARK + rb")+")
_GROUPS = re.compile(rb" ?" + _LETTER + rb"+| ?[0-9]+| ?" + _MARK + rb"+")


class ByteBPE:
    """A vocabulary file with what cutting and decoding need: which byte pairs are certain cuts, and bytes by id."""

    def __init__(self, text: str, cached: int = 32 << 20):
        self.text = text
        spec = json.loads(text)
        names, vocab = byte_names(), spec["model"]["vocab"]
        self.names, self.chars = names, str.maketrans({chr(b): c for c, b in names.items()})
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.added:
                self.bytes[i] = bytes(names[c] for c in token)
        self.never = np.ones((256, 256), bool)
        for b in self.bytes:
            for x, y in zip(b, b[1:], strict=False):
                self.never[x, y] = False
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache, self.parts = TwoAges(cached // 2, self._pieces), TwoAges(cached // 2, lambda raw: [*map(self._merged, raw)])

    @cached_property
    def library(self):
        """The library's merges and pre-tokens; a worker that only decodes never builds them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.text)
        return made.model, made.pre_tokenizer

    def _merged(self, raw: bytes) -> bytes:
        """Ids of bytes within one pre-token, by the vocabulary's merges alone."""
        return array("I", [x.id for x in self.library[0].tokenize(raw.decode("latin-1").translate(self.chars))]).tobytes()

    def fragments(self, raw: bytes) -> list[bytes]:
        """The pre-tokens of a piece, cut at every byte pair that no token holds."""
        out = []
        for token, _ in self.library[1].pre_tokenize_str(raw.decode()):
            own = bytes(map(self.names.__getitem__, token))
            b = np.frombuffer(own, np.uint8)
            at = [0, *(np.flatnonzero(self.never[b[:-1], b[1:]]) + 1).tolist(), len(own)]
            out += [own[i:j] for i, j in zip(at, at[1:], strict=False)]
        return out

    def _pieces(self, raw: list[bytes]) -> list[bytes]:
        """Each piece on its own: a short plain one by its pre-tokens, anything else fragment by fragment."""
        own = [_GROUPS.findall(x) if len(x) <= 64 and _SIMPLE.fullmatch(x) else self.fragments(x) for x in raw]
        flat = self.parts.filled([y for x in own for y in x])
        ends = np.cumsum([len(x) for x in own]).tolist()
        return [b"".join(flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def _cuts(self, raw: bytes) -> list[int]:
        """Certain cuts that are also ends of pre-tokens whatever follows: before ASCII white space, after none.

        The byte before may not end a white-space character, of which those beyond ASCII have two or three bytes.
        """
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(b[1:] <= 32) + 1
        x, y = b[at - 1], b[at]
        at = at[self.never[x, y] & WHITE[y] & ~WHITE[x]]
        wide = b[at - 1] >= 0x80
        if wide.any():
            two, three = b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
            at = at[~(wide & ((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))))]
        return [0, *at.tolist(), len(raw)]

    def _plain(self, raw: bytes) -> bytes:
        at = self._cuts(raw)
        return b"".join(self.cache.filled([raw[i:j] for i, j in zip(at, at[1:], strict=False)]))

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text.encode())
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()].encode()) if m.start() > at else b"", self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:].encode()) if at < len(text) else b""])

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


_BUILT: dict[int, ByteBPE] = {}


def _built(text: str) -> ByteBPE:
    """One set of tables for each worker process and vocabulary."""
    key = zlib.crc32(text.encode())
    if key not in _BUILT:
        _BUILT[key] = ByteBPE(text)
    return _BUILT[key]


def _vocabulary(df: DataFrame, path: str):
    """The file's text for all workers; a vocabulary is a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, source: str, target: str, kind: pa.DataType, sql: str, make, keep: list[str]) -> DataFrame:
    kept = df.select(*keep, F.col(source).alias("__in"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in slices(parts):
            made = pa.array([fn(x) for x in part.column(len(keep)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], names=[*keep, target])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{target}` {sql}"])
    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``: the whole text's token ids as little-endian unsigned 32-bit integers (binary).

    The ids are those of the tokenizers library for the file, special tokens' strings included; a null
    or empty text has no ids. Row by row, without a shuffle; repeated rows stay repeated. Columns not
    in ``keep`` are dropped, so clashing names do no harm.
    """
    vocab = _vocabulary(docs, path)
    return _mapped(docs, text, ids, pa.binary(), "binary", lambda: _built(vocab.value).encode, list(keep))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of the ids; null ids give the empty text."""
    vocab = _vocabulary(encoded, path)
    return _mapped(encoded, ids, text, pa.string(), "string", lambda: _built(vocab.value).decode, list(keep))
