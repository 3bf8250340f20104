"""Operator 7: language-model scores by a weighted backoff automaton over smoothed n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import groups, slices, written
from .words import mix, word_hashes

END = b""
_BITS = 20
#: Tokens of a shard of the automaton, and of the texts that a task deals to the shards at once.
SHARD = 1_200_000
CHUNK = 2_000_000


def _tokens(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words; the end, which no word equals, is the empty string."""
    return [*(text or "").encode().lower().split(), END]


def _count_words(flush: int):
    """Rows (word, c, n): each word of a stretch of texts with its code and count."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in seen if w]
            codes = np.append(_codes(b" ".join(words).decode("utf-8", "surrogatepass"))[:-1], np.uint64(1)).astype(np.int64)
            words.append(END)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(codes), pa.array([seen[w] for w in words], pa.int64())], names=["word", "c", "n"])

        for b in slices(parts):
            for text in b.column(0).to_pylist():
                seen.update(_tokens(text))
            if len(seen) > flush:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return run


#: Bytes of a word's code, of its place among head or hot words, and of a count.
_CODE, _PLACE, _SUM = 7, 3, 5


def _codes(text: str | None) -> np.ndarray:
    """56-bit codes of the words of ``_tokens``; 1 is the end, 0 no word."""
    return np.append(np.maximum(word_hashes(text) >> np.uint64(8), np.uint64(2)), np.uint64(1))


def _low(x: np.ndarray, wide: int) -> bytes:
    """The low bytes, all first ones, then all second ones and so on: high bytes vary little and compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _full(raw: bytes, at: int, n: int, wide: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T
    return out.reshape(-1).view("<u8")


def _squeezed(raw: bytes) -> bytes:
    """Entropy-coded, which the shuffle's own compression is not."""
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=int(np.frombuffer(blob, "<u8", 1)[0]), codec="zstd", asbytes=True)


def _packed(x: np.ndarray, heads: np.ndarray) -> bytes:
    """Head words by their place, others by their code."""
    at = np.minimum(np.searchsorted(heads, x), len(heads) - 1)
    head = heads[at] == x
    return np.packbits(head).tobytes() + _low(at[head], _PLACE) + _low(x[~head], _CODE)


def _unpacked(raw: bytes, at: int, n: int, heads: np.ndarray) -> tuple[np.ndarray, int]:
    head = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    out, own = np.empty(n, np.uint64), int(head.sum())
    out[head] = heads[_full(raw, at, own, _PLACE).astype(np.int64)]
    at += own * _PLACE
    out[~head] = _full(raw, at, n - own, _CODE)
    return out, at + (n - own) * _CODE


def _new(*cols: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, keys: np.ndarray, held: np.ndarray, heads: np.ndarray) -> bytes:
    """Events sorted by (b, a, c): each code once a run, and the document of each event."""
    used, at = np.unique(doc, return_inverse=True)
    flags = [_new(b), _new(b, a), _new(b, a, c)]
    small = _low(at, 2 if len(used) <= 1 << 16 else 4)
    bits = b"".join(np.packbits(f).tobytes() for f in flags)
    words = b"".join(_packed(x[f], heads) for x, f in zip((b, a, c), flags, strict=True))
    return _squeezed(np.array([len(b), len(used)], "<u4").tobytes() + bits + words + small + keys[used].tobytes() + held[used].tobytes())


def _unpack(blob: bytes, heads: np.ndarray) -> tuple[np.ndarray, ...]:
    raw = _whole(blob)
    n, docs = np.frombuffer(raw, "<u4", 2).tolist()
    at, wide, out = 8, -(-n // 8), []
    flags = [np.unpackbits(np.frombuffer(raw, np.uint8, wide, at + i * wide), count=n).astype(bool) for i in range(3)]
    at += 3 * wide
    for f in flags:
        own, at = _unpacked(raw, at, int(f.sum()), heads)
        out.append(own[np.cumsum(f) - 1])
    wide = 2 if docs <= 1 << 16 else 4
    own = _full(raw, at, n, wide).astype(np.int64)
    at += n * wide
    keys, held = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, bool, docs, at + 8 * docs)
    return out[1], out[0], out[2], keys[own], held[own]


def _chunks(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, c (the word and the two before it, 0 where there is none), document, keys and held of whole texts."""
    own: list = [[], [], []]
    tokens = 0

    def out() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for x in own[0]])
        c, doc = np.concatenate(own[0]), np.repeat(np.arange(len(sizes)), sizes)
        b, a = np.zeros_like(c), np.zeros_like(c)
        b[1:] = np.where(doc[1:] == doc[:-1], c[:-1], 0)
        a[2:] = np.where(doc[2:] == doc[:-2], c[:-2], 0)
        return a, b, c, doc, np.array(own[1], "<i8"), np.array(own[2], bool)

    for part in slices(parts):
        for key, held, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            for x, y in zip(own, (_codes(text), key, held), strict=True):
                x.append(y)
            tokens += len(own[0][-1])
            if tokens >= most:
                yield out()
                own, tokens = [[], [], []], 0
    if tokens:
        yield out()


def _route(b: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (mix(mix(b) + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _parted(a: np.ndarray, b: np.ndarray, c: np.ndarray, hot: tuple, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each event and whether its middle word is hot: such a word is dealt by the word before it too."""
    words, splits, _ = hot
    part, is_hot = np.where(b == 0, c, np.uint64(0)), np.zeros(len(b), bool)
    if len(words):
        at = np.minimum(np.searchsorted(words, b), len(words) - 1)
        is_hot = words[at] == b
        part = np.where(is_hot, mix(a) % splits[at], part)
    return _route(b, part, shards), is_hot


def _pack_pairs(at: np.ndarray, c: np.ndarray, shard: np.ndarray | None, n: np.ndarray, heads: np.ndarray) -> bytes:
    """Bigrams of hot words, each (place of the hot word, next word) once a run, with the shards that ask and counts."""
    first = _new(at, c)
    asks = b"" if shard is None else _low(shard, _PLACE)
    return _squeezed(np.array([len(n), int(first.sum())], "<u4").tobytes() + np.packbits(first).tobytes() + _low(at[first], _PLACE) + _packed(c[first], heads) + asks + _low(n, _SUM))


def _unpack_pairs(blob: bytes, heads: np.ndarray, asks: bool) -> tuple[np.ndarray, ...]:
    raw = _whole(blob)
    n, firsts = np.frombuffer(raw, "<u4", 2).tolist()
    run = np.cumsum(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), 8), count=n)) - 1
    start = 8 + -(-n // 8)
    at = _full(raw, start, firsts, _PLACE)[run].astype(np.int64)
    c, start = _unpacked(raw, start + firsts * _PLACE, firsts, heads)
    shard = _full(raw, start, n, _PLACE).astype(np.int64) if asks else np.zeros(n, np.int64)
    return at, c[run], shard, _full(raw, start + n * _PLACE * asks, n, _SUM).astype(np.int64)


def _hot_pairs(hot, roots, shards: int, most: int):
    """Rows (pair, blob): counts of a stretch's bigrams whose first word is hot, dealt by bigram, with the shards that ask."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, c, doc, _, held in _chunks(parts, most):
            shard, good = _parted(a, b, c, hot.value, shards)
            b, c, shard, n = b[good], c[good], shard[good], ~held[doc[good]]
            own = mix(mix(b) ^ c)
            pair = own % np.uint64(shards)
            # equal rows must only lie together mostly: what is left apart is added up later
            order = np.argsort((pair << np.uint64(40)) | (own >> np.uint64(40)) << np.uint64(16) | shard.astype(np.uint64) & np.uint64(0xFFFF))
            b, c, shard, pair, n = b[order], c[order], shard[order], pair[order], n[order]
            new = _new(b, c, shard)
            sums = np.bincount(np.cumsum(new) - 1, n).astype(np.int64) if len(n) else np.zeros(0, np.int64)
            at, c, shard, pair = np.searchsorted(hot.value[0], b[new]), c[new], shard[new], pair[new]
            edges = [*np.flatnonzero(_new(pair)).tolist(), len(pair)]
            for i, j in zip(edges, edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(pair[i])], pa.int32()), pa.array([_pack_pairs(at[i:j], c[i:j], shard[i:j], sums[i:j], roots.value[0])], pa.binary())], names=["pair", "blob"])

    return run


_PAIRS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("types", pa.int64()), ("near", pa.float64())])
_PAIRS_SQL = "kind int, shard int, blob binary, b long, c long, n long, types long, near double"


def _pair_rows(kind: int, rows: int, **cols) -> pa.RecordBatch:
    given = {"kind": np.full(rows, kind, np.int32), **cols}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _PAIRS], schema=_PAIRS)


def _sum_pairs(hot, roots):
    """Adds up bigrams. Kind 0: the counts that a shard asks for. 2: a hot word's count, following words, and the
    unigrams of those that are head words, as far as they are here. 3: a rarer word that follows a hot one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (heads, uni, _) = hot.value[0], roots.value
        for g in groups(parts, ["pair"]):
            at, c, shard, n = (np.concatenate(x) for x in zip(*(_unpack_pairs(x, heads, True) for x in g.column("blob").to_pylist()), strict=True))
            order = np.lexsort((shard, c, at))
            at, c, shard, n = at[order], c[order], shard[order], n[order]
            first = _new(at, c)
            kind = np.cumsum(first) - 1
            own, ta, tc = np.bincount(kind, n).astype(np.int64), at[first], c[first]
            live = own > 0
            asks = np.flatnonzero(_new(at, c, shard) & live[kind])
            asks = asks[np.argsort(shard[asks], kind="stable")]
            to, k = shard[asks], kind[asks]
            edges = [*np.flatnonzero(_new(to)).tolist(), len(to)]
            for i, j in zip(edges, edges[1:]):
                yield _pair_rows(0, 1, shard=[int(to[i])], blob=[_pack_pairs(ta[k[i:j]], tc[k[i:j]], None, own[k[i:j]], heads)])
            place = np.minimum(np.searchsorted(heads, tc), len(heads) - 1)
            head = heads[place] == tc
            ta, tc, own, place, head = ta[live], tc[live], own[live], place[live], head[live]
            types = np.bincount(ta, minlength=len(words))
            met = np.flatnonzero(types)
            sums = lambda x: np.bincount(ta, x, len(words))[met]
            yield _pair_rows(2, len(met), b=words[met].astype(np.int64), n=sums(own).astype(np.int64), types=types[met], near=sums(np.where(head, 10 ** uni[place], 0)))
            yield _pair_rows(3, int((~head).sum()), b=words[ta[~head]].astype(np.int64), c=tc[~head].astype(np.int64))

    return run


def _events(hot, roots, shards: int, most: int):
    """Rows (shard, blob): the n-grams of the texts, dealt to the shards of the automaton."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, c, doc, keys, held in _chunks(parts, most):
            shard, _ = _parted(a, b, c, hot.value, shards)
            low = np.uint64(0xFFFF)
            near = mix(b) & low
            order = np.argsort((near << np.uint64(32)) | (mix(a) & low) << np.uint64(16) | (mix(c) & low), kind="stable")
            order = order[np.argsort(shard[order], kind="stable")]
            a, b, c, doc, shard = a[order], b[order], c[order], doc[order], shard[order]
            edges = [*np.flatnonzero(_new(shard)).tolist(), len(shard)]
            for i, j in zip(edges, edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[i])], pa.int32()), pa.array([_pack(a[i:j], b[i:j], c[i:j], doc[i:j], keys, held, roots.value[0])], pa.binary())], names=["shard", "blob"])

    return run


_OUT = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("tokens", pa.int64()), ("known", pa.int64()), ("firsts", pa.int64())])
_OUT_SQL = "kind int, doc long, b long, c long, x double, y double, tokens long, known long, firsts long"


def _walk(a, b, c, doc, held, pairs, roots: tuple, hot: tuple, floor: float, discount: float) -> Iterator[tuple]:
    """The automaton of one shard over its own events: all arcs and failures of the histories that end in its words.

    Rows (kind, doc, b, c, x, y, tokens, known, firsts). 0: x is to be added to a document's score and y to its
    base, with the numbers of its tokens, known tokens and first tokens here. 1: x times a document falls to the
    root from history b with the word c (0 if its unigram is already in kind 0). 2: the mass that history b leaves,
    and the unigrams of its head words. 3: a rarer word that history b has. ``pairs`` are the counts of hot words'
    bigrams that occur here; what such a history leaves at the root is summed elsewhere.

    Every token but the end is the middle word of one event, and all events of a middle word that is not hot are
    here: its count is known here, so the base needs no join. The first token's event stands for the end.
    """
    heads, uni, live = roots
    order = np.lexsort((c, a, b))
    a, b, c, doc, held = a[order], b[order], c[order], doc[order], held[order]
    start = _new(b, a, c)
    kind = np.cumsum(start) - 1
    ta, tb, tc = a[start], b[start], c[start]
    three = np.bincount(kind, ~held, len(ta))
    three[tb == 0] = 0
    own = np.where(np.isin(tb, hot[0]), 0, three)
    pb, pc, pn = np.concatenate([tb, pairs[0]]), np.concatenate([tc, pairs[1]]), np.concatenate([own, pairs[2]])
    order = np.lexsort((pc, pb))
    start = _new(pb[order], pc[order])
    pair = np.empty(len(pb), np.int64)
    pair[order] = np.cumsum(start) - 1
    two = np.bincount(pair, pn)
    pb, pc = pb[order][start], pc[order][start]
    start = _new(pb)
    word = np.cumsum(start) - 1
    one, types, names = np.bincount(word, two), np.bincount(word, two > 0), pb[start]
    is_hot = np.zeros(len(names), bool)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], names), len(hot[0]) - 1)
        is_hot = hot[0][at] == names
        one = np.where(is_hot, hot[2][at], one)
    pair = pair[: len(tb)]
    n2, n1 = two[pair], one[word[pair]]
    history = np.cumsum(_new(tb, ta)) - 1
    seen = three > 0
    n_h = np.bincount(history, three)
    below = np.bincount(history, np.where(seen, (n2 - discount) / np.maximum(n1, 1), 0))
    bow = np.log10(np.maximum(discount * np.bincount(history, seen) / np.maximum(n_h, 1), 1e-12) / np.maximum(1 - below, 1e-12))
    bow = np.where((n_h > 0), bow, 0)[history]
    bow[ta == 0] = 0
    log = lambda x: np.log10(np.maximum(x, 1e-300))
    root = n2 == 0
    score = np.where(seen & (ta > 0), log(three - discount) - log(n_h)[history], bow + np.where(root, 0, log(n2 - discount) - log(n1)))
    at = np.minimum(np.searchsorted(heads, tc), len(heads) - 1)
    head = heads[at] == tc
    score += np.where(root & head, uni[at], 0)
    end = int(np.searchsorted(heads, 1))
    base = np.where(tb == 0, uni[end], np.log10(n1 + 1.0) - floor)
    known = np.where(tb == 0, live[end], n1 > 0)
    docs, own = np.unique(doc, return_inverse=True)
    zero = lambda n: np.zeros(n, np.int64)
    n = len(docs)
    count = lambda flags: np.bincount(own, flags[kind], n).astype(np.int64)
    yield 0, docs, zero(n), zero(n), np.bincount(own, score[kind], n), np.bincount(own, base[kind], n), np.bincount(own, minlength=n), count(known), count(tb == 0)

    fell = np.flatnonzero(root[kind])
    to, fb, fc = own[fell], b[fell], np.where(head[kind[fell]], 0, c[fell])
    order = np.lexsort((fc, fb, to))
    to, fb, fc = to[order], fb[order], fc[order]
    start = np.flatnonzero(_new(to, fb, fc))
    n = len(start)
    yield 1, docs[to[start]], fb[start].astype(np.int64), fc[start].astype(np.int64), np.diff(np.append(start, len(to))).astype(float), np.zeros(n), zero(n), zero(n), zero(n)
    asked = np.isin(names, np.unique(fb)) & (one > 0) & ~is_hot
    at = np.minimum(np.searchsorted(heads, pc), len(heads) - 1)
    head, there = heads[at] == pc, (two > 0) & asked[word]
    sums = np.bincount(word, np.where(head & there, 10 ** uni[at], 0))
    n = int(asked.sum())
    yield 2, zero(n), names[asked].astype(np.int64), zero(n), discount * types[asked] / one[asked], sums[asked], zero(n), zero(n), zero(n)
    rare = there & ~head
    n = int(rare.sum())
    yield 3, zero(n), pb[rare].astype(np.int64), pc[rare].astype(np.int64), np.zeros(n), np.zeros(n), zero(n), zero(n), zero(n)


def _walks(roots, hot, floor: float, discount: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, ["shard"]):
            blobs = [_unpack(x, roots.value[0]) for x in g.column("blob").to_pylist() if x is not None]
            if not blobs:
                continue
            given = [_unpack_pairs(x, roots.value[0], False) for x in g.column("pairs").to_pylist() if x is not None]
            at, c, _, n = (np.concatenate(x) for x in zip(*given, strict=True)) if given else [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)]
            pairs = hot.value[0][at], c, n
            for kind, *cols in _walk(*(np.concatenate(x) for x in zip(*blobs, strict=True)), pairs, roots.value, hot.value, floor, discount):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], schema=_OUT)

    return run


class BackoffAutomaton:
    """States are histories that have continuations; an arc is a kept n-gram; a failure arc drops the oldest word.

    p(w | h) = (c(hw) - discount) / c(h) for kept n-grams, else backoff(h) * p(w | shorter h), down to the
    add-one unigram; backoff(h) makes the probabilities of every history add up to one. State 0 is the root.
    """

    def __init__(self, counts: np.ndarray, total: int, vocabulary: int, two: dict[int, int], three: dict[int, int], discount: float = 0.5):
        mask = (1 << _BITS) - 1
        floor = total + vocabulary + 1
        self.uni = np.log10((counts + 1) / floor).tolist()
        by_word: dict[int, list[int]] = {}
        for key in two:
            by_word.setdefault(key >> _BITS, []).append(key)
        by_pair: dict[int, list[int]] = {}
        for key in three:
            if key >> _BITS in two and (key & ((1 << 2 * _BITS) - 1)) in two:
                by_pair.setdefault(key >> _BITS, []).append(key)
        states = {h: i for i, h in enumerate(sorted(by_word), 1)}
        pairs = {h: i for i, h in enumerate(sorted(by_pair), len(states) + 1)}
        self.bow, self.fail = [0.0] * (len(states) + len(pairs) + 1), [0] * (len(states) + len(pairs) + 1)
        self.start = [states.get(w, 0) for w in range(len(counts))]
        self.arcs: dict[int, tuple[int, float]] = {}
        prob: dict[int, float] = {}
        for h, i in states.items():
            used, below = 0.0, 0.0
            for key in by_word[h]:
                w = key & mask
                p = prob[key] = (two[key] - discount) / counts[h]
                used, below = used + p, below + (counts[w] + 1) / floor
                self.arcs[i << _BITS | w] = (pairs.get(key, self.start[w]), log10(p))
            self.bow[i] = log10(max(1 - used, 1e-12) / max(1 - below, 1e-12))
        for h, i in pairs.items():
            self.fail[i] = states.get(h & mask, 0)
            used, below = 0.0, 0.0
            for key in by_pair[h]:
                lower = key & ((1 << 2 * _BITS) - 1)
                p = (three[key] - discount) / two[h]
                used, below = used + p, below + prob[lower]
                self.arcs[i << _BITS | key & mask] = (pairs.get(lower, self.start[key & mask]), log10(p))
            self.bow[i] = log10(max(1 - used, 1e-12) / max(1 - below, 1e-12))
        self.to_root = [0.0] * len(self.bow)
        for i in range(1, len(self.bow)):
            self.to_root[i] = self.bow[i] + (self.bow[self.fail[i]] if self.fail[i] else 0.0)

    def traverse(self, ids: list[int]) -> float:
        """One pass from left to right. A word without an id fails to the root, and its unigram is added elsewhere."""
        state, total = 0, 0.0
        arcs, bow, fail, uni, start, to_root = self.arcs, self.bow, self.fail, self.uni, self.start, self.to_root
        for w in ids:
            if w < 0:
                total += to_root[state]
                state = 0
                continue
            while state:
                arc = arcs.get(state << _BITS | w)
                if arc is not None:
                    state = arc[0]
                    total += arc[1]
                    break
                total += bow[state]
                state = fail[state]
            else:
                total += uni[w]
                state = start[w]
        return total


def score_documents(docs: DataFrame, *, held_out: int = 2, folds: int = 7, head_share: float = 1e-6, discount: float = 0.5, shard_tokens: int = SHARD, chunk_tokens: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs(doc_id, text)``.

    Training texts are those with crc32(doc_id as text) mod folds <> held_out (a null doc_id counts as the
    empty text). Every word, bigram and trigram of them is counted exactly and is in the automaton, however
    rare. The automaton lies in shards by the last word of a history, so a shard has all arcs of its histories
    and their failures; only the root is shared. What each text asks of a shard goes there, is counted and
    scored at once, and sums come back. Shards hold about ``shard_tokens`` tokens: their number grows with the
    corpus. A word with more than a quarter of that is dealt by the word before it too, and of its bigram counts
    each shard gets those that occur there. Words in n-grams are 56-bit codes: among d different words the
    chance that any two share a code is about d * d / 2**57.

    Words with at least ``head_share`` of all tokens go to every task with their unigrams; others are looked
    up by joins with the full table of counts, to the same result. A null or empty text is its end alone.
    Repeated rows are scored, and counted, each. Other columns are not read, so clashing names do no harm; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
    docs = docs.select("doc_id", fold.alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("key"))
    train = docs.where(~F.col("held_out")).select("text")
    table = written(train.mapInArrow(_count_words(400_000), "word binary, c long, n long").groupBy("word", "c").agg(F.sum("n").alias("n")), "words").where("n > 0")
    total, vocabulary = (x or 0 for x in table.agg(F.sum("n"), F.count("*")).first())
    least = max(1, ceil(head_share * total))
    top = [(r["word"], r["n"]) for r in table.where((F.col("n") >= least) & (F.length("word") > 0)).orderBy(F.desc("n"), "word").toLocalIterator()]
    end = table.where(F.length("word") == 0).first()
    words = [END, *(bytes(w) for w, _ in top)]
    counts = np.array([end["n"] if end else 0, *(n for _, n in top)], np.int64)
    floor = log10(total + vocabulary + 1)
    uni = np.log10(counts + 1) - floor
    codes = _codes(b" ".join(words[1:]).decode("utf-8", "surrogatepass"))
    codes = np.concatenate([codes[-1:], codes[:-1]])
    order = np.argsort(codes, kind="stable")
    first = order[_new(codes[order])]
    roots = spark.sparkContext.broadcast((codes[first], uni[first], counts[first] > 0))
    hot = np.flatnonzero((counts * 4 > shard_tokens) & (codes != 1))
    hot = hot[np.argsort(codes[hot])]
    splits = (-(-counts[hot] * 4 // shard_tokens)).astype(np.uint64)
    hot_words = spark.sparkContext.broadcast((codes[hot], splits, counts[hot]))
    shards = max(1, -(-total * folds // max(1, folds - 1) // shard_tokens))

    # the join on the code takes the same shuffle as this sum
    coded = lambda rows: rows.groupBy("c").agg(F.sum("n").alias("n"))
    log_n = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(floor)
    asked = docs.select("key", "held_out", "text")
    events = asked.mapInArrow(_events(hot_words, roots, shards, chunk_tokens), "shard int, blob binary").selectExpr("shard", "blob", "cast(null as binary) pairs")
    pairs = None
    if len(hot):
        pairs = asked.mapInArrow(_hot_pairs(hot_words, roots, shards, chunk_tokens), "pair int, blob binary").repartition(shards, "pair").sortWithinPartitions("pair")
        pairs = written(pairs.mapInArrow(_sum_pairs(hot_words, roots), _PAIRS_SQL), "pairs")
        events = events.unionByName(pairs.where("kind = 0").selectExpr("shard", "cast(null as binary) blob", "blob pairs"))
    out = written(events.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_walks(roots, hot_words, floor, discount), _OUT_SQL), "walks")
    rare = coded(table.where((F.col("n") < least) & (F.length("word") > 0)))
    # a history that is not hot lies in one shard, so kinds 2 and 3 have it once
    follows = out.where("kind = 3").select("b", "c")
    left = out.where("kind = 2").select("b", F.col("x").alias("mass"), F.col("y").alias("near"))
    if pairs is not None:
        follows = follows.union(pairs.where("kind = 3").select("b", "c"))
        used = pairs.where("kind = 2").groupBy("b").agg(*(F.sum(x).alias(x) for x in ("n", "types", "near")))
        left = left.union(used.select("b", F.lit(discount) * F.col("types") / F.col("n"), "near"))
    far = follows.join(rare, "c").groupBy("b").agg(F.sum(F.pow(F.lit(10.0), log_n)).alias("far"))
    left = left.join(far, "b", "left").select("b", "mass", (F.col("near") + F.coalesce("far", F.lit(0.0))).alias("near"))
    bows = left.select("b", F.log10(F.greatest("mass", F.lit(1e-12)) / F.greatest(1 - F.col("near"), F.lit(1e-12))).alias("bow"))
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    own = out.where("kind = 0").select("doc", "x", "y", "tokens", "known", "firsts")
    fell = out.where("kind = 1 and b <> 0").join(bows, "b").select("doc", (F.col("x") * F.col("bow")).alias("x"), F.lit(0.0).alias("y"), *none("tokens", "known", "firsts"))
    met = out.where("kind = 1 and c <> 0").join(rare, "c", "left").select("doc", (F.col("x") * log_n).alias("x"), F.lit(0.0).alias("y"), *none("tokens", "known", "firsts"))
    sums = own.union(fell).union(met).groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("x", "y", "tokens", "known", "firsts")))
    per = lambda c: F.expr(f"{c} div firsts")
    return docs.select("doc_id", "held_out", "key").join(sums, F.col("key") == F.col("doc")).select(
        "doc_id", "held_out", per("tokens").alias("n_tokens"), per("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("y") / F.col("firsts")).alias("base_score"), (F.col("x") / F.col("firsts")).alias("score"),
    )
