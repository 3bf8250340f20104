"""Conversation repair, SimHash classes and whitening against brute force and odd inputs."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from edgetide.llm import queries as Q
from edgetide.llm.conversations import conversation_digests, plan_repairs, repair_report, repaired_rows
from edgetide.llm.simhash import anchors, fingerprint, nearest_anchor, simhash_duplicates
from edgetide.llm.whitening import fit_whitening, quantized, whiten_embeddings

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
VECS = "vec_id long, embedding array<float>, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# --- conversations ---------------------------------------------------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def repair_one(rows):
    """Report and repaired rows of one conversation by a search over (cost, string) on the roles alone."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    count, faults, seen = defaultdict(int), [], set()
    for _, _, role, text in rows:
        shown = WORD.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "ok"
        seen.add((role, text))
        count[fault] += 1
        faults.append(fault)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, kept = heapq.heappop(heap)
        shape = "".join(r[:1] for r, _ in kept)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            break
        tail = (at, shape[-1:], len(audit) - len(audit.rstrip("I")) if audit.endswith("III") else 0)
        if tail in done:
            continue
        done.add(tail)
        for role in ("user", "assistant"):
            if can(shape + role[0]) and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*kept, (role, ""))))
        if at == len(rows):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, kept))
        if faults[at] in ("ok", "truncated"):
            more = 3 * (faults[at] == "truncated")
            for letter, role in (("K", rows[at][2]), ("R", "user"), ("R", "assistant")):
                if role[:1] and can(shape + role[0]):
                    heapq.heappush(heap, (cost + more + 3 * (letter == "R"), audit + letter, at + 1, (*kept, (role, rows[at][3]))))
    said = "\n".join(f"{r}:{t}" for r, t in kept)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), list(kept)


def can(shape):
    """Whether initials can be continued to a legal form."""
    return any(re.fullmatch("(s?(ua)+)?", shape + end) for end in ("", "a", "ua"))


def brute_repairs(rows, damaged=True):
    by = {r[0]: [] for r in rows}
    for r in damage(rows) if damaged else rows:
        by[r[0]].append(r)
    return {c: repair_one(rs)[0] for c, rs in by.items()}


def op11(df, **kw):
    rows = Q.damaged(df)
    plans = plan_repairs(rows, **kw)
    return rows, plans


def query11(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:] for r in Q.op11_conversation_repair(spark, str(tmp_path)).collect()}


def noisy(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Ok!\n", "so.. ", "deep end", "\x0b", "é.", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]
    rows = []
    for c in range(convs):
        n = rng.randint(1, most)
        for t in range(n):
            turn = rng.choice([t, t, t, t * 3, None, -t])
            good = rng.random() < 0.6
            rows.append((rng.choice([c, c, c, None]) if c % 9 == 8 else c, turn, ["user", "assistant"][t % 2] if good else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.randint(0, 99)}."))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


def test_repairs_equal_a_search(spark, tmp_path):
    rows = noisy(4, 220, 8)
    got = query11(spark, spark.createDataFrame(rows, CONV).repartition(5), tmp_path)
    assert got == brute_repairs(rows)
    assert None in got


@pytest.mark.parametrize("piece_rows", [1, 3])
def test_pieces_change_nothing(spark, piece_rows):
    rows = noisy(9, 60, 14) + [(1000, t, ["user", "assistant"][(t // 7) % 2], f"t{t % 50}.") for t in range(400)]
    df, plans = op11(spark.createDataFrame(rows, CONV).repartition(3), piece_rows=piece_rows)
    got = {(r.has_id, r.id): tuple(r)[1:8] for r in repair_report(plans).collect()}
    whole = {(r.has_id, r.id): tuple(r)[1:8] for r in repair_report(op11(spark.createDataFrame(rows, CONV))[1]).collect()}
    assert got == whole and plans.count() > len(whole)
    digests = {(r.has_id, r.id): r.sha256 for r in conversation_digests(repaired_rows(df, plans)).collect()}
    want = {(c is not None, c or 0): v for c, v in brute_repairs([r for r in rows if r[0] != 1000]).items()}
    assert {k: (*got[k], digests.get(k, hashlib.sha256(b"").hexdigest())) for k in want} == want


def test_repaired_rows_are_legal(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "cut"), (1, 3, "user", "More?"), (2, 5, "assistant", "Lone."), (3, 0, "system", "Be kind.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV + ", digest string")
    plans = plan_repairs(df)
    got = defaultdict(list)
    for r in repaired_rows(df, plans).orderBy("id", "place").collect():
        got[r.id].append((r.edit, r.role, r.text))
    assert got[1] == [("K", "user", "Hi."), ("K", "assistant", "cut"), ("K", "user", "More?"), ("I", "assistant", "")]
    assert got[2] == [("I", "user", ""), ("K", "assistant", "Lone.")]
    assert 3 not in got
    assert {r.conv_id: (r.cost, r.audit) for r in repair_report(plans).collect()} == {1: (10, "KDKKI"), 2: (3, "IK"), 3: (4, "D")}


def test_repairs_of_nothing_and_of_long_texts(spark, tmp_path):
    empty = spark.createDataFrame([], CONV)
    assert query11(spark, empty, tmp_path) == {}
    long = "word " * 400_000
    rows = [(5, t, ["user", "assistant"][t % 2], f"{t} {long}.") for t in range(12)] + [(6, None, None, None)]
    assert query11(spark, spark.createDataFrame(rows, CONV), tmp_path) == brute_repairs(rows)


def test_repairs_equal_sql(spark, tables):
    got = sorted(map(tuple, Q.op11_conversation_repair(spark, tables).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet'")
    assert got == sorted(con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({Q.SQL['op11_conversation_repair']})").fetchall())


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """doc_id to the least doc_id reachable over prints of at most two differing bits."""
    names = sorted(set(prints.values()))
    label = {p: p for p in names}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for d, p in prints.items():
        least[root(p)] = min(least.get(root(p), d), d)
    return {d: least[root(p)] for d, p in prints.items()}


def test_anchors_cover_and_hold_every_near_word():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, 2000, dtype=np.uint64)
    home = nearest_anchor(words)
    assert (np.bitwise_count(home ^ words) <= 1).all() and (nearest_anchor(home) == home).all()
    code = nearest_anchor(np.arange(1 << 16, dtype=np.uint64) * np.uint64(40503) & np.uint64(0x7FFFFFFF))
    apart = np.bitwise_count(code[:300, None] ^ code[None, :300])
    assert apart[apart > 0].min() >= 3
    made = anchors(words, 1)
    for w, row in zip(words[:50].tolist(), made[:50].tolist(), strict=True):
        assert {nearest_anchor(np.array([w ^ 1 << b], np.uint64))[0].item() for b in range(32)} <= set(row)
        assert len(set(row)) <= 17 and all((w ^ x).bit_count() <= 2 for x in row)


def test_fingerprints_of_odd_texts(monkeypatch):
    import edgetide.llm.simhash as module

    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "A b\x0bc\x0cd\re", "日本 語\x1c x ÀB", "a " * 9, "x" * 5000]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "q", "."]) for _ in range(rng.randint(3, 300))) for _ in range(40)]
    assert [fingerprint(None if t is None else t.encode()) for t in texts] == [brute_print(t) for t in texts]
    monkeypatch.setattr(module, "_PIECE", 16)
    monkeypatch.setattr(module, "_FLUSH", 8)
    assert [fingerprint(None if t is None else t.encode()) for t in texts] == [brute_print(t) for t in texts]


def test_simhash_query_against_brute_force(spark, tables):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    want = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op12_simhash_covering(spark, tables).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("block", [4096, 40])
def test_links_of_close_fingerprints(spark, monkeypatch, block):
    """A crowd around few centres, most of it at the same anchors, in one block and in many."""
    import edgetide.llm.simhash as module

    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for d in range(1500):
        p = rng.choice(centres[:3] if d % 3 else centres)
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.choice([rng.randrange(64), 63, 31, 0, 40])
        prints[d] = p
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(d, signed(p)) for d, p in prints.items()] + [(None, signed(centres[0]))], "doc_id long, print long")
    monkeypatch.setattr(module, "fingerprints", lambda docs, size: table)
    got = {r.doc_id: r.component_id for r in simhash_duplicates(table, block=block).collect()}
    assert got.pop(None) is None
    assert got == classes(prints)


def test_simhash_edges(spark):
    assert simhash_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "p"), (2, "", "p"), (7, " \t ", "p"), (3, "a b c d", "p"), (3, "a b c d", "p"), (4, "A B c D", "q"), (None, "a b c d", "p"), (5, "w " * 600_000, "p")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_duplicates(spark.createDataFrame(rows, DOCS + ", print string")).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (7, 1), (3, 3), (3, 3), (4, 3), (None, None), (5, 5)], key=str)
    with pytest.raises(ValueError, match="three"):
        simhash_duplicates(spark.createDataFrame([], DOCS), apart=4)


# --- whitening -------------------------------------------------------------------------------------------------------


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def brute_whitening(rows):
    taken = [(i, whole(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in taken})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    apart = np.array([[n * x[k] - sums[k] for k in range(d)] for x in fit], object)
    v = (apart.T @ apart).astype(float) / float(n) ** 3
    e, p = np.linalg.eigh(v)
    order = [k for k in np.argsort(-e) if e[k] > 1e-12 * e[-1]][:16]
    out = []
    for i, x in taken:
        centred = np.array([n * a - s for a, s in zip(x, sums, strict=True)], object)
        out.append((i, n, int((centred * centred).sum()), centred.astype(float) / n @ p[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)))
    return out


def compared(got, want):
    """Rows by id and, as ids may repeat, by the deviation; a component's sign is its own."""
    found = defaultdict(list)
    for r in got:
        found[r.vec_id, r.deviation].append((r.component, r.n, r.whitened, r.explained, r.identity_error))
    k = len(want[0][4])
    signs = np.zeros(k)
    for i, n, deviation, y, share in want:
        rows = sorted(found[i, deviation])[:: max(1, len(found[i, deviation]) // k)][:k]
        assert [r[0] for r in rows] == list(range(1, k + 1)) and {r[1] for r in rows} == {n}
        assert np.allclose([r[3] for r in rows], share, rtol=1e-6) and max(r[4] for r in rows) <= 1e-4
        mine = np.array([r[2] for r in rows])
        signs = np.where(signs == 0, np.sign(mine * y) * (np.abs(y) > 1e-6), signs)
        assert np.allclose(mine * np.where(signs == 0, 1, signs), y, atol=1e-6)
    assert len(got) == k * len(want)


def test_whitening_query_against_brute_force(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    compared(Q.op13_bit_sliced_whitening(spark, tables).collect(), brute_whitening(rows))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * [1, 3, 0.2, 40, 0.01]).astype(np.float32).tolist()) for i in range(200)]
    rows += [(3, rows[9][1]), *[(900 + k, rows[0][1]) for k in range(70)], rows[4], (None, rows[5][1])]
    bad = [(300, None), (301, [None] * 5), (302, [math.nan] * 5), (303, [math.inf] + [0.0] * 4), (304, []), (305, [1.0, 2.0]), (306, [3e38] * 5)]
    return rows, bad


def test_whitening_of_odd_vectors(spark, odd, tmp_path):
    rows, bad = odd
    df = spark.createDataFrame([(i, v, 0) for i, v in [*bad, *rows]], VECS).repartition(7)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    compared(Q.op13_bit_sliced_whitening(spark, str(tmp_path)).collect(), brute_whitening(rows))


def test_exact_sums_and_products(spark, odd):
    """Counts of bits weighted by their places give the integers themselves, wide ranges and signs included."""
    rng = np.random.default_rng(2)
    for scale in (1, 1 << 40):
        rows = [(i, (rng.standard_normal(3) * scale).astype(np.float32).tolist(), 0) for i in range(150)]
        fit = quantized(spark.createDataFrame(rows, VECS), "embedding", 64, 1_000_000).select("x").distinct()
        x = [tuple(r.x) for r in fit.collect()]
        m = fit_whitening(fit)
        assert m.n == len(x) and m.low == [min(c) for c in zip(*x)] and m.sums == [sum(a - lo for a in c) for c, lo in zip(zip(*x), m.low)]
        y = np.array([[a - lo for a, lo in zip(r, m.low)] for r in x], object)
        exact = m.n * (y.T @ y) - np.outer(*[np.array(m.sums, object)] * 2)
        v = np.array([[c / (m.n * m.n) for c in r] for r in exact.tolist()])
        assert np.allclose(v @ m.vectors, m.vectors * m.values, rtol=1e-9, atol=1e-9 * m.trace)


def test_whitening_without_rows_or_variance(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None, 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])):
        spark.createDataFrame(rows, VECS).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert Q.op13_bit_sliced_whitening(spark, f"{tmp_path}/{k}").count() == 0
    far = [(i, [float(1 << 49) * i, 1.0 * (i % 3)], 0) for i in range(40)]
    rows, m = whiten_embeddings(spark.createDataFrame(far, "vec_id long, embedding array<double>, x int"))
    assert all(r.deviation is None for r in rows.collect() if r.vec_id == 0) and m.n == 40
