"""The same frames as common table expressions, for the comparison engine."""

from __future__ import annotations

from .frames import CUTOFF, SEED, WIDTH


def draw(a: str, b: str | int, seed: int) -> str:
    pmod = lambda x: f"((({x}) % 2147483648 + 2147483648) % 2147483648)"
    high = f"CAST(floor({a} / 2147483648) AS BIGINT)"
    return f"((({pmod(a)} * 1103515245 + {pmod(high)} * 69069 + {pmod(b)} * 12345 + {seed * 2654435}) % 2147483648 * 48271) % 2147483647)"


def recency(delta: str) -> str:
    return f"(1.0::DOUBLE / (1 + ln(1 + greatest({delta}, 0) / 86400.0::DOUBLE)))"


def log1p(x: str) -> str:
    return f"ln(1.0::DOUBLE + {x})"


def slots(name: str, seed: int) -> str:
    return f"{name} AS (SELECT seq AS qid, src, time, dst AS positive, CAST({draw('seq', 777, seed)} % {WIDTH} AS INTEGER) AS label_col, CAST(r.range AS INTEGER) AS col FROM tgt, range({WIDTH}) r)"


def cells(slot: str, a: str, b: str) -> str:
    return f"CASE WHEN {slot}.col = {slot}.label_col THEN {slot}.positive WHEN {a} = {slot}.positive THEN {b} ELSE {a} END AS cand, {slot}.col = {slot}.label_col AS is_pos"


_PARTS = {
    "edges": "edges AS (SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id AS seq FROM events)",
    "buys": "buys AS (SELECT o_custkey AS src, l_partkey AS dst, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS time, l_orderkey * 8 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "hist": f"hist AS (SELECT * FROM edges WHERE time < {CUTOFF})",
    "tgt": f"tgt AS (SELECT * FROM edges WHERE time >= {CUTOFF})",
    "pool": "pool AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS idx FROM (SELECT DISTINCT dst FROM hist)), npool AS (SELECT count(*) AS n FROM pool)",
    "slots": slots("slots", SEED),
    "cands": f"cands AS MATERIALIZED (SELECT s.qid, s.src, s.time, s.col, {cells('s', 'a.dst', 'b.dst')} FROM (SELECT *, {draw('qid', 'col', SEED)} % n AS idx FROM slots, npool) s JOIN pool a ON a.idx = s.idx JOIN pool b ON b.idx = (s.idx + 1) % s.n)",
    "stats": "ss AS (SELECT src, count(*) AS n, max(time) AS last FROM hist GROUP BY src), ds AS (SELECT dst, count(*) AS n, max(time) AS last FROM hist GROUP BY dst), ps AS (SELECT src, dst, count(*) AS n, min(time) AS first, max(time) AS last FROM hist GROUP BY src, dst)",
    "feat": "feat AS MATERIALIZED (SELECT c.*, "
    + ", ".join(f"{log1p(f'coalesce({t}.n, 0)')} AS {k}_log_count, CASE WHEN {t}.n IS NULL THEN 0 ELSE {recency(f'c.time - {t}.last')} END AS {k}_recency, CAST({t}.n IS NOT NULL AS INTEGER) AS {k}_seen" for k, t in (("pair", "ps"), ("src", "ss"), ("dst", "ds")))
    + ", coalesce(ps.n, 0)::DOUBLE / greatest(coalesce(ss.n, 0), 1) AS pair_share_src, coalesce(ps.n, 0)::DOUBLE / greatest(coalesce(ds.n, 0), 1) AS pair_share_dst"
    " FROM cands c LEFT JOIN ps ON ps.src = c.src AND ps.dst = c.cand LEFT JOIN ss ON ss.src = c.src LEFT JOIN ds ON ds.dst = c.cand)",
    "scored": "scored AS MATERIALIZED (SELECT qid, src, time, col, cand, is_pos, pair_seen AS seen, round(3 * pair_seen + pair_recency + pair_log_count, 9) AS score, round(dst_log_count, 9) AS a, round(pair_share_src, 9) AS b, round(dst_recency, 9) AS c FROM feat)",
    "occ": "occ AS MATERIALIZED (SELECT qid, src, time, cand, min(col) AS col FROM cands GROUP BY qid, src, time, cand)",
    "ranked": "ranked AS (SELECT qid, count(*) FILTER (WHERE score > ps OR (score = ps AND col < pc)) + 1.0::DOUBLE AS rank FROM (SELECT *, max(CASE WHEN is_pos THEN score END) OVER q AS ps, max(CASE WHEN is_pos THEN col END) OVER q AS pc FROM scored WINDOW q AS (PARTITION BY qid)) GROUP BY qid)",
}
_NEEDS = {"hist": ["edges"], "tgt": ["edges"], "pool": ["hist"], "slots": ["tgt"], "cands": ["pool", "slots"], "stats": ["hist"], "feat": ["cands", "stats"], "scored": ["feat"], "occ": ["cands"], "ranked": ["scored"]}


def query(body: str, *needs: str, ctes: str = "", doubles: str = "") -> str:
    """A full statement: the parts it needs, its own expressions, and doubles rounded to six digits."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    parts = [_PARTS[n] for n in order] + ([ctes] if ctes else [])
    fixed = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in doubles.split())
    top = f"SELECT * REPLACE ({fixed}) FROM result" if fixed else "SELECT * FROM result"
    return f"WITH {', '.join([*parts, f'result AS ({body})'])} {top}"


def z(x: str, q: str = "q") -> str:
    return f"(({x} - avg({x}) OVER {q}) / (stddev_pop({x}) OVER {q} + 1e-6))"
