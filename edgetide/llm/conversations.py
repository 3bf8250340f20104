"""Operator 11: conversation structure repair as a shortest edit path over secondary-sorted streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of leaving a truncated row in.
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 4, 3, 3, 3
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; the first and the last may end.
STATES, ENDS = 4, (0, 3)
#: What a user or assistant row that is put in or given another role must be in each state.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
_KEY = ["has_id", "id", "has_turn", "turn", "role", "digest"]
_PIECES = "has_id boolean, id long, piece int, has_turn boolean, turn long, role string, digest binary, paths array<struct<start:int,audit:string>>, ends array<int>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _inserted(state: int) -> Iterator[tuple[int, str, int]]:
    """State, letters and cost after none, one or two inserts; more would return to one of these."""
    for k in range(3):
        yield state, "I" * k, INSERT * k
        state = NEXT[state]


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state after a row: (state before, cost, letters) of every way there. A row is deleted before anything is
    put in, as DI comes before ID and costs the same."""
    into: list[list[tuple[int, int, str]]] = [[(s, DELETE, "D")] for s in range(STATES)]
    if fault in (BLANK, DUPLICATE):
        return into
    stays = LEFT_TRUNCATED if fault == TRUNCATED else 0
    for s in range(STATES):
        for at, letters, cost in _inserted(s):
            into[NEXT[at]].append((s, cost + REROLE + stays, letters + "R"))
            kept = {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None}.get(initial)
            if kept is not None:
                into[kept].append((s, cost + stays, letters + "K"))
    return into


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in range(4)}


class Path:
    """Cheapest edits so far to each state, the ASCII-least of equal ones, carried from row to row.

    Two prefixes that end after the same row are never one the beginning of the other, so their order, kept as a rank,
    decides before the letters that follow. ``back`` holds for each row and state the state before and the letters.
    """

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.back: list[list[tuple[int, str] | None]] = []

    def row(self, initial: str, fault: int) -> None:
        cost, rank = self.cost, self.rank
        best = []
        for ways in MOVES[initial, fault]:
            found = None
            for s, c, letters in ways:
                if cost[s] is not None and (found is None or (cost[s] + c, rank[s], letters) < found[:3]):
                    found = (cost[s] + c, rank[s], letters, s)
            best.append(found)
        order = sorted((b[1], b[2], t) for t, b in enumerate(best) if b)
        for r, (*_, t) in enumerate(order):
            rank[t] = r
        self.rank = rank
        self.cost = [b[0] if b else None for b in best]
        self.back.append([(b[3], b[2]) if b else None for b in best])

    def traced(self, end: int) -> tuple[int, str]:
        """The state before the held rows, and their letters, on the way to a state after them."""
        out = []
        for step in reversed(self.back):
            end, letters = step[end]
            out.append(letters)
        return end, "".join(reversed(out))

    def finish(self) -> tuple[int, int, str]:
        """Cost, state after the last row and letters after it, of the cheapest whole path."""
        ways = []
        for s in range(STATES):
            if self.cost[s] is not None:
                ways += [(self.cost[s] + c, self.rank[s], letters, s) for at, letters, c in _inserted(s) if at in ENDS]
        cost, _, letters, state = min(ways)
        return cost, state, letters


def _planner(piece_rows: int):
    """The streamed search: one conversation's state at a time, whatever its length; its backpointers leave the worker
    as rows, ``piece_rows`` of them traced back from each of the four states."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        now = path = first = last = prev = None
        count, maps = {}, []

        def spill() -> None:
            traced = [path.traced(t) if path.cost[t] is not None else (0, "") for t in range(STATES)]
            out.append(dict(zip(_KEY, (*now, *first), strict=True)) | {"piece": len(maps), "paths": [{"start": s, "audit": a} for s, a in traced]})
            maps.append([s for s, _ in traced])
            path.back.clear()

        def close() -> None:
            cost, state, letters = path.finish()
            start, audit = path.traced(state)
            ends = [state]
            for back in [[start if t == state else 0 for t in range(STATES)], *reversed(maps)]:
                ends.append(back[ends[-1]])
            paths = [{"start": start, "audit": audit + letters} if t == state else {"start": 0, "audit": ""} for t in range(STATES)]
            span = count["high"] - count["low"] + 1 - count["turns"] if count["turns"] else 0
            out.append(
                dict(zip(_KEY, (*now, *(first or (False, 0, "", b""))), strict=True))
                | {"piece": len(maps), "paths": paths, "ends": ends[-2::-1], "cost": cost, "gaps": min(span, 2**63 - 1)}
                | {k: count[f] for k, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED), ("illegal", "illegal"))}
            )

        def frame() -> pd.DataFrame:
            made = pd.DataFrame({k: [r.get(k) for r in out] for k in [*_KEY[:2], "piece", *_KEY[2:], "paths", "ends"]})
            for k in _REPORT:
                made[k] = pd.array([r.get(k) for r in out], "Int64")
            out.clear()
            return made

        for part in parts:
            cols = [part[k].tolist() for k in [*_KEY, "fault", "again", "gone"]]
            for has, conv, has_turn, turn, role, digest, fault, again, gone in zip(*cols, strict=True):
                if now != (has, conv):
                    if now is not None:
                        close()
                    now, path, first, last, prev, maps = (has, conv), Path(), None, None, None, []
                    count = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, OK, "illegal", "turns", "low", "high"), 0)
                if gone:
                    continue
                key = (has_turn, turn, role, digest)
                if len(path.back) >= piece_rows:
                    spill()
                    first = None
                if fault != BLANK and (again or key == prev):
                    fault = DUPLICATE
                initial = role[:1]
                if last is not None and last + initial not in ("su", "ua", "au"):
                    count["illegal"] += 1
                if has_turn and (prev is None or prev[:2] != key[:2]):
                    count["low"], count["high"], count["turns"] = count["low"] if count["turns"] else turn, turn, count["turns"] + 1
                first, last, prev = first or key, initial, key
                count[fault] += 1
                path.row(initial if initial in ("s", "u", "a") else "", fault)
            if out:
                yield frame()
        if now is not None:
            close()
            yield frame()

    return run


def _applier(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters of a piece stand before its rows; each row takes the letters up to its own."""
    out: list[tuple] = []
    now, letters, at, state, place = None, "", 0, 0, 0

    def put(edit: str, role: str | None, text: str) -> None:
        nonlocal state, place
        if role is None:
            state = NEXT[state]
            role = ROLE[state]
        else:
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        out.append((*now, place, edit, role, text))
        place += 1

    def rest() -> None:
        for _ in letters[at:]:
            put("I", None, "")

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["has_id", "id", "place", "edit", "role", "text"])
        out.clear()
        return made

    for part in parts:
        for has, conv, audit, role, text in zip(*(part[k].tolist() for k in ("has_id", "id", "audit", "role", "text")), strict=True):
            if now != (has, conv):
                if now is not None:
                    rest()
                now, letters, at, state, place = (has, conv), "", 0, 0, 0
            if audit is not None:
                letters, at = letters[at:] + audit, 0
                continue
            while letters[at] == "I":
                put("I", None, "")
                at += 1
            if letters[at] != "D":
                put(letters[at], role if letters[at] == "K" else None, text)
            at += 1
        if out:
            yield frame()
    if now is not None:
        rest()
        if out:
            yield frame()


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with sort keys free of nulls; nulls in role and text are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_id"), F.coalesce("conv_id", F.lit(0)).alias("id"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), gone.alias("gone"),
    )


def _fault(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_WHITE))
    return F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)


def plan_repairs(rows: DataFrame, *, piece_rows: int = 1 << 16) -> DataFrame:
    """The cheapest edits that give ``rows(conv_id, turn, role, text)`` the form ``(s?(ua)+)?`` of role initials, as pieces.

    Faults: blank (nothing but space and TAB..CR), duplicate (role and text in an earlier row), truncated (last character
    before that white space is none of ``.!?``); a row's first one counts. Keep costs 0, Rerole to user or assistant 3,
    Delete 4 (a must for blank and duplicate rows), Insert of an empty user or assistant row 3; a truncated row that stays
    costs 3 more. Of equal costs the ASCII-least string of initials wins.

    Rows are repartitioned by conversation and sorted by turn (nulls first; equal turns by role, then the text's SHA-256);
    ``mapInPandas`` carries the four states of the search over Arrow batches. Texts stay behind: only keys and faults move.
    After every ``piece_rows`` rows of one conversation its backpointers leave the worker as a row of the written table, so
    memory does not grow with a conversation. Earlier equal rows are found by an aggregate of digests, of which only
    those that occur twice are joined back; a conversation of any share of the rows costs its one task a stream.

    Result: one row for each piece; the last of a conversation (``ends`` not null) also has gaps (turns missing between
    the least and greatest), blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or au) and cost.
    Nulls in role and text are one space, a null conv_id is a conversation of its own; an empty role has no initial and
    cannot be kept. A true ``gone`` column keeps a conversation in the result without the row. Other columns are
    ignored; repeated rows are duplicates; texts of any length are one digest; an empty table gives an empty result.
    """
    keyed = _keyed(rows)
    light = keyed.select(*_KEY, _fault(F.col("text")).alias("fault"), "gone")
    seen = light.where("not gone").groupBy("has_id", "id", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = light.join(seen, ["has_id", "id", "role", "digest"], "left").withColumn("again", F.coalesce(F.struct("has_turn", "turn") > F.col("earliest"), F.lit(False)))
    ordered = known.select(*_KEY, "fault", "again", "gone").repartition("has_id", "id").sortWithinPartitions(*_KEY)
    return written(ordered.mapInPandas(_planner(piece_rows), _PIECES), "repairs")


def _audits(plans: DataFrame) -> DataFrame:
    """The letters of each piece, from the state in which the whole path leaves it."""
    ends = plans.where("ends is not null").select("has_id", "id", F.posexplode("ends").alias("piece", "end"))
    return plans.join(ends, ["has_id", "id", "piece"]).withColumn("audit", F.expr("paths[end].audit"))


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: has_id, id, place, edit (K, R or I), role, text, streamed in the order of the plan.

    ``rows`` are those that were planned. A piece's letters sort right before its first row, so one task holds one piece's
    letters at a time; conversations without rows have none here.
    """
    marks = _audits(plans).select(*_KEY, F.lit(0).alias("kind"), "piece", "audit", F.lit(None).cast("string").alias("text"))
    texts = _keyed(rows).where("not gone").select(*_KEY, F.lit(1).alias("kind"), F.lit(0).alias("piece"), F.lit(None).cast("string").alias("audit"), "text")
    both = marks.unionByName(texts).repartition("has_id", "id").sortWithinPartitions(*_KEY, "kind", "piece")
    return both.mapInPandas(_applier, "has_id boolean, id long, place long, edit string, role string, text string")


def repair_report(plans: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    told = plans.where("ends is not null").select("has_id", "id", *_REPORT)
    audit = _audits(plans).groupBy("has_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    return told.join(audit, ["has_id", "id"]).select(F.when(F.col("has_id"), F.col("id")).alias("conv_id"), *_REPORT, "audit", "has_id", "id")


def _digester(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now = digest = None
    for part in parts:
        done = []
        for has, conv, place, role, text in zip(*(part[k].tolist() for k in ("has_id", "id", "place", "role", "text")), strict=True):
            if now != (has, conv):
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (has, conv), hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(done, columns=["has_id", "id", "sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=["has_id", "id", "sha256"])


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """has_id, id, sha256 of a conversation's ``role:text`` lines in order; a conversation without rows is left out.

    ``repaired`` is the frame of ``repaired_rows``, whose tasks give whole conversations one after another and in order,
    so nothing is shuffled again. A digest has to read its lines in turn, hence one task for each conversation.
    """
    return repaired.mapInPandas(_digester, "has_id boolean, id long, sha256 string")
