"""Repair of conversation structure by the cheapest edits, found with a bidirectional Dijkstra search.

A conversation's rows are taken by turn (nulls first; ties by role and text). Its repair gives every row an edit and may insert rows, so that the initials
of the roles read `(s?(ua)+)?`: Keep (K, cost 0), Rerole to user or assistant (R, 3), Delete (D, 4) and Insert a user or assistant row
with empty text (I, 3). Blank and duplicate rows have to be deleted; a truncated row that stays costs 3 more.

The edit lattice has a node per number of rows read and state of the automaton of that pattern. One heap searches from the start, one from the ends,
each settling the nearer node first. They stop when the two nearest open nodes together cost more than the best meeting, so all crossings of equal
cost are finished. Edges on cheapest ways through a crossing are marked, and the audit (the edits' initials in order) takes the ASCII-least marked
edge at every node. Which node an initial leads to is fixed, so that is the least concatenation, and an audit names one repair only.

The work is two passes. The first one carries a code and a digest per row through a shuffle by conversation and gives a report with the audit. The second one
streams the rows of a conversation along its audit, so no task ever holds a conversation's texts: besides one batch of rows, a task holds the codes,
digests and lattice costs (some 250 bytes a row) of the conversation that it is at. A conversation is one ordered repair, so one task reads it.

Edge cases: a null role or text counts as one space, so such a text is blank and such a role has to be reroled or deleted, as has any role that does not start
with s, u or a (an empty one too). A null id is a conversation of its own. Null turns come first and are left out of `gaps`. Rows that are equal in all
columns are duplicates of each other. A conversation without rows has zeros, an empty audit and no repaired rows. No conversations: no rows. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsmood.llm.common import stage

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: Faults of a row, the first that applies; with the class of the role's initial (place in INITIALS) they are its code.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
ROLES = {2: "user", 3: "assistant"}
_WHITE = r"\x20\x09-\x0D"

#: States: 0 nothing read, 1 after s, 2 after u, 3 after a. By class of initial where Keep leads, and where Rerole and Insert lead.
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_OTHER = (2, 2, 3, 2)
_ENDS = (0, 3)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _forward(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """(initial, next node, cost) of the edits at a node, 4 x rows read + state, in ASCII order."""
    i, q = divmod(node, 4)
    out = [("I", 4 * i + _OTHER[q], INSERT_COST)]
    if i < len(codes):
        fault, kind = divmod(codes[i], 4)
        out.insert(0, ("D", node + 4, DELETE_COST))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if _KEEP[q][kind] is not None:
                out.append(("K", 4 * (i + 1) + _KEEP[q][kind], KEEP_COST + more))
            out.append(("R", 4 * (i + 1) + _OTHER[q], REROLE_COST + more))
    return out


def _backward(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """The same edits, from the node that they lead to: (initial, node before, cost)."""
    i, q = divmod(node, 4)
    before = [4 * i + p for p in range(4) if _OTHER[p] == q]
    if i:
        before += [4 * (i - 1) + p for p in range(4)]
    return [(edit, p, cost) for p in before for edit, after, cost in _forward(codes, p) if after == node]


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost of a repair and the ASCII-least audit of that cost."""
    n = len(codes)
    never = 1 << 60
    costs = [[never] * (4 * n + 4) for _ in range(2)]
    settled = [bytearray(4 * n + 4) for _ in range(2)]
    ends = [4 * n + q for q in _ENDS]
    heaps: list[list[tuple[int, int]]] = [[(0, 0)], [(0, e) for e in ends]]
    edges = (_forward, _backward)
    costs[0][0] = 0
    for e in ends:
        costs[1][e] = 0
    best = 0 if n == 0 else never
    while all(heaps) and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heappop(heaps[side])
        if settled[side][node]:
            continue
        settled[side][node] = 1
        best = min(best, cost + costs[1 - side][node])
        for _, other, step in edges[side](codes, node):
            if cost + step < costs[side][other]:
                costs[side][other] = cost + step
                heappush(heaps[side], (cost + step, other))
            best = min(best, cost + step + costs[1 - side][other])

    # Settled from the start and on a cheapest way: crossings first, then back along edges that kept the cost.
    start, rest = costs
    marked = bytearray(4 * n + 4)
    open_nodes = [e for e in ends if settled[0][e] and start[e] == best]
    for v in range(4 * n + 4):
        if settled[1][v]:
            if settled[0][v] and start[v] + rest[v] == best:
                open_nodes.append(v)
            open_nodes += [u for _, u, step in _backward(codes, v) if settled[0][u] and start[u] + step + rest[v] == best]
    while open_nodes:
        v = open_nodes.pop()
        if not marked[v]:
            marked[v] = 1
            open_nodes += [u for _, u, step in _backward(codes, v) if settled[0][u] and start[u] + step == start[v]]
    audit, node, cost = [], 0, 0
    while not (node in ends and cost == best):
        edit, node, step = next(
            (e, v, step) for e, v, step in _forward(codes, node)
            if (settled[1][v] and cost + step + rest[v] == best) or (marked[v] and start[v] == cost + step))
        audit.append(edit)
        cost += step
    return best, "".join(audit)


_remembered = lru_cache(65_536)(cheapest)


def plan(codes: bytes) -> tuple[int, str]:
    """`cheapest`; short conversations of the same shape are searched once per worker."""
    return _remembered(codes) if len(codes) <= 32 else cheapest(codes)


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with reproducible faults, by crc32 of `id:turn` modulo 20 (nulls: one space): `conv_id`, `turn`, `role`, `text`, `gone`.

    0: the row is gone (it stays in the table, marked). 1: its text is empty. 2: its text loses `.`, `!` and `?`. 3: it comes twice. 4: its role is user.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(known(id_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    named = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), what.alias("what"))
    return named.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("what") == 0).alias("gone"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _code(role: Column, text: Column) -> Column:
    """The code of a row without looking at others: 4 x fault + class of the initial."""
    fault = F.when(~text.rlike(f"[^{_WHITE}]"), BLANK).when(~text.rlike(rf"[.!?][{_WHITE}]*\z"), TRUNCATED).otherwise(NONE)
    kind = F.coalesce(*[F.when(role.startswith(c), k) for k, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    return (fault * 4 + kind).cast("int")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one partition, sorted by `first`, turn, role and text."""
    dealt = rows.repartition("conv_id")
    return dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "text")


def reports(rows: DataFrame) -> DataFrame:
    """First pass over `conv_id`, `turn`, `role`, `text`, `gone`: per conversation `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`.

    Conversations of which all rows are gone are reported too.
    """
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    narrow = _in_order(rows).select("conv_id", "turn", _code(F.col("role"), F.col("text")).alias("code"), same.alias("same"), "gone")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        each = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
        current, started = None, False
        codes, seen, turns, low, high, last = bytearray(), set(), 0, None, None, None

        def close() -> None:
            faults = [c >> 2 for c in codes]
            illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:]))
            gaps = 0 if low is None else high - low + 1 - turns
            found.append((current, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, *plan(bytes(codes))))

        for conv, turn, code, digest, gone in each:
            if not started or conv != current:
                if started:
                    close()
                    if len(found) >= 10_000:
                        yield _batch(found)
                        found = []
                current, started = conv, True
                codes, seen, turns, low, high, last = bytearray(), set(), 0, None, None, None
            if gone:
                continue
            if turn is not None:
                turns += turn != last
                low, high, last = turn if low is None else low, turn, turn
            if code >> 2 != BLANK and digest in seen:
                code = 4 * DUPLICATE + (code & 3)
            seen.add(digest)
            codes.append(code)
        if started:
            close()
        yield _batch(found)

    kind = rows.schema["conv_id"].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    types = [to_arrow_type(kind), *[pa.int64()] * len(names), pa.string()]

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *names, "audit"])

    return narrow.mapInArrow(search, f"conv_id {kind.simpleString()}, {', '.join(f'{n} long' for n in names)}, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Second pass: the rows after repair, `conv_id`, `place` (from 0), `role`, `text`, `edit` (K, R or I); a task gives them in order."""
    plans = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = plans.union(rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), "turn", "role", "text"))
    dealt = _in_order(both, "part")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, current = "", 0, 0, 0, None

        def inserts(out: list[tuple]) -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = _OTHER[state]
                out.append((current, place, ROLES[state], "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            out: list[tuple] = []
            for conv, part, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part == 0:
                    # Inserts at the end of the conversation before have been written with its last row.
                    audit, at, state, place, current = text, 0, 0, 0, conv
                    inserts(out)
                    continue
                what, at = audit[at], at + 1
                if what != "D":
                    if what == "K":
                        state = _KEEP[state][INITIALS.index(role[0])]
                    else:
                        state = _OTHER[state]
                        role = ROLES[state]
                    out.append((conv, place, role, text, what))
                    place += 1
                inserts(out)
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "role", "text", "edit"])

    kind = rows.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
    return dealt.select("conv_id", "part", "role", "text").mapInArrow(edit, f"conv_id {kind.simpleString()}, place long, role string, text string, edit string")


def digests(lines: DataFrame) -> DataFrame:
    """`conv_id`, `repaired_sha256` of the `role:text` lines of `repaired`, hashed as its tasks give them: no shuffle, no text is held."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if state:
                        done.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _pairs(done)
        yield _pairs([(current, state.hexdigest())] if state else [])

    kind = lines.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def _pairs(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], arrow), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return lines.mapInArrow(digest, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of `conv_id`, `turn`, `role`, `text`, `gone`, from written tables."""
    written = stage(rows, "conversation-rows")
    found = stage(reports(written), "conversation-reports")
    return found, repaired(written, found)
