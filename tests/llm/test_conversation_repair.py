"""Conversation repair against a search over all edits, written without lattices."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from newsmood.llm import conversation_repair as cr
from newsmood.llm import queries
from tests.conftest import rows

WHITE = " \t\n\x0b\x0c\r"


def plain_cheapest(kinds):
    """Uniform-cost search over edits; `kinds` holds (initial, fault) per row. The first end taken off is the least of the cheapest."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, read = heappop(heap)
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", read):
            return cost, audit
        for role in "ua":
            if re.fullmatch("s?(ua)*u?", read + role):
                heappush(heap, (cost + 3, audit + "I", i, read + role))
        if i < len(kinds):
            initial, fault = kinds[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, read))
            if fault in ("", "t"):
                more = 3 if fault else 0
                if initial and initial in "sua" and re.fullmatch("s?(ua)*u?", read + initial):
                    heappush(heap, (cost + more, audit + "K", i + 1, read + initial))
                for role in "ua":
                    if re.fullmatch("s?(ua)*u?", read + role):
                        heappush(heap, (cost + 3 + more, audit + "R", i + 1, read + role))


def codes(kinds):
    return bytes(4 * {"": 0, "b": 1, "d": 2, "t": 3}[fault] + (cr.INITIALS.index(initial) if initial in cr.INITIALS else 3) for initial, fault in kinds)


def test_search_finds_the_least_of_the_cheapest():
    rng = random.Random(11)
    for n in list(range(6)) * 60 + [7] * 5:
        kinds = [(rng.choice("suaax"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(n)]
        assert cr.cheapest(codes(kinds)) == plain_cheapest(kinds), kinds
        nearly = [("ua"[i % 2] if rng.random() < 0.9 else "s", "" if rng.random() < 0.9 else "t") for i in range(n)]
        assert cr.cheapest(codes(nearly)) == plain_cheapest(nearly), nearly


def test_long_conversation():
    kinds = [("s", "")] + [("ua"[i % 2], "") for i in range(20_000)]
    assert cr.cheapest(codes(kinds)) == (0, "K" * 20_001)
    broken = kinds[:5000] + [("a", "t"), ("a", "b")] + kinds[5000:]
    cost, audit = cr.cheapest(codes(broken))
    assert cost > 0 and len(audit.replace("I", "")) == 20_003


def plain_report(table):
    convs = {}
    for conv, turn, role, text in table:
        kept = convs.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        kept += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(WHITE)
            fault = "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            kinds.append((role[:1], fault))
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a + b for (a, _), (b, _) in zip(kinds, kinds[1:])]
        cost, audit = plain_cheapest(kinds)
        lines, left, read = [], list(kept), ""
        for edit in audit:
            if edit == "I":
                _, role, text = None, "", ""
            else:
                _, role, text = left.pop(0)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if read[-1:] == "u" else "user"
            read += role[0]
            lines.append(f"{role}:{text}")
        faults = [f for _, f in kinds]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"),
            "truncated": faults.count("t"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def run(spark, monkeypatch, table):
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in table],
                               "conv_id long, turn long, role string, text string, place string, part string, gone string, code string, same string, edit string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return {r.pop("conv_id"): r for r in rows(queries.op11_conversation_repair(spark, ""))}


ODD = [
    (None, None, None, None), (None, 1, "user", "A."), (None, 1, "user", "A."), (1, None, "user", "Hi."), (1, None, "assistant", "Yes"), (1, 5, "", "no role."), (1, 9, "User", "upper."),
    (2, 0, "system", "S."), (3, 0, "user", " \t\x0b\n"), (3, 1, "user", "\x1c"), (3, 2, "assistant", "x. \n"), (4, 0, "user", "w " * 30_000 + "!"), (4, 1, "assistant", "é?"),
    (5, 7, "user", "same turn."), (5, 7, "assistant", "same turn."), (5, 7, "user", "other."), (5, -3, "tool", "t."), (6, 0, "user", "\x00."), (6, 1, "assistant", "a\nb:."),
]


def test_odd_rows(spark, monkeypatch):
    assert run(spark, monkeypatch, ODD) == plain_report(ODD)
    assert run(spark, monkeypatch, []) == {}


def test_conversations_without_rows_are_reported(spark, monkeypatch):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    got = run(spark, monkeypatch, gone)
    assert got == plain_report(gone) and all(r["audit"] == "" and r["cost"] == 0 for r in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, monkeypatch, seed):
    rng = random.Random(seed)
    table = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            table.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", None]),
                          rng.choice(["Yes.", "No!", "maybe", "", None, f"t{rng.random()}."])))
    rng.shuffle(table)
    assert run(spark, monkeypatch, table) == plain_report(table)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a.", False), (1, 1, "assistant", "b.", False), (2, 0, "user", "gone", True)],
                               "conv_id long, turn long, role string, text string, gone boolean")
    reports, lines = cr.repair(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in reports.collect()} == {1: (3, "RK"), 2: (0, "")}
    assert [tuple(r) for r in lines.collect()] == [(1, 0, "user", "a.", "R"), (1, 1, "assistant", "b.", "K")]
