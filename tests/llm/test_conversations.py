"""Conversation repair against plain Python: every edit sequence of short signatures, and whole tables row by row."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from scarpline.llm import conversations as cv

VALID = re.compile(r"(s?(ua)+)?")
DATA = "/root/testdata/sf0.01/conversations.parquet"


def every_repair(signature):
    """(cost, audit) of each edit sequence with at most two inserts at a place, by trying them all."""
    slots = ["", "I", "II"]
    per_row = [["D"] if m == "x" else ["D", "K", "Ru", "Ra"] for m in signature]
    best = None
    for edits in itertools.product(*per_row):
        for before in itertools.product(slots, repeat=len(signature) + 1):
            for names in itertools.product("ua", repeat=sum(map(len, before))):
                left, roles, audit, cost = list(names), "", "", 0
                for k, ins in enumerate(before):
                    for _ in ins:
                        roles, audit, cost = roles + left.pop(0), audit + "I", cost + 2
                    if k < len(signature):
                        e, m = edits[k], signature[k]
                        audit += e[0]
                        cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and m.isupper())
                        roles += {"D": "", "K": m.lower()}.get(e[0], e[-1])
                if VALID.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_each_short_signature_has_its_cheapest_repair():
    for n in range(3):
        for signature in map("".join, itertools.product("suaoSUAOx", repeat=n)):
            assert cv.solve(signature) == every_repair(signature), signature
    pick = random.Random(5)
    for _ in range(12):
        signature = "".join(pick.choices("suaUox", k=3))
        assert cv.solve(signature) == every_repair(signature), signature


def test_a_very_long_signature_is_solved_flatly():
    cost, audit = cv.solve("s" + "ua" * 20_000 + "u")
    assert (cost, audit) == (2, "K" * 40_002 + "I")


def plain(rows):
    """The contract, one conversation after the other."""
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        mine = groups.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in mine if t is not None]
        signature, faults, seen = "", [], set()
        for _, role, text in mine:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else mark.upper() if fault else mark
        cost, audit = cv.solve(signature)
        lines, at, last = [], 0, ""
        for edit in audit:
            due = "assistant" if last == "u" else "user"
            role, text = ("", "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else due
                lines.append(f"{role}:{text}")
                last = role[:1]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.selectExpr("*", "1 AS signature", "'x' AS audit", "2 AS cost", "3 AS conv")
    got = cv.op13_rows(df).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[1:]) for r in got}


def test_edge_rows(spark):
    long = "word " * 60_000
    rows = [(1, 0, "system", "Rules."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (1, 5, "user", "Hello?"), (1, 7, None, None), (1, None, "user", ""), (2, 3, "tool", "é"), (2, 4, "", "ok."), (2, 5, "assistant", long), (2, 6, "user", long + "."), (None, 1, "user", "A."), (None, 2, "assistant", "B"), (3, None, None, None), (3, None, None, None), (4, 0, "user", " \t\n"), (5, 9, "assistant", "Ends! ")]
    rows += [(c, t, r, f"{r} {t} of {c}.") for c in range(10, 60) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    assert found(spark, rows, extra=True) == plain(rows)
    assert found(spark, []) == {}


def test_a_conversation_of_many_rows_and_equal_texts(spark):
    pick = random.Random(3)
    rows = [(7, t, pick.choice(("user", "assistant", "system")), pick.choice(("Same.", f"Own {t}.", "cut off"))) for t in range(4000)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the tables")
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(DATA).select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows) == plain(rows)


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C"), (2, 0, "assistant", " ")]
    got = sorted(map(tuple, cv.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert [r[3][0] for r in got] == list("uaua") or [r[3][0] for r in got] == list("ua")
    assert {r[0] for r in got} == {1}
