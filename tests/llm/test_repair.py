"""Conversation repair against a plain version that tries all edits of every row."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from eventmesa.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """rows: (initial, fault). Least (cost, letters) by recursion over all edits."""
    roles = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
        grown = next(x for x in roles[state] if x != "s")
        if inserted < 3:
            add(2, "I", best(i, to[grown], inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            add(3, "D", best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if initial in roles[state] and initial:
                    add(more, "K", best(i + 1, to[initial], 0))
                add(2 + more, "R", best(i + 1, to[grown], 0))
        return min(found, default=(10**9, "~"))

    return best(0, 0, 0)


def plain(conversations):
    one = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
            role, text = one(role), one(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.rstrip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = plain_audit(list(zip(initials, faults, strict=True)))
        fixed, i, role = [], 0, ""
        for letter in audit:
            role = {"user": "assistant"}.get(role, "user") if letter in "IR" else role
            if letter == "K":
                role = {"s": "system", "u": "user", "a": "assistant"}[initials[i]]
            if letter != "D":
                fixed.append(f"{rows[i][1] if letter == 'K' else role}:{'' if letter == 'I' else rows[i][2]}")
            i += letter != "I"
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "user", "assistant", "usher", "tool", "", None, "U"]
    texts = ["Yes.", "No", "no?", "", " \t\n", None, "Well! ", "é。", "So\x1f", "Yes.", "a.\x0b"]
    rows = []
    for conv in range(160):
        for turn in range(r.randint(0, 9)):
            rows.append((conv, r.choice([turn, turn, turn, 2 * turn, None]), r.choice(roles), r.choice(texts)))
        if conv % 9 == 0 and rows:
            rows += [rows[-1]] * 3
        if conv % 4 == 0:
            rows += [(conv, t, ["user", "assistant"][t % 2], f"text {t}.") for t in range(12)]
    return rows + [(None, 1, "user", "nobody."), (None, None, None, None), (7000, -3, "user", "x" * 200_000)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("small", [False, True])
def test_repair_matches_all_edits(spark, monkeypatch, small):
    rows = conversations()
    if small:  # several segments of a conversation, several strides of a run
        monkeypatch.setattr(repair, "SEGMENT_RUNS", 2)
        monkeypatch.setattr(repair, "UNROLLED", 2)
    given = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, symbol string")
    got = {x[0]: tuple(x[1:]) for x in repair.reports(repair.damaged(given)).collect()}
    assert got == plain(rows)
    assert repair.reports(repair.damaged(given.limit(0))).count() == 0


def test_long_runs_and_long_conversations(spark):
    r = random.Random(9)
    for _ in range(60):
        rows = [(x, f) for x, f in ((r.choice("suax"), r.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(5)) for _ in range(r.randint(1, 12))]
        codes = ["sua".find(x) % 4 * 4 + ["", "blank", "duplicate", "truncated"].index(f) for x, f in rows]
        assert repair.audit(codes, [1] * len(codes)) == plain_audit(rows)
    assert repair.audit([5, 8], [10**6, 3]) == repair.audit([5] * 10**6 + [8], [1] * 10**6 + [3])
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t % 700}.") for t in range(6000)]
    got = repair.reports(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copies").repartition(7)).first()
    assert (got.duplicate, got.gaps, len(got.audit.replace("I", ""))) == (6000 - len({(a, b) for _, _, a, b in rows}), 0, 6000)
    fixed = repair.repaired(spark.createDataFrame(rows[:50], SCHEMA).selectExpr("*", "1 as copies")).orderBy("place").collect()
    assert re.fullmatch("s?(ua)+", "".join(x.role[0] for x in fixed))
    assert {x.text for x in fixed} - {""} <= {x[3] for x in rows}
