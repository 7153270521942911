"""Operator 11 against a plain dynamic programme over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from textguard.llm import dialog_repair as dr
from textguard.llm.lightest import derive

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLE = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged_rows(rows):
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(name.encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        here += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def keep_least(best, state, value):
    if state not in best or value[:2] < best[state][:2]:
        best[state] = value


def with_inserts(best):
    for _ in range(4):
        for s, (cost, audit, turns) in list(best.items()):
            for r in "ua":
                if (s, r) in STEP:
                    keep_least(best, STEP[s, r], (cost + 5, audit + "I", turns + ((ROLE[r], ""),)))
    return best


def expected(rows):
    """conv_id -> the row that the operator should give."""
    out = {}
    for conv, turns in damaged_rows(rows).items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            ink = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        best = with_inserts({"": (0, "", ())})
        for (_, role, text), fault in zip(turns, faults):
            new = {}
            for s, (cost, audit, done) in best.items():
                keep_least(new, s, (cost + 2, audit + "D", done))
                if fault in ("", "truncated"):
                    stay = cost + (5 if fault else 0)
                    if (s, role[:1]) in STEP:
                        keep_least(new, STEP[s, role[:1]], (stay, audit + "K", done + ((role, text),)))
                    for r in "ua":
                        if (s, r) in STEP:
                            keep_least(new, STEP[s, r], (stay + 1, audit + "R", done + ((ROLE[r], text),)))
            best = with_inserts(new)
        cost, audit, done = min(best[s] for s in ("", "a") if s in best)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest(), done)
    return out


def conversations():
    rng = random.Random(3)
    texts = ["Hi.", "Yes!", "no", "  ", "", None, "What?\n", "ok. \x0b", "é…"]
    rows = []
    for conv in [*range(80), None]:
        n = {50: 400, 7: 60}.get(conv, rng.choice([1, 1, 2, 3, 5, 8, 12]))
        for t in range(n):
            role = rng.choice(["user", "assistant", "system", None, "tool", "", "User", "a"]) if rng.random() < 0.4 else "user" if t % 2 == 0 else "assistant"
            rows.append((conv, t if conv == 50 else rng.choice([t, t, t, t * 2, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}."))
    return rows + rows[:40] + [rows[5]] * 30


@pytest.mark.parametrize("block,fan", [(512, 64), (8, 2)])
def test_lightest_repair_in_blocks_of_any_size(spark, monkeypatch, block, fan):
    monkeypatch.setattr(dr, "BLOCK", block)
    monkeypatch.setattr(dr, "FAN", fan)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS copies", "1 AS is_row", "2 AS gaps")
    got = {r.conv_id: tuple(r)[1:] for r in dr.report(dr.damaged(df)).collect()}
    assert got == {c: w[:-1] for c, w in expected(rows).items()}


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = conversations()
    out = {}
    for r in sorted(dr.repaired(dr.damaged(spark.createDataFrame(rows, SCHEMA))).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert out == {c: list(w[-1]) for c, w in expected(rows).items() if w[-1]}
    for turns in out.values():
        assert re.fullmatch("s?(ua)+", "".join(role[:1] for role, _ in turns))


def test_empty_table_and_conversation_without_rows(spark):
    assert dr.report(dr.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = dr.report(dr.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_many_equal_rows_stay_one_fact(spark):
    fact = dr.facts(dr.damaged(spark.createDataFrame([(2, 2, "user", "Hello.")] * 5000, SCHEMA)))
    assert fact.count() == 1
    row = dr.solve(fact).collect()[0]
    assert (row.duplicate, row.cost, row.audit) == (4999, 2 * 5000, "D" * 5000)


def test_agenda_pops_least_audit_of_least_cost():
    edges = {(2, 0): [(1, "b", 1, 0), (1, "a", 1, 1)], (1, 0): [(1, "a", 0, 0)], (1, 1): [(1, "c", 0, 0)]}
    assert derive(2, [0], lambda i, s: edges.get((i, s), []))[0, 0] == (2, "ab", 0)
