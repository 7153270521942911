"""Contexts (J4, T4), messages by key (J1), deletions (S9), originals of filtered replies (F9), times (F13) and evaluation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textguard.plans import context as CX
from textguard.plans import stats as ST
from textguard.plans import tables as T

MESSAGES = "conversation_id long, turn long, role string, content string, masked_content string"


def _messages(spark, n):
    rows = [(1, t * 3, "USER" if t % 2 == 0 else "ASSISTANT", f"c{t}", f"m{t}" if t % 4 == 0 else ("" if t % 4 == 2 else None)) for t in range(n)]
    rows += [(2, 5, "ASSISTANT", "only a reply", None), (3, 0, "USER", None, None)]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.mark.parametrize("block", [4096, 4])
@pytest.mark.parametrize("duplicate", [False, True])
def test_contexts(spark, block, duplicate):
    m = _messages(spark, 23)
    entries = CX.context_entries(m, block)
    got = {}
    for r in sorted(CX.expand_contexts(entries, CX.context_lengths(entries, duplicate), block).collect(), key=lambda r: r.position):
        got.setdefault((r.conversation_id, r.turn), []).append((r.position, r.role, r.content))
    want = {}
    for conv in (1, 2, 3):
        rows = sorted((r for r in m.collect() if r.conversation_id == conv), key=lambda r: r.turn)
        history = []
        for r in rows:
            entry = (r.role.lower(), r.masked_content or r.content)
            if r.role == "USER":
                shown = history + ([entry] if duplicate else []) + [entry]
                want[(conv, r.turn)] = [(i + 1, *e) for i, e in enumerate(shown)]
            history.append(entry)
    assert got == want


def test_no_messages(spark):
    entries = CX.context_entries(spark.createDataFrame([], MESSAGES))
    assert entries.count() == 0 and CX.expand_contexts(entries, CX.context_lengths(entries)).count() == 0


def test_messages_and_deletions_by_key(spark):
    convs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "empty")], "id long, title string")
    msgs = spark.createDataFrame([(1, 4), (1, 0), (2, 0), (9, 0)], "conversation_id long, turn long")
    keys = spark.createDataFrame([(1,), (1,), (3,), (8,), (9,), (None,)], "id long")
    found, missing = T.conversation_messages(convs, msgs, keys)
    assert sorted((r.conversation_id, r.turn, r.position, r.title) for r in found.collect()) == [(1, 0, 1, "one"), (1, 4, 2, "one")]
    assert sorted(r.id for r in missing.collect()) == [8, 9]
    out = sorted(map(tuple, T.delete_outcomes(convs, msgs, keys).collect()))
    assert out == [(1, "deleted", 2), (3, "deleted", 0), (8, "not found", 0), (9, "not found", 0)]


def test_original_of_a_filtered_reply(spark):
    rows = [("the original", "[REDACTED - x]", "other", "the original"), ("", "[RESPONSE BLOCKED - x]", "kept", "kept"), (None, "[Content censored]\nx", None, "[Content censored]\nx"),
            ("", "plain", "kept", "plain"), (None, None, "kept", None)]
    df = spark.createDataFrame(rows, "f string, c string, a string, want string")
    for r in df.select("want", ST.original_response(F.col("f"), F.col("c"), F.col("a")).alias("got")).collect():
        assert r.got == r.want


def test_client_time(spark):
    now = dt.datetime(2030, 1, 1)
    raw = ["2024-05-06T07:08:09+02:00Z", "2024-05-06T07:08:09Z", "2024-05-06T07:08:09-01:30", "no time", "", None, "2024-13-40T00:00:00Z"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r.t for r in df.select("i", F.date_format(ST.client_time(F.col("raw"), F.lit(now)), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()]
    assert got == ["2024-05-06 05:08:09", "2024-05-06 07:08:09", "2024-05-06 08:38:09"] + ["2030-01-01 00:00:00"] * 4


def test_multilabel_evaluation(spark):
    cases = [(["gender"], ["gender", "racial"]), (["gender", "racial"], ["racial"]), (["gender"], ["racial"]), (["gender"], []), ([], []), ([], ["racial"]), (None, None),
             (["gender", "gender"], ["gender"]), ([None], [])]
    df = spark.createDataFrame(cases, "e array<string>, p array<string>")
    oks = [r.ok for r in df.select(T.multilabel_verdict(F.col("e"), F.col("p")).alias("ok")).collect()]
    assert oks == [True, True, False, False, True, False, True, True, True]
    got = {r.label: r for r in T.multilabel_confusion(df, F.col("e"), F.col("p"), ["gender", "racial", "none"]).collect()}
    assert [got["gender"][k] for k in ("n", "tp", "fp", "fn", "tn", "passed", "failed")] == [9, 2, 0, 3, 4, 6, 3]
    assert [got["racial"][k] for k in ("tp", "fp", "fn", "tn")] == [1, 3, 0, 5]
    assert got["none"].f1 == 0.0 and got["none"].accuracy == 1.0
    empty = T.multilabel_confusion(df.limit(0), F.col("e"), F.col("p"), ["gender"]).collect()
    assert [(r.n, r.tp, r.passed, r.accuracy) for r in empty] == [(0, 0, 0, 0.0)]
