"""M3 and M4 over a table of tokens against the fold over an array of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from textguard.operators import modelspans as MS

LABELS = ["O", "B-NAME", "I-NAME", "I-NAME", "B-CODE", "I-CODE", "NAME", "I-CITY"]


@pytest.mark.parametrize("block", [4096, 5])
def test_table_equals_fold(spark, block):
    rng = random.Random(block)
    rows = []
    for doc in range(60):
        at = 0
        for idx in range(rng.randint(0, 40)):
            at += rng.choice([0, 0, 0, 1, 3])
            special = rng.random() < 0.05
            rows.append((doc, idx * rng.choice([1, 1]), rng.choice(LABELS), rng.randint(1, 9) / 16, 0 if special else at, 0 if special else at + 2))
            at += 2
    tokens = spark.createDataFrame(rows, "doc_id long, idx long, label string, conf double, start int, end int")
    spans = MS.spans_of_tokens(tokens, block)
    arrays = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label", "conf", "start", "end"))),
                                                      lambda t: F.struct(t["label"].alias("label"), t["conf"].alias("conf"), t["start"].alias("start"),
                                                                         t["end"].alias("end"))).alias("tokens"))
    for got, fold in ((spans, MS.decode("tokens")), (MS.merged_token_spans(spans, block), MS.decode_and_merge("tokens"))):
        want = arrays.select("doc_id", F.explode(fold).alias("s")).select(
            "doc_id", "s.type", "s.start", "s.end", F.size("s.confs").alias("n"), F.aggregate("s.confs", F.lit(0.0), lambda a, c: a + c).alias("c"))
        assert sorted(map(tuple, want.collect())) == sorted((r.doc_id, r.type, r.start, r.end, r.n_tokens, r.conf_sum) for r in got.collect())
        assert want.count() > 100


def test_words_borders_and_repeated_rows(spark, monkeypatch):
    """Small words and blocks, gaps between idx and rows that come twice: spans as the fold gives them, counts doubled where rows are."""
    monkeypatch.setattr(MS, "WORD", 3)
    rng, rows = random.Random(8), []
    for doc in range(40):
        at = idx = 0
        for _ in range(rng.randint(0, 60)):
            at, idx = at + rng.choice([0, 0, 0, 3]), idx + rng.choice([1, 1, 1, 9])
            rows.append((doc, idx, rng.choice([*LABELS, "I-NAME", "I-NAME"]), 0.5, at + 1, at + 3))
            at += 2
    tokens = spark.createDataFrame(rows, "doc_id long, idx long, label string, conf double, start int, end int")
    arrays = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label", "conf", "start", "end"))),
                                                      lambda t: F.struct(t["label"].alias("label"), t["conf"].alias("conf"), t["start"].alias("start"),
                                                                         t["end"].alias("end"))).alias("tokens"))
    want = sorted((r.doc_id, r.s.type, r.s.start, r.s.end, len(r.s.confs)) for r in arrays.select("doc_id", F.explode(MS.decode("tokens")).alias("s")).collect())
    for times, t in ((1, tokens), (2, tokens.unionByName(tokens))):
        got = MS.spans_of_tokens(t, 7).collect()
        assert sorted((r.doc_id, r.type, r.start, r.end, r.n_tokens // times) for r in got) == want and len(want) > 50


def test_tokens_outside_do_not_move(spark, monkeypatch):
    """A long text of tokens outside and of continuations without a beginning becomes a mask a word and hardly any pieces."""
    sizes, keep = {}, MS.written

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(MS, "written", counted)
    label = F.when(F.col("id") % 5 == 0, "I-NAME").when(F.col("id") == 7001, "B-NAME").otherwise("O")
    t = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("idx"), label.alias("label"), F.lit(1).alias("conf"),
                                   (F.col("id") + 1).alias("start"), (F.col("id") + 2).alias("end"))
    assert [(r["first"], r.n_tokens) for r in MS.spans_of_tokens(t).collect()] == [(7001, 1)]
    assert sizes["token-words"] < 400 and sizes["token-pieces"] < 20
