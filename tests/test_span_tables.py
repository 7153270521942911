"""Spans of two sources resolved over tables against the fold over one row's arrays."""

import random

import pytest
from pyspark.sql import functions as F

from textguard.operators import pii as P
from textguard.operators import spanmerge as SM

TYPES = ["email", "phone", "ssn", "name", "location", "ip_address"]
SCHEMA = "doc_id long, ord long, start int, end int, type string, value string, confidence double"


def _spans(rng, doc, n):
    out = []
    for i in range(n):
        a = rng.randint(0, 80)
        out.append((doc, i, a, a + rng.randint(1, 12), rng.choice(TYPES), f"v{a}", rng.choice([0.5, 0.75, 0.75, 0.9])))
    return out


def _disjoint(rng, doc, n):
    """Rule spans of one pattern never overlap; several patterns do."""
    out, at = [], 0
    for i in range(n):
        at += rng.randint(0, 9)
        out.append((doc, i, at, at + 5, rng.choice(TYPES), f"v{at}", rng.choice([0.5, 0.75, 0.9])))
        at += rng.choice([2, 5])
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_tables_equal_the_fold(spark, block):
    rng = random.Random(block)
    rules = spark.createDataFrame([r for d in range(80) for r in _disjoint(rng, d, rng.randint(0, 12))], SCHEMA)
    model_rows = [r for d in range(10, 90) for r in _spans(rng, d, rng.randint(0, 8))]
    model_rows += [(d, 100 + o, s, e, t, v, 0.8) for d, o, s, e, t, v, _ in model_rows[::3]]
    model = spark.createDataFrame(model_rows, SCHEMA)

    def arrays(t, name):
        return t.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct("start", "end", "type", "value", "confidence").alias("s")))),
                                                   lambda x: x["s"]).alias(name))
    both = arrays(rules, "r").join(arrays(model, "m"), "doc_id", "full").withColumn("r", F.coalesce("r", F.array().cast(P.SPAN_ARRAY)))
    want = both.select("doc_id", F.explode(P.resolve_spans(F.col("r"), F.col("m"))).alias("s")).select("doc_id", "s.*")
    got = SM.resolve_span_tables(rules, model, block=block)
    key = lambda r: (r.doc_id, r.start, r.end, r.type, r.value, r.confidence)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert want.count() > 300
    no_names = SM.resolve_span_tables(rules, model, mask_names=False, block=block)
    assert sorted(map(key, no_names.collect())) == sorted(k for k in map(key, want.collect()) if k[3] != "name")


def test_ties_and_priorities(spark):
    rules = spark.createDataFrame([(1, 0, 0, 10, "email", "tie", 0.9), (1, 1, 20, 30, "ssn", "higher type", 0.1), (1, 2, 40, 50, "phone", "surer", 0.9),
                                   (1, 3, 60, 70, "phone", "less sure", 0.5), (1, 4, 80, 90, "phone", "touches", 0.5)], SCHEMA)
    model = spark.createDataFrame([(1, 0, 0, 10, "email", "model", 0.9), (1, 1, 22, 30, "phone", "model", 0.9), (1, 2, 40, 52, "phone", "model", 0.8),
                                   (1, 3, 60, 70, "phone", "model", 0.8), (1, 4, 90, 95, "name", "model", 0.8), (1, 5, 90, 95, "name", "again", 0.9), (2, 0, 5, 9, "name", "alone", None)], SCHEMA)
    got = sorted((r.doc_id, r.start, r.value, r.confidence) for r in SM.resolve_span_tables(rules, model).collect())
    assert got == [(1, 0, "model", 0.9), (1, 20, "higher type", 0.1), (1, 40, "surer", 0.9), (1, 60, "model", 0.8), (1, 80, "touches", 0.5),
                   (1, 90, "again", 0.9), (2, 5, "alone", None)]


def test_empty_and_one_sided(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 0, 0, 3, "email", "x", 0.5)], SCHEMA).withColumn("_src", F.lit(7)).withColumn("_cluster", F.lit("u"))
    assert SM.resolve_span_tables(none, none).count() == 0
    assert SM.resolve_span_tables(some, none).count() == SM.resolve_span_tables(none, some).count() == 1
