"""Token decoding and span merging fixtures (FIXTURES.md, span fixtures)."""

from pyspark.sql import functions as F

from textguard.operators import modelspans as MS
from textguard.operators.scoring import bias_from_probabilities, toxicity_from_probability

TOK = "array<struct<label:string,conf:double,start:int,end:int>>"


def test_bio_decoding(spark):
    toks = [("B-NAME", 0.9, 0, 4), ("I-NAME", 0.7, 4, 6), ("O", 1.0, 6, 7), ("I-NAME", 0.9, 8, 10)]
    df = spark.createDataFrame([(toks,)], f"tokens {TOK}")
    spans = df.select(MS.decode("tokens").alias("s")).first()["s"]
    assert [(s["type"], s["start"], s["end"]) for s in spans] == [("name", 0, 6)]
    assert abs(sum(spans[0]["confs"]) / len(spans[0]["confs"]) - 0.8) < 1e-9


def test_merge(spark):
    def merged(a, b):
        toks = [("B-NAME", 0.9, a[0], a[1]), ("O", 1.0, a[1], a[1] + 1), ("B-NAME", 0.9, b[0], b[1])]
        df = spark.createDataFrame([(toks,)], f"tokens {TOK}")
        return [(s["start"], s["end"]) for s in df.select(MS.decode_and_merge("tokens").alias("s")).first()["s"]]
    assert merged((0, 4), (6, 9)) == [(0, 9)]
    assert merged((0, 4), (7, 9)) == [(0, 4), (7, 9)]


def test_probability_mappings(spark):
    r = spark.range(1).select(toxicity_from_probability(F.lit(0.85)).alias("t"),
                              toxicity_from_probability(F.lit(0.3)).alias("u"),
                              bias_from_probabilities(F.array(F.lit(0.9), F.lit(0.1), F.lit(0.6))).alias("b"),
                              bias_from_probabilities(F.array(F.lit(0.3), F.lit(0.1), F.lit(0.2))).alias("c")).first()
    assert (r["t"]["detected"], r["t"]["severity"]) == (True, "high")
    assert (r["u"]["detected"], r["u"]["severity"]) == (False, None)
    assert list(r["b"]["types"]) == ["gender", "religious"] and r["b"]["severity"] == "high"
    assert r["c"]["detected"] is False and r["c"]["severity"] == "low"   # severity without a detection
