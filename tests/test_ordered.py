"""Skew-proof order operators against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textguard.operators.ordered import blocked_running_sum, nearest_rank_percentiles


def nearest_rank(values, p):
    if not values:
        return 0.0
    s = sorted(values)
    return s[max(0, min(len(s) - 1, int(round((p / 100.0) * (len(s) - 1)))))]


def test_percentiles_match_brute_force(spark):
    random.seed(7)
    rows = [("one", float(v)) for v in range(1, 11)]
    # a hot group holding most rows, with many ties
    rows += [("hot", float(random.randint(0, 50))) for _ in range(3000)]
    rows += [("small", float(random.random())) for _ in range(37)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [50.0, 95.0, 0.0, 100.0, 25.0]
    got = {(r["g"], r["p"]): r["v"] for r in nearest_rank_percentiles(df, "g", "v", ps, num_partitions=7).collect()}
    for g in ("one", "hot", "small"):
        vals = [v for gg, v in rows if gg == g]
        for p in ps:
            assert got[(g, p)] == nearest_rank(vals, p), (g, p)
    assert got[("one", 50.0)] == 5.0 and got[("one", 95.0)] == 10.0


def test_percentiles_of_hot_values_and_empty_groups(spark):
    df = spark.range(0, 60_000, 1, 6).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).cast("double").alias("v")) \
        .unionByName(spark.createDataFrame([("none", None)], "g string, v double"))
    got = {(r["g"], r["p"]): r["v"] for r in nearest_rank_percentiles(df, "g", "v", [50.0, 99.0], num_partitions=5).collect()}
    vals = sorted(float(i) if i % 3 == 0 else 7.0 for i in range(60_000))
    assert got == {("a", 50.0): nearest_rank(vals, 50.0), ("a", 99.0): nearest_rank(vals, 99.0), ("none", 50.0): 0.0, ("none", 99.0): 0.0}


def test_blocked_running_sum(spark):
    rows = [(k, t, t % 5 + 1) for k in (1, 2) for t in range(0, 23 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r["k"], r["t"]): r["rs"] for r in blocked_running_sum(df, "k", "t", "v", "rs", block=4).collect()}
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["t"]): r["rs"] for r in df.withColumn("rs", F.sum("v").over(w)).collect()}
    assert got == want
