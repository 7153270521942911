"""Scores once per distinct text (M8) and the security log scan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textguard.operators import scoring as SC
from textguard.sources.logs import scan_security_logs


def _scored(spark, docs, hot_share=SC.HOT_SHARE):
    asked = spark.sparkContext.accumulator(0)

    def scorer(df, text):
        @F.udf("int")
        def size(t):
            asked.add(1)
            return len(t)
        return df.withColumn("n", size(text))
    rows = SC.score_distinct(docs, "text", "doc_id", scorer, ["n"], hot_share).collect()
    return Counter((r.doc_id, r.n) for r in rows), asked.value


@pytest.mark.parametrize("hot_share", [2, 16_384])
def test_hot_text_is_scored_once_without_adaptive_execution(spark, hot_share):
    rows = [(i, "the same text") for i in range(3000)] + [(3000 + i, f"text {i % 50}") for i in range(500)] + [(9001, None), (9002, ""), (7, "other text, same id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got, asked = _scored(spark, docs, hot_share)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == Counter((i, len(t or "")) for i, t in rows)
    assert asked == len({t or "" for _, t in rows})


def test_hot_text_does_not_meet_one_task(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(2000)] + [(5000 + i, f"t{i}") for i in range(900)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SC.score_distinct(docs.repartition(8), "text", "doc_id", lambda d, t: d.withColumn("n", F.length(t)), ["n"], hot_share=4)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 2900 and max(sizes) < 600
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_empty_table(spark):
    got, asked = _scored(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert not got and asked == 0


def test_log_lines_of_several_writers(spark, tmp_path):
    lines = ['{"type":"a","conv_id":1,"score":0.5,"is_flagged":true}', '{"type":"a","conv_id":"2","score":"0.25","extra":{"x":1}}', '{"type":"b","conv_id":"two","is_flagged":"maybe","score":1}',
             '{"type":"b","conv_id":3,"sco', "", "[1, 2]", "not json", '{"type":null}', "{}"]
    (tmp_path / "log.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = scan_security_logs(spark, str(tmp_path)).collect()
    good = Counter((r.type, r.conv_id, r.score, r.is_flagged, tuple(r.bad_fields)) for r in rows if r.bad_line is None)
    assert good == Counter([("a", 1, 0.5, True, ()), ("a", 2, 0.25, None, ()), ("b", None, 1.0, None, ("conv_id", "is_flagged")), (None, None, None, None, ()), (None, None, None, None, ())])
    bad = [r for r in rows if r.bad_line is not None]
    assert sorted(r.bad_line for r in bad) == sorted(['{"type":"b","conv_id":3,"sco', "[1, 2]", "not json"])
    assert all(r.type is None and r.conv_id is None and r.bad_fields == [] for r in bad)
