"""D2/J5 over tables of spans: detections of a model and of the rules, one row each, resolved per document.

``pii.resolve_spans`` resolves the spans of a row's own text. Where a model's detections arrive as a table of their own
(a batch scorer's output), both sources meet here by key. Only spans that overlap can meet, so documents are cut
into clusters of overlapping spans first: a cluster ends where no earlier span reaches over the next start. Clusters
are found by windows over blocks of the text, so a document with very many spans is not one task's window, and only
the spans of one cluster are gathered into one row.

Defined results: a key found in one source only keeps that source's spans; empty tables give no rows; repeated model
rows count once, at the place of the first; a null confidence is lowest; other columns of the sources are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.ordered import blocked_highest_before, blocked_latest
from textguard.operators.pii import SPAN, SPAN_ARRAY, resolve_spans

#: Code points of a text whose spans are windowed together.
SPAN_BLOCK = 4096


def span_table(df: DataFrame, key: str, spans: str) -> DataFrame:
    """(key, ord, start, end, type, value, confidence): the spans of an array column, ``ord`` their order of detection."""
    rows = df.select(key, F.posexplode_outer(F.col(spans).cast(SPAN_ARRAY)).alias("ord", "s")).where(F.col("s").isNotNull())
    return rows.select(key, F.col("ord").cast("bigint").alias("ord"), "s.start", "s.end", "s.type", "s.value", "s.confidence")


def span_clusters(spans: DataFrame, key: str, block: int = SPAN_BLOCK) -> DataFrame:
    """``spans`` with ``_cluster``: the start of the first span of the run of overlapping spans that a span stands in."""
    reach = blocked_highest_before(spans, key, "start", "end", "_reach", block)
    opens = F.col("_reach").isNull() | (F.col("_reach") <= F.col("start"))
    return blocked_latest(reach.withColumn("_opens", opens), key, "start", {"_cluster": F.col("_opens")}, block).drop("_reach", "_opens")


def resolve_span_tables(rules: DataFrame, model: DataFrame, key: str = "doc_id", mask_names: bool = True,
                        block: int = SPAN_BLOCK) -> DataFrame:
    """(key, start, end, type, value, confidence): what is left of two tables (key, ord, start, end, type, value, confidence) by the
    rules of ``pii.resolve_spans``; ``mask_names=False`` (D4) then drops names, which have taken part in the resolution."""
    columns = (key, "ord", "start", "end", "type", "value", "confidence")
    both = (model.select(*columns).withColumn("_src", F.lit(0)).unionByName(rules.select(*columns).withColumn("_src", F.lit(1))))
    span = F.struct(F.col("start"), F.col("end"), F.col("type"), F.col("value"), F.col("confidence")).cast(SPAN)
    gathered = span_clusters(both, key, block).groupBy(key, "_cluster").agg(
        F.sort_array(F.collect_list(F.struct("_src", "ord", span.alias("span")))).alias("_all"))

    def of(source: int):
        return F.transform(F.filter("_all", lambda x: x["_src"] == source), lambda x: x["span"])
    kept = gathered.select(key, F.explode_outer(resolve_spans(of(1), of(0))).alias("s")).where(F.col("s").isNotNull()).select(key, "s.*")
    return kept if mask_names else kept.where(F.col("type") != "name")
