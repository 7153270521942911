"""Flagship job: screen every document for toxicity and PII and roll the result up by
language - one narrow detection stage, then a partial/final aggregate over a handful of
groups (the per-language partial sums are combined map-side, so a dominant language
costs no more than any other)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import ci
from textguard.operators import outfilter as OF
from textguard.plans import oracle_sql as O
from textguard.plans.catalog import ORACLES, register
from textguard.sources.tables import read_table, spread_for_cpu


def screening_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_for_cpu(read_table(spark, sf, "documents").select("doc_id", "lang", "text"))
    scored = OF.with_toxicity(docs, "text")
    t = F.coalesce(F.col("text"), F.lit(""))
    has_digit, has_at = t.rlike(r"\p{Nd}"), F.instr(t, "@") > 0
    hits = {f"{name}_hits": F.when(has_at if name == "email" else has_digit, F.regexp_count(t, F.lit(ci(p))))
            .otherwise(F.lit(0)) for name, p, _ in L.PII_RULES}
    scored = scored.withColumns(hits)
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("toxicity.detected")).alias("toxic_docs"),
        F.round(F.avg("toxicity.score"), 4).alias("avg_toxicity"),
        *[F.sum(c).cast("bigint").alias(c) for c in hits])


_hits_sql = ", ".join(f"CAST(sum(len(regexp_extract_all(coalesce(text, ''), {O.q(ci(p))}))) AS BIGINT) AS {name}_hits"
                      for name, p, _ in L.PII_RULES)
ORACLES["screening_by_lang"] = (
    "WITH src AS (SELECT doc_id, lang, text FROM documents), " + O.output_filter_ctes("src").strip()
    + f"\nSELECT lang, count(*) AS docs, CAST(count_if(tox_det) AS BIGINT) AS toxic_docs, round(avg(tox_score), 4) AS avg_toxicity, "
    + _hits_sql + " FROM of6 GROUP BY lang")
register("screening_by_lang")(screening_by_lang)
