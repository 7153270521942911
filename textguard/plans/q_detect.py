"""Contract queries for PII detection, span resolution, masking and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import ci, shannon_entropy
from textguard.operators import pii as P
from textguard.plans import oracle_sql as O
from textguard.plans.catalog import register
from textguard.plans.q_outfilter import DOCS_SQL, docs_with_planted


def _pv_sql(select: str, where: str = "") -> str:
    return f"WITH src AS {DOCS_SQL}, {O.privacy_ctes('src')}\nSELECT {select} FROM pv5 {where}"


def _spans_long(df: DataFrame, spans_col: str) -> DataFrame:
    # explode_outer + a filter above it: a plain explode makes the optimiser infer
    # `size(spans) > 0` and push it under the projection, computing the spans twice
    return (df.select("doc_id", F.explode_outer(spans_col).alias("s")).filter(F.col("s").isNotNull())
              .select("doc_id", F.col("s.type").alias("span_type"), F.col("s.value").alias("span_value"),
                      F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"),
                      F.col("s.confidence").alias("confidence")))


SPANS_SQL = ("WITH src AS " + DOCS_SQL + ", x AS (SELECT doc_id, unnest(" + O.rule_pii_spans("coalesce(text, '')")
             + ") AS s FROM src)\nSELECT doc_id, s.t AS span_type, s.v AS span_value, s.s AS span_start, "
             "s.e AS span_end, s.c AS confidence FROM x")


@register("pii_spans", SPANS_SQL)
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + D3: every validated rule detection with code-point offsets, one row per span."""
    df = (docs_with_planted(spark, sf).withColumn("_t", F.coalesce("text", F.lit("")))
          .withColumn("spans", P.rule_pii_spans("_t")))
    return _spans_long(df, "spans")


HITS_SQL = ("WITH s AS (" + SPANS_SQL + ")\nSELECT span_type, count(*) AS hits, count(DISTINCT doc_id) AS docs "
            "FROM s GROUP BY span_type")


@register("pii_hits_by_type", HITS_SQL)
def pii_hits_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """D1 rolled up: detections and documents per PII type. A document counts its own types, so the only
    shuffle carries one partial sum per type and task."""
    types = (docs_with_planted(spark, sf).withColumn("_t", F.coalesce("text", F.lit("")))
             .select(F.transform(P.rule_pii_spans("_t"), lambda s: s["type"]).alias("types")))
    own = F.transform(F.array_distinct("types"), lambda t: F.struct(t.alias("span_type"), F.size(F.filter("types", lambda x: x == t)).alias("n")))
    return (types.select(F.explode_outer(own).alias("o")).filter(F.col("o").isNotNull())
            .groupBy(F.col("o.span_type").alias("span_type")).agg(F.sum("o.n").alias("hits"), F.count(F.lit(1)).alias("docs")))


RESOLVED_SQL = _pv_sql("doc_id, s.t AS span_type, s.v AS span_value, s.s AS span_start, s.e AS span_end, "
                       "s.c AS confidence FROM (SELECT doc_id, unnest(spans) AS s FROM pv5) z --", "")


@register("pii_resolved_spans", RESOLVED_SQL)
def pii_resolved_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans after overlap resolution (priority, then confidence), sorted by start."""
    df = (docs_with_planted(spark, sf).withColumn("_t", F.coalesce("text", F.lit("")))
          .withColumn("spans", P.resolve_spans(P.rule_pii_spans("_t"))))
    return _spans_long(df, "spans")


MASKDOC_SQL = _pv_sql("doc_id, len(mspans) > 0 AS pii_detected, CASE WHEN text IS NULL THEN NULL ELSE pii_masked END "
                      "AS masked_text, len(map_texts) AS n_mappings, array_to_string(list_sort(map_texts), ' ; ') AS mappings")


@register("mask_documents", MASKDOC_SQL)
def mask_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with PII masked by the default strategies, and their placeholder mappings."""
    df = P.with_privacy(docs_with_planted(spark, sf), "text", secrets=False)
    p = F.col("privacy")
    return df.select("doc_id", p["pii_detected"].alias("pii_detected"), p["masked_text"].alias("masked_text"),
                     F.size(p["mappings"]).cast("bigint").alias("n_mappings"),
                     P.mappings_text(p["mappings"]).alias("mappings"))


def _mask_all_sql() -> str:
    cols = []
    for strat in L.MASK_STRATEGIES:
        cols.append(O.mask_value("m.t", "m.v", O.q(strat), "m.idx") + f" AS mask_{strat}")
    return _pv_sql("doc_id, m.t AS span_type, m.v AS span_value, m.s AS span_start, m.idx AS type_index, "
                   "m.strategy AS default_strategy, m.mask AS mask_default, " + ", ".join(cols)
                   + " FROM (SELECT doc_id, unnest(mspans) AS m FROM pv5) z --")


@register("mask_values", _mask_all_sql())
def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every resolved span masked under each of the four strategies."""
    df = P.with_privacy(docs_with_planted(spark, sf), "text", secrets=False)
    m = F.col("m")
    out = (df.select("doc_id", F.explode_outer("privacy.spans").alias("m")).filter(F.col("m").isNotNull())
           .select("doc_id", m["type"].alias("span_type"), m["value"].alias("span_value"),
                   m["start"].alias("span_start"), m["idx"].cast("long").alias("type_index"),
                   m["strategy"].alias("default_strategy"), m["mask"].alias("mask_default"),
                   *[P.mask_value(m["type"], m["value"], F.lit(s), m["idx"]).alias(f"mask_{s}")
                     for s in L.MASK_STRATEGIES]))
    return out


APIKEY_SQL = _pv_sql("doc_id, len(api_keys) AS n_api_keys, array_to_string(api_keys, ' ') AS api_keys")


@register("api_key_hits", APIKEY_SQL)
def api_key_hits(spark: SparkSession, sf: str) -> DataFrame:
    """API-key candidates (3 patterns) with entropy above 3.5, per document."""
    df = docs_with_planted(spark, sf).withColumn("sec", P.secret_hits(F.coalesce("text", F.lit(""))))
    return df.select("doc_id", F.size("sec.api_keys").cast("bigint").alias("n_api_keys"),
                     F.array_join("sec.api_keys", " ").alias("api_keys"))


PASSWORD_SQL = _pv_sql("doc_id, len(passwords) AS n_passwords, array_to_string(passwords, ' ') AS passwords")


@register("password_hits", PASSWORD_SQL)
def password_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Non-trivial password values after password/passwd/pwd markers, per document."""
    df = docs_with_planted(spark, sf).withColumn("sec", P.secret_hits(F.coalesce("text", F.lit(""))))
    return df.select("doc_id", F.size("sec.passwords").cast("bigint").alias("n_passwords"),
                     F.array_join("sec.passwords", " ").alias("passwords"))


SECRETS_SQL = _pv_sql("doc_id, CASE WHEN text IS NULL THEN NULL ELSE full_masked END AS masked_text, "
                      "len(all_map_texts) AS n_mappings, array_to_string(list_sort(all_map_texts), ' ; ') AS mappings")


@register("mask_secrets", SECRETS_SQL)
def mask_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """PII masking followed by API-key and password redaction of the masked text."""
    df = P.with_privacy(docs_with_planted(spark, sf), "text")
    p = F.col("privacy")
    return df.select("doc_id", p["masked_text"].alias("masked_text"), F.size(p["mappings"]).cast("bigint").alias("n_mappings"),
                     P.mappings_text(p["mappings"]).alias("mappings"))


ENTROPY_SQL = ("WITH src AS " + DOCS_SQL + ", c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), "
               + O.q(ci(L.API_KEY_PATTERNS[2])) + ")) AS token FROM src)\nSELECT doc_id, token, round("
               + O.entropy("token") + ", 4) AS entropy FROM c")


@register("secret_entropy", ENTROPY_SQL)
def secret_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """H6: Shannon entropy (bits per character) of every long alphanumeric token."""
    df = docs_with_planted(spark, sf)
    tokens = df.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")),
                                                               F.lit(ci(L.API_KEY_PATTERNS[2])), F.lit(0))).alias("token"))
    return tokens.select("doc_id", "token", F.round(shannon_entropy(F.col("token")), 4).alias("entropy"))
