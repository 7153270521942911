"""Contract queries for the output filter (D15-D20, P2) over documents and planted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.operators import outfilter as OF
from textguard.operators import textmodel as TM
from textguard.plans import oracle_sql as O
from textguard.plans.catalog import register
from textguard.session import written
from textguard.sources.planted import planted_df, planted_values_sql
from textguard.sources.tables import read_table, spread_for_cpu

DOCS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {planted_values_sql()})"


def docs_with_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents table plus the planted rows, spread over the task slots."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return spread_for_cpu(docs).unionByName(planted_df(spark))


def _of_sql(select: str) -> str:
    return f"WITH src AS {DOCS_SQL}, {O.output_filter_ctes('src')}\nSELECT {select} FROM of6"


TOX_SQL = _of_sql(", ".join([
    "doc_id",
    "tox_det AS toxicity_detected",
    "tox_score AS toxicity_score",
    "tox_sev AS severity",
    "array_to_string(tox_kws, ', ') AS keywords",
    "array_to_string(tox_phs, ', ') AS phrases",
    "round(tox_sent, 4) AS sentiment_score",
]))


@register("toxicity_scores", TOX_SQL)
def toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted toxicity of every document (keywords 0.2, phrases 0.5, negative sentiment 0.3)."""
    df = OF.with_toxicity(docs_with_planted(spark, sf), "text")
    t = F.col("toxicity")
    return df.select(
        "doc_id",
        t["detected"].alias("toxicity_detected"),
        t["score"].alias("toxicity_score"),
        t["severity"].alias("severity"),
        F.array_join(t["keywords"], ", ").alias("keywords"),
        F.array_join(t["phrases"], ", ").alias("phrases"),
        F.round(t["sentiment"], 4).alias("sentiment_score"),
    )


SENT_SQL = _of_sql(", ".join(["doc_id", "round(tox_sent, 4) AS sentiment_score"]))


@register("sentiment_scores", SENT_SQL)
def sentiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rule sentiment in [-1, 1] per document."""
    df = docs_with_planted(spark, sf)
    return df.select("doc_id", F.round(OF.sentiment_score(F.coalesce(F.col("text"), F.lit(""))), 4)
                     .alias("sentiment_score"))


BIAS_SQL = _of_sql(", ".join([
    "doc_id",
    "bias_det AS bias_detected",
    "array_to_string(bias_types, ', ') AS bias_types",
    "bias_score AS bias_score",
    "bias_sev AS severity",
]))


@register("bias_flags", BIAS_SQL)
def bias_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rule bias types (first matching pattern per type), 0.3 per type."""
    df = OF.with_bias(docs_with_planted(spark, sf), "text")
    b = F.col("bias")
    return df.select("doc_id", b["detected"].alias("bias_detected"),
                     F.array_join(b["types"], ", ").alias("bias_types"),
                     b["score"].alias("bias_score"), b["severity"].alias("severity"))


JB_SQL = _of_sql(", ".join([
    "doc_id",
    "jb_det AS jailbreak_detected",
    "jb_score AS jailbreak_score",
    "jb_sev AS severity",
    "array_to_string(jb_hits[1:3], ' || ') AS indicators",
]))


@register("output_jailbreak", JB_SQL)
def output_jailbreak(spark: SparkSession, sf: str) -> DataFrame:
    """Jailbreak indicators in a response; 0.4 each, capped at 1.0; first 3 listed."""
    df = OF.with_output_jailbreak(docs_with_planted(spark, sf), "text")
    j = F.col("jailbreak")
    return df.select("doc_id", j["detected"].alias("jailbreak_detected"), j["score"].alias("jailbreak_score"),
                     j["severity"].alias("severity"), F.array_join(j["indicators"], " || ").alias("indicators"))


VERDICT_SQL = _of_sql(", ".join([
    "doc_id",
    "of_flagged AS is_flagged",
    "tox_det AS toxicity_detected",
    "bias_det AS bias_detected",
    "jb_det AS jailbreak_detected",
    "tox_score AS toxicity_score",
    "bias_score AS bias_score",
    "jb_score AS jailbreak_score",
    "of_sev AS severity",
    "of_expl AS explanation",
    "of_strategy AS sanitization_strategy",
]))


@register("filter_verdicts", VERDICT_SQL)
def filter_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Combined verdict (flag, max severity, explanation, strategy) per document."""
    df = OF.with_output_filter(docs_with_planted(spark, sf), "text")
    v = F.col("verdict")
    return df.select("doc_id", v["is_flagged"].alias("is_flagged"),
                     v["toxicity_detected"].alias("toxicity_detected"), v["bias_detected"].alias("bias_detected"),
                     v["jailbreak_detected"].alias("jailbreak_detected"), v["toxicity_score"].alias("toxicity_score"),
                     v["bias_score"].alias("bias_score"), v["jailbreak_score"].alias("jailbreak_score"),
                     v["severity"].alias("severity"), v["explanation"].alias("explanation"),
                     v["sanitization_strategy"].alias("sanitization_strategy"))


SANITIZED_SQL = _of_sql(", ".join([
    "doc_id",
    "of_strategy AS sanitization_strategy",
    "of_filtered AS filtered_response",
    f"""CASE WHEN text IS NULL THEN NULL
         WHEN of_flagged AND (of_filtered IS NULL OR of_filtered = '') THEN {O.q(OF.L.MSG_BLOCKED)}
         WHEN of_filtered IS NOT NULL AND of_filtered <> '' THEN of_filtered ELSE text END AS final_text""",
]))


@register("sanitized_text", SANITIZED_SQL)
def sanitized_text(spark: SparkSession, sf: str) -> DataFrame:
    """D20 + P2: sanitised response under the default strategies and the text finally shown."""
    df = OF.with_output_filter(docs_with_planted(spark, sf), "text")
    v = F.col("verdict")
    return df.select("doc_id", v["sanitization_strategy"].alias("sanitization_strategy"),
                     v["filtered_response"].alias("filtered_response"),
                     F.when(F.col("text").isNotNull(), OF.final_text(F.col("text"), v)).alias("final_text"))


# Toxicity: a model fitted on the table labels. Bias: one model a label, taught by the rules' own verdicts, since no table
# holds bias labels; a label that no rule found has no terms, and a row without a known term keeps the rules.
_TERMS_SQL = f"src0 AS {DOCS_SQL}, terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\pL+')) AS term FROM src0)"
_RULES_SQL = O.namespaced(O.output_filter_ctes("src0").strip(), "rule")


def _bias_label_sql(label: str) -> str:
    return f"SELECT doc_id, CAST(list_contains(bias_types, '{label}') AS INT) AS y FROM rule_of6"


MODEL_SQL = ("WITH " + ",\n".join([_TERMS_SQL, _RULES_SQL, TM.oracle_ctes("tox", "SELECT doc_id, toxic AS y FROM labels"),
                                   *(TM.oracle_ctes(x, _bias_label_sql(x)) for x in L.BIAS_MODEL_LABELS)]) + """,
src AS (SELECT s.*, t.p AS tp, CASE WHEN """ + " OR ".join(f"{x}.p IS NOT NULL" for x in L.BIAS_MODEL_LABELS) + " THEN list_value("
             + ", ".join(f"coalesce({x}.p, 0.0)" for x in L.BIAS_MODEL_LABELS) + """) END AS bp FROM src0 s
  LEFT JOIN tox_score t USING (doc_id) """ + " ".join(f"LEFT JOIN {x}_score {x} USING (doc_id)" for x in L.BIAS_MODEL_LABELS) + "),\n"
             + O.output_filter_ctes("src", tox_p="tp", bias_p="bp").strip() + "\nSELECT " + ", ".join([
                 "doc_id", "round(tp, 4) AS toxicity_probability", "round(bp[1], 4) AS bias_probability", "of_flagged AS is_flagged", "tox_det AS toxicity_detected",
                 "round(tox_score, 4) AS toxicity_score", "tox_sev AS toxicity_severity",
                 "bias_det AS bias_detected", "array_to_string(bias_types, ', ') AS bias_types", "round(bias_score, 4) AS bias_score", "of_sev AS severity",
                 "of_expl AS explanation", "of_strategy AS sanitization_strategy", "of_filtered AS filtered_response"]) + " FROM of6")


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, tp, bp): probabilities of the fitted models for every document with a known term."""
    docs = docs_with_planted(spark, sf)
    sets = written(TM.term_sets(docs), "term-sets")
    taught = OF.with_bias(docs, "text").select("doc_id", *(F.array_contains("bias.types", x).cast("int").alias(x) for x in L.BIAS_MODEL_LABELS))
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("tp"))
    out = TM.score_all(sets, TM.fit_all(sets, [(labels, ["tp"]), (taught, list(L.BIAS_MODEL_LABELS))]))
    some = F.greatest(*(F.col(x).isNotNull() for x in L.BIAS_MODEL_LABELS))
    return out.select("doc_id", "tp", F.when(some, F.array(*(F.coalesce(x, F.lit(0.0)) for x in L.BIAS_MODEL_LABELS))).alias("bp"))


@register("model_filter_verdicts", MODEL_SQL)
def model_filter_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """M7 (with M2, M6): verdict and sanitised text where a model scored the row, rules elsewhere."""
    d = docs_with_planted(spark, sf).join(model_scores(spark, sf), "doc_id", "left")
    df = OF.with_output_filter(d, "text", toxicity_model="tp", bias_model="bp")
    v = F.col("verdict")
    return df.select("doc_id", F.round("tp", 4).alias("toxicity_probability"), F.round(F.get("bp", F.lit(0)), 4).alias("bias_probability"),
                     v["is_flagged"].alias("is_flagged"), v["toxicity_detected"].alias("toxicity_detected"),
                     F.round(v["toxicity_score"], 4).alias("toxicity_score"), v["toxicity"]["severity"].alias("toxicity_severity"),
                     v["bias_detected"].alias("bias_detected"), F.array_join(v["bias"]["types"], ", ").alias("bias_types"),
                     F.round(v["bias_score"], 4).alias("bias_score"), v["severity"].alias("severity"), v["explanation"].alias("explanation"),
                     v["sanitization_strategy"].alias("sanitization_strategy"), v["filtered_response"].alias("filtered_response"))
