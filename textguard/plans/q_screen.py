"""Contract queries for normalisation and the prompt/response screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import placeholder_email, with_normalized
from textguard.operators import screen as S
from textguard.plans import oracle_sql as O
from textguard.plans.catalog import register
from textguard.plans.q_outfilter import DOCS_SQL, docs_with_planted
from textguard.sources.planted import planted_df, planted_values_sql
from textguard.sources.tables import read_table, spread_for_cpu

TURNS_SQL = ("(SELECT conv_id, turn, role, text FROM conversations UNION ALL "
             f"SELECT doc_id AS conv_id, 0::BIGINT AS turn, 'user' AS role, text FROM {planted_values_sql()})")


def turns_with_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations table plus the planted texts as one-turn user conversations."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = planted_df(spark).select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
                                       F.lit("user").alias("role"), "text")
    return spread_for_cpu(conv).unionByName(planted)


NORM_SQL = f"WITH src AS {DOCS_SQL}, {O.normalize_ctes('src').strip()}\nSELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE _norm END AS normalized FROM nz4"


@register("normalize_corpus", NORM_SQL)
def normalize_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """H1: de-obfuscated, normalised text of every document."""
    df = with_normalized(docs_with_planted(spark, sf), "text", "normalized")
    return df.select("doc_id", "normalized")


EMAIL_RX = L.PROMPT_PII_RULES[0][1]
PLACEHOLDER_SQL = (f"WITH src AS {DOCS_SQL}, e AS (SELECT doc_id, text, unnest(regexp_extract_all(coalesce(text, ''), "
                   f"{O.q(EMAIL_RX)})) AS email FROM src)\nSELECT doc_id, email, "
                   f"{O.placeholder_email('email', 'text')} AS is_placeholder FROM e")


@register("placeholder_emails", PLACEHOLDER_SQL)
def placeholder_emails(spark: SparkSession, sf: str) -> DataFrame:
    """H7: every e-mail address found, with the placeholder verdict in its document's context."""
    df = docs_with_planted(spark, sf)
    e = df.select("doc_id", "text", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(EMAIL_RX),
                                                                  F.lit(0))).alias("email"))
    return e.select("doc_id", "email", placeholder_email(F.col("email"), F.col("text")).alias("is_placeholder"))


def _pa_sql(select: str, src: str = DOCS_SQL) -> str:
    return f"WITH src AS {src}, {O.prompt_ctes('src').strip()}\nSELECT {select} FROM pa2"


@register("prompt_jailbreak", _pa_sql("doc_id, pa_flagged AS jailbreak_detected, pa_jb_score AS jailbreak_score, "
                                      "array_to_string(jb_hits[1:3], ', ') AS patterns"))
def prompt_jailbreak(spark: SparkSession, sf: str) -> DataFrame:
    """Jailbreak patterns on the lower-case or normalised prompt; 0.2 each, uncapped."""
    df = S.with_prompt_analysis(docs_with_planted(spark, sf), "text")
    p = F.col("prompt")
    return df.select("doc_id", p["jailbreak_detected"].alias("jailbreak_detected"),
                     p["jailbreak_score"].alias("jailbreak_score"),
                     F.array_join(F.slice(p["jailbreak_patterns"], 1, 3), ", ").alias("patterns"))


@register("prompt_pii", _pa_sql("doc_id, pa_pii AS pii_detected, array_to_string(pii_found, ', ') AS pii_found"))
def prompt_pii(spark: SparkSession, sf: str) -> DataFrame:
    """PII presence on the prompt side (first match per type, placeholder and password rules)."""
    df = S.with_prompt_analysis(docs_with_planted(spark, sf), "text")
    p = F.col("prompt")
    return df.select("doc_id", p["pii_detected"].alias("pii_detected"),
                     F.array_join(p["pii_found"], ", ").alias("pii_found"))


@register("prompt_analysis", _pa_sql("conv_id, turn, pa_flagged AS is_flagged, pa_flagged AS jailbreak_detected, "
                                     "pa_pii AS pii_detected, pa_jb_score AS jailbreak_score, pa_expl AS explanation",
                                     TURNS_SQL))
def prompt_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The combined prompt record for every conversation turn."""
    df = S.with_prompt_analysis(turns_with_planted(spark, sf), "text")
    p = F.col("prompt")
    return df.select("conv_id", "turn", p["is_flagged"].alias("is_flagged"),
                     p["jailbreak_detected"].alias("jailbreak_detected"), p["pii_detected"].alias("pii_detected"),
                     p["jailbreak_score"].alias("jailbreak_score"), p["explanation"].alias("explanation"))


def _ra_sql(select: str, src: str = DOCS_SQL) -> str:
    return f"WITH src AS {src}, {O.response_ctes('src').strip()}\nSELECT {select} FROM ra2"


@register("lexicon_toxicity", _ra_sql("doc_id, ra_tox AS toxicity_detected, ra_score AS toxicity_score, "
                                      "array_to_string(lex_hits, ', ') AS keywords"))
def lexicon_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """25-term lexicon on the lower-case or normalised text; 0.2 each, uncapped."""
    df = S.with_response_analysis(docs_with_planted(spark, sf), "text")
    r = F.col("response")
    return df.select("doc_id", r["toxicity_detected"].alias("toxicity_detected"),
                     r["toxicity_score"].alias("toxicity_score"), F.array_join(r["keywords"], ", ").alias("keywords"))


@register("harmful_instructions", _ra_sql("doc_id, harmful, ra_flagged AS is_flagged, ra_tox AS toxicity_detected, "
                                          "ra_expl AS explanation"))
def harmful_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Instruction phrase + harmful word flags the text and replaces the explanation."""
    df = S.with_response_analysis(docs_with_planted(spark, sf), "text")
    r = F.col("response")
    return df.select("doc_id", r["harmful"].alias("harmful"), r["is_flagged"].alias("is_flagged"),
                     r["toxicity_detected"].alias("toxicity_detected"), r["explanation"].alias("explanation"))


@register("response_analysis", _ra_sql("conv_id, turn, ra_flagged AS is_flagged, ra_tox AS toxicity_detected, "
                                       "ra_score AS toxicity_score, ra_expl AS explanation", TURNS_SQL))
def response_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The combined response record for every conversation turn."""
    df = S.with_response_analysis(turns_with_planted(spark, sf), "text")
    r = F.col("response")
    return df.select("conv_id", "turn", r["is_flagged"].alias("is_flagged"),
                     r["toxicity_detected"].alias("toxicity_detected"), r["toxicity_score"].alias("toxicity_score"),
                     r["explanation"].alias("explanation"))


@register("prompt_intent", f"WITH src AS {TURNS_SQL}\nSELECT conv_id, turn, {O.prompt_intent('text')} AS intent FROM src "
                           "WHERE role = 'user'")
def prompt_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Canned-reply class of every user turn (greeting, help, question, other)."""
    df = turns_with_planted(spark, sf).filter(F.col("role") == "user")
    return df.select("conv_id", "turn", S.prompt_intent(F.col("text")).alias("intent"))
