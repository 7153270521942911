"""Contract queries for the guarded pipeline."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.ordered import blocked_running_sum
from textguard.plans import oracle_sql as O
from textguard.plans import pipeline as PL
from textguard.plans.catalog import register
from textguard.session import ensure_checkpoint_dir
from textguard.sources.planted import planted_turns, planted_values_sql
from textguard.sources.tables import read_table

TS_FMT = "yyyy-MM-dd HH:mm:ss"


@lru_cache(maxsize=1)
def pipe_with() -> str:
    return "WITH " + O.pipeline_ctes(planted_values_sql()) + "\n"


_WRITTEN: dict[tuple, str] = {}


def contract_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations and the planted ones, so every rule meets the pipeline."""
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted_turns(spark))


def _state(spark: SparkSession, sf: str) -> tuple:
    """What identifies the content of the conversations table: its rows, files and newest change (no column is read)."""
    t = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet")
    return tuple(t.agg(F.count(F.lit(1)), F.count_distinct("_metadata.file_path"), F.max("_metadata.file_modification_time")).first())


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """The guarded exchanges of (conversations + planted turns): screened and written once per
    application and state of the table, in the shared folder, and read from there by every query
    over the audit tables."""
    key = (spark.sparkContext.applicationId, sf, *_state(spark, sf))
    path = _WRITTEN.get(key)
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
        PL.guarded_exchanges(contract_turns(spark, sf)).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored messages derived from the conversations table by the guarded pipeline."""
    return PL.stored_messages(exchanges(spark, sf))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return PL.conversation_rollup(exchanges(spark, sf))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return PL.security_events(exchanges(spark, sf))


@register("turn_pairs")
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the turn after it; an exchange is a user turn answered by the assistant."""
    p = PL.pair_turns(contract_turns(spark, sf))
    return p.select("conv_id", "turn", "role", F.col("next_turn").cast("string").alias("next_turn"), "next_role", "next_text",
                    ((F.col("role") == "user") & F.coalesce(F.col("next_role") == "assistant", F.lit(False)))
                    .alias("is_exchange"))


TURN_PAIRS_SQL_TAIL = """
SELECT conv_id, turn, role, CAST(next_turn AS VARCHAR) AS next_turn, next_role, next_text, (role = 'user' AND coalesce(next_role = 'assistant', FALSE)) AS is_exchange FROM follow"""


MSG_SELECT = ("id, conversation_id, turn, role, content, " + O.tstr("created_at") + " AS created_at, is_flagged, "
              "jailbreak_score, toxicity_score, pii_detected, explanation, original_content, masked_content, n_mappings, "
              "filtered_content, bias_detected, bias_score, jailbreak_detected_in_output, jailbreak_score_in_output, "
              "has_filter_analysis, fa_severity, sanitization_strategy")


def flat_messages(m: DataFrame) -> DataFrame:
    return m.select("id", "conversation_id", "turn", "role", "content",
                    F.date_format("created_at", TS_FMT).alias("created_at"), "is_flagged", "jailbreak_score",
                    "toxicity_score", "pii_detected", "explanation", "original_content", "masked_content",
                    F.col("n_mappings").cast("bigint").alias("n_mappings"), "filtered_content", "bias_detected",
                    "bias_score", "jailbreak_detected_in_output", "jailbreak_score_in_output",
                    F.col("filter_analysis").isNotNull().alias("has_filter_analysis"),
                    F.col("filter_analysis.severity").alias("fa_severity"), "sanitization_strategy")


@register("guarded_messages")
def guarded_messages(spark: SparkSession, sf: str) -> DataFrame:
    """P1/P2/P4 + S3/S4: the messages the guarded pipeline stores for every exchange."""
    return flat_messages(messages(spark, sf))


EVT_SELECT = ("id, " + O.tstr("timestamp") + " AS timestamp, source_conv_id, turn, seq, type, severity, message, "
              "CAST(conversation_id AS VARCHAR) AS conversation_id, user_id, is_flagged, explanation, jailbreak_score, toxicity_score")


@register("security_events_emit")
def security_events_emit(spark: SparkSession, sf: str) -> DataFrame:
    """P3 + S5: security events recorded by the pipeline (ordered per exchange by ``seq``)."""
    e = events(spark, sf)
    # conversation_id is NULL for toxic-prompt events (recorded before the conversation
    # exists); it is rendered as text so the column has one representation everywhere.
    return (e.withColumn("timestamp", F.date_format("timestamp", TS_FMT))
             .withColumn("conversation_id", F.col("conversation_id").cast("string")))


CONV_SELECT = ("id, title, user_id, " + O.tstr("created_at") + " AS created_at, is_flagged, jailbreak_detected, "
               "pii_detected, toxicity_detected, bias_detected, jailbreak_detected_in_output, any_flagged, any_toxicity, "
               "exchanges")


@register("conversation_rollup")
def conversation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation flags as the last exchange left them (and the OR over all exchanges)."""
    c = conversations(spark, sf)
    return c.withColumn("created_at", F.date_format("created_at", TS_FMT))


@register("assemble_context")
def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    """The model context of every stored user turn - the conversation's stored messages
    so far in time order (masked text when present), then the current masked turn. Kept
    linear in size: per turn the context length in messages and characters, computed with
    skew-proof running sums, plus the current entry (role lower-cased, content)."""
    m = messages(spark, sf).select(
        "conversation_id", "turn", "role", "created_at",
        F.coalesce(F.when(F.col("masked_content") != "", F.col("masked_content")), F.col("content")).alias("llm_content"))
    m = m.withColumn("_one", F.lit(1)).withColumn("_chars", F.coalesce(F.length("llm_content"), F.lit(0)))
    m = blocked_running_sum(m, "conversation_id", "turn", "_one", "history_messages", inclusive=True)
    m = blocked_running_sum(m, "conversation_id", "turn", "_chars", "history_chars", inclusive=True)
    return (m.filter(F.col("role") == "USER")
             .select("conversation_id", "turn", F.lower("role").alias("llm_role"), "llm_content",
                     F.col("history_messages").cast("bigint").alias("context_messages"),
                     F.col("history_chars").cast("bigint").alias("context_chars")))


ASSEMBLE_SQL_TAIL = """, lc AS (SELECT conversation_id, turn, role,
    coalesce(CASE WHEN masked_content <> '' THEN masked_content END, content) AS llm_content FROM msgs)
SELECT conversation_id, turn, lower(role) AS llm_role, llm_content, context_messages, context_chars FROM (
  SELECT *, count(*) OVER w AS context_messages, CAST(sum(coalesce(length(llm_content), 0)) OVER w AS BIGINT) AS context_chars
  FROM lc WINDOW w AS (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE role = 'USER'"""


@register("basic_messages")
def basic_messages(spark: SparkSession, sf: str) -> DataFrame:
    """P5: the simple pipeline - prompt screen and lexicon screens only, per exchange."""
    ex = PL.basic_exchanges(contract_turns(spark, sf))
    return ex.select("conv_id", "turn", F.col("pa.is_flagged").alias("prompt_flagged"),
                     F.col("pa.jailbreak_score").alias("jailbreak_score"), F.col("pa.pii_detected").alias("pii_detected"),
                     F.col("ptox.toxicity_detected").alias("prompt_toxic"),
                     F.col("rtox.is_flagged").alias("reply_flagged"), F.col("rtox.toxicity_score").alias("reply_toxicity"),
                     F.coalesce(F.col("pa.explanation"), F.col("rtox.explanation")).alias("explanation"))


BASIC_SQL_TAIL = """
SELECT conv_id, turn, refused AS prompt_flagged, pa_jb_score AS jailbreak_score, pa_pii AS pii_detected,
  ptox AS prompt_toxic, r_flagged AS reply_flagged, r_score AS reply_toxicity, coalesce(pa_expl, r_expl) AS explanation
FROM ex2"""


def _finish_oracles():
    from textguard.plans.catalog import ORACLES
    w = pipe_with()
    ORACLES["turn_pairs"] = w + TURN_PAIRS_SQL_TAIL
    ORACLES["guarded_messages"] = w + "SELECT " + MSG_SELECT + " FROM msgs"
    ORACLES["security_events_emit"] = w + "SELECT " + EVT_SELECT + " FROM evts"
    ORACLES["conversation_rollup"] = w + "SELECT " + CONV_SELECT + " FROM convs"
    ORACLES["assemble_context"] = w.rstrip("\n") + ASSEMBLE_SQL_TAIL
    ORACLES["basic_messages"] = w + BASIC_SQL_TAIL


_finish_oracles()
