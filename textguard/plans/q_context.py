"""Contract queries for contexts (J4, T4), messages, deletions and creation by key (J1, S9, S10), originals of filtered replies (F9),
refused prompts and the security log as JSON lines (S2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.plans import context as CX
from textguard.plans import pipeline as PL
from textguard.plans import stats as ST
from textguard.plans import tables as T
from textguard.plans.oracle_sql import q, tstr
from textguard.plans.q_pipeline import TS_FMT, _state, contract_turns, conversations, exchanges, messages
from textguard.plans.q_stats import ELOG, FILTER_WHERE, LOGS, W, _filter_rows, event_log, logs, oracle
from textguard.plans.catalog import register
from textguard.session import ensure_checkpoint_dir
from textguard.sources.logs import scan_security_logs

# ---------------------------------------------------------------- J4, T4

_ENTRIES_SQL = W + """
, en AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS position, turn, lower(role) AS role,
    coalesce(CASE WHEN masked_content <> '' THEN masked_content END, content) AS content FROM msgs)
"""


@register("context_entries")
def context_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that contexts are made of, each stored once, in order of time."""
    return CX.context_entries(messages(spark, sf))


oracle("context_entries", _ENTRIES_SQL + "SELECT conversation_id, position, turn, role, content FROM en")


@register("context_lengths")
def context_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries precede each appended user turn, with the current turn once and twice."""
    entries = CX.context_entries(messages(spark, sf))
    once = CX.context_lengths(entries).withColumnRenamed("history", "history_once")
    return once.join(CX.context_lengths(entries, duplicate_current=True).withColumnRenamed("history", "history_twice"), ["conversation_id", "turn"])


oracle("context_lengths", _ENTRIES_SQL + """
SELECT conversation_id, turn, position - 1 AS history_once, position AS history_twice FROM en WHERE role = 'user'""")


@register("newest_contexts")
def newest_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole context of every conversation's newest user turn, as it should be and with the current turn twice."""
    entries = CX.context_entries(messages(spark, sf))

    def of(duplicate: bool) -> DataFrame:
        lengths = CX.context_lengths(entries, duplicate)
        newest = lengths.groupBy("conversation_id").agg(F.max("turn").alias("turn"), F.max_by("history", "turn").alias("history"))
        return CX.expand_contexts(entries, newest).withColumn("duplicate_current", F.lit(duplicate))
    return of(False).unionByName(of(True))


oracle("newest_contexts", _ENTRIES_SQL + """
, nw AS (SELECT conversation_id, max(turn) AS turn, max(position) AS p FROM en WHERE role = 'user' GROUP BY conversation_id),
v AS (SELECT nw.*, d.dup, p - CASE WHEN d.dup THEN 0 ELSE 1 END AS history FROM nw, (VALUES (FALSE), (TRUE)) AS d(dup))
SELECT v.conversation_id, v.turn, e.position, e.role, e.content, v.dup AS duplicate_current
  FROM v JOIN en e ON e.conversation_id = v.conversation_id AND e.position <= v.history
UNION ALL SELECT v.conversation_id, v.turn, v.history + 1, 'user', e.content, v.dup FROM v JOIN en e ON e.conversation_id = v.conversation_id AND e.turn = v.turn""")


# ---------------------------------------------------------------- J1, S9, S10

def requested_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation keys that clients ask for: those of the turn table, also of conversations that stored nothing, and of the event log."""
    return (contract_turns(spark, sf).select(F.col("conv_id").alias("id"))
            .unionByName(event_log(spark, sf).select(F.col("conversation_id").alias("id"))))


_REQ_SQL = ELOG + ", req AS (SELECT conv_id AS id FROM turns UNION SELECT conversation_id FROM elog WHERE conversation_id IS NOT NULL)"


@register("message_history")
def message_history(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of every requested conversation, with content and place in order of time."""
    found, _ = T.conversation_messages(conversations(spark, sf), messages(spark, sf), requested_ids(spark, sf))
    return found.select("conversation_id", F.col("position").cast("bigint").alias("position"), F.col("id").alias("message_id"), "title", "role", "content",
                        F.date_format("created_at", TS_FMT).alias("created_at"), "is_flagged", "pii_detected", "explanation")


oracle("message_history", W + _REQ_SQL + f"""
SELECT m.conversation_id, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.turn) AS position, m.id AS message_id, c.title, m.role, m.content,
  {tstr('m.created_at')} AS created_at, m.is_flagged, m.pii_detected, m.explanation
FROM msgs m JOIN convs c ON c.id = m.conversation_id WHERE c.id IN (SELECT id FROM req)""")


@register("messages_not_found")
def messages_not_found(spark: SparkSession, sf: str) -> DataFrame:
    """Requested keys that name no stored conversation, such as those whose every prompt was refused."""
    return T.conversation_messages(conversations(spark, sf), messages(spark, sf), requested_ids(spark, sf))[1]


oracle("messages_not_found", W + _REQ_SQL + " SELECT id FROM req WHERE id NOT IN (SELECT id FROM convs)")


def _delete_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth requested key."""
    return requested_ids(spark, sf).where(F.col("id") % 5 == 0)


@register("delete_outcomes")
def delete_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each delete request - deleted with so many messages, or not found."""
    return T.delete_outcomes(conversations(spark, sf), messages(spark, sf), _delete_requests(spark, sf))


oracle("delete_outcomes", W + _REQ_SQL + """
, n AS (SELECT conversation_id AS id, count(*) AS n FROM msgs GROUP BY conversation_id)
SELECT r.id, CASE WHEN c.id IS NULL THEN 'not found' ELSE 'deleted' END AS outcome, CASE WHEN c.id IS NULL THEN 0 ELSE coalesce(n.n, 0) END AS messages
FROM req r LEFT JOIN convs c ON c.id = r.id LEFT JOIN n ON n.id = r.id WHERE r.id % 5 = 0""")


@register("conversations_left")
def conversations_left(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations that remain after the delete requests."""
    left, _, _ = T.delete_cascade(conversations(spark, sf), messages(spark, sf), _delete_requests(spark, sf))
    return left.select("id", "title", "user_id", "exchanges")


oracle("conversations_left", W + " SELECT id, title, user_id, exchanges FROM convs WHERE id % 5 <> 0")


@register("get_or_create_requested")
def get_or_create_requested(spark: SparkSession, sf: str) -> DataFrame:
    """One conversation a requested key, created where none is stored."""
    return T.get_or_create(conversations(spark, sf).select("id", "title"), requested_ids(spark, sf).where(F.col("id").isNotNull()), "id").select("id", "title", "created")


oracle("get_or_create_requested", W + _REQ_SQL + " SELECT r.id, c.title, c.id IS NULL AS created FROM req r LEFT JOIN convs c ON c.id = r.id")


# ---------------------------------------------------------------- F9, refused prompts

@register("output_filter_originals")
def output_filter_originals(spark: SparkSession, sf: str) -> DataFrame:
    """the original of every filtered reply, as three versions of the store keep it: in ``filtered_content``; with the analysis,
    beside an empty ``filtered_content``; nowhere."""
    m = _filter_rows(messages(spark, sf))
    version = F.pmod(F.col("conversation_id") + F.col("turn"), F.lit(3))
    kept = F.when(version == 0, F.col("filtered_content")).when(version == 1, F.lit(""))
    analysed = F.when(version == 1, F.col("filtered_content"))
    return m.select("id", version.alias("version"), F.col("content").alias("shown"), ST.original_response(kept, F.col("content"), analysed).alias("original"))


_STANDS_IN = "(" + " OR ".join(f"starts_with(content, {q(p)})" for p in L.FILTERED_REPLY_PREFIXES) + ")"
oracle("output_filter_originals", W + f"""
, v AS (SELECT *, ((conversation_id + turn) % 3 + 3) % 3 AS version FROM msgs WHERE {FILTER_WHERE})
SELECT id, version, content AS shown, CASE WHEN version = 0 AND filtered_content <> '' THEN filtered_content
  WHEN version = 1 AND {_STANDS_IN} THEN coalesce(filtered_content, content) ELSE content END AS original FROM v""")


@register("refused_prompts")
def refused_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts that were refused before anything was stored, and what the user is told."""
    return PL.refused_turns(exchanges(spark, sf))


oracle("refused_prompts", W + f"""
SELECT conv_id, turn, {q(L.MSG_REFUSED)} AS message, pa_expl AS explanation, pa_jb_score AS jailbreak_score, pa_pii AS pii_detected FROM ex2 WHERE refused""")


# ---------------------------------------------------------------- S2

_LINES: dict[tuple, str] = {}


# Which lines drift, misfit and end early, in SQL that both engines read.
DRIFTED = "((conv_id + turn) % 3 + 3) % 3 = 0"
MISFIT = "type = 'prompt_analysis' AND ((conv_id + turn) % 13 + 13) % 13 = 5"
CUT = "((conv_id * 31 + turn * 7) % 97 + 97) % 97 = 0"


def log_lines(spark: SparkSession, sf: str) -> str:
    """The folder of the security log as JSON lines, written once per application and state of the table. The writers differ: a third of the
    records hold the score as text and a field of their own, some prompt records say 'unknown' for a flag, and some lines end early."""
    key = (spark.sparkContext.applicationId, sf, *_state(spark, sf))
    if key not in _LINES:
        lg = logs(spark, sf)
        flag = F.when(F.expr(MISFIT), F.lit("unknown")).otherwise(F.col("pii_detected").cast("string"))
        others = [F.col(c) for c in lg.columns if c not in ("score", "pii_detected")]
        plain = F.to_json(F.struct(*lg.columns))
        drifted = F.to_json(F.struct(*others, F.col("score").cast("string").alias("score"), flag.alias("pii_detected"), F.lit("v2").alias("client")))
        line = F.when(F.expr(DRIFTED) | F.expr(MISFIT), drifted).otherwise(plain)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/security-log-{uuid.uuid4().hex}"
        lg.select(F.when(F.expr(CUT), F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value")).write.text(path)
        _LINES[key] = path
    return _LINES[key]


@register("security_log_lines")
def security_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The security log scanned from JSON lines of several writers, per record type; lines that end early counted apart."""
    s = scan_security_logs(spark, log_lines(spark, sf))
    bad = F.col("bad_line").isNotNull()
    return s.groupBy(F.coalesce("type", F.lit("bad line")).alias("record_type")).agg(
        F.count_if(~bad).alias("records"), F.count_if(bad).alias("bad_lines"), F.count_if(F.size("bad_fields") > 0).alias("misfits"),
        ST.count_if(F.col("is_flagged")).alias("flagged"), ST.count_if(F.col("pii_detected")).alias("pii"),
        F.count("score").alias("scored"), F.round(F.sum("score"), 4).alias("score_sum"))


oracle("security_log_lines", W + LOGS + f"""
, ln AS (SELECT *, {CUT} AS cut, {MISFIT} AS misfit FROM logs)
SELECT CASE WHEN cut THEN 'bad line' ELSE type END AS record_type, count_if(NOT cut) AS records, count_if(cut) AS bad_lines, count_if(NOT cut AND misfit) AS misfits,
  count_if(NOT cut AND coalesce(is_flagged, FALSE)) AS flagged, count_if(NOT cut AND NOT misfit AND coalesce(pii_detected, FALSE)) AS pii,
  count(CASE WHEN NOT cut THEN score END) AS scored, round(sum(CASE WHEN NOT cut THEN score END), 4) AS score_sum FROM ln GROUP BY 1""")
