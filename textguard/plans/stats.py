"""Dashboard analytics (A1-A18, F1, F5-F15, T1-T3) over the audit tables.

Every dashboard is one scan and one conditional aggregate (partial aggregation on
each partition, one small final merge), in place of the reference's separate count
queries. "Now" is an explicit ``as_of``: by default the latest time in the table
itself, taken as a scalar subquery, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """``round(num / den * 100, digits)``, 0 when the denominator is 0."""
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double") * 100.0, digits)).otherwise(F.lit(0.0))


def latest(df: DataFrame, ts: str) -> Column:
    """Scalar subquery: the latest ``ts`` of ``df`` (the default ``as_of``)."""
    return df.agg(F.max(ts)).scalar()


def since(ts: str, as_of: Column, interval: str) -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {interval}")


def event_log(events: DataFrame) -> DataFrame:
    """Security-event view of the ``events`` table: time, type, a severity band of the
    value, the conversation key carried in ``props``, flagged when the type is error."""
    sev = (F.when(F.col("value") >= 300, "critical").when(F.col("value") >= 200, "high")
           .when(F.col("value") >= 100, "medium").otherwise("low"))
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("type"),
        sev.alias("severity"), F.concat_ws(" ", "event_type", "props").alias("message"),
        F.get_json_object("props", "$.k").cast("bigint").alias("conversation_id"), "user_id",
        (F.col("event_type") == "error").alias("is_flagged"), F.col("value").alias("score"))


def security_logs(ex: DataFrame, events: DataFrame) -> DataFrame:
    """The analysis log - one prompt record per user turn, one response record per
    reply, plus every recorded event - in one wide schema (missing fields NULL)."""
    prompt = ex.select(F.lit("prompt_analysis").alias("type"), F.col("conv_id"), F.col("turn"),
                       F.col("text").alias("content"), F.col("pa.is_flagged").alias("is_flagged"),
                       F.col("pa.jailbreak_detected").alias("jailbreak_detected"),
                       F.col("pa.pii_detected").alias("pii_detected"),
                       F.col("pa.jailbreak_score").alias("score"))
    response = ex.filter(F.col("reply").isNotNull()).select(
        F.lit("response_analysis").alias("type"), F.col("conv_id"), F.col("next_turn").alias("turn"),
        F.col("reply").alias("content"), F.col("rtox.is_flagged").alias("is_flagged"),
        F.col("rtox.toxicity_detected").alias("toxicity_detected"), F.col("rtox.toxicity_score").alias("score"))
    evs = events.select(F.col("type"), F.col("source_conv_id").alias("conv_id"), "turn",
                        F.col("message").alias("content"), "is_flagged")
    return (prompt.unionByName(response, allowMissingColumns=True)
                  .unionByName(evs, allowMissingColumns=True))


def health_band(score: Column) -> Column:
    """green / yellow / red bands with their labels (the intended thresholds)."""
    (t1, c1, l1), (t2, c2, l2) = L.HEALTH_BANDS
    c3, l3 = L.HEALTH_ELSE
    return F.struct(F.when(score >= t1, c1).when(score >= t2, c2).otherwise(c3).alias("color"),
                    F.when(score >= t1, l1).when(score >= t2, l2).otherwise(l3).alias("label"))


MODULES = ["jailbreak_prompt", "pii_detected", "toxicity_detected", "bias_detected", "jailbreak_output"]


def module_counts(convs: DataFrame) -> DataFrame:
    """A8 module section: conversations per detection flag, and totals."""
    return convs.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        count_if(F.col("is_flagged")).alias("flagged_conversations"),
        count_if(F.col("jailbreak_detected")).alias("jailbreak_prompt"),
        count_if(F.col("pii_detected")).alias("pii_detected"),
        count_if(F.col("toxicity_detected")).alias("toxicity_detected"),
        count_if(F.col("bias_detected")).alias("bias_detected"),
        count_if(F.col("jailbreak_detected_in_output")).alias("jailbreak_output"),
    )


def unpivot_counts(one_row: DataFrame, names: list[str], name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Wide single-row counts to (name, value) rows."""
    return one_row.unpivot([], names, name_col, value_col)


def original_response(filtered: Column, content: Column, analysed: Column) -> Column:
    """the reply before filtering - ``filtered`` where it holds a text; else ``content``, but where that only stands for a
    filtered reply, the original kept with the analysis (``analysed``), if any."""
    stands_in = F.lit(False)
    for prefix in L.FILTERED_REPLY_PREFIXES:
        stands_in = stands_in | F.startswith(content, F.lit(prefix))
    return (F.when(filtered.isNotNull() & (filtered != ""), filtered)
            .when(F.coalesce(stands_in, F.lit(False)), F.coalesce(analysed, content)).otherwise(content))


def client_time(raw: Column, as_of: Column) -> Column:
    """the time a client shows for an event - a 'Z' behind an explicit offset is dropped; a missing, empty or unreadable
    time is ``as_of``."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "([+-]\\d{2}:\\d{2})Z$", "$1")), as_of)
