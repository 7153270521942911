"""Contract queries for the dashboards and audit-table operations (A1-A18, F1, F5-F12,
F15, T1-T3, S2, S6-S11, J1, J2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import truncate_with_ellipsis
from textguard.operators.ordered import nearest_rank_percentiles
from textguard.plans import stats as ST
from textguard.plans.catalog import ORACLES, register
from textguard.plans.oracle_sql import ordered_distinct, q, tstr
from textguard.plans.q_pipeline import TS_FMT, conversations, events, exchanges, messages, pipe_with
from textguard.sources.tables import read_table

W = pipe_with().rstrip("\n")
ELOG = """, elog AS (SELECT event_id AS id, ts AS timestamp, event_type AS type,
    CASE WHEN value >= 300 THEN 'critical' WHEN value >= 200 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS severity,
    event_type || ' ' || props AS message, CAST(json_extract_string(props, '$.k') AS BIGINT) AS conversation_id, user_id,
    event_type = 'error' AS is_flagged, value AS score FROM events)"""
LOGS = """, logs AS (
  SELECT 'prompt_analysis' AS type, conv_id, turn, text AS content, refused AS is_flagged, refused AS jailbreak_detected,
         pa_pii AS pii_detected, CAST(NULL AS BOOLEAN) AS toxicity_detected, pa_jb_score AS score FROM ex2
  UNION ALL SELECT 'response_analysis', conv_id, next_turn, reply, r_flagged, NULL, NULL, r_tox, r_score FROM ex2
    WHERE reply IS NOT NULL
  UNION ALL SELECT type, source_conv_id, turn, message, is_flagged, NULL, NULL, NULL, NULL FROM evts)"""
MSG_ASOF = "(SELECT max(created_at) FROM msgs)"
CONV_ASOF = "(SELECT max(created_at) FROM convs)"


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; cast each call to BIGINT like Spark's count_if."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = _bigint_counts(sql)


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return ST.event_log(read_table(spark, sf, "events"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return ST.security_logs(exchanges(spark, sf), events(spark, sf))


# ---------------------------------------------------------------- A1, S6

@register("security_log_stats")
def security_log_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses in the security log and the flagged share."""
    g = logs(spark, sf).agg(
        F.count(F.lit(1)).alias("total_analyses"), ST.count_if(F.col("is_flagged")).alias("flagged_analyses"),
        ST.count_if(F.col("jailbreak_detected")).alias("jailbreak_attempts"),
        ST.count_if(F.col("pii_detected")).alias("pii_detections"),
        ST.count_if(F.col("toxicity_detected")).alias("toxicity_detections"))
    return g.withColumn("flag_rate", ST.pct(F.col("flagged_analyses"), F.col("total_analyses"), 4))


oracle("security_log_stats", W + LOGS + """
SELECT count(*) AS total_analyses, count_if(coalesce(is_flagged, FALSE)) AS flagged_analyses,
  count_if(coalesce(jailbreak_detected, FALSE)) AS jailbreak_attempts, count_if(coalesce(pii_detected, FALSE)) AS pii_detections,
  count_if(coalesce(toxicity_detected, FALSE)) AS toxicity_detections,
  CASE WHEN count(*) > 0 THEN round(count_if(coalesce(is_flagged, FALSE)) / count(*) * 100.0, 4) ELSE 0.0 END AS flag_rate
FROM logs""")


@register("analysis_log_preview")
def analysis_log_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis-log records with a 100-character preview (plus '...')."""
    lg = logs(spark, sf).filter(F.col("type").isin("prompt_analysis", "response_analysis"))
    return lg.select("type", "conv_id", "turn", truncate_with_ellipsis(F.col("content"), L.TRUNC_PREVIEW).alias("preview"),
                     "is_flagged", "score")


oracle("analysis_log_preview", W + LOGS + f"""
SELECT type, conv_id, turn, CASE WHEN length(content) > {L.TRUNC_PREVIEW} THEN substr(content, 1, {L.TRUNC_PREVIEW}) || '...'
  ELSE content END AS preview, is_flagged, score FROM logs WHERE type IN ('prompt_analysis', 'response_analysis')""")


# ---------------------------------------------------------------- A2 platform stats

@register("platform_security_stats")
def platform_security_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A2: users, conversations by flag, messages, log totals and the last 24 hours."""
    c = conversations(spark, sf)
    c = c.withColumn("_recent", ST.since("created_at", ST.latest(c, "created_at"), "24 HOURS"))
    recent = F.col("_recent")
    users = event_log(spark, sf).agg(F.countDistinct("user_id")).scalar()
    m = messages(spark, sf).agg(F.count(F.lit(1)).alias("n"), ST.count_if(F.col("pii_detected")).alias("p"))
    lg = logs(spark, sf).agg(F.count(F.lit(1)).alias("n"), ST.count_if(F.col("is_flagged")).alias("f"))
    conv = c.agg(
        F.count(F.lit(1)).alias("total_conversations"), ST.count_if(F.col("is_flagged")).alias("flagged_conversations"),
        ST.count_if(F.col("jailbreak_detected")).alias("jailbreak_attempts"),
        ST.count_if(F.col("pii_detected")).alias("pii_detections"),
        ST.count_if(F.col("toxicity_detected")).alias("toxicity_detections"),
        ST.count_if(recent).alias("recent_conversations"),
        ST.count_if(recent & F.col("is_flagged")).alias("recent_flagged"))
    return conv.select(
        users.alias("total_users"), "*",
        m.select("n").scalar().alias("total_messages"), m.select("p").scalar().alias("pii_messages"),
        lg.select("n").scalar().alias("total_security_logs"), lg.select("f").scalar().alias("flagged_security_logs"),
        ST.pct(F.col("flagged_conversations"), F.col("total_conversations"), 4).alias("flag_rate"))


oracle("platform_security_stats", W + LOGS + ELOG + f"""
SELECT (SELECT count(DISTINCT user_id) FROM elog) AS total_users, count(*) AS total_conversations,
  count_if(is_flagged) AS flagged_conversations, count_if(jailbreak_detected) AS jailbreak_attempts,
  count_if(pii_detected) AS pii_detections, count_if(toxicity_detected) AS toxicity_detections,
  count_if(created_at >= {CONV_ASOF} - INTERVAL 24 HOURS) AS recent_conversations,
  count_if(created_at >= {CONV_ASOF} - INTERVAL 24 HOURS AND is_flagged) AS recent_flagged,
  (SELECT count(*) FROM msgs) AS total_messages, (SELECT count_if(pii_detected) FROM msgs) AS pii_messages,
  (SELECT count(*) FROM logs) AS total_security_logs, (SELECT count_if(coalesce(is_flagged, FALSE)) FROM logs) AS flagged_security_logs,
  CASE WHEN count(*) > 0 THEN round(count_if(is_flagged) / count(*) * 100.0, 4) ELSE 0.0 END AS flag_rate
FROM convs""")


# ---------------------------------------------------------------- A3, A4, A5

@register("dashboard_stats")
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A3: messages, PII (total and last 24 h), jailbreak attempts (F4), toxicity."""
    m = messages(spark, sf)
    m = m.withColumn("_recent", ST.since("created_at", ST.latest(m, "created_at"), "24 HOURS"))
    return m.agg(
        F.count(F.lit(1)).alias("total_messages"),
        ST.count_if(F.col("pii_detected") & F.col("_recent")).alias("recent_pii_detections"),
        ST.count_if(F.col("pii_detected")).alias("total_pii_detections"),
        ST.count_if(F.col("jailbreak_score").isNotNull() | F.col("jailbreak_detected_in_output")).alias("jailbreak_attempts"),
        ST.count_if(F.col("toxicity_score").isNotNull() & (F.col("toxicity_score") > 0)).alias("toxicity_detected"))


oracle("dashboard_stats", W + f"""
SELECT count(*) AS total_messages, count_if(pii_detected AND created_at >= {MSG_ASOF} - INTERVAL 24 HOURS) AS recent_pii_detections,
  count_if(pii_detected) AS total_pii_detections,
  count_if(jailbreak_score IS NOT NULL OR jailbreak_detected_in_output) AS jailbreak_attempts,
  count_if(toxicity_score IS NOT NULL AND toxicity_score > 0) AS toxicity_detected FROM msgs""")


@register("privacy_stats")
def privacy_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A4: PII messages, masked messages, last 24 h, detection rate."""
    m = messages(spark, sf)
    m = m.withColumn("_recent", ST.since("created_at", ST.latest(m, "created_at"), "24 HOURS"))
    g = m.agg(ST.count_if(F.col("pii_detected")).alias("total_pii_detections"),
              ST.count_if(F.col("masked_content").isNotNull()).alias("masked_messages"),
              ST.count_if(F.col("pii_detected") & F.col("_recent")).alias("recent_pii_detections"),
              F.count(F.lit(1)).alias("total_messages"))
    return g.withColumn("pii_detection_rate", ST.pct(F.col("total_pii_detections"), F.col("total_messages")))


oracle("privacy_stats", W + f"""
SELECT count_if(pii_detected) AS total_pii_detections, count_if(masked_content IS NOT NULL) AS masked_messages,
  count_if(pii_detected AND created_at >= {MSG_ASOF} - INTERVAL 24 HOURS) AS recent_pii_detections, count(*) AS total_messages,
  CASE WHEN count(*) > 0 THEN round(count_if(pii_detected) / count(*) * 100.0, 2) ELSE 0.0 END AS pii_detection_rate
FROM msgs""")


@register("pii_by_type")
def pii_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """A5: mapping entries per PII type (entries, not detections: equal placeholders collapse)."""
    m = messages(spark, sf).filter(F.col("pii_detected") & F.col("pii_mappings").isNotNull())
    e = m.select(F.explode(F.map_values("pii_mappings")).alias("v"))
    return e.groupBy(F.coalesce(F.col("v.type"), F.lit("unknown")).alias("pii_type")).agg(F.count(F.lit(1)).alias("count"))


oracle("pii_by_type", W + """
SELECT t AS pii_type, count(*) AS count FROM (SELECT unnest(map_types) AS t FROM msgs WHERE pii_detected AND n_mappings > 0)
GROUP BY t""")


# ---------------------------------------------------------------- A6, A7, A18

def _assistant(spark, sf):
    return messages(spark, sf).filter(F.col("role") == "ASSISTANT")


@register("output_filter_stats")
def output_filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged responses by reason, last 24 h, filter rate."""
    a = _assistant(spark, sf).withColumn(
        "_recent", ST.since("created_at", ST.latest(messages(spark, sf), "created_at"), "24 HOURS"))
    fl = F.col("is_flagged")
    g = a.agg(ST.count_if(fl).alias("total_filtered"),
              ST.count_if(fl & F.col("toxicity_score").isNotNull() & (F.col("toxicity_score") > 0)).alias("toxicity_detections"),
              ST.count_if(fl & F.col("bias_detected")).alias("bias_detections"),
              ST.count_if(fl & F.col("jailbreak_detected_in_output")).alias("jailbreak_in_output"),
              ST.count_if(fl & F.col("_recent")).alias("recent_filtered"),
              F.count(F.lit(1)).alias("total_responses"))
    return g.withColumn("filter_rate", ST.pct(F.col("total_filtered"), F.col("total_responses")))


oracle("output_filter_stats", W + f"""
SELECT count_if(is_flagged) AS total_filtered,
  count_if(is_flagged AND toxicity_score IS NOT NULL AND toxicity_score > 0) AS toxicity_detections,
  count_if(is_flagged AND bias_detected) AS bias_detections, count_if(is_flagged AND jailbreak_detected_in_output) AS jailbreak_in_output,
  count_if(is_flagged AND created_at >= {MSG_ASOF} - INTERVAL 24 HOURS) AS recent_filtered, count(*) AS total_responses,
  CASE WHEN count(*) > 0 THEN round(count_if(is_flagged) / count(*) * 100.0, 2) ELSE 0.0 END AS filter_rate
FROM msgs WHERE role = 'ASSISTANT'""")


@register("severity_distribution")
def severity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged responses with an analysis, per severity, zero-filled over the 4 levels."""
    a = _assistant(spark, sf).filter(F.col("is_flagged") & F.col("filter_analysis").isNotNull())
    sev = F.lower(F.col("filter_analysis.severity"))
    wide = a.agg(*[ST.count_if(sev == s).alias(s) for s in L.SEVERITY_LEVELS])
    return ST.unpivot_counts(wide, L.SEVERITY_LEVELS, "severity", "count")


oracle("severity_distribution", W + ", sd AS (SELECT lower(fa_severity) AS s FROM msgs WHERE role = 'ASSISTANT' AND is_flagged "
       "AND has_filter_analysis)\n" + " UNION ALL ".join(
           f"SELECT {q(s)} AS severity, (SELECT count_if(s = {q(s)}) FROM sd) AS count" for s in L.SEVERITY_LEVELS))


@register("sanitization_distribution")
def sanitization_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged responses with an analysis, per sanitisation strategy found."""
    a = _assistant(spark, sf).filter(F.col("is_flagged") & F.col("filter_analysis").isNotNull()
                                     & F.col("sanitization_strategy").isNotNull())
    return a.groupBy(F.col("sanitization_strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("count"))


oracle("sanitization_distribution", W + """
SELECT sanitization_strategy AS strategy, count(*) AS count FROM msgs
WHERE role = 'ASSISTANT' AND is_flagged AND has_filter_analysis AND sanitization_strategy IS NOT NULL GROUP BY 1""")


@register("module_counts_long")
def module_counts_long(spark: SparkSession, sf: str) -> DataFrame:
    """Chart rows - filter reasons, severities and strategies as (chart, name, value),
    names capitalised as the dashboard shows them."""
    s = output_filter_stats(spark, sf)
    reasons = ST.unpivot_counts(s.select(F.col("toxicity_detections").alias("Toxicity"),
                                         F.col("bias_detections").alias("Bias"),
                                         F.col("jailbreak_in_output").alias("Jailbreak")),
                                ["Toxicity", "Bias", "Jailbreak"]).withColumn("chart", F.lit("reasons"))
    sev = severity_distribution(spark, sf).select(F.lit("severity").alias("chart"), F.initcap("severity").alias("name"),
                                                  F.col("count").alias("value"))
    san = sanitization_distribution(spark, sf).select(F.lit("sanitization").alias("chart"),
                                                      F.initcap("strategy").alias("name"), F.col("count").alias("value"))
    return reasons.select("chart", "name", "value").unionByName(sev).unionByName(san)


def _cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


oracle("module_counts_long", W + f"""
, a AS (SELECT * FROM msgs WHERE role = 'ASSISTANT'),
sd AS (SELECT lower(fa_severity) AS s FROM a WHERE is_flagged AND has_filter_analysis)
SELECT 'reasons' AS chart, 'Toxicity' AS name, (SELECT count_if(is_flagged AND toxicity_score > 0) FROM a) AS value
UNION ALL SELECT 'reasons', 'Bias', (SELECT count_if(is_flagged AND bias_detected) FROM a)
UNION ALL SELECT 'reasons', 'Jailbreak', (SELECT count_if(is_flagged AND jailbreak_detected_in_output) FROM a)
UNION ALL """ + " UNION ALL ".join(f"SELECT 'severity', {q(s.capitalize())}, (SELECT count_if(s = {q(s)}) FROM sd)"
                                     for s in L.SEVERITY_LEVELS) + f"""
UNION ALL SELECT 'sanitization', {_cap('sanitization_strategy')}, count(*) FROM a
  WHERE is_flagged AND has_filter_analysis AND sanitization_strategy IS NOT NULL GROUP BY sanitization_strategy""")


# ---------------------------------------------------------------- A8, F8, F15, A15, A16

@register("unified_security_stats")
def unified_security_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A8 + F15: conversation totals, module counts, health score and band, last 24 h."""
    c = conversations(spark, sf)
    c = c.withColumn("_recent", ST.since("created_at", ST.latest(c, "created_at"), "24 HOURS"))
    recent = F.col("_recent")
    g = c.agg(F.count(F.lit(1)).alias("total_conversations"), ST.count_if(F.col("is_flagged")).alias("flagged_conversations"),
              ST.count_if(F.col("jailbreak_detected")).alias("jailbreak_prompt"),
              ST.count_if(F.col("pii_detected")).alias("pii_detected"),
              ST.count_if(F.col("toxicity_detected")).alias("toxicity_detected"),
              ST.count_if(F.col("bias_detected")).alias("bias_detected"),
              ST.count_if(F.col("jailbreak_detected_in_output")).alias("jailbreak_output"),
              ST.count_if(recent).alias("recent_conversations"),
              ST.count_if(recent & F.col("is_flagged")).alias("recent_flagged"))
    health = F.when(F.col("total_conversations") > 0, F.round(F.greatest(F.lit(0.0), 100.0 - F.col("flagged_conversations")
                                                                        / F.col("total_conversations") * 100.0), 2)) \
              .otherwise(F.lit(100.0))
    g = g.withColumn("security_health_score", health)
    band = ST.health_band(F.col("security_health_score"))
    return g.withColumn("health_color", band["color"]).withColumn("health_label", band["label"])


def _band_sql(x: str) -> tuple[str, str]:
    (t1, c1, l1), (t2, c2, l2) = L.HEALTH_BANDS
    c3, l3 = L.HEALTH_ELSE
    return (f"CASE WHEN {x} >= {t1} THEN {q(c1)} WHEN {x} >= {t2} THEN {q(c2)} ELSE {q(c3)} END",
            f"CASE WHEN {x} >= {t1} THEN {q(l1)} WHEN {x} >= {t2} THEN {q(l2)} ELSE {q(l3)} END")


_bc, _bl = _band_sql("security_health_score")
oracle("unified_security_stats", W + f"""
, u AS (SELECT count(*) AS total_conversations, count_if(is_flagged) AS flagged_conversations,
  count_if(jailbreak_detected) AS jailbreak_prompt, count_if(pii_detected) AS pii_detected,
  count_if(toxicity_detected) AS toxicity_detected, count_if(bias_detected) AS bias_detected,
  count_if(jailbreak_detected_in_output) AS jailbreak_output,
  count_if(created_at >= {CONV_ASOF} - INTERVAL 24 HOURS) AS recent_conversations,
  count_if(created_at >= {CONV_ASOF} - INTERVAL 24 HOURS AND is_flagged) AS recent_flagged FROM convs),
u2 AS (SELECT *, CASE WHEN total_conversations > 0 THEN round(greatest(0.0, 100.0 - flagged_conversations / total_conversations * 100.0), 2)
  ELSE 100.0 END AS security_health_score FROM u)
SELECT *, {_bc} AS health_color, {_bl} AS health_label FROM u2""")


@register("threat_trends_7d")
def threat_trends_7d(spark: SparkSession, sf: str) -> DataFrame:
    """F8: flagged conversations in 7 rolling 24-hour buckets ending at ``as_of``, labelled
    by the bucket's start date, zero-filled."""
    c = conversations(spark, sf)
    as_of = ST.latest(c, "created_at")
    start = as_of - F.expr("INTERVAL 7 DAYS")
    idx = F.floor((F.unix_micros("created_at") - F.unix_micros(start)) / F.lit(86400 * 1_000_000))
    counts = (c.filter(F.col("is_flagged")).withColumn("day_index", idx)
               .filter((F.col("day_index") >= 0) & (F.col("day_index") < 7))
               .groupBy("day_index").agg(F.count(F.lit(1)).alias("threats")))
    days = spark.range(7).select(F.col("id").alias("day_index"))
    out = days.join(F.broadcast(counts), "day_index", "left")
    return out.select(F.col("day_index").cast("bigint").alias("day_index"),
                      F.date_format(start + F.make_interval(days=F.col("day_index").cast("int")), "yyyy-MM-dd").alias("date"),
                      F.coalesce(F.col("threats"), F.lit(0)).cast("bigint").alias("threats"))


oracle("threat_trends_7d", W + f"""
, st AS (SELECT {CONV_ASOF} - INTERVAL 7 DAYS AS s),
b AS (SELECT CAST(floor((epoch_us(created_at) - epoch_us((SELECT s FROM st))) / CAST(86400000000 AS BIGINT)) AS BIGINT) AS d
      FROM convs WHERE is_flagged)
SELECT r.range AS day_index, strftime((SELECT s FROM st) + to_days(CAST(r.range AS INTEGER)), '%Y-%m-%d') AS date,
  CAST(count(b.d) AS BIGINT) AS threats
FROM range(7) r LEFT JOIN b ON b.d = r.range GROUP BY r.range""")


@register("threat_share")
def threat_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each module among all detections, zero categories dropped."""
    long = ST.unpivot_counts(ST.module_counts(conversations(spark, sf)).select(*ST.MODULES), ST.MODULES)
    total = long.agg(F.sum("value")).scalar()
    return (long.filter(F.col("value") > 0)
                .select("name", "value", F.round(F.col("value") / total * 100.0, 2).alias("percent")))


oracle("threat_share", W + """
, m AS (SELECT count_if(jailbreak_detected) AS jailbreak_prompt, count_if(pii_detected) AS pii_detected,
  count_if(toxicity_detected) AS toxicity_detected, count_if(bias_detected) AS bias_detected,
  count_if(jailbreak_detected_in_output) AS jailbreak_output FROM convs),
l AS (UNPIVOT m ON jailbreak_prompt, pii_detected, toxicity_detected, bias_detected, jailbreak_output INTO NAME name VALUE value)
SELECT name, value, round(value / (SELECT sum(value) FROM l) * 100.0, 2) AS percent FROM l WHERE value > 0""")


@register("module_rates")
def module_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Block rate and per-module share of all messages, capped at 100 %, 0 when empty."""
    m = messages(spark, sf)
    g = m.agg(F.count(F.lit(1)).alias("total_messages"), ST.count_if(F.col("is_flagged")).alias("flagged_messages"),
              ST.count_if(F.col("jailbreak_score").isNotNull() | F.col("jailbreak_detected_in_output")).alias("jb"),
              ST.count_if(F.col("pii_detected")).alias("pii"),
              ST.count_if(F.col("toxicity_score").isNotNull() & (F.col("toxicity_score") > 0)).alias("tox"))
    tot = F.col("total_messages")

    def share(c):
        return F.when(tot > 0, F.least(F.lit(100.0), F.round(F.col(c) / tot * 100.0, 1))).otherwise(F.lit(0.0))
    return g.select("total_messages", "flagged_messages", ST.pct(F.col("flagged_messages"), tot, 1).alias("block_rate"),
                    share("jb").alias("jailbreak_share"), share("pii").alias("pii_share"), share("tox").alias("toxicity_share"))


oracle("module_rates", W + """
, g AS (SELECT count(*) AS total_messages, count_if(is_flagged) AS flagged_messages,
  count_if(jailbreak_score IS NOT NULL OR jailbreak_detected_in_output) AS jb, count_if(pii_detected) AS pii,
  count_if(toxicity_score IS NOT NULL AND toxicity_score > 0) AS tox FROM msgs)
SELECT total_messages, flagged_messages,
  CASE WHEN total_messages > 0 THEN round(flagged_messages / total_messages * 100.0, 1) ELSE 0.0 END AS block_rate,
  CASE WHEN total_messages > 0 THEN least(100.0, round(jb / total_messages * 100.0, 1)) ELSE 0.0 END AS jailbreak_share,
  CASE WHEN total_messages > 0 THEN least(100.0, round(pii / total_messages * 100.0, 1)) ELSE 0.0 END AS pii_share,
  CASE WHEN total_messages > 0 THEN least(100.0, round(tox / total_messages * 100.0, 1)) ELSE 0.0 END AS toxicity_share
FROM g""")


# ---------------------------------------------------------------- A9, A10, A17, T1, T3 (event streams)

@register("active_users_5min")
def active_users_5min(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct owners of conversations created in the last 5 minutes; error events in
    the last 5 minutes of the event log."""
    c = conversations(spark, sf)
    active = c.filter(ST.since("created_at", ST.latest(c, "created_at"), "5 MINUTES")).agg(
        F.countDistinct("user_id")).scalar()
    el = event_log(spark, sf)
    errors = el.filter((F.col("type") == "error") & ST.since("timestamp", ST.latest(el, "timestamp"), "5 MINUTES")).agg(
        F.count(F.lit(1))).scalar()
    return spark.range(1).select(active.alias("active_users"), errors.alias("recent_errors"))


oracle("active_users_5min", W + ELOG + f"""
SELECT (SELECT count(DISTINCT user_id) FROM convs WHERE created_at >= {CONV_ASOF} - INTERVAL 5 MINUTES) AS active_users,
  (SELECT count(*) FROM elog WHERE type = 'error' AND timestamp >= (SELECT max(timestamp) FROM elog) - INTERVAL 5 MINUTES)
  AS recent_errors""")


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events (time descending, id as the unique tie-break)."""
    return df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


@register("active_conversations_5min")
def active_conversations_5min(spark: SparkSession, sf: str) -> DataFrame:
    """A10: distinct conversations among the newest 200 events that fall in the last 5 minutes."""
    el = event_log(spark, sf)
    as_of = ST.latest(el, "timestamp")
    last = newest(el, L.RECENT_SCAN).filter(ST.since("timestamp", as_of, "5 MINUTES"))
    return last.agg(F.countDistinct("conversation_id").alias("active_conversations"))


oracle("active_conversations_5min", W + ELOG + f"""
, n AS (SELECT * FROM elog ORDER BY timestamp DESC, id DESC LIMIT {L.RECENT_SCAN})
SELECT count(DISTINCT conversation_id) AS active_conversations FROM n
WHERE timestamp >= (SELECT max(timestamp) FROM elog) - INTERVAL 5 MINUTES""")


@register("recent_activity")
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + F14: the newest 50 security events, time rendered ISO with a 'Z' (naive UTC)."""
    e = newest(event_log(spark, sf), 50)
    return e.select("id", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
                    "type", "severity", "message", "user_id", "is_flagged")


oracle("recent_activity", W + ELOG + """
SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, type, severity, message, user_id, is_flagged
FROM elog ORDER BY timestamp DESC, id DESC LIMIT 50""")


@register("latest_events_500")
def latest_events_500(spark: SparkSession, sf: str) -> DataFrame:
    """The capped cache of the newest 500 events."""
    e = newest(event_log(spark, sf), L.RECENT_EVENTS_CAP)
    return e.select("id", F.date_format("timestamp", TS_FMT).alias("timestamp"), "type", "severity", "user_id")


oracle("latest_events_500", W + ELOG + f"""
SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, type, severity, user_id FROM elog
ORDER BY timestamp DESC, id DESC LIMIT {L.RECENT_EVENTS_CAP}""")


@register("recent_flagged")
def recent_flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Events other than 'normal' among the pipeline's newest 50 events."""
    e = events(spark, sf)
    top = e.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(50)
    return top.agg(F.count(F.lit(1)).alias("recent_events"), ST.count_if(F.col("type") != "normal").alias("flagged"))


oracle("recent_flagged", W + """
, t AS (SELECT * FROM evts ORDER BY timestamp DESC, id DESC LIMIT 50)
SELECT count(*) AS recent_events, count_if(type <> 'normal') AS flagged FROM t""")


# ---------------------------------------------------------------- A11-A13 (per key, percentiles)

@register("conversation_stats")
def conversation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation - messages, flagged, jailbreak (score > 0), PII, toxicity (score > 0)."""
    m = messages(spark, sf)
    g = m.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("total_messages"), ST.count_if(F.col("is_flagged")).alias("flagged_messages"),
        ST.count_if(F.coalesce(F.col("jailbreak_score"), F.lit(0.0)) > 0).alias("jailbreak_attempts"),
        ST.count_if(F.col("pii_detected")).alias("pii_detections"),
        ST.count_if(F.coalesce(F.col("toxicity_score"), F.lit(0.0)) > 0).alias("toxicity_detections"))
    return g.withColumn("flag_rate", ST.pct(F.col("flagged_messages"), F.col("total_messages"), 4))


oracle("conversation_stats", W + """
SELECT conversation_id, count(*) AS total_messages, count_if(is_flagged) AS flagged_messages,
  count_if(coalesce(jailbreak_score, 0.0) > 0) AS jailbreak_attempts, count_if(pii_detected) AS pii_detections,
  count_if(coalesce(toxicity_score, 0.0) > 0) AS toxicity_detections,
  round(count_if(is_flagged) / count(*) * 100.0, 4) AS flag_rate FROM msgs GROUP BY conversation_id""")


PERCENTS = [25.0, 50.0, 75.0, 90.0, 95.0, 99.0]


def _nearest_rank_sql(percents) -> str:
    ps = ", ".join(str(p) for p in percents)
    return f"""
, s AS (SELECT event_type AS variant, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
t AS (SELECT DISTINCT variant, n, p FROM s, (SELECT CAST(unnest([{ps}]) AS DOUBLE) AS p))
SELECT t.variant, t.p, s.ms FROM t JOIN s ON s.variant = t.variant
  AND s.rn = greatest(0, least(t.n - 1, CAST(round_even(t.p / 100.0 * (t.n - 1), 0) AS BIGINT)))"""


@register("percentile_nearest")
def percentile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles (index round_half_even(p/100*(n-1))) of event values per type."""
    ev = read_table(spark, sf, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("ms"))
    return nearest_rank_percentiles(ev, "variant", "ms", PERCENTS)


oracle("percentile_nearest", "WITH x AS (SELECT 1)" + _nearest_rank_sql(PERCENTS))


@register("latency_summary")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per variant - samples, average, p50 and p95 (nearest rank)."""
    ev = read_table(spark, sf, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("ms"))
    pc = nearest_rank_percentiles(ev, "variant", "ms", [50.0, 95.0])
    wide = pc.groupBy("variant").agg(F.max(F.when(F.col("p") == 50.0, F.col("ms"))).alias("p50_ms"),
                                     F.max(F.when(F.col("p") == 95.0, F.col("ms"))).alias("p95_ms"))
    base = ev.groupBy("variant").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("ms"), 4).alias("avg_ms"))
    return base.join(wide, "variant")


oracle("latency_summary", "WITH x AS (SELECT 1)" + _nearest_rank_sql([50.0, 95.0]).replace(
    "SELECT t.variant, t.p, s.ms FROM", ", pc AS (SELECT t.variant, t.p, s.ms FROM") + """),
b AS (SELECT event_type AS variant, count(*) AS samples, round(avg(value), 4) AS avg_ms FROM events GROUP BY 1)
SELECT b.variant, samples, avg_ms, max(CASE WHEN p = 50.0 THEN ms END) AS p50_ms, max(CASE WHEN p = 95.0 THEN ms END) AS p95_ms
FROM b JOIN pc ON pc.variant = b.variant GROUP BY b.variant, samples, avg_ms""")


# ---------------------------------------------------------------- F1, F5, F6/F9, F10-F12, T2

@register("flagged_conversations")
def flagged_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """conversations whose flag is set."""
    c = conversations(spark, sf).filter(F.col("is_flagged"))
    return c.select("id", "title", "user_id", F.date_format("created_at", TS_FMT).alias("created_at"))


oracle("flagged_conversations", W + f"\nSELECT id, title, user_id, {tstr('created_at')} AS created_at FROM convs WHERE is_flagged")


@register("conversation_titles")
def conversation_titles(spark: SparkSession, sf: str) -> DataFrame:
    """titles - the first stored prompt cut to 50 characters plus '...'."""
    return conversations(spark, sf).select("id", "title")


oracle("conversation_titles", W + "\nSELECT id, title FROM convs")


@register("page_conversations")
def page_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Page 2 (offset 10, 20 rows) of conversations, newest first, id as tie-break."""
    c = conversations(spark, sf).orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(10).limit(20)
    return c.select("id", "title", F.date_format("created_at", TS_FMT).alias("created_at"), "is_flagged")


oracle("page_conversations", W + f"\nSELECT id, title, {tstr('created_at')} AS created_at, is_flagged FROM convs "
       "ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10")


def _privacy_rows(m: DataFrame) -> DataFrame:
    orig, masked = F.col("original_content"), F.col("masked_content")
    differs = F.coalesce(orig != masked, F.lit(False))
    has_map = F.col("pii_mappings").isNotNull() & (F.size(F.map_keys("pii_mappings")) > 0)
    return m.filter(orig.isNotNull() & (has_map | differs | F.col("pii_detected")))


@register("privacy_log")
def privacy_log(spark: SparkSession, sf: str) -> DataFrame:
    """F5 + T2: newest 50 messages where masking happened (original vs masked)."""
    m = _privacy_rows(messages(spark, sf)).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)
    return m.select("id", F.date_format("created_at", TS_FMT).alias("timestamp"), F.col("original_content"),
                    F.col("masked_content"), F.col("n_mappings").cast("bigint").alias("n_mappings"),
                    "conversation_id", "explanation")


PRIV_WHERE = ("original_content IS NOT NULL AND (n_mappings > 0 OR coalesce(original_content <> masked_content, FALSE) "
              "OR pii_detected)")
oracle("privacy_log", W + f"""
SELECT id, {tstr('created_at')} AS timestamp, original_content, masked_content, n_mappings, conversation_id, explanation
FROM msgs WHERE {PRIV_WHERE} ORDER BY created_at DESC, id DESC LIMIT 50""")


@register("pii_types_per_row")
def pii_types_per_row(spark: SparkSession, sf: str) -> DataFrame:
    """distinct PII types in each privacy-log row's mapping, in the order in which the mapping names them."""
    m = _privacy_rows(messages(spark, sf))
    types = F.array_distinct(F.transform(F.map_values("pii_mappings"), lambda v: v["type"]))
    return m.select("id", F.coalesce(F.array_join(types, ", "), F.lit("")).alias("pii_types"))


oracle("pii_types_per_row", W + f"""
SELECT id, array_to_string({ordered_distinct('map_types')}, ', ') AS pii_types FROM msgs WHERE {PRIV_WHERE}""")


def _filter_rows(m: DataFrame) -> DataFrame:
    fc, content = F.col("filtered_content"), F.col("content")
    changed = fc.isNotNull() & F.coalesce(fc != content, F.lit(False))
    tox = F.col("toxicity_score").isNotNull() & (F.col("toxicity_score") > 0)
    return m.filter((F.col("role") == "ASSISTANT") & F.col("is_flagged")
                    & (changed | tox | F.col("bias_detected") | F.col("jailbreak_detected_in_output")))


@register("output_filter_log")
def output_filter_log(spark: SparkSession, sf: str) -> DataFrame:
    """F6 + F9 + T2: newest 50 filtered responses, original (F9 precedence) beside what was shown."""
    m = _filter_rows(messages(spark, sf)).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)
    fc = F.col("filtered_content")
    original = F.when(fc.isNotNull() & (fc != ""), fc).otherwise(F.col("content"))
    return m.select("id", F.date_format("created_at", TS_FMT).alias("timestamp"), original.alias("original_response"),
                    F.col("content").alias("filtered_response"), "toxicity_score", "bias_detected", "bias_score",
                    F.col("jailbreak_detected_in_output").alias("jailbreak_detected"),
                    F.col("jailbreak_score_in_output").alias("jailbreak_score"), "sanitization_strategy",
                    "conversation_id", "explanation")


FILTER_WHERE = ("role = 'ASSISTANT' AND is_flagged AND ((filtered_content IS NOT NULL AND coalesce(filtered_content <> content, FALSE)) "
                "OR (toxicity_score IS NOT NULL AND toxicity_score > 0) OR bias_detected OR jailbreak_detected_in_output)")
oracle("output_filter_log", W + f"""
SELECT id, {tstr('created_at')} AS timestamp,
  CASE WHEN filtered_content IS NOT NULL AND filtered_content <> '' THEN filtered_content ELSE content END AS original_response,
  content AS filtered_response, toxicity_score, bias_detected, bias_score, jailbreak_detected_in_output AS jailbreak_detected,
  jailbreak_score_in_output AS jailbreak_score, sanitization_strategy, conversation_id, explanation
FROM msgs WHERE {FILTER_WHERE} ORDER BY created_at DESC, id DESC LIMIT 50""")


@register("filter_reasons")
def filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """reason tags of every filter-log row (Toxicity, Bias, Jailbreak)."""
    m = _filter_rows(messages(spark, sf))
    tags = F.concat_ws(", ", F.when(F.coalesce(F.col("toxicity_score"), F.lit(0.0)) > 0, F.lit("Toxicity")),
                       F.when(F.col("bias_detected"), F.lit("Bias")),
                       F.when(F.col("jailbreak_detected_in_output"), F.lit("Jailbreak")))
    return m.select("id", tags.alias("reasons"))


oracle("filter_reasons", W + f"""
SELECT id, concat_ws(', ', CASE WHEN coalesce(toxicity_score, 0.0) > 0 THEN 'Toxicity' END,
  CASE WHEN bias_detected THEN 'Bias' END, CASE WHEN jailbreak_detected_in_output THEN 'Jailbreak' END) AS reasons
FROM msgs WHERE {FILTER_WHERE}""")


# ---------------------------------------------------------------- J1, J2

@register("conversation_messages")
def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's messages in time order (position within the conversation)."""
    c = conversations(spark, sf).select(F.col("id").alias("conversation_id"), "title")
    m = messages(spark, sf)
    j = c.join(m, "conversation_id")
    return j.select("conversation_id", "title", F.col("id").alias("message_id"), "turn", "role",
                    F.date_format("created_at", TS_FMT).alias("created_at"), "is_flagged", "jailbreak_score",
                    "toxicity_score", "pii_detected", "explanation")


oracle("conversation_messages", W + f"""
SELECT c.id AS conversation_id, c.title, m.id AS message_id, m.turn, m.role, {tstr('m.created_at')} AS created_at, m.is_flagged,
  m.jailbreak_score, m.toxicity_score, m.pii_detected, m.explanation FROM convs c JOIN msgs m ON m.conversation_id = c.id""")


@register("owned_conversations")
def owned_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Ownership-checked lookups - (conversation, user) requests taken from the event log
    (conversation key in props, acting user) that match an owned conversation."""
    req = event_log(spark, sf).select(F.col("conversation_id").alias("id"), "user_id").distinct()
    c = conversations(spark, sf)
    hits = c.join(req, ["id", "user_id"], "left_semi")
    return hits.select("id", "user_id", "title")


oracle("owned_conversations", W + ELOG + """
SELECT c.id, c.user_id, c.title FROM convs c WHERE EXISTS (SELECT 1 FROM elog e WHERE e.conversation_id = c.id AND e.user_id = c.user_id)""")
