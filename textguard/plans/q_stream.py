"""Contract queries for the streaming jobs.

The contract cuts a table into arrivals, each a set of files, some rows arriving two arrivals late, and runs the job over
them with one arrival a micro-batch until all are read; the result is the sink's table. The oracle replays the
batches: the watermark of a batch is the newest time of the batches before it less the delay, and a row is
late if its time (or its window's end) is not behind the watermark of the batch before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.plans import oracle_sql as O
from textguard.plans.catalog import register
from textguard.plans.q_pipeline import TS_FMT, contract_turns, pipe_with
from textguard.session import ensure_checkpoint_dir
from textguard.sources.tables import read_table
from textguard.streaming import jobs as W

EVENT_FILES, TURN_FILES = 6, 10
WINDOW_DELAY, DAY_DELAY, TURN_DELAY = "10 minutes", "1 hour", "2 hours"
#: A spell of a conversation ends this long after its newest turn.
SPELL = "20 hours 30 seconds 500 milliseconds"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_into_files(df: DataFrame, arrival: Column, arrivals: int, name: str) -> tuple[str, int]:
    """Write the rows of each value 0..arrivals-1 of ``arrival`` in that order, each as the same number of files: (folder, that number). The
    file source reads files by age, so a batch of so many files is one arrival, and all tasks write and read it. An arrival
    of few rows is filled up with empty files."""
    spark = df.sparkSession
    path, width = _folder(spark, name), spark.sparkContext.defaultParallelism
    for k in range(arrivals):
        df.where(arrival == k).repartition(width).write.mode("append").parquet(path)
        for _ in range((k + 1) * width - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, width


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files that are there, in append mode, and read its Parquet sink."""
    spark = df.sparkSession
    out = _folder(spark, name)
    W.start(df, f"{name}-{uuid.uuid4().hex}", "append", "parquet", path=out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    n = ev.agg((F.max("event_id") + 1).alias("n"))
    due = F.expr(f"event_id * {EVENT_FILES} div n + if(event_id % 37 = 0, 2, 0)")
    rows = ev.crossJoin(F.broadcast(n)).withColumn("due", F.least(due, F.lit(EVENT_FILES - 1)))  # n is one row
    rows = rows.select("event_id", "ts", "user_id", "event_type", "value", "props", "due")
    path, width = cut_into_files(rows, F.col("due"), EVENT_FILES, "event-files")
    return W.read_stream(spark, path, W.EVENT_SCHEMA, max_files=width)


EVENT_BATCHES = (f"n AS (SELECT max(event_id) + 1 AS n FROM events), ev AS (SELECT events.*, least(event_id * {EVENT_FILES} // n.n "
                 f"+ CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END, {EVENT_FILES - 1}) AS b FROM events, n)")


def marks(rows: str, delay: str) -> str:
    """CTEs: ``mark`` (b, wm: watermark of the batch, late: that of the batch before) and ``stop`` (wm: the last one)."""
    return (f"top AS (SELECT b, max(date_trunc('milliseconds', ts)) AS m FROM {rows} GROUP BY b), "
            f"mark0 AS (SELECT b, max(m) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '{delay}' AS wm FROM top), "
            "mark AS (SELECT b, coalesce(wm, TIMESTAMP '1970-01-01') AS wm, coalesce(lag(wm) OVER (ORDER BY b), TIMESTAMP '1970-01-01') AS late FROM mark0), "
            f"stop AS (SELECT max(m) - INTERVAL '{delay}' AS wm FROM top)")


@register("stream_active_windows", f"WITH {EVENT_BATCHES}, {marks('ev', WINDOW_DELAY)}, " + """
x AS (SELECT ev.*, date_trunc('minute', ts) - to_minutes(CAST(k.k AS BIGINT)) AS s FROM ev, (SELECT unnest(range(0, 5)) AS k) k),
y AS (SELECT x.*, s + INTERVAL '5 minutes' AS e FROM x JOIN mark USING (b) WHERE s + INTERVAL '5 minutes' > mark.late)
SELECT """ + O.tstr("s") + " AS window_start, " + O.tstr("e") + """ AS window_end, count(DISTINCT user_id) AS active_users,
  count(*) FILTER (event_type = 'error') AS errors, count(*) AS events
FROM y, stop WHERE e <= stop.wm GROUP BY s, e""")
def stream_active_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Active users and errors of every closed five-minute window, sliding by a minute."""
    out = drained(W.closed_activity(event_stream(spark, sf), WINDOW_DELAY), "active-windows")
    return out.select(*(F.date_format(c, TS_FMT).alias(c) for c in ("window_start", "window_end")), "active_users", "errors", "events")


@register("stream_daily_threats", f"WITH {EVENT_BATCHES}, {marks('ev', DAY_DELAY)}, " + """
y AS (SELECT ev.*, date_trunc('day', ts) AS d FROM ev JOIN mark USING (b) WHERE date_trunc('day', ts) + INTERVAL '1 day' > mark.late)
SELECT strftime(d, '%Y-%m-%d') AS date, count(*) FILTER (event_type = 'error') AS threats, count(*) AS events
FROM y, stop WHERE d + INTERVAL '1 day' <= stop.wm GROUP BY d""")
def stream_daily_threats(spark: SparkSession, sf: str) -> DataFrame:
    """Threats and events of every closed day."""
    return drained(W.daily_threats(event_stream(spark, sf), DAY_DELAY), "daily-threats")


@register("stream_newest_events", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value
FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 500""")
def stream_newest_events(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 500 events, kept current batch by batch."""
    table = _folder(spark, "newest-events")
    q = (event_stream(spark, sf).writeStream.foreachBatch(W.newest_events_sink(spark, table, cap=500))
         .option("checkpointLocation", W.checkpoint_for(spark, f"newest-{uuid.uuid4().hex}")).trigger(availableNow=True).start())
    q.awaitTermination()
    return W.read_newest_events(spark, table).withColumn("ts", F.date_format("ts", TS_FMT))


def guard_sql() -> str:
    """CTEs of the pipeline, and ``guarded``: every turn with the flags and content of W1."""
    chains = [O.namespaced(make("turns").strip(), prefix) for prefix, make in (
        ("gp", O.prompt_ctes), ("gq", O.response_ctes), ("gv", O.privacy_ctes), ("go", O.output_filter_ctes))]
    final = (f"CASE WHEN of_flagged AND (of_filtered IS NULL OR of_filtered = '') THEN {O.q(L.MSG_BLOCKED)} "
             "WHEN of_filtered IS NOT NULL AND of_filtered <> '' THEN of_filtered ELSE t.text END")
    return pipe_with().rstrip("\n") + ",\n" + ",\n".join(chains) + f""",
guarded AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.role = 'user' THEN pa_flagged ELSE of_flagged OR ra_flagged END AS is_flagged,
    t.role = 'user' AND pa_flagged AS jailbreak_detected,
    t.role = 'user' AND (len(mspans) > 0 OR len(api_keys) > 0 OR len(passwords) > 0) AS pii_detected,
    CASE WHEN t.role = 'user' THEN ra_tox ELSE tox_det OR ra_flagged END AS toxicity_detected,
    t.role <> 'user' AND bias_det AS bias_detected, t.role <> 'user' AND o.jb_det AS jailbreak_detected_in_output,
    CASE WHEN t.role = 'user' THEN (CASE WHEN t.text IS NOT NULL THEN full_masked END) ELSE {final} END AS content
  FROM turns t JOIN gp_pa2 p USING (conv_id, turn) JOIN gq_ra2 r USING (conv_id, turn) JOIN gv_pv5 v USING (conv_id, turn)
  JOIN go_of6 o USING (conv_id, turn))"""


@register("stream_guarded_turns", guard_sql() + " SELECT * FROM guarded")
def stream_guarded_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn scored as its file arrives."""
    turns = contract_turns(spark, sf)
    path, width = cut_into_files(turns, F.pmod("conv_id", F.lit(3)), 3, "turn-files")
    return drained(W.guard_turns(W.read_stream(spark, path, W.TURN_SCHEMA, max_files=width)), "guarded-turns")


#: Time of a turn in the session contract: 2024-01-01 + conv_id hours + turn x 100 hours, so that spells end inside conversations.
TURN_TIME = "conv_id * 3600 + turn * 360000"


@register("stream_conversation_sessions", guard_sql() + f""",
secs AS (SELECT c.conv_id, c.turn, {TURN_TIME} AS sec FROM conversations c),
ends AS (SELECT min(sec) AS lo, max(sec) - min(sec) + 1 AS span FROM secs),
tv AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_seconds(sec) AS ts, least((sec - lo) * {TURN_FILES} // span
       + CASE WHEN (conv_id * 8 + turn) % 11 = 0 THEN 2 ELSE 0 END, {TURN_FILES - 1}) AS b FROM secs, ends),
{marks('tv', TURN_DELAY)},
kept AS (SELECT g.*, tv.ts, tv.b FROM tv JOIN mark USING (b) JOIN guarded g USING (conv_id, turn) WHERE tv.ts > mark.late),
per AS (SELECT conv_id, b, max(max(ts)) OVER (PARTITION BY conv_id ORDER BY b) AS newest FROM kept GROUP BY conv_id, b),
gap AS (SELECT per.*, coalesce(m.wm >= lag(newest) OVER (PARTITION BY conv_id ORDER BY per.b) + INTERVAL '{SPELL}', FALSE) AS fresh
        FROM per LEFT JOIN mark m ON m.b = per.b - 1),
spell AS (SELECT conv_id, b, sum(CAST(fresh AS INT)) OVER (PARTITION BY conv_id ORDER BY b) AS spell FROM gap),
done AS (SELECT conv_id, spell, max(turn) AS last_turn, count(*) AS turns, count(*) FILTER (is_flagged) AS flagged_turns, max(ts) AS last_ts,
    arg_max(struct_pack(f := is_flagged, p := pii_detected, t := toxicity_detected, b := bias_detected, j := jailbreak_detected_in_output), turn) AS fl
  FROM kept JOIN spell USING (conv_id, b) GROUP BY conv_id, spell)
SELECT conv_id, last_turn, turns, flagged_turns, {O.tstr('last_ts')} AS last_ts, fl.f AS is_flagged, fl.p AS pii_detected,
  fl.t AS toxicity_detected, fl.b AS bias_detected, fl.j AS jailbreak_detected_in_output
FROM done, stop WHERE last_ts + INTERVAL '{SPELL}' <= stop.wm""")
def stream_conversation_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose spell of activity has ended, from state that expires."""
    sec = F.expr(TURN_TIME)
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", sec.alias("sec"))
    ends = turns.agg(F.min("sec").alias("lo"), (F.max("sec") - F.min("sec") + 1).alias("span"))
    due = F.expr(f"(sec - lo) * {TURN_FILES} div span + if((conv_id * 8 + turn) % 11 = 0, 2, 0)")
    rows = turns.crossJoin(F.broadcast(ends)).select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("sec")).alias("ts"),
                                                     F.least(due, F.lit(TURN_FILES - 1)).alias("due"))  # ends is one row
    # the turns as W1 leaves them, in files by arrival
    scored = W.guard_turns(rows, keep=("ts", "due")).drop("content")
    store = _folder(spark, "scored-turns")
    scored.write.parquet(store)
    scored = spark.read.schema(scored.schema).parquet(store)
    path, width = cut_into_files(scored, F.col("due"), TURN_FILES, "scored-turn-files")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    with W.rocksdb_state(spark):
        out = drained(W.conversation_sessions(W.read_stream(spark, path, kind, max_files=width), SPELL, TURN_DELAY), "conversation-sessions")
    return out.withColumn("last_ts", F.date_format("last_ts", TS_FMT))
