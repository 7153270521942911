"""Structured Streaming jobs (W1-W5): the reference polls its tables every few seconds;
these jobs keep the same answers current as rows arrive.

Every job reads a file source with an explicit schema and writes with a checkpoint
under the session's checkpoint folder (``spark.checkpoint.dir``), so a restarted
query resumes where it stopped and lost executors only cost recomputation.
Late data: rows older than the watermark are dropped (the reference defines none).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textguard.operators import outfilter as OF
from textguard.operators import pii as P
from textguard.operators import screen as S
from textguard.session import ensure_checkpoint_dir

TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def guard_turns(turns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score turns as they arrive - stateless, so it is the batch column logic as is.
    User turns get the prompt screen, prompt toxicity and masking; assistant turns get the
    output filter and the legacy response screen. ``keep`` names further columns to pass on."""
    t = S.with_screen_views(turns, "text")
    t = S.with_prompt_analysis(t, "text", "pa", staged=True)
    t = S.with_response_analysis(t, "text", "tox", staged=True).drop(*S.SCREEN_TMP)
    t = P.with_privacy(t, "text", "priv")
    t = OF.with_output_filter(t, "text", "of")
    is_user = F.col("role") == "user"
    return t.select(
        "conv_id", "turn", "role", *keep,
        F.when(is_user, F.col("pa.is_flagged")).otherwise(F.col("of.is_flagged") | F.col("tox.is_flagged")).alias("is_flagged"),
        F.when(is_user, F.col("pa.jailbreak_detected")).otherwise(F.lit(False)).alias("jailbreak_detected"),
        F.when(is_user, F.col("priv.pii_detected") | F.col("priv.secrets_detected")).otherwise(F.lit(False)).alias("pii_detected"),
        F.when(is_user, F.col("tox.toxicity_detected"))
         .otherwise(F.col("of.toxicity_detected") | F.col("tox.is_flagged")).alias("toxicity_detected"),
        F.when(~is_user, F.col("of.bias_detected")).otherwise(F.lit(False)).alias("bias_detected"),
        F.when(~is_user, F.col("of.jailbreak_detected")).otherwise(F.lit(False)).alias("jailbreak_detected_in_output"),
        F.when(is_user, F.col("priv.masked_text")).otherwise(OF.final_text(F.col("text"), F.col("of"))).alias("content"),
    )


def activity_windows(events: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes",
                     slide: str = "1 minute") -> DataFrame:
    """Active users (approximate distinct) and error events per sliding 5-minute window."""
    return (events.withWatermark("ts", watermark)
                  .groupBy(F.window("ts", size, slide).alias("w"))
                  .agg(F.approx_count_distinct("user_id").alias("active_users"),
                       F.count_if(F.col("event_type") == "error").alias("errors"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "active_users", "errors"))


def closed_activity(events: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """W2 in append mode: active users and error events per sliding window, once the window has closed. Users are counted
    exactly by two aggregates in a row (window and user, then window); both drop their state with the watermark."""
    per_user = (events.withWatermark("ts", watermark)
                      .groupBy(F.window("ts", size, slide).alias("w"), "user_id")
                      .agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("events")))
    return (per_user.groupBy("w")
                    .agg(F.count("user_id").alias("active_users"), F.sum("errors").alias("errors"), F.sum("events").alias("events"))
                    .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "active_users", "errors", "events"))


def daily_threats(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Flagged (error) events per day, emitted once the day has closed."""
    return (events.withWatermark("ts", watermark)
                  .groupBy(F.window("ts", "1 day").alias("w"))
                  .agg(F.count_if(F.col("event_type") == "error").alias("threats"), F.count(F.lit(1)).alias("events"))
                  .select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "threats", "events"))


def conversation_state(scored_turns: DataFrame) -> DataFrame:
    """Latest flags per conversation (last write wins by turn) plus running totals;
    an update-mode aggregate whose state is one row per conversation."""
    flags = F.struct("is_flagged", "pii_detected", "toxicity_detected", "bias_detected", "jailbreak_detected_in_output")
    return (scored_turns.groupBy("conv_id")
                        .agg(F.max_by(flags, "turn").alias("latest"), F.max("turn").alias("last_turn"),
                             F.count(F.lit(1)).alias("turns"),
                             F.count_if(F.col("is_flagged")).alias("flagged_turns"))
                        .select("conv_id", "last_turn", "turns", "flagged_turns", "latest.*"))


FLAGS = ("is_flagged", "pii_detected", "toxicity_detected", "bias_detected", "jailbreak_detected_in_output")
SESSION_SCHEMA = ("conv_id bigint, last_turn bigint, turns bigint, flagged_turns bigint, last_ts timestamp, "
                  + ", ".join(f"{f} boolean" for f in FLAGS))


class SessionState(StatefulProcessor):
    """State of one conversation: the flags of its highest turn and running totals, one row. A timer ``ttl_ms`` after its newest
    turn emits the row and clears the state, so state lasts as long as a conversation is active."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "last_turn long, turns long, flagged long, last_us long, " + ", ".join(f"{f} boolean" for f in FLAGS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_turn, turns, flagged, last_us, flags = None, 0, 0, None, ()
        if self.row.exists():
            last_turn, turns, flagged, last_us, *flags = self.row.get()
            self.handle.deleteTimer(self._expiry(last_us))
        for pdf in rows:
            turns, flagged = turns + len(pdf), flagged + int(pdf["is_flagged"].fillna(False).astype(bool).sum())
            top = pdf.loc[pdf["turn"].idxmax()]
            if last_turn is None or top["turn"] >= last_turn:
                last_turn, flags = int(top["turn"]), [None if pd.isna(top[f]) else bool(top[f]) for f in FLAGS]
            newest = int(pdf["us"].max())
            last_us = newest if last_us is None else max(last_us, newest)
        self.row.update((last_turn, turns, flagged, last_us, *flags))
        self.handle.registerTimer(self._expiry(last_us))
        return iter(())

    def _expiry(self, last_us: int) -> int:
        return last_us // 1000 + self.ttl_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_turn, turns, flagged, last_us, *flags = self.row.get()
        self.row.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "last_turn": [last_turn], "turns": [turns], "flagged_turns": [flagged],
                            "last_ts": [pd.Timestamp(last_us, unit="us")], **{f: [v] for f, v in zip(FLAGS, flags)}})

    def close(self) -> None:
        pass


def conversation_sessions(scored_turns: DataFrame, ttl: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """W4 with expiry: a row per conversation and spell of activity, emitted when the watermark is ``ttl`` past its newest
    turn (column ts); a turn after that opens a new spell, a turn behind the watermark is dropped. Needs the RocksDB
    state store (``rocksdb_state``)."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = scored_turns.select("conv_id", "turn", "ts", *FLAGS, F.unix_micros("ts").alias("us")).withWatermark("ts", watermark)
    return rows.groupBy("conv_id").transformWithStateInPandas(SessionState(ttl_ms), outputStructType=SESSION_SCHEMA, outputMode="Append",
                                                              timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB (state with timers needs it)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def newest_events_sink(spark: SparkSession, table_dir: str, cap: int = 500):
    """``foreachBatch`` function keeping the newest ``cap`` events in a table: each
    micro-batch is merged with what the batch before it stored and cut to the newest ``cap``
    rows (a top-k on time, id). Two folders are written in turn, so storage is bounded, and a
    batch that is run again after a failure finds its predecessor untouched and overwrites only
    its own folder."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.select("event_id", "ts", "user_id", "event_type", "value")
        if epoch_id > 0:
            prev = batch.sparkSession.read.parquet(_slot(table_dir, epoch_id - 1))
            rows = rows.unionByName(prev.drop("epoch"))
        top = rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(cap)
        top.withColumn("epoch", F.lit(epoch_id).cast("bigint")).write.mode("overwrite").parquet(_slot(table_dir, epoch_id))
    return write


def _slot(table_dir: str, epoch_id: int) -> str:
    return f"{table_dir.rstrip('/')}/slot{epoch_id % 2}"


def read_newest_events(spark: SparkSession, table_dir: str) -> DataFrame:
    """The rows that the last batch stored."""
    rows = spark.read.parquet(f"{table_dir.rstrip('/')}/slot*")
    newest = rows.agg(F.max("epoch").alias("epoch"))  # one row
    return rows.join(F.broadcast(newest), "epoch").drop("epoch")


def start(df: DataFrame, name: str, mode: str, sink: str, available_now: bool = True, **opts):
    """Start a streaming query with a checkpoint under the session's checkpoint folder. ``sink`` is
    the caller's choice; ``memory`` brings the whole result to the driver and is meant for tests."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_for(spark, name))
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink)
        for k, v in opts.items():
            w = w.option(k, v)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
