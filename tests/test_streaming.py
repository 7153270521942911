"""Streaming jobs against their batch equivalents (availableNow triggers, temp folders)."""

import datetime
import os
import random
import tempfile
import uuid

from pyspark.sql import functions as F

from textguard.streaming import jobs as W


def _src(table, sf="/root/testdata/sf0.001"):
    d = tempfile.mkdtemp(prefix="tg-src-")
    os.symlink(f"{sf}/{table}.parquet", os.path.join(d, f"{table}.parquet"))
    return d


def _name(base):
    # the checkpoint folder is shared and persists; each test run gets its own query names
    return f"{base}_{uuid.uuid4().hex[:8]}"


def _drain(q):
    q.processAllAvailable()
    q.awaitTermination(120)


def test_activity_and_daily_windows(spark):
    n_w2, n_w3 = _name("w2"), _name("w3")
    ev = W.read_stream(spark, _src("events"), W.EVENT_SCHEMA)
    _drain(W.start(W.activity_windows(ev), n_w2, "update", "memory"))
    got = {(r["window_start"], r["window_end"]): (r["active_users"], r["errors"]) for r in spark.table(n_w2).collect()}
    batch = spark.read.schema(W.EVENT_SCHEMA).parquet("/root/testdata/sf0.001/events.parquet")
    want = {(r["window_start"], r["window_end"]): (r["active_users"], r["errors"])
            for r in W.activity_windows(batch).collect()}
    assert got == want and len(got) > 0
    ev = W.read_stream(spark, _src("events"), W.EVENT_SCHEMA)
    _drain(W.start(W.daily_threats(ev), n_w3, "update", "memory"))
    got = {r["date"]: (r["threats"], r["events"]) for r in spark.table(n_w3).collect()}
    want = {r["date"]: (r["threats"], r["events"]) for r in W.daily_threats(batch).collect()}
    assert got == want and sum(v[1] for v in got.values()) == batch.count()


def test_guard_and_conversation_state(spark):
    n_w4 = _name("w4")
    turns = W.read_stream(spark, _src("conversations"), W.TURN_SCHEMA)
    _drain(W.start(W.conversation_state(W.guard_turns(turns)), n_w4, "update", "memory"))
    got = {r["conv_id"]: r.asDict() for r in spark.table(n_w4).collect()}
    batch = spark.read.schema(W.TURN_SCHEMA).parquet("/root/testdata/sf0.001/conversations.parquet")
    want = {r["conv_id"]: r.asDict() for r in W.conversation_state(W.guard_turns(batch)).collect()}
    assert got == want and len(got) == batch.select("conv_id").distinct().count()


def test_newest_events_cache(spark):
    n_w5 = _name("w5")
    out = tempfile.mkdtemp(prefix="tg-newest-")
    ev = W.read_stream(spark, _src("events"), W.EVENT_SCHEMA)
    q = ev.writeStream.foreachBatch(W.newest_events_sink(spark, out, cap=500)) \
          .option("checkpointLocation", W.checkpoint_for(spark, n_w5)).trigger(availableNow=True).start()
    _drain(q)
    got = W.read_newest_events(spark, out)
    batch = spark.read.schema(W.EVENT_SCHEMA).parquet("/root/testdata/sf0.001/events.parquet")
    want = batch.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500)
    assert got.count() == 500
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_newest_events_over_batches_and_a_retry(spark):
    """Two folders in turn hold the newest rows of all batches; running a batch again changes nothing."""
    out = tempfile.mkdtemp(prefix="tg-newest-")
    ev = spark.read.schema(W.EVENT_SCHEMA).parquet("/root/testdata/sf0.001/events.parquet")
    sink = W.newest_events_sink(spark, out, cap=50)
    for epoch in (0, 1, 2, 2):
        sink(ev.where(F.col("event_id") % 3 == epoch), epoch)
    want = ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)
    assert sorted(r["event_id"] for r in W.read_newest_events(spark, out).collect()) == sorted(r["event_id"] for r in want.collect())
    assert sorted(os.listdir(out)) == ["slot0", "slot1"]


TURN_FLAGS = ", ".join(f"{f} boolean" for f in W.FLAGS)


def _minutes(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def _replay(files, ttl, delay):
    """Batches in turn: rows at or behind the watermark of the batch before are late, then spells whose time is up end."""
    state, out, mark, newest = {}, [], None, None
    for rows in [*files, []]:  # a last batch without rows lets the final watermark act
        late, mark = mark, None if newest is None else newest - delay
        for conv, turn, minute, flagged in rows:
            if late is None or minute > late:
                s = state.setdefault(conv, [None, 0, 0, minute, None])
                s[1], s[2], s[3] = s[1] + 1, s[2] + flagged, max(s[3], minute)
                if s[0] is None or turn >= s[0]:
                    s[0], s[4] = turn, flagged
            newest = minute if newest is None else max(newest, minute)
        for conv in [c for c, s in state.items() if mark is not None and s[3] + ttl <= mark]:
            out.append((conv, *state.pop(conv)))
    return sorted(out), len(state)


def test_conversation_spells_expire_and_state_stays_small(spark):
    rng = random.Random(4)
    files = []
    for k in range(8):  # a file covers 100 minutes; conversations pause, some turns come two files late
        rows = [(c, 10 * k + t, 100 * k + rng.randint(0, 99) - 200 * (rng.random() < 0.1), rng.random() < 0.3)
                for c in range(40) if rng.random() < 0.5 for t in range(rng.randint(1, 4))]
        files.append(rows)
    files.append([(999, 0, 5000, False)])
    src = tempfile.mkdtemp(prefix="tg-turns-")
    for rows in files:
        data = [(c, t, _minutes(m), f, False, False, False, False) for c, t, m, f in rows]
        spark.createDataFrame(data, "conv_id long, turn long, ts timestamp, " + TURN_FLAGS).coalesce(1).write.mode("append").parquet(src)
    n_w4 = _name("w4s")
    with W.rocksdb_state(spark):
        stream = W.read_stream(spark, src, "conv_id long, turn long, ts timestamp, " + TURN_FLAGS, max_files=1)
        q = W.start(W.conversation_sessions(stream, "45 minutes 30 seconds", "20 minutes"), n_w4, "append", "memory")
        _drain(q)
    want, left = _replay(files, 45.5, 20)
    got = sorted((r.conv_id, r.last_turn, r.turns, r.flagged_turns, (r.last_ts - datetime.datetime(2024, 1, 1)).total_seconds() / 60, r.is_flagged)
                 for r in spark.table(n_w4).collect())
    assert got == want and len(want) > 40 and left == 1
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # the one open conversation: its row and its timer


def test_an_arrival_is_several_files(spark):
    """W1-W5 contract: every arrival is written by all tasks, as equally many files, one arrival a micro-batch."""
    from textguard.plans.q_stream import cut_into_files
    rows = spark.range(0, 4001, 1, 3).select("id", F.when(F.col("id") == 4000, 1).otherwise(F.col("id") % 2 * 2).alias("k"))
    path, width = cut_into_files(rows, F.col("k"), 3, "test-arrivals")
    assert width > 1 and len(spark.read.parquet(path).inputFiles()) == 3 * width
    assert spark.read.parquet(path).where("k = 2").select(F.input_file_name()).distinct().count() == width
    batches = []
    q = (W.read_stream(spark, path, "id long, k long", max_files=width).writeStream
         .foreachBatch(lambda df, n: batches.append([(r.k, r.n) for r in df.groupBy("k").agg(F.count("id").alias("n")).collect()]))
         .option("checkpointLocation", W.checkpoint_for(spark, _name("arrivals"))).trigger(availableNow=True).start())
    _drain(q)
    assert batches == [[(0, 2000)], [(1, 1)], [(2, 2000)]]
