"""Audit-table sinks (S3-S5): exchanges are screened and written once per batch; messages,
events and the conversation roll-up are derived from the written exchanges.

Every table has a folder per batch, which a retry of the batch overwrites, so a retry leaves no
second copy, and a batch reads nothing but its own exchanges. Messages and events are further
partitioned by day, so dashboards over a time range prune files. The roll-up is kept as mergeable
state: a batch writes what it tells about its conversations, readers merge the batches' rows, and
``compact_conversations`` merges those of closed batches into one base, in a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.plans import pipeline as PL


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(ts))


def write_audit_tables(ex: DataFrame, out_dir: str, batch: int = 0) -> dict[str, str]:
    """Write messages (S3/S4), security events (S5) and the conversations' state of one batch of
    guarded exchanges; batches are numbered in order of arrival. Returns the table paths."""
    spark = ex.sparkSession
    paths = {n: f"{out_dir.rstrip('/')}/{n}" for n in ("exchanges", "messages", "security_events", "conversations")}
    at = {n: f"{p}/batch={int(batch)}" for n, p in paths.items()}
    ex.write.mode("overwrite").parquet(at["exchanges"])
    own = spark.read.schema(ex.schema).parquet(at["exchanges"])
    msgs = PL.stored_messages(own).withColumn("pii_mappings", F.to_json("pii_mappings")) \
                                  .withColumn("filter_analysis", F.to_json("filter_analysis"))
    _by_day(msgs, "created_at").write.mode("overwrite").partitionBy("day").parquet(at["messages"])
    _by_day(PL.security_events(own), "timestamp").write.mode("overwrite").partitionBy("day").parquet(at["security_events"])
    PL.conversation_partials(own).write.mode("overwrite").parquet(f"{paths['conversations']}/parts/batch={int(batch)}")
    return paths


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _partials(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of the newest base and of the batches after it, up to ``upto``. Only folder names decide what is read."""
    parts = spark.read.parquet(f"{path.rstrip('/')}/parts")
    if upto is not None:
        parts = parts.where(F.col("batch") <= upto)
    bases = f"{path.rstrip('/')}/bases"
    if not _exists(spark, bases):
        return parts.drop("batch")
    base = spark.read.parquet(bases)
    if upto is not None:
        base = base.where(F.col("upto") <= upto)
    newest = base.agg(F.max("upto")).first()[0]
    if newest is None:
        return parts.drop("batch")
    return base.where(F.col("upto") == newest).drop("upto").unionByName(parts.where(F.col("batch") > newest).drop("batch"))


def compact_conversations(spark: SparkSession, path: str, upto: int) -> None:
    """Merge the conversations' state of all batches up to ``upto``, which must not be retried any more, into one base. A retry
    of the compaction overwrites its folder."""
    merged = PL.merged_partials(_partials(spark, path, upto))
    merged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/bases/upto={int(upto)}")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up row of every conversation over all batches."""
    return PL.finished_rollup(PL.merged_partials(_partials(spark, path)))


def read_audit_table(spark: SparkSession, path: str) -> DataFrame:
    """Read an audit table back (partition discovery adds ``batch`` and ``day``; a filter on them prunes files)."""
    return spark.read.parquet(path)
