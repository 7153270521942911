"""Spark session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "textguard", master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str = "16g",
              scan_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the cluster's session and
    only call :func:`ensure_checkpoint_dir`."""
    cores = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cores}]"
    parts = shuffle_partitions or int(cores)
    spark = (SparkSession.builder.master(master).appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", str(parts))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", driver_memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if scan_partitions:  # text jobs are CPU-bound: a table of one small file would keep one slot busy
        spark.conf.set("textguard.scan.partitions", str(scan_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. A cluster names a shared one in
    ``spark.checkpoint.dir``; where it is unset, a session on one machine (master local) gets a
    scratch folder and any other session an error, since executors would not see each other's files."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="textguard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, so that its readers do not compute it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
