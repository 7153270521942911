"""Table sources: parquet scans of the input tables with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full-table scan. Filters and projections applied later are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Spread a scan over the number of partitions that the caller names in the session setting
    ``textguard.scan.partitions`` (unset: the scan is left as read, at every size). Apply it to the
    scan itself, before any union with small inputs or join."""
    n = df.sparkSession.conf.get("textguard.scan.partitions", "")
    return df.repartition(int(n)) if n else df
