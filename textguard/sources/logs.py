"""The security log as a JSON document store - written as JSON lines and read back
with an explicit schema (never inferred), so prompt-analysis, response-analysis and event
records of different shapes share one wide schema with missing fields NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("type string, conv_id bigint, turn bigint, content string, is_flagged boolean, "
              "jailbreak_detected boolean, pii_detected boolean, toxicity_detected boolean, score double")


def write_security_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Append log records as JSON lines (NULL fields are omitted, as in a document store)."""
    logs.select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]).write.mode(mode).json(path)


def read_security_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def scan_security_logs(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path`` with ``bad_line``, the text of a line that is no JSON object (its fields are null then), and
    ``bad_fields``, the names of fields whose value does not fit the column's type (null there, the other fields stay).

    Writers drift: fields are read as text and cast, so a score written as "0.5" is a score, fields that a record lacks are
    null and fields that no column is named after are ignored. Empty lines are no records."""
    fields = [f.split() for f in LOG_SCHEMA.split(", ")]
    raw = spark.read.schema(", ".join(f"{n} string" for n, _ in fields) + ", bad_line string").option(
        "columnNameOfCorruptRecord", "bad_line").option("mode", "PERMISSIVE").json(path)
    good = F.col("bad_line").isNull()
    typed = [F.when(good, F.col(n).try_cast(t)).alias(n) for n, t in fields]
    misfits = F.filter(F.array(*[F.when(good & F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), n) for n, t in fields]), lambda x: x.isNotNull())
    return raw.select(*typed, "bad_line", misfits.alias("bad_fields"))
