"""Registry of contract queries: each name maps to a Spark job over the input tables and,
where the result is expressible in SQL, the DuckDB oracle computing the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from textguard.plans import flagship, q_branches, q_context, q_detect, q_more, q_outfilter, q_pipeline, q_screen, q_stats, q_stream, q_tokens  # noqa: F401
