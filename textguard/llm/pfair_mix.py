"""Operator 3 - mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded order, form blocks. With weight w the j-th block of a source
may not start before slot floor(j / w) (its release) and must be done by slot ceil((j + 1) / w)
(its deadline). One slot serves one block; among the released blocks the earliest deadline goes
first. At every slot each source then has had its weight's share of the slots, give or take
less than one block.

Weights are whole shares of 2**50 ``UNITS``, so releases and deadlines are exact integers and off the
target weights by no more than one block in 2**50 slots. All blocks that there are (one for ``BLOCK_ROWS``
rows) are planned on the driver, which holds one entry for each source; a plan of over ``PLAN_ROWS`` blocks is
written to the shared folder in pieces. Every document keeps its place in the mixture: a source that
runs out leaves its slots empty, and no document is dropped or repeated.

A source's order is cut by leading hash bits into parts; part sizes give each part its offset, so
one source with a third of all rows is numbered in many tasks.

Defined results: a null source is a source of its own (named ``null_name``); sources without a
target are mixed as one, ``(other)``, with the smallest weight given; null text and repeated rows count as documents like
others (rows equal in doc_id and text take neighbouring places); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.llm.common import named, staged_path

#: What weights are whole shares of.
UNITS = 1 << 50
#: Blocks of a plan that is broadcast, and in a written piece of a larger one.
PLAN_ROWS = 1 << 18
BLOCK_ROWS = 64
#: Rows aimed at in one part of a source's order.
PART_ROWS = 5_000
SEED = 17
OTHER = "(other)"


def units(weights: dict[str, float], total: int = UNITS) -> dict[str, int]:
    """Whole shares of ``total`` slots by largest remainders, at least one each."""
    if not weights:
        return {}
    if len(weights) > total:
        raise ValueError(f"a mixture can name at most {total} sources")
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    n, whole = len(weights), sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    spare = total - sum(out.values())
    if spare > 0:
        for i, k in enumerate(sorted(weights, key=lambda k: (out[k] - exact[k], k))):
            out[k] += spare // n + (i < spare % n)
    for k in sorted(weights, key=lambda k: (-out[k], k)):  # what the least shares of one took
        if spare >= 0:
            break
        less = min(out[k] - 1, -spare)
        out[k], spare = out[k] - less, spare + less
    return out


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """One period as (source, block, slot): earliest deadline first among the released blocks."""
    return list(slots(shares, shares))


def slots(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the first blocks[k] blocks of each source k, by slot."""
    total = sum(shares.values())
    waiting = [(0, k, 0) for k in sorted(shares) if blocks.get(k)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])  # slots of sources that have run out
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            deadline = -(-(j + 1) * total // shares[k])
            # of equal deadlines first the one whose next block is released before this one's deadline, the larger share
            overlap = (j + 1) * total // shares[k] < deadline
            heapq.heappush(ready, (deadline, 1 - overlap, k, j))
        _, _, k, j = heapq.heappop(ready)
        yield k, j, slot
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * total // shares[k], k, j + 1))
        slot += 1


def _planned(spark: SparkSession, shares: dict[str, int], blocks: dict[str, int], names: list[str]) -> DataFrame:
    """The table of slots(), with the columns ``names``."""
    found, path, kinds = slots(shares, blocks), None, [pa.string(), pa.int64(), pa.int64()]
    while True:
        rows = list(islice(found, PLAN_ROWS))
        cols = zip(*rows) if rows else [[]] * 3
        piece = spark.createDataFrame(pa.table({c: pa.array(v, t) for c, v, t in zip(names, cols, kinds)}))
        if len(rows) < PLAN_ROWS and path is None:
            return F.broadcast(piece)
        path = path or staged_path(spark, "mix-plan")
        piece.write.mode("append").parquet(path)
        if len(rows) < PLAN_ROWS:
            return spark.read.schema(piece.schema).parquet(path)


def _counts(docs: DataFrame, null_name: str) -> dict[str, int]:
    """Rows by source. One small row per source comes to the driver."""
    return {r["s"]: r["count"] for r in docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(null_name)).alias("s")).count().collect()}


def tempered(docs: DataFrame, power: float = 0.7, null_name: str = "") -> dict[str, float]:
    """Target weights as the sources' row counts to a power under one, so large sources weigh less than
    their size."""
    return {s: n ** power for s, n in _counts(docs, null_name).items()}


def mix(docs: DataFrame, weights: dict[str, float], block_rows: int = BLOCK_ROWS, null_name: str = "", seed: int = SEED,
        order: list[str] | None = None) -> DataFrame:
    """``docs`` with mix_source, mix_block (of the source), mix_slot and mix_place (the row's place in the mixture's slots).

    order: the columns whose seeded hash orders a source's rows (doc_id, and text where there is one). Columns of ``docs`` named
    like one of the four are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_place")
    s, h, part, before, n, slot = (named(docs, c) for c in ("_s", "_h", "_part", "_before", "_n", "_slot"))
    counts = _counts(docs, null_name)
    total, other = sum(counts.values()), sum(c for k, c in counts.items() if k not in weights)
    d = docs.withColumn(s, F.coalesce(F.col("source").cast("string"), F.lit(null_name)))
    if other:
        known = spark.createDataFrame(pa.table({s: pa.array(sorted(weights), pa.string()), n: pa.array([True] * len(weights), pa.bool_())}))
        d = d.join(F.broadcast(known), s, "left").withColumn(s, F.when(F.col(n), F.col(s)).otherwise(F.lit(OTHER))).drop(n)
        if OTHER not in weights:
            weights = {**weights, OTHER: min(weights.values(), default=1.0)}
    order = order or [c for c in ("doc_id", "text") if c in docs.columns]
    d = d.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *order), 1))
    held = {k: counts.get(k, 0) + (other if k == OTHER else 0) for k in weights}
    plan = _planned(spark, units(weights), {k: -(-c // block_rows) for k, c in held.items()}, [s, "mix_block", slot])
    parts = max(1, -(-total // PART_ROWS))
    d = d.withColumn(part, F.floor(F.col(h) / F.lit(float(1 << 63)) * parts).cast("long"))
    sizes = d.groupBy(s, part).agg(F.count("*").alias("_c"))
    ahead = sizes.withColumn(before, F.sum("_c").over(Window.partitionBy(s).orderBy(part)) - F.col("_c")).drop("_c")
    w = Window.partitionBy(s, part).orderBy(h, *order)
    d = d.withColumn(n, F.row_number().over(w) - 1).join(ahead.hint("shuffle_hash"), [s, part])
    d = d.withColumn(n, F.col(n) + F.col(before)).withColumn("mix_block", F.floor(F.col(n) / block_rows).cast("long"))
    d, at = d.join(plan, [s, "mix_block"]), F.col(slot)
    return d.select(*docs.columns, F.col(s).alias("mix_source"), "mix_block", at.alias("mix_slot"),
                    (at * block_rows + F.col(n) % block_rows).cast("long").alias("mix_place"))


def reorder(docs: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """``docs``, all rows and columns, written out in the order of the mixture."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source")  # so no column can clash
    how = {"order": [f"row.{c}" for c in ("doc_id", "text") if c in docs.columns], **how}
    return mix(packed, weights or tempered(docs), **how).repartitionByRange("mix_place").sortWithinPartitions("mix_place").select("row.*")
