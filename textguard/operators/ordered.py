"""Order-dependent operators that stay exact and skew-proof.

A window ``partitionBy(key).orderBy(...)`` puts a whole key in one task. When one key
may hold a third of all rows, that task is the whole job. The helpers here split a key
into fixed-size blocks of its order column, solve each block in its own window, and
stitch the blocks together through a small per-block table, so no task ever sees more
than one block of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def blocked_running_sum(df: DataFrame, key: str, order: str, value: str, out: str,
                        block: int = DEFAULT_BLOCK, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order`` (an integer position, e.g. a turn
    number). Two levels: a running sum inside each (key, block) and the summed totals of
    the earlier blocks of the same key, joined back on (key, block)."""
    b = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    staged = df.withColumn("_blk", b)
    frame_end = Window.currentRow if inclusive else -1
    w_in = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, frame_end)
    staged = staged.withColumn("_in_blk", F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    totals = staged.groupBy(key, "_blk").agg(F.sum(value).alias("_blk_total"))
    w_blk = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_blk_off", F.coalesce(F.sum("_blk_total").over(w_blk), F.lit(0))).drop("_blk_total")
    return (staged.join(offsets, [key, "_blk"], "left")
            .withColumn(out, F.col("_in_blk") + F.coalesce(F.col("_blk_off"), F.lit(0)))
            .drop("_blk", "_in_blk", "_blk_off"))


def blocked_previous(df: DataFrame, key: str, order: str, values: list[str], block: int = DEFAULT_BLOCK) -> DataFrame:
    """``df`` with ``prev_<v>``: the values of the row before in ``order`` (an integer, unique per key; gaps allowed), null at the
    start of a key. A block's first row gets them from a table of the blocks' last rows."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    last = F.struct(*values)
    ends = d.groupBy(key, "_blk").agg(F.max_by(last, order).alias("_last"))
    ahead = ends.select(key, "_blk", F.lag("_last").over(Window.partitionBy(key).orderBy("_blk")).alias("_ahead"))
    near = F.lag(last).over(Window.partitionBy(key, "_blk").orderBy(order))
    d = d.withColumn("_near", near).join(ahead, [key, "_blk"], "left")
    prev = F.coalesce("_near", "_ahead")
    return d.withColumns({f"prev_{v}": prev[v] for v in values}).drop("_blk", "_near", "_ahead")


def blocked_latest(df: DataFrame, key: str, order: str, marks: dict[str, Column], block: int = DEFAULT_BLOCK) -> DataFrame:
    """``df`` with a column for each mark (name: condition): the ``order`` of the newest row so far, itself included, for which the
    condition holds; null where there is none yet."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    at = {m: F.when(c, F.col(order)) for m, c in marks.items()}
    tops = d.groupBy(key, "_blk").agg(*(F.max(c).alias(f"_top_{m}") for m, c in at.items()))
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tops.select(key, "_blk", *(F.max(f"_top_{m}").over(before).alias(f"_ahead_{m}") for m in marks))
    inside = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_in_{m}": F.max(c).over(inside) for m, c in at.items()}).join(ahead, [key, "_blk"], "left")
    return d.withColumns({m: F.coalesce(f"_in_{m}", f"_ahead_{m}") for m in marks}).drop("_blk", *(f"_{w}_{m}" for w in ("in", "ahead") for m in marks))


def nearest_rank_percentiles(df: DataFrame, group: str, value: str, percents: list[float],
                             num_partitions: int | None = None) -> DataFrame:
    """A13 nearest-rank percentile per group: the value at 0-based index
    ``round_half_even(p/100 * (n-1))`` of the group's sorted values (0.0 for an empty group).

    Exact, on distinct values: rows are first counted per (group, value), combined before the
    shuffle, so a value that fills a table is one row. The distinct values are range-partitioned
    on (group, value), which cuts a large group into many ranges; the rank of a value is the
    count of its group's rows in earlier ranges (a small per-range table) plus the count before
    it in its range. A group whose values are all null gets 0.0."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    ranged = (src.filter(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
                 .repartitionByRange(n_parts, "g", "v").withColumn("_part", F.spark_partition_id()))
    # Pin the range assignment: the range totals and the ranks inside ranges must see the same
    # partition ids, so the counted values (not the rows) are written once to the checkpoint folder.
    from textguard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    totals = ranged.groupBy("g", "_part").agg(F.sum("c").alias("_cnt"))
    w_off = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))) \
                    .withColumn("_n", F.sum("_cnt").over(Window.partitionBy("g")))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p")
    at = F.bround(F.col("p") / 100.0 * (F.col("_n") - 1), 0).cast("bigint")
    targets = offsets.select("g", "_n").distinct().select("g", "_n", wanted) \
                     .select("g", "p", F.greatest(F.lit(0), F.least(F.col("_n") - 1, at)).alias("_k"))
    # the range that holds each target first, so the value join is on (group, range) and never on a group alone
    placed = offsets.join(targets, "g").where((F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_cnt"))) \
                    .select("g", "_part", "p", (F.col("_k") - F.col("_off")).alias("_k"))
    w_in = Window.partitionBy("g", "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("_to", F.sum("c").over(w_in))
    picked = ranked.join(placed, ["g", "_part"]).where((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("c"))).select("g", "p", "v")
    empty = src.groupBy("g").agg(F.count("v").alias("_n")).where("_n = 0").select("g", wanted, F.lit(0.0).alias("v"))
    return picked.unionByName(empty).select(F.col("g").alias(group), "p", F.col("v").alias(value))


def blocked_highest_before(df: DataFrame, key: str, order: str, value: str, out: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``df`` with ``out``: the highest ``value`` among the rows of ``key`` with a strictly lower ``order`` (an integer; ties and
    gaps allowed), null where there is none. Rows of one block are windowed together; a block's predecessors come as
    one number from a table of one row a block."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    tops = d.groupBy(key, "_blk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tops.select(key, "_blk", F.max("_top").over(before).alias("_ahead"))
    inside = Window.partitionBy(key, "_blk").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_near", F.max(value).over(inside)).join(ahead, [key, "_blk"], "left")
    return d.withColumn(out, F.greatest("_near", "_ahead")).drop("_blk", "_near", "_ahead")
