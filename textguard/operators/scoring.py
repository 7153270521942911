"""Model scoring (M1, M2, M6, M8): a scorer plug-in and the native post-processing of
model outputs.

M1: a scorer is a factory ``() -> callable(list[str]) -> list[value]``. It runs inside an
iterator pandas UDF: the model is built once per Python worker (not per row or batch) and
scores Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows at a time).
Everything after the raw score (thresholds, severities, type lists) is native Spark SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import py_strip

_SCORERS: dict[str, Callable[[], Callable[[list], list]]] = {}
_LOADED: dict[str, Callable[[list], list]] = {}


def register_scorer(name: str, factory: Callable[[], Callable[[list], list]]) -> None:
    """Register a scorer factory under ``name`` (the factory must be importable on workers)."""
    _SCORERS[name] = factory


def load_scorer(name: str, factory: Callable[[], Callable[[list], list]] | None = None) -> Callable[[list], list]:
    """The scorer ``name``, built at most once per Python process (worker processes are
    reused across tasks, so a model is loaded once per worker)."""
    fn = _LOADED.get(name)
    if fn is None:
        fn = (factory or _SCORERS[name])()
        _LOADED[name] = fn
    return fn


def score_column(text: Column, scorer: str, return_type: str, factory=None) -> Column:
    """Apply a registered scorer to a text column, batch by batch (Arrow), loading it once
    per worker process. ``factory`` travels with the UDF so remote workers can build it."""
    if factory is not None:
        register_scorer(scorer, factory)
    fac = _SCORERS[scorer]

    @F.pandas_udf(return_type)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = load_scorer(scorer, fac)
        for s in batches:
            yield pd.Series(fn(s.tolist()))
    return _score(text)


# ---------------------------------------------------------------- M2 toxicity probabilities

def _blank(text: Column) -> Column:
    return F.length(py_strip(F.coalesce(text, F.lit("")))) == 0


def toxicity_from_probability(p: Column, text: Column | None = None) -> Column:
    """M2: probability -> struct(detected, score, severity); clamped to [0, 1]; p >= 0.5
    detected; severity only when detected (>= 0.8 high, >= 0.6 medium, else low). A blank
    ``text``, where one is given, scores 0.0 whatever the model says."""
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p.cast("double")))
    if text is not None:
        prob = F.when(_blank(text), F.lit(0.0)).otherwise(prob)
    det = prob >= L.TOXICITY_MODEL_DETECT
    (hi, hname), (md, mname) = L.TOXICITY_MODEL_SEVERITY
    sev = F.when(det, F.when(prob >= hi, hname).when(prob >= md, mname).otherwise("low"))
    return F.struct(det.alias("detected"), prob.alias("score"), sev.alias("severity"))


# ---------------------------------------------------------------- M6 bias probabilities

def bias_from_probabilities(probs: Column, text: Column | None = None) -> Column:
    """M6: per-label sigmoid probabilities (gender, racial, religious) -> struct(detected,
    types, score=max, severity, scores map). Severity is set from the max even when no
    label passes 0.5 (>= 0.7 high, >= 0.4 medium, >= 0.2 low). A blank ``text``, where one is
    given, scores zero for every label."""
    if text is not None:
        probs = F.when(_blank(text), F.array_repeat(F.lit(0.0), len(L.BIAS_MODEL_LABELS))).otherwise(probs)
    labels = F.array(*[F.lit(x) for x in L.BIAS_MODEL_LABELS])
    pairs = F.arrays_zip(labels.alias("label"), probs.alias("p"))
    types = F.transform(F.filter(pairs, lambda z: z["p"] > L.BIAS_MODEL_DETECT), lambda z: z["label"])
    score = F.array_max(probs)
    (t1, n1), (t2, n2), (t3, n3) = L.BIAS_MODEL_SEVERITY
    sev = F.when(score >= t1, n1).when(score >= t2, n2).when(score >= t3, n3)
    return F.struct((F.size(types) > 0).alias("detected"), types.alias("types"), score.alias("score"),
                    sev.alias("severity"), F.map_from_arrays(labels, probs).alias("scores"))


# ---------------------------------------------------------------- M8 score once per distinct text

#: A text hash that holds more than one row in so many is hot; there can be no more hot hashes than this.
HOT_SHARE = 16_384


def text_hash(text: Column) -> Column:
    """32 bytes that stand for a text; a null reads as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def score_distinct(df: DataFrame, text: str, key: str, scorer: Callable[[DataFrame, str], DataFrame],
                   out_cols: list[str], hot_share: int = HOT_SHARE) -> DataFrame:
    """M8: score each distinct text once and join the result back to every row: (``key``, *out_cols).

    Hashes are counted first, with one representative key each, in fixed-width rows that are combined before their
    shuffle; texts then move once, to the representatives only. The scores return by hash. A hash that holds more than
    1 / ``hot_share`` of all rows goes by broadcast - there are fewer than ``hot_share`` of them, whatever the table's size - and the
    others by a shuffled join, in which no hash is larger than that share; so no copy count makes one task long, with or
    without adaptive execution. A null text is scored as an empty one; keys may repeat; a row without a key is scored too."""
    def clean(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))
    hashed = df.select(F.col(key), text_hash(F.col(text)).alias("_th"))
    counts = hashed.groupBy("_th").agg(F.min(key).alias("_rep"), F.count(F.lit(1)).alias("_n"))
    texts = df.select(F.col(key).alias("_rep"), clean(text).alias(text))
    # representatives by key; where a key repeats, its rows are told apart by their hash
    first = texts.join(counts, "_rep").where(text_hash(F.col(text)) == F.col("_th")).dropDuplicates(["_rep", "_th"])
    no_key = counts.where(F.col("_rep").isNull()).select("_th", "_n")
    keyless = (df.where(F.col(key).isNull()).select(clean(text).alias(text)).withColumn("_th", text_hash(F.col(text))).dropDuplicates(["_th"]).join(no_key, "_th"))
    distinct = first.select("_th", "_n", text).unionByName(keyless.select("_th", "_n", text))
    total = df.agg(F.count(F.lit(1))).scalar()
    is_hot = F.col("_n") * hot_share > total

    def scored(which: Column) -> DataFrame:
        return scorer(distinct.where(which), text).select("_th", *out_cols)
    marked = hashed.join(F.broadcast(counts.where(is_hot).select("_th", F.lit(True).alias("_hot"))), "_th", "left")
    by_broadcast = marked.where(F.col("_hot")).join(F.broadcast(scored(is_hot)), "_th")
    by_shuffle = marked.where(F.col("_hot").isNull()).join(scored(~is_hot), "_th")
    return by_broadcast.select(key, *out_cols).unionByName(by_shuffle.select(key, *out_cols))
