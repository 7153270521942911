"""Model scores in the output filter (M7), with the rules as fallback and the blank-text rule (M2, M6)."""

import os

from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.operators import outfilter as OF
from textguard.operators.scoring import score_column

ROWS = [
    # id, text, toxicity probability, bias probabilities
    ("whole", "a calm sentence", 0.75, None),       # high score without items: the whole text is censored
    ("prefix", "a calm sentence", 0.55, None),      # detected below 0.6: a warning line
    ("model_says_no", "you stupid idiot", 0.1, None),
    ("rules", "you stupid idiot", None, None),      # no score: the rules decide
    ("blank", "   ", 0.99, [0.9, 0.9, 0.9]),
    ("bias", "a calm sentence", 0.0, [0.6, 0.2, 0.8]),
    ("severity_only", "a calm sentence", 0.0, [0.45, 0.1, 0.1]),
]


def test_model_scores_and_fallback(spark):
    df = spark.createDataFrame(ROWS, "id string, text string, p double, b array<double>")
    got = {r["id"]: r["verdict"] for r in OF.with_output_filter(df, "text", strategies={"toxicity": "censor", "bias": "censor"},
                                                               toxicity_model="p", bias_model="b").collect()}
    assert got["whole"]["filtered_response"] == L.MSG_TOXIC_WHOLE and got["whole"]["toxicity"]["severity"] == "medium"
    assert got["prefix"]["filtered_response"] == L.MSG_TOXIC_PREFIX + "a calm sentence"
    assert not got["model_says_no"]["is_flagged"]
    assert got["rules"]["toxicity_detected"] and got["rules"]["filtered_response"] == "you [REDACTED] [REDACTED]"
    assert not got["blank"]["is_flagged"] and got["blank"]["toxicity_score"] == 0.0 and got["blank"]["bias_score"] == 0.0
    assert got["bias"]["bias"]["types"] == ["gender", "religious"] and got["bias"]["bias_score"] == 0.8
    assert not got["severity_only"]["bias_detected"] and got["severity_only"]["bias"]["severity"] == "medium"


def test_scorer_is_built_once_per_worker(spark):
    """M1: the factory runs once in a worker process, however many batches and tasks it scores."""
    def factory():
        built = object()  # one for each call of the factory
        return lambda texts: [f"{os.getpid()} {id(built)}" for _ in texts]
    df = spark.range(4000).repartition(8).select(F.col("id").cast("string").alias("text"))
    rows = [r[0] for r in df.select(score_column(F.col("text"), "counting", "string", factory).alias("m")).distinct().collect()]
    assert rows and len(rows) == len({r.split()[0] for r in rows})
