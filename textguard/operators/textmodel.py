"""A linear text model fitted and applied in Spark: log-odds of terms (M2, M6, M7).

A document's features are its distinct terms. A term's weight is the logarithm of how much likelier it is in
documents of the label than in the others, from one grouped aggregate over the labelled documents. Both rates are drawn
towards the term's overall rate (PSEUDO documents of it). A term is known only if it stands in MIN_DOCS labelled documents
and in MIN_Z standard deviations more or fewer documents of the label than chance gives, so the many
terms that differ by chance do not add up in long texts.
A score is the prior plus the sum of the weights of the known terms, its probability the logistic function of it. Weights
are whole millionths, so sums do not depend on their order. The model is a table of at most ``max_terms`` terms, the
bound that lets it be broadcast; texts are never moved, only (document, term) pairs are joined.

A document without a known term has no probability (null), so rules can act. Null texts have no terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.session import written

PSEUDO, MIN_Z, MIN_DOCS = 2.0, 5.0, 2
#: Size of a model: the terms with the largest weights.
MAX_TERMS = 20_000
MILLION = 1_000_000
TERM = r"\pL+"


def term_sets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms): the distinct runs of letters of every text, lower-cased, as an array."""
    return df.select(key, F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))).alias("terms"))


def terms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term): the distinct runs of letters of every text, lower-cased."""
    return term_sets(df, key, text).select(key, F.explode("terms").alias("term"))


@dataclass
class TextModel:
    """Weights (term, weight) and the prior (one row), in millionths."""

    weights: DataFrame
    prior: DataFrame

    def score(self, doc_terms: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, p) for every document with a known term."""
        sums = doc_terms.join(F.broadcast(self.weights), "term").groupBy(key).agg(F.sum("weight").alias("s"))
        odds = (F.col("s") + F.col("prior")) / MILLION
        return sums.crossJoin(F.broadcast(self.prior)).select(key, (1 / (1 + F.exp(-odds))).alias("p"))  # the prior is one row


def fit(doc_terms: DataFrame, labels: DataFrame, key: str = "doc_id", min_z: float = MIN_Z, min_docs: int = MIN_DOCS,
        max_terms: int = MAX_TERMS) -> TextModel:
    """The model of ``labels`` (key, y: 0 or 1). Labels without a document's terms count in the prior only."""
    total = labels.agg(*_totals(F.sum("y"), F.count("y")))
    seen = doc_terms.join(labels, key).groupBy("term").agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    return _model(seen, total, min_z, min_docs, max_terms)


def _totals(pos: Column, known: Column) -> tuple[Column, Column]:
    pos = F.coalesce(pos, F.lit(0))
    return pos.cast("double").alias("n_pos"), (F.coalesce(known, F.lit(0)) - pos).cast("double").alias("n_neg")


def _model(seen: DataFrame, total: DataFrame, min_z: float, min_docs: int, max_terms: int) -> TextModel:
    """The model of the terms' counts (term, pos, n) and those of the labels (n_pos, n_neg; one row)."""
    drawn = PSEUDO * F.col("n") / (F.col("n_pos") + F.col("n_neg"))
    chance = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    rates = (seen.where(F.col("n") >= min_docs).crossJoin(F.broadcast(total))  # total is one row
             .where(F.abs(F.col("pos") - F.col("n") * chance) > min_z * F.sqrt(F.col("n") * chance * (1 - chance)))
             .select("term", "n_pos", "n_neg", (F.col("pos") + drawn).alias("a"), (F.col("n") - F.col("pos") + drawn).alias("b")))
    log_odds = F.log(F.col("a") / (F.col("n_pos") + PSEUDO)) - F.log(F.col("b") / (F.col("n_neg") + PSEUDO))
    weights = (rates.select("term", F.round(log_odds * MILLION).cast("bigint").alias("weight")).orderBy(F.abs("weight").desc(), "term").limit(max_terms))
    prior = total.select(F.round(F.log((F.col("n_pos") + 1) / (F.col("n_neg") + 1)) * MILLION).cast("bigint").alias("prior"))
    return TextModel(weights, prior)


def fit_all(docs: DataFrame, tables: list[tuple[DataFrame, list[str]]], key: str = "doc_id", min_z: float = MIN_Z, min_docs: int = MIN_DOCS,
            max_terms: int = MAX_TERMS) -> dict[str, TextModel]:
    """``fit`` for every label of several tables, in one pass over ``docs`` (``term_sets``): each table has ``key`` and its labels' columns
    (0 or 1), whose names differ. Labels are summed by key and meet a document once, as numbers, before its terms are counted;
    what is read several times (the sums by key, the counts by term) is written first."""
    names = [x for _, labels in tables for x in labels]
    sums = None
    for k, (table, labels) in enumerate(tables):
        part = table.groupBy(key).agg(F.count(F.lit(1)).alias(f"rows{k}"), *(F.sum(x).alias(f"pos_{x}") for x in labels), *(F.count(x).alias(f"known_{x}") for x in labels))
        sums = part if sums is None else sums.join(part, key, "full")
    sums = written(sums, "label-sums")
    rows_of = {x: f"rows{k}" for k, (_, labels) in enumerate(tables) for x in labels}
    counts = (docs.join(sums, key).select(F.explode("terms").alias("term"), *(f"rows{k}" for k in range(len(tables))), *(f"pos_{x}" for x in names))
              .groupBy("term").agg(*(F.sum(f"rows{k}").alias(f"rows{k}") for k in range(len(tables))), *(F.sum(f"pos_{x}").alias(f"pos_{x}") for x in names)))
    counts = written(counts.where(F.greatest(*(F.coalesce(f"rows{k}", F.lit(0)) for k in range(len(tables)))) >= max(min_docs, 1)), "term-counts")
    out = {}
    for x in names:
        seen = counts.where(F.col(rows_of[x]) > 0).select("term", F.col(f"pos_{x}").cast("double").alias("pos"), F.col(rows_of[x]).cast("double").alias("n"))
        total = sums.agg(*_totals(F.sum(f"pos_{x}"), F.sum(f"known_{x}")))
        out[x] = _model(seen, total, min_z, min_docs, max_terms)
    return out


def score_all(docs: DataFrame, models: dict[str, TextModel], key: str = "doc_id") -> DataFrame:
    """(key, a probability for each model, null where it knows no term) for every document of ``docs`` (``term_sets``) with a term that some
    model knows: terms meet the weights of all models in one join."""
    known = None
    for k, m in enumerate(models.values()):
        w = m.weights.select("term", F.lit(k).alias("model"), "weight")
        known = w if known is None else known.unionByName(w)
    weights = known.groupBy("term").agg(*(F.sum(F.when(F.col("model") == k, F.col("weight"))).alias(f"w{k}") for k in range(len(models))))
    sums = (docs.select(key, F.explode("terms").alias("term")).join(F.broadcast(weights), "term")  # at most max_terms a model
            .groupBy(key).agg(*(F.sum(f"w{k}").alias(f"s{k}") for k in range(len(models)))))
    for k, m in enumerate(models.values()):
        sums = sums.crossJoin(F.broadcast(m.prior.withColumnRenamed("prior", f"prior{k}")))  # one row
    return sums.select(key, *((1 / (1 + F.exp(-(F.col(f"s{k}") + F.col(f"prior{k}")) / MILLION))).alias(x) for k, x in enumerate(models)))


def oracle_ctes(name: str, labels: str, min_z: float = MIN_Z, min_docs: int = MIN_DOCS, max_terms: int = MAX_TERMS) -> str:
    """DuckDB CTEs of the same model over a relation ``terms`` (doc_id, term): ``{name}_score`` (doc_id, p)."""
    return f"""{name}_lab AS ({labels}),
{name}_tot AS (SELECT CAST(coalesce(sum(y), 0) AS DOUBLE) AS np, CAST(count(y) - coalesce(sum(y), 0) AS DOUBLE) AS nn FROM {name}_lab),
{name}_cnt AS (SELECT term, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM terms JOIN {name}_lab USING (doc_id) GROUP BY term),
{name}_ab AS (SELECT term, np, nn, pos + {PSEUDO} * n / (np + nn) AS a, n - pos + {PSEUDO} * n / (np + nn) AS b FROM {name}_cnt, {name}_tot
  WHERE n >= {min_docs} AND abs(pos - n * (np / (np + nn))) > {min_z} * sqrt(n * (np / (np + nn)) * (1 - np / (np + nn)))),
{name}_w AS (SELECT term, ln(a / (np + {PSEUDO})) - ln(b / (nn + {PSEUDO})) AS w FROM {name}_ab),
{name}_top AS (SELECT term, CAST(round(w * {MILLION}) AS BIGINT) AS weight FROM {name}_w
  ORDER BY abs(CAST(round(w * {MILLION}) AS BIGINT)) DESC, term LIMIT {max_terms}),
{name}_score AS (SELECT doc_id, 1 / (1 + exp(-(sum(weight) + any_value(prior)) / {MILLION}.0)) AS p
  FROM terms JOIN {name}_top USING (term), (SELECT CAST(round(ln((np + 1) / (nn + 1)) * {MILLION}) AS BIGINT) AS prior FROM {name}_tot) GROUP BY doc_id)"""
