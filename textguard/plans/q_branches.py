"""Contract queries for model spans beside rule spans (D2, D4, J5), multi-label evaluation (E1), sanitising by other strategies (D20),
age bias (D21) and unreadable event times (F13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators import outfilter as OF
from textguard.operators import pii as P
from textguard.operators import spanmerge as SM
from textguard.plans import oracle_sql as O
from textguard.plans import stats as ST
from textguard.plans import tables as T
from textguard.plans.catalog import register
from textguard.plans.q_outfilter import DOCS_SQL, docs_with_planted
from textguard.plans.q_pipeline import TS_FMT
from textguard.plans.q_stats import ELOG, event_log, oracle

# ---------------------------------------------------------------- D2, J5, D4 with a second source

# Stand-in for a model that finds spans of its own, looser than the rules: its e-mails tie with the rules', its phones beat theirs and lose to
# cards, its locations lose to addresses, names stand alone and one comes twice with different confidence.
MODEL_RULES = [
    ("name", "[A-Z][a-z]+ [A-Z][a-z]+", 0.75),
    ("email", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0.95),
    ("phone", "[0-9][0-9 -]{6,}[0-9]", 0.99),
    ("name", "[A-Z][a-z]+ [A-Z][a-z]+", 0.85),
    ("location", "[0-9]+[.][0-9]+[.][0-9]+", 0.6),
    ("zip_code", "[0-9]{5}", 0.5),
]


def _with_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = docs_with_planted(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    model = F.expr("concat(" + ", ".join(P.regex_spans_sql("_t", p, t, c) for t, p, c in MODEL_RULES) + ")")
    return d.withColumn("model", model).withColumn("rules", P.rule_pii_spans("_t"))


_MODEL_SQL = "list_concat(" + ", ".join(O.regex_spans("_pt", p, t, c) for t, p, c in MODEL_RULES) + ")"
_BOTH_SQL = f"""WITH src AS {DOCS_SQL}, b0 AS (SELECT doc_id, coalesce(text, '') AS _pt FROM src),
b1 AS (SELECT *, {O.rule_pii_spans('_pt')} AS rules, {_MODEL_SQL} AS model0 FROM b0),
b2 AS (SELECT * EXCLUDE (model0), {O.dedupe_model_spans('model0')} AS model FROM b1),
b3 AS (SELECT *, {O.resolve_spans('rules', 'model')} AS spans FROM b2)"""


@register("resolved_with_model", _BOTH_SQL + """
SELECT doc_id, s.t AS span_type, s.v AS span_value, s.s AS span_start, s.e AS span_end, s.c AS confidence FROM (SELECT doc_id, unnest(spans) AS s FROM b3)""")
def resolved_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the rules and of a second source, each a table of its own, resolved by overlap, priority and confidence."""
    d = _with_sources(spark, sf)
    r = SM.resolve_span_tables(SM.span_table(d, "doc_id", "rules"), SM.span_table(d, "doc_id", "model"))
    return r.select("doc_id", F.col("type").alias("span_type"), F.col("value").alias("span_value"), F.col("start").alias("span_start"),
                    F.col("end").alias("span_end"), "confidence")


def _masked_sql() -> str:
    return (_BOTH_SQL + f""", b4 AS (SELECT *, list_filter(spans, lambda x: x.t <> 'name') AS plain FROM b3),
b5 AS (SELECT *, {O.with_masks('spans')} AS m_all, {O.with_masks('plain')} AS m_plain FROM b4)
SELECT doc_id, {O.splice('_pt', 'm_all')} AS names_masked, {O.splice('_pt', 'm_plain')} AS names_kept FROM b5""")


@register("masked_with_model", _masked_sql())
def masked_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """D5 over both sources, with names masked and (D4) left as they are."""
    d = _with_sources(spark, sf).withColumn("spans", P.resolve_spans(F.col("rules"), F.col("model")))
    d = d.withColumn("m_all", P.with_masks(F.col("spans"))).withColumn("m_plain", P.with_masks(P.drop_names(F.col("spans"))))
    return d.select("doc_id", P.splice("_t", F.col("m_all")).alias("names_masked"), P.splice("_t", F.col("m_plain")).alias("names_kept"))


# ---------------------------------------------------------------- E1

# Annotations of the contract: the groups that a text names (no table holds bias labels).
GROUP_WORDS = [("gender", r"\b(men|women|males|females)\b"), ("racial", r"\b(black|white|asian|arab)\b"), ("religious", r"\b(christians?|muslims?|jewish|hindus?)\b")]
LABELS = [g for g, _ in GROUP_WORDS]


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    d = docs_with_planted(spark, sf)
    named = F.filter(F.array(*[F.when(low.rlike(rx), g) for g, rx in GROUP_WORDS]), lambda x: x.isNotNull())
    return OF.with_bias(d.withColumn("expected", named), "text").select("doc_id", "expected", F.col("bias.types").alias("predicted"))


_ANNOTATED_SQL = (f"WITH src AS {DOCS_SQL}, " + O.output_filter_ctes("src").strip() + ", an AS (SELECT doc_id, bias_types AS p, list_concat("
                  + ", ".join(f"CASE WHEN regexp_matches(lower(_t), {O.q(rx)}) THEN [{O.q(g)}] ELSE []::VARCHAR[] END" for g, rx in GROUP_WORDS) + ") AS e FROM of6),\n"
                  "ev AS (SELECT *, CASE WHEN len(e) > 0 THEN len(list_intersect(e, p)) > 0 ELSE len(p) = 0 END AS ok FROM an)")


@register("bias_eval_rows", _ANNOTATED_SQL + "\nSELECT doc_id, array_to_string(e, ', ') AS expected, array_to_string(p, ', ') AS predicted, ok AS passed FROM ev")
def bias_eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and predicted bias types of every document, and whether the case passes."""
    return _annotated(spark, sf).select("doc_id", F.array_join("expected", ", ").alias("expected"), F.array_join("predicted", ", ").alias("predicted"),
                                        T.multilabel_verdict(F.col("expected"), F.col("predicted")).alias("passed"))


@register("bias_eval")
def bias_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts and rates per bias type, and the totals of cases that passed and failed."""
    return T.multilabel_confusion(_annotated(spark, sf), F.col("expected"), F.col("predicted"), LABELS)


oracle("bias_eval", _ANNOTATED_SQL + f""",
lb AS (SELECT unnest({O.arr(LABELS)}) AS label),
c AS (SELECT label, count(*) AS n, count_if(list_contains(e, label) AND list_contains(p, label)) AS tp, count_if(NOT list_contains(e, label) AND list_contains(p, label)) AS fp,
  count_if(list_contains(e, label) AND NOT list_contains(p, label)) AS fn, count_if(NOT list_contains(e, label) AND NOT list_contains(p, label)) AS tn,
  count_if(ok) AS passed, count_if(NOT ok) AS failed FROM ev, lb GROUP BY label)
SELECT label, passed, failed, n, tp, fp, fn, tn, CASE WHEN n > 0 THEN round((tp + tn) / n, 4) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall,
  CASE WHEN tp > 0 THEN round(2.0 * tp / (2.0 * tp + fp + fn), 4) ELSE 0.0 END AS f1 FROM c""")


# ---------------------------------------------------------------- D20, D21

STRATEGIES = {"sanitized_text_filter": {"toxicity": "filter", "bias": "censor", "jailbreak": "warn"},
              "sanitized_text_warn": {"toxicity": "warn", "bias": "filter", "jailbreak": "censor"},
              "sanitized_text_block": {"toxicity": "block", "bias": "block", "jailbreak": "filter"}}


def _register_strategies(name: str, strategies: dict) -> None:
    sql = (f"WITH src AS {DOCS_SQL}, {O.output_filter_ctes('src', strategies=strategies)}\n"
           "SELECT doc_id, of_strategy AS sanitization_strategy, of_filtered AS filtered_response FROM of6")

    @register(name, sql)
    def sanitized(spark: SparkSession, sf: str) -> DataFrame:
        """Sanitised responses where a caller replaces the strategies."""
        v = F.col("verdict")
        return OF.with_output_filter(docs_with_planted(spark, sf), "text", strategies=strategies).select(
            "doc_id", v["sanitization_strategy"].alias("sanitization_strategy"), v["filtered_response"].alias("filtered_response"))


for _name, _strategies in STRATEGIES.items():
    _register_strategies(_name, _strategies)

AGE_TEXTS = [(-1, "All old people are slow."), (-2, "Typical boomer talk, and all women are emotional."), (-3, "Generation explains taste."), (-4, "My old bicycle."), (-5, None)]
_AGE_SQL = "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {'CAST(NULL AS VARCHAR)' if t is None else O.q(t)})" for i, t in AGE_TEXTS) + ") AS v(doc_id, text))"


@register("age_bias_flags", f"WITH src AS {_AGE_SQL}, {O.output_filter_ctes('src', include_age=True)}\n"
          "SELECT doc_id, bias_det AS bias_detected, array_to_string(bias_types, ', ') AS bias_types, bias_score, bias_sev AS severity FROM of6")
def age_bias_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Bias types with the optional fourth, age."""
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(AGE_TEXTS, "doc_id bigint, text string"))
    b = F.col("bias")
    return OF.with_bias(docs, "text", include_age=True).select("doc_id", b["detected"].alias("bias_detected"), F.array_join(b["types"], ", ").alias("bias_types"),
                                                               b["score"].alias("bias_score"), b["severity"].alias("severity"))


# ---------------------------------------------------------------- F13

@register("client_event_times")
def client_event_times(spark: SparkSession, sf: str) -> DataFrame:
    """event times as clients receive them, some missing, some unreadable, some with an offset and a stray 'Z'; type and severity by
    default where they are missing. "Now" is the newest time in the table."""
    el = event_log(spark, sf)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(F.col("id") % 7 == 3, F.lit("no time")).when(F.col("id") % 11 == 4, F.lit(""))
           .when(F.col("id") % 5 != 0, F.concat(iso, F.when(F.col("id") % 2 == 0, F.lit("+00:00Z")).otherwise(F.lit("Z")))))
    kind = F.when(F.col("id") % 13 != 0, F.col("type"))
    band = F.when(F.col("id") % 17 != 0, F.col("severity"))
    return el.select("id", raw.alias("received"), F.date_format(ST.client_time(raw, ST.latest(el, "timestamp")), TS_FMT).alias("timestamp"),
                     F.coalesce(kind, F.lit("normal")).alias("type"), F.coalesce(band, F.lit("low")).alias("severity"))


oracle("client_event_times", "WITH x AS (SELECT 1)" + ELOG + """
, r AS (SELECT *, CASE WHEN id % 7 = 3 THEN 'no time' WHEN id % 11 = 4 THEN '' WHEN id % 5 <> 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN id % 2 = 0 THEN '+00:00Z' ELSE 'Z' END END AS received FROM elog)
SELECT id, received, strftime(coalesce(CASE WHEN received LIKE '2%' THEN TRY_CAST(regexp_replace(received, '([+-]\\d{2}:\\d{2})Z$', '\\1') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END,
    (SELECT max(timestamp) FROM elog)), '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN id % 13 = 0 THEN 'normal' ELSE type END AS type, CASE WHEN id % 17 = 0 THEN 'low' ELSE severity END AS severity FROM r""")
