"""Output filter (D15-D20): weighted toxicity, sentiment, bias, output jailbreak,
verdict and sanitisation, all as native column expressions over a text column.

Each ``with_*`` transform adds one struct column and keeps the input rows whole;
it is a narrow (map-only) stage, so it scales with the number of input partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.prefilters import BIAS_REQUIRES, OUTPUT_JAILBREAK_REQUIRES
from textguard.functions.sqltext import expr, first_regex_sql, regex_hits_sql, substring_hits_sql
from textguard.functions.text import ci, col_, punct_normalize, score_tenths, uni, word_count
from textguard.operators.scoring import bias_from_probabilities, toxicity_from_probability

STR_ARRAY = "array<string>"
ITEM_ARRAY = "array<struct<type:string,value:string>>"
PATTERN_ARRAY = "array<struct<type:string,pattern:string>>"
SEVERITY_RANK = {s: i + 1 for i, s in enumerate(L.SEVERITY_LEVELS)}


def hits_by_literal(conds_and_values) -> Column:
    """Array of the values whose condition holds, in list order (codegen-friendly, no lambdas)."""
    parts = [F.when(cond, F.array(F.lit(v))).otherwise(F.array().cast(STR_ARRAY)) for cond, v in conds_and_values]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def substring_hits(views, needles) -> Column:
    """Needles present as substrings in any of the given text views."""
    def present(n):
        out = F.lit(False)
        for v in views:
            out = out | F.contains(v, F.lit(n))
        return out
    return hits_by_literal([(present(n), n) for n in needles])


def regex_hits(views, patterns, case_insensitive=True) -> Column:
    """Patterns that match any of the given text views (each pattern is a literal regex)."""
    def matches(p):
        rx = ci(p) if case_insensitive else uni(p)
        out = F.lit(False)
        for v in views:
            out = out | v.rlike(rx)
        return out
    return hits_by_literal([(matches(p), p) for p in patterns])


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, r in SEVERITY_RANK.items():
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(0)
    for n, r in SEVERITY_RANK.items():
        out = F.when(name == n, F.lit(r)).otherwise(out)
    return out


def sentiment_score(text, low: str | None = None) -> Column:
    """(positive - negative words present) / words x 10, clamped to [-1, 1]; 0 for no words.
    ``low`` names a staged lower-case column of ``text`` when one exists."""
    text = col_(text)
    if low is None:
        pos = F.size(substring_hits([F.lower(text)], L.POSITIVE_WORDS))
        neg = F.size(substring_hits([F.lower(text)], L.NEGATIVE_WORDS))
    else:
        pos = F.size(expr(substring_hits_sql([low], L.POSITIVE_WORDS)))
        neg = F.size(expr(substring_hits_sql([low], L.NEGATIVE_WORDS)))
    wc = word_count(text)
    raw = ((pos - neg).cast("double") / F.greatest(wc, F.lit(1)).cast("double")) * float(L.SENTIMENT_SCALE)
    return F.when(wc == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def toxicity_tenths_severity(tenths: Column) -> Column:
    return (F.when(tenths >= 10, "critical").when(tenths >= 6, "high")
            .when(tenths >= 3, "medium").when(tenths >= 2, "low").otherwise(F.lit(None).cast("string")))


def with_views(df: DataFrame, text: str) -> DataFrame:
    """Stage the text (NULL read as empty: no detections), its lower-case and its
    punctuation-stripped views once per row."""
    staged = df.withColumn("_tg_t", F.coalesce(F.col(text), F.lit("")))
    staged = staged.withColumns({"_tg_low": F.lower(F.col("_tg_t")), "_tg_pnorm": punct_normalize(F.col("_tg_t"))})
    return staged.withColumn("_tg_sent", sentiment_score(F.col("_tg_t"), "_tg_low"))


def toxicity_struct(text: str) -> Column:
    """D15 rule path over staged views: struct(detected, score, tenths, severity, keywords, phrases, items, sentiment)."""
    views = ["_tg_low", "_tg_pnorm"]
    kws = expr(substring_hits_sql(views, L.TOXICITY_KEYWORDS))
    phs = expr(substring_hits_sql(views, L.AGGRESSIVE_PHRASES))
    sent = F.col("_tg_sent")
    tenths = (F.size(kws) * L.KEYWORD_TENTHS + F.size(phs) * L.PHRASE_TENTHS
              + F.when(sent < L.SENTIMENT_PENALTY_BELOW, F.lit(L.SENTIMENT_TENTHS)).otherwise(F.lit(0)))
    items = F.concat(F.transform(kws, lambda k: F.struct(F.lit("keyword").alias("type"), k.alias("value"))),
                     F.transform(phs, lambda p: F.struct(F.lit("phrase").alias("type"), p.alias("value"))))
    return F.struct(
        (tenths >= 2).alias("detected"),
        score_tenths(F.least(tenths, F.lit(10))).alias("score"),
        tenths.alias("tenths"),
        toxicity_tenths_severity(tenths).alias("severity"),
        kws.alias("keywords"),
        phs.alias("phrases"),
        items.alias("items"),
        sent.alias("sentiment"),
    )


def bias_struct(include_age: bool = False) -> Column:
    """D17 rule path: first matching pattern per bias type, 0.3 per type."""
    groups = list(L.BIAS_PATTERNS) + ([("age", L.AGE_BIAS_PATTERNS)] if include_age else [])
    firsts = [(btype, expr(first_regex_sql("_tg_low", pats, requires=BIAS_REQUIRES))) for btype, pats in groups]
    types = hits_by_literal([(f.isNotNull(), t) for t, f in firsts])
    patterns = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), f.alias("pattern")) for t, f in firsts]),
                        lambda s: s["pattern"].isNotNull())
    n = F.size(types)
    return F.struct(
        (n > 0).alias("detected"),
        types.alias("types"),
        score_tenths(F.least(n * L.BIAS_TENTHS_PER_TYPE, F.lit(10))).alias("score"),
        F.when(n >= 2, "high").when(n == 1, "medium").otherwise(F.lit(None).cast("string")).alias("severity"),
        patterns.alias("patterns"),
    )


def with_model_toxicity(rules: Column, probability: Column, text: Column) -> Column:
    """M7: the model's result where a row has a probability, else the rules'. A model names no words,
    so its items are empty."""
    m = toxicity_from_probability(probability, text)
    none = F.array().cast(STR_ARRAY)
    model = F.struct(m["detected"].alias("detected"), m["score"].alias("score"), F.lit(None).cast("int").alias("tenths"), m["severity"].alias("severity"),
                     none.alias("keywords"), none.alias("phrases"), F.array().cast(ITEM_ARRAY).alias("items"), F.lit(None).cast("double").alias("sentiment"))
    return F.when(probability.isNotNull(), model).otherwise(rules)


def with_model_bias(rules: Column, probabilities: Column, text: Column) -> Column:
    """M7: the model's result where a row has probabilities, else the rules'; a model names no patterns."""
    m = bias_from_probabilities(probabilities, text)
    model = F.struct(m["detected"].alias("detected"), m["types"].alias("types"), m["score"].alias("score"), m["severity"].alias("severity"),
                     F.array().cast(PATTERN_ARRAY).alias("patterns"))
    return F.when(probabilities.isNotNull(), model).otherwise(rules)


def output_jailbreak_struct() -> Column:
    """Indicator patterns on lower or punctuation-stripped text; 0.4 each, capped at 1.0."""
    hits = expr(regex_hits_sql(["_tg_low", "_tg_pnorm"], L.OUTPUT_JAILBREAK_PATTERNS, requires=OUTPUT_JAILBREAK_REQUIRES))
    n = F.size(hits)
    return F.struct(
        (n > 0).alias("detected"),
        score_tenths(F.least(n * L.OUTPUT_JAILBREAK_TENTHS, F.lit(10))).alias("score"),
        F.when(n > 0, "critical").otherwise(F.lit(None).cast("string")).alias("severity"),
        F.slice(hits, 1, L.EXPLANATION_ITEMS).alias("indicators"),
        n.alias("n_indicators"),
    )


def _censor(text: Column, tox: Column, bias: Column, jb: Column) -> Column:
    def redact(acc, item):
        pat = F.when(item["type"] == "phrase", F.concat(F.lit("(?i)\\Q"), item["value"], F.lit("\\E")))\
               .otherwise(F.concat(F.lit("(?i)\\b\\Q"), item["value"], F.lit("\\E\\b")))
        return F.regexp_replace(acc, pat, F.lit(L.REDACTED))
    n_items = F.size(tox["items"])
    censored = (F.when(~tox["detected"], text)
                .when((tox["score"] >= 0.6) & (n_items == 0), F.lit(L.MSG_TOXIC_WHOLE))
                .when(n_items > 0, F.aggregate(tox["items"], text, redact))
                .otherwise(F.concat(F.lit(L.MSG_TOXIC_PREFIX), text)))
    # Each detected bias type prepends its line, so the last type ends up first.
    prefixes = F.array_join(F.transform(F.reverse(bias["types"]),
                                        lambda t: F.format_string(L.MSG_BIAS_PREFIX.replace("{}", "%s"), t)), "")
    censored = F.when(bias["detected"], F.concat(prefixes, censored)).otherwise(censored)
    return F.when(jb["detected"], F.lit(L.MSG_JAILBREAK_WHOLE)).otherwise(censored)


def _filter_out(text: Column, tox: Column) -> Column:
    kw_items = F.filter(tox["items"], lambda i: i["type"] == "keyword")
    removed = F.aggregate(kw_items, text, lambda acc, i: F.replace(acc, i["value"], F.lit("")))
    from textguard.functions.text import py_strip
    return py_strip(F.when(tox["detected"], removed).otherwise(text))


def sanitize(text: Column, strategy: Column, tox: Column, bias: Column, jb: Column) -> Column:
    """Block -> NULL, censor, warn, filter; unknown strategy -> text unchanged."""
    return (F.when(strategy == "block", F.lit(None).cast("string"))
            .when(strategy == "censor", _censor(text, tox, bias, jb))
            .when(strategy == "warn", F.concat(F.lit(L.MSG_WARN_PREFIX), text))
            .when(strategy == "filter", _filter_out(text, tox))
            .otherwise(text))


def with_output_filter(df: DataFrame, text: str, out: str = "verdict", strategies: dict | None = None,
                       include_age_bias: bool = False, toxicity_model: str | None = None,
                       bias_model: str | None = None) -> DataFrame:
    """D19 ``filter_response`` over a text column: adds struct ``out`` with the 12 verdict fields
    plus the three detector results. ``strategies`` overrides {toxicity,bias,jailbreak} -> strategy.

    M7: ``toxicity_model`` names a column with a model's probability, ``bias_model`` one with its
    probabilities per label; a row where the column is NULL is judged by the rules."""
    strat = dict(L.DEFAULT_SANITIZATION)
    strat.update(strategies or {})
    staged = with_views(df, text)
    tox, bias = toxicity_struct("_tg_t"), bias_struct(include_age_bias)
    if toxicity_model:
        tox = with_model_toxicity(tox, F.col(toxicity_model), F.col("_tg_t"))
    if bias_model:
        bias = with_model_bias(bias, F.col(bias_model), F.col("_tg_t"))
    staged = (staged.withColumn("_tg_tox", tox)
                    .withColumn("_tg_bias", bias)
                    .withColumn("_tg_jb", output_jailbreak_struct()))
    tox, bias, jb = F.col("_tg_tox"), F.col("_tg_bias"), F.col("_tg_jb")
    flagged = tox["detected"] | bias["detected"] | jb["detected"]
    sev = severity_name(F.greatest(severity_rank(tox["severity"]), severity_rank(bias["severity"]),
                                   severity_rank(jb["severity"])))
    expl = F.concat_ws(L.EXPL_SEP,
                       F.when(tox["detected"], F.concat(F.lit("Toxicity detected (score: "),
                                                        F.format_string("%.2f", tox["score"]), F.lit(")"))),
                       F.when(bias["detected"], F.concat(F.lit(L.EXPL_BIAS), F.array_join(bias["types"], L.LIST_SEP))),
                       F.when(jb["detected"], F.lit(L.EXPL_OUTPUT_JAILBREAK)))
    strategy = (F.when(jb["detected"], F.lit(strat["jailbreak"]))
                .when(tox["detected"], F.lit(strat["toxicity"]))
                .when(bias["detected"], F.lit(strat["bias"])))
    staged = staged.withColumn("_tg_strategy", strategy)
    txt = F.col("_tg_t")
    verdict = F.struct(
        flagged.alias("is_flagged"),
        tox["detected"].alias("toxicity_detected"),
        bias["detected"].alias("bias_detected"),
        jb["detected"].alias("jailbreak_detected"),
        tox["score"].alias("toxicity_score"),
        bias["score"].alias("bias_score"),
        jb["score"].alias("jailbreak_score"),
        sev.alias("severity"),
        F.when(flagged, expl).alias("explanation"),
        F.col(text).alias("original_response"),
        F.when(flagged, sanitize(txt, F.col("_tg_strategy"), tox, bias, jb)).alias("filtered_response"),
        F.col("_tg_strategy").alias("sanitization_strategy"),
        tox.alias("toxicity"),
        bias.alias("bias"),
        jb.alias("jailbreak"),
    )
    return staged.withColumn(out, verdict).drop(
        "_tg_t", "_tg_low", "_tg_pnorm", "_tg_sent", "_tg_tox", "_tg_bias", "_tg_jb", "_tg_strategy")


def with_toxicity(df: DataFrame, text: str, out: str = "toxicity") -> DataFrame:
    """D15 alone."""
    staged = with_views(df, text)
    return staged.withColumn(out, toxicity_struct("_tg_t")).drop("_tg_t", "_tg_low", "_tg_pnorm", "_tg_sent")


def with_bias(df: DataFrame, text: str, out: str = "bias", include_age: bool = False) -> DataFrame:
    """D17 alone (D21: ``include_age`` adds the age patterns the reference defines but never runs)."""
    staged = with_views(df, text)
    return staged.withColumn(out, bias_struct(include_age)).drop("_tg_t", "_tg_low", "_tg_pnorm", "_tg_sent")


def with_output_jailbreak(df: DataFrame, text: str, out: str = "jailbreak") -> DataFrame:
    """D18 alone."""
    staged = with_views(df, text)
    return staged.withColumn(out, output_jailbreak_struct()).drop("_tg_t", "_tg_low", "_tg_pnorm", "_tg_sent")


def final_text(text: Column, verdict: Column) -> Column:
    """Blocked -> fixed message; non-empty filtered text; else the original.
    A filter strategy that empties the text shows the block message (build decision, see README)."""
    filt = verdict["filtered_response"]
    return (F.when(verdict["is_flagged"] & (filt.isNull() | (filt == "")), F.lit(L.MSG_BLOCKED))
            .when(filt.isNotNull() & (filt != ""), filt)
            .otherwise(text))
