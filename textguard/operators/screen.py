"""Prompt and response screens (D10-D14, D22, D23, P6) as native column expressions.

The normalised view (H1) and the lower-case view are staged once per row; every
pattern below is a literal regex, so each is compiled once per task, and the whole
screen is a single narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import ci, placeholder_email, trivial_prompt_password, uni, with_normalized
from textguard.functions.prefilters import PROMPT_JAILBREAK_REQUIRES
from textguard.functions.sqltext import expr, regex_hits_sql, substring_hits_sql
from textguard.operators.outfilter import STR_ARRAY

ENTITY_ARRAY = "array<struct<label:string,text:string>>"


def with_screen_views(df: DataFrame, text: str) -> DataFrame:
    """Stage ``_tg_t`` (NULL read as empty), ``_tg_low`` and ``_tg_norm`` (H1)."""
    staged = df.withColumn("_tg_t", F.coalesce(F.col(text), F.lit("")))
    staged = staged.withColumn("_tg_low", F.lower(F.col("_tg_t")))
    return with_normalized(staged, "_tg_t", "_tg_norm")


SCREEN_TMP = ["_tg_t", "_tg_low", "_tg_norm"]


def _join_first(arr: Column, n: int = L.EXPLANATION_ITEMS) -> Column:
    return F.array_join(F.slice(arr, 1, n), L.LIST_SEP)


def prompt_pii_found() -> Column:
    """PII types whose first match (original text, else normalised) counts; an e-mail
    placeholder is skipped; any password marker in the prompt replaces the type by
    'password' when that password is non-trivial, and by nothing otherwise."""
    t, norm = F.col("_tg_t"), F.col("_tg_norm")
    pw_rx = ci(L.PROMPT_PASSWORD_PATTERN)
    pw_present = t.rlike(pw_rx)
    pw_ok = ~trivial_prompt_password(F.regexp_extract(t, pw_rx, 1), t)
    parts = []
    for ptype, pat in L.PROMPT_PII_RULES:
        m_orig = F.regexp_extract(t, uni(pat), 0)
        m_norm = F.regexp_extract(norm, uni(pat), 0)
        matched = F.when(m_orig != "", m_orig).when(m_norm != "", m_norm)
        skip = placeholder_email(matched, t) if ptype == "email" else F.lit(False)
        parts.append(F.when(matched.isNull() | skip, F.array().cast(STR_ARRAY))
                     .when(pw_present, F.when(pw_ok, F.array(F.lit("password"))).otherwise(F.array().cast(STR_ARRAY)))
                     .otherwise(F.array(F.lit(ptype))))
    return F.concat(*parts)


def entity_hits(entities: Column) -> Column:
    """PERSON entities, and ORG/GPE entities longer than 3 characters that are not
    in the skip list, formatted ``LABEL: text``."""
    keep = F.filter(entities, lambda e: e["label"].isin(*L.NER_LABELS_ALWAYS)
                    | (e["label"].isin(*L.NER_LABELS_LONG) & (F.length(e["text"]) > 3)
                       & ~F.lower(e["text"]).isin(*L.NER_SKIP_WORDS)))
    return F.transform(keep, lambda e: F.concat(e["label"], F.lit(": "), e["text"]))


def with_prompt_analysis(df: DataFrame, text: str, out: str = "prompt", entities: str | None = None,
                         staged: bool = False) -> DataFrame:
    """D22 ``analyze_prompt``: struct(is_flagged, jailbreak_detected, pii_detected,
    jailbreak_score, explanation, jailbreak_patterns, pii_found, entities).
    ``staged=True``: the views of ``with_screen_views`` are already there (and are kept)."""
    keep_views = staged
    staged = df if staged else with_screen_views(df, text)
    jb = expr(regex_hits_sql(["_tg_low", "_tg_norm"], L.JAILBREAK_PATTERNS, flags="", requires=PROMPT_JAILBREAK_REQUIRES))
    staged = staged.withColumn("_tg_jb", jb).withColumn("_tg_pii", prompt_pii_found())
    ents = entity_hits(F.col(entities)) if entities else F.array().cast(STR_ARRAY)
    staged = staged.withColumn("_tg_ent", ents)
    jbh, pii, ent = F.col("_tg_jb"), F.col("_tg_pii"), F.col("_tg_ent")
    jb_det = F.size(jbh) > 0
    e1 = F.when(jb_det, F.concat(F.lit(L.EXPL_JAILBREAK), _join_first(jbh)))
    pii_txt = F.concat(F.lit(L.EXPL_PII), F.array_join(pii, L.LIST_SEP))
    e2 = F.when(F.size(pii) > 0, F.when(e1.isNull(), pii_txt).otherwise(F.concat(e1, F.lit(L.EXPL_SEP), pii_txt)))\
          .otherwise(e1)
    e3 = F.when(e2.isNull() & (F.size(ent) > 0), F.concat(F.lit(L.EXPL_NER), _join_first(ent))).otherwise(e2)
    result = F.struct(
        jb_det.alias("is_flagged"),
        jb_det.alias("jailbreak_detected"),
        ((F.size(pii) > 0) | (F.size(ent) > 0)).alias("pii_detected"),
        F.when(jb_det, F.round(F.size(jbh) * L.JAILBREAK_WEIGHT_TENTHS / 10.0, 4)).alias("jailbreak_score"),
        e3.alias("explanation"),
        jbh.alias("jailbreak_patterns"),
        pii.alias("pii_found"),
        ent.alias("entities"),
    )
    return staged.withColumn(out, result).drop(*([] if keep_views else SCREEN_TMP), "_tg_jb", "_tg_pii", "_tg_ent")


def harmful_instructions(low: Column) -> Column:
    """An instruction phrase together with a harmful word."""
    has_phrase = F.lit(False)
    for p in L.HARMFUL_PHRASES:
        has_phrase = has_phrase | F.contains(low, F.lit(p))
    has_word = F.lit(False)
    for w in L.HARMFUL_WORDS:
        has_word = has_word | F.contains(low, F.lit(w))
    return has_phrase & has_word


def with_response_analysis(df: DataFrame, text: str, out: str = "response", staged: bool = False) -> DataFrame:
    """D23 ``analyze_response``: struct(is_flagged, toxicity_detected, toxicity_score,
    explanation, keywords, harmful). ``staged=True``: reuse (and keep) staged views."""
    keep_views = staged
    staged = df if staged else with_screen_views(df, text)
    staged = staged.withColumn("_tg_lex", expr(substring_hits_sql(["_tg_low", "_tg_norm"], L.LEXICON_KEYWORDS)))
    lex = F.col("_tg_lex")
    tox = F.size(lex) > 0
    harmful = harmful_instructions(F.col("_tg_low"))
    expl = (F.when(harmful, F.lit(L.EXPL_HARMFUL))
            .when(tox, F.concat(F.lit(L.EXPL_LEXICON), _join_first(lex))))
    result = F.struct(
        (tox | harmful).alias("is_flagged"),
        tox.alias("toxicity_detected"),
        F.when(tox, F.round(F.size(lex) * 2 / 10.0, 4)).alias("toxicity_score"),
        expl.alias("explanation"),
        lex.alias("keywords"),
        harmful.alias("harmful"),
    )
    return staged.withColumn(out, result).drop(*([] if keep_views else SCREEN_TMP), "_tg_lex")


def prompt_intent(text) -> Column:
    """Canned-reply class by substring, in order greeting, help, question, else other."""
    low = F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))
    out = F.lit("other")
    for intent, words in reversed(L.INTENT_WORDS):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        out = F.when(cond, F.lit(intent)).otherwise(out)
    return out
