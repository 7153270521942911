"""Contract queries for table maintenance (S7-S11), evaluation (E1), model post-processing
(M2-M8), named entities (D12) and event time clean-up (F13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.operators import modelspans as MS
from textguard.operators import outfilter as OF
from textguard.operators import pii as P
from textguard.operators import scoring as SC
from textguard.operators import screen as S
from textguard.plans import oracle_sql as O
from textguard.plans import tables as T
from textguard.plans.catalog import register
from textguard.plans.q_outfilter import DOCS_SQL, docs_with_planted
from textguard.plans.q_pipeline import TS_FMT, contract_turns, conversations, messages, pipe_with
from textguard.plans.q_stats import ELOG, event_log, oracle
from textguard.sources.tables import read_table, spread_for_cpu

W = pipe_with().rstrip("\n")


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen in the event log; role by id (every 10th ADMIN, next MODERATOR, else USER)."""
    u = read_table(spark, sf, "events").select("user_id").distinct()
    role = F.when(F.col("user_id") % 10 == 0, "ADMIN").when(F.col("user_id") % 10 == 1, "MODERATOR").otherwise("USER")
    return u.withColumn("role", role)


USERS_SQL = (", users AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 0 THEN 'ADMIN' WHEN user_id % 10 = 1 "
             "THEN 'MODERATOR' ELSE 'USER' END AS role FROM events)")


def role_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Update requests read from the event log: large signups ask for MODERATOR, large errors
    ask for a role that does not exist, large purchases name a user that does not exist."""
    e = read_table(spark, sf, "events")
    sig = e.filter((F.col("event_type") == "signup") & (F.col("value") >= 300)).select(
        "user_id", F.lit("MODERATOR").alias("new_role"), "ts", F.col("event_id").alias("update_id"))
    bad = e.filter((F.col("event_type") == "error") & (F.col("value") >= 320)).select(
        "user_id", F.lit("SUPERUSER").alias("new_role"), "ts", F.col("event_id").alias("update_id"))
    unknown = e.filter((F.col("event_type") == "purchase") & (F.col("value") >= 340)).select(
        (F.col("user_id") + 100000).alias("user_id"), F.lit("ADMIN").alias("new_role"), "ts",
        F.col("event_id").alias("update_id"))
    return sig.unionByName(bad).unionByName(unknown)


UPD_SQL = """, upd AS (
  SELECT user_id, 'MODERATOR' AS new_role, ts, event_id AS update_id FROM events WHERE event_type = 'signup' AND value >= 300
  UNION ALL SELECT user_id, 'SUPERUSER', ts, event_id FROM events WHERE event_type = 'error' AND value >= 320
  UNION ALL SELECT user_id + 100000, 'ADMIN', ts, event_id FROM events WHERE event_type = 'purchase' AND value >= 340)"""


@register("apply_role_updates")
def apply_role_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of role updates applied to the users table (latest valid update wins)."""
    out, _ = T.apply_role_updates(users(spark, sf), role_updates(spark, sf))
    return out


oracle("apply_role_updates", "WITH x AS (SELECT 1)" + USERS_SQL + UPD_SQL + """,
last AS (SELECT user_id, arg_max(new_role, struct_pack(t := ts, i := update_id)) AS new_role FROM upd
         WHERE new_role IN ('USER', 'ADMIN', 'MODERATOR') AND user_id IN (SELECT user_id FROM users) GROUP BY user_id)
SELECT u.user_id, u.role AS old_role, coalesce(l.new_role, u.role) AS role,
  coalesce(l.new_role IS NOT NULL AND l.new_role <> u.role, FALSE) AS changed FROM users u LEFT JOIN last l USING (user_id)""")


@register("role_update_rejects")
def role_update_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The updates that were refused (invalid role, unknown user)."""
    _, rej = T.apply_role_updates(users(spark, sf), role_updates(spark, sf))
    return rej.select("update_id", "user_id", "new_role", "reason")


oracle("role_update_rejects", "WITH x AS (SELECT 1)" + USERS_SQL + UPD_SQL + """
SELECT update_id, user_id, new_role, 'invalid role' AS reason FROM upd WHERE new_role NOT IN ('USER', 'ADMIN', 'MODERATOR')
UNION ALL SELECT update_id, user_id, new_role, 'user not found' FROM upd
  WHERE new_role IN ('USER', 'ADMIN', 'MODERATOR') AND user_id NOT IN (SELECT user_id FROM users)""")


@register("schema_evolve")
def schema_evolve(spark: SparkSession, sf: str) -> DataFrame:
    """Turns the pipeline did not store (system turns, refused prompts and what followed
    them), as rows of the first message schema, merged with the stored messages into the
    second schema; added flags default to FALSE."""
    m = messages(spark, sf)
    raw = contract_turns(spark, sf)
    legacy = (raw.join(m.select(F.col("conversation_id").alias("conv_id"), "turn"), ["conv_id", "turn"], "left_anti")
                 .select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                         F.upper("role").alias("role"), F.col("text").alias("content"), F.lit("v1").alias("schema")))
    current = m.select("id", "role", "content", "bias_detected", "bias_score", "jailbreak_detected_in_output",
                       "sanitization_strategy", F.lit("v2").alias("schema"))
    merged = T.merge_versions(legacy, current, T.MESSAGE_ADDED_COLUMNS)
    return merged.select("id", "role", "content", "schema", "bias_detected", "bias_score", "jailbreak_detected_in_output",
                         "sanitization_strategy", "original_content")


oracle("schema_evolve", W + """
SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS id, upper(c.role) AS role, c.text AS content,
  'v1' AS schema, FALSE AS bias_detected, CAST(NULL AS DOUBLE) AS bias_score, FALSE AS jailbreak_detected_in_output,
  CAST(NULL AS VARCHAR) AS sanitization_strategy, CAST(NULL AS VARCHAR) AS original_content
FROM turns c WHERE NOT EXISTS (SELECT 1 FROM msgs m WHERE m.conversation_id = c.conv_id AND m.turn = c.turn)
UNION ALL SELECT id, role, content, 'v2', coalesce(bias_detected, FALSE), bias_score, coalesce(jailbreak_detected_in_output, FALSE),
  sanitization_strategy, CAST(NULL AS VARCHAR) FROM msgs""")


def delete_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Delete requests read from the event log: conversations named by large error events."""
    return event_log(spark, sf).filter((F.col("type") == "error") & (F.col("score") >= 300)).select(
        F.col("conversation_id").alias("id"))


@register("delete_cascade")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Messages left after deleting the requested conversations with their messages."""
    _, msgs_left, _ = T.delete_cascade(conversations(spark, sf), messages(spark, sf), delete_keys(spark, sf))
    return msgs_left.select("id", "conversation_id")


oracle("delete_cascade", W + ELOG + """
, k AS (SELECT DISTINCT conversation_id AS id FROM elog WHERE type = 'error' AND score >= 300 AND conversation_id IN (SELECT id FROM convs))
SELECT id, conversation_id FROM msgs WHERE conversation_id NOT IN (SELECT id FROM k)""")


@register("delete_not_found")
def delete_not_found(spark: SparkSession, sf: str) -> DataFrame:
    """Delete requests naming no stored conversation (the reference's 404)."""
    _, _, nf = T.delete_cascade(conversations(spark, sf), messages(spark, sf), delete_keys(spark, sf))
    return nf


oracle("delete_not_found", W + ELOG + """
SELECT DISTINCT conversation_id AS id FROM elog WHERE type = 'error' AND score >= 300
  AND conversation_id NOT IN (SELECT id FROM convs)""")


@register("get_or_create")
def get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation ids named in the event log - existing conversations are returned,
    the others created (title unknown until their first stored prompt)."""
    existing = conversations(spark, sf).select("id", "title")
    req = event_log(spark, sf).select(F.col("conversation_id").alias("id"))
    return T.get_or_create(existing, req, "id").select("id", "title", "created")


oracle("get_or_create", W + ELOG + """
, r AS (SELECT DISTINCT conversation_id AS id FROM elog)
SELECT r.id, c.title, c.id IS NULL AS created FROM r LEFT JOIN convs c ON c.id = r.id""")


def _email(uid):
    return F.concat(F.lit("user"), uid.cast("string"), F.lit("@corp.io"))


@register("reject_duplicate_keys")
def reject_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-up events as registrations; e-mails of purchasing users already exist;
    the first sign-up per new e-mail is accepted, later ones are duplicates."""
    e = read_table(spark, sf, "events")
    existing = e.filter(F.col("event_type") == "purchase").select(_email(F.col("user_id")).alias("email")).distinct()
    reqs = e.filter(F.col("event_type") == "signup").select(F.col("event_id"), _email(F.col("user_id")).alias("email"), "ts")
    return T.reject_duplicate_keys(existing, reqs, "email", ["ts", "event_id"], "event_id").select("event_id", "email", "status")


oracle("reject_duplicate_keys", """WITH ex AS (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) || '@corp.io' AS email FROM events
  WHERE event_type = 'purchase'),
rq AS (SELECT event_id, 'user' || CAST(user_id AS VARCHAR) || '@corp.io' AS email, ts FROM events WHERE event_type = 'signup'),
fst AS (SELECT email, arg_min(event_id, struct_pack(t := ts, i := event_id)) AS first_id FROM rq
        WHERE email NOT IN (SELECT email FROM ex) GROUP BY email)
SELECT rq.event_id, rq.email, CASE WHEN rq.email IN (SELECT email FROM ex) THEN 'exists'
  WHEN rq.event_id = fst.first_id THEN 'accepted' ELSE 'duplicate' END AS status FROM rq LEFT JOIN fst USING (email)""")


# ---------------------------------------------------------------- E1

@register("toxicity_eval")
def toxicity_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Rule toxicity (D15) against the labelled documents - confusion counts,
    accuracy, precision, recall and F1 per language."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    j = spread_for_cpu(docs).join(labels, "doc_id")
    scored = OF.with_toxicity(j, "text")
    return T.confusion(scored, F.col("toxic") == 1, F.col("toxicity.detected"), ["lang"])


oracle("toxicity_eval", "WITH src AS (SELECT d.doc_id, d.lang, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)), "
       + O.output_filter_ctes("src").strip() + """
, c AS (SELECT lang, count(*) AS n, count_if(toxic = 1 AND tox_det) AS tp, count_if(toxic <> 1 AND tox_det) AS fp,
  count_if(toxic = 1 AND NOT tox_det) AS fn, count_if(toxic <> 1 AND NOT tox_det) AS tn FROM of6 GROUP BY lang)
SELECT lang, n, tp, fp, fn, tn, CASE WHEN n > 0 THEN round((tp + tn) / n, 4) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall,
  CASE WHEN tp > 0 THEN round(2.0 * tp / (2.0 * tp + fp + fn), 4) ELSE 0.0 END AS f1 FROM c""")


# ---------------------------------------------------------------- M2, M6, M8

@register("probability_to_toxicity")
def probability_to_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """M2: model probabilities (event value / 100) mapped to detection and severity."""
    e = read_table(spark, sf, "events")
    t = SC.toxicity_from_probability(F.col("value") / 100.0)
    return e.select("event_id", F.round(t["score"], 4).alias("score"), t["detected"].alias("detected"),
                    t["severity"].alias("severity"))


oracle("probability_to_toxicity", """WITH p AS (SELECT event_id, greatest(0.0, least(1.0, value / 100.0)) AS prob FROM events)
SELECT event_id, round(prob, 4) AS score, prob >= 0.5 AS detected,
  CASE WHEN prob >= 0.5 THEN (CASE WHEN prob >= 0.8 THEN 'high' WHEN prob >= 0.6 THEN 'medium' ELSE 'low' END) END AS severity
FROM p""")


def _frac(c):
    return c - F.floor(c)


@register("probabilities_to_bias")
def probabilities_to_bias(spark: SparkSession, sf: str) -> DataFrame:
    """M6: three label probabilities per row (fractional parts of value/7, /11, /13) mapped
    to bias types, max score and severity."""
    e = read_table(spark, sf, "events")
    probs = F.array(_frac(F.col("value") / 7.0), _frac(F.col("value") / 11.0), _frac(F.col("value") / 13.0))
    b = SC.bias_from_probabilities(probs)
    return e.select("event_id", b["detected"].alias("detected"), F.array_join(b["types"], ", ").alias("types"),
                    F.round(b["score"], 4).alias("score"), b["severity"].alias("severity"))


oracle("probabilities_to_bias", """WITH p AS (SELECT event_id, [value / 7.0 - floor(value / 7.0), value / 11.0 - floor(value / 11.0),
  value / 13.0 - floor(value / 13.0)] AS pr FROM events),
q AS (SELECT event_id, pr, list_filter(['gender', 'racial', 'religious'], lambda l, i: pr[i] > 0.5) AS types, list_max(pr) AS s FROM p)
SELECT event_id, len(types) > 0 AS detected, array_to_string(types, ', ') AS types, round(s, 4) AS score,
  CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.2 THEN 'low' END AS severity FROM q""")


@register("score_distinct_join_back")
def score_distinct_join_back(spark: SparkSession, sf: str) -> DataFrame:
    """M8: toxicity scored once per distinct document text and joined back to every copy."""
    docs = spread_for_cpu(read_table(spark, sf, "documents").select("doc_id", "text"))

    def scorer(df, text):
        s = OF.with_toxicity(df, text)
        return s.select("*", F.col("toxicity.detected").alias("toxicity_detected"),
                        F.col("toxicity.score").alias("toxicity_score"))
    return SC.score_distinct(docs, "text", "doc_id", scorer, ["toxicity_detected", "toxicity_score"])


oracle("score_distinct_join_back", "WITH src AS (SELECT doc_id, text FROM documents), " + O.output_filter_ctes("src").strip()
       + "\nSELECT doc_id, tox_det AS toxicity_detected, tox_score AS toxicity_score FROM of6")


# ---------------------------------------------------------------- M3-M5 (rows), D12 (rows)

def _tokens(spark, sf):
    d = docs_with_planted(spark, sf).withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumn("_spans", P.resolve_spans(P.rule_pii_spans("_t")))
    return d.withColumn("tokens", MS.tokens_from_rule_spans("_t", "_spans"))


def _mspans_long(df, col, with_value=False):
    s = F.col("s")
    cols = ["doc_id", s["type"].alias("span_type"), s["start"].alias("span_start"), s["end"].alias("span_end")]
    if with_value:
        cols += [s["value"].alias("span_value"), F.round(s["confidence"], 4).alias("confidence")]
    else:
        cols += [F.round(F.aggregate(s["confs"], F.lit(0.0), lambda a, c: a + c) / F.size(s["confs"]), 4)
                 .alias("confidence")]
    return df.select("doc_id", F.explode_outer(col).alias("s")).filter(F.col("s").isNotNull()).select(*cols)


@register("bio_spans")
def bio_spans(spark: SparkSession, sf: str) -> DataFrame:
    """M3: BIO token labels decoded to spans (tokens from the deterministic stand-in tagger)."""
    return _mspans_long(_tokens(spark, sf).withColumn("sp", MS.decode("tokens")), "sp")


@register("merge_spans")
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    """M4: decoded spans merged when same-typed and at most 2 characters apart."""
    return _mspans_long(_tokens(spark, sf).withColumn("sp", MS.decode_and_merge("tokens")), "sp")


@register("span_thresholds")
def span_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """M5: merged spans cleaned (trailing punctuation), thresholded by type, validated."""
    return _mspans_long(_tokens(spark, sf).withColumn("sp", MS.model_spans("_t", "tokens")), "sp", with_value=True)


# Stand-in for a named-entity model: two capitalised words in a row are a PERSON, two or more capitals an ORG.
PERSON_RX, ORG_RX = "[A-Z][a-z]+ [A-Z][a-z]+", "[A-Z]{2,}"


def _entity_sql() -> str:
    def kept(label: str, rx: str) -> str:
        found = f"regexp_extract_all(coalesce(text, ''), '{rx}')"
        if label in L.NER_LABELS_LONG:
            found = f"list_filter({found}, lambda e: length(e) > 3 AND NOT list_contains({O.arr(L.NER_SKIP_WORDS)}, lower(e)))"
        return f"list_transform({found}, lambda e: '{label}: ' || e)"
    ents = f"list_concat({kept('PERSON', PERSON_RX)}, {kept('ORG', ORG_RX)})"
    return (f"WITH src AS {DOCS_SQL}, {O.prompt_ctes('src')}, en AS (SELECT *, {ents} AS ents FROM pa2)\n"
            "SELECT doc_id, array_to_string(ents, '; ') AS entities, pa_pii OR len(ents) > 0 AS pii_detected, "
            f"CASE WHEN pa_expl IS NULL AND len(ents) > 0 THEN {O.q(L.EXPL_NER)} || array_to_string(ents[1:{L.EXPLANATION_ITEMS}], {O.q(L.LIST_SEP)}) "
            "ELSE pa_expl END AS explanation FROM en")


@register("entity_filter", _entity_sql())
def entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Entities filtered by label, length and skip list; they set the PII flag and, when
    nothing else explains the prompt, the explanation. A model's entities come the same way,
    from a scorer column (M1)."""
    def found(label: str, rx: str):
        return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rx), F.lit(0)),
                           lambda e: F.struct(F.lit(label).alias("label"), e.alias("text")))
    d = docs_with_planted(spark, sf).withColumn("ents", F.concat(found("PERSON", PERSON_RX), found("ORG", ORG_RX)).cast(S.ENTITY_ARRAY))
    a = S.with_prompt_analysis(d, "text", "pa", entities="ents")
    return a.select("doc_id", F.array_join(F.col("pa.entities"), "; ").alias("entities"),
                    F.col("pa.pii_detected").alias("pii_detected"), F.col("pa.explanation").alias("explanation"))


# ---------------------------------------------------------------- F13

@register("clean_event_timestamps")
def clean_event_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """event times as a client receives them (even ids with an offset and a stray 'Z'),
    cleaned (a 'Z' after an explicit offset dropped), parsed, with default type/severity."""
    el = event_log(spark, sf)
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                   F.when(F.col("id") % 2 == 0, F.lit("+00:00Z")).otherwise(F.lit("Z")))
    clean = F.regexp_replace(iso, "([+-]\\d{2}:\\d{2})Z$", "$1")
    parsed = F.try_to_timestamp(clean)
    return el.select("id", F.date_format(parsed, TS_FMT).alias("timestamp"),
                     F.coalesce("type", F.lit("normal")).alias("type"), F.coalesce("severity", F.lit("low")).alias("severity"))


oracle("clean_event_timestamps", "WITH x AS (SELECT 1)" + ELOG + """
, s AS (SELECT id, type, severity, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN id % 2 = 0 THEN '+00:00Z' ELSE 'Z' END AS iso FROM elog)
SELECT id, strftime(TRY_CAST(regexp_replace(iso, '([+-]\\d{2}:\\d{2})Z$', '\\1') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS timestamp,
  coalesce(type, 'normal') AS type, coalesce(severity, 'low') AS severity FROM s""")


# Oracles for the decoder and merger on the stand-in tagger's tokens: every whitespace
# piece of a resolved rule span is tagged, and pieces of one span are separated by
# whitespace, so decoding yields one span per piece (an I- tag that starts after the open
# span's end opens a new span); merging joins same-typed neighbours at most 2 apart.
from textguard.plans.q_outfilter import DOCS_SQL  # noqa: E402

_PIECES = ("WITH src AS " + DOCS_SQL + ", " + O.privacy_ctes("src").strip() + """,
sp AS (SELECT doc_id, unnest(spans) AS s FROM pv5),
pc AS (SELECT doc_id, s, unnest(regexp_extract_all(s.v, '\\S+')) AS m,
              unnest(generate_series(1, len(regexp_extract_all(s.v, '\\S+')))) AS i FROM sp),
pz AS (SELECT doc_id, lower(s.t) AS span_type,
    CAST(s.s + coalesce(list_sum(list_transform(regexp_split_to_array(s.v, '\\S+')[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(regexp_extract_all(s.v, '\\S+')[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS span_start,
    length(m) AS len, s.c AS conf FROM pc),
pieces AS (SELECT doc_id, span_type, span_start, CAST(span_start + len AS INTEGER) AS span_end, conf FROM pz)""")

oracle("bio_spans", _PIECES + "\nSELECT doc_id, span_type, span_start, span_end, round(conf, 4) AS confidence FROM pieces")
_MERGE_BODY = """,
o AS (SELECT *, lag(span_type) OVER w AS pt, lag(span_end) OVER w AS pe FROM pieces
      WINDOW w AS (PARTITION BY doc_id ORDER BY span_start)),
g AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND pt = span_type AND span_start <= pe + 2 THEN 0 ELSE 1 END)
        OVER (PARTITION BY doc_id ORDER BY span_start ROWS UNBOUNDED PRECEDING) AS grp FROM o),
mg AS (SELECT doc_id, min(span_type) AS span_type, min(span_start) AS span_start, max(span_end) AS span_end,
  sum(conf) / count(*) AS confidence FROM g GROUP BY doc_id, grp)"""
oracle("merge_spans", _PIECES + _MERGE_BODY + "\nSELECT doc_id, span_type, span_start, span_end, round(confidence, 4) AS confidence FROM mg")
ORACLES_MERGE = _PIECES + _MERGE_BODY


def _span_thresholds_sql() -> str:
    from textguard.functions import lexicons as LX
    from textguard.operators.modelspans import STRUCTURED, VALIDATION_PATTERNS
    thr = "CASE " + " ".join(f"WHEN span_type = {O.q(k)} THEN {v}" for k, v in LX.MODEL_PII_THRESHOLDS.items()) + " ELSE 0.5 END"
    valid = "CASE " + " ".join(f"WHEN span_type = {O.q(k)} THEN regexp_matches(span_value, {O.q(p)})"
                               for k, p in VALIDATION_PATTERNS.items()) + \
            " ELSE length(span_value) >= 2 AND regexp_matches(span_value, '[\\pL\\pN]') END"
    punct = "[" + "".join("\\" + c for c in LX.MODEL_SPAN_STRIP_CHARS) + "]"
    structured = ", ".join(O.q(x) for x in STRUCTURED)
    lo, hi = "greatest(span_start - 20, 0)", "least(span_end + 20, length(text))"
    ctx = f"lower(substr(text, {lo} + 1, {hi} - {lo}))"
    math_near = " OR ".join(f"contains({ctx}, {O.q(op)})" for op in LX.MATH_INDICATORS)
    zip_bad = (f"(span_type = 'zip_code' AND ({math_near} OR (span_start > 0 AND regexp_matches(substr(text, span_start, 1), '^\\p{{Nd}}$')) "
               f"OR (span_end < length(text) AND regexp_matches(substr(text, span_end + 1, 1), '^\\p{{Nd}}$'))))")
    strip = "regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    v0 = strip.format(v="substr(text, span_start + 1, raw_end - span_start)")
    return (ORACLES_MERGE + f""",
t0 AS (SELECT m.doc_id, m.span_type, m.span_start, m.span_end AS raw_end, m.confidence, coalesce(d.text, '') AS text
       FROM mg m JOIN src d USING (doc_id)),
t1 AS (SELECT *, CASE WHEN span_type IN ({structured}) THEN 0
         ELSE length({v0}) - length(regexp_replace({v0}, '{punct}+$', '')) END AS k FROM t0),
t2 AS (SELECT doc_id, span_type, span_start, CAST(raw_end - k AS INTEGER) AS span_end, confidence, text FROM t1),
t3 AS (SELECT *, {strip.format(v="substr(text, span_start + 1, span_end - span_start)")} AS span_value FROM t2)
SELECT doc_id, span_type, span_start, span_end, span_value, confidence FROM t3
WHERE length(span_value) >= 3 AND confidence >= ({thr}) AND NOT {zip_bad} AND ({valid})""")


def _span_thresholds_oracle() -> str:
    sql = _span_thresholds_sql()
    # the final select rounds the confidence like the Spark side
    return sql.replace("SELECT doc_id, span_type, span_start, span_end, span_value, confidence FROM t3",
                       "SELECT doc_id, span_type, span_start, span_end, span_value, round(confidence, 4) AS confidence FROM t3")


oracle("span_thresholds", _span_thresholds_oracle())
