"""Contract queries for M3 and M4 over a table of tokens.

The tagger is a rule on pieces of four characters, read from the texts: a piece that begins with a capital letter is the beginning
of a NAME, one with a digit continues a CODE, one that begins with a vowel continues a NAME, the others, and all with white space,
are outside. So spans of several tokens, changes of type inside a run, continuations without a beginning and, as every
fifth token ends a character early, gaps inside a run all occur. A special token stands before and behind each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators import modelspans as MS
from textguard.plans.catalog import register
from textguard.plans.q_outfilter import DOCS_SQL, docs_with_planted

PIECE = 4


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, label, conf, start, end): tokens of every text of ``docs`` by the rule tagger. conf is in tenths."""
    text = F.coalesce("text", F.lit(""))
    n = F.floor((F.length(text) + PIECE - 1) / PIECE).cast("int")
    parts = F.regexp_extract_all(text, F.lit(r"[\s\S]{1,4}"), F.lit(0))
    t = docs.select("doc_id", F.posexplode(F.concat(F.array(F.lit("")), parts, F.array(F.lit("")))).alias("k", "piece"), n.alias("n"))
    i, p = F.col("k") - 1, F.col("piece")
    special = (F.col("k") == 0) | (F.col("k") == F.col("n") + 1)
    label = (F.when(special, "B-NAME").when(p.rlike("[\\t\\n\\r ]"), "O").when(p.rlike("^[A-Z]"), "B-NAME").when(p.rlike("[0-9]"), "I-CODE")
             .when(p.rlike("^[aeiou]"), "I-NAME").otherwise("O"))
    start = F.when(special, 0).otherwise(i * PIECE)
    end = F.when(special, 0).otherwise(i * PIECE + F.when(i % 5 == 2, PIECE - 1).otherwise(PIECE))
    return t.select("doc_id", i.cast("bigint").alias("idx"), label.alias("label"), (1 + F.pmod(i, F.lit(9))).cast("bigint").alias("conf"),
                    start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


_TOKENS_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\s\S]{{1,4}}') AS ps FROM {DOCS_SQL}),
e AS (SELECT doc_id, unnest(list_concat([''], ps, [''])) AS piece, unnest(range(0, len(ps) + 2)) AS k, len(ps) AS n FROM d),
tok AS (SELECT doc_id, k - 1 AS idx, k = 0 OR k = n + 1 AS special, 1 + ((k - 1) % 9 + 9) % 9 AS conf,
    CASE WHEN k = 0 OR k = n + 1 THEN 0 ELSE (k - 1) * 4 END AS s,
    CASE WHEN k = 0 OR k = n + 1 THEN 0 ELSE (k - 1) * 4 + CASE WHEN (k - 1) % 5 = 2 THEN 3 ELSE 4 END END AS t,
    CASE WHEN k = 0 OR k = n + 1 THEN 'B-NAME' WHEN regexp_matches(piece, '[\t\n\r ]') THEN 'O' WHEN regexp_matches(piece, '^[A-Z]') THEN 'B-NAME'
         WHEN regexp_matches(piece, '[0-9]') THEN 'I-CODE' WHEN regexp_matches(piece, '^[aeiou]') THEN 'I-NAME' ELSE 'O' END AS label FROM e),
tg AS (SELECT doc_id, idx, s, t, conf, special OR label = 'O' AS o, NOT special AND label[1] = 'B' AS b, lower(label[3:]) AS ty FROM tok),
run AS (SELECT *, sum(CAST(o AS INT)) OVER w AS run, lag(ty) OVER w AS pty, lag(t) OVER w AS pt, lag(o) OVER w AS po FROM tg
        WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
live AS (SELECT *, bool_or(b) OVER (PARTITION BY doc_id, run ORDER BY idx) AS live FROM run WHERE NOT o),
op AS (SELECT *, sum(CAST(b OR po OR pty <> ty OR s > pt AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS span FROM live WHERE live),
sp AS (SELECT doc_id, min(idx) AS first, min(ty) AS span_type, min(s) AS s, max(t) AS t, sum(conf) AS c, count(*) AS n FROM op GROUP BY doc_id, span)"""


def _shown(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", F.col("type").alias("span_type"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "n_tokens",
                        F.round(F.col("conf_sum") / F.col("n_tokens") / 10, 4).alias("confidence"))


@register("token_table_spans", _TOKENS_SQL + """
SELECT doc_id, span_type, s AS span_start, t AS span_end, n AS n_tokens, round(c / n / 10, 4) AS confidence FROM sp""")
def token_table_spans(spark: SparkSession, sf: str) -> DataFrame:
    """M3 over a token table: continuations, changes of type, orphans and gaps."""
    return _shown(MS.spans_of_tokens(token_table(docs_with_planted(spark, sf))))


@register("token_table_merged", _TOKENS_SQL + """,
pv AS (SELECT *, lag(span_type) OVER w AS pty, lag(t) OVER w AS pt FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
g AS (SELECT *, sum(CASE WHEN pty = span_type AND s <= pt + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY first) AS grp FROM pv),
mg AS (SELECT doc_id, min(span_type) AS span_type, min(s) AS s, max(t) AS t, sum(c) AS c, sum(n) AS n FROM g GROUP BY doc_id, grp)
SELECT doc_id, span_type, s AS span_start, t AS span_end, CAST(n AS BIGINT) AS n_tokens, round(c / n / 10, 4) AS confidence FROM mg""")
def token_table_merged(spark: SparkSession, sf: str) -> DataFrame:
    """M4 over a token table: spans of one type a character apart are one."""
    return _shown(MS.merged_token_spans(MS.spans_of_tokens(token_table(docs_with_planted(spark, sf)))))
