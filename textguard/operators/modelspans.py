"""Token-classification decoding (M3), span merging (M4) and span clean-up (M5).

The input is one array of tokens per text, ``array<struct<label,conf,start,end>>`` in
token order (what a token-classification scorer emits for one text). Decoding and merging
are folds over that array, so a text is handled inside its own row: no shuffle, and no
text is ever grouped with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.sqltext import ident, sql_str
from textguard.operators.ordered import DEFAULT_BLOCK, blocked_latest, blocked_previous
from textguard.session import written

MSPAN = "STRUCT<type:STRING,start:INT,end:INT,confs:ARRAY<DOUBLE>>"
TOKEN_ARRAY = "array<struct<label:string,conf:double,start:int,end:int>>"


def decode_bio_sql(tokens: str) -> str:
    """M3: special tokens (0, 0) and 'O' close the open span; 'B-' or a type change opens
    one; a same-type tag extends it only when it starts at or before the span's end
    (otherwise it opens a new one); a tag with no open span and no 'B-' is ignored."""
    t = ident(tokens)
    new = "named_struct('type', tg, 'start', x.start, 'end', x.end, 'confs', array(x.conf))"
    close = "CASE WHEN acc.cur IS NULL THEN acc.spans ELSE array_append(acc.spans, acc.cur) END"
    # prefix/tag of the label: 'B-NAME' -> ('B', 'name'); a label without '-' -> ('O', label)
    step = f"""(acc, x) -> CASE
      WHEN (x.start = 0 AND x.end = 0) OR x.label = 'O'
        THEN named_struct('spans', {close}, 'cur', CAST(NULL AS {MSPAN}))
      ELSE (CASE
        WHEN pfx = 'B' OR (acc.cur IS NOT NULL AND acc.cur.type <> tg)
          THEN named_struct('spans', {close}, 'cur', {new})
        WHEN acc.cur IS NOT NULL AND x.start <= acc.cur.end
          THEN named_struct('spans', acc.spans, 'cur', named_struct('type', acc.cur.type, 'start', acc.cur.start,
               'end', x.end, 'confs', array_append(acc.cur.confs, x.conf)))
        WHEN acc.cur IS NOT NULL
          THEN named_struct('spans', array_append(acc.spans, acc.cur), 'cur', {new})
        ELSE acc END) END"""
    pfx = "(CASE WHEN instr(x.label, '-') > 0 THEN substring_index(x.label, '-', 1) ELSE 'O' END)"
    tg = "lower(CASE WHEN instr(x.label, '-') > 0 THEN substr(x.label, instr(x.label, '-') + 1) ELSE x.label END)"
    step = step.replace("pfx", pfx).replace("tg", tg)
    init = f"named_struct('spans', CAST(array() AS ARRAY<{MSPAN}>), 'cur', CAST(NULL AS {MSPAN}))"
    finish = "acc -> CASE WHEN acc.cur IS NULL THEN acc.spans ELSE array_append(acc.spans, acc.cur) END"
    return f"aggregate({t}, {init}, {step}, {finish})"


def merge_spans_sql(spans: str) -> str:
    """M4: sorted by start; a span merges into the last kept one when the type is equal and
    it starts at most 2 characters after that span's end (confidences pooled)."""
    sorted_spans = f"array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE 0 END)"
    gap = L.MODEL_SPAN_MERGE_GAP
    step = f"""(acc, s) -> CASE
      WHEN size(acc) > 0 AND element_at(acc, -1).type = s.type AND s.start <= element_at(acc, -1).end + {gap}
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('type', s.type, 'start', element_at(acc, -1).start,
             'end', greatest(element_at(acc, -1).end, s.end), 'confs', concat(element_at(acc, -1).confs, s.confs))))
      ELSE array_append(acc, s) END"""
    return f"aggregate({sorted_spans}, CAST(array() AS ARRAY<{MSPAN}>), {step})"


STRUCTURED = ["email", "phone", "ssn", "credit_card", "date_of_birth"]
VALIDATION_PATTERNS = {
    # FIXED VALUES: full-value validation patterns of the model path, by type.
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\d\s\-\(\)\+\.]{10,}$",
    "ssn": r"^\d{3}[-]?\d{2}[-]?\d{4}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "date_of_birth": r"^(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}$",
    "zip_code": r"^\d{5}(?:-\d{4})?$",
}


def finalize_spans_sql(text: str, spans: str, min_len: int = L.MODEL_SPAN_MIN_LEN, min_conf: float = 0.5) -> str:
    """M5: value = stripped text of the span; unstructured types lose trailing
    punctuation (the end moves back by the characters removed); mean confidence; keep
    when long enough, confident enough for the type, and valid for the type."""
    t = ident(text)
    strip = "regexp_replace({v}, '^\\\\s+|\\\\s+$', '')"
    raw = f"substr({t}, s.start + 1, s.end - s.start)"
    val0 = strip.format(v=raw)
    punct = "[" + "".join("\\\\" + c for c in L.MODEL_SPAN_STRIP_CHARS) + "]"
    k = f"(length({val0}) - length(regexp_replace({val0}, '{punct}+$', '')))"
    structured = ", ".join(sql_str(x) for x in STRUCTURED)
    k = f"(CASE WHEN s.type IN ({structured}) THEN 0 ELSE {k} END)"
    stage1 = (f"transform({spans}, s -> named_struct('type', s.type, 'start', s.start, 'end', s.end - {k}, "
              f"'k', {k}, 'conf', aggregate(s.confs, 0D, (a, c) -> a + c) / size(s.confs)))")
    value = (f"CASE WHEN s.k > 0 THEN {strip.format(v=f'substr({t}, s.start + 1, s.end - s.start)')} "
             f"ELSE {strip.format(v=f'substr({t}, s.start + 1, s.end - s.start)')} END")
    with_value = (f"transform({stage1}, s -> named_struct('type', s.type, 'start', s.start, 'end', s.end, "
                  f"'confidence', s.conf, 'value', {value}))")
    thr = "CASE " + " ".join(f"WHEN s.type = {sql_str(k_)} THEN {v}" for k_, v in L.MODEL_PII_THRESHOLDS.items()) \
          + f" ELSE {min_conf} END"
    valid_typed = "CASE " + " ".join(
        f"WHEN s.type = {sql_str(k_)} THEN s.value RLIKE {sql_str(p)}" for k_, p in VALIDATION_PATTERNS.items()) \
        + " ELSE length(s.value) >= 2 AND s.value RLIKE '[\\\\p{L}\\\\p{N}]' END"
    lo = f"greatest(s.start - {L.ZIP_CONTEXT_CHARS}, 0)"
    hi = f"least(s.end + {L.ZIP_CONTEXT_CHARS}, length({t}))"
    ctx = f"lower(substr({t}, {lo} + 1, {hi} - {lo}))"
    math_near = " OR ".join(f"contains({ctx}, {sql_str(op)})" for op in L.MATH_INDICATORS)
    zip_bad = (f"(s.type = 'zip_code' AND ({math_near} OR (s.start > 0 AND substr({t}, s.start, 1) RLIKE '^\\\\p{{Nd}}$') "
               f"OR (s.end < length({t}) AND substr({t}, s.end + 1, 1) RLIKE '^\\\\p{{Nd}}$')))")
    keep = f"length(s.value) >= {min_len} AND s.confidence >= ({thr}) AND NOT {zip_bad} AND ({valid_typed})"
    return f"filter({with_value}, s -> {keep})"


def decode(tokens: str) -> Column:
    return F.expr(decode_bio_sql(tokens))


def decode_and_merge(tokens: str) -> Column:
    return F.expr(merge_spans_sql(decode_bio_sql(tokens)))


def model_spans(text: str, tokens: str) -> Column:
    """M3 -> M4 -> M5: final model detections of one text."""
    return F.expr(finalize_spans_sql(text, merge_spans_sql(decode_bio_sql(tokens))))


def tokens_from_rule_spans(text: str, spans: str) -> Column:
    """Deterministic stand-in for a token-classification model (tests and contract
    queries only). Each rule span becomes its whitespace-separated pieces, labelled
    B-<TYPE> then I-<TYPE> with the rule's confidence, followed by one 'O' token; the whole
    sequence is framed by special (0, 0) tokens. Runs of 'O' tokens decode exactly like one,
    so the untagged text between spans is represented by that single separator, and the
    work per text is linear in the size of its spans."""
    sp = ident(spans)
    pieces = ("aggregate(zip_with(regexp_extract_all(s.value, '\\\\S+', 0), split(s.value, '\\\\S+', -1), "
              "(m, p) -> named_struct('m', m, 'pl', length(p))), named_struct('pos', 0, 'toks', "
              "CAST(array() AS ARRAY<STRUCT<start:INT,end:INT>>)), (acc, x) -> CASE WHEN x.m IS NULL THEN acc ELSE "
              "named_struct('pos', acc.pos + x.pl + length(x.m), 'toks', array_append(acc.toks, "
              "named_struct('start', acc.pos + x.pl, 'end', acc.pos + x.pl + length(x.m)))) END).toks")
    per_span = (f"concat(transform({pieces}, (k, i) -> named_struct('label', concat(CASE WHEN i = 0 THEN 'B-' ELSE 'I-' END, "
                f"upper(s.type)), 'conf', s.confidence, 'start', s.start + k.start, 'end', s.start + k.end)), "
                f"array(named_struct('label', 'O', 'conf', 1.0D, 'start', s.end, 'end', s.end + 1)))")
    special = "array(named_struct('label', 'O', 'conf', 1.0D, 'start', 0, 'end', 0))"
    return F.expr(f"concat({special}, flatten(transform({sp}, s -> {per_span})), {special})")


# ---------------------------------------------------------------- M3, M4 over a table of tokens

#: Tokens of a word: how many of them one bit mask (a non-negative bigint) describes.
WORD = 62


def spans_of_tokens(tokens: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """M3 over a table (doc_id, idx, label, conf, start, end) of a tagger's tokens, one row each: (doc_id, first, type, start, end,
    conf_sum, n_tokens), ``first`` the idx of a span's first token. The same rules as ``decode_bio_sql``, stated over
    neighbours: between special or 'O' tokens, tokens before the first 'B-' are ignored; from there on a token opens a span
    if it is a 'B-', of another type than the token before it, or starts behind that one's end, else it extends the
    span. A document's tokens are ordered in blocks, so a long document is not one task's window.

    Tokens outside move as bits only: a word of ``WORD`` tokens has a mask of those outside and one of the others, built
    before the shuffle, and tells each of its tokens whether the one before it is outside. The tokens of a block then become pieces of
    spans; those certainly before a 'B-' are dropped there, and pieces that meet at a border of blocks are joined."""
    t = tokens.select("doc_id", "idx", "label", "conf", "start", "end", F.floor(F.col("idx") / F.lit(block)).cast("bigint").alias("_blk"))
    place = F.col("idx") - F.col("_blk") * block
    word, bit = F.floor(place / WORD).cast("int"), F.expr(f"shiftleft(1L, CAST((idx - _blk * {block}) % {WORD} AS INT))")
    kept = F.coalesce(~_out(), F.lit(True))
    words = written(t.groupBy("doc_id", "_blk", word.alias("_word")).agg(F.bit_or(F.when(kept, 0).otherwise(bit)).alias("outs"),
                                                                         F.bit_or(F.when(kept, bit).otherwise(0)).alias("ins")), "token-words")
    pieces = written(_pieces(t.where(kept), words, word, bit), "token-pieces")
    return _stitched(pieces, words, block)


def _out() -> Column:
    """Whether a token is special or 'O'."""
    return ((F.col("start") == 0) & (F.col("end") == 0)) | (F.col("label") == "O")


def _pieces(kept: DataFrame, words: DataFrame, word: Column, bit: Column) -> DataFrame:
    """The spans inside each block, and what may belong to one: the tokens of a block from one that opens a piece to the next. A
    block's first token opens one. ``prev_out``: whether the token before the piece is outside, null for a block's first token; ``dead``: no
    'B-' since the last token outside (of these, the last one of a block only)."""
    w = Window.partitionBy("doc_id", "_blk").orderBy("_word", F.col("idx").asc_nulls_first())
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    label = F.col("label")
    tagged = F.instr(label, "-") > 0
    # only the tokens' own columns are shuffled; a word's masks then stand before its tokens
    rows = kept.unionByName(words, allowMissingColumns=True).repartition("doc_id", "_blk").withColumns({
        "_word": F.coalesce("_word", word), "out": _out(), "begins": tagged & (F.substring_index(label, "-", 1) == "B"),
        "type": F.lower(F.when(tagged, label.substr(F.instr(label, "-") + 1, F.length(label))).otherwise(label))})
    is_token = F.col("idx").isNotNull()
    rows = rows.withColumns({
        "_outs": F.last("outs", ignorenulls=True).over(so_far), "_ins": F.last("ins", ignorenulls=True).over(so_far),
        "_ahead": F.when(~is_token, F.last(F.col("outs") > F.col("ins"), ignorenulls=True).over(before)),
        "_near": F.last(F.when(is_token, F.struct("type", "end", "out")), ignorenulls=True).over(before)})
    rows = rows.withColumn("_ahead", F.last("_ahead", ignorenulls=True).over(so_far)).where(is_token)
    outs, ins = F.col("_outs").bitwiseAND(bit - 1), F.col("_ins").bitwiseAND(bit - 1)  # the higher mask has the nearer token
    near = F.col("_near")
    rows = rows.withColumn("prev_out", F.when((outs > 0) | (ins > 0), outs > ins).otherwise(F.col("_ahead")))
    opens = (F.col("begins") | F.coalesce("prev_out", F.lit(True)) | near.isNull() | near["out"].isNull() | (near["type"] != F.col("type"))
             | (F.col("start") > near["end"]))
    rows = rows.withColumns({"first": F.max(F.when(opens, F.col("idx"))).over(so_far),
                             "_b": F.max(F.when(F.col("begins") & ~F.col("out"), F.col("idx"))).over(so_far),
                             "_fresh": F.max(F.when(F.col("prev_out"), F.col("idx"))).over(so_far),
                             "_top": F.max("idx").over(Window.partitionBy("doc_id", "_blk"))})
    dead = F.col("_fresh").isNotNull() & (F.col("_fresh") > F.coalesce("_b", F.lit(-1 << 62)))
    rows = rows.where(~F.col("out")).withColumn("dead", dead).where(~F.col("dead") | (F.col("idx") == F.col("_top")))
    return rows.groupBy("doc_id", "_blk", "first").agg(
        F.min_by("type", "idx").alias("type"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.sum("conf").alias("conf_sum"),
        F.count(F.lit(1)).alias("n_tokens"), F.max("begins").alias("begins"), F.max("dead").alias("dead"), F.min_by("prev_out", "idx").alias("prev_out"))


def _stitched(pieces: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """Spans of the pieces: those after a 'B-', a block's first one joined to the one before it where it extends that."""
    ends = words.groupBy("doc_id", "_blk").agg(F.max_by(F.col("outs") > F.col("ins"), "_word").alias("_last"))
    ahead = ends.select("doc_id", "_blk", F.lag("_last").over(Window.partitionBy("doc_id").orderBy("_blk")).alias("_out_ahead"))
    p = pieces.join(ahead, ["doc_id", "_blk"], "left").withColumn("_at_border", F.col("prev_out").isNull()).drop("_blk")
    p = p.withColumn("prev_out", F.coalesce("prev_out", "_out_ahead", F.lit(True))).drop("_out_ahead")
    p = blocked_previous(p, "doc_id", "first", ["type", "end"], block)
    p = blocked_latest(p, "doc_id", "first", {"last_b": F.col("begins"), "fresh": F.col("prev_out") | F.col("dead")}, block)
    p = p.where(F.col("last_b") >= F.coalesce("fresh", F.lit(-1 << 62)))
    opens = ~F.col("_at_border") | F.col("begins") | F.col("prev_out") | F.col("prev_type").isNull() | (F.col("prev_type") != F.col("type")) | (F.col("start") > F.col("prev_end"))
    p = blocked_latest(p.withColumn("opens", opens), "doc_id", "first", {"span": F.col("opens")}, block)
    return p.groupBy("doc_id", F.col("span").alias("first")).agg(
        F.min_by("type", p["first"]).alias("type"), F.min_by("start", p["first"]).alias("start"), F.max_by("end", p["first"]).alias("end"),
        F.sum("conf_sum").alias("conf_sum"), F.sum("n_tokens").alias("n_tokens"))


def merged_token_spans(spans: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """M4 over ``spans_of_tokens`` of a tagger whose spans end in the order in which they start: neighbours of one type
    at most MODEL_SPAN_MERGE_GAP characters apart are one span, their confidences pooled."""
    s = blocked_previous(spans, "doc_id", "first", ["type", "end"], block)
    opens = F.col("prev_type").isNull() | (F.col("prev_type") != F.col("type")) | (F.col("start") > F.col("prev_end") + L.MODEL_SPAN_MERGE_GAP)
    s = blocked_latest(s.withColumn("opens", opens), "doc_id", "first", {"group": F.col("opens")}, block)
    return s.groupBy("doc_id", "group").agg(F.min_by("type", "first").alias("type"), F.min_by("start", "first").alias("start"), F.max("end").alias("end"),
                                            F.sum("conf_sum").alias("conf_sum"), F.sum("n_tokens").alias("n_tokens"))
