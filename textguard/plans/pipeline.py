"""Guarded chat pipeline (P1-P5, J3, J4, S3-S5, A14) over a table of conversation turns.

Input: ``turns(conv_id, turn, role, text)`` where ``turn`` orders the turns of a conversation; numbers
may have gaps. The reply a user turn got is the turn right after it when that turn is an assistant
turn; it is stored under that turn's own number and time.

Plan shape: one equi-join on the composite key (conv_id, turn) pairs each turn with the
next; hashing on both columns spreads even a conversation that holds a third of all rows
over every partition. Everything after the pairing is row-local (the detectors are
native column expressions). Roll-ups per conversation are partial/final aggregates
(``max_by``), so a hot conversation is pre-aggregated map-side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.text import truncate_with_ellipsis
from textguard.operators import outfilter as OF
from textguard.operators import pii as P
from textguard.operators import screen as S

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
USER_BUCKETS = 100       # derived owner: user_id = conv_id mod 100


def message_time(conv_id: Column, turn: Column) -> Column:
    """Derived message time: 2024-01-01 + conv_id hours + turn minutes."""
    return F.timestamp_seconds(F.lit(EPOCH_2024) + conv_id * 3600 + turn * 60)


def derived_user(conv_id: Column) -> Column:
    return F.pmod(conv_id, F.lit(USER_BUCKETS)).cast("bigint")


#: Turn numbers that one task orders at once when turns are paired.
TURN_BLOCK = 4096


def pair_turns(turns: DataFrame) -> DataFrame:
    """Every turn with the number, role and text of the turn after it in order (NULL at the end); numbers may
    have gaps. Only numbers are ordered, in blocks, so a very long conversation is not one task's window; a
    block's last number gets its successor from the conversation's next block. Texts meet on (conv_id,
    turn), which spreads such a conversation over all partitions."""
    n = turns.select("conv_id", "turn").distinct().withColumn("_blk", F.floor(F.col("turn") / TURN_BLOCK))
    near = n.withColumn("_near", F.lead("turn").over(Window.partitionBy("conv_id", "_blk").orderBy("turn")))
    heads = n.groupBy("conv_id", "_blk").agg(F.min("turn").alias("_head"))
    far = heads.select("conv_id", "_blk", F.lead("_head").over(Window.partitionBy("conv_id").orderBy("_blk")).alias("_far"))
    link = near.join(far, ["conv_id", "_blk"], "left").select("conv_id", F.col("turn").alias("_before"), F.coalesce("_near", "_far").alias("turn"))
    nxt = turns.select("conv_id", "turn", F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    nxt = link.where(F.col("turn").isNotNull()).join(nxt, ["conv_id", "turn"]).select(
        "conv_id", F.col("_before").alias("turn"), F.col("turn").alias("next_turn"), "next_role", "next_text")
    return turns.join(nxt, ["conv_id", "turn"], "left")


def guarded_exchanges(turns: DataFrame, mask_overrides: dict | None = None,
                      filter_strategies: dict | None = None) -> DataFrame:
    """One row per user turn with the prompt screen, prompt toxicity, masking, the
    reply's output filter and legacy response screen, and the ``refused`` flag."""
    ex = pair_turns(turns).filter(F.col("role") == "user")
    ex = ex.withColumn("reply", F.when(F.col("next_role") == "assistant", F.col("next_text")))
    # the prompt's normalised views are staged once for both prompt screens
    ex = S.with_screen_views(ex, "text")
    ex = S.with_prompt_analysis(ex, "text", "pa", staged=True)
    ex = S.with_response_analysis(ex, "text", "ptox", staged=True).drop(*S.SCREEN_TMP)
    ex = P.with_privacy(ex, "text", "priv", overrides=mask_overrides)
    ex = OF.with_output_filter(ex, "reply", "of", strategies=filter_strategies)
    ex = S.with_response_analysis(ex, "reply", "rtox")
    return ex.withColumn("refused", F.col("pa.is_flagged"))


def _pii_found(ex) -> Column:
    return F.col("priv.pii_detected") | F.col("priv.secrets_detected")


def _prompt_expl() -> Column:
    """Prompt explanation after masking: ' | PII detected and masked' appended when masked."""
    e = F.col("pa.explanation")
    return F.when(_pii_found(None), F.when(e.isNull(), F.lit(L.EXPL_PII_MASKED))
                  .otherwise(F.concat(e, F.lit(L.EXPL_SEP), F.lit(L.EXPL_PII_MASKED)))).otherwise(e)


def stored_messages(ex: DataFrame) -> DataFrame:
    """S3 + S4: the message rows the pipeline stores (none for refused prompts)."""
    ok = ex.filter(~F.col("refused"))
    ptox = F.col("ptox.toxicity_detected")
    user = ok.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("conversation_id"), "turn", F.lit("USER").alias("role"),
        F.col("priv.masked_text").alias("content"),
        message_time(F.col("conv_id"), F.col("turn")).alias("created_at"),
        (F.col("pa.is_flagged") | ptox).alias("is_flagged"),
        F.col("pa.jailbreak_score").alias("jailbreak_score"),
        F.when(ptox, F.col("ptox.toxicity_score")).alias("toxicity_score"),
        _pii_found(ok).alias("pii_detected"),
        F.coalesce(_prompt_expl(), F.when(ptox, F.col("ptox.explanation"))).alias("explanation"),
        F.col("text").alias("original_content"),
        F.col("priv.masked_text").alias("masked_content"),
        F.size("priv.mappings").alias("n_mappings"),
        F.when(F.size("priv.mappings") > 0, P.mappings_as_map(F.col("priv.mappings"))).alias("pii_mappings"),
        F.lit(None).cast("string").alias("filtered_content"),
        F.lit(False).alias("bias_detected"),
        F.lit(None).cast("double").alias("bias_score"),
        F.lit(False).alias("jailbreak_detected_in_output"),
        F.lit(None).cast("double").alias("jailbreak_score_in_output"),
        F.lit(None).cast(FILTER_ANALYSIS).alias("filter_analysis"),
        F.lit(None).cast("string").alias("sanitization_strategy"),
    )
    of, rt = F.col("of"), F.col("rtox")
    any_det = of["is_flagged"] | of["toxicity_detected"] | of["bias_detected"] | of["jailbreak_detected"]
    reply = ok.filter(F.col("reply").isNotNull()).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("next_turn").cast("string")).alias("id"),
        F.col("conv_id").alias("conversation_id"), F.col("next_turn").alias("turn"), F.lit("ASSISTANT").alias("role"),
        OF.final_text(F.col("reply"), of).alias("content"),
        message_time(F.col("conv_id"), F.col("next_turn")).alias("created_at"),
        (of["is_flagged"] | rt["is_flagged"]).alias("is_flagged"),
        F.lit(None).cast("double").alias("jailbreak_score"),
        F.when(of["toxicity_detected"], of["toxicity_score"])
         .when(rt["toxicity_detected"], rt["toxicity_score"]).alias("toxicity_score"),
        F.lit(False).alias("pii_detected"),
        F.coalesce(of["explanation"], rt["explanation"]).alias("explanation"),
        F.lit(None).cast("string").alias("original_content"),
        F.lit(None).cast("string").alias("masked_content"),
        F.lit(0).alias("n_mappings"),
        F.lit(None).cast(P_MAP).alias("pii_mappings"),
        F.when(any_det, F.col("reply")).alias("filtered_content"),
        of["bias_detected"].alias("bias_detected"),
        of["bias_score"].alias("bias_score"),
        of["jailbreak_detected"].alias("jailbreak_detected_in_output"),
        of["jailbreak_score"].alias("jailbreak_score_in_output"),
        F.when(any_det, F.struct(
            of["toxicity_detected"].alias("toxicity_detected"), of["bias_detected"].alias("bias_detected"),
            of["jailbreak_detected"].alias("jailbreak_detected"),
            F.when(of["toxicity_detected"], of["toxicity_score"]).alias("toxicity_score"),
            F.when(of["bias_detected"], of["bias_score"]).alias("bias_score"),
            F.when(of["jailbreak_detected"], of["jailbreak_score"]).alias("jailbreak_score"),
            of["severity"].alias("severity"))).alias("filter_analysis"),
        of["sanitization_strategy"].alias("sanitization_strategy"),
    )
    return user.unionByName(reply)


FILTER_ANALYSIS = ("struct<toxicity_detected:boolean,bias_detected:boolean,jailbreak_detected:boolean,"
                   "toxicity_score:double,bias_score:double,jailbreak_score:double,severity:string>")
P_MAP = "map<string,struct<original:string,type:string,strategy:string,confidence:double>>"

EVENT_FIELDS = ("seq int, type string, severity string, message string, conversation_id bigint, is_flagged boolean, "
                "explanation string, jailbreak_score double, toxicity_score double")


def _event(seq: int, etype, severity, message, conv, flagged, expl, jb, tox) -> Column:
    def c(x, t=None):
        v = x if isinstance(x, Column) else F.lit(x)
        return v.cast(t) if t else v
    return F.struct(F.lit(seq).alias("seq"), c(etype, "string").alias("type"), c(severity, "string").alias("severity"),
                    F.substring(c(message, "string"), 1, L.TRUNC_EVENT_MESSAGE).alias("message"),
                    c(conv, "bigint").alias("conversation_id"), c(flagged, "boolean").alias("is_flagged"),
                    c(expl, "string").alias("explanation"), c(jb, "double").alias("jailbreak_score"),
                    c(tox, "double").alias("toxicity_score"))


def event_array() -> Column:
    """The events one exchange records, in order (array of structs)."""
    text, conv = F.col("text"), F.col("conv_id")
    refused, ptox = F.col("refused"), F.col("ptox.toxicity_detected")
    of, rt = F.col("of"), F.col("rtox")
    pii = _pii_found(None) & ~refused
    out_type = F.when(of["jailbreak_detected"], "jailbreak_output").when(of["bias_detected"], "bias").otherwise("toxicity")
    out_sev = F.when(of["severity"] == "critical", "critical").when(of["severity"] == "high", "high").otherwise("medium")
    none = F.lit(None)
    cands = [
        (ptox, _event(1, "toxicity", "medium", text, none, True, F.col("ptox.explanation"), none,
                      F.col("ptox.toxicity_score"))),
        (refused, _event(2, "jailbreak", "high", text, none, True, F.col("pa.explanation"), F.col("pa.jailbreak_score"),
                         none)),
        (pii, _event(3, "pii", "high", text, conv, False, _prompt_expl(), none, none)),
        (~refused & of["is_flagged"], _event(4, out_type, out_sev, F.col("reply"), conv, True, of["explanation"], none,
                                             of["toxicity_score"])),
        (~refused & ~of["is_flagged"] & rt["is_flagged"], _event(4, "toxicity", "medium", text, conv, True,
                                                                 rt["explanation"], none, rt["toxicity_score"])),
        (~refused & ~of["is_flagged"] & ~rt["is_flagged"] & ~pii,
         _event(4, "normal", "low", text, conv, False, none, none, none)),
    ]
    empty = F.array().cast(f"array<struct<{EVENT_FIELDS}>>")
    return F.concat(*[F.when(cond, F.array(ev)).otherwise(empty) for cond, ev in cands])


def security_events(ex: DataFrame) -> DataFrame:
    """The events exploded to rows. Ids are deterministic hashes of
    (conversation, turn, seq); times are the turn's time."""
    ev = ex.select("conv_id", "turn", F.explode_outer(event_array()).alias("e")).filter(F.col("e").isNotNull())
    return ev.select(
        F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"),
                           F.col("e.seq").cast("string")), 256).substr(1, 32).alias("id"),
        message_time(F.col("conv_id"), F.col("turn")).alias("timestamp"),
        F.col("conv_id").alias("source_conv_id"), "turn", F.col("e.seq").alias("seq"),
        F.col("e.type").alias("type"), F.col("e.severity").alias("severity"), F.col("e.message").alias("message"),
        F.col("e.conversation_id").alias("conversation_id"), derived_user(F.col("conv_id")).alias("user_id"),
        F.col("e.is_flagged").alias("is_flagged"), F.col("e.explanation").alias("explanation"),
        F.col("e.jailbreak_score").alias("jailbreak_score"), F.col("e.toxicity_score").alias("toxicity_score"))


ROLLUP_FLAGS = ("is_flagged", "jailbreak_detected", "pii_detected", "toxicity_detected", "bias_detected", "jailbreak_detected_in_output")


def conversation_partials(ex: DataFrame) -> DataFrame:
    """A14 as mergeable state: what some exchanges tell about their conversations, one row each. ``latest`` are the flags of
    the highest turn, ``first_text`` is the text of the lowest."""
    ok = ex.filter(~F.col("refused"))
    of, rt = F.col("of"), F.col("rtox")
    values = (F.col("pa.is_flagged") | of["is_flagged"] | rt["is_flagged"], F.col("pa.jailbreak_detected"), _pii_found(ok),
              of["toxicity_detected"] | rt["is_flagged"], of["bias_detected"], of["jailbreak_detected"])
    flags = F.struct(*(v.alias(n) for n, v in zip(ROLLUP_FLAGS, values)))
    return merged_partials(ok.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("last_turn"), flags.alias("latest"), F.col("turn").alias("first_turn"), F.col("text").alias("first_text"),
        flags["is_flagged"].alias("any_flagged"), flags["toxicity_detected"].alias("any_toxicity"), F.lit(1).cast("bigint").alias("exchanges")))


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row a conversation from rows about disjoint parts of it; merging in any order and grouping gives the same."""
    return partials.groupBy("id").agg(
        F.max("last_turn").alias("last_turn"), F.max_by("latest", "last_turn").alias("latest"), F.min("first_turn").alias("first_turn"),
        F.min_by("first_text", "first_turn").alias("first_text"), F.bool_or("any_flagged").alias("any_flagged"),
        F.bool_or("any_toxicity").alias("any_toxicity"), F.sum("exchanges").alias("exchanges"))


def finished_rollup(partials: DataFrame) -> DataFrame:
    """The roll-up that merged partials stand for."""
    return partials.select(
        "id", truncate_with_ellipsis(F.col("first_text"), L.TRUNC_TITLE).alias("title"), derived_user(F.col("id")).alias("user_id"),
        message_time(F.col("id"), F.col("first_turn")).alias("created_at"), *(F.col("latest")[f].alias(f) for f in ROLLUP_FLAGS),
        F.coalesce("any_flagged", F.lit(False)).alias("any_flagged"), F.coalesce("any_toxicity", F.lit(False)).alias("any_toxicity"), "exchanges")


def conversation_rollup(ex: DataFrame) -> DataFrame:
    """A14 + S10: one row per conversation that stored anything. Flags are those of the
    last exchange (last write wins, ``max_by`` over turn); ``any_*`` are the OR over all
    exchanges. Title and creation time come from the first stored user turn."""
    return finished_rollup(conversation_partials(ex))


def refused_turns(ex: DataFrame) -> DataFrame:
    """Prompts refused before anything was stored, with the reply text shown to the user."""
    return ex.filter(F.col("refused")).select(
        "conv_id", "turn", F.lit(L.MSG_REFUSED).alias("message"), F.col("pa.explanation").alias("explanation"),
        F.col("pa.jailbreak_score").alias("jailbreak_score"), F.col("pa.pii_detected").alias("pii_detected"))


def basic_exchanges(turns: DataFrame) -> DataFrame:
    """P5: the simple pipeline - prompt screen and lexicon screens only, no masking or filter."""
    ex = pair_turns(turns).filter(F.col("role") == "user")
    ex = ex.withColumn("reply", F.when(F.col("next_role") == "assistant", F.col("next_text")))
    ex = S.with_screen_views(ex, "text")
    ex = S.with_prompt_analysis(ex, "text", "pa", staged=True)
    ex = S.with_response_analysis(ex, "text", "ptox", staged=True).drop(*S.SCREEN_TMP)
    return S.with_response_analysis(ex, "reply", "rtox")
