"""PII detection (D1-D4), span resolution (D2/J5), masking (D5/D6), secrets.

Spans are computed per row from the row's own text, so every job here is a narrow
stage: no shuffle, no driver round trip, and the work per row is bounded by the
length of that row's text. Offsets are code-point based and end-exclusive.

Offsets without a UDF: ``regexp_extract_all`` returns the matches and ``split`` the
pieces between them (both walk the same ``Matcher.find`` sequence), so match i
starts at the summed length of pieces 0..i and matches 0..i-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L
from textguard.functions.arrays import FOLD_CHUNK, TextBlocks, let, runs, scan
from textguard.functions.sqltext import expr, ident, sql_str
from textguard.functions.text import ci, col_, shannon_entropy, trivial_secret_password

SPAN_FIELDS = "start int, end int, type string, value string, confidence double"
SPAN = f"struct<{SPAN_FIELDS}>"
SPAN_ARRAY = f"array<{SPAN}>"


def _empty_spans() -> Column:
    return F.array().cast(SPAN_ARRAY)


SPAN_ARRAY_SQL = "ARRAY<STRUCT<start:INT,end:INT,type:STRING,value:STRING,confidence:DOUBLE>>"


def regex_spans_sql(text: str, pattern: str, span_type: str, confidence: float) -> str:
    """All non-overlapping matches of ``pattern`` in column ``text`` as span structs, in order.
    Matches and the pieces between them are computed once and zipped; the fold keeps a
    running code-point position and grows its array in chunks, so it is linear in the matches."""
    t, rx = ident(text), sql_str(pattern)
    zipped = (f"zip_with(regexp_extract_all({t}, {rx}, 0), split({t}, {rx}, -1), "
              f"(m, p) -> named_struct('m', m, 'pl', length(p)))")
    init = f"named_struct('pos', 0, 'done', CAST(array() AS ARRAY<{SPAN_ARRAY_SQL}>), 'cur', CAST(array() AS {SPAN_ARRAY_SQL}))"
    full = f"size(acc.cur) >= {FOLD_CHUNK}"
    step = (f"(acc, x) -> CASE WHEN x.m IS NULL THEN acc ELSE named_struct("
            f"'pos', acc.pos + x.pl + length(x.m), "
            f"'done', CASE WHEN {full} THEN array_append(acc.done, acc.cur) ELSE acc.done END, "
            f"'cur', array_append(CASE WHEN {full} THEN CAST(array() AS {SPAN_ARRAY_SQL}) ELSE acc.cur END, named_struct("
            f"'start', acc.pos + x.pl, 'end', acc.pos + x.pl + length(x.m), 'type', {sql_str(span_type)}, "
            f"'value', x.m, 'confidence', CAST({confidence} AS DOUBLE)))) END")
    return f"aggregate({zipped}, {init}, {step}, acc -> flatten(array_append(acc.done, acc.cur)))"


def regex_spans(text: str, pattern: str, span_type: str, confidence: float) -> Column:
    return expr(regex_spans_sql(text, pattern, span_type, confidence))


PLACEHOLDER_RX = "(?i)(" + "|".join(L.PLACEHOLDER_VALUE_PATTERNS) + ")"


def validate_spans(text: str, spans: Column) -> Column:
    """D3: drop placeholder values; drop zip codes in arithmetic (an indicator within 20
    characters) or inside a longer number (an adjoining digit)."""
    n = L.ZIP_CONTEXT_CHARS

    def zip_ok(blocks: TextBlocks, s: Column) -> Column:
        lo, hi = F.greatest(s["start"] - n, F.lit(0)), F.least(s["end"] + n, blocks.length)
        # the character before, the zip code's surroundings and the character after
        near = let(blocks.between(lo, hi), lambda c: let(F.lower(c), lambda low: ~(
            _any([F.contains(low, F.lit(op)) for op in L.MATH_INDICATORS])
            | ((s["start"] > 0) & c.substr(s["start"] - lo, F.lit(1)).rlike(r"^\p{Nd}$"))
            | c.substr(s["end"] - lo + 1, F.lit(1)).rlike(r"^\p{Nd}$"))))
        return F.when(s["type"] == "zip_code", near).otherwise(F.lit(True))

    real = F.filter(spans, lambda s: ~s["value"].rlike(PLACEHOLDER_RX))
    return let(real, lambda r: F.when(F.exists(r, lambda s: s["type"] == "zip_code"),
                                      TextBlocks.of(F.col(text), lambda blocks: F.filter(r, lambda s: zip_ok(blocks, s))))
               .otherwise(r))


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def rule_prefilter_sql(text: str, span_type: str, pattern: str) -> str:
    """A cheap test every match of the rule needs: '@' for e-mail, a digit for the numeric rules (an ASCII one where
    ``pattern`` names 0-9 somewhere). Most texts fail it, and then the rule's two regex scans are skipped."""
    t = ident(text)
    digit = "[0-9]" if "[0-9]" in pattern or "[1-9]" in pattern else r"\p{Nd}"
    return f"instr({t}, '@') > 0" if span_type == "email" else f"{t} RLIKE {sql_str(digit)}"


def rule_pii_spans(text: str) -> Column:
    """D1 + D3: validated rule detections of column ``text`` in pattern order, then match order."""
    per_rule = [f"CASE WHEN {rule_prefilter_sql(text, t, p)} THEN {regex_spans_sql(text, ci(p), t, c)} "
                f"ELSE CAST(array() AS {SPAN_ARRAY_SQL}) END" for t, p, c in L.PII_RULES]
    return validate_spans(text, expr("concat(" + ", ".join(per_rule) + ")"))


def type_priority(t: Column) -> Column:
    out = F.lit(L.DEFAULT_TYPE_PRIORITY)
    for name, pr in L.TYPE_PRIORITY.items():
        out = F.when(t == name, F.lit(pr)).otherwise(out)
    return out


def _significant_overlap(a: Column, b: Column) -> Column:
    ov = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    return (ov > 0) & ((ov * 10 > (b["end"] - b["start"]) * 3) | (ov * 10 > (a["end"] - a["start"]) * 3))


def dedupe_model_spans(model_spans: Column) -> Column:
    """Model detections keyed by (start, end, type); a later one replaces an earlier only
    with strictly higher confidence (it keeps the earlier position)."""
    def same_key(x, e):
        return (x["start"] == e["start"]) & (x["end"] == e["end"]) & (x["type"] == e["type"])

    def step(acc, e):
        return F.when(F.exists(acc, lambda x: same_key(x, e)),
                      F.transform(acc, lambda x: F.when(same_key(x, e) & (e["confidence"] > x["confidence"]), e)
                                  .otherwise(x))).otherwise(F.array_append(acc, e))
    return F.aggregate(model_spans, _empty_spans(), step)


def _clusters(spans: Column) -> Column:
    """Spans (with their place ``ord`` in the order of detection) cut where no span reaches over:
    an array of clusters, each in order of detection."""
    def cut(s: Column) -> Column:
        reach = scan(s, F.lit(0), "int", "int", lambda far, x: let(F.greatest(far, x["span"]["end"]), lambda e: F.struct(e.alias("state"), e.alias("item"))))
        def starts(r: Column) -> Column:
            apart = lambda i: (i == 0) | ((F.get(r, i - 1) <= F.get(s, i)["span"]["start"]) & (F.get(s, i - 1)["span"]["start"] != F.get(s, i)["span"]["start"]))
            return F.filter(F.sequence(F.lit(0), F.size(s) - 1), apart)
        return let(reach, lambda r: let(starts(r), lambda c: runs(s, c)))
    by_place = lambda c: F.array_sort(c, lambda x, y: x["ord"] - y["ord"])
    by_start = F.sort_array(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), i.alias("ord"), x.alias("span"))))
    return let(by_start, lambda s: F.when(F.size(s) == 0, F.array().cast(f"array<array<struct<start:int,ord:int,span:{SPAN}>>>"))
               .otherwise(F.transform(cut(s), by_place)))


def resolve_spans(rule_spans: Column, model_spans: Column | None = None) -> Column:
    """Model spans first; each rule span meets the first kept span it overlaps by more
    than 30 % of either length: the higher type priority wins, on equal priority the higher
    confidence; otherwise the rule span is dropped. Non-overlapping rule spans are kept.
    Result sorted by start (kept spans never share a start).

    Only spans of one cluster of overlapping spans can meet, so the pairwise fold runs per
    cluster: the work grows with the spans of a text, and with the square of a cluster only."""
    def step(acc, e):
        first = F.try_element_at(F.filter(acc, lambda x: _significant_overlap(x, e)), F.lit(1))
        def meet(f: Column) -> Column:
            pe, px = type_priority(e["type"]), type_priority(f["type"])
            wins = (pe > px) | ((pe == px) & (e["confidence"] > f["confidence"]))
            return (F.when(f.isNull(), F.array_append(acc, e)).when(wins, F.array_append(F.array_remove(acc, f), e)).otherwise(acc))
        return let(first, meet)

    def one(c: Column, n_model: Column | None) -> Column:
        span = lambda x: x["span"]
        if n_model is None:
            rules, init = F.transform(c, span), _empty_spans()
        else:
            rules = F.transform(F.filter(c, lambda x: x["ord"] >= n_model), span)
            init = dedupe_model_spans(F.transform(F.filter(c, lambda x: x["ord"] < n_model), span))
        return F.when(F.size(c) == 1, F.transform(c, span)).otherwise(F.aggregate(rules, init, step))

    if model_spans is None:
        found, n_model = rule_spans, None
    else:
        model = F.coalesce(model_spans.cast(SPAN_ARRAY), _empty_spans())
        found, n_model = F.concat(model, rule_spans), F.size(model)
    return let(found, lambda a: F.when(F.size(a) < 2, a).otherwise(F.sort_array(F.flatten(F.transform(_clusters(a), lambda c: one(c, n_model))))))


def drop_names(spans: Column) -> Column:
    """D4 (``mask_names=False``): names are never masked."""
    return F.filter(spans, lambda s: s["type"] != "name")


# ---------------------------------------------------------------- masking

def default_strategy(t: Column, overrides: dict | None = None) -> Column:
    strategies = dict(L.DEFAULT_MASK_STRATEGY)
    strategies.update(overrides or {})
    out = F.lit("token")
    for name, s in strategies.items():
        out = F.when(t == name, F.lit(s)).otherwise(out)
    return out


def _hash8(v: Column) -> Column:
    return F.substring(F.sha2(v, 256), 1, L.HASH_HEX_CHARS)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "\\D", "")


def mask_value(t: Column, v: Column, strategy: Column, idx: Column) -> Column:
    """The mask text of one detected value (Appendix B)."""
    upper = F.upper(t)
    token_label = F.coalesce(*[F.when(t == k, F.lit(lbl)) for k, lbl in L.TOKEN_LABEL.items()], upper)
    hash_label = F.coalesce(*[F.when(t == k, F.lit(lbl)) for k, lbl in L.HASH_LABEL.items()],
                            F.concat(upper, F.lit("_HASH")))
    token = F.concat(F.lit("["), token_label, F.lit("_"), idx.cast("string"), F.lit("]"))
    hashed = F.concat(F.lit("["), hash_label, F.lit("_"), _hash8(v), F.lit("]"))
    d = _digits(v)
    last4 = F.substring(d, -4, 4)
    local = F.substring_index(v, "@", 1)
    domain = F.element_at(F.split(v, "@", 2), 2)
    masked_local = F.when(F.length(local) > 1,
                          F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.least(F.lit(3), F.length(local) - 1))))\
                    .otherwise(F.lit("*"))
    ip_parts = F.split(v, "\\.", -1)
    partial = (F.when(t == "email", F.when(F.instr(v, "@") > 0, F.concat(masked_local, F.lit("@"), domain))
                      .otherwise(F.lit("[EMAIL]")))
               .when(t == "phone", F.when(F.length(d) >= 4, F.concat(F.repeat(F.lit("*"), F.length(d) - 4), last4))
                     .otherwise(F.lit("[PHONE]")))
               .when(t == "ssn", F.when(F.length(d) == 9, F.concat(F.lit("XXX-XX-"), last4)).otherwise(F.lit("[SSN]")))
               .when(t == "credit_card", F.when(F.length(d) >= 4, F.concat(F.lit("****-****-****-"), last4))
                     .otherwise(F.lit("[CREDIT_CARD]")))
               .when(t == "ip_address", F.when(F.size(ip_parts) == 4,
                                               F.concat(F.element_at(ip_parts, 1), F.lit("."), F.element_at(ip_parts, 2),
                                                        F.lit(".*.*"))).otherwise(F.lit("[IP]")))
               .otherwise(F.lit(L.REDACTED)))
    return (F.when(strategy == "token", token).when(strategy == "partial", partial)
            .when(strategy == "hash", hashed).otherwise(F.lit(L.REDACTED)))


def _numbered(spans: Column) -> Column:
    """For each span how many spans of its type stand from it to the end: one sort by (type, place)."""
    by_type = F.sort_array(F.transform(spans, lambda x, i: F.struct(x["type"].alias("type"), i.alias("i"))))
    def count(o: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: (j == 0) | (F.get(o, j)["type"] != F.get(o, j - 1)["type"]))
        left = let(starts, lambda r: F.flatten(F.transform(runs(o, r), lambda g: F.transform(
            g, lambda x, k: F.struct(x["i"].alias("i"), (F.size(g) - k).alias("idx"))))))
        return F.when(F.size(o) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sort_array(left), lambda x: x["idx"]))
    return let(by_type, count)


def with_masks(spans: Column, overrides: dict | None = None) -> Column:
    """Spans (sorted by start) with ``idx`` (per-type counter counted from the last span),
    ``strategy`` and ``mask``."""
    def add(s, idx):
        strategy = default_strategy(s["type"], overrides)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"),
                        s["value"].alias("value"), s["confidence"].alias("confidence"), idx.alias("idx"),
                        strategy.alias("strategy"), mask_value(s["type"], s["value"], strategy, idx).alias("mask"))
    return let(spans, lambda a: let(_numbered(a), lambda n: F.transform(a, lambda s, i: add(s, F.get(n, i)))))


def splice(text, masked_spans: Column) -> Column:
    """Replace spans from last to first, each on the text as already modified.

    Built from left to right: the text before each span and its mask. Where a span reaches over
    the start of the next one, replacing it removes as many characters of what stands there by
    then, the next mask first; ``eaten`` carries that number on."""
    text = col_(text)
    piece = "struct<a:int,b:int,mask:string>"

    def step(state: Column, s: Column) -> Column:
        # state.eaten: characters still to be removed after the last mask; state.end: where its span ended
        gap = s["start"] - state["end"]
        into = F.greatest(state["eaten"] - gap, F.lit(0))
        n = F.length(s["mask"])
        return F.struct(
            F.struct(F.greatest(into - n, F.lit(0)).alias("eaten"), s["end"].alias("end")).alias("state"),
            F.struct(F.least(state["end"] + state["eaten"], s["start"]).alias("a"), s["start"].alias("b"),
                     F.when(into == 0, s["mask"]).otherwise(s["mask"].substr(into + 1, F.greatest(n - into, F.lit(0)))).alias("mask")).alias("item"))

    def build(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("eaten"), F.lit(0).alias("end"))
        pieces = scan(spans, zero, "struct<eaten:int,end:int>", piece, step)
        last = F.element_at(spans, -1)
        def join(blocks: TextBlocks) -> Column:
            def whole(p: Column) -> Column:
                return F.array_join(F.transform(p, lambda x: F.concat(blocks.between(x["a"], x["b"]), x["mask"])), "")
            return let(pieces, lambda p: F.concat(whole(p), blocks.between(last["end"] + left_over(p, spans), blocks.length)))
        return F.when(F.size(spans) == 0, text).otherwise(TextBlocks.of(text, join))

    def left_over(p: Column, spans: Column) -> Column:
        # what the last span still has to remove: only where its own mask was shorter than the overlap
        return F.aggregate(spans, zero_state(), lambda acc, s: step(acc, s)["state"], lambda acc: acc["eaten"])

    def zero_state() -> Column:
        return F.struct(F.lit(0).alias("eaten"), F.lit(0).alias("end"))

    return let(masked_spans, build)


MAPPING_FIELDS = "placeholder string, original string, type string, strategy string, confidence double"


def mapping_entries(masked_spans: Column) -> Column:
    """Mapping placeholder -> {original, type, strategy, confidence}: written from the last
    span to the first, so for a repeated placeholder the leftmost span's value wins."""
    by_mask = lambda a: F.sort_array(F.transform(a, lambda x, i: F.struct(x["mask"].alias("mask"), i.alias("i"))))

    def entries(a: Column, o: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: (j == 0) | (F.get(o, j)["mask"] != F.get(o, j - 1)["mask"]))
        ends = let(starts, lambda r: F.transform(runs(o, r), lambda g: F.struct((-F.element_at(g, -1)["i"]).alias("last"), F.element_at(g, 1)["i"].alias("first"))))

        def entry(w: Column) -> Column:
            return F.struct(w["mask"].alias("placeholder"), w["value"].alias("original"), w["type"].alias("type"),
                            w["strategy"].alias("strategy"), w["confidence"].alias("confidence"))
        return F.transform(F.sort_array(ends), lambda e: entry(F.get(a, e["first"])))

    return let(masked_spans, lambda a: F.when(F.size(a) == 0, F.array().cast(f"array<struct<{MAPPING_FIELDS}>>"))
               .otherwise(let(by_mask(a), lambda o: entries(a, o))))


def secret_hits(text) -> Column:
    """D7 + D8: API keys (3 patterns, entropy > 3.5) then passwords (3 patterns, non-trivial)."""
    text = col_(text)
    keys = F.concat(*[F.regexp_extract_all(text, F.lit(ci(p)), F.lit(0)) for p in L.API_KEY_PATTERNS])
    keys = F.filter(keys, lambda k: shannon_entropy(k) > L.API_KEY_MIN_ENTROPY)
    # every password pattern starts with password, passwd or pwd (case-insensitive)
    pws = F.when(text.rlike("(?i)passw|pwd"),
                 F.concat(*[F.regexp_extract_all(text, F.lit(ci(p)), F.lit(1)) for p in L.PASSWORD_PATTERNS]))\
           .otherwise(F.array().cast("array<string>"))
    pws = F.filter(pws, lambda p: ~trivial_secret_password(p))
    return F.struct(keys.alias("api_keys"), pws.alias("passwords"))


def with_privacy(df: DataFrame, text: str, out: str = "privacy", overrides: dict | None = None,
                 mask_names: bool = False, model_spans: str | None = None, secrets: bool = True) -> DataFrame:
    """``preserve_privacy`` + secret masking for a text column. Adds struct ``out``:
    pii_detected, spans, masked_text, mappings (array of entries), api_keys, passwords,
    secrets_detected. NULL text is read as empty (no detections)."""
    t = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("_tg_pt", t)
    model = F.col(model_spans) if model_spans else None
    staged = staged.withColumn("_tg_spans", resolve_spans(rule_pii_spans("_tg_pt"), model))
    spans = F.col("_tg_spans") if mask_names else drop_names(F.col("_tg_spans"))
    staged = staged.withColumn("_tg_masked", with_masks(spans, overrides))
    pii_text = splice(F.col("_tg_pt"), F.col("_tg_masked"))
    entries = mapping_entries(F.col("_tg_masked"))
    if secrets:
        staged = staged.withColumn("_tg_sec", secret_hits(F.col("_tg_pt")))
        keys, pws = F.col("_tg_sec")["api_keys"], F.col("_tg_sec")["passwords"]
        masked = F.aggregate(keys, pii_text, lambda acc, k: F.replace(acc, k, F.lit(L.API_KEY_MASK)))
        masked = F.aggregate(pws, masked, lambda acc, p: F.replace(acc, p, F.lit(L.PASSWORD_MASK)))
        sec_entries = F.concat(
            F.when(F.size(keys) > 0, F.array(F.struct(F.lit(L.API_KEY_MASK).alias("placeholder"),
                                                      F.element_at(keys, -1).alias("original"),
                                                      F.lit("api_key").alias("type"), F.lit("full").alias("strategy"),
                                                      F.lit(L.API_KEY_CONFIDENCE).alias("confidence"))))
            .otherwise(F.array().cast(f"array<struct<{MAPPING_FIELDS}>>")),
            F.when(F.size(pws) > 0, F.array(F.struct(F.lit(L.PASSWORD_MASK).alias("placeholder"),
                                                     F.element_at(pws, -1).alias("original"),
                                                     F.lit("password").alias("type"), F.lit("full").alias("strategy"),
                                                     F.lit(L.PASSWORD_CONFIDENCE).alias("confidence"))))
            .otherwise(F.array().cast(f"array<struct<{MAPPING_FIELDS}>>")))
        entries = F.concat(entries, sec_entries)
        sec_found = (F.size(keys) > 0) | (F.size(pws) > 0)
    else:
        keys = pws = F.array().cast("array<string>")
        masked = pii_text
        sec_found = F.lit(False)
    result = F.struct(
        (F.size(F.col("_tg_masked")) > 0).alias("pii_detected"),
        F.col("_tg_masked").alias("spans"),
        F.when(F.col(text).isNull(), F.lit(None).cast("string")).otherwise(masked).alias("masked_text"),
        entries.alias("mappings"),
        keys.alias("api_keys"),
        pws.alias("passwords"),
        sec_found.alias("secrets_detected"),
    )
    return staged.withColumn(out, result).drop("_tg_pt", "_tg_spans", "_tg_masked", "_tg_sec")


def mappings_as_map(entries: Column) -> Column:
    """Entries as MAP<placeholder, struct<original,type,strategy,confidence>> (keys are unique)."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(
        e["placeholder"], F.struct(e["original"].alias("original"), e["type"].alias("type"),
                                   e["strategy"].alias("strategy"), e["confidence"].alias("confidence")))))


def mappings_text(entries: Column) -> Column:
    """Canonical text of a mapping: entries sorted by placeholder, ``k=>original|type|strategy``."""
    return F.array_join(F.sort_array(F.transform(entries, lambda e: F.concat_ws(
        "|", F.concat(e["placeholder"], F.lit("=>"), e["original"]), e["type"], e["strategy"]))), " ; ")
