"""DuckDB SQL builders for the correctness oracle.

Each function returns a DuckDB SQL expression (text) that computes, on a plain
row, the same value as the matching Spark column function of the library. The
oracle queries in :mod:`textguard.plans.catalog` are assembled from these pieces
so both sides share one set of fixed values (:mod:`textguard.functions.lexicons`).
RE2 differences are noted where they matter: ``\\b`` is ASCII there, so
word-boundary matches that the JVM takes in Unicode are written with explicit
character classes.
"""

from __future__ import annotations

from textguard.functions import lexicons as L
from textguard.functions.text import ci, uni
from textguard.sources.planted import sparse_turns_sql

WS = (r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\pL\p{Nd}_"   # the JVM's \b word characters (letters, decimal digits, underscore)


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]::VARCHAR[]"




def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def word_count(x: str) -> str:
    s = py_strip(x)
    return f"(CASE WHEN length({s}) = 0 THEN 0 ELSE len(regexp_split_to_array({s}, '[{WS}]+')) END)"


def punct_normalize(x: str) -> str:
    s = f"regexp_replace({x}, '[^\\pL\\pN_{WS}]', ' ', 'g')"
    return f"lower(regexp_replace({s}, '[{WS}]+', ' ', 'g'))"


def substring_hits(views, needles) -> str:
    cond = " OR ".join(f"contains({v}, k)" for v in views)
    return f"list_filter({arr(needles)}, lambda k: {cond})"


def regex_hits(views, patterns, case_insensitive=True) -> str:
    parts = []
    for p in patterns:
        rx = ci(p) if case_insensitive else uni(p)
        cond = " OR ".join(f"regexp_matches({v}, {q(rx)})" for v in views)
        parts.append(f"CASE WHEN {cond} THEN [{q(p)}] ELSE []::VARCHAR[] END")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def tenths_score(t: str) -> str:
    return f"round(CAST({t} AS DOUBLE) / 10.0, 4)"


def sentiment(text: str, low: str) -> str:
    pos = f"len({substring_hits([low], L.POSITIVE_WORDS)})"
    neg = f"len({substring_hits([low], L.NEGATIVE_WORDS)})"
    wc = word_count(text)
    raw = f"((CAST(({pos}) - ({neg}) AS DOUBLE) / CAST(greatest({wc}, 1) AS DOUBLE)) * {float(L.SENTIMENT_SCALE)})"
    return f"(CASE WHEN {wc} = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, {raw})) END)"


def tox_severity(t: str) -> str:
    return (f"(CASE WHEN {t} >= 10 THEN 'critical' WHEN {t} >= 6 THEN 'high' WHEN {t} >= 3 THEN 'medium' "
            f"WHEN {t} >= 2 THEN 'low' ELSE NULL END)")


def sev_rank(s: str) -> str:
    return ("(CASE " + " ".join(f"WHEN {s} = {q(n)} THEN {i + 1}" for i, n in enumerate(L.SEVERITY_LEVELS))
            + " ELSE 0 END)")


def sev_name(r: str) -> str:
    return ("(CASE " + " ".join(f"WHEN {r} = {i + 1} THEN {q(n)}" for i, n in enumerate(L.SEVERITY_LEVELS))
            + " ELSE NULL END)")


def output_filter_ctes(src: str, text: str = "text", tox_p: str | None = None, bias_p: str | None = None,
                       strategies: dict | None = None, include_age: bool = False) -> str:
    """CTE chain ``of1`` .. ``of3`` over relation ``src`` adding the output-filter columns:
    tox_kws, tox_phs, tox_sent, tox_tenths, tox_det, tox_score, tox_sev, bias_types, bias_n,
    bias_det, bias_score, bias_sev, jb_hits, jb_n, jb_det, jb_score, jb_sev, of_flagged,
    of_sev, of_expl, of_strategy, of_filtered. ``tox_p`` and ``bias_p`` name columns with a model's
    probability and probabilities (M7); rows where they are NULL are judged by the rules.
    ``strategies`` replaces strategies per detector, ``include_age`` adds the age patterns (D21)."""
    strat = {**L.DEFAULT_SANITIZATION, **(strategies or {})}
    mt, mb, blank = (f"{tox_p} IS NOT NULL" if tox_p else "FALSE"), (f"{bias_p} IS NOT NULL" if bias_p else "FALSE"), f"length({py_strip('_t')}) = 0"
    p = f"(CASE WHEN {blank} THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, {tox_p or 0.0})) END)"
    labels = L.BIAS_MODEL_LABELS
    bp = f"(CASE WHEN {blank} THEN [{', '.join('0.0' for _ in labels)}]::DOUBLE[] ELSE {bias_p or '[0.0]::DOUBLE[]'} END)"
    m_types = "list_concat(" + ", ".join(f"CASE WHEN {bp}[{i + 1}] > {L.BIAS_MODEL_DETECT} THEN [{q(x)}] ELSE []::VARCHAR[] END" for i, x in enumerate(labels)) + ")"
    (hi, hname), (md, mname) = L.TOXICITY_MODEL_SEVERITY
    m_sev = f"CASE WHEN {p} >= {L.TOXICITY_MODEL_DETECT} THEN CASE WHEN {p} >= {hi} THEN {q(hname)} WHEN {p} >= {md} THEN {q(mname)} ELSE 'low' END END"
    m_bsev = "CASE " + " ".join(f"WHEN list_max({bp}) >= {t} THEN {q(n)}" for t, n in L.BIAS_MODEL_SEVERITY) + " END"
    views = ["_low", "_pnorm"]
    bias_firsts = []
    for btype, pats in [*L.BIAS_PATTERNS, *([("age", L.AGE_BIAS_PATTERNS)] if include_age else [])]:
        whens = " ".join(f"WHEN regexp_matches(_low, {q(ci(p))}) THEN {q(p)}" for p in pats)
        bias_firsts.append((btype, f"(CASE {whens} ELSE NULL END)"))
    bias_types = "list_concat(" + ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN [{q(t)}] ELSE []::VARCHAR[] END" for t, f in bias_firsts) + ")"
    return f"""
of0 AS (SELECT *, coalesce({text}, '') AS _t FROM {src}),
of1 AS (SELECT *, lower(_t) AS _low, {punct_normalize('_t')} AS _pnorm FROM of0),
of2 AS (SELECT *,
    CASE WHEN {mt} THEN []::VARCHAR[] ELSE {substring_hits(views, L.TOXICITY_KEYWORDS)} END AS tox_kws,
    CASE WHEN {mt} THEN []::VARCHAR[] ELSE {substring_hits(views, L.AGGRESSIVE_PHRASES)} END AS tox_phs,
    {sentiment('_t', '_low')} AS tox_sent,
    CASE WHEN {mb} THEN {m_types} ELSE {bias_types} END AS bias_types,
    {regex_hits(views, L.OUTPUT_JAILBREAK_PATTERNS)} AS jb_hits
  FROM of1),
of3 AS (SELECT *,
    CASE WHEN {mt} THEN CAST(floor({p} * 10) AS INTEGER) ELSE len(tox_kws) * {L.KEYWORD_TENTHS} + len(tox_phs) * {L.PHRASE_TENTHS}
      + (CASE WHEN tox_sent < {L.SENTIMENT_PENALTY_BELOW} THEN {L.SENTIMENT_TENTHS} ELSE 0 END) END AS tox_tenths,
    len(bias_types) AS bias_n,
    len(jb_hits) AS jb_n
  FROM of2),
of4 AS (SELECT *,
    CASE WHEN {mt} THEN {p} >= {L.TOXICITY_MODEL_DETECT} ELSE tox_tenths >= 2 END AS tox_det,
    CASE WHEN {mt} THEN {p} ELSE {tenths_score('least(tox_tenths, 10)')} END AS tox_score,
    CASE WHEN {mt} THEN {m_sev} ELSE {tox_severity('tox_tenths')} END AS tox_sev,
    bias_n > 0 AS bias_det, CASE WHEN {mb} THEN list_max({bp}) ELSE {tenths_score(f'least(bias_n * {L.BIAS_TENTHS_PER_TYPE}, 10)')} END AS bias_score,
    CASE WHEN {mb} THEN {m_bsev} ELSE (CASE WHEN bias_n >= 2 THEN 'high' WHEN bias_n = 1 THEN 'medium' ELSE NULL END) END AS bias_sev,
    jb_n > 0 AS jb_det, {tenths_score(f'least(jb_n * {L.OUTPUT_JAILBREAK_TENTHS}, 10)')} AS jb_score,
    (CASE WHEN jb_n > 0 THEN 'critical' ELSE NULL END) AS jb_sev
  FROM of3),
of5 AS (SELECT *,
    (tox_det OR bias_det OR jb_det) AS of_flagged,
    {sev_name(f"greatest({sev_rank('tox_sev')}, {sev_rank('bias_sev')}, {sev_rank('jb_sev')})")} AS of_sev,
    {kwfold_select('_t')},
    (CASE WHEN jb_det THEN {q(strat['jailbreak'])} WHEN tox_det THEN {q(strat['toxicity'])}
          WHEN bias_det THEN {q(strat['bias'])} ELSE NULL END) AS of_strategy
  FROM of4),
of6 AS (SELECT *,
    CASE WHEN of_flagged THEN concat_ws({q(L.EXPL_SEP)},
        CASE WHEN tox_det THEN 'Toxicity detected (score: ' || printf('%.2f', tox_score) || ')' END,
        CASE WHEN bias_det THEN {q(L.EXPL_BIAS)} || array_to_string(bias_types, {q(L.LIST_SEP)}) END,
        CASE WHEN jb_det THEN {q(L.EXPL_OUTPUT_JAILBREAK)} END) END AS of_expl,
    CASE WHEN of_flagged THEN {sanitize_expr('_t')} END AS of_filtered
  FROM of5)"""


def censor_keyword(acc: str, kw: str) -> str:
    """``\\bkw\\b`` case-insensitive replacement with Unicode word boundaries (two passes,
    because a shared separator can only be consumed by one of two adjacent matches)."""
    pat = q(f"(?i)(^|[^{WORD}])" + kw + f"([^{WORD}]|$)")
    once = f"regexp_replace({acc}, {pat}, '\\1{L.REDACTED}\\2', 'g')"
    return f"regexp_replace({once}, {pat}, '\\1{L.REDACTED}\\2', 'g')"


def censor_fold(text: str) -> str:
    # A keyword that was not detected cannot match its own word-boundary pattern, so the
    # fold runs over the whole list in order (linear nesting).
    acc = text
    for kw in L.TOXICITY_KEYWORDS:
        acc = censor_keyword(acc, kw)
    return acc


def censor_expr(text: str) -> str:
    kw_acc = "_kwfold"
    phr = kw_acc
    for ph in L.AGGRESSIVE_PHRASES:
        phr = f"regexp_replace({phr}, {q('(?i)' + ph)}, {q(L.REDACTED)}, 'g')"
    prefix = ("array_to_string(list_transform(list_reverse(bias_types), "
              f"lambda t: {q(L.MSG_BIAS_PREFIX.split('{}')[0])} || t || {q(L.MSG_BIAS_PREFIX.split('{}')[1])}), '')")
    tox_part = (f"CASE WHEN NOT tox_det THEN {text} "
                f"WHEN tox_tenths >= 6 AND len(tox_kws) + len(tox_phs) = 0 THEN {q(L.MSG_TOXIC_WHOLE)} "
                f"WHEN len(tox_kws) + len(tox_phs) > 0 THEN {phr} "
                f"ELSE {q(L.MSG_TOXIC_PREFIX)} || {text} END")
    with_bias = f"(CASE WHEN bias_det THEN {prefix} || ({tox_part}) ELSE ({tox_part}) END)"
    return f"(CASE WHEN jb_det THEN {q(L.MSG_JAILBREAK_WHOLE)} ELSE {with_bias} END)"


def filter_expr(text: str) -> str:
    # keywords removed in list order, only those detected (case-sensitive plain replace)
    acc = f"list_reduce(list_prepend({text}, tox_kws), lambda a, k: replace(a, k, ''))"
    return py_strip(f"(CASE WHEN tox_det THEN {acc} ELSE {text} END)")


def sanitize_expr(text: str) -> str:
    return (f"(CASE WHEN of_strategy = 'block' THEN NULL "
            f"WHEN of_strategy = 'censor' THEN {censor_expr(text)} "
            f"WHEN of_strategy = 'warn' THEN {q(L.MSG_WARN_PREFIX)} || {text} "
            f"WHEN of_strategy = 'filter' THEN {filter_expr(text)} "
            f"ELSE {text} END)")


def kwfold_select(text: str) -> str:
    """Column ``_kwfold``: the keyword pass of the censor strategy (used by ``censor_expr``)."""
    return f"(CASE WHEN tox_det THEN {censor_fold(text)} ELSE {text} END) AS _kwfold"


# ---------------------------------------------------------------- PII spans, masking, secrets

SPAN_T = "STRUCT(s INTEGER, e INTEGER, t VARCHAR, v VARCHAR, c DOUBLE)"


def regex_spans(text: str, pattern: str, span_type: str, conf: float) -> str:
    """Match spans of one pattern: start = summed lengths of the pieces and matches before it."""
    m = f"regexp_extract_all({text}, {q(pattern)})"
    pc = f"regexp_split_to_array({text}, {q(pattern)})"
    start = (f"(coalesce(list_sum(list_transform({pc}[1:i], lambda x: length(x))), 0)"
             f" + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0))")
    return (f"list_transform(generate_series(1, len({m})), lambda i: struct_pack("
            f"s := CAST({start} AS INTEGER), e := CAST({start} + length({m}[i]) AS INTEGER), "
            f"t := {q(span_type)}, v := {m}[i], c := CAST({conf} AS DOUBLE)))")


def zip_ok(text: str, s: str) -> str:
    lo = f"greatest({s}.s - {L.ZIP_CONTEXT_CHARS}, 0)"
    hi = f"least({s}.e + {L.ZIP_CONTEXT_CHARS}, length({text}))"
    ctx = f"lower(substr({text}, {lo} + 1, {hi} - {lo}))"
    math_near = " OR ".join(f"contains({ctx}, {q(op)})" for op in L.MATH_INDICATORS)
    prev_d = f"({s}.s > 0 AND regexp_matches(substr({text}, {s}.s, 1), '^\\p{{Nd}}$'))"
    next_d = f"({s}.e < length({text}) AND regexp_matches(substr({text}, {s}.e + 1, 1), '^\\p{{Nd}}$'))"
    return f"NOT ({math_near} OR {prev_d} OR {next_d})"


PLACEHOLDER_RX = "(?i)(" + "|".join(L.PLACEHOLDER_VALUE_PATTERNS) + ")"


def rule_pii_spans(text: str) -> str:
    parts = [regex_spans(text, ci(p), t, c) for t, p, c in L.PII_RULES]
    allspans = "list_concat(" + ", ".join(parts) + ")"
    return (f"list_filter({allspans}, lambda s: NOT regexp_matches(s.v, {q(PLACEHOLDER_RX)}) "
            f"AND (s.t <> 'zip_code' OR ({zip_ok(text, 's')})))")


def type_priority(t: str) -> str:
    whens = " ".join(f"WHEN {t} = {q(k)} THEN {v}" for k, v in L.TYPE_PRIORITY.items())
    return f"(CASE {whens} ELSE {L.DEFAULT_TYPE_PRIORITY} END)"


def sig_overlap(a: str, b: str) -> str:
    ov = f"(least({a}.e, {b}.e) - greatest({a}.s, {b}.s))"
    return f"({ov} > 0 AND ({ov} * 10 > ({b}.e - {b}.s) * 3 OR {ov} * 10 > ({a}.e - {a}.s) * 3))"


def resolve_spans(rule_spans: str, model: str | None = None) -> str:
    first = f"list_filter(acc, lambda x: {sig_overlap('x', 'e')})[1]"
    pe, pf = type_priority("e.t"), type_priority(f"({first}).t")
    wins = f"({pe} > {pf} OR ({pe} = {pf} AND e.c > ({first}).c))"
    body = (f"CASE WHEN len(list_filter(acc, lambda x: {sig_overlap('x', 'e')})) = 0 THEN list_append(acc, e) "
            f"WHEN {wins} THEN list_append(list_filter(acc, lambda x: x <> {first}), e) ELSE acc END")
    return f"list_sort(list_reduce({rule_spans}, lambda acc, e: {body}, {model or f'[]::{SPAN_T}[]'}))"


def dedupe_model_spans(spans: str) -> str:
    """One span a (start, end, type), at its first place, with its highest confidence."""
    same = "y.s = x.s AND y.e = x.e AND y.t = x.t"
    best = f"list_max(list_transform(list_filter({spans}, lambda y: {same}), lambda y: y.c))"
    firsts = f"list_filter({spans}, lambda x, i: len(list_filter({spans}[1:i - 1], lambda y: {same})) = 0)"
    return f"list_transform({firsts}, lambda x: struct_pack(s := x.s, e := x.e, t := x.t, v := x.v, c := {best}))"


def default_strategy(t: str) -> str:
    whens = " ".join(f"WHEN {t} = {q(k)} THEN {q(v)}" for k, v in L.DEFAULT_MASK_STRATEGY.items())
    return f"(CASE {whens} ELSE 'token' END)"


def mask_value(t: str, v: str, strategy: str, idx: str) -> str:
    tok = "(CASE " + " ".join(f"WHEN {t} = {q(k)} THEN {q(x)}" for k, x in L.TOKEN_LABEL.items()) + f" ELSE upper({t}) END)"
    hsh = "(CASE " + " ".join(f"WHEN {t} = {q(k)} THEN {q(x)}" for k, x in L.HASH_LABEL.items()) + f" ELSE upper({t}) || '_HASH' END)"
    d = f"regexp_replace({v}, '\\D', '', 'g')"
    last4 = f"right({d}, 4)"
    local = f"split_part({v}, '@', 1)"
    domain = f"substr({v}, strpos({v}, '@') + 1)"
    masked_local = f"(CASE WHEN length({local}) > 1 THEN left({local}, 1) || repeat('*', least(3, length({local}) - 1)) ELSE '*' END)"
    ip = f"string_split({v}, '.')"
    partial = (f"(CASE WHEN {t} = 'email' THEN (CASE WHEN strpos({v}, '@') > 0 THEN {masked_local} || '@' || {domain} ELSE '[EMAIL]' END) "
               f"WHEN {t} = 'phone' THEN (CASE WHEN length({d}) >= 4 THEN repeat('*', length({d}) - 4) || {last4} ELSE '[PHONE]' END) "
               f"WHEN {t} = 'ssn' THEN (CASE WHEN length({d}) = 9 THEN 'XXX-XX-' || {last4} ELSE '[SSN]' END) "
               f"WHEN {t} = 'credit_card' THEN (CASE WHEN length({d}) >= 4 THEN '****-****-****-' || {last4} ELSE '[CREDIT_CARD]' END) "
               f"WHEN {t} = 'ip_address' THEN (CASE WHEN len({ip}) = 4 THEN {ip}[1] || '.' || {ip}[2] || '.*.*' ELSE '[IP]' END) "
               f"ELSE {q(L.REDACTED)} END)")
    return (f"(CASE WHEN {strategy} = 'token' THEN '[' || {tok} || '_' || CAST({idx} AS VARCHAR) || ']' "
            f"WHEN {strategy} = 'partial' THEN {partial} "
            f"WHEN {strategy} = 'hash' THEN '[' || {hsh} || '_' || sha256({v})[1:{L.HASH_HEX_CHARS}] || ']' "
            f"ELSE {q(L.REDACTED)} END)")


MSPAN_T = "STRUCT(s INTEGER, e INTEGER, t VARCHAR, v VARCHAR, c DOUBLE, idx BIGINT, strategy VARCHAR, mask VARCHAR)"


def with_masks(spans: str) -> str:
    idx = f"len(list_filter({spans}[i:], lambda x: x.t = {spans}[i].t))"
    strat = default_strategy(f"{spans}[i].t")
    return (f"list_transform(generate_series(1, len({spans})), lambda i: struct_pack("
            f"s := {spans}[i].s, e := {spans}[i].e, t := {spans}[i].t, v := {spans}[i].v, c := {spans}[i].c, "
            f"idx := {idx}, strategy := {strat}, mask := {mask_value(f'{spans}[i].t', f'{spans}[i].v', strat, idx)}))")


def splice(text: str, ms: str) -> str:
    return f"list_reduce(list_reverse({ms}), lambda acc, x: substr(acc, 1, x.s) || x.mask || substr(acc, x.e + 1), {text})"


def ordered_distinct(values: str) -> str:
    """The values of a list, each at its first place."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def mapping_texts(ms: str) -> str:
    """Entries ``k=>original|type|strategy`` where the leftmost span wins per placeholder."""
    first = f"list_filter({ms}, lambda y: y.mask = k)[1]"
    return (f"list_transform(list_distinct(list_transform({ms}, lambda x: x.mask)), lambda k: "
            f"k || '=>' || {first}.v || '|' || {first}.t || '|' || {first}.strategy)")


def entropy(s: str) -> str:
    chs = f"regexp_extract_all({s}, '(?s).')"
    n = f"CAST(len({chs}) AS DOUBLE)"
    p = f"(len(list_filter({chs}, lambda x: x = ch)) / {n})"
    return (f"(CASE WHEN {s} IS NULL OR length({s}) = 0 THEN 0.0 ELSE "
            f"-list_sum(list_transform(list_distinct({chs}), lambda ch: {p} * log2({p}))) END)")


def api_keys(text: str) -> str:
    parts = ", ".join(f"regexp_extract_all({text}, {q(ci(p))})" for p in L.API_KEY_PATTERNS)
    return f"list_filter(list_concat({parts}), lambda k: {entropy('k')} > {L.API_KEY_MIN_ENTROPY})"


def passwords(text: str) -> str:
    parts = ", ".join(f"regexp_extract_all({text}, {q(ci(p))}, 1)" for p in L.PASSWORD_PATTERNS)
    triv = ", ".join(q(x) for x in L.TRIVIAL_PASSWORDS)
    return (f"list_filter(list_concat({parts}), lambda p: NOT (lower(p) IN ({triv}) "
            f"OR length(p) < {L.TRIVIAL_PASSWORD_MIN_LEN}))")


def privacy_ctes(src: str, text: str = "text") -> str:
    """CTEs pv1..pv3 over ``src``: rule spans, resolved spans with masks, masked text,
    mapping texts, secrets (api_keys, passwords) and the final masked text."""
    return f"""
pv0 AS (SELECT *, coalesce({text}, '') AS _pt FROM {src}),
pv1 AS (SELECT *, {rule_pii_spans('_pt')} AS rule_spans FROM pv0),
pv2 AS (SELECT *, {resolve_spans('rule_spans')} AS spans FROM pv1),
pv3 AS (SELECT *, {with_masks('spans')} AS mspans, {api_keys('_pt')} AS api_keys, {passwords('_pt')} AS passwords
        FROM pv2),
pv4 AS (SELECT *, {splice('_pt', 'mspans')} AS pii_masked, {mapping_texts('mspans')} AS map_texts,
    list_transform({ordered_distinct('list_reverse(list_transform(mspans, lambda x: x.mask))')},
                   lambda k: list_filter(mspans, lambda y: y.mask = k)[1].t) AS map_types FROM pv3),
pv5 AS (SELECT *,
    list_reduce(list_prepend(list_reduce(list_prepend(pii_masked, api_keys), lambda a, k: replace(a, k, {q(L.API_KEY_MASK)})),
                             passwords), lambda a, p: replace(a, p, {q(L.PASSWORD_MASK)})) AS full_masked,
    list_concat(map_texts,
      CASE WHEN len(api_keys) > 0 THEN [{q(L.API_KEY_MASK)} || '=>' || api_keys[-1] || '|api_key|full'] ELSE []::VARCHAR[] END,
      CASE WHEN len(passwords) > 0 THEN [{q(L.PASSWORD_MASK)} || '=>' || passwords[-1] || '|password|full'] ELSE []::VARCHAR[] END
    ) AS all_map_texts,
    list_concat(map_types, CASE WHEN len(api_keys) > 0 THEN ['api_key'] ELSE []::VARCHAR[] END,
      CASE WHEN len(passwords) > 0 THEN ['password'] ELSE []::VARCHAR[] END) AS all_map_types
  FROM pv4)"""


# ---------------------------------------------------------------- normalisation and screens

def decode_chain(z: str) -> str:
    s = f"lower(replace({py_strip(z)}, ' ', ''))"
    esc = f"array_to_string(regexp_extract_all({s}, '\\\\x([0-9a-f]{{2}})', 1), '')"
    hx = (f"(CASE WHEN regexp_matches({s}, '\\\\x[0-9a-f]{{2}}') THEN try(decode(unhex({esc}))) "
          f"WHEN length({s}) % 2 = 0 AND length({s}) >= 6 AND regexp_matches({s}, '^[0-9a-f]+$') "
          f"THEN try(decode(unhex({s}))) ELSE {z} END)")
    b = py_strip(z)
    dec = f"try(decode(from_base64({b})))"
    printable = f"(length({dec}) - length(regexp_replace({dec}, '[^\\p{{C}}\\p{{Z}}]| ', '', 'g')))"
    b64 = (f"(CASE WHEN length({b}) >= 8 AND length({b}) % 4 = 0 AND regexp_matches({b}, '^[A-Za-z0-9+/]*={{0,2}}$') "
           f"AND length({dec}) > 0 AND {printable} * 5 > length({dec}) * 4 THEN {dec} ELSE {z} END)")
    return f"(CASE WHEN {hx} <> {z} THEN {hx} ELSE {b64} END)"


def normalize_ctes(src: str, text: str = "text", out: str = "_norm") -> str:
    """CTEs nz1..nz3 over ``src`` adding ``_t`` (text, NULL as ''), ``_low`` and ``out``."""
    u = f"(CASE WHEN strpos(_t, '%') > 0 THEN coalesce(try(url_decode(_t)), _t) ELSE _t END)"
    z = f"regexp_replace({u}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    folded = f"lower(translate(_dec, {q(L.LEET_FROM)}, {q(L.LEET_TO)}))"
    return f"""
nz1 AS (SELECT *, coalesce({text}, '') AS _t FROM {src}),
nz2 AS (SELECT *, lower(_t) AS _low, {z} AS _z FROM nz1),
nz3 AS (SELECT *, {decode_chain('_z')} AS _dec FROM nz2),
nz4 AS (SELECT * EXCLUDE (_z, _dec), CASE WHEN _t = '' THEN _t
          ELSE trim(regexp_replace({folded}, '[^\\pL\\pN]+', ' ', 'g')) END AS {out} FROM nz3)"""


def placeholder_email(email: str, ctx: str) -> str:
    local = f"lower(split_part({email}, '@', 1))"
    domain = f"lower(substr({email}, strpos({email}, '@') + 1))"
    toks = ", ".join(q(x) for x in L.PLACEHOLDER_TOKENS)
    doms = ", ".join(q(x) for x in L.PLACEHOLDER_EMAIL_DOMAINS)
    ctxw = " OR ".join(f"contains(lower({ctx}), {q(w)})" for w in L.PLACEHOLDER_CONTEXT_WORDS)
    disp = " OR ".join(f"ends_with({domain}, {q(d)})" for d in L.DISPOSABLE_EMAIL_DOMAINS)
    return (f"(strpos({email}, '@') > 0 AND ({local} IN ({toks}) OR {domain} IN ({doms}) "
            f"OR ends_with({domain}, '.example') OR starts_with({domain}, 'example.') OR {ctxw} OR {disp}))")


def trivial_prompt_password(pw: str, ctx: str) -> str:
    subs = " OR ".join(f"contains(lower({pw}), {q(s)})" for s in L.TRIVIAL_PASSWORD_SUBSTRINGS)
    ctxw = " OR ".join(f"contains(lower({ctx}), {q(w)})" for w in L.PLACEHOLDER_CONTEXT_WORDS)
    return (f"(length({pw}) < {L.PROMPT_PASSWORD_MIN_LEN} OR {subs} OR {entropy(pw)} < {L.PROMPT_PASSWORD_MIN_ENTROPY} "
            f"OR {ctxw})")


def prompt_pii_found(t: str, norm: str) -> str:
    pw_rx = q(ci(L.PROMPT_PASSWORD_PATTERN))
    pw_present = f"regexp_matches({t}, {pw_rx})"
    pw_ok = f"NOT {trivial_prompt_password(f'regexp_extract({t}, {pw_rx}, 1)', t)}"
    parts = []
    for ptype, pat in L.PROMPT_PII_RULES:
        mo = f"regexp_extract({t}, {q(uni(pat))})"
        mn = f"regexp_extract({norm}, {q(uni(pat))})"
        matched = f"(CASE WHEN {mo} <> '' THEN {mo} WHEN {mn} <> '' THEN {mn} END)"
        skip = placeholder_email(matched, t) if ptype == "email" else "FALSE"
        parts.append(f"CASE WHEN {matched} IS NULL OR coalesce({skip}, FALSE) THEN []::VARCHAR[] "
                     f"WHEN {pw_present} THEN (CASE WHEN {pw_ok} THEN ['password'] ELSE []::VARCHAR[] END) "
                     f"ELSE [{q(ptype)}] END")
    return "list_concat(" + ", ".join(parts) + ")"


def prompt_ctes(src: str, text: str = "text") -> str:
    """normalize_ctes + pa1/pa2: jailbreak hits, PII found, flags and explanation."""
    jb = regex_hits(["_low", "_norm"], L.JAILBREAK_PATTERNS, case_insensitive=False)
    pii_txt = f"{q(L.EXPL_PII)} || array_to_string(pii_found, {q(L.LIST_SEP)})"
    e1 = f"(CASE WHEN len(jb_hits) > 0 THEN {q(L.EXPL_JAILBREAK)} || array_to_string(jb_hits[1:3], {q(L.LIST_SEP)}) END)"
    return normalize_ctes(src, text) + f""",
pa1 AS (SELECT *, {jb} AS jb_hits, {prompt_pii_found('_t', '_norm')} AS pii_found FROM nz4),
pa2 AS (SELECT *, len(jb_hits) > 0 AS pa_flagged, len(pii_found) > 0 AS pa_pii,
    CASE WHEN len(jb_hits) > 0 THEN round(len(jb_hits) * {L.JAILBREAK_WEIGHT_TENTHS} / 10.0, 4) END AS pa_jb_score,
    CASE WHEN len(pii_found) > 0 THEN (CASE WHEN {e1} IS NULL THEN {pii_txt} ELSE {e1} || {q(L.EXPL_SEP)} || {pii_txt} END)
         ELSE {e1} END AS pa_expl
  FROM pa1)"""


def response_ctes(src: str, text: str = "text") -> str:
    """normalize_ctes + ra1/ra2: lexicon hits, harmful rule, flags and explanation."""
    lex = substring_hits(["_low", "_norm"], L.LEXICON_KEYWORDS)
    phr = " OR ".join(f"contains(_low, {q(p)})" for p in L.HARMFUL_PHRASES)
    wrd = " OR ".join(f"contains(_low, {q(w)})" for w in L.HARMFUL_WORDS)
    return normalize_ctes(src, text) + f""",
ra1 AS (SELECT *, {lex} AS lex_hits, (({phr}) AND ({wrd})) AS harmful FROM nz4),
ra2 AS (SELECT *, len(lex_hits) > 0 AS ra_tox, (len(lex_hits) > 0 OR harmful) AS ra_flagged,
    CASE WHEN len(lex_hits) > 0 THEN round(len(lex_hits) * 2 / 10.0, 4) END AS ra_score,
    CASE WHEN harmful THEN {q(L.EXPL_HARMFUL)}
         WHEN len(lex_hits) > 0 THEN {q(L.EXPL_LEXICON)} || array_to_string(lex_hits[1:3], {q(L.LIST_SEP)}) END AS ra_expl
  FROM ra1)"""


def prompt_intent(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    whens = []
    for intent, words in L.INTENT_WORDS:
        cond = " OR ".join(f"contains({low}, {q(w)})" for w in words)
        whens.append(f"WHEN {cond} THEN {q(intent)}")
    return "(CASE " + " ".join(whens) + " ELSE 'other' END)"


# ---------------------------------------------------------------- pipeline (P1-P5) and derived tables

import re as _re  # noqa: E402


def namespaced(ctes: str, prefix: str) -> str:
    """Give a CTE chain its own names so several chains can share one WITH clause."""
    return _re.sub(r"\b(of|pv|nz|pa|ra)(\d)\b", prefix + r"_\1\2", ctes)


def ts_of(conv: str, turn: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({conv} AS BIGINT)) + to_minutes(CAST({turn} AS BIGINT)))"


def tstr(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def pipeline_ctes(planted_sql: str) -> str:
    """CTEs ``turns``, ``pairs``, ``ex`` (one row per user turn), ``msgs`` (stored
    messages), ``evts`` (security events) and ``convs`` (conversation roll-up)."""
    turns = (f"turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL "
             f"SELECT doc_id, 0::BIGINT, 'user', text FROM {planted_sql} UNION ALL "
             f"SELECT doc_id, 1::BIGINT, 'assistant', text FROM {planted_sql} UNION ALL SELECT * FROM {sparse_turns_sql()})")
    pairs = ("follow AS (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text "
             "FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
             "pairs AS (SELECT *, CASE WHEN next_role = 'assistant' THEN next_text END AS reply FROM follow WHERE role = 'user')")
    chains = [
        namespaced(prompt_ctes("pairs").strip(), "p"),
        namespaced(response_ctes("pairs").strip(), "q"),
        namespaced(privacy_ctes("pairs").strip(), "v"),
        namespaced(output_filter_ctes("pairs", "reply").strip(), "o"),
        namespaced(response_ctes("pairs", "reply").strip(), "r"),
    ]
    ex = """ex AS (SELECT x.conv_id, x.turn, x.next_turn, x.text, x.reply,
    p.pa_flagged AS refused, p.pa_pii, p.pa_jb_score, p.pa_expl,
    q.ra_tox AS ptox, q.ra_score AS ptox_score, q.ra_expl AS ptox_expl,
    (len(v.mspans) > 0 OR len(v.api_keys) > 0 OR len(v.passwords) > 0) AS pii_found,
    CASE WHEN x.text IS NULL THEN NULL ELSE v.full_masked END AS masked, len(v.all_map_texts) AS n_mappings,
    v.all_map_types AS map_types,
    o.of_flagged, o.tox_det, o.bias_det, o.jb_det, o.tox_score, o.bias_score, o.jb_score, o.of_sev, o.of_expl,
    o.of_strategy, o.of_filtered,
    r.ra_flagged AS r_flagged, r.ra_tox AS r_tox, r.ra_score AS r_score, r.ra_expl AS r_expl
  FROM pairs x JOIN p_pa2 p USING (conv_id, turn) JOIN q_ra2 q USING (conv_id, turn)
  JOIN v_pv5 v USING (conv_id, turn) JOIN o_of6 o USING (conv_id, turn) JOIN r_ra2 r USING (conv_id, turn)),
ex2 AS (SELECT *, CASE WHEN pii_found THEN (CASE WHEN pa_expl IS NULL THEN 'PII detected and masked'
                        ELSE pa_expl || ' | PII detected and masked' END) ELSE pa_expl END AS prompt_expl,
        (of_flagged OR tox_det OR bias_det OR jb_det) AS any_det FROM ex)"""
    blocked = q(L.MSG_BLOCKED)
    final = (f"CASE WHEN of_flagged AND (of_filtered IS NULL OR of_filtered = '') THEN {blocked} "
             f"WHEN of_filtered IS NOT NULL AND of_filtered <> '' THEN of_filtered ELSE reply END")
    msgs = f"""msgs AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, conv_id AS conversation_id, turn,
    'USER' AS role, masked AS content, {ts_of('conv_id', 'turn')} AS created_at, ptox AS is_flagged,
    pa_jb_score AS jailbreak_score, CASE WHEN ptox THEN ptox_score END AS toxicity_score, pii_found AS pii_detected,
    coalesce(prompt_expl, CASE WHEN ptox THEN ptox_expl END) AS explanation, text AS original_content,
    masked AS masked_content, n_mappings, CAST(NULL AS VARCHAR) AS filtered_content, FALSE AS bias_detected,
    CAST(NULL AS DOUBLE) AS bias_score, FALSE AS jailbreak_detected_in_output,
    CAST(NULL AS DOUBLE) AS jailbreak_score_in_output, FALSE AS has_filter_analysis, CAST(NULL AS VARCHAR) AS fa_severity,
    CAST(NULL AS VARCHAR) AS sanitization_strategy, map_types
  FROM ex2 WHERE NOT refused
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(next_turn AS VARCHAR), conv_id, next_turn, 'ASSISTANT', {final},
    {ts_of('conv_id', 'next_turn')}, of_flagged OR r_flagged, CAST(NULL AS DOUBLE),
    CASE WHEN tox_det THEN tox_score WHEN r_tox THEN r_score END, FALSE, coalesce(of_expl, r_expl),
    CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, CASE WHEN any_det THEN reply END, bias_det, bias_score, jb_det,
    jb_score, any_det, CASE WHEN any_det THEN of_sev END, of_strategy, []::VARCHAR[]
  FROM ex2 WHERE NOT refused AND reply IS NOT NULL)"""
    out_type = "CASE WHEN jb_det THEN 'jailbreak_output' WHEN bias_det THEN 'bias' ELSE 'toxicity' END"
    out_sev = "CASE WHEN of_sev = 'critical' THEN 'critical' WHEN of_sev = 'high' THEN 'high' ELSE 'medium' END"
    ev_cols = "conv_id, turn, seq, type, severity, message, conversation_id, is_flagged, explanation, jailbreak_score, toxicity_score"
    evts = f"""ev0 AS (
  SELECT conv_id, turn, 1 AS seq, 'toxicity' AS type, 'medium' AS severity, text AS message, CAST(NULL AS BIGINT) AS conversation_id,
    TRUE AS is_flagged, ptox_expl AS explanation, CAST(NULL AS DOUBLE) AS jailbreak_score, ptox_score AS toxicity_score
  FROM ex2 WHERE ptox
  UNION ALL SELECT conv_id, turn, 2, 'jailbreak', 'high', text, NULL, TRUE, pa_expl, pa_jb_score, NULL FROM ex2 WHERE refused
  UNION ALL SELECT conv_id, turn, 3, 'pii', 'high', text, conv_id, FALSE, prompt_expl, NULL, NULL FROM ex2
    WHERE pii_found AND NOT refused
  UNION ALL SELECT conv_id, turn, 4, {out_type}, {out_sev}, reply, conv_id, TRUE, of_expl, NULL, tox_score FROM ex2
    WHERE NOT refused AND of_flagged
  UNION ALL SELECT conv_id, turn, 4, 'toxicity', 'medium', text, conv_id, TRUE, r_expl, NULL, r_score FROM ex2
    WHERE NOT refused AND NOT of_flagged AND r_flagged
  UNION ALL SELECT conv_id, turn, 4, 'normal', 'low', text, conv_id, FALSE, NULL, NULL, NULL FROM ex2
    WHERE NOT refused AND NOT of_flagged AND NOT r_flagged AND NOT pii_found),
evts AS (SELECT substr(sha256(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) || '|' || CAST(seq AS VARCHAR)), 1, 32) AS id,
    {ts_of('conv_id', 'turn')} AS timestamp, conv_id AS source_conv_id, turn, seq, type, severity,
    substr(message, 1, {L.TRUNC_EVENT_MESSAGE}) AS message, conversation_id, CAST(((conv_id % 100) + 100) % 100 AS BIGINT) AS user_id,
    is_flagged, explanation, jailbreak_score, toxicity_score FROM ev0)"""
    title = f"CASE WHEN length(first_text) > {L.TRUNC_TITLE} THEN substr(first_text, 1, {L.TRUNC_TITLE}) || '...' ELSE first_text END"
    convs = f"""cv0 AS (SELECT conv_id, turn, text, (of_flagged OR r_flagged) AS c_flagged, FALSE AS c_jb, pii_found AS c_pii,
    (tox_det OR r_flagged) AS c_tox, bias_det AS c_bias, jb_det AS c_jbo FROM ex2 WHERE NOT refused),
cv1 AS (SELECT conv_id, arg_max(struct_pack(f := c_flagged, j := c_jb, p := c_pii, t := c_tox, b := c_bias, o := c_jbo), turn) AS f,
    arg_min(text, turn) AS first_text, min(turn) AS first_turn, bool_or(c_flagged) AS any_flagged,
    bool_or(c_tox) AS any_toxicity, count(*) AS exchanges FROM cv0 GROUP BY conv_id),
convs AS (SELECT conv_id AS id, {title} AS title, CAST(((conv_id % 100) + 100) % 100 AS BIGINT) AS user_id,
    {ts_of('conv_id', 'first_turn')} AS created_at, f.f AS is_flagged, f.j AS jailbreak_detected, f.p AS pii_detected,
    f.t AS toxicity_detected, f.b AS bias_detected, f.o AS jailbreak_detected_in_output, any_flagged, any_toxicity,
    exchanges FROM cv1)"""
    del ev_cols
    return ",\n".join([turns, pairs] + chains + [ex, msgs, evts, convs])
