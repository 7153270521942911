"""Scalar text functions as native Spark column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``; nothing
leaves the JVM. Multi-step normalisations are also offered as DataFrame transforms
(``with_*``) that stage their intermediate values as columns, so a value used by
several later expressions is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import lexicons as L

# Characters Python's str.isspace() accepts (str.split()/strip() semantics), as a regex class body.
PY_WS = (r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WS_RUN = "[" + PY_WS + "]+"


def uni(pattern: str) -> str:
    """``pattern`` with the classes that Python takes in Unicode written out (Java and RE2 read them as ASCII):
    ``\\d`` as decimal digits of any script, ``\\s`` and ``\\S`` by ``str.isspace()``."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        token = pattern[i:i + step]
        if token == r"\d":
            token = r"\p{Nd}"
        elif token == r"\s":
            token = PY_WS if inside else "[" + PY_WS + "]"
        elif token == r"\S" and not inside:
            token = "[^" + PY_WS + "]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
        i += step
    return "".join(out)


def ci(pattern: str) -> str:
    """Case-insensitive form of a pattern (Java and RE2 share the inline flag)."""
    return "(?i)" + uni(pattern)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), "^[" + PY_WS + "]+|[" + PY_WS + "]+$", "")


def word_count(c) -> Column:
    """``len(text.split())``: pieces between whitespace runs, minus the empty piece a
    leading or trailing run leaves (measured 3x faster than counting regex matches)."""
    c = col_(c)
    pieces = F.size(F.split(c, PY_WS_RUN, -1))
    lead = c.rlike("^[" + PY_WS + "]").cast("int")
    trail = c.rlike("[" + PY_WS + "]$").cast("int")
    return F.when(c.isNull() | (F.length(c) == 0), F.lit(0)).otherwise(pieces - lead - trail)


def contains_any(c, needles) -> Column:
    c = col_(c)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def matched_literals(c, needles) -> Column:
    """Array of the needles (in list order) that occur in ``c`` as substrings."""
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(col_(c), n))


def strip_zero_width(c) -> Column:
    """H2: remove U+200B..U+200D and U+FEFF."""
    return F.regexp_replace(col_(c), L.ZERO_WIDTH_CLASS, "")


def leet_fold(c) -> Column:
    """H3: fold common leetspeak characters to letters."""
    return F.translate(col_(c), L.LEET_FROM, L.LEET_TO)


def punct_normalize(c) -> Column:
    """``[^\\w\\s]`` -> space, whitespace runs -> one space, lower case (no strip)."""
    # every non-word character is either whitespace or becomes a space, and each run then
    # collapses to one space: a single pass over runs of non-word characters does both
    return F.lower(F.regexp_replace(col_(c), "[^\\p{L}\\p{N}_]+", " "))


def url_unquote(c) -> Column:
    """Percent-decoding with ``urllib.parse.unquote`` rules: '+' stays, stray '%' stays."""
    c = col_(c)
    esc = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B")
    return F.when(F.instr(c, "%") > 0, F.coalesce(F.try_url_decode(esc), c)).otherwise(c)


def nfkc(c) -> Column:
    """Unicode NFKC, JVM-side through the ICU normaliser bundled with Spark; ASCII rows skip it."""
    c = col_(c)
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7F]"), composed).otherwise(c)


def utf8_ignore(b) -> Column:
    """``bytes.decode('utf-8', errors='ignore')`` of a binary column."""
    return F.regexp_replace(F.make_valid_utf8(col_(b).cast("string")), "\uFFFD", "")


def maybe_decode_hex(c) -> Column:
    """H4: ``\\xNN`` escapes -> only those bytes decoded; else an all-hex even string of 6+ -> decoded.
    A cheap shape test (an escape present, or nothing but hex digits and spaces) guards the
    rest, so ordinary prose pays one scan."""
    c = col_(c)
    shape = (F.instr(F.lower(c), "\\x") > 0) | c.rlike("^[" + PY_WS + "0-9a-fA-F]+$")
    s = F.lower(F.replace(py_strip(c), F.lit(" "), F.lit("")))
    escaped = F.array_join(F.regexp_extract_all(s, F.lit("\\\\x([0-9a-f]{2})"), F.lit(1)), "")
    plain = (F.length(s) % 2 == 0) & (F.length(s) >= 6) & s.rlike("^[0-9a-f]+$")
    decoded = (F.when(s.rlike("\\\\x[0-9a-f]{2}"), utf8_ignore(F.unhex(escaped)))
               .when(plain, utf8_ignore(F.unhex(s)))
               .otherwise(c))
    return F.when(shape, decoded).otherwise(c)


def printable_count(c) -> Column:
    """Number of characters for which ``str.isprintable()`` holds."""
    c = col_(c)
    return F.length(c) - F.length(F.regexp_replace(c, "[^\\p{C}\\p{Z}]| ", ""))


def maybe_decode_base64(c) -> Column:
    """H5: strict base64 of 8+ characters, kept when more than 80 % of the text is printable.
    Only a text made of base64 characters between optional outer whitespace can decode,
    which one scan decides before anything else is computed."""
    c = col_(c)
    shape = c.rlike("^[" + PY_WS + "]*[A-Za-z0-9+/]*={0,2}[" + PY_WS + "]*$")
    s = py_strip(c)
    valid = (F.length(s) >= 8) & (F.length(s) % 4 == 0)
    # try_to_binary: NULL instead of an error on a malformed candidate
    dec = utf8_ignore(F.try_to_binary(s, F.lit("base64")))
    keep = valid & (F.length(dec) > 0) & (printable_count(dec) * 5 > F.length(dec) * 4)
    return F.when(shape, F.when(keep, dec).otherwise(c)).otherwise(c)


def with_normalized(df: DataFrame, src: str, out: str) -> DataFrame:
    """H1 ``normalize_text`` as a staged transform (URL-unquote, NFKC, zero-width strip,
    hex-or-base64 decode, leet fold, lower, non-alphanumeric runs -> space, trim)."""
    t = "_tg_n1"
    staged = df.withColumn(t, strip_zero_width(nfkc(url_unquote(F.col(src)))))
    hx = "_tg_nh"
    staged = staged.withColumn(hx, maybe_decode_hex(F.col(t)))
    decoded = F.when(F.col(hx) != F.col(t), F.col(hx)).otherwise(maybe_decode_base64(F.col(t)))
    folded = F.lower(leet_fold(decoded))
    final = F.trim(F.regexp_replace(folded, "[^\\p{L}\\p{N}]+", " "))
    src_c = F.col(src)
    return (staged.withColumn(out, F.when(src_c.isNull() | (src_c == ""), src_c).otherwise(final))
            .drop(t, hx))


def normalize_text(c) -> Column:
    """H1 as a single column expression (use ``with_normalized`` inside jobs)."""
    c = col_(c)
    t = strip_zero_width(nfkc(url_unquote(c)))
    hx = maybe_decode_hex(t)
    decoded = F.when(hx != t, hx).otherwise(maybe_decode_base64(t))
    final = F.trim(F.regexp_replace(F.lower(leet_fold(decoded)), "[^\\p{L}\\p{N}]+", " "))
    return F.when(c.isNull() | (c == ""), c).otherwise(final)


def chars(c) -> Column:
    """Array of the code points of a string."""
    return F.regexp_extract_all(col_(c), F.lit("(?s)."), F.lit(0))


def shannon_entropy(c) -> Column:
    """H6: bits per character, case-sensitive; 0.0 for empty or NULL."""
    c = col_(c)
    cs = chars(c)
    n = F.size(cs).cast("double")
    probs = F.transform(F.array_distinct(cs), lambda ch: F.size(F.filter(cs, lambda x: x == ch)) / n)
    h = -F.aggregate(probs, F.lit(0.0).cast("double"), lambda acc, p: acc + p * F.log2(p))
    return F.when(c.isNull() | (F.length(c) == 0), F.lit(0.0)).otherwise(h)


def placeholder_email(email, context) -> Column:
    """H7: e-mail that looks like a placeholder, test or disposable address."""
    email, context = col_(email), col_(context)
    at = F.instr(email, "@")
    local = F.lower(F.substring_index(email, "@", 1))
    domain = F.lower(F.element_at(F.split(email, "@", 2), 2))
    ctx = F.lower(context)
    disposable = F.lit(False)
    for d in L.DISPOSABLE_EMAIL_DOMAINS:
        disposable = disposable | domain.endswith(d)
    out = (local.isin(*L.PLACEHOLDER_TOKENS) | domain.isin(*L.PLACEHOLDER_EMAIL_DOMAINS)
           | domain.endswith(".example") | domain.startswith("example.")
           | contains_any(ctx, L.PLACEHOLDER_CONTEXT_WORDS) | disposable)
    return F.when(at > 0, out).otherwise(F.lit(False))


def trivial_prompt_password(pw, context) -> Column:
    """H8: password in a prompt that is short, common, low-entropy, or in a demo context."""
    pw, context = col_(pw), col_(context)
    return ((F.length(pw) < L.PROMPT_PASSWORD_MIN_LEN)
            | contains_any(F.lower(pw), L.TRIVIAL_PASSWORD_SUBSTRINGS)
            | (shannon_entropy(pw) < L.PROMPT_PASSWORD_MIN_ENTROPY)
            | contains_any(F.lower(context), L.PLACEHOLDER_CONTEXT_WORDS))


def trivial_secret_password(pw) -> Column:
    """H9: password on the masking side that is a known default or shorter than 6."""
    pw = col_(pw)
    return F.lower(pw).isin(*L.TRIVIAL_PASSWORDS) | (F.length(pw) < L.TRIVIAL_PASSWORD_MIN_LEN)


def truncate_with_ellipsis(c, n: int) -> Column:
    """``s[:n] + '...' if len(s) > n else s``."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(L.ELLIPSIS))).otherwise(c)


def score_tenths(tenths) -> Column:
    """Integer tenths -> double score rounded to 4 places (the float sums of 0.2/0.5/0.3)."""
    return F.round(col_(tenths).cast("double") / 10.0, 4)
