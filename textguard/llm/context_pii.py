"""Operator 1 - personal data by bootstrapped contextual extraction, in DataFrame and SQL operations only.

Four patterns (e-mail, ip, card, phone) give the base spans. They are the seeds: the whole text of
a base span is a known instance of its kind. Words with a digit or an '@' outside the base spans, and
runs of digit groups joined by one space ('415 555 0199') as one, are unknown instances. The word
before an instance, the word after it, and both together are its lexical patterns. On the graph of patterns and distinct instances two scores are iterated:

    pattern and kind:  sum of its instances' confidence / (number of its instances + 1)
    instance and kind: 1 for a seed, else 1 - product over its supported patterns of (1 - score)

Patterns with enough seeds and a high score are trusted. An unknown instance that looks like an identifier of the kind and
whose confidence in trusted patterns reaches MIN_SCORE is discovered: from the next round on it counts as a seed, so a
context in which only discovered instances stand can be trusted in turn. Unknown instances in a context trusted in
the last round that look like an identifier of the kind are added as spans of kind ``ctx_<kind>`` (without
punctuation at their ends). Base spans stay.

Beyond the parameters: a run of digit groups with fewer or more digits than RUN_DIGITS is taken word by word, and
a neighbouring word is only seen if it ends within REACH code points. All work inside a row is linear in its
spans: candidates are held against base spans by a merge of the two sorted lists, texts are cut in blocks.

Repeated matches restart only at the start of a run of word characters or at the end of the last
match (``\\G``), which finds the same leftmost matches without rescanning long runs.

Defined results: null text is empty; a repeated row is scanned again but counts once in the
graph (instances are distinct texts); null doc_ids are returned; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import staged
from textguard.llm.sqlspans import let, literal, matches, pieces, running, running_max

# The base kinds in their order, as (kind, pattern, test of a match m_, cheap test of a text).
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_DIGITS = "regexp_replace(m_, '[^0-9]', '')"
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "instr({t}, '@') > 0"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"rlike(m_, '^{_BYTE}([.]{_BYTE}){{3}}$')", "{t} rlike '[0-9][.][0-9]'"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})", "{t} rlike '[0-9][\\x20-]?[0-9]'"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", "{t} rlike '[+][0-9]'"),
]

SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"
FOUND = SPAN.replace("kind: string", "kind: string, word: string, before: string, after: string")
#: A word with a digit or an '@'; or words of digits and group marks only, each one space after the other.
_TAIL = r"[^\x20\x09-\x0DA-Za-z0-9@]*+"
_RUN = rf"{_TAIL}[0-9][0-9()-]*+(?:\x20[(]?[0-9][0-9()-]*+(?={_TAIL}(?![^\x20\x09-\x0D])))++{_TAIL}"
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{_RUN}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Digits of a run that is one instance; the words of other runs (tables, say) are instances of their own.
RUN_DIGITS = (7, 19)
#: Code points of the text around a candidate in which its neighbours are looked for.
REACH = 64
ROUNDS = 3
#: What an added word or run must look like, by kind: an identifier, not any word with a digit.
SHAPES = {"email": "word rlike '@'", "ip": "word rlike '[0-9]+[.:][0-9a-fA-F]*[.:][0-9a-fA-F]+'",
          "card": "length(regexp_replace(word, '[^0-9]', '')) >= 8", "phone": "length(regexp_replace(word, '[^0-9]', '')) >= 7"}
MIN_SEEDS, MIN_SCORE = 5, 0.8


def found_spans(text: str) -> str:
    """SQL for the sorted base spans of column ``text``, each with its text as an instance (without punctuation at
    its ends) and the words around the words it lies in; words with a digit or an '@' count as no word."""
    space, ink = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    word = "regexp_replace(m_, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '')"
    # a word that the next match cuts is none
    left = f"concat(if(k_ = 0, ' ', ''), substring(before_, -{REACH}))"
    right = f"concat(substring(after_, 1, {REACH}), if(k_ = size(found_.m) - 1, ' ', ''))"
    before = f"lower(regexp_extract({left}, {literal(f'{space}([^0-9@{space[1:-1]}]++){space}+{ink}*+$')}, 1))"
    after = f"lower(regexp_extract({right}, {literal(f'^{ink}*+{space}+([^0-9@{space[1:-1]}]++){space}')}, 1))"

    def one(rank: int, kind: str, regex: str, test: str, cheap: str) -> str:
        span = f"struct(s_ AS start, {rank} AS rank, e_ AS end, '{kind}' AS kind, {word} AS word, {before} AS before, {after} AS after)"
        return f"if({cheap.format(t=text)}, cast(filter({matches(text, regex, f'if({test}, {span}, null)')}, x_ -> x_ is not null) as {FOUND}), cast(array() as {FOUND}))"
    return "array_sort(concat(" + ", ".join(one(i, *k) for i, k in enumerate(KINDS)) + "))"


def base_spans(text: str) -> str:
    """SQL for the sorted base spans of column ``text``."""
    return bare(found_spans(text))


def bare(spans: str) -> str:
    """SQL for base spans without their words."""
    return f"transform({spans}, x_ -> struct(x_.start AS start, x_.rank AS rank, x_.end AS end, x_.kind AS kind))"


def candidates(text: str) -> str:
    """SQL for the unknown instances, base spans among them: place without punctuation at the ends, text, and the
    words around."""
    before = f"lower(regexp_extract(substring(before_, -{REACH}), {literal('([^\\x20\\x09-\\x0D]++)[\\x20\\x09-\\x0D]+$')}, 1))"
    after = f"lower(regexp_extract(substring(after_, 1, {REACH}), {literal('^[\\x20\\x09-\\x0D]+([^\\x20\\x09-\\x0D]++)')}, 1))"

    def core(word: str, end: str, first: str, last: str) -> str:
        return let("l_", f"length(regexp_extract({word}, '^[^A-Za-z0-9]*', 0))",
                   let("t_", f"length(regexp_extract({word}, '[^A-Za-z0-9]*+$', 0))",
                       f"struct({end} - length({word}) + l_ AS start, {end} - t_ AS end, substring({word}, l_ + 1, length({word}) - l_ - t_) AS word, "
                       f"if({first}, {before}, '') AS before, if({last}, {after}, '') AS after)"))
    each = let("p_", "split(m_, ' ', -1)", let("q_", running("transform(p_, x_ -> length(x_) + 1)"),
               f"transform(p_, (w_, n_) -> {core('w_', '(s_ + q_[n_] - 1)', 'n_ = 0', 'n_ = size(p_) - 1')})"))
    whole = f"instr(m_, ' ') = 0 or length(regexp_replace(m_, '[^0-9]', '')) between {RUN_DIGITS[0]} and {RUN_DIGITS[1]}"
    found = matches(text, CANDIDATE, f"if({whole}, array({core('m_', 'e_', 'true', 'true')}), {each})")
    return f"if({text} rlike '[0-9@]', filter(flatten({found}), x_ -> x_.word rlike '[0-9@]'), array())"


def digest(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def _edges(seen: DataFrame) -> DataFrame:
    """Distinct (pattern, word) pairs."""
    pats = F.expr("""filter(array(if(before != '', concat('L ', before), null), if(after != '', concat('R ', after), null),
                                  if(before != '' and after != '', concat('B ', before, ' ', after), null)), p -> p is not null)""")
    return seen.select("word", F.explode(pats).alias("pattern")).distinct()


SHAPE = " or ".join(f"(kind = '{k}' and {test})" for k, test in SHAPES.items())


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, kind, score) of the trusted patterns. seen: (word, before, after, kinds), the kind of a base
    span (empty: unknown)."""
    edges = staged(_edges(seen), "pii-edges")
    base = staged(seen.select("word", F.explode("kinds").alias("kind")).distinct(), "pii-seeds")
    size = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-sizes")
    sure = base.select("word", "kind", F.lit(1.0).alias("c"), F.lit(1).alias("seed"))
    conf = sure
    for i in range(rounds):
        # a pattern is supported by its base and discovered instances; one says nothing about others
        score = staged(edges.join(conf, "word").groupBy("pattern", "kind").agg(F.sum("c").alias("c"), F.sum("seed").alias("seeds")).where("seeds >= 2")
                       .join(size, "pattern").select("pattern", "kind", "seeds", (F.col("c") / (F.col("n") + 1)).alias("score")), "pii-score")
        trusted = score.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score)).select("pattern", "kind", "score")
        if i < rounds - 1:
            sum_log = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))))
            firm = F.sum(F.when((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score), F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
            guess = (edges.join(score, "pattern").groupBy("word", "kind").agg((1 - F.exp(sum_log)).alias("c"), (1 - F.exp(firm)).alias("sure"))
                     .join(base, ["word", "kind"], "left_anti"))
            found = F.coalesce((F.col("sure") >= min_score) & F.expr(SHAPE), F.lit(False))
            conf = staged(sure.unionByName(guess.select("word", "kind", "c", found.cast("int").alias("seed"))), "pii-conf")
    return trusted


def _free(found: str, seen: str) -> str:
    """SQL for the elements of ``seen`` that overlap none of the spans ``found``: both are merged by place, a running maximum of the
    ends of the spans that start before a candidate's end tells whether one reaches into it."""
    marks = (f"array_sort(concat(transform({seen}, (w_, i_) -> struct(w_.end AS at, 0 AS is_base, w_.start AS other, i_ AS i)), "
             f"transform({found}, b_ -> struct(b_.start AS at, 1 AS is_base, b_.end AS other, -1 AS i))))")
    tops = running_max("transform(marks_, x_ -> if(x_.is_base = 1, x_.other, 0))")
    free = "filter(zip_with(marks_, tops_, (x_, t_) -> if(x_.is_base = 0 and t_ <= x_.other, x_.i, null)), v_ -> v_ is not null)"
    return f"transform({let('marks_', marks, let('tops_', tops, free))}, v_ -> {seen}[v_])"


def find_pii(docs: DataFrame, carry: list[str] | None = None, **limits) -> DataFrame:
    """doc_id, base (sorted base spans), spans (base and added, sorted) for every row of ``docs`` (doc_id,
    text), with the columns ``carry`` of the input in the struct ``row``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in carry or ["doc_id"])).alias("row"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    first = staged(d.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "row",
                            F.expr(found_spans("_text")).alias("_found"), F.expr(candidates("_text")).alias("_seen")), "pii-first")
    free = F.when(F.size("_found") == 0, F.col("_seen")).otherwise(F.expr(_free("_found", "_seen")))
    unknown = first.where("size(_seen) > 0").select("_row", free.alias("free")).select("_row", F.explode("free").alias("w")).select("_row", "w.*")
    known = first.where("size(_found) > 0").select(F.explode("_found").alias("b")).select("b.word", "b.before", "b.after", F.array("b.kind").alias("kinds"))
    trusted = trusted_patterns(known.unionByName(unknown.select("word", "before", "after", F.expr("cast(array() as array<string>)").alias("kinds"))), **limits)
    first = first.withColumn("_found", F.expr(bare("_found"))).withColumnRenamed("_found", "base")
    keys = F.array(*(F.when(c, F.concat(*v)) for c, v in (
        (F.col("before") != "", (F.lit("L "), "before")), (F.col("after") != "", (F.lit("R "), "after")),
        ((F.col("before") != "") & (F.col("after") != ""), (F.lit("B "), "before", F.lit(" "), "after")))))
    rank = F.expr(" ".join(["case kind", *(f"when '{k[0]}' then {len(KINDS) + i}" for i, k in enumerate(KINDS)), "end"]))
    added = (unknown.select("_row", "start", "end", "word", F.explode(F.array_compact(keys)).alias("pattern")).join(trusted, "pattern")
             .where(F.expr(SHAPE))
             .groupBy("_row").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("ctx_"), "kind").alias("kind"))).alias("added")))
    some = first.where("size(_seen) > 0").drop("_seen").join(added, "_row", "left")
    none = first.where("size(_seen) = 0").drop("_seen").withColumn("added", F.lit(None).cast(SPAN))
    return some.unionByName(none).withColumn("spans", F.expr(f"array_sort(concat(base, coalesce(cast(added as {SPAN}), cast(array() as {SPAN}))))")).drop("_row", "added")


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests of every row."""
    found = find_pii(docs)
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k[0]}')) as long)").alias(f"n_{k[0]}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets (overlapping spans by the first
    one's) and n_chars, where there is such a column, counted anew."""
    cols = docs.columns
    found = find_pii(docs, carry=cols)
    # a span that starts where no earlier one reaches begins a cluster of overlapping ones; places are the spans' numbers
    heads = "filter(transform(spans, (x_, i_) -> if(i_ = 0 or x_.start >= ends_[i_ - 1], i_, null)), v_ -> v_ is not null)"
    clusters = ("transform(heads_, (h_, k_) -> struct(spans[h_].start AS start, if(k_ + 1 < size(heads_), ends_[heads_[k_ + 1] - 1], ends_[size(ends_) - 1]) AS end, "
                "spans[h_].kind AS kind))")
    between = ("concat(transform(all_, (c_, k_) -> struct(if(k_ = 0, 0, all_[k_ - 1].end) AS start, c_.start AS end)), "
               "array(struct(all_[size(all_) - 1].end AS start, length(row.text) AS end)))")
    masked = let("ends_", running_max("transform(spans, x_ -> x_.end)"), let("heads_", heads, let("all_", clusters, let(
        "kept_", pieces("row.text", between), "array_join(transform(kept_, (t_, k_) -> concat(t_, if(k_ < size(all_), concat('[', upper(all_[k_].kind), ']'), ''))), '')"))))
    new = {"text": F.expr(f"if(size(spans) = 0, row.text, {masked})")}
    if "n_chars" in cols:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("new_text")).cast(kind)
    out = found.withColumn("new_text", new["text"])
    return out.select(*(F.col("new_text").alias(c) if c == "text" else new["n_chars"].alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in cols))
