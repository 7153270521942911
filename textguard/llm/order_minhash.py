"""Operator 6 - document fingerprints by Order MinHash, in DataFrame and SQL operations only.

A text's k-mers are its runs of ``WORDS_PER_MER`` words, each with its occurrence number, so the
third copy of a k-mer is an element of its own. The hash of (k-mer, occurrence) deals the
elements over ``SLOTS`` slots; in each slot the ``PICKS`` least hashes are selected, put back into
text order, and their k-mers hashed as a tuple. A slot that gets fewer elements than that selects from
all elements of the text, by a hash of its own, so short texts have tuples in every slot too. Moving a passage therefore changes signatures
even when the set of k-mers stays the same, which plain MinHash does not notice: the likeness
of two fingerprints, the share of equal slots among the slots used by either, falls with edit
distance.

Occurrence numbers come from one sort per text: equal k-mers become neighbours, so the number
is the distance to the start of the run. All steps are array expressions over the row's own
text, on arrays of longs; the only shuffle brings each document next to its successor by doc_id.

Defined results: null text is empty; an empty text has an empty fingerprint, of likeness 1 to
another empty one and 0 to others; a text of fewer words than a k-mer has one k-mer, the whole
sequence. Rows are ordered by doc_id (null first), then text, so repeated rows follow each
other; after the last row comes the first, which for one row is itself. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.sqlspans import let

WORDS_PER_MER = 2
SLOTS, PICKS = 64, 2
#: Documents between two cuts of the id order, and the most cuts; with more documents the cuts hold more.
ROWS_PER_CUT, MAX_CUTS = 500, 4096


#: An element is one long: a hash above, the place of its first word (in words) in the low bits.
_PLACE_BITS = 30  # a string holds fewer words
_PLACE, _HASH = (1 << _PLACE_BITS) - 1, -(1 << _PLACE_BITS)


def fingerprint(text: str) -> str:
    """SQL for the slots of column ``text``: an int per slot, all 0 for a text without words."""
    words = rf"filter(split({text}, r'[\x20\x09-\x0D]++', -1), x_ -> x_ != '')"
    mers = (f"transform(sequence(1, greatest(size(w_) - {WORDS_PER_MER - 1}, 1)), "
            f"i_ -> xxhash64({', '.join(f'try_element_at(w_, i_ + {k})' for k in range(WORDS_PER_MER))}))")
    # sorted by k-mer and place; a run of one k-mer starts where it differs from the one before
    by_mer = f"sort_array(transform(g_, (x_, i_) -> (x_ & {_HASH}L) | i_))"
    starts = f"filter(sequence(0, size(s_) - 1), j_ -> j_ = 0 or (s_[j_] & {_HASH}L) != (s_[j_ - 1] & {_HASH}L))"
    # the occurrence number is the distance to the start of the run
    numbered = (f"sort_array(flatten(transform(r_, (a_, q_) -> transform(sequence(a_, coalesce(try_element_at(r_, q_ + 2), size(s_)) - 1), "
                f"j_ -> (xxhash64(s_[j_] & {_HASH}L, j_ - a_) & {_HASH}L) | (s_[j_] & {_PLACE}L)))))")
    slot = f"shiftrightunsigned({{}}, {64 - SLOTS.bit_length() + 1})"
    heads = f"filter(sequence(0, size(t_) - 1), j_ -> j_ = 0 or {slot.format('t_[j_]')} != {slot.format('t_[j_ - 1]')})"
    # the least elements of a slot, put back into text order, as a tuple of k-mers
    picked = f"sort_array(transform(sequence(a_, least(a_ + {PICKS}, coalesce(try_element_at(f_, q_ + 2), size(t_))) - 1), j_ -> cast(t_[j_] & {_PLACE}L as int)))"
    enough = f"coalesce(try_element_at(f_, q_ + 2), size(t_)) - a_ >= {PICKS}"
    used = f"map_from_entries(transform(f_, (a_, q_) -> struct({slot.format('t_[a_]')} AS slot, if({enough}, hash(transform({picked}, i_ -> g_[i_])), null) AS v)))"
    # of all elements, for a slot with too few
    remixed = f"sort_array(transform(t_, x_ -> (xxhash64(x_ & {_HASH}L, k_) & {_HASH}L) | (x_ & {_PLACE}L)))"
    least = f"sort_array(transform(slice({remixed}, 1, {PICKS}), x_ -> cast(x_ & {_PLACE}L as int)))"
    slots = let("f_", heads, let("m_", used, f"transform(sequence(0L, {SLOTS - 1}L), k_ -> coalesce(try_element_at(m_, k_), hash(transform({least}, i_ -> g_[i_]))))"))
    body = let("g_", mers, let("s_", by_mer, let("r_", starts, let("t_", numbered, slots))))
    return let("w_", words, f"if(size(w_) = 0, array_repeat(0, {SLOTS}), {body})")


def likeness(a: str, b: str) -> Column:
    """Share of equal slots among those used by either fingerprint (1 for two empty ones)."""
    both = f"zip_with({a}, {b}, (x, y) -> struct(x AS a, y AS b))"
    return F.expr(let("z_", f"filter({both}, z -> z.a != 0 or z.b != 0)",
                      "if(size(z_) = 0, cast(1.0 as double), size(filter(z_, z -> z.a = z.b)) / cast(size(z_) as double))"))


def with_next(docs: DataFrame, added: dict[str, str], rows_per_cut: int = ROWS_PER_CUT) -> DataFrame:
    """``docs`` (doc_id, text) with the columns ``added`` (SQL over text), and text and those columns of the
    following row by (doc_id, text) as next_<col>; the last row is followed by the first.

    The id order is cut at quantiles; rows are numbered inside a cut, and a cut's last row gets its
    successor from a table with the first row of each cut."""
    cols = ["text", *added]

    def complete(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.expr(v) for k, v in added.items()}) if added else df

    n = docs.count()
    cuts = min(MAX_CUTS, max(1, n // rows_per_cut))
    at = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 100 * cuts + 100).alias("q")).first()["q"] if cuts > 1 else None
    edges = sorted(set(at or []))
    part = F.size(F.filter(F.lit(edges), lambda x: x < F.col("doc_id"))) if edges else F.lit(0)
    d = docs.withColumn("_cut", F.when(F.col("doc_id").isNull(), 0).otherwise(part))
    w = Window.partitionBy("_cut").orderBy("doc_id", "text")
    ahead = complete(d).withColumn("_next", F.lead(F.struct(*cols)).over(w))
    heads = complete(d.groupBy("_cut").agg(F.min(F.struct("doc_id", "text")).alias("_least")).select("_cut", "_least.text"))
    heads = heads.select("_cut", F.struct(*cols).alias("_head"))
    first = heads.agg(F.min_by("_head", "_cut").alias("_first"))  # one row
    after = heads.select("_cut", F.lead("_head").over(Window.orderBy("_cut")).alias("_after"))  # one row per cut
    after = after.join(F.broadcast(first)).select("_cut", F.coalesce("_after", "_first").alias("_after"))
    out = ahead.join(after.hint("shuffle_hash"), "_cut", "left")
    return out.select(*docs.columns, *added, *(F.when(F.col("_next").isNull(), F.col(f"_after.{c}")).otherwise(F.col(f"_next.{c}")).alias(f"next_{c}") for c in cols))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = with_next(d, {"fp": fingerprint("text")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp",
                 F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    d = d.withColumn("edited_fp", F.expr(fingerprint("edited")))
    text_of = lambda c: F.concat_ws("", F.transform(c, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("fp")).alias("fingerprint"),
                    text_of(F.col("edited_fp")).alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
