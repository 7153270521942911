"""Operator 2 - quality rules as a short-circuit cascade.

Every document gets its base counts. Those that pass the two base rules go through further
rules, each of which can reject. A sample of the table is timed first: per rule its mean
cost and its rejection rate; the rules then run in descending order of rejections per
second, and a document leaves at its first rejection. The order changes the work, never the
verdict, because a document is kept only if no rule rejects it.

Defined results: null or empty text has no words and fails the base rule; repeated rows are
judged one by one; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import ASCII_SPACE, small_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Share of the rows that the cost sample reads, and the most rows it times. Only the order of the rules depends on it.
SAMPLE_FRACTION = 0.1
SAMPLE_ROWS = 400

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: Without white space and UTF-8 continuation bytes, each byte left stands for one code point of a word.
_NOT_COUNTED = bytes(np.flatnonzero(ASCII_SPACE).tolist()) + bytes(range(0x80, 0xC0))
_NO_LETTER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


class Doc:
    """One text; its counts are made when a rule first asks for them."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        n = len(w) - 2
        if n < 2 or len(set(zip(w, w[1:], w[2:]))) == n:
            return 0
        hit, first = np.zeros(n + 2, dtype=bool), {}
        for i, t in enumerate(zip(w, w[1:], w[2:])):
            j = first.setdefault(t, i)
            if j != i:
                hit[i:i + 3] = True
                hit[j:j + 3] = True
        return int(hit.sum())


# Further rules. Each says whether it rejects the document.
def odd_word_length(d: Doc) -> bool:
    """Words of under 2 or over 20 characters on average."""
    return d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words


def symbol_heavy(d: Doc) -> bool:
    """More than one symbol for ten words."""
    return 10 * d.n_symbols > d.n_words


def repeated_lines(d: Doc) -> bool:
    """Three lines or more, and more than 30 % of the lines, repeat an earlier one."""
    return d.n_dup_lines >= 3 and 100 * d.n_dup_lines > 30 * len(d.lines)


def shouting(d: Doc) -> bool:
    """More than half of the ASCII letters are capitals."""
    upper = len(d.raw) - len(d.raw.translate(None, _UPPER))
    return 2 * upper > upper + len(d.raw) - len(d.raw.translate(None, _LOWER))


def few_letter_words(d: Doc) -> bool:
    """Under 80 % of the words hold a letter (ASCII letter or any non-ASCII character)."""
    return 100 * sum(1 for w in d.words if w.translate(None, _NO_LETTER)) < 80 * d.n_words


RULES: dict[str, Callable[[Doc], bool]] = {
    f.__name__: f for f in (odd_word_length, symbol_heavy, repeated_lines, shouting, few_letter_words)
}


def base_failed(d: Doc) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float      # mean time of one judgement, its own counts included
    rejected: float     # share it rejects of the sampled rows that reach the rules

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.large_binary()).to_pylist():
        yield x or b""


def rule_costs(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES,
               fraction: float = SAMPLE_FRACTION, rows: int = SAMPLE_ROWS) -> list[RuleCost]:
    """Cost and selectivity of each rule on a sample of ``docs``, timed on the executors: of the rows that the base rules
    pass on, as the cascade sees no others, and without splitting words, which the base rules have paid."""
    names = list(rules)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: [0, 0.0, 0] for k in names}
        for b in batches:
            for raw in _texts(b, 0):
                base = Doc(raw)
                if base_failed(base):
                    continue
                for k in names:
                    d = Doc(raw)
                    d.words, d.n_words = base.words, base.n_words
                    t = time.perf_counter()
                    no = rules[k](d)
                    x = total[k]
                    x[0] += 1
                    x[1] += time.perf_counter() - t
                    x[2] += bool(no)
        yield pa.RecordBatch.from_pydict({"name": names, "n": [total[k][0] for k in names],
                                          "s": [total[k][1] for k in names], "r": [total[k][2] for k in names]},
                                         pa.schema([("name", pa.string()), ("n", pa.int64()), ("s", pa.float64()), ("r", pa.int64())]))

    got = (docs.select("text").sample(False, fraction, 7).limit(rows)
           .mapInArrow(timed, "name string, n long, s double, r long")
           .groupBy("name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("r").alias("r")).collect())
    by = {x["name"]: x for x in got}
    out = []
    for k in names:
        n = by[k]["n"] if k in by else 0
        out.append(RuleCost(k, by[k]["s"] / n if n else 0.0, by[k]["r"] / n if n else 0.0))
    return out


def order_rules(costs: list[RuleCost]) -> list[str]:
    """Most rejections per second first; ties and unsampled rules by name."""
    return [c.name for c in sorted(costs, key=lambda c: (-c.worth, c.seconds, c.name))]


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, order: list[str] | None = None) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text)."""
    order = order if order is not None else order_rules(rule_costs(docs, rules))
    chain = [rules[k] for k in order]
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {k: [] for k in (*keys, "base_failed", "kept")}
            for raw in _texts(b, 1):
                d = Doc(raw)
                for k in keys:
                    cols[k].append(getattr(d, k))
                failed = base_failed(d)
                cols["base_failed"].append(failed)
                cols["kept"].append(not failed and not any(rule(d) for rule in chain))
            arrays = [b.column(0), *(pa.array(cols[k], pa.int64()) for k in keys),
                      pa.array(cols["base_failed"], pa.bool_()), pa.array(cols["kept"], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *keys, "base_failed", "kept"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order = order if order is not None else order_rules(rule_costs(docs, rules))
    chain = [rules[k] for k in order]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for raw in _texts(b, at):
                d = Doc(raw)
                keep.append(not base_failed(d) and not any(rule(d) for rule in chain))
            yield b.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


# DuckDB twin of judge() over the table documents.
ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
     g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
     g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
     cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n >= 2) GROUP BY rid),
     m AS (SELECT doc_id, t, ws, ls, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
                  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low
           FROM w LEFT JOIN cover USING (rid)),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AND NOT 10 * n_symbols > n_words
       AND NOT (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(ls)) AND NOT 2 * up > up + low
       AND NOT 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 80 * n_words AS kept
FROM f
"""
