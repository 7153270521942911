"""Helpers to state large native expressions as Spark SQL text.

A rule list of dozens of literals becomes hundreds of expression nodes; building them
one py4j call at a time costs seconds per query, while ``F.expr`` parses the same
expression in milliseconds on the JVM. The expressions are identical either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.text import uni


def sql_str(s: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def str_array(items) -> str:
    return "array(" + ", ".join(sql_str(i) for i in items) + ")"


EMPTY_STR_ARRAY = "CAST(array() AS ARRAY<STRING>)"


def substring_hits_sql(views: list[str], needles) -> str:
    """Needles (in list order) present as substrings in any of the named columns.

    Written out per needle rather than as ``filter(array, k -> ...)``: a staged column
    referenced only inside a lambda looks single-use to the optimizer, which then inlines
    its (expensive) expression into the lambda and re-evaluates it for every needle."""
    parts = []
    for n in needles:
        cond = " OR ".join(f"contains({ident(v)}, {sql_str(n)})" for v in views)
        parts.append(f"CASE WHEN {cond} THEN array({sql_str(n)}) ELSE {EMPTY_STR_ARRAY} END")
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _guarded(view: str, pattern: str, flags: str, requires: dict | None) -> str:
    rx = f"{ident(view)} RLIKE {sql_str(flags + uni(pattern))}"
    lits = (requires or {}).get(pattern)
    if not lits:
        return rx
    pre = " OR ".join(f"contains({ident(view)}, {sql_str(x)})" for x in lits)
    return f"(({pre}) AND {rx})"


def regex_hits_sql(views: list[str], patterns, flags: str = "(?i)", requires: dict | None = None) -> str:
    """Patterns (in list order) that match any of the named columns; each pattern stays
    a literal so it is compiled once per task. ``requires`` maps a pattern to literals one
    of which every match contains (lower-case views): the regex runs only when one occurs."""
    parts = []
    for p in patterns:
        cond = " OR ".join(_guarded(v, p, flags, requires) for v in views)
        parts.append(f"CASE WHEN {cond} THEN array({sql_str(p)}) ELSE {EMPTY_STR_ARRAY} END")
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def first_regex_sql(view: str, patterns, flags: str = "(?i)", requires: dict | None = None) -> str:
    """The first pattern (in list order) matching the named column, else NULL."""
    whens = " ".join(f"WHEN {_guarded(view, p, flags, requires)} THEN {sql_str(p)}" for p in patterns)
    return f"CASE {whens} ELSE CAST(NULL AS STRING) END"


def expr(sql: str) -> Column:
    return F.expr(sql)
