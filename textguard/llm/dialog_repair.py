"""Operator 11 - conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is well formed if its role initials are nothing, or an optional s and then one or more ua. A repair
keeps a row (cost 0), gives it the role user or assistant (Rerole, 1), deletes it (2), or inserts an empty
turn of user or assistant anywhere (5); a truncated row that stays adds 5, blank and duplicate rows must go. The
lightest repair is the one of least cost, and among those of the ASCII-least audit (the edits' initials).

Edits are weighted deductions (``lightest.derive``). A long conversation isn't solved in one task: its
rows, without their texts, are ordered by a range sort and cut into blocks of ``BLOCK`` places of that order. A block
gives the lightest (cost, audit) between every state at its start and every state at its end; neighbouring blocks are joined by
deductions with two antecedents, (block, s, q) and (rest, q, t) -> (s, t), at most ``FAN`` at a time, until
one item is left. Joining is monotone: audits of the same rows with equal cost have equally many letters that are not I, and
as many I, so neither is the beginning of the other.

Equal rows of a turn are one fact with a number of copies: behind the first, copies are deleted, which is
lightest right behind it (D is the least letter). Texts are moved once, to be repaired in order: a conversation is
streamed through a task row by row (its digest is sequential), only its audit is held.

Defined results: a null conv_id is a conversation of its own; null roles and texts are one space, so a null text is blank; an
empty role has no initial. Rows of a conversation are ordered by turn, nulls first; rows of one turn by role, then
by the SHA-256 of the text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textguard.llm.common import small_batches, staged
from textguard.llm.lightest import derive

# Edits and their costs, the roles that can be given, and what the damage code does.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
DROP, EMPTY, UNSTOP, REPEAT, AS_USER, CODES = 0, 1, 2, 3, 4, 20
SPACES = " \t\n\x0b\x0c\r"

#: States of the role initials: nothing yet, after s, after u, after a; where a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
GOALS = (START, AFTER_A)
NAMES = {"u": "user", "a": "assistant"}

#: Places of a block in the order of all facts, and blocks that are joined at a time.
BLOCK, FAN = 512, 64

OK, BLANK, DUPLICATE, CUT = range(4)

_WHOLE = "n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PIECE = f"block bigint, whole boolean, {_WHOLE}, first string, last string, ways array<struct<s:int,t:int,cost:bigint,audit:string>>"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by crc32 of ``conv_id:turn``; copies is 0 for a dropped row, 2 for a repeated one."""
    def seen(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", seen("conv_id"), seen("turn")).cast("binary")) % CODES
    text = F.when(code == EMPTY, "").when(code == UNSTOP, F.translate(seen("text"), ".!?", "")).otherwise(seen("text"))
    return turns.select("conv_id", "turn", F.when(code == AS_USER, "user").otherwise(seen("role")).alias("role"), text.alias("text"),
                        F.when(code == DROP, 0).when(code == REPEAT, 2).otherwise(1).alias("copies"))


def facts(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conv_id, turn, role, text) of ``damaged`` rows, without the text: its hash, the number of copies, its fault
    (apart from duplicates), written in order; ``at`` rises in that order, in blocks of consecutive numbers for each part."""
    ink = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(ink == "", BLANK).when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK)
    one = (rows.where("copies > 0").select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), fault.alias("fault"),
                                           F.col("copies").cast("bigint"))
           .groupBy("conv_id", "turn", "role", "text_hash", "fault").agg(F.sum("copies").alias("copies")))
    order = ["conv_id", "turn", "role", "text_hash"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = one.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(ranged.withColumn("at", F.monotonically_increasing_id()), "dialog-facts")


def _with_duplicates(fact: DataFrame) -> DataFrame:
    """``facts`` with ``first``: whether role and text were not seen earlier in the conversation. Firsts are joined back by place, which is unique."""
    firsts = fact.groupBy("conv_id", "role", "text_hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    return fact.join(firsts, "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def edits(initial: str, fault: int, copies: int, s: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) for a fact met in state ``s``."""
    if fault in (BLANK, DUPLICATE):
        return [(DELETE * copies, "D" * copies, s)]
    more, rest = DELETE * (copies - 1), "D" * (copies - 1)
    stays = TRUNCATED if fault == CUT else 0
    out = [(DELETE + more, "D" + rest, s)]
    if (s, initial) in STEP:
        out.append((KEEP + stays + more, "K" + rest, STEP[s, initial]))
    out += [(REROLE + stays + more, "R" + rest, STEP[s, r]) for r in NAMES if (s, r) in STEP and r != initial]
    return out


def _back(rows: list[tuple[str, int, int]]):
    """Edges into (place, state) of the chain of ``rows`` (initial, fault, copies): edits of the row before, inserts at the place."""
    insert = {t: [(INSERT, "I", s) for (s, r), to in STEP.items() if to == t and r in NAMES] for t in range(4)}
    known: dict[tuple[str, int, int], dict[int, list]] = {}

    def into(i: int, t: int):
        for c, w, s in insert[t]:
            yield c, w, i, s
        if i:
            row = rows[i - 1]
            if row not in known:
                by = known[row] = {q: [] for q in range(4)}
                for s in range(4):
                    for c, w, q in edits(*row, s):
                        by[q].append((c, w, s))
            for c, w, s in known[row][t]:
                yield c, w, i - 1, s
    return into


def ways(rows: list[tuple[str, int, int]]) -> list[dict]:
    """Lightest (cost, audit) from every state before ``rows`` to every state behind them."""
    out = []
    for t in range(4):
        final = derive(len(rows), [t], _back(rows))
        out += [{"s": s, "t": t, "cost": final[0, s][0], "audit": final[0, s][1]} for s in range(4) if (0, s) in final]
    return out


def lightest(rows: list[tuple[str, int, int]]) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation."""
    cost, audit, _ = derive(len(rows), GOALS, _back(rows), goal=(0, START))[0, START]
    return cost, audit


def joined(parts: list[list[dict]]) -> list[dict]:
    """Ways through neighbouring blocks: an item of the rest behind, and a way of the block before it, as antecedents."""
    into = [{t: [(w["cost"], w["audit"], w["s"]) for w in ws if w["t"] == t] for t in range(4)} for ws in parts]
    out = []
    for t in range(4):
        final = derive(len(parts), [t], lambda i, q: [(c, w, i - 1, s) for c, w, s in into[i - 1][q]] if i else [])
        out += [{"s": s, "t": t, "cost": final[0, s][0], "audit": final[0, s][1]} for s in range(4) if (0, s) in final]
    return out


def _pairs_illegal(initials: list[str]) -> int:
    return sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:]))


def _piece(conv, block: int, rows: list[tuple]) -> dict:
    """A block of one conversation: counts, initials at its ends, and its ways. ``rows``: (role, fault, copies, first)."""
    chain, count = [], Counter()
    for role, fault, copies, first in rows:
        initial = role[:1]
        if fault == BLANK:
            count["blank"] += copies
            chain.append((initial, BLANK, copies))
        elif first:
            count["duplicate"] += copies - 1
            count["truncated"] += fault == CUT
            chain.append((initial, fault, copies))
        else:
            count["duplicate"] += copies
            chain.append((initial, DUPLICATE, copies))
    initials = [r[0] for r in chain]
    return {"conv_id": conv, "block": block, "n_rows": sum(r[2] for r in chain), "blank": count["blank"], "duplicate": count["duplicate"],
            "truncated": count["truncated"], "illegal": _pairs_illegal(initials) + sum(r[2] - 1 for r in chain), "first": initials[0], "last": initials[-1],
            "chain": chain}


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Facts in order (one block together) to one row for each block of a conversation. A conversation between two others of
    its block is whole: it has a single way, its lightest repair."""
    block, rows, out = None, [], []

    def close() -> list[dict]:
        runs = [(c, [r[1:] for r in g]) for c, g in groupby(rows, key=lambda r: r[0])]
        pieces = [_piece(conv, block, run) for conv, run in runs]
        for k, piece in enumerate(pieces):
            chain, piece["whole"] = piece.pop("chain"), 0 < k < len(pieces) - 1
            if piece["whole"]:
                cost, audit = lightest(chain)
                piece["ways"] = [{"s": START, "t": AFTER_A, "cost": cost, "audit": audit}]
            else:
                piece["ways"] = ways(chain)
        return pieces
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "conv_id", "role", "fault", "copies", "first")]
        for b, *row in zip(*cols):
            if b != block and rows:
                out += close()
                rows = []
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            block = b
            rows.append(row)
    if rows:
        out += close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _join_blocks(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Up to FAN neighbouring blocks of one conversation as one."""
    parts = sorted(table.to_pylist(), key=lambda r: r["block"])
    one = dict(parts[0]) | {k: sum(p[k] for p in parts) for k in ("n_rows", "blank", "duplicate", "truncated", "illegal")}
    one["illegal"] += sum(_pairs_illegal([x["last"], y["first"]]) for x, y in zip(parts, parts[1:]))
    one |= {"block": parts[0]["into"], "last": parts[-1]["last"], "ways": joined([p["ways"] for p in parts])}
    return pa.Table.from_pylist([{f: one[f] for f in schema.names}], schema=schema)


def solve(fact: DataFrame) -> DataFrame:
    """(conv_id, counts of faults, cost, audit) of every conversation with a fact."""
    spark = fact.sparkSession
    kind = f"conv_id {fact.schema['conv_id'].dataType.simpleString()}, {_PIECE}"
    schema = to_arrow_schema(spark.createDataFrame([], kind).schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = BLOCK.bit_length() - 1
    blocks = (_with_duplicates(fact).select("at", F.shiftright("at", size).alias("block"), "conv_id", "role", "fault", "copies", "first")
              .repartition(parts, "block").sortWithinPartitions("at"))
    pieces = staged(blocks.mapInArrow(lambda it: _pieces(it, schema), kind), "dialog-pieces")
    done, open_ = pieces.where("whole"), pieces.where("NOT whole")
    while True:
        # conversations of more than FAN pieces are joined in runs of neighbouring block numbers, the others at once
        each = open_.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
        if each.isEmpty():
            break
        into = F.when(F.col("n") > FAN, F.shiftright("block", FAN.bit_length() - 1)).otherwise(-1)
        split = open_.join(each, open_["conv_id"].eqNullSafe(each["of"]), "left").withColumn("into", into).drop("of")
        done = done.unionByName(split.where("n IS NULL").drop("n", "into"))
        open_ = staged(split.where("n IS NOT NULL").drop("n").groupBy("conv_id", "into").applyInArrow(lambda t: _join_blocks(t, schema), kind),
                       "dialog-pieces")
    best = F.expr("array_min(transform(filter(ways, w -> w.s = 0 AND w.t IN (0, 3)), w -> struct(w.cost, w.audit)))")
    return (done.unionByName(open_).withColumn("best", best)
            .select("conv_id", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")))


def _heads(rows: DataFrame) -> DataFrame:
    """One row for every conv_id of ``damaged`` rows: gaps, faults, cost, audit; zeros and an empty audit where no row is left."""
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("bigint").alias("gaps"))
    found = solve(facts(rows)).withColumnRenamed("conv_id", "of")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return (gaps.join(found, gaps["conv_id"].eqNullSafe(found["of"]), "left")
            .select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit")))


def _in_order(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Every conversation's head, then its rows in order, together in one partition."""
    have = rows.where("copies > 0").withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("is_row", F.lit(True))
    both = heads.withColumn("is_row", F.lit(False)).unionByName(have, allowMissingColumns=True)
    return (small_batches(both).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
            .sortWithinPartitions("conv_id", "is_row", "turn", "role", "text_hash").drop("text_hash"))


class _Walk:
    """A conversation repaired row by row by its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _given(self) -> str:
        """The role that an insert or a rerole gives in this state."""
        return "a" if self.state == AFTER_U else "u"

    def inserts(self) -> Iterator[tuple[str, str]]:
        """(edit, role) of the inserts that come next."""
        while self.audit[self.at:self.at + 1] == "I":
            role = self._given()
            self.at, self.state = self.at + 1, STEP[self.state, role]
            yield "I", NAMES[role]

    def row(self, role: str) -> tuple[str, str] | None:
        """(edit, role) of the next row, nothing if it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        initial = role[:1] if edit == "K" else self._given()
        self.state = STEP[self.state, initial]
        return edit, role if edit == "K" else NAMES[initial]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For the batches of ``_in_order``, one list at a time: heads as ('head', row), repaired turns as ('turn', conv_id, turn, role, text, edit)."""
    walk = conv = None
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("is_row", "conv_id", "turn", "role", "text", "copies")]
        for k, (is_row, cid, turn, role, text, copies) in enumerate(zip(*cols)):
            if not is_row:
                if walk:
                    out += [("turn", conv, None, r, "", e) for e, r in walk.inserts()]
                head = {c: batch.column(c)[k].as_py() for c in ("conv_id", *_HEAD)}
                walk, conv = _Walk(head["audit"]), cid
                out.append(("head", head))
                continue
            for _ in range(copies):
                out += [("turn", conv, None, r, "", e) for e, r in walk.inserts()]
                kept = walk.row(role)
                if kept:
                    out.append(("turn", conv, turn, kept[1], text, kept[0]))
        yield out
    if walk:
        yield [("turn", conv, None, r, "", e) for e, r in walk.inserts()]


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of (conv_id, turn, role, text, copies) rows: conv_id, place (from 0), turn (null for an insert), role, text, edit."""
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place bigint, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, edit string"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)

    def turns(batches):
        place = 0
        for events in _walked(batches):
            out = []
            for e in events:
                if e[0] == "head":
                    place = 0
                else:
                    out.append({"conv_id": e[1], "place": place, "turn": e[2], "role": e[3], "text": e[4], "edit": e[5]})
                    place += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return _in_order(rows, _heads(rows)).mapInArrow(turns, kind)


def report(rows: DataFrame) -> DataFrame:
    """One row for every conv_id of (conv_id, turn, role, text, copies) rows: faults, cost, audit, and the digest of its repaired turns."""
    kind = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "cost bigint, audit string, repaired_sha256 string")
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)

    def digests(batches):
        head, sha, glue = None, None, b""
        for events in _walked(batches):
            out = []
            for e in events:
                if e[0] == "head":
                    if head:
                        out.append(head | {"repaired_sha256": sha.hexdigest()})
                    head, sha, glue = e[1], hashlib.sha256(), b""
                else:
                    sha.update(glue + f"{e[3]}:{e[4]}".encode())
                    glue = b"\n"
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if head:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": sha.hexdigest()}], schema=schema)
    return _in_order(rows, _heads(rows)).mapInArrow(digests, kind)
