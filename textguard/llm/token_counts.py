"""Operator 12 - token counts, huge documents by overlapping chunks that are resynchronised.

A text of up to ``chunk`` bytes is encoded in one go. A longer one is cut every ``chunk`` bytes; each
chunk also takes along the first ``overlap`` bytes of the next one, and the chunks are encoded
apart, in any task, with byte offsets. Two neighbours are spliced at their first common boundary:
a place in the overlap where both end a pre-token. Such a place is proven stable:

* the split pattern has no look-behind, so from a boundary of the whole text on, a chunk's
  pre-tokens are the text's;
* a pre-token of the left chunk is the text's own if the pattern saw enough behind it: three
  characters, and the longest added token, which is searched before the pattern (``margin``);
* the first chunk starts at the start of the text, and each splice hands the proof on.

Tokens never cross pre-tokens, so a text's count is a sum over splices and its last chunk. Where
neighbours have no common boundary (a run longer than the overlap), the overlap is widened to
the whole next chunk, both become one chunk, and the round is repeated for that document.

This holds for byte-level BPE files (``.json``). Texts under other files (other ``.json``, or
``.model``, which is read by sentencepiece) are encoded whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted row by
row; null doc_ids are returned; other columns are ignored; an empty table gives no rows. Special
strings inside texts count as the library does by default, as one token each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.llm import bytebpe
from textguard.llm.common import small_batches, staged

#: Bytes of a chunk and of the overlap of neighbours.
CHUNK, OVERLAP = 1 << 16, 1 << 10

#: What the split pattern may look at behind a match: three characters of up to four bytes.
LOOK_AHEAD = 12

_PARTS = "key string, part int, core binary, tail binary, ends boolean"
_SPLICE = "key string, part int, n_tokens bigint, head_at array<int>, head_n array<bigint>, tail_at array<int>, tail_n array<bigint>"


def count(docs: DataFrame, tokenizer_file: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    with open(tokenizer_file, "rb") as f:
        spec = f.read()
    if tokenizer_file.endswith(".model"):
        kind = "piece"
    else:
        kind = "bytes" if bytebpe.splits_at_space(spec) else "whole"
    if chunk <= overlap:
        raise ValueError("a chunk must be longer than the overlap")
    file = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, a few MB
    pick = small_batches(docs).select("doc_id", "text")
    doc_id = pick.schema["doc_id"].dataType.simpleString()
    cut = chunk if kind == "bytes" else None
    first = staged(pick.mapInArrow(lambda it: _first(it, file.value, kind, cut, overlap), f"doc_id {doc_id}, n_bytes bigint, n_tokens bigint, {_PARTS}"),
                   "token-counts")
    found = first.where("part IS NULL").select("doc_id", "n_bytes", "n_tokens")
    open_ = first.where("part IS NOT NULL").select("key", "part", "core", "tail", "ends")
    owner = first.where("part = 0").select("key", "doc_id", "n_bytes")
    if kind == "bytes" and not open_.isEmpty():
        found = found.unionByName(owner.join(_spliced(open_, file, overlap), "key").select("doc_id", "n_bytes", "n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def _first(batches: Iterator[pa.RecordBatch], spec: bytes, kind: str, chunk: int | None, overlap: int) -> Iterator[pa.RecordBatch]:
    """A row with its count for every short text, a row for each chunk of a long one."""
    counter = _counter(spec, kind)
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        long = np.zeros(len(size), bool) if chunk is None else size > chunk
        short = np.flatnonzero(~long)
        n = counter([t or "" for t in col.take(pa.array(short)).to_pylist()])
        yield _rows(ids.take(pa.array(short)), size[short], n, {})
        for i in np.flatnonzero(long).tolist():
            key, parts = uuid.uuid4().hex, cuts(col[i].as_py().encode(), chunk, overlap)
            for a in range(0, len(parts), 64):
                some = parts[a:a + 64]
                yield _rows(pa.concat_arrays([ids.slice(i, 1)] * len(some)), np.full(len(some), size[i]), None,
                            {"key": [key] * len(some), "part": list(range(a, a + len(some))), "core": [p[0] for p in some],
                             "tail": [p[1] for p in some], "ends": [p[2] for p in some]})


def _rows(ids: pa.Array, size: np.ndarray, n: np.ndarray | None, parts: dict) -> pa.RecordBatch:
    m = len(ids)
    types = {"key": pa.string(), "part": pa.int32(), "core": pa.binary(), "tail": pa.binary(), "ends": pa.bool_()}
    more = [pa.array(parts[k], t) if parts else pa.nulls(m, t) for k, t in types.items()]
    counts = pa.nulls(m, pa.int64()) if n is None else pa.array(n, pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), counts, *more], names=["doc_id", "n_bytes", "n_tokens", *types])


def _counter(spec: bytes, kind: str):
    if kind == "bytes":
        return bytebpe.segments(spec, plain=False).counts
    if kind == "piece":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return lambda texts: np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)
    tok = bytebpe.tokenizer(spec, plain=False)
    return lambda texts: np.array([len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], np.int64)


def cuts(data: bytes, chunk: int, overlap: int) -> list[tuple[bytes, bytes, bool]]:
    """(core, overlap with the next chunk, whether it reaches the end of the text), at starts of characters."""
    def start(p: int) -> int:
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        return min(p, len(data))
    at = sorted({start(p) for p in range(0, len(data), chunk)} | {len(data)})
    return [(data[a:b], data[b:(e := start(b + overlap))], e == len(data)) for a, b in zip(at[:-1], at[1:])]


def boundaries(tok, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens end, 0 included, and the number of tokens before each."""
    e = tok.encode(text, add_special_tokens=False)
    if not e.ids:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends = np.cumsum(lengths[np.array(e.ids)])
    word = np.array([-1 if w is None else w for w in e.word_ids])
    last = np.append(np.flatnonzero((word[1:] != word[:-1]) | (word[1:] < 0)), len(word) - 1)
    return np.append(0, ends[last]), np.append(0, last + 1)


def _encoded(batches: Iterator[pa.RecordBatch], spec: bytes, overlap: int) -> Iterator[pa.RecordBatch]:
    """Every chunk encoded: its tokens, and its boundaries in the overlaps with the chunk before and the one behind."""
    tok = bytebpe.segments(spec, plain=False).tok
    lengths = bytebpe.byte_lengths(tok)
    margin = LOOK_AHEAD + max([len(t.content.encode()) for t in tok.get_added_tokens_decoder().values()], default=0)
    for batch in batches:
        for row in batch.to_pylist():
            core, tail = row["core"], row["tail"]
            at, n = boundaries(tok, lengths, (core + tail).decode())
            head = at <= overlap + 3  # a cut is up to three bytes behind its place
            proven = len(core) + len(tail) - (0 if row["ends"] else margin)
            seam = (at >= len(core)) & (at <= proven) & bool(tail)
            yield pa.RecordBatch.from_pylist([{
                "key": row["key"], "part": row["part"], "n_tokens": int(n[-1]), "head_at": at[head].tolist(), "head_n": n[head].tolist(),
                "tail_at": (at[seam] - len(core)).tolist(), "tail_n": n[seam].tolist()}], schema=_splice_schema())


def _splice_schema() -> pa.Schema:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.schema([("key", pa.string()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("head_at", ints), ("head_n", longs), ("tail_at", ints),
                      ("tail_n", longs)])


def _spliced(parts: DataFrame, file, overlap: int) -> DataFrame:
    """(key, n_tokens) of the documents whose chunks are ``parts``."""
    done = None
    while True:
        n = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
        ends = staged(parts.repartition(int(n), "key", "part").mapInArrow(lambda it: _encoded(it, file.value, overlap), _SPLICE), "token-ends")
        right = ends.select("key", (F.col("part") - 1).alias("part"), F.col("head_at").alias("to_at"), F.col("head_n").alias("to_n"))
        place = F.array_min(F.array_intersect("tail_at", "to_at"))
        seam = (ends.join(right, ["key", "part"], "left").withColumn("at", place)
                .select("key", "part", F.col("to_at").isNull().alias("is_last"), "at", "n_tokens",
                        F.expr("tail_n[array_position(tail_at, at) - 1] - to_n[array_position(to_at, at) - 1]").alias("gain")))
        seam = staged(seam, "token-seams")
        total = seam.groupBy("key").agg(F.sum(F.when(F.col("is_last"), F.col("n_tokens")).otherwise(F.col("gain"))).alias("n_tokens"),
                                        F.max((~F.col("is_last") & F.col("at").isNull()).cast("int")).alias("failed"))
        good = total.where("failed = 0").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        again = total.where("failed = 1").select("key")
        if again.isEmpty():
            return done
        # a chunk whose seam to the one before it failed joins that one; a document has at most 2 GB / chunk of them
        joins = seam.where("NOT is_last AND at IS NULL").select("key", (F.col("part") + 1).alias("part"), F.lit(0).alias("fresh"))
        run = Window.partitionBy("key").orderBy("part")
        marked = (parts.join(again, "key").select("key", "part").join(joins, ["key", "part"], "left")
                  .select("key", "part", (F.sum(F.coalesce("fresh", F.lit(1))).over(run) - 1).cast("int").alias("into")))
        parts = staged(parts.join(marked, ["key", "part"]).groupBy("key", "into").applyInArrow(_joined, _PARTS), "token-chunks")


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring chunks as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    last = rows[-1]
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("core", pa.binary()), ("tail", pa.binary()), ("ends", pa.bool_())])
    return pa.Table.from_pylist([{"key": last["key"], "part": last["into"], "core": b"".join(r["core"] for r in rows), "tail": last["tail"],
                                  "ends": last["ends"]}], schema=schema)
