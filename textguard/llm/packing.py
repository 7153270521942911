"""Operator 9 - token ids in packed matrices: best-fit decreasing with a segment tree.

Each document becomes token ids and an end mark. A document longer than a row is cut into whole
rows and a rest, in order, so nothing is lost. Inside a task the pieces of one pool at a time
are packed longest first, each into the open row whose free space is least but sufficient; a
segment tree over the free spaces 0..row length finds that row in log(row length) steps.

A packed row has its ids (little-endian, padded), the cumulative lengths of its segments, the
columns at which positions restart, and for each segment its document, its piece number and its
first position in the document. ``unpack`` restores every document.

Defined results: null or empty text is a lone end mark; special-token strings in a text are
ordinary text; repeated rows and null doc_ids are packed like others; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_TOKENS = 2048
#: A pool, the pieces packed together, is closed at so many tokens.
POOL_TOKENS = 4 << 20
#: Code points handed to the tokenizer at once; longer texts go in parts cut after white space where there is some.
PART_CHARS = 1 << 20


class FreeSpace:
    """Open rows by free space; ``fit`` finds the least free space of at least a given size."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        i = space + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i //= 2

    def fit(self, need: int) -> int | None:
        """Take a row out whose free space is the least of at least ``need``."""
        i = need + self.size
        if not self.any[i]:
            while True:  # up to the first right neighbour that holds a row
                if i == 1:
                    return None
                if i % 2 == 0 and self.any[i + 1]:
                    i += 1
                    break
                i //= 2
            while i < self.size:  # down to its leftmost leaf
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        space = i - self.size
        row = self.rows[space].pop()
        if not self.rows[space]:
            self.any[i] = 0
            i //= 2
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i //= 2
        return row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row; every length is between 1 and ``capacity``."""
    rows: list[list[int]] = []
    free, space = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        r = free.fit(lengths[i])
        if r is None:
            r = len(rows)
            rows.append([])
            space.append(capacity)
        rows[r].append(i)
        space[r] -= lengths[i]
        if space[r]:
            free.add(space[r], r)
    return rows


_encoders: dict[int, object] = {}


def encoder(raw: bytes):
    """The tokenizer of a vocabulary file's content, made once per worker."""
    key = hash(raw)
    if key not in _encoders:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_ids(enc, text: str) -> np.ndarray:
    """Ids of a text; the parts of a very long one join to the same text."""
    out, at = [], 0
    while at < len(text):
        end = at + PART_CHARS
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.int64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


OUT = ("pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, "
       "first_positions array<int>")


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, pool_tokens: int = POOL_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text); columns see OUT."""
    with open(vocabulary, "rb") as f:  # 50 thousand entries whatever the corpus
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(pool: list[tuple[int | None, int, np.ndarray]], first_id: int, dtype: str, pad: int) -> pa.RecordBatch:
        packs = best_fit_decreasing([len(x) for _, _, x in pool], row_tokens)
        cols: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
        for r, members in enumerate(packs):
            ids = np.full(row_tokens, pad, dtype)
            ends = np.cumsum([len(pool[i][2]) for i in members])
            ids[:ends[-1]] = np.concatenate([pool[i][2] for i in members])
            starts = [0, *ends[:-1].tolist()]
            for k, v in zip(cols, (first_id + r, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], starts, [pool[i][0] for i in members],
                                   [pool[i][1] for i in members], [pool[i][1] * row_tokens for i in members])):
                cols[k].append(v)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        end = enc.max_token_value + 1
        dtype = "<u2" if end < 1 << 16 else "<u4"
        next_id, pool, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(token_ids(enc, text.as_py() or ""), end).astype(dtype)
                for k in range(0, len(ids), row_tokens):
                    pool.append((doc, k // row_tokens, ids[k:k + row_tokens]))
                    held += len(pool[-1][2])
                    if held >= pool_tokens:
                        got = rows(pool, next_id, dtype, end)
                        yield got
                        next_id, pool, held = next_id + got.num_rows, [], 0
        if pool:
            yield rows(pool, next_id, dtype, end)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def position_ids(cu_seqlens: list[int], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Positions of a row's tokens, restarting with each segment; padding is 0."""
    out = np.zeros(row_tokens, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
