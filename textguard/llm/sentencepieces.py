"""Operator 5 - SentencePiece encoding and decoding by a batched numpy Viterbi.

The vocabulary's pieces form a unigram model: a piece of rank r among the ordinary pieces has the
Zipf log-probability -log((r + 2.7) H), since the file's own scores are ranks of merges and no
probabilities. The best segmentation of a text is the sequence of pieces of greatest sum; bytes
that no piece covers become byte pieces at a score below all others.

A text is split at places that no piece can cross (before a word's space, around bytes that
stand in no longer piece), so the parts' optima make up the text's. The distinct parts of a batch
are grouped by length and all parts of a group advance together, one byte per step: hashes of
all substrings probe the sorted hashes of the pieces, and one vectorised maximum per step
stores the back-pointers of the whole group.

Spaces are the pieces' word mark, and a text gets one in front; a literal word mark in a text is
encoded by byte pieces, so decoding restores every text exactly.

Defined results: null and empty text have no tokens and decode to the empty text; special-piece
names in a text are ordinary text; repeated rows and null doc_ids are encoded like others; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import prefix_hash, range_hash, slices, small_batches, utf8, word_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text encoded together; cells (word, end, piece length) held at once.
BATCH_BYTES, CELLS = 1 << 20, 1 << 19
BYTE_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays, small enough to send to every task."""
    keys: np.ndarray      # sorted hashes of the ordinary pieces' bytes, the word mark as a space
    ids: np.ndarray       # their ids
    scores: np.ndarray    # their log-probabilities, and -inf at the end for no piece
    lengths: np.ndarray   # the piece lengths that occur, ascending
    seen: np.ndarray      # table by the low bits of the hashes that occur, to skip most probes
    byte_ids: np.ndarray  # id of each byte piece
    byte_score: float
    solo: np.ndarray      # bytes that stand in no piece of several bytes
    text: np.ndarray      # the bytes of all pieces, one after the other by id
    bounds: np.ndarray


def load(model: str = MODEL) -> Pieces:
    """Read a SentencePiece model file with byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    raw, byte_ids, ordinary = [], np.zeros(256, np.int32), []
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(name[3:5], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            b = name.replace(MARK, " ").encode()
            raw.append(b)
            if b" " not in b.lstrip(b" "):  # a piece over a word's end would cross the splits
                ordinary.append((i, b))
    ranks = np.arange(len(ordinary), dtype=float)
    weight = 1 / (ranks + 2.7)
    score = np.log(weight / weight.sum())
    lens = np.array([len(b) for _, b in ordinary])
    joined = np.frombuffer(b"".join(b for _, b in ordinary), np.uint8)
    end = np.cumsum(lens)
    key = range_hash(prefix_hash(joined), end - lens, end)
    order = np.argsort(key)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[key & np.uint64((1 << 20) - 1)] = True
    solo = np.ones(256, dtype=bool)
    for _, b in ordinary:
        if len(b) > 1:
            solo[list(b)] = False
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    return Pieces(key[order], np.array([i for i, _ in ordinary], np.int32)[order], np.append(score[order], -np.inf), np.unique(lens), seen,
                  byte_ids, float(score.min() - BYTE_PENALTY), solo, np.frombuffer(b"".join(raw), np.uint8), bounds)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - count), count)


def _probe(v: Pieces, p: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Index of the piece with the bytes [start, start + length), or -1."""
    h = range_hash(p, start, start + length)
    out = np.full(len(h), -1, np.int32)
    maybe = np.flatnonzero(v.seen[h & np.uint64((1 << 20) - 1)])
    at = np.searchsorted(v.keys, h[maybe])
    at[at == len(v.keys)] = 0
    hit = v.keys[at] == h[maybe]
    out[maybe[hit]] = at[hit]
    return out


def viterbi(v: Pieces, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per word, ids of all words one after the other) for equal-length words, one per row of bytes."""
    n, size = words.shape
    lengths = v.lengths[v.lengths <= size]
    longest = int(lengths[-1])
    p = prefix_hash(words.ravel())
    row = np.arange(n) * size
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int16)   # length of the last piece
    piece = np.zeros((n, size + 1), np.int32)  # its id
    block = max(1, CELLS // (n * longest))
    for lo in range(1, size + 1, block):
        ends = np.arange(lo, min(lo + block, size + 1))
        found = np.full((n, len(ends), len(lengths)), -1, np.int32)
        for k, width in enumerate(lengths.tolist()):
            e = ends[ends >= width]
            if len(e):
                found[:, len(ends) - len(e):, k] = _probe(v, p, (row[:, None] + e - width).ravel(), width).reshape(n, len(e))
        for c, e in enumerate(ends.tolist()):
            m = int(np.searchsorted(lengths, e, "right"))
            total = best[:, e - lengths[:m]] + v.scores[found[:, c, :m]]
            k = total.argmax(axis=1)
            top = total[np.arange(n), k]
            byte = best[:, e - 1] + v.byte_score
            use = byte > top
            best[:, e] = np.where(use, byte, top)
            back[:, e] = np.where(use, 1, lengths[k])
            piece[:, e] = np.where(use, v.byte_ids[words[:, e - 1]], v.ids[found[np.arange(n), c, k]])
    count = np.zeros(n, np.int64)
    steps = []
    at, live = np.full(n, size), np.arange(n)
    while len(live):  # from the ends back, one token of every unfinished word at a time
        steps.append((live, piece[live, at[live]]))
        count[live] += 1
        at[live] -= back[live, at[live]]
        live = live[at[live] > 0]
    last = np.cumsum(count) - 1
    out = np.zeros(int(count.sum()), np.int32)
    for k, (rows, got) in enumerate(steps):
        out[last[rows] - k] = got
    return count, out


def encode(v: Pieces, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per text, ids of all texts one after the other) of the texts data[bounds[i]:bounds[i + 1]]."""
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    tokens = np.zeros(len(size), np.int64)
    if not len(full):
        return tokens, np.zeros(0, np.int32)
    # every text gets a space in front
    begin = bounds[full] + np.arange(len(full))
    buf = np.full(len(data) + len(full), 32, np.uint8)
    body = np.ones(len(buf), dtype=bool)
    body[begin] = False
    buf[body] = data[bounds[0]:bounds[-1]]
    space, solo = buf == 32, v.solo[buf]
    cut = solo | space
    cut[1:] &= ~(space[1:] & space[:-1])  # a run of spaces stays whole
    cut[1:] |= solo[:-1]
    cut[begin] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(buf)))
    key = word_hash(buf, start, start + length)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    w_start, w_len = start[first], length[first]
    w_count, w_at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    chunks, done = [], 0
    for size_ in np.unique(w_len).tolist():
        of = np.flatnonzero(w_len == size_)
        step = max(1, CELLS // (size_ * min(size_, int(v.lengths[-1]))))
        for a in range(0, len(of), step):
            some = of[a:a + step]
            words = buf[w_start[some][:, None] + np.arange(size_)]
            count, ids = viterbi(v, words)
            w_count[some] = count
            w_at[some] = done + np.cumsum(count) - count
            chunks.append(ids)
            done += len(ids)
    pool = np.concatenate(chunks)
    per_word = w_count[which]
    ids = pool[ragged(w_at[which], per_word)]
    text_of = np.searchsorted(begin, start, "right") - 1
    tokens[full] = np.bincount(text_of, weights=per_word, minlength=len(full)).astype(np.int64)
    return tokens, ids


def decode(v: Pieces, tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts with the given tokens."""
    n = v.bounds[ids + 1] - v.bounds[ids]
    raw = v.text[ragged(v.bounds[ids], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(tokens)])]
    front = ends[:-1][tokens > 0]  # the space in front of every text
    keep = np.ones(len(raw), dtype=bool)
    keep[front] = False
    return raw[keep], ends - np.concatenate([[0], np.cumsum(tokens > 0)])


def _run(vocabulary, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        lowest, highest = int(v.byte_ids.min()), int(v.byte_ids.max())
        for b in batches:
            data, bounds = utf8(b.column(1))
            for i, j in slices(bounds, BATCH_BYTES):
                part, local = data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
                tokens, ids = encode(v, part, local)
                off = np.concatenate([[0], np.cumsum(tokens)])
                falls = np.concatenate([[0], np.cumsum((ids >= lowest) & (ids <= highest))])
                raw, back = decode(v, tokens, ids)
                same = np.diff(back) == np.diff(local)
                if len(raw) == len(part) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(raw != part)])
                    same = wrong[local[1:]] == wrong[local[:-1]]
                else:
                    same = np.array([bytes(raw[a:z]) == bytes(part[c:d]) for a, z, c, d in zip(back, back[1:], local, local[1:])])
                cols = [b.column(0).slice(i, j - i), pa.array(tokens), pa.array(falls[off[1:]] - falls[off[:-1]]), pa.array(same),
                        pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))]
                names = ["doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids"]
                if decoded:
                    cols.append(pa.array([bytes(raw[a:z]).decode() for a, z in zip(back, back[1:])], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def tokenize(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, round_trip, ids (and the decoded text) for every row of ``docs`` (doc_id, text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    out = "doc_id long, n_tokens long, n_byte_tokens long, round_trip boolean, ids array<int>" + ", decoded string" * decoded
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(vocabulary, decoded), out)
