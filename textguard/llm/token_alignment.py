"""Operator 13 - alignment of two tokenizers over the same bytes by merge-path partitioning.

A is a byte-level BPE file, B a sentencepiece model. Both cut the same bytes (a space and the text), so
each gives a rising list of end offsets. Merging the two lists gives everything: a step to a
new offset is one overlap of an A and a B token (a link), an offset in both lists closes a
group. The texts of a chunk are laid end to end and their lists are merged in pieces:

* diagonals at equal distances cut the merge path into pieces of equal work; where each crosses
  the path is found by binary searches, all diagonals at once (``merge_path``);
* a piece reads only its own stretches of the lists and emits its links, and marks those that
  close a group (``overlaps``); an offset in both lists is never divided between two pieces;
* the pieces' links are joined in order, which stitches groups that reach over a border: a group
  ends at a mark, in whichever piece that is.

Corpus-wide counts (in how many documents an id pair is linked) take two passes. A task writes its
documents in blocks: the distinct pairs of a block with the number of its documents that hold each, and for
every document places in that list. Pairs are then summed over blocks, each block gets the counts
of its own pairs back, and its documents look theirs up. So a pair that every document holds
is one row a block, not one a document; nothing of the corpus passes through one task or the driver.

Defined results: texts that are null or empty, or whose joined A or B bytes are not space + text, have no
tokens: zeros and an empty groups_sha256. Repeated rows and rows with a null doc_id count as documents
of their own; other columns are ignored; an empty table gives no rows. Special strings inside
texts are plain text. One document is encoded and held whole by one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import bytebpe
from textguard.llm.common import small_batches, staged

#: Steps of a piece of the merge path, bytes of text merged at once, bytes of text of a block.
PIECE, CHUNK, BLOCK = 1 << 16, 1 << 20, 1 << 24

#: Segments that a worker remembers for both tokenizers, and their ids, the longer segments' included.
REMEMBER, REMEMBER_IDS = 600_000, 16_000_000

_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders (i, j) of pieces of about ``piece`` steps in the merge of two rising lists, both ends included:
    a[:i] and b[:j] are the least i + j values, and equal values stay together."""
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        first = a[mid] <= b[d[busy] - mid - 1]
        low[busy] = np.where(first, mid + 1, low[busy])
        high[busy] = np.where(first, high[busy], mid)
    i, j = low, d - low
    tied = np.flatnonzero((i > 0) & (j < m))
    j[tied] += a[i[tied] - 1] == b[j[tied]]
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one piece: the A token and B token of every step to a new offset, and whether it closes a group."""
    pa_, pb = a[i[0]:i[1]], b[j[0]:j[1]]
    ends = np.concatenate([pa_, pb])
    ends.sort(kind="stable")
    if len(ends):
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
    x, y = np.searchsorted(pa_, ends), np.searchsorted(pb, ends)
    both = np.zeros(len(ends), bool)
    inside = np.flatnonzero((x < len(pa_)) & (y < len(pb)))
    both[inside] = pa_[x[inside]] == pb[y[inside]]
    return i[0] + x, j[0] + y, both


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two lists of ends of the same bytes: A token, B token, closes a group."""
    i, j = merge_path(a, b, piece)
    parts = [overlaps(a, b, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(i) - 1)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Ids:
    """Lists of ids, end to end in one growing array."""

    def __init__(self):
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32)

    def add(self, ids: np.ndarray, n: np.ndarray):
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        end = int(self.start[-1])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end - len(self.ids), len(self.ids)), np.int32)])
        self.ids[end - len(ids):end] = ids

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these lists, number of ids of each)."""
        n = self.start[at + 1] - self.start[at]
        total = np.append(0, np.cumsum(n))
        return self.ids[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])].astype(np.int64), n


class Numbers(dict):
    """Numbers of segments; one that is not known gets the next number and is listed as new."""

    known, new = 0, ()

    def __missing__(self, segment: str) -> int:
        n = self[segment] = self.known + len(self.new)
        self.new.append(segment)
        return n


class Pieces:
    """Ids of segments by A and by a sentencepiece model that ``splits_at_space``, with whether the bytes of both are the segment's own.

    A segment is a run of white space and the run of other characters after it. Where the model has pieces with a white space behind another
    character (";\\r"), runs that begin with that white space do not begin a segment. Texts begin with a space, and the first space of a
    segment is the one that the model adds. A worker that remembers too many segments goes on with those that it met more than once.
    """

    def __init__(self, spec: bytes, model):
        self.tok, self.model = bytebpe.tokenizer(spec, plain=True), model
        self.a_bytes, self.b_bytes = _a_bytes(self.tok), _b_bytes(model)
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.space = [model.piece_to_id("▁")]
        white = bytebpe.SPACE
        inner = set(re.findall(f"[{white}]", "".join(model.id_to_piece(i)[1:] for i in range(model.get_piece_size()))))
        more = f"(?:[{''.join(map(re.escape, sorted(inner)))}][{white}]*[^{white}]*)*" if inner else ""
        self.pattern = re.compile(f"[{white}]*[^{white}]+{more}|[{white}]+")
        self._clear()

    def _clear(self):
        self.index, self.a, self.b = Numbers(), Ids(), Ids()
        self.sound, self.again = np.zeros(0, bool), np.zeros(0, bool)

    def _renew(self):
        again = self.again.tolist()
        kept = {w: i for w, i in self.index.items() if again[i]}
        at = np.fromiter(kept.values(), np.int64, len(kept))
        (a, na), (b, nb), sound = self.a.of(at), self.b.of(at), self.sound[at]
        self._clear()
        if 4 * len(kept) <= 3 * REMEMBER and 2 * (len(a) + len(b)) <= REMEMBER_IDS:
            self.a.add(a, na)
            self.b.add(b, nb)
            self.index.update(zip(kept, range(len(kept))))
            self.sound, self.again = sound, np.zeros(len(kept), bool)

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each segment of the texts, number of segments of each text); valid until the next call."""
        if len(self.index) > REMEMBER or self.a.start[-1] + self.b.start[-1] > REMEMBER_IDS:
            self._renew()
        words = [self.pattern.findall(t) for t in texts]
        each = np.fromiter(map(len, words), np.int64, len(words))
        index = self.index
        index.known, index.new = len(self.sound), []
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(each.sum()))
        self.again[at[at < index.known]] = True
        for s in range(0, len(index.new), 4096):
            self._add(index.new[s:s + 4096])
        # a text that is all one segment may be huge: such segments are not remembered after this call
        for w in index.new:
            if len(w) > bytebpe.LONGEST:
                del index[w]
        return at, each

    def _add(self, words: list[str]):
        own = [w.encode() for w in words]
        size = np.fromiter(map(len, own), np.int64, len(own))
        a, na = self._a_ids(words, size)
        lists = self.model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        lists = [x if w[0] == " " and len(w) > 1 else self.space if w == " " else x[1:] for w, x in zip(words, lists)]
        b, nb = _flat(lists)
        same = np.ones(len(words), bool)
        for ids, n, long, of in ((a, na, self.a_len, self.a_bytes), (b, nb, self.b_len, self.b_bytes)):
            flat = ids.tolist()
            if not (np.array_equal(_sums(long[ids], n), size) and b"".join(map(of.__getitem__, flat)) == b"".join(own)):
                end = np.cumsum(n).tolist()
                same &= np.fromiter((b"".join(map(of.__getitem__, flat[s:e])) == w for w, s, e in zip(own, [0, *end], end)), bool, len(own))
        self.a.add(a, na)
        self.b.add(b, nb)
        self.sound, self.again = np.append(self.sound, same), np.append(self.again, np.zeros(len(words), bool))

    def _a_ids(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of the segments, many short ones laid end to end in one text: its tokens are theirs in order, and divided by their bytes."""
        laid = []
        for s in range(0, len(words), 256):
            part = words[s:s + 256]
            laid += part if any(len(w) > bytebpe.LONGEST or w[-1].isspace() for w in part) else ["".join(part)]
        ids, _ = _flat([e.ids for e in self.tok.encode_batch_fast(laid, add_special_tokens=False)])
        total, end = np.cumsum(self.a_len[ids]), np.cumsum(size)
        last = np.searchsorted(total, end)
        if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(total[last], end):
            return ids, np.diff(last, prepend=-1)
        return _flat([e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)])


def splits_at_space(spec: bytes) -> bool:
    """Whether a sentencepiece file is BPE on unchanged text with a space before it and no piece has a space behind another character,
    so that merges stay inside a segment and segments can be encoded one by one."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(spec)
    n, t, pieces = m.normalizer_spec, m.trainer_spec, [p.piece for p in m.pieces]
    return (t.model_type == pb.TrainerSpec.BPE and not t.treat_whitespace_as_suffix and not n.precompiled_charsmap and n.add_dummy_prefix
            and not n.remove_extra_whitespaces and n.escape_whitespaces and "▁" in pieces and not any(re.search("[^▁]▁| ", p) for p in pieces))


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_spec: bytes, b_spec: bytes):
        import sentencepiece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_spec)
        self.pieces = Pieces(a_spec, self.b) if splits_at_space(b_spec) else None
        self.a = None if self.pieces else bytebpe.segments(a_spec, plain=True)
        self.a_bytes, self.b_bytes = (self.pieces.a_bytes, self.pieces.b_bytes) if self.pieces else (_a_bytes(self.a.tok), _b_bytes(self.b))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.written = {s: np.array([b"%d%s" % (i, s) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]) for s in (b",", b"|", b";")}
        self.width = np.array([len(x) for x in self.written[b","].tolist()], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A ids of each text, B ids, B ids of each text); none for texts whose bytes do not come back."""
        spaced = [" " + t if t else "" for t in texts]
        if self.pieces:
            at, each = self.pieces.look(spaced)
            (a, na), (b, nb) = self.pieces.a.of(at), self.pieces.b.of(at)
            na, nb = _sums(na, each), _sums(nb, each)
            if self.pieces.sound[at].all():
                return a, na, b, nb
        else:
            a, na = self.a.tokens(spaced)
            a = a.astype(np.int64)
            b, nb = _flat(self.b.encode(texts, num_threads=1))
        whole = b"".join(t.encode() for t in spaced)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            size = np.array([len(t.encode()) for t in spaced], np.int64)
            if np.array_equal(size, _sums(self.a_len[a], na)) and np.array_equal(size, _sums(self.b_len[b], nb)):
                return a, na, b, nb
        keep = np.ones(len(texts), bool)
        for k, (x, y) in enumerate(zip(np.split(a, np.cumsum(na)[:-1]), np.split(b, np.cumsum(nb)[:-1]))):
            want = spaced[k].encode()
            keep[k] = (b"".join(map(self.a_bytes.__getitem__, x.tolist())) == want == b"".join(map(self.b_bytes.__getitem__, y.tolist())))
        return a[np.repeat(keep, na)], na * keep, b[np.repeat(keep, nb)], nb * keep


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _sums(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    end = np.cumsum(each)
    return total[end] - total[end - each]


def _a_bytes(tok) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    vocab = tok.get_vocab(True)
    out = [b""] * (max(vocab.values()) + 1)
    for s, i in tok.get_vocab(False).items():
        out[i] = bytes(of[c] for c in s)
    for i, t in tok.get_added_tokens_decoder().items():
        out[i] = t.content.encode()
    return out


def _b_bytes(model) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, <0xHH> the byte HH."""
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def _aligned(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
    """Columns of the texts' rows; the distinct (text, id pair) keys of their links, sorted, and the links of each key."""
    a, na, b, nb = pair.encode(texts)
    x, y, closes = merged(np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b]))
    a_end, b_end = np.cumsum(na), np.cumsum(nb)
    text_of = np.searchsorted(a_end, x, "right")
    n_links = np.bincount(text_of, minlength=len(texts))
    n_groups = np.bincount(text_of[closes], minlength=len(texts))
    # the ids in the order of the groups, A before B, each with the mark behind it
    last_a, last_b = x[closes], y[closes]
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    at_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
    at_b = np.arange(len(b)) + (last_a + 1)[group_b]
    shown = np.zeros(len(a) + len(b), pair.written[b","].dtype)
    width = np.zeros(len(a) + len(b), np.int64)
    shown[at_a], shown[at_b] = pair.written[b","][a], pair.written[b","][b]
    width[at_a], width[at_b] = pair.width[a], pair.width[b]
    shown[at_a[last_a]], shown[at_b[last_b]] = pair.written[b"|"][a[last_a]], pair.written[b";"][b[last_b]]
    flat = shown.tobytes().translate(None, b"\0")
    stop = np.append(0, np.cumsum(width))[a_end + b_end].tolist()
    sha, begin = [], 0
    for e in stop:
        sha.append(hashlib.sha256(flat[begin:e - 1]).hexdigest() if e > begin else "")
        begin = e
    keys, links = np.unique((text_of * len(pair.a_bytes) + a[x]) * len(pair.b_bytes) + b[y], return_counts=True)
    return {"n_a": na, "n_b": nb, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha}, keys, links


def align(docs: DataFrame, a_file: str, b_file: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row for every row of ``docs``: counts of tokens, groups and links, the groups' digest, and the links' corpus-wide counts."""
    with open(a_file, "rb") as fa, open(b_file, "rb") as fb:
        specs = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))  # two vocabulary files, a few MB
    pick = small_batches(docs).select("doc_id", "text")
    doc_id = pick.schema["doc_id"].dataType.simpleString()
    blocks = staged(pick.mapInArrow(lambda it: _blocks(it, *specs.value, chunk, block),
                                    f"block string, doc_id {doc_id}, {_DOC}, pairs binary, counts binary, is_doc boolean"), "alignment")
    held = staged(blocks.where("NOT is_doc").select("block", "pairs", "counts").mapInArrow(_pairs, "block string, pair bigint, a_id bigint, n bigint"),
                  "alignment-pairs")
    count = staged(held.groupBy("pair", "a_id").agg(F.sum("n").alias("n_docs")), "alignment-counts")
    most = count.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # at most one row for each id of A
    ranked = count.join(F.broadcast(most), "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    back = held.select("block", "pair").join(ranked, "pair").select("block", "pair", "n_docs", "best")
    rows = blocks.where("is_doc").drop("is_doc")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "block"]
    both = (rows.withColumns({"pair": F.lit(None).cast("bigint"), "n_docs": F.lit(None).cast("bigint"), "best": F.lit(None).cast("boolean")})
            .unionByName(back.select("block", *none, "pair", "n_docs", "best")))
    # the pairs of a block stand before its documents, in the order of its list
    ordered = (both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
               .sortWithinPartitions("block", F.col("pair").asc_nulls_last()))
    return ordered.mapInArrow(_counted, f"doc_id {doc_id}, {_DOC}, n_best bigint, count_sum bigint").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_pair: dict[str, Pair] = {}


def _blocks(batches: Iterator[pa.RecordBatch], a_spec: bytes, b_spec: bytes, chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    key = hashlib.sha256(a_spec + b_spec).hexdigest()
    if key not in _pair:
        _pair[key] = Pair(a_spec, b_spec)
    pair = _pair[key]
    done: list[tuple] = []
    size = 0
    ids_type = None
    for batch in batches:
        ids_type = batch.schema.field(0).type
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and (n == 0 or n + len(texts[stop]) <= chunk):
                n += len(texts[stop])
                stop += 1
            done.append((batch.column(0).slice(at, stop - at), *_aligned(pair, texts[at:stop])))
            size, at = size + n, stop
            if size >= block:
                yield from _block(pair, done, ids_type)
                done, size = [], 0
    if done:
        yield from _block(pair, done, ids_type)


def _block(pair: Pair, done: list[tuple], ids_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The block's list of pairs, then its documents with places in that list (differences) and links at each."""
    wide = len(pair.a_bytes) * len(pair.b_bytes)
    pairs, n = np.unique(np.concatenate([keys % wide for _, _, keys, _ in done]), return_counts=True)
    block = uuid.uuid4().hex
    a_id = pairs // len(pair.b_bytes)
    for s in range(0, len(pairs), 1 << 16):
        e = slice(s, s + (1 << 16))
        yield _batch(block, pa.nulls(1, ids_type), None, [np.stack([pairs[e], a_id[e]]).tobytes()], [n[e].tobytes()])
    for ids, cols, keys, links in done:
        cut = np.searchsorted(keys, np.arange(len(ids) + 1) * wide).tolist()
        place = np.searchsorted(pairs, keys % wide)
        step = np.diff(place, prepend=0)
        first = np.array(cut[:-1])[np.diff(cut) > 0]
        step[first] = place[first]
        step, links = step.astype(np.uint32), links.astype(np.uint32)
        for s in range(0, len(ids), 256):
            e = min(s + 256, len(ids))
            yield _batch(block, ids.slice(s, e - s), {k: v[s:e] for k, v in cols.items()},
                         [step[cut[i]:cut[i + 1]].tobytes() for i in range(s, e)], [links[cut[i]:cut[i + 1]].tobytes() for i in range(s, e)])


def _batch(block: str, ids: pa.Array, cols: dict | None, pairs: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    types = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
    middle = [pa.array(cols[k], t) if cols else pa.nulls(1, t) for k, t in types.items()]
    m = len(ids)
    return pa.RecordBatch.from_arrays([pa.array([block] * m), ids, *middle, pa.array(pairs, pa.binary()), pa.array(counts, pa.binary()),
                                       pa.array([cols is not None] * m)],
                                      names=["block", "doc_id", *types, "pairs", "counts", "is_doc"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pair, a_id = np.frombuffer(row["pairs"], np.int64).reshape(2, -1)
            n = np.frombuffer(row["counts"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(n)), pa.array(pair), pa.array(a_id), pa.array(n)],
                                             names=["block", "pair", "a_id", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the counts of their block's pairs, which come right before them."""
    block, lists, n_docs, best = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        names = np.array(batch.column("block").to_pylist(), object)
        edge = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
        for s, e in zip(edge, [*edge[1:], len(names)]):
            part = batch.slice(s, e - s)
            if names[s] != block:
                block, lists, n_docs, best = names[s], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            m = part.num_rows - part.column("pair").null_count
            if m:
                lists.append((part.column("n_docs").slice(0, m).to_numpy(), part.column("best").slice(0, m).to_numpy(zero_copy_only=False)))
            if m == part.num_rows:
                continue
            if lists:
                n_docs, best = (np.concatenate([np.asarray(x[k], np.int64) for x in lists]) for k in (0, 1))
                lists = [(n_docs, best)]
            docs = part.slice(m)
            sums, tops = [], []
            for step, links in zip(docs.column("pairs").to_pylist(), docs.column("counts").to_pylist()):
                place, each = np.cumsum(np.frombuffer(step, np.uint32), dtype=np.int64), np.frombuffer(links, np.uint32).astype(np.int64)
                sums.append(int((n_docs[place] * each).sum()))
                tops.append(int((best[place] * each).sum()))
            cols = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tops, pa.int64()), pa.array(sums, pa.int64())],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])
