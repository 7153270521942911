"""Operator 7 - removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

Which suffixes are sorted: each window of ``length`` bytes names its least ``GRAM``-byte
substring (by hash, leftmost on ties). That place is a function of the window's bytes, so two
equal windows name the same place in their text. Only suffixes at named places are sorted,
about one in seventy, and only those whose gram occurs more than once. A suffix carries the
bytes before it that its windows reach (its left side).

1. Texts are packed into batches, written once to a table bucketed by batch, so later joins by
   batch move the small side only.
2. Grams are counted over all batches.
3. Each batch sorts its suffixes (equal ones become one row) and writes them as a front-coded
   run, cut at the splitters: shared prefix length, rest, left side. The splitters are quantiles of
   the repeated suffixes' first eight bytes over all batches, one for each range; where one beginning
   fills m ranges, its suffixes are dealt to m ranges by a checksum of their first ``GRAM`` bytes,
   which equal windows share.
4. A task per range merges the runs with a loser tree that keeps every contender's common
   prefix with the last winner: contenders with different lengths are ordered without looking
   at their bytes, equal ones are compared from that length on. The order's prefix lengths, and
   those of the left sides sorted backwards, say exactly which windows are equal.
5. The spans go back to their batch, which cuts its texts.

A gram that stands in more than ``hot_rows`` batches is not merged as one group: its windows
are sorted as whole strings, so equal ones meet as one row per batch and different ones part.

Defined results: null text is empty; texts under ``length`` bytes keep all bytes; repeated
rows are separate documents (each repeats the other); a null doc_id is returned as null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import prefix_hash, range_hash, shared_dir, small_batches, staged, utf8

GRAM = 64
#: Low bits of a sort key hold the place, so ties go left; no Spark value is longer.
_PLACE = np.uint64((1 << 31) - 1)
BATCH_BYTES = 2 << 20
RANGE_BYTES = 16 << 20
#: One in so many named places of every batch tells its first bytes; the splitters are quantiles of those that repeat.
HEAD_SHARE = 16
HOT_ROWS = 20_000

_BATCH = pa.schema([("b", pa.int64()), ("blob", pa.binary())])


# --- batches -----------------------------------------------------------------------------

def _pack(limit: int):
    def blob(part: list[pa.RecordBatch]) -> bytes:
        t = pa.Table.from_batches(part).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, part, held = TaskContext.get().partitionId() << 32, [], 0
        for rb in batches:
            _, bounds = utf8(rb.column(1))
            at = 0
            while at < rb.num_rows:
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit - held, "right")) - 1)
                part.append(rb.slice(at, end - at))
                held += int(bounds[end] - bounds[at])
                at = end
                if held >= limit or at < rb.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob(part)], pa.binary())], schema=_BATCH)
                    b, part, held = b + 1, [], 0
        if part:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob(part)], pa.binary())], schema=_BATCH)
    return run


def _unpack(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_id, bytes, bounds) of a batch."""
    t = pa.ipc.open_stream(raw).read_all().combine_chunks()
    data, bounds = utf8(t.column(1))
    ids = t.column(0)
    return (ids.chunk(0) if ids.num_chunks else pa.array([], pa.int64())), data, bounds


# --- named places --------------------------------------------------------------------------

def places(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, first window, last window) of the places that windows of ``length`` bytes name."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    p, n = prefix_hash(data), len(data)
    at = np.arange(n - GRAM + 1)
    gram = range_hash(p, at, at + GRAM)
    key = (gram & ~_PLACE) | at.astype(np.uint64)
    span, got = length - GRAM + 1, 1
    while 2 * got <= span:
        key = np.minimum(key[:-got], key[got:])
        got *= 2
    if got < span:
        key = np.minimum(key[:len(key) - (span - got)], key[span - got:])
    ok = np.zeros(n - length + 1, dtype=bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= length:
            ok[a:b - length + 1] = True
    start = np.flatnonzero(ok)
    if not len(start):
        return none, np.zeros(0, np.uint64), none, none
    place = (key[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    place = place[first]
    return place, gram[place], start[first], start[last]


def _grams(length: int):
    schema = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("many", pa.bool_()), ("head", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for b, blob in zip(rb.column(0).to_pylist(), rb.column(1)):
                _, data, bounds = _unpack(blob.as_py())
                place, gram, _, _ = places(data, bounds, length)
                g, at, n = np.unique(gram, return_index=True, return_counts=True)
                head = pa.array((_head(data, place[at]) >> np.uint64(1)).astype(np.int64), mask=(np.arange(len(g)) + b) % HEAD_SHARE != 0)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), b)), pa.array(n > 1), head], schema=schema)
    return run


def _head(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes from each place as one big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


def _splitters(hits: DataFrame, ranges: int) -> np.ndarray:
    """Up to ranges - 1 quantiles of the beginnings in ``hits`` (heads), sorted; one that fills several ranges is repeated."""
    at = [i / ranges for i in range(1, ranges)]
    if not at:
        return np.zeros(0, np.int64)
    found = hits.select(F.explode("heads").alias("head")).agg(F.percentile_approx("head", at, 10 * ranges + 1000).alias("q")).first()["q"]
    return np.array(found or [], np.int64)


def _ranges(splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(distinct splitters, how often each stands, first own range of each, number of ranges)."""
    edges, times = np.unique(splitters, return_counts=True)
    own = np.where(times > 1, times, 0)
    return edges, times, len(edges) + 1 + np.cumsum(own) - own, len(edges) + 1 + int(own.sum())


# --- sorted runs ---------------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_coded(rows: list[tuple[bytes, bytes, bool]]) -> bytes:
    """A sorted run: for each (suffix, left, many) the prefix shared with the suffix before, and the rest."""
    lcp, rests, prev = np.zeros(len(rows), np.uint16), [], b""
    for i, (s, _, _) in enumerate(rows):
        lcp[i] = h = common_prefix(prev, s)
        rests.append(s[h:])
        prev = s
    rest = np.array([len(x) for x in rests], np.uint16)
    left = np.array([len(x) for _, x, _ in rows], np.uint16)
    many = np.array([m for _, _, m in rows], np.uint8)
    body = b"".join([np.uint32(len(rows)).tobytes(), lcp.tobytes(), rest.tobytes(), left.tobytes(), many.tobytes(), *rests, *(x for _, x, _ in rows)])
    return zstandard.ZstdCompressor(level=6).compress(body)


def front_decoded(raw: bytes) -> list[tuple[int, bytes, bytes, bool]]:
    """(shared prefix, suffix, left, many) in order."""
    body = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    lcp, rest, left = (np.frombuffer(body, np.uint16, n, 4 + 2 * n * k).tolist() for k in range(3))
    many = np.frombuffer(body, np.uint8, n, 4 + 6 * n).tolist()
    at = 4 + 7 * n
    out, prev = [], b""
    tails = at + sum(rest)
    for i in range(n):
        prev = prev[:lcp[i]] + body[at:at + rest[i]]
        at += rest[i]
        out.append((lcp[i], prev, body[tails:tails + left[i]], bool(many[i])))
        tails += left[i]
    return out


_RUN = pa.schema([("range", pa.int32()), ("b", pa.int64()), ("first", pa.int32()), ("payload", pa.binary())])


def _runs(length: int, splitters: np.ndarray):
    """Batches with their repeated grams -> run pieces per range, and (range -1) the owners of the rows."""
    edges, times, own, _ = _ranges(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for b, blob, hits, hots in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2), rb.column(3)):
                _, data, bounds = _unpack(blob.as_py())
                place, gram, lo, hi = places(data, bounds, length)
                keep = np.isin(gram, hits.values.to_numpy().view(np.uint64))
                place, gram, lo, hi = place[keep], gram[keep], lo[keep], hi[keep]
                hot = np.isin(gram, hots.values.to_numpy().view(np.uint64))
                if hot.any():  # every window of a hot gram is a row of its own
                    each = (hi - lo + 1)[hot]
                    start = np.repeat(lo[hot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    place, lo, hi = np.append(place[~hot], start), np.append(lo[~hot], start), np.append(hi[~hot], start)
                raw = data.tobytes()
                number: dict[tuple[bytes, bytes], int] = {}
                count: list[int] = []
                owner = np.zeros(len(place), np.int32)
                for i, (p, a, z) in enumerate(zip(place.tolist(), lo.tolist(), hi.tolist())):
                    k = number.setdefault((raw[p:z + length], raw[a:p]), len(count))
                    if k == len(count):
                        count.append(0)
                    count[k] += 1
                    owner[i] = k
                order = sorted(number.items())
                heads = np.array([int.from_bytes(s[:8], "big") >> 1 for (s, _), _ in order], np.int64)
                part = np.searchsorted(edges, heads, "right")
                full = np.flatnonzero((part > 0) & (times[part - 1] > 1) & (edges[part - 1] == heads)) if len(edges) else []
                for i in full:
                    e = part[i] - 1
                    part[i] = own[e] + zlib.crc32(order[i][0][0][:GRAM]) % int(times[e])
                if len(full):
                    by_range = np.argsort(part, kind="stable")
                    order, part = [order[i] for i in by_range], part[by_range]
                rank = np.zeros(max(len(order), 1), np.int32)
                rank[[k for _, k in order]] = np.arange(len(order))
                rows = [(s, left, count[k] > 1) for (s, left), k in order]
                owners = zstandard.ZstdCompressor(level=3).compress(place.astype(np.int32).tobytes() + (rank[owner] if len(place) else owner).tobytes())
                got, first, size = np.unique(part, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1, *got.tolist()], pa.int32()), pa.array([b] * (len(got) + 1), pa.int64()),
                    pa.array([0, *first.tolist()], pa.int32()),
                    pa.array([owners, *(front_coded(rows[f:f + n]) for f, n in zip(first.tolist(), size.tolist()))], pa.binary())], schema=_RUN)
    return run


# --- merge ---------------------------------------------------------------------------------

def loser_tree_merge(runs: list[list[tuple[int, bytes, bytes, bool]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in run, common prefix with the row before) in merged order."""
    k = 1
    while k < len(runs):
        k *= 2
    cur: list[bytes | None] = [r[0][1] if r else None for r in runs] + [None] * (k - len(runs))
    lcp, pos, tree = [0] * k, [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps its common prefix with the winner."""
        x, y = cur[a], cur[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        h = common_prefix(x, y, lcp[a])
        if x[h:h + 1] <= y[h:h + 1]:
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    best = list(range(k))
    at = k
    while len(best) > 1:  # the first tournament, from the leaves up
        at //= 2
        nxt = []
        for i in range(0, len(best), 2):
            w, loser = play(best[i], best[i + 1])
            tree[at + i // 2] = loser
            nxt.append(w)
        best = nxt
    w = best[0]
    while cur[w] is not None:
        yield w, pos[w], lcp[w]
        pos[w] += 1
        r = runs[w]
        if pos[w] < len(r):
            lcp[w], cur[w] = r[pos[w]][0], r[pos[w]][1]
        else:
            cur[w] = None
        i = (w + k) // 2
        while i:
            w, tree[i] = play(w, tree[i])
            i //= 2


def equal_windows(suffix: list[bytes], lcp: np.ndarray, left: list[bytes], many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows in merged order, the least and the greatest distance d from a window's start to the
    named place for which the window occurs elsewhere (-1: none). Row i has the windows d in
    [length - len(suffix), len(left)]."""
    n = len(suffix)
    r = np.array([len(x) for x in suffix])
    li = np.array([len(x) for x in left])
    low, high = np.full(n, -1), np.full(n, -1)
    same = np.zeros(n, dtype=bool)  # equal to the row before
    for i in np.flatnonzero((lcp[1:] == r[1:]) & (r[1:] == r[:-1]) & (li[1:] == li[:-1])) + 1:
        same[i] = left[i] == left[i - 1]
    whole = many | same
    whole[:-1] |= same[1:]
    low[whole], high[whole] = (length - r)[whole], li[whole]
    group = np.cumsum(lcp < min(GRAM, length))
    size, open_ = np.bincount(group), np.bincount(group, weights=~whole)
    live = np.flatnonzero((size[group] > 1) & (open_[group] > 0))
    if not len(live):
        return low, high
    # rows left out stand between live rows: what a live row shares with the live row before is the least of all between
    joined = np.minimum.reduceat(lcp[:live[-1] + 1], np.append(0, live[:-1] + 1))
    back = [left[i][::-1] for i in live]
    order = np.array(sorted(range(len(live)), key=back.__getitem__))
    rank = np.empty(len(live), np.int64)
    rank[order] = np.arange(len(live))
    shared = np.array([0] + [common_prefix(back[a], back[b]) for a, b in zip(order[:-1], order[1:])])
    weight = 1 + many[live]
    for d in range(int((length - r[live]).min()), int(li[live].max()) + 1):
        on = np.flatnonzero((li[live] >= d) & (r[live] >= length - d))
        if len(on) < 2:
            continue
        key = np.cumsum(joined < length - d)[on] * np.int64(len(live) + 1) + np.cumsum(shared < d)[rank[on]]
        _, inv = np.unique(key, return_inverse=True)
        hit = on[np.bincount(inv, weights=weight[on])[inv] > 1]
        rows = live[hit]
        low[rows] = np.where(low[rows] < 0, d, np.minimum(low[rows], d))
        high[rows] = np.maximum(high[rows], d)
    return low, high


def _merge(length: int):
    schema = pa.schema([("b", pa.int64()), ("payload", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        bs, firsts = t["b"].to_pylist(), t["first"].to_pylist()
        runs = [front_decoded(x) for x in t["payload"].to_pylist()]
        of, at, lcp = (np.array(x) for x in zip(*loser_tree_merge(runs)))
        picked = [runs[i][j] for i, j in zip(of.tolist(), at.tolist())]
        low, high = equal_windows([x[1] for x in picked], lcp, [x[2] for x in picked], np.array([x[3] for x in picked]), length)
        out_b, out = [], []
        for i in range(len(runs)):
            mine = np.flatnonzero((of == i) & (high >= 0))
            if len(mine):
                out_b.append(bs[i])
                out.append((at[mine] + firsts[i]).astype(np.int32).tobytes() + low[mine].astype(np.int32).tobytes() + high[mine].astype(np.int32).tobytes())
        return pa.table({"b": pa.array(out_b, pa.int64()), "payload": pa.array(out, pa.binary())}, schema=schema)
    return run


# --- cutting -------------------------------------------------------------------------------

def _cut(length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for blob, owners, found in zip(rb.column(0), rb.column(1), rb.column(2)):
                ids, data, bounds = _unpack(blob.as_py())
                gone = np.zeros(len(data), dtype=bool)
                if owners.is_valid and found.is_valid:
                    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(owners.as_py()), np.int32).reshape(2, -1)
                    low = np.full(int(raw[1].max()) + 1 if raw.shape[1] else 0, -1)
                    high = low.copy()
                    for x in found.as_py():
                        k, a, z = np.frombuffer(x, np.int32).reshape(3, -1)
                        low[k], high[k] = a, z
                    hit = high[raw[1]] >= 0
                    p, k = raw[0][hit].astype(np.int64), raw[1][hit]
                    step = np.zeros(len(data) + 1, np.int32)
                    np.add.at(step, p - high[k], 1)
                    np.add.at(step, p + length - low[k], -1)
                    gone = np.cumsum(step[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = bounds[:-1][bounds[:-1] < len(data)]
                begins[edge] = gone[edge]
                total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
                kept = []
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    kept.append((data[a:z] if total[a] == total[z] else data[a:z][~gone[a:z]]).tobytes())
                cols = [ids, pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array(spans[bounds[1:]] - spans[bounds[:-1]]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, names)
    return run


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, batch_bytes: int = BATCH_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, ``kept``) for every row of ``docs`` (doc_id, text)."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_batches_{uuid.uuid4().hex}"
    (small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .mapInArrow(_pack(batch_bytes), "b long, blob binary")
     .write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").bucketBy(buckets, "b").saveAsTable(name))
    batches = spark.table(name)

    grams = staged(batches.mapInArrow(_grams(length), "g long, b long, many boolean, head long"), "suffix-grams")
    repeated = grams.groupBy("g").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many")
    found = grams.join(repeated.select("g", (F.col("n") > hot_rows).alias("hot")), "g")
    hits = staged(found.groupBy("b").agg(F.collect_list("g").alias("hits"), F.collect_list(F.when(F.col("hot"), F.col("g"))).alias("hots"),
                                        F.collect_list("head").alias("heads"), F.count("*").alias("n")), "suffix-hits")

    total = hits.agg(F.sum("n")).first()[0] or 0
    ranges = max(buckets, int(total * 1.4 * length // RANGE_BYTES))
    splitters = _splitters(hits, ranges)

    joined = batches.join(hits.hint("shuffle_hash"), "b").select("b", "blob", "hits", "hots")
    runs = staged(joined.mapInArrow(_runs(length, splitters), "range int, b long, first int, payload binary"), "suffix-runs", "none")
    spans = (runs.where("range >= 0").repartition(_ranges(splitters)[3], "range").groupBy("range")
             .applyInArrow(_merge(length), "b long, payload binary"))
    spans = staged(spans, "suffix-spans").groupBy("b").agg(F.collect_list("payload").alias("found"))
    owners = runs.where("range < 0").select("b", F.col("payload").alias("owners"))
    back = batches.join(owners.join(spans, "b").hint("shuffle_hash"), "b", "left").select("blob", "owners", "found")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return back.mapInArrow(_cut(length, with_text), out + ", kept binary" * with_text)
