"""Operator 4 - near-duplicate components with HyperMinHash registers.

A document's set holds the hashes of its distinct word shingles. Its sketch is one register
per bucket: the leading-zero count (6 bits) and 10 mantissa bits of the bucket's least hash.
Bands of compressed registers propose pairs; the Jaccard estimate, corrected for chance
collisions of compressed registers, discards hopeless pairs; the rest are confirmed on the
full sets.

Documents with equal sets are one node, so copies cost one row each and no pairs. Each
node is first estimated against one center, the most-met node of its buckets; what the estimate
holds for near forms clusters, and the full sets then give links and connected components; buckets that still hold several
clusters are searched by their registers, in blocks of bounded size. Inside a cluster nodes of
different components are compared by their full sets, again in blocks. Both steps hand out one edge per merger, so no link between components is missed and pairs are
never written out inside a group.

Recall is high, not exact: bands whose registers agree independently with share p all miss a pair with
probability (1 - p**5)**40, where p scatters round the similarity as shingles meet in one bucket. Over
simulated sets that is 6e-10 at 17 of 20 shingles (7e-11 for p = 0.85), 4e-10 at 6 of 7, 4e-7 at 46 of 57
and 1e-6 at 80 of 100. The estimate's cut lies six standard deviations below the threshold.

Defined results: null text, empty text and text without words have the empty set: no links,
component_id = doc_id, kept. A row with a null doc_id belongs to its component but never
names it; a component of null ids only has component_id null and keeps its rows. Rows with
one doc_id count as one document for naming; each row is returned. Ties go to the smallest
doc_id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import mix64, named, slices, small_batches, staged, utf8, word_hash, words
from textguard.llm.components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Nodes in a block: of sets, and of registers.
BLOCK, WIDE_BLOCK = 256, 512

_M = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every row's distinct shingles of ``size`` lower-cased words, sorted by row and
    hash. A row with fewer words has one shingle, its whole sequence; without words none."""
    data = _LOWER[data]
    start, end, row = words(data, bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = word_hash(data, start, end)
    n_rows = len(bounds) - 1
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    span = np.minimum(count, size)  # words in each shingle of the row
    # position of a word in its row decides whether a shingle starts there
    begins = (np.arange(len(w)) - first[row]) <= (count - span)[row]
    at = np.flatnonzero(begins)
    of = row[at]
    h = _M[0] * (span[of].astype(np.uint64) + np.uint64(1))
    for k in range(size):
        more = k < span[of]
        h[more] = mix64(h[more] ^ (w[at[more] + k] * _M[1])) + _M[2]
    h = mix64(h)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def sketch(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Compressed registers, one line of REGISTERS uint16 per row."""
    least = np.full(n_rows * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.zeros(n_rows * REGISTERS, dtype=bool)
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    at = row * REGISTERS + bucket.astype(np.int64)
    v = mix64(h ^ _M[3]) | np.uint64(1 << 10)  # at most 53 leading zeros
    np.minimum.at(least, at, v)
    full[at] = True
    zeros = np.full(len(least), EMPTY, np.uint16)
    m = least[full]
    top = np.zeros(len(m), np.int64)  # place of the highest set bit
    rest = m.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(s)
        top[big] += s
        rest[big] >>= np.uint64(s)
    lz = 63 - top
    mant = (m << (lz + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    zeros[full] = (lz.astype(np.uint16) << MANTISSA) | mant.astype(np.uint16)
    return zeros.reshape(n_rows, REGISTERS)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that two unrelated registers agree, for sets of sizes a and b: the sum over
    leading-zero counts of the density product times the width of a mantissa cell."""
    la, lb = np.maximum(a / REGISTERS, 1e-9), np.maximum(b / REGISTERS, 1e-9)
    both, out = la + lb, np.zeros(len(a))
    for i in range(40):
        hi = 2.0 ** -i
        out += la * lb / both * (hi / 2) * 2.0 ** -MANTISSA * (np.exp(-both * hi / 2) - np.exp(-both * hi))
    return out


def likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Rows of two register tables whose collision-corrected Jaccard estimate is less than six standard
    deviations under the threshold (for the registers in use)."""
    t = percent / 100
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    at = np.flatnonzero(ok)
    x, y = np.broadcast_to(x, (len(ok), REGISTERS))[at], y[at]
    nx, ny = np.broadcast_to(nx, len(ok))[at], ny[at]
    void = ((x == EMPTY) & (y == EMPTY)).sum(axis=1)
    used = np.maximum(REGISTERS - void, 1)
    share, cut = ((x == y).sum(axis=1) - void) / used, t - 6 * np.sqrt(t * (1 - t) / used)
    some = share >= cut  # the correction only lowers the share
    c = chance(nx[some].astype(float), ny[some].astype(float))
    share[some] = (share[some] - c) / (1 - c)
    ok[at] = share >= cut
    return ok


#: Which registers make up a band: a fixed shuffle, so that neighbours fall into different bands.
_DEAL = np.argsort(mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)), kind="stable")


#: The registers in the order in which an empty one looks for a used one: an own fixed shuffle for each.
_PROBE = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) * _M[1] + _M[2]).reshape(REGISTERS, REGISTERS), axis=1, kind="stable")


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one taking the value of the first used one in its own order, so that bands of
    small sets are as telling as those of large ones: one differing register is copied to others independently."""
    out = regs.copy()
    row, at = np.nonzero(regs == EMPTY)
    for k in range(REGISTERS):
        if not len(row):
            break
        value = regs[row, _PROBE[at, k]]
        hit = value != EMPTY
        out[row[hit], at[hit]] = value[hit]
        row, at = row[~hit], at[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands, one line of BANDS numbers per row; the key carries the band's number."""
    r = filled(regs)[:, _DEAL].reshape(len(regs), BANDS, ROWS)
    h = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _M[0], r.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h ^ (r[:, :, k].astype(np.uint64) * _M[1] + _M[2]))
    return h


def _digests(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """128-bit digest of each row's set (order-free sums of two mixes)."""
    out = np.zeros((n_rows, 2), np.uint64)
    np.add.at(out[:, 0], row, mix64(h ^ _M[0]))
    np.add.at(out[:, 1], row, mix64(h ^ _M[1]))
    return mix64(out)


def _binary(a: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous array as fixed-width binary values."""
    a = np.ascontiguousarray(a)
    n = len(a)
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(a.tobytes())])


def _registers(col: pa.Array) -> np.ndarray:
    raw, _ = utf8(col)
    return raw.view(np.uint16).reshape(-1, REGISTERS)


_SIG = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("regs", pa.binary())])


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(2))
            for i, j in slices(bounds):
                part, local = data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
                row, h = shingles(part, local, size)
                n = np.bincount(row, minlength=j - i)
                node = _binary(_digests(row, h, j - i), 16).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                    pa.array([x if k else None for x, k in zip(node, n)], pa.binary()), pa.array(n, pa.int64()),
                    _binary(sketch(row, h, j - i), 2 * REGISTERS)], schema=_SIG)
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            key = band_keys(_registers(b.column(1)))
            row = np.repeat(np.arange(len(key)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column(0).take(pa.array(row))], ["key", "node"])


def _worth(percent: int):
    """Keep the pairs whose estimate does not rule them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = likely(_registers(b.column(2)), _registers(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))
    return run


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The two blocks of a task; a block that meets itself stands on both sides."""
    left, right = t.filter(pc.equal(t["side"], 0)), t.filter(pc.equal(t["side"], 1))
    return (left, left) if right.num_rows == 0 else (left, right)


def _labels(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Component of each row of the two blocks as a small integer."""
    both = np.array(left["comp"].to_pylist() + right["comp"].to_pylist(), dtype=object)
    _, codes = np.unique(both, return_inverse=True)
    return codes[:left.num_rows], codes[left.num_rows:]


def _spanning(left: pa.Table, right: pa.Table, near) -> pa.Table:
    """One edge for each merger of components: near(i, js) says which rows js of ``right`` are near row i of
    ``left``; it is asked only about rows that are not yet connected with i."""
    cx, cy = _labels(left, right)
    ia, ib = [], []
    for i in range(len(cx)):
        j = np.flatnonzero(cy != cx[i])
        if len(j):
            j = j[near(i, j)]
        if len(j):
            own, (other, first) = cx[i], np.unique(cy[j], return_index=True)
            ia += [i] * len(other)
            ib += j[first].tolist()
            cx[np.isin(cx, other)] = own
            cy[np.isin(cy, other)] = own
    return pa.table({"a": left["node"].take(pa.array(ia, pa.int64())), "b": right["node"].take(pa.array(ib, pa.int64()))}, schema=_EDGES)


def _maybe_near(percent: int):
    """Edges that connect what the estimate holds for near in one pair of blocks of a bucket."""
    def run(t: pa.Table) -> pa.Table:
        left, right = _sides(t)
        x, y = _registers(left["regs"]), _registers(right["regs"])
        nx, ny = left["n"].to_numpy(), right["n"].to_numpy()

        def near(i: int, j: np.ndarray) -> np.ndarray:
            return likely(x[i], y[j], nx[i], ny[j], percent)

        return _spanning(left, right, near)
    return run


def _linked(percent: int):
    """Edges that connect what is linked, by the full sets, in one pair of blocks of a cluster."""
    def run(t: pa.Table) -> pa.Table:
        left, right = _sides(t)
        nx, ny = left["n"].to_numpy(), right["n"].to_numpy()
        flat = [np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in s["items"].chunks)]) for s in (left, right)]
        known, codes = np.unique(np.concatenate(flat), return_inverse=True)
        px, py = codes[:len(flat[0])], codes[len(flat[0]):]
        ox, oy = np.concatenate([[0], np.cumsum(nx)]), np.concatenate([[0], np.cumsum(ny)])
        mark = np.zeros(len(known), dtype=np.int32)

        def near(i: int, j: np.ndarray) -> np.ndarray:
            own = px[ox[i]:ox[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[py], oy[:-1])[j]
            mark[own] = 0
            return 100 * common >= percent * (ny[j] + nx[i] - common)

        return _spanning(left, right, near)
    return run


def _sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(k, items): the shingle set of one document for each k of ``keys``. Only their texts are moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(1))
            for i, j in slices(bounds):
                row, h = shingles(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], size)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i),
                                                  pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], ["k", "items"])

    texts = docs.join(keys.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    return texts.select("k", "text").mapInArrow(run, "k long, items array<long>")


def _stars(star: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``star`` as blocks of the nodes b of one center a, which is copied to each block."""
    size = star.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    zero = F.lit(0).cast("long")
    out = (star.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("side"), F.col("b").alias("node"))
           .unionByName(size.select("a", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("a").alias("node"))))
    return out.join(sets, "node").withColumn("comp", F.col("node"))


def _blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Deal the rows of a group into ``blocks`` blocks and copy each to the pairs of blocks it belongs to."""
    at = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return at.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other"),
                           "side": F.when(F.col("block") <= F.col("other"), 0).otherwise(1)}).drop("block", "other")


def _stragglers(rest: DataFrame, group: str, payload: str, width: int) -> DataFrame:
    """Pairs of blocks (p, q), of ``width`` nodes each, within the groups of rows (group, node, comp, n, payload): the
    largest component of a group is only compared with the other nodes, never with itself, so a node of it is copied
    once for each block of others and not to every block of its group."""
    size = rest.groupBy(group, "comp").agg(F.count("*").alias("c"))
    main = size.groupBy(group).agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")) \
        .select(group, F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / width).alias("few"),
                F.ceil(F.col("top.c") / width).alias("many")).where("few > 0")
    at = rest.join(main, group)
    loose, core = at.where(F.col("comp") != F.col("main")), at.where(F.col("comp") == F.col("main"))
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    met = loose.withColumn("p", F.pmod(F.xxhash64("node"), F.col("few"))).withColumn("q", F.explode(F.sequence(-F.col("many"), -one))).withColumn("side", F.lit(0))
    core = core.withColumn("q", -1 - F.pmod(F.xxhash64("node"), F.col("many"))).withColumn("p", F.explode(F.sequence(zero, F.col("few") - 1))).withColumn("side", F.lit(1))
    keep = [group, "node", "comp", "n", payload, "p", "q", "side"]
    return _blocks(loose, "few").select(*keep).unionByName(met.select(*keep)).unionByName(core.select(*keep))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text, F.length(text)).alias("k"), text.alias("text"))
    sig = staged(d.mapInArrow(_signatures(size), "doc_id long, k long, node binary, n long, regs binary"), "hmh-sig")
    nodes = staged(sig.where(F.col("node").isNotNull()).groupBy("node")
                   .agg(F.min("k").alias("k"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "hmh-nodes")
    holder = nodes.select("node", "k")
    bands = nodes.select("node", "regs").mapInArrow(_bands, "key long, node binary")
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = staged(bands.join(shared, "key"), "hmh-met")
    # the node that meets most others in its buckets is likeliest the text the others were made from: it is the center
    fame = met.groupBy("node").agg(F.sum("m").alias("fame"))
    ranked = met.join(fame, "node").select("key", "node", F.struct("fame", "node").alias("r"))
    buckets = ranked.groupBy("key").agg(F.max("r").alias("top"))
    member = staged(met.select("key", "node").join(buckets, "key"), "hmh-members")

    # each node with the center of most fame among its buckets
    regs = nodes.select("node", "regs", "n")
    star = member.groupBy(F.col("node").alias("b")).agg(F.max("top").alias("top")).select(F.col("top.node").alias("a"), "b").where("a != b")
    star = (star.join(regs.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na")), "a")
            .join(regs.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb")), "b")
            .select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_worth(percent), "a binary, b binary"))
    star = staged(star, "hmh-star")
    tied = components(star)

    # buckets whose nodes are not yet tied together: their registers tell what else may be near
    labelled = member.select("key", "node").join(tied, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    rest = staged(labelled.join(mixed, "key"), "hmh-mixed").join(regs, "node")
    glue = staged(_stragglers(rest, "key", "regs", WIDE_BLOCK).select("key", "p", "q", "side", "node", "comp", "regs", "n")
                  .groupBy("key", "p", "q").applyInArrow(_maybe_near(percent), "a binary, b binary").distinct(), "hmh-glue")
    if not glue.isEmpty():
        tied = components(star.unionByName(glue))
    tied = tied.withColumnRenamed("comp", "cluster")

    # the sets of all nodes in clusters, from one document each
    where = tied.join(holder, "node").join(regs.select("node", "n"), "node").select("node", "k", "n")
    sets = staged(where.join(_sets(d, where, size), "k").select("node", "n", "items"), "hmh-sets")
    links = staged(_stars(star, sets).select("a", "block", "side", "node", "comp", "n", "items")
                   .groupBy("a", "block").applyInArrow(_linked(percent), "a binary, b binary"), "hmh-links")
    comp = components(links)

    # clusters with several components: their nodes of different components meet once, with their full sets
    of = staged(tied.join(comp, "node", "left").select("cluster", "node", F.coalesce("comp", "node").alias("comp")), "hmh-cluster")
    unsure = of.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("cluster")
    members = staged(of.join(unsure, "cluster").join(sets, "node"), "hmh-unsure")
    if not members.isEmpty():
        late = staged(_stragglers(members, "cluster", "items", BLOCK).groupBy("cluster", "p", "q").applyInArrow(_linked(percent), "a binary, b binary"), "hmh-late")
        if not late.isEmpty():
            comp = components(links.unionByName(late))

    named = nodes.select("node", "first_id").join(comp, "node", "left").select("node", "first_id", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(smallest, "comp").select("node", "component_id")
    # a row without words has no node; its own key keeps such rows apart
    keyed = sig.select("doc_id", "n", "node", F.coalesce("node", F.col("k").cast("string").cast("binary")).alias("at"))
    out = keyed.join(of_node.withColumnRenamed("node", "at"), "at", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, without the later members of near-duplicate groups."""
    verdict = near_duplicates(docs, size, percent)
    lost = named(docs, "_gone")
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(lost), "left_anti")


# DuckDB twin of near_duplicates() over the table documents (all pairs that share a shingle; small tables only).
ORACLE = r"""
WITH RECURSIVE w AS (
       SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
