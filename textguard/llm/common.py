"""Helpers shared by the corpus operators: staged tables in the shared folder, UTF-8 views of
Arrow columns, and vectorised hashing of byte ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Python's bytes.split() white space: space and the five controls 9-13.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of text handled by one vectorised step inside a task.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint
    folder. Only a single-machine session (master local) gets a scratch folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile
    d = tempfile.mkdtemp(prefix="textguard-shared-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a
    lost executor costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch between the JVM and Python, where the session has not set its own.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of texts small: the default of 10,000 rows holds tens of MB on both sides."""
    conf = df.sparkSession.conf
    for key, (default, value) in BATCH_CONF.items():
        if conf.isModifiable(key) and (default is None or conf.get(key) == default):
            conf.set(key, value)
    return df


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string or binary column: row i is bytes[bounds[i]:bounds[i+1]]; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    bounds = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each (one longer row makes a range of its own)."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser spreading 64-bit values (the public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    t = _powers.get(key)
    if t is None or len(t) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        t = np.full(size, base, np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if size > 4 * CHUNK_BYTES:
            return t  # an exceptionally long row: not kept
        _powers[key] = t
    return t[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 (length n + 1)."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(len(data), False), out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end): equal byte strings have equal hashes wherever they stand."""
    inv = _power_table(len(p), True)
    return mix64((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64))


_places = mix64(np.arange(64 << 8, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(1))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the disjoint, ascending byte ranges [start, end): a sum over the bytes of a mixed value of (place in the range, byte). A
    polynomial modulo 2**64 would give Thue-Morse strings of a thousand letters equal hashes."""
    first = np.zeros(len(data) + 1, np.int64)
    first[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(first)[:-1]
    value = _places[((place & 63) << 8) | data]
    far = np.flatnonzero(place > 63)
    value[far] = mix64((place[far].astype(np.uint64) << np.uint64(8) | data[far]) * np.uint64(_BASE) + np.uint64(1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix64(sums[end] - sums[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of non-space bytes; runs never cross rows."""
    n = len(data)
    ink = np.zeros(n + 2, dtype=bool)
    ink[1:-1] = ~ASCII_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    end = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    return start, end, row


def named(df: DataFrame, taken: str) -> str:
    """A column name starting with ``taken`` that ``df`` does not use (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    while taken.lower() in have:
        taken += "_"
    return taken
