"""Operator 8 - WARC archives with segmented records, written and read back by Spark.

Writing: pages are deduplicated by the SHA-256 of their payload (payloads under ``MIN_PAYLOAD`` bytes
are always responses). Payloads of a digest that holds a large share of all rows are not gathered: its response
goes to them by broadcast (at most ``HOT_SHARE`` digests). A response's block is an HTTP message with a chunked body; a block over
``SEGMENT_BYTES`` is cut into a first record and continuation records that name the first as their
origin, the last one with the total length. A revisit has no body and names the record of its response. All records of
one call bear one date, since pages hold none.
Records leave through Spark's text writer with the WARC record end as line separator, gzipped, a file as one member.

Reading: files are parsed record by record by their Content-Length. Whole records are decoded where
they are read; segments alone are shuffled, grouped by origin, ordered by segment number, and
checked to be complete and of the stated total length before their chunked framing is decoded.

Defined results: null html is the empty payload; a null page_id is written as an empty value and
read back as null, after all others in the choice of the response; rows equal in page_id and
payload are all responses if theirs is the smallest id, else revisits; other columns are ignored;
an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import small_batches, staged_path

MIN_PAYLOAD = 100
#: Code points of a segment and of an HTTP chunk; records of a file, which bound a file's size.
SEGMENT_CHARS, CHUNK_CHARS, FILE_RECORDS = 32_768, 4096, 512
#: A digest that holds more than one row in so many is hot.
HOT_SHARE = 16_384
END = "\r\n\r\n"

OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _record(kind: str, fields: dict[str, object], block: str) -> str:
    head = {"WARC-Type": kind, **{k: v for k, v in fields.items() if v is not None}, "Content-Length": len(block.encode())}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block


def chunked(body: str, size: int = CHUNK_CHARS) -> str:
    """HTTP/1.1 chunked framing; chunks end between code points, their sizes count bytes."""
    parts = (body[i:i + size] for i in range(0, len(body), size))
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at = end + 4 + n


def record_id(row: int, segment: int = 1) -> str:
    return f"<urn:page:{row}>" if segment == 1 else f"<urn:page:{row}:{segment}>"


def records(page: int | None, row: int, url: str | None, html: str, kind: str, refers_to: int | None, refers_row: int | None, date: str) -> Iterator[str]:
    """The records of one page without their end marks."""
    rid = record_id(row)
    shown = "" if page is None else page
    digest = hashlib.sha256(html.encode()).hexdigest()
    # a line break in a URL would end the header field
    fields = {"WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": "".join(c for c in url or "" if c >= " "), "X-Page-Id": shown,
              "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        yield _record("revisit", {**fields, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                  "WARC-Refers-To": record_id(refers_row), "WARC-Refers-To-Date": date, "X-Refers-To-Page": refers_to, "X-Payload-Length": len(html.encode())}, "HTTP/1.1 200 OK\r\n\r\n")
        return
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = [block[i:i + SEGMENT_CHARS] for i in range(0, len(block), SEGMENT_CHARS)]
    if len(parts) == 1:
        yield _record("response", fields, block)
        return
    yield _record("response", {**fields, "WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block.encode()) if k == len(parts) else None
        yield _record("continuation", {"WARC-Record-ID": record_id(row, k), "WARC-Date": date, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": k,
                                       "WARC-Segment-Total-Length": total}, part)


def write_warc(pages: DataFrame, path: str, date: datetime.datetime | None = None, hot_share: int = HOT_SHARE) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``; ``date`` (UTC, default now) is their WARC-Date."""
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha2("html", 256))).withColumn("big", F.octet_length("html") >= MIN_PAYLOAD)
    p = p.withColumn("row", F.monotonically_increasing_id())
    # only digests that occur more than once have revisits; the sides are short rows
    first = (p.where("big").groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("row", "page_id").alias("first_row"), F.count("*").alias("n"))
             .where("n > 1 and first is not null"))
    # the share of the largest digests has fewer than hot_share members at any size
    hot = F.col("n") * hot_share > pages.agg(F.count(F.lit(1))).scalar()
    common = first.where(hot).select("digest", F.col("first").alias("hot_first"), F.col("first_row").alias("hot_row"))
    rare = first.where(~hot).select(F.col("digest").alias("key"), "first", "first_row")
    p = p.join(F.broadcast(common), "digest", "left")
    # rows of a hot digest are done; in the second join they scatter over keys that match nothing
    key = F.when(F.col("hot_first").isNotNull(), F.unhex(F.hex("row"))).otherwise(F.col("digest"))
    p = p.withColumn("key", key).join(rare, "key", "left").withColumns({"first": F.coalesce("hot_first", "first"), "first_row": F.coalesce("hot_row", "first_row")})
    revisit = F.col("big") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.select("page_id", "row", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"),
                 F.when(revisit, F.col("first_row")).alias("refers_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for r in b.to_pylist():
                for x in records(r["page_id"], r["row"], r["url"], r["html"], r["kind"], r["refers_to"], r["refers_row"], stamp):
                    out.append(x)
                    held += len(x)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (p.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS)
     .option("compression", "gzip").text(path))


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an uncompressed WARC file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        yield fields, raw[end + 4:end + 4 + n]
        if raw[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = end + 8 + n


def payload(block: bytes) -> bytes:
    """Body of an HTTP message, its chunked framing undone."""
    head, body = block.split(b"\r\n\r\n", 1)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(fields: dict[str, str]) -> int | None:
    return int(fields["X-Page-Id"]) if fields.get("X-Page-Id") else None


_SEG = [("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("page", pa.string()), ("block", pa.binary())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files -> finished pages (segment columns null) and segments (page columns null)."""
    import gzip
    schema = pa.schema([*_OUT, *_SEG])
    for b in batches:
        for content in b.column(0):
            cols: dict[str, list] = {f.name: [] for f in schema}
            for fields, block in parse(gzip.decompress(content.as_py())):
                row: dict[str, object] = dict.fromkeys(cols)
                if "WARC-Segment-Number" in fields:
                    first = fields["WARC-Type"] != "continuation"
                    row |= {"origin": fields["WARC-Record-ID"] if first else fields["WARC-Segment-Origin-ID"], "number": int(fields["WARC-Segment-Number"]),
                            "total": int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None,
                            "page": fields["X-Page-Id"] if first else None, "block": block}
                elif fields["WARC-Type"] == "revisit":
                    row |= {"page_id": _page(fields), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "record_type": "revisit", "refers_to": int(fields["X-Refers-To-Page"])}
                else:
                    body = payload(block)
                    row |= {"page_id": _page(fields), "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "record_type": "response"}
                for k in cols:
                    cols[k].append(row[k])
            yield pa.RecordBatch.from_pydict(cols, schema)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one origin per row -> pages."""
    for b in batches:
        out = []
        for parts in b.column(0).to_pylist():
            parts.sort(key=lambda x: x["number"])
            if [x["number"] for x in parts] != list(range(1, len(parts) + 1)):
                raise ValueError("segments are missing or repeated")
            block = b"".join(x["block"] for x in parts)
            if parts[-1]["total"] != len(block):
                raise ValueError("the segments do not have the stated total length")
            body, page = payload(block), parts[0]["page"]
            out.append({"page_id": int(page) if page else None, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(),
                        "record_type": "response", "refers_to": None})
        yield pa.RecordBatch.from_pylist(out, _OUT)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages in the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    got = files.mapInArrow(_read, OUT + ", origin string, number long, total long, page string, block binary")
    pages = got.where("origin is null").select(*_OUT.names)
    parts = got.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "page", "block")).alias("parts"))
    return pages.unionByName(parts.select("parts").mapInArrow(_assemble, OUT))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = staged_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d),
     t AS (SELECT *, n >= 100 AND page_id <> first AS revisit FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to FROM t
"""
