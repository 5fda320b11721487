"""WARC with revisit resolution (op 9).

Headers (id, digest, length) are grouped by payload digest to the original response of each repeated payload; pages
are joined to it, and each becomes a response with its payload or a revisit of the original without it. Payloads are
dealt to partitions of a bounded number of bytes; those of digests with very many pages, of which there are few, are
joined by broadcast and dealt by row. Every record is a gzip member of its own in its archive, so that it can be read
alone; reading parses the archives again and takes digests from the payloads themselves.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, table

#: Shortest payload that a revisit may stand for.
LEAST_BYTES = 1000
#: Payload bytes of an archive, about, and its records at most.
ARCHIVE_BYTES, RECORDS = 32 << 20, 5_000
#: Digests with more pages than this, and than so small a part of all pages, are hot.
HOT_PAGES, HOT_PART = 1000, 100_000
CRLF = "\r\n"
#: Bytes of a gzip member at most: of the four bytes of its size, the last one is 0.
MEMBER_BYTES = (1 << 24) - 1


def _uri(column: Column) -> Column:
    """As it may stand in a header line: control characters and spaces percent-encoded."""
    out = column
    for c in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return out


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, hot_pages: int = HOT_PAGES) -> DataFrame:
    """Per row of ``pages``: page_id, url, payload, digest, length, refers_to and refers_to_url (the original's, null for originals).

    A null html is an empty payload. Equal payloads (digest and length) of at least ``least_bytes`` refer to the row
    with the largest page_id (and of these the largest url); rows tied on it are originals, and a null page_id is the
    smallest. Repeated rows stay, an empty table gives none; other columns are ignored. The rows lie in partitions of
    about ``archive_bytes`` of payload.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("length", F.octet_length("payload").cast("bigint"))
    headers = own.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    originals = headers.where("n > 1 and top.page_id is not null").select("digest", "length", "n", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("html").cast("string"))).alias("b")).first()
    most = max(hot_pages, size["n"] // HOT_PART)
    hot = F.broadcast(originals.where(F.col("n") > most).select(F.col("digest").alias("hot"), F.col("length").alias("hot_length"), F.col("original").alias("hot_original"), F.col("original_url").alias("hot_url")))  # HOT_PART rows at most
    own = own.join(hot, (F.col("digest") == F.col("hot")) & (F.col("length") == F.col("hot_length")), "left")
    payload = F.concat_ws(":", "digest", F.col("length").cast("string"))
    own = own.withColumn("by", F.when(F.col("hot").isNull(), payload).otherwise(F.xxhash64("page_id", "url", "digest").cast("string")))
    parts = max(1, -(-(size["b"] or 0) // archive_bytes))
    own = own.repartition(int(parts), "by")
    joined = own.join(originals.where(F.col("n") <= most).select(payload.alias("by"), "original", "original_url"), "by", "left")
    top, url = F.when(F.col("hot").isNotNull(), F.col("hot_original")).otherwise(F.col("original")), F.when(F.col("hot").isNotNull(), F.col("hot_url")).otherwise(F.col("original_url"))
    revisit = top.isNotNull() & ~F.col("page_id").eqNullSafe(top)
    return joined.select("page_id", "url", "payload", "digest", "length", F.when(revisit, top).alias("refers_to"), F.when(revisit, url).alias("refers_to_url"))


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A URN made of the row's id, url and payload; rows that are equal in all three are one record, stored as often."""
    h = F.sha1(F.concat_ws("\0", digest, F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("\0"))).cast("binary"))
    return F.concat(F.lit("<urn:sha1:"), h, F.lit(">"))


def _member(record: bytes) -> bytes:
    """``record`` as one gzip member (several above ``MEMBER_BYTES``), without its last byte, which is 0."""
    out = b"".join(gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(record), MEMBER_BYTES))
    return out[:-1]


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records: int = RECORDS) -> None:
    """One WARC record for each row, a gzip member each, in archives below ``path``. Rows of one digest needn't share an archive.

    Spark's text writer puts the members in files, whatever the file system, and commits them; the last byte of a
    member stands as its line end.
    """
    small_batches(resolved.sparkSession)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("refers_to_url"), F.col("digest")))),
        F.when(revisit & F.col("refers_to_url").isNotNull(), F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri(F.col("refers_to_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block, F.lit(CRLF * 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_member(x) for x in batch.column("record").to_pylist()], pa.binary())], names=["member"])

    members = resolved.select(record.cast("binary").alias("record")).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an unpacked archive."""
    while version := stream.readline():
        if version == b"\r\n":
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Of every record below ``path``: page_id, url, record_type, payload_bytes, payload_digest (of the payload read, or as a revisit states), refers_to, payload (null for revisits)."""

    def page(own: str | None) -> int | None:
        return None if own is None else int(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                with gzip.open(io.BytesIO(batch.column("content")[i].as_buffer()), "rb") as stream:
                    for headers, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, stated = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"{headers['warc-record-id']} doesn't have its payload digest")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page(headers.get("x-page-id")), headers.get("warc-target-uri"), kind, length, stated, page(headers.get("x-refers-to-page-id")), payload.decode() if kind == "response" else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(resolve(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, n, max(page_id) AS top FROM p WHERE n >= {LEAST_BYTES} GROUP BY h, n HAVING count(*) > 1)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN o ON o.h = p.h AND o.n = p.n
"""
