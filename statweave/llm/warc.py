"""WARC archives: writing captures as request, response (or revisit) and metadata records, and assembling captures from archives."""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import cut, shared_folder, table

CRLF = "\r\n"


def base32_sha1(payload) -> F.Column:
    """SHA-1 of a binary column in bare upper-case base32: every five hexadecimal digits are four base-32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind, record_id, block, *headers) -> F.Column:
    """A record without the two line ends after its block. headers: (name, column), left out where null."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, minimum: int = 0, date: str = "2026-01-01T00:00:00Z", records_per_file: int = 30_000) -> None:
    """A capture per row of pages (page_id, url, html; null html: empty): request, response or revisit, and metadata records, in gzipped WARC files.

    Of the rows with equal payloads of at least `minimum` bytes those with the largest page_id are responses and the others revisits without the payload;
    shorter payloads are all responses. A null page_id counts as the least, line ends in a url are percent-encoded, other columns are ignored.
    Only payloads that occur more than once are looked up, in a join whose crowded keys Spark splits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    row = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"),
                       base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    again = cut(row.filter(F.col("bytes") >= minimum).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner"))
    row = row.join(again, "digest", "left")
    revisit = F.coalesce(F.col("winner").isNotNull() & (F.col("bytes") >= minimum) & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    urn = lambda kind, page: _urn(F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), F.col("digest"))
    me = urn("capture", F.col("page_id"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    answer = F.when(revisit, _record(F.lit("revisit"), me, head, *common, http, digest,
                                     ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                     ("WARC-Refers-To", urn("capture", F.col("winner"))))).otherwise(_record(F.lit("response"), me, F.concat(head, "html"), *common, http, digest))
    request = _record(F.lit("request"), urn("request", F.col("page_id")), F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)), *common,
                      ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", me))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(revisit, F.concat(F.lit("refers-to-page: "), F.col("winner").cast("string"))), F.lit(""))
    metadata = _record(F.lit("metadata"), urn("metadata", F.col("page_id")), fields, *common, ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", me))
    (row.select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of the bytes of a file that is gzipped, in any number of members, or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        while True:
            piece = member.decompress(content, 1 << 20)
            content = member.unconsumed_tail or member.unused_data
            if piece:
                yield piece
            if member.eof or not (piece or content):
                break
        if not member.eof:
            return


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; lengths decide where a block ends, never its bytes."""
    buffer, more = bytearray(), True
    while True:
        while more and (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            more = piece is not None
            buffer += piece or b""
        if (end := buffer.find(b"\r\n\r\n")) < 0:
            return
        head = bytes(buffer[:end]).decode("utf-8", "replace").split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers.get("content-length", 0))
        while more and len(buffer) < end + 8 + size:
            piece = next(pieces, None)
            more = piece is not None
            buffer += piece or b""
        yield headers, bytes(buffer[end + 4:end + 4 + size])
        del buffer[:end + 8 + size]


RECORD = ("warc_type string, record_id string, concurrent_to string, refers_to string, url string, date string, content_type string, payload_digest string, "
          "payload_bytes long, computed_digest string, block binary")


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of the archives in a folder. payload_bytes: of an HTTP message its body's length, as its header says where a revisit holds no body;
    computed_digest: of a response's body. blocks: whether the blocks of responses come along; those of other kinds always do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for content in batch.column(0):
                for h, block in _records(_inflated(content.as_py())):
                    kind, size, computed = h.get("warc-type"), None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = len(body)
                        if kind == "revisit":
                            size = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), size)
                        else:
                            computed = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    kept = block if blocks or kind != "response" else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"),
                                 (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, size, computed, kept))
                    held += 200 + len(kept or b"")
                    if held > 1 << 23:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORD.split(", ")])


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: it, the request and the metadata record whose concurrent-to names it (null where there is none).

    Records that occur more than once keep their responses apart and share request and metadata. Records of other kinds take no part; no records give no rows.
    Returns capture_id, answer, request, metadata (structs)."""
    part = lambda kind, *cols: records.filter(F.col("warc_type") == kind).filter(F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.max(F.struct(*cols)).alias(kind))
    answer = records.filter(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(
        "warc_type", "refers_to", "url", "date", "payload_digest", "payload_bytes", "computed_digest", "block").alias("answer"))
    return answer.join(part("request", "record_id", "url", "block"), "capture_id", "left").join(part("metadata", "record_id", "block"), "capture_id", "left")


def captures_of_pages(spark: SparkSession, pages: DataFrame, minimum: int = 0, blocks: bool = True) -> DataFrame:
    """Pages written as archives in the shared folder, read back and assembled."""
    path = shared_folder(spark)
    write_archives(pages, path, minimum)
    return assemble_captures(read_records(spark, path, blocks))


def op10_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = captures_of_pages(spark, table(spark, sf_dir, "pages"), 0, blocks=False)
    field = lambda name: F.regexp_extract(F.decode("metadata.block", "UTF-8"), f"(?m)^{name}: (-?[0-9]+)", 1)
    number = lambda name: F.when(field(name) != "", field(name).cast("long"))
    return captures.select(number("page-id").alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"),
                           F.coalesce("answer.computed_digest", "answer.payload_digest").alias("payload_digest"), F.col("answer.warc_type").alias("record_type"), number("refers-to-page").alias("refers_to"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS winner,
         [CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS INTEGER) FOR i IN range(8)] AS words FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((words[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM d
"""
