"""WARC archives: writing captures, and assembling transactions from archives.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; the request and the
metadata name the response in WARC-Concurrent-To. Reading parses the archives' records by their Content-Length and joins
the three kinds through these identifiers into one nested row per capture.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, saved, sliced

#: Fixed values of the format: version line, line end, end of a record, alphabet of base32.
VERSION, LINE, END, BASE32 = "WARC/1.1", "\r\n", "\r\n\r\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of payload after which a writing task begins another archive (on average).
ARCHIVE_BYTES = 16_000_000
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_digest string, fields map<string,string>, payload binary"


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in base32: 10 digits make 8 letters."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(digest, 1 + 10 * i, F.lit(10)), 16, 10).cast("long"))
    letter = lambda part, j: F.substring(F.lit(BASE32), F.shiftright(part, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(parts, lambda part: F.concat(*(letter(part, j) for j in range(8)))), "")


def urn(text: Column) -> Column:
    """A record id: the MD5 of a text as a UUID."""
    digest = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Writes three records for each page row into gzipped archives in the folder `path`.

    The payload is the html in UTF-8; null is empty. Of pages with equal payloads of `least_bytes` or more, that with the
    largest id is a response and the others revisit it, without a payload of their own; smaller payloads are all
    responses. Rows that share the largest id are all responses. A null id counts as less than any other, a null url is
    empty. An empty table gives a folder without records. Other columns aren't written.
    """
    key, sha1 = F.col(id_col), F.sha1(F.coalesce(html_col, F.lit("")).cast("binary"))
    page = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    # What is equal is found among ids and digests; the html then travels once, by page, so equal payloads don't meet.
    narrow = saved(pages.select(key.alias("key"), page.alias("page"), sha1.alias("sha1"), F.octet_length(F.coalesce(html_col, F.lit(""))).alias("bytes")), "pages")
    first = narrow.groupBy("sha1").agg(F.max("key").alias("first"))
    marks = narrow.select("page", "key", "sha1").distinct().join(first, "sha1").drop("key")
    rows = pages.select(page.alias("page"), key.alias("key"), F.coalesce(F.regexp_replace(url_col, r"[\r\n]", ""), F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), sha1.alias("sha1"))
    rows = rows.join(marks, ["page", "sha1"]).withColumn("bytes", F.octet_length("html"))
    identity = lambda kind, key: urn(F.concat_ws("|", F.lit(kind), F.coalesce(key.cast("string"), F.lit("null")), F.col("sha1")))
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first"))
    own = F.when(revisit, identity("revisit", F.col("key"))).otherwise(identity("response", F.col("key")))

    def record(kind: Column, identifier: Column, fields: list[tuple[str, Column]], mime: str, block: Column) -> Column:
        """Optional fields are left out where null. Blocks are text, so a record is text and the line separator ends it."""
        head = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), identifier), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
        head += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
        head += [F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block))]
        return F.concat(F.concat_ws(LINE, *head), F.lit(END), block)

    digest, uri = F.concat(F.lit("sha1:"), base32(F.col("sha1"))), F.col("url")
    reply = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), "bytes", F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    response = record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, identity("response", F.col("first")))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        "application/http; msgtype=response", reply,
    )
    request = record(F.lit("request"), identity("request", F.col("key")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")))
    about = F.concat_ws(LINE, F.concat(F.lit("pageId: "), F.col("key").cast("string")), F.concat(F.lit("payloadBytes: "), "bytes"))
    metadata = record(F.lit("metadata"), identity("metadata", F.col("key")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)], "application/warc-fields", about)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    size = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    per_file = max(3, 3 * size["n"] * ARCHIVE_BYTES // max(1, size["bytes"]))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of one archive; each is found by the length of the one before, whatever its payload contains."""
    at, end = 0, len(data)
    while at < end:
        body = data.index(END.encode(), at) + 4
        lines = data[at : body - 4].decode().split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        last = body + int(fields["Content-Length"])
        block = data[body:last]
        http = fields["Content-Type"].startswith("application/http")
        split = block.find(END.encode())
        about = dict(x.split(": ", 1) for x in block.decode().split(LINE) if ": " in x) if fields["WARC-Type"] == "metadata" else {}
        digest = fields.get("WARC-Payload-Digest")
        yield {
            "record_id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "concurrent_to": fields.get("WARC-Concurrent-To"), "refers_to": fields.get("WARC-Refers-To"), "uri": fields.get("WARC-Target-URI"),
            "payload_digest": digest and digest.removeprefix("sha1:"), "fields": list(about.items()), "payload": block[split + 4 :] if http and split >= 0 else block,
        }
        at = last + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder; each archive, whose size the writer bounds, is parsed by one task."""
    kind = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "uri", "payload_digest")] + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = []
            for row in parsed(gzip.decompress(batch.column(0)[0].as_py())):
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(released(each), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: capture(record_id, uri, payload_digest, payload, ...), request, metadata.
    The payload may be left out of `records`.

    A request or metadata record belongs to the capture that it names; a capture without one has null there, and one that
    names no capture is dropped. Of several requests (or metadata records) for one capture the least record id counts.
    """
    captures = records.where(F.col("type").isin("response", "revisit"))
    side = lambda kind, value: records.where(F.col("type") == kind).groupBy("concurrent_to").agg(F.min_by(value, "record_id").alias(kind))
    request = side("request", F.struct("record_id", "uri"))
    metadata = side("metadata", F.col("fields"))
    capture = F.struct(*(c for c in ("record_id", "type", "refers_to", "uri", "payload_digest", "payload") if c in records.columns)).alias("capture")
    joined = captures.select(F.col("record_id").alias("concurrent_to"), capture).join(request, "concurrent_to", "left").join(metadata, "concurrent_to", "left")
    return joined.select("capture", "request", "metadata")


def resolved(found: DataFrame) -> DataFrame:
    """transactions() with `original`: the metadata of the capture that a revisit refers to, null for others and where
    there is none. Identifiers and metadata alone are joined, the captures to them once."""
    known = found.select(F.col("capture.record_id").alias("original_id"), F.col("metadata").alias("original")).where("original_id is not null").dropDuplicates(["original_id"])
    return found.join(known, F.col("capture.refers_to") == F.col("original_id"), "left").drop("original_id")
