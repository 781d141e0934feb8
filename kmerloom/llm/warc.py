"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records: the response (or a revisit, where an equal payload is stored
elsewhere), and a request and a metadata record that name it as concurrent to them. Archives are
written and read through Spark's own file sources, so they may lie in any store Spark knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, lean

CRLF = "\r\n"
MAX_BROADCAST_REVISITS = 1_000_000
#: Pages of at most so many bytes of payload, and how many of them share an archive: half a GB at most,
#: as a file is read whole. Larger pages have an archive each.
ARCHIVES = ((1 << 16, 8_000), (1 << 22, 128), (1 << 31, 1))
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(ident: Column, kind: str) -> Column:
    h = F.md5(F.concat(ident.cast("string"), F.lit(":" + kind)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, ident: Column, url: Column, date: str, content_type: str, block: Column, *extra: Column) -> Column:
    """One record up to its block; the writer's line separator adds the two closing line ends.

    Optional header lines are null where they are absent; concat_ws leaves those out.
    """
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), _urn(ident, kind if kind in ("request", "metadata") else "response")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), *extra, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the three records of each row of pages as gzip archives under path.

    Of rows with equal payloads of at least min_revisit_bytes, the one with the largest id (of equal
    ids the last row) is a response and the others are revisits of it. Equality is that of SHA-1 and
    length; the largest id is a partial aggregate, and only row numbers and digests are joined, so a
    payload shared by a third of the pages meets in no task. Rows are numbered in a written copy of
    the table, which goes when the archives are there; record ids are made of the row's number, so
    rows with a null or repeated id are captures of their own. Null payloads are empty, a null URL is
    an empty one. Line ends in URLs, which would end the header, become blanks. Spark's text sink
    compresses an archive as a whole, not record by record.
    """
    spark = pages.sparkSession
    sha = F.sha1(F.col("body").cast("binary"))
    base = pages.select(F.col(page_id).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]", " ").alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    with Scratch(spark, "warc-pages") as write:
        base = write(base.withColumns({"row": F.monotonically_increasing_id(), "sha": sha, "n": F.octet_length("body").cast("long")}), "pages")
        large = base.filter(F.col("n") >= min_revisit_bytes)
        original = write(large.groupBy("sha", "n").agg(F.max(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "originals")
        # Payloads with many copies are few (fewer than 50,000), so their copies stay where they are.
        many = max(256, (original.agg(F.sum("copies")).first()[0] or 0) // 50_000)
        digest = large.select("row", "sha", "n")
        hot = F.broadcast(original.filter(F.col("copies") > many).select("sha", "n", "first"))
        rest = digest.join(hot.select("sha", "n"), ["sha", "n"], "left_anti").join(original.filter(F.col("copies") <= many).select("sha", "n", "first"), ["sha", "n"])
        revisits = digest.join(hot, ["sha", "n"]).unionByName(rest).filter(F.col("row") != F.col("first.row")).select("row", "first")
        revisits = write(revisits, "revisits")
        # The payloads are shuffled only if the revisits (32 bytes each) are too many to broadcast.
        revisits = F.broadcast(revisits) if revisits.count() <= MAX_BROADCAST_REVISITS else revisits
        records = _records(base.join(revisits, "row", "left"), date)
        least = -1
        for most, together in ARCHIVES:
            part = records.filter((F.col("n") > least) & (F.col("n") <= most)).select("value")
            if least < 0 or base.filter(F.col("n") > least).head(1):
                part.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * together).text(path)
            least = most


def _records(rows: DataFrame, date: str) -> DataFrame:
    """n, value: the three records of rows (row, id, uri, body, sha, n, first)."""
    ident, uri, first = F.col("row"), F.col("uri"), F.col("first")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF * 2))
    digest_line = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha"))
    page_line = F.concat(F.lit("WARC-Page-Id: "), F.col("id").cast("string"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), _urn(ident, "response"))
    response = _record("response", ident, uri, date, "application/http; msgtype=response", F.concat(http, F.col("body")), page_line, digest_line)
    revisit = _record(
        "revisit", ident, uri, date, "application/http; msgtype=response", http, page_line, digest_line, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"),
        F.concat(F.lit("WARC-Refers-To: "), _urn(first["row"], "response")), F.concat(F.lit("WARC-Refers-To-Page: "), first["id"].cast("string")),
    )
    path_part = F.regexp_replace(uri, "^[a-z]+://[^/]*", "")
    host = F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1)
    request = _record("request", ident, uri, date, "application/http; msgtype=request", F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)), concurrent)
    metadata = _record("metadata", ident, uri, date, "application/warc-fields", F.concat(F.lit("payload-bytes: "), F.octet_length("body").cast("string"), F.lit(CRLF)), concurrent)
    main = F.when(first.isNull(), response).otherwise(revisit)
    return rows.select("n", F.explode(F.array(request, main, metadata)).alias("value"))


def _parse(stream: io.BufferedIOBase):
    """(headers, block) of every record of an open archive; blocks are read by Content-Length."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        yield headers, block


RECORDS = "record_id string, concurrent_to string, type string, uri string, date string, content_type string, page_id long, digest string, refers_to string, refers_to_page long, http_headers string, payload binary, declared_bytes long, payload_sha1 string, intact boolean"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path, all files but those that Spark takes as hidden. A
    file is parsed by one task, record by record.

    payload_sha1 is that of the payload as read; intact tells whether a response's is the one that its
    header declares (null for other records, and without such a header).
    """

    bound_batches(spark)

    @lean
    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                raw = io.BytesIO(content)
                rows: list[tuple] = []
                held = 0
                for h, block in _parse(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
                    http, payload, declared = None, block, len(block)
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                        declared = next((int(x.split(":", 1)[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), len(payload))
                    number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
                    declared_sha = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    own_sha = hashlib.sha1(payload).hexdigest()
                    intact = own_sha == declared_sha if declared_sha and h.get("warc-type") == "response" else None
                    rows.append((h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), number("warc-page-id"), declared_sha, h.get("warc-refers-to"), number("warc-refers-to-page"), http, payload, declared, own_sha, intact))
                    held += len(block)
                    if held > 8_000_000 or len(rows) >= 2_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null if absent).

    Request and metadata records name the capture in WARC-Concurrent-To; a response or revisit is
    its own capture. All three meet by one shuffle on the capture's id. Records of other types,
    and those that name no capture, are left out. If a kind comes twice for a capture, the one
    with the smallest record id is kept.
    """
    own = F.col("type").isin("response", "revisit")
    keyed = records.filter("type in ('response', 'revisit', 'request', 'metadata')").withColumn("capture_id", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture_id is not null")
    body = F.struct("type", "uri", "date", "page_id", "digest", "refers_to", "refers_to_page", "http_headers", "declared_bytes", "payload_sha1", "intact", "payload")
    side = F.struct("record_id", "uri", "date", "http_headers", "payload")

    def one(kind: Column, value: Column) -> Column:
        return F.min_by(F.when(kind, value), F.when(kind, F.col("record_id")))

    return keyed.groupBy("capture_id").agg(
        one(own, body).alias("response"), one(F.col("type") == "request", side).alias("request"), one(F.col("type") == "metadata", side).alias("metadata")
    )
