"""WARC archives with revisit records.

Headers (page id and payload digest, no payload) are grouped by digest, with partial minima before the shuffle; the
smallest page id of a digest is its original. Records are written by Spark's text writer, whose line separator is the
blank line that ends a WARC record, so commits are atomic and any file system that Spark knows will do. Payloads move
once, by page id, so that no digest gathers them; revisit records carry none. Spark's text reader streams archives,
parted at blank lines, to a parser that goes by Content-Length, so a task holds one record however large an archive is;
revisit records are joined to their originals by record id, and Spark splits hot originals in that join. An archive is
one gzip stream, so its records are read in order only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: When pages were fetched isn't known; one date keeps archives repeatable.
DATE = "2024-01-01T00:00:00Z"
PARSED = "page_id long, record_id string, record_type string, refers_to_id string, payload_digest string, stored_bytes long, whole boolean"


def base32(hexadecimal: Column) -> Column:
    """RFC 4648 base32 of 40 hexadecimal digits (a SHA-1): four groups of 40 bits are eight digits each."""
    digits = []
    for group in range(4):
        bits = F.conv(F.substring(hexadecimal, 10 * group + 1, 10), 16, 10).cast("long")
        digits += [F.lit(BASE32).substr((F.shiftright(bits, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*digits)


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def originals(pages: DataFrame) -> DataFrame:
    """pages with payload (null: empty), sha1 (hexadecimal), first, the smallest page id with an equal payload, and its url. Null
    page ids never are the smallest unless a payload has no other. Rows repeated with equal id and payload all get
    the same role."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    headers = p.groupBy("page_id", "sha1").agg(F.min("url").alias("url"))
    firsts = headers.groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("x")).select("sha1", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"))
    roles = headers.join(firsts, "sha1").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first", "first_url")
    return p.join(roles, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1"))).drop("_page", "_sha1")


def records(pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """One string column: each row a record without the blank line that ends it. Payloads of fewer than min_bytes are
    always written in full. Line breaks in urls, which would break headers, are percent-encoded."""
    size = F.octet_length("payload")
    original = (size < min_bytes) | F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(original, F.concat(http, "payload")).otherwise(http)
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(original, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("sha1"))), F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), uri("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(~original, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first"), F.col("sha1")))), F.when(~original, F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri("first_url"))),
        F.when(~original, F.lit("WARC-Refers-To-Date: " + date)), F.when(~original, F.lit("WARC-Profile: " + PROFILE)),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(original, size).otherwise(0)).cast("string")),
    ]
    return pages.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 10_000, date: str = DATE) -> None:
    """Deduplicated archives with fresh headers. pages: page_id, url, html. records_per_file keeps archives of a handy
    size; an archive of an empty table is empty. date: of all records, as pages carry none. Archives are gzip files."""
    records(originals(pages), min_bytes, date).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


class Parser:
    """Reads records by Content-Length from pieces of archives in order; holds what is left of one record."""

    def __init__(self):
        self.held, self.headers = bytearray(), None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of each record that is whole by now; names are lower-case."""
        self.held += piece
        while True:
            if self.headers is None:
                end = self.held.find(b"\r\n\r\n", len(self.held) - len(self.held.lstrip(b"\r\n")))
                if end < 0:
                    return
                first, *rest = bytes(self.held[:end]).lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError("no WARC record where one should begin")
                self.headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
                del self.held[: end + 4]
            size = int(self.headers["content-length"])
            if len(self.held) < size + 4:
                return
            headers, block, self.headers = self.headers, bytes(self.held[:size]), None
            del self.held[: size + 4]
            yield headers, block

    def close(self) -> None:
        if self.headers is not None or self.held.strip(b"\r\n"):
            raise ValueError("an archive ends within a record")


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: pieces of archives as the reader parts them, at blank lines; their order within a task is the files'."""
    parser = Parser()
    for batch in batches:
        out = []
        for piece in base.utf8(batch.column(0)):
            for headers, block in parser.feed(piece + END.encode()):
                payload = block.partition(b"\r\n\r\n")[2]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                whole = headers["warc-type"] != "response" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                page = headers.get("x-page-id")
                out.append((int(page) if page else None, headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), digest, len(payload), whole))
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "record_id", "record_type", "refers_to_id", "payload_digest", "stored_bytes", "whole"])
    parser.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes (revisit: of its original), payload_digest, record_type, refers_to (the
    original's page id), whole (a response's payload has its digest)."""
    found = spark.read.option("lineSep", END).text(path).mapInArrow(parsed, PARSED)
    sources = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("page_id").alias("refers_to"), F.first("stored_bytes").alias("original_bytes"))
    kept, revisits = found.where("record_type = 'response'"), found.where("record_type <> 'response'")
    resolved = revisits.join(sources, "refers_to_id", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"]
    return kept.select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "whole").unionByName(
        resolved.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "whole").select(out)
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch(spark) + "/warc"
    write(base.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path)


def oracle() -> str:
    """The base32 comes from the hexadecimal SHA-1, five bits at a time."""
    digits = " || ".join(f"substr('{BASE32}', 1 + ((('0x' || substr(h, {10 * g + 1}, 10))::bigint >> {35 - 5 * j}) & 31)::int, 1)" for g in range(4) for j in range(8))
    return f"""with p as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) h from pages),
q as (select *, min(page_id) over (partition by h) first, octet_length(b)::bigint n from p)
select page_id, n as payload_bytes, {digits} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, true as whole from q"""
