"""WARC records as a chunked record table.

A record is streamed as rows (archive, record, chunk, data, payload_sha1): data of at most CHUNK bytes, the
record's header in its first chunk, and the SHA-1 of the payload up to and including that chunk. Neither the
writer nor the reader builds a whole record: the writer encodes slices of the page, the reader follows the
chunks of a record in order, across batches, and keeps only the running digest. Concatenating an archive's
chunks in order gives a plain WARC 1.1 file.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is the response
and the others are revisits of it without a payload block.

Defined cases: a null html is an empty payload; a null url gives a record without a target; pages that share the
largest page_id of a group of equal payloads are all responses; a page with a null page_id never takes part in
revisits; repeated rows get records of their own; an empty table gives an archive without records; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, settle, small_batches, small_side

CHUNK = 256 * 1024
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CHUNK_ROWS = "archive int, record long, chunk int, data binary, payload_sha1 string"
RECORD_ROWS = "archive int, record long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, intact boolean"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _header(kind: str, record: int, page_id, url, refers_to, payload_bytes: int, digest: str, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{record}:{page_id}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunk_rows(archive: int, record: int, page_id, url, html: str, payload_bytes: int, digest: str, refers_to):
    """The rows of one record; html is encoded a slice at a time."""
    kind = "response" if refers_to is None else "revisit"
    buffer = _header(kind, record, page_id, url, refers_to, payload_bytes, digest, payload_bytes if refers_to is None else 0)
    running, number = hashlib.sha1(), 0
    if refers_to is None:
        for at in range(0, len(html), CHUNK // 4):  # a character has at most four bytes
            piece = html[at : at + CHUNK // 4].encode("utf-8", "surrogatepass")
            running.update(piece)
            yield archive, record, number, buffer + piece, running.hexdigest()
            buffer, number = b"", number + 1
    yield archive, record, number, buffer + b"\r\n\r\n", running.hexdigest()


def plan_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, payload_bytes, payload_digest, refers_to.

    Digests are taken in the JVM; groups of equal payloads are summed up before the shuffle, and what a page refers to is
    found without its html, and then joined by page: copies of one payload never meet in one task, and where there are few
    revisits the html is not shuffled either.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
    slim = kept(rows.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "payload_digest", "payload_bytes"), "digests")
    group = ["payload_digest", "payload_bytes"]
    groups = slim.groupBy(*group).agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).filter("first > last").drop("last")
    revisits = kept(slim.join(groups, group).filter("page_id < first").select("page_id", *group, F.col("first").alias("refers_to")).distinct(), "revisits")
    rows = rows.join(small_side(revisits), ["page_id", *group], "left")
    return rows.select("page_id", "url", "html", *group[::-1], "refers_to")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every page's record and return the chunk table, which lies in the shared folder."""
    small_batches(pages.sparkSession, 500)
    rows = plan_records(pages).withColumn("archive", F.spark_partition_id()).withColumn("record", F.monotonically_increasing_id())

    def write(batches):
        for pdf in batches:
            out, size = [], 0
            for r in pdf.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                for row in chunk_rows(r.archive, r.record, page_id, r.url, r.html, r.payload_bytes, r.payload_digest, refers_to):
                    out.append(row)
                    size += len(row[3])
                    if size > 8 * CHUNK:
                        yield pd.DataFrame(out, columns=["archive", "record", "chunk", "data", "payload_sha1"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["archive", "record", "chunk", "data", "payload_sha1"])

    return settle(rows.mapInPandas(write, CHUNK_ROWS), "warc")


class _Record:
    """What is kept of the record whose chunks pass by."""

    def __init__(self, archive: int, record: int):
        self.archive, self.record, self.head, self.fields = archive, record, b"", None
        self.sha1, self.got, self.tail, self.next, self.intact = hashlib.sha1(), 0, b"", 0, True

    def feed(self, number: int, data: bytes, running: str) -> None:
        self.intact &= number == self.next
        self.next += 1
        if self.fields is None:
            self.head += data
            head, sep, data = self.head.partition(b"\r\n\r\n")
            if not sep:
                return
            lines = head.decode().split("\r\n")
            self.intact &= lines[0].startswith("WARC/1.")
            self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            self.head = b""
        rest = int(self.fields["content-length"]) - self.got
        self.sha1.update(data[:rest])
        self.got += len(data[:rest])
        self.tail += data[rest:]
        self.intact &= self.sha1.hexdigest() == running

    def row(self):
        f = self.fields or {}
        number = lambda k: int(f[k]) if k in f else None
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        whole = self.tail == b"\r\n\r\n" and self.got == number("content-length")
        if f.get("warc-type") == "response":
            size, found = self.got, self.sha1.hexdigest()
            whole = whole and found == digest
        else:
            size, found = number("x-payload-length"), digest
        return self.archive, self.record, f.get("warc-type"), number("x-page-id"), f.get("warc-target-uri"), number("x-refers-to-page-id"), size, found, bool(self.intact and whole)


def read_archives(chunks: DataFrame) -> DataFrame:
    """The chunk table read back: one row a record, each digest taken again from the payload bytes."""
    small_batches(chunks.sparkSession, 500)
    names = [x.split(" ")[0] for x in RECORD_ROWS.split(", ")]

    def read(batches):
        now, out = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if now is None or (now.archive, now.record) != (r.archive, r.record):
                    if now is not None:
                        out.append(now.row())
                    now = _Record(r.archive, r.record)
                now.feed(r.chunk, bytes(r.data), r.payload_sha1)
            yield typed(out)
            out = []
        if now is not None:
            yield typed([now.row()])

    def typed(rows):
        pdf = pd.DataFrame(rows, columns=names)
        return pdf.astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})

    dealt = chunks.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return dealt.mapInPandas(read, RECORD_ROWS)


def file_bytes(chunks: DataFrame, archive: int):
    """One archive as a stream of byte strings, in order: a plain WARC file."""
    for r in chunks.filter(F.col("archive") == archive).orderBy("record", "chunk").toLocalIterator():
        yield bytes(r["data"])


def parse(data: bytes):
    """(fields, payload) of each record of a plain WARC file held in memory; for tests and small files."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(re.findall(r"(?m)^([\w-]+): (.*?)\r?$", data[at:end].decode()))
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m
"""
