"""WARC archives over a chunked record table.

A payload is a run of rows (record, chunk number, bytes), none longer than CHUNK, and each carries the
digest and length of the payload up to its end, so no task ever holds more than a chunk beside the
row it reads. In the archive a chunk is a WARC record: a payload of several chunks becomes a response
record with segment number 1 and continuation records that name it as their origin.

Archives are gzip files, written and read by Spark's text source, on any file system that Spark knows: the writer
ends each row with the empty lines that end a WARC record, and the reader cuts at the version line
that begins one. A chunk is also cut inside any version line that stands in a payload, so the cut is
exact for these archives; `parse` reads any archive by its content lengths.

Null payloads count as empty and null urls leave out the target. Rows that repeat, even with the page id,
stay records of their own. Of equal payloads of SMALLEST bytes or more the one with the smallest page id
is the response, of rows with that same id any one; null page ids come last.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import count
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, utf8

CHUNK = 1 << 20
SMALLEST = 100
VERSION = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def cuts(payload: memoryview | bytes, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of the payload's chunks: at most `size` bytes, and no version line within one. An empty payload is one empty chunk."""
    view, start, end = memoryview(payload), 0, len(payload)
    while True:
        stop = min(end, start + size)
        at = bytes(view[start:stop]).find(VERSION)
        if at >= 0:
            stop = start + at + 4
        yield start, stop
        start = stop
        if start >= end:
            return


CHUNK_SCHEMA = "record string, page_id long, url string, chunk int, last boolean, data binary, so_far long, digest string"


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk rows of pages (page_id, url, html), with running lengths and SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                record, running = str(uuid.uuid4()), hashlib.sha256()
                for k, (a, b) in enumerate(cuts(payload, size)):
                    data = payload[a:b]
                    running.update(data)
                    rows.append((record, page, url, k, b >= len(payload), data, b, running.hexdigest()))
                    held += b - a
                    if held >= 4 * size:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, CHUNK_SCHEMA)


def record_types(chunks: DataFrame) -> DataFrame:
    """(record, digest, bytes, kind, origin, origin_page): which records are responses, and what the others revisit."""
    done = chunks.where("last").select("record", "page_id", "digest", F.col("so_far").alias("bytes"))
    keeper = done.where(F.col("bytes") >= SMALLEST).groupBy("digest", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")).alias("keeper"))
    out = done.join(keeper, ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & (F.col("keeper.record") != F.col("record"))
    return out.select(
        "record", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("keeper.record")).alias("origin"), F.when(revisit, F.col("keeper.page_id")).alias("origin_page"),
    )


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the chunk table as WARC files. Revisit records hold no payload."""
    crlf = F.lit("\r\n")
    kinds = record_types(chunks)
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), crlf)
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    rows = chunks.drop("digest").join(kinds, "record").where("kind = 'response' or chunk = 0")
    revisit, first, single = F.col("kind") == "revisit", F.col("chunk") == 0, F.col("last") & (F.col("chunk") == 0)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("").cast("binary")).when(first, F.concat(F.encode(http, "UTF-8"), "data")).otherwise(F.col("data"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, urn("record")).otherwise(F.concat(F.lit("<urn:uuid:"), "record", F.lit("#"), F.col("chunk").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", url),
        optional("Glyphmill-Page-Id", F.col("page_id")),
        optional("WARC-Refers-To", urn("origin")),
        optional("Glyphmill-Refers-To-Page-Id", F.col("origin_page")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))).otherwise(""),
        F.when(~single & ~revisit, line("WARC-Segment-Number", F.col("chunk") + 1)).otherwise(""),
        F.when(~first, line("WARC-Segment-Origin-ID", urn("record"))).otherwise(""),
        F.when(~first & F.col("last"), line("WARC-Segment-Total-Length", F.col("bytes"))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.when(first, "application/http; msgtype=response").otherwise("application/octet-stream")),
        line("Content-Length", F.octet_length("body")),
    )
    rows = rows.withColumn("body", body).select(F.concat(F.encode(head, "UTF-8"), F.encode(crlf, "UTF-8"), "body").cast("string").alias("value"))
    rows.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n") if b":" in x)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed archive, by content length."""
    while line := stream.readline():
        if line.strip():
            lines = []
            while (x := stream.readline()).strip():
                lines.append(x)
            head = _fields(b"".join(lines))
            yield head, stream.read(int(head["content-length"]))


PARSED_SCHEMA = "record string, page_id long, kind string, segment int, data binary, bytes long, digest string, origin string, origin_page long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARSED_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    urn = lambda x: x[10:-1] if x else None
    number = lambda x: int(x) if x else None
    for batch in batches:
        rows = []
        for raw in utf8(batch.column(0)):
            if not raw.strip():
                continue
            head, _, rest = raw.partition(END)
            f = _fields(head)
            block = memoryview(rest)[: int(f["content-length"])]
            segment, kind = number(f.get("warc-segment-number")), f["warc-type"]
            if kind == "response":
                block = block[rest.find(END) + len(END) :]
            size = digest = data = None
            if kind == "response" and segment is None:
                size, digest = len(block), hashlib.sha256(block).hexdigest()
            elif kind != "revisit":
                data = bytes(block)
            rows.append((urn(f.get("warc-segment-origin-id") or f["warc-record-id"]), number(f.get("glyphmill-page-id")), kind, segment, data, size, digest, urn(f.get("warc-refers-to")), number(f.get("glyphmill-refers-to-page-id"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of each record whose segments come in order; only the digest's state is kept."""
    now, page, size, running = None, None, 0, None
    numbers = count(1)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.string()), (page, pa.int64()), (size, pa.int64()), (running.hexdigest(), pa.string()))], ["record", "page_id", "bytes", "digest"])

    for batch in batches:
        for record, page_id, segment, data in zip(*(c.to_pylist() for c in batch.columns)):
            if record != now:
                if now is not None:
                    yield done()
                now, page, size, running, numbers = record, page_id, 0, hashlib.sha256(), count(1)
            if segment != next(numbers):
                raise ValueError(f"a segment of record {record} is missing or doubled")
            running.update(data)
            size += len(data)
    if now is not None:
        yield done()


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, digests computed anew.

    A revisit record takes length and digest from the payload that it refers to.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).schema("value string").text(path)
    parsed = scratch.put(raw.mapInArrow(_parsed, PARSED_SCHEMA), "parsed")
    whole = parsed.where("kind = 'response' and segment is null").select("record", "page_id", "bytes", "digest")
    parts = parsed.where("segment is not null").select("record", "page_id", "segment", "data")
    parts = parts.repartition(F.col("record")).sortWithinPartitions("record", "segment")
    responses = whole.unionByName(parts.mapInArrow(_joined, "record string, page_id long, bytes long, digest string"))
    responses = scratch.put(responses, "responses")
    revisits = parsed.where("kind = 'revisit'").select("page_id", F.col("origin").alias("record"), "origin_page")
    revisits = revisits.join(responses.select("record", "bytes", "digest"), "record", "left")
    columns = lambda kind, origin: ("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(kind).alias("record_type"), origin.cast("long").alias("refers_to"))
    return responses.select(*columns("response", F.lit(None))).unionByName(revisits.select(*columns("revisit", F.col("origin_page"))))


def round_trip(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    chunks = scratch.put(chunk_table(pages, size), "chunks", compression="zstd")
    write_archives(chunks, f"{scratch.root}/archives")
    scratch.drop("chunks")
    return read_archives(spark, f"{scratch.root}/archives", scratch)
