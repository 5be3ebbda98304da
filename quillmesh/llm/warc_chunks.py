"""WARC archives through a chunked record table.

A payload becomes rows of (record, chunk number, bytes), each with the digest of the payload so far, so that no step holds a
whole record. A chunk is one WARC record, its later ones ``continuation`` records with segment numbers, and one member of a
gzip file, so that readers can seek to it. Spark's text writer puts the members into files, with an empty member as the
separator of its lines; its text reader returns the records one by one. The parser goes by Content-Length, so that a payload
that itself holds WARC headers stays whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch

#: Bytes of payload in a row.
CHUNK = 1 << 20
#: Rows and bytes after which a task hands chunks on.
BATCH_ROWS, BATCH_BYTES = 64, 4 << 20
#: A gzip member of no bytes.
EMPTY = gzip.compress(b"", mtime=0).decode("latin-1")
VERSION = "WARC/1.1"
LINE = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
CHUNK_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.binary()), ("so_far", pa.string()), ("copy", pa.int64())])
READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("so_far", pa.string()), ("read", pa.int64())])
CHUNKS = "page_id bigint, url string, digest string, bytes bigint, chunk int, chunks int, data binary, so_far string, copy bigint"


def base32_sha1(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _batched(rows: Iterator[tuple], schema: pa.Schema, data: int) -> Iterator[pa.RecordBatch]:
    """Record batches of few rows and bytes; column ``data`` holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunk_table(pages: DataFrame, size: int = CHUNK, payloads: bool = True) -> DataFrame:
    """Chunk rows of each page's html in UTF-8: ``so_far`` is the SHA-1 of chunks up to this one, ``digest`` that of all.
    ``copy`` is the number of the row they come from, which tells repeated rows apart.

    Null html is an empty payload of one empty chunk. Without ``payloads`` only the first row of each page, without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = (TaskContext.get().partitionId() << 40) - 1

        def rows() -> Iterator[tuple]:
            nonlocal copy
            for batch in batches:
                for page, url, cell in zip(*(batch.column(c) for c in ("page_id", "url", "body")), strict=True):
                    view, copy = memoryview(cell.as_buffer() if cell.is_valid else b""), copy + 1  # the cell's own bytes
                    sha, marks = hashlib.sha1(), []
                    for k in range(0, max(len(view), 1), size):
                        sha.update(view[k : k + size])
                        marks.append(base32_sha1(sha))
                    for k, mark in enumerate(marks if payloads else marks[:1]):
                        data = bytes(view[k * size : (k + 1) * size]) if payloads else b""
                        yield page.as_py(), url.as_py(), marks[-1], len(view), k, len(marks), data, mark, copy

        yield from _batched(rows(), CHUNK_SCHEMA, 6)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, CHUNKS)


def _record(page, url, digest, size, chunk, chunks, data, so_far, first) -> bytes:
    """A chunk's WARC record: a ``revisit`` without block if ``first`` names the page that holds the payload."""
    name = lambda p, end=">": f"<urn:page:{'null' if p is None else p}:{digest}{end}"
    again = first is not None
    head = [
        ("WARC-Type", "revisit" if again else "continuation" if chunk else "response"),
        ("WARC-Record-ID", name(page, f":{chunk + 1}>") if chunk else name(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else "".join(quote(c) if c in "\r\n\t " else c for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Bytes", size),
        ("X-Page-ID", page),
    ]
    if again:
        head += [("WARC-Refers-To", name(first)), ("X-Refers-To-Page", first), ("WARC-Profile", REVISIT)]
    else:
        if chunks > 1:
            head.append(("WARC-Segment-Number", chunk + 1))
        if chunk:
            head.append(("WARC-Segment-Origin-ID", name(page)))
            if chunk + 1 == chunks:
                head.append(("WARC-Segment-Total-Length", size))
        head.append(("X-Digest-So-Far", f"sha1:{so_far}"))
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(data))]
    lines = [VERSION, *(f"{k}: {v}" for k, v in head if v is not None)]
    return (LINE.join(lines) + LINE * 2).encode("utf-8", "replace") + data + (LINE * 2).encode()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One gzip member for each record."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield (gzip.compress(_record(*(c.as_py() for c in row)), mtime=0),)

    yield from _batched(rows(), pa.schema([("value", pa.binary())]), 0)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes gzip WARC files. Of records with equal payloads of ``least_bytes`` or more, that of the smallest page_id is the
    response and the others revisit it; rows that agree in page_id and payload are one record each, of the same type."""
    digests = chunk_table(pages, payloads=False).where(F.col("bytes") >= least_bytes).select("digest", "page_id")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    role = digests.join(first, "digest").where("page_id is null or page_id != first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    chunks = chunk_table(pages)
    rows = chunks.join(role, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull()
    rows = rows.where(~again | (F.col("chunk") == 0)).withColumn("data", F.when(again, F.lit(b"")).otherwise(F.col("data")))
    # the chunks of a record follow each other in one file, those of repeated rows one row after the other
    rows = rows.sortWithinPartitions("page_id", "digest", "copy", "chunk")
    members = rows.select("page_id", "url", "digest", "bytes", "chunk", "chunks", "data", "so_far", "first").mapInArrow(_members, "value binary")
    # text is written byte for byte
    members.select(F.col("value").cast("string")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Names the written files for what they hold, as readers go by the name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        old = status.getPath()
        if old.getName().startswith("part-"):
            new = spark._jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + ".warc.gz")
            if not files.rename(old, new):
                raise OSError(f"cannot rename {old.getName()}")


def _records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in a stream that was cut at each LINE VERSION LINE."""
    cut = f"{LINE}{VERSION}{LINE}".encode()
    start = f"{VERSION}{LINE}".encode()
    for line in lines:
        raw = line.removeprefix(start)
        while (end := raw.find(b"\r\n\r\n")) < 0:
            raw += cut + next(lines)
        headers = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in HEADER.findall(raw[: end + 2])}
        length = int(headers.get("content-length", 0))
        block = raw[end + 4 :]
        while len(block) < length:  # the cut lay inside the block
            block += cut + next(lines)
        yield headers, block[:length]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Chunk rows of gzip WARC files: page_id, record_type, digest, bytes, refers_to, chunk, data, so_far, read, as read.

    ``so_far`` is computed anew from the blocks, ``read`` is a block's length; without ``payloads`` ``data`` is null. A gzip
    file is one task's stream, in order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lines = (x.as_py() for b in batches for x in b.column("value"))
        sha = hashlib.sha1()
        for h, block in _records(lines):
            number = lambda k: int(v) if (v := h.get(k, "")).lstrip("-").isdigit() else None  # noqa: B023, E731
            chunk = (number("warc-segment-number") or 1) - 1
            if chunk == 0:
                sha = hashlib.sha1()
            sha.update(block)
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
            yield number("x-page-id"), h.get("warc-type"), digest, number("x-payload-bytes"), number("x-refers-to-page"), chunk, block if payloads else None, base32_sha1(sha), len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), READ_SCHEMA, 6)

    lines = spark.read.option("lineSep", f"{LINE}{VERSION}{LINE}").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, "page_id bigint, record_type string, digest string, bytes bigint, refers_to bigint, chunk int, data binary, so_far string, read bigint")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records written to ``path`` and read back.

    One row per row of ``pages``. A response's bytes and digest are those of the blocks read, and must agree with its header;
    a revisit's are its header's. Null html is an empty payload; a null page_id stays null and is never the smallest unless
    all of a payload's ids are null, and then all are responses; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{Scratch(spark).root}/archives"
    write_archives(pages, path, least_bytes)
    chunks = read_archives(spark, path, payloads=False)
    whole = chunks.groupBy("page_id", "digest", "chunk").agg(
        F.count("*").alias("copies"), F.min("record_type").alias("record_type"), F.min("bytes").alias("bytes"), F.min("refers_to").alias("refers_to"), F.min("read").alias("read"), F.max("so_far").alias("so_far")
    )
    record = whole.groupBy("page_id", "digest").agg(
        F.min_by("copies", "chunk").alias("copies"), F.min_by("record_type", "chunk").alias("record_type"), F.min("bytes").alias("bytes"), F.min("refers_to").alias("refers_to"), F.sum("read").alias("read"), F.max_by("so_far", "chunk").alias("so_far")
    )
    revisit = F.col("record_type") == "revisit"
    sound = revisit | ((F.col("read") == F.col("bytes")) & (F.col("so_far") == F.col("digest")))
    checked = lambda good: F.when(sound, good).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    out = record.select(
        "page_id", F.when(revisit, F.col("bytes")).otherwise(F.col("read")).alias("payload_bytes"), checked(F.when(revisit, F.col("digest")).otherwise(F.col("so_far"))).alias("payload_digest"),
        "record_type", "refers_to", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
