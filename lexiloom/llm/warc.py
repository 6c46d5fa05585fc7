"""WARC archives: writing, reading, and revisit resolution by payload digest.

Writing stays in the JVM: a record is a string column and Spark's text writer ends each with
the two CRLFs that the format wants, with atomic task commits to the shared folder. Reading
parses ``Content-Length`` framing in Arrow batches. Only headers are shuffled by digest.

Defined cases. Null payload: an empty payload. Payloads shorter than ``least`` bytes are
always responses. Of rows with equal payloads, the one with the smallest id is the response
(null ids come last); of repeated rows with that same id one is the response and the others
revisit that id, ties by record id. Null url: the record has no target header. A very long
payload (up to the 2 GiB that a value may have) is one record, alone in its file if need be.
Extra columns are ignored, whatever their names. Empty table: an empty archive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

CRLF = "\r\n"
RECORDS_PER_FILE = 20_000
#: Payload bytes that a file may have, unless one record has more: a file is read as one value.
FILE_BYTES = 1 << 30
#: Classes of payload sizes are so many times apart: a full file of any but the least has a sixteenth of the bytes or more.
CLASS_STEP = 16
#: Decisions (two record ids and a url each) are broadcast up to so many bytes, checked; beyond, a shuffle join.
BROADCAST_BYTES = 32 << 20
HEADERS = (
    "record_id string, record_type string, page_id long, target_uri string, warc_date string, "
    "payload_digest string, payload_length long, refers_to string, refers_to_uri string"
)


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def records(df: DataFrame) -> DataFrame:
    """One ``value`` per row of record columns (:data:`HEADERS` and ``payload``), in WARC/1.1 form.

    A response carries its payload as the block, a revisit an empty block.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    clean = F.regexp_replace("target_uri", r"[\r\n]", "")
    return df.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            _header("WARC-Type", F.col("record_type")),
            _header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
            _header("WARC-Date", F.col("warc_date")),
            _header("WARC-Target-URI", clean),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            _header("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
            _header("WARC-Refers-To-Target-URI", F.regexp_replace("refers_to_uri", r"[\r\n]", "")),
            F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(""),
            _header("X-Page-ID", F.col("page_id").cast("string")),
            _header("X-Payload-Length", F.col("payload_length").cast("string")),
            F.lit(f"Content-Type: text/html{CRLF}"),
            _header("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
        ).alias("value")
    )


def size_classes(df: DataFrame) -> list[int]:
    """The classes of payload sizes (:func:`_class_of`) that occur."""
    return sorted(r[0] for r in df.select(_class_of()).distinct().collect())  # at most five


def _class_of() -> Column:
    """How often :data:`CLASS_STEP` the even share of a file's bytes has to grow to hold the payload."""
    out, limit = F.lit(0), FILE_BYTES // RECORDS_PER_FILE
    for k in range(1, 5):
        out, limit = F.when(F.col("payload_length") > limit, k).otherwise(out), limit * CLASS_STEP
    return out


def write_archive(df: DataFrame, where: str, records_per_file: int = RECORDS_PER_FILE, fast: bool = False, classes: list[int] | None = None) -> None:
    """Writes gzipped archive files of at most ``records_per_file`` records each.

    A file is one gzip stream, read from its start. Records of a like size share files: those of
    each class are as many a file as stay within :data:`FILE_BYTES` at the class's largest, so a
    large payload changes no other class's files. Each class that occurs is a pass over ``df``.
    """
    classes = size_classes(df) if classes is None else classes
    for k, n in enumerate(classes or [0]):
        most = max(1, min(records_per_file, RECORDS_PER_FILE // CLASS_STEP**n))
        (
            records(df.where(_class_of() == n))
            .write.option("compression", "gzip")
            .option("zlib.compress.level", "BEST_SPEED" if fast else "DEFAULT_COMPRESSION")
            .option("lineSep", CRLF * 2)
            .option("maxRecordsPerFile", most)
            .mode("append" if k else "overwrite")
            .text(where)
        )


class _Inflater:
    """Reads lines and exact byte counts from gzipped bytes, inflating piece by piece."""

    def __init__(self, packed: memoryview, piece: int = 1 << 18):
        self.packed, self.piece, self.at = packed, piece, 0
        self.zip = zlib.decompressobj(31)
        self.have = bytearray()
        self.pos = 0

    def _more(self) -> bool:
        while self.at < len(self.packed):
            part = self.zip.decompress(self.packed[self.at : self.at + self.piece])
            self.at += self.piece
            while self.zip.eof and self.zip.unused_data:
                rest = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
                part += self.zip.decompress(rest)
            if part:
                if self.pos:
                    del self.have[: self.pos]
                    self.pos = 0
                self.have += part
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.have) - self.pos < n and self._more():
            pass
        if len(self.have) - self.pos < n:
            raise ValueError("a record is cut short")
        out = bytes(memoryview(self.have)[self.pos : self.pos + n])
        self.pos += n
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is consumed; None at the end of the archive."""
        seen = self.pos
        while (at := self.have.find(mark, seen)) < 0:
            left = len(self.have) - self.pos
            if not self._more():
                if left:
                    raise ValueError("a header is cut short")
                return None
            seen = max(self.pos, self.pos + left - len(mark) + 1)
        out = bytes(memoryview(self.have)[self.pos : at])
        self.pos = at + len(mark)
        return out


def parse(packed: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one gzipped archive file."""
    source = _Inflater(memoryview(packed))
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        block = source.take(int(fields["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def read_archive(spark: SparkSession, where: str, payload: bool = True) -> DataFrame:
    """Records of the archive files in ``where``; without ``payload`` only headers leave Python."""
    names = [x.split()[0] for x in HEADERS.split(", ")] + ["payload"] * payload
    kinds = {"page_id": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in source:
            for content in batch.column("content"):
                for f, block in parse(content.as_buffer()):
                    page, length, digest = f.get("X-Page-ID"), f.get("X-Payload-Length"), f.get("WARC-Payload-Digest")
                    row = (
                        _bare(f.get("WARC-Record-ID")), f.get("WARC-Type"), page and int(page), f.get("WARC-Target-URI"), f.get("WARC-Date"),
                        digest and digest.rpartition(":")[2], int(length) if length else len(block), _bare(f.get("WARC-Refers-To")), f.get("WARC-Refers-To-Target-URI"),
                    )
                    rows.append((*row, block) if payload else row)
                    held += len(block) if payload else 200
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(where).select("content")
    return scratch.arrow(files, read, HEADERS + (", payload binary" if payload else ""))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def responses(headers: DataFrame, least: int = 100) -> DataFrame:
    """Which record each revisit refers to: headers shuffled by payload digest.

    One row per digest that occurs more than once: digest, record and page of the response.
    The aggregate is partial before its shuffle, so a digest with a third of all rows sends
    one row per task.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "record_id", "target_uri"))
    return (
        headers.where(F.col("payload_length") >= least)
        .groupBy("payload_digest")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .where("n > 1")
        .select("payload_digest", F.col("first.record_id").alias("response_id"), F.col("first.page_id").alias("response_page"), F.col("first.target_uri").alias("response_uri"))
    )


def revisits(headers: DataFrame, least: int = 100) -> DataFrame:
    """(record_id, response_id, response_uri) of each record that repeats an earlier payload.

    The response table is written first, so the join's two sides are plain shuffles and
    adaptive execution can split a hot digest.
    """
    found = scratch.keep(responses(headers, least), "responses")
    return (
        headers.where(F.col("payload_length") >= least)
        .select("record_id", "payload_digest")
        .join(found, "payload_digest")
        .where("record_id <> response_id")
        .select("record_id", "response_id", "response_uri")
    )


def deduplicate(raw: DataFrame, headers: DataFrame, least: int = 100) -> DataFrame:
    """Records with revisits resolved and fresh headers; payloads meet the decisions by record id.

    Few decisions go to the payloads; many are shuffled with them, on an even key.
    """
    again = F.col("response_id").isNotNull()
    decided = scratch.keep(revisits(headers, least), "revisits")
    size = decided.agg(F.sum(100 + F.octet_length("record_id") + F.octet_length("response_id") + F.coalesce(F.octet_length("response_uri"), F.lit(0)))).first()[0] or 0
    decided = F.broadcast(decided) if size <= BROADCAST_BYTES else decided.hint("merge")
    return raw.join(decided, "record_id", "left").select(
        "record_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "page_id", "target_uri", "warc_date", "payload_digest", "payload_length",
        F.col("response_id").alias("refers_to"),
        F.col("response_uri").alias("refers_to_uri"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html). Repeated rows get record ids of their own."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), text.alias("payload")).select(
        F.concat(F.lit("urn:uuid:"), F.expr("uuid()")).alias("record_id"),
        F.lit("response").alias("record_type"),
        "page_id", "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        digest_of("payload").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_uri"),
        "payload",
    )


def digest_of(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def resolve(archive: DataFrame) -> DataFrame:
    """Page-level view of a deduplicated archive: each revisit with its response's page."""
    columns = ["page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("found_page").alias("refers_to"), "record_id"]
    kept, again = archive.where("record_type = 'response'"), archive.where("record_type = 'revisit'")
    target = kept.select(F.col("record_id").alias("found_id"), F.col("page_id").alias("found_page"))
    return kept.withColumn("found_page", F.lit(None).cast("long")).select(columns).unionByName(again.join(target, F.col("refers_to") == F.col("found_id"), "left").select(columns))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes an archive of the pages, resolves revisits, writes the deduplicated archive with
    fresh headers, reads it back and resolves each revisit to its response."""
    spark = pages.sparkSession
    first, second = scratch.path(spark, "warc"), scratch.path(spark, "warc-deduplicated")
    classes = size_classes(from_pages(pages))
    write_archive(from_pages(pages), first, fast=True, classes=classes)  # read once and dropped
    headers = scratch.keep(read_archive(spark, first, payload=False), "headers")
    raw = read_archive(spark, first).withColumn("payload", F.col("payload").cast("string"))
    write_archive(deduplicate(raw, headers, least), second, classes=classes)
    scratch.drop(spark, first)
    again = scratch.keep(read_archive(spark, second, payload=False), "headers-deduplicated")
    return resolve(again)
