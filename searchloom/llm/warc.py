"""WARC: deduplicated archives. Records with equal payloads become one response and revisits that refer to it.

Headers (key, digest, size) meet by payload digest and revisits join their original response; payloads stay out of that
shuffle. Decisions come back to the pages by broadcast while they are few, by their key beyond. A sink writes the
records, with fresh headers, to files bounded by bytes, each record a gzip member of its own as WARC readers expect;
files become visible when the job commits, and a task that is run again leaves no double. Archives are read back as
whole files and parsed record by record, members being inflated as they come, and digests are computed anew.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from searchloom.llm._shared import Scratch, stage

FILE_BYTES = 32 << 20  # of a file, as written; a larger record has a file of its own
FEW_BYTES = 32 << 20  # of revisits that are broadcast to the pages
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id string, record_type string, url string, payload_digest string, refers_to string, payload binary"


def base32(digest: Column) -> Column:
    """The upper-case base32 of a 160-bit digest given in hex: four characters for every five hex digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to; columns of these names are replaced.

    Of rows whose payloads (null: empty) are equal and have at least least_bytes bytes, the one of the largest key is
    the response and the others revisit it. Smaller ones are all responses. Rows that repeat a key and its payload
    are the same capture, so all of them are responses; a row with a null key is a response too.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    full = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.drop("payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = pages.withColumn("payload_bytes", F.octet_length(full).cast("long")).withColumn("payload_digest", base32(F.sha1(full.cast("binary"))))
    heads = pages.select(F.col(key).alias("__key"), F.col("payload_digest").alias("__digest"), "payload_bytes").where((F.col("payload_bytes") >= least_bytes) & F.col(key).isNotNull())
    first = heads.groupBy("__digest").agg(F.max("__key").alias("__first"))
    revisits = scratch.stage(heads.join(first, "__digest").where("__key < __first").select("__key", "__digest", "__first").distinct(), "revisits")
    size = revisits.agg(F.sum(F.octet_length(F.col("__key").cast("string")) + F.octet_length(F.col("__first").cast("string")) + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(revisits) if size <= FEW_BYTES else revisits, (pages[key] == revisits["__key"]) & (pages["payload_digest"] == revisits["__digest"]), "left")
    kind = F.when(F.col("__first").isNotNull(), "revisit").otherwise("response")
    return joined.withColumn("record_type", kind).withColumn("refers_to", F.col("__first")).drop("__key", "__digest", "__first")


def _lines(*lines: Column | str) -> Column:
    return F.concat(*(x for line in lines for x in ((F.lit(line) if isinstance(line, str) else line), F.lit("\r\n"))))


def record(key: str = "page_id", payload: str = "html", url: str = "url", date: str = "") -> Column:
    """The WARC record, without its end mark, of a row of resolve_revisits(); its date is that of the call, if none is given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    # A line break or control character in a URL would break the header; it is percent-encoded as in a URI.
    clean = F.coalesce(F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A"), F.lit(""))
    is_revisit = F.col("record_type") == "revisit"
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), "")
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.coalesce(F.col(payload), F.lit(""))))
    head = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col(key))),
        f"WARC-Date: {date}",
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        "Content-Type: application/http; msgtype=response",
    )
    again = _lines(F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to"))), f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}")
    return F.concat(head, F.when(is_revisit, again).otherwise(""), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveSink(DataSource):
    """Writes the strings of a one-column frame as gzip members. Options: path, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "searchloom_warc"

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], int(self.options["file_bytes"]))


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def _folder(self):
        """The file system of the path, as pyarrow knows it, and the folder there."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._folder()
        system.create_dir(f"{folder}/_temporary", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for value in batch.column(0):
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/_temporary/{files[-1]}", compression=None), 0
                member = gzip.compress(value.as_buffer(), 1, mtime=0)
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{folder}/_temporary/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages):
        """Removes what tasks have left, those that were run twice too."""
        from pyarrow import fs

        system, folder = self._folder()
        if system.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/_temporary")


def write_archives(resolved: DataFrame, path: str, file_bytes: int = FILE_BYTES, **names) -> None:
    """Writes the records of resolve_revisits() rows to gzip files of about file_bytes under path.

    path is on a file system that pyarrow.fs knows by its URI (shared folders, HDFS, S3, GCS).
    """
    resolved.sparkSession.dataSource.register(ArchiveSink)
    rows = resolved.select(F.concat(record(**names), F.lit(RECORD_END)).cast("binary").alias("value"))
    rows.write.format("searchloom_warc").mode("append").option("path", path).option("file_bytes", file_bytes).save()


def _parse(batches):
    for batch in batches:
        for content in batch.column(0):
            data = gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))  # one member or many
            out, size = [], 0
            while line := data.readline():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {line[:40]!r}")
                head = {}
                while (line := data.readline()).strip():
                    name, _, value = line.decode().partition(":")
                    head[name.lower()] = value.strip()
                block = data.read(int(head["content-length"]))
                data.read(len(RECORD_END))
                page = lambda s: s.removeprefix("<urn:x-page:").removesuffix(">") or None if s else None
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} is not what its digest says")
                out.append({"page_id": page(head["warc-record-id"]), "record_type": kind, "url": head["warc-target-uri"], "payload_digest": digest, "refers_to": page(head.get("warc-refers-to")), "payload": payload})
                size += len(block)
                if size >= 1 << 20 or len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path; a revisit's payload is null. Empty archives give an empty table.

    A payload that does not have the digest of its header is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse, RECORDS)


def with_payload_size(records: DataFrame) -> DataFrame:
    """records without payloads, with payload_bytes: of a revisit, those of the response that it refers to."""
    light = stage(records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "records")
    sizes = light.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    # A page_id may repeat with unlike payloads: the response is the one of the revisit's own digest.
    same = (light["refers_to"] == sizes["__id"]) & (light["payload_digest"] == sizes["__digest"])
    joined = light.join(sizes.dropDuplicates(["__id", "__digest"]), same, "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__id", "__digest", "__bytes")
