"""WARC archives of web pages: written, deduplicated by payload, and read back.

Each record is one gzip member, as WARC/1.1 asks. Pages whose payload another
page has too are written once, as a response; the others revisit it by digest. The reader goes
through an archive front to back with incremental decompression: it frames a
record by its content length, checks that the member ends where the record
does, and verifies the digests. It holds one record at a time.

Archives are opened through Arrow's file systems, so the folder may be any that both
Arrow and Spark can reach by URI. Names carry the task attempt, and only an
attempt that finishes reports its archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_side, text_batches

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class WarcError(ValueError):
    """A record that its framing or its digest shows to be damaged."""


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def _header_text(value: str) -> str:
    """A header value on one line: control characters and % become %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _header_value(text: str) -> str:
    head, *rest = text.split("%")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a payload of None makes a revisit of ``refers_to``."""
    block = HTTP.format(size).encode() + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if payload is None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines) + "\r\n\r\n"
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class Members:
    """The gzip members of a stream, one after another, inflated piece by piece."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.rest = b""
        self.unpack = None
        self.buffer = b""

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        self.unpack = zlib.decompressobj(31) if self.rest else None
        self.buffer = b""
        return bool(self.rest)

    def _more(self) -> bool:
        while not self.unpack.eof:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    raise WarcError("archive ends inside a record")
            try:
                out = self.unpack.decompress(self.rest, CHUNK)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                raise WarcError("record without an end of headers")
        head, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise WarcError("record shorter than its content length")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece

    def ended(self) -> bool:
        while not self.buffer and self._more():
            pass
        return not self.buffer


def read_records(stream) -> Iterator[dict]:
    """Every record of an archive: its headers (lower-case names), payload and payload size."""
    members = Members(stream)
    while members.next_member():
        first, *lines = members.until(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {first[:40]!r}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        left = int(head["content-length"])
        digest = hashlib.sha256()
        block = bytearray()
        for piece in members.take(left):
            digest.update(piece)
            block += piece
        if b"".join(members.take(4)) != b"\r\n\r\n" or not members.ended():
            raise WarcError("record does not end where its content length says")
        if head.get("warc-block-digest") != f"sha256:{digest.hexdigest()}":
            raise WarcError("block digest differs")
        http, _, payload = bytes(block).partition(b"\r\n\r\n")
        fields = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:])
        size = int(fields["content-length"])
        if head["warc-type"] == "response":
            if len(payload) != size or head["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
                raise WarcError("payload digest or length differs")
        yield head | {"payload": payload, "payload_bytes": size}


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is null for responses.

    Of equal payloads of at least MIN_REVISIT_BYTES, the smallest page_id is the
    response. Rows that repeat that page_id are responses too; a row without page_id
    revisits if another row of its payload has one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "size": F.octet_length("payload")}
    )
    large = hashed.where(F.col("size") >= MIN_REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = materialize(groups.select("digest", "first"), "equal-payloads")
    joined = hashed.join(small_side(groups, groups.count()), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page below ``folder``; (path, n_records) of the archives.

    A null html is an empty payload. An empty table writes no archive.
    """
    spark = pages.sparkSession
    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        stream, name, done, number = None, "", 0, 0
        paths: list[str] = []
        counts: list[int] = []
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.gz"
                    stream, done = files.open_output_stream(f"{top}/{name}", compression=None), 0
                    number += 1
                    paths.append(name)
                    counts.append(0)
                whole = None if row["refers_to"] is not None else row["payload"]
                done += stream.write(encode_record(row["page_id"], row["url"], whole, row["size"], row["digest"], row["refers_to"]))
                counts[-1] += 1
                if done >= archive_bytes:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in paths]), pa.array(counts, pa.int64())], names=["path", "n_records"])

    return materialize(plan_records(pages).mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives named by ``path``, digests verified."""
    spark = archives.sparkSession
    parts = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                held = 0
                with files.open_input_stream(at, compression=None) as stream:
                    for record in read_records(stream):
                        number = {k: int(record[h]) if h in record else None for k, h in (("page_id", "page-id"), ("refers_to", "refers-to-page-id"))}
                        url = record.get("warc-target-uri")
                        rows.append(
                            number | {
                                "url": None if url is None else _header_value(url), "record_type": record["warc-type"],
                                "payload_bytes": record["payload_bytes"], "payload_digest": record["warc-payload-digest"].partition(":")[2],
                                "payload": record["payload"],
                            }
                        )
                        held += len(record["payload"]) + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return archives.select("path").repartition(parts).mapInArrow(run, fields)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc")))
