"""Web archives: one gzip member per record, and a sequential reader that checks what it reads."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.files import new_file, open_file
from riskloom.session import materialise

READ_BYTES = 1 << 18
RECORD_COLUMNS = (
    "archive string, record_type string, key string, url string, payload_bytes bigint, payload_digest string, "
    "refers_to string, verified boolean, payload binary"
)
BLANK = b"\r\n\r\n"


def payload_roles(pages: DataFrame, key: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """(key, digest, refers_to) of the revisits: rows whose payload also stands under a larger key."""
    body = F.coalesce(F.col(payload), F.lit(""))
    slim = materialise(
        pages.where(F.octet_length(body) >= min_revisit_bytes).select(key, F.sha1(body).alias("_digest")), "digests"
    )
    shared = slim.groupBy("_digest").agg(F.max(key).alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    # stored, so that both sides of the join are plain shuffles that adaptive execution can split
    shared = materialise(shared.drop("_n"), "shared")
    revisits = slim.join(shared, "_digest").where(~F.col(key).eqNullSafe(F.col("refers_to"))).distinct()
    return materialise(revisits, "revisits")


def header(fields: dict[str, str | None]) -> bytes:
    def clean(value: str) -> str:
        return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)

    lines = [f"{name}: {clean(value)}" for name, value in fields.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + BLANK


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, written: str) -> bytes:
    """One WARC record, not yet compressed."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    common = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}')}>",
        "WARC-Date": written,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": digest,
        "X-Record-Key": key,
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        fields = {
            "WARC-Type": "revisit",
            **common,
            "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{refers_to}:{digest}')}>",
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "X-Refers-To-Key": refers_to,
            "Content-Length": "0",
        }
        return header(fields) + BLANK
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload
    fields = {
        "WARC-Type": "response",
        **common,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    return header(fields) + block + BLANK


def member(data: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_warc(
    pages: DataFrame,
    folder: str,
    *,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    level: int = 6,
    written: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes every row as one record into archives under ``folder``; returns the stored manifest (archive,
    records, bytes). The project has no web records, so this works on any table with a key, an address and a text.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the largest key are responses and
    the others revisits without a body. Repeated rows: each is written; rows that share the largest key are all
    responses. A NULL key never is the largest: it revisits, or, if every key of the payload is NULL, responds.
    A NULL payload is empty; a NULL address leaves its header out; control characters and blanks in an address or
    key are percent-encoded. An empty table gives an empty manifest. Other columns are ignored.

    Task attempts write under names of their own, and only committed manifest rows name archives, so lost
    executors and repeated attempts leave no doubled records.
    """
    roles = payload_roles(pages, key, payload, min_revisit_bytes)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha"))
    roles = roles.select(F.col(key).alias("_role_key"), "_digest", "refers_to")
    same = F.col("_key").eqNullSafe(F.col("_role_key")) & (F.col("_sha") == F.col("_digest"))
    rows = rows.join(roles, same, "left").select(
        F.col("_key").cast("string").alias("key"),
        F.col("_url").cast("string").alias("url"),
        F.col("_body").cast("binary").alias("body"),
        F.col("refers_to").cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        records = size = 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if stream is None:
                    path, stream = new_file(folder, "pages", ".warc.gz")
                    records = size = 0
                data = member(record(*row, written), level)
                stream.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return materialise(rows.mapInArrow(write, "archive string, records bigint, bytes bigint"), "manifest")


class Members:
    """The decompressed bytes of one archive, member by member, at most a read buffer ahead."""

    def __init__(self, stream):
        self.stream, self.raw, self.inflate, self.plain = stream, b"", None, b""

    def begin(self) -> bool:
        """Moves to the next member; False at the end of the archive."""
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.inflate = zlib.decompressobj(31) if self.raw else None
        self.plain = b""
        return bool(self.raw)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.raw and not (data := self.stream.read(READ_BYTES)):
            raise ValueError("the archive ends inside a record")
        piece = self.inflate.decompress(self.raw or data, READ_BYTES)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.plain += piece
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record has no end of its header")
        found, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return found

    def exactly(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.plain and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.plain = self.plain[:length], self.plain[length:]
            length -= len(piece)
            yield piece

    def finish(self) -> None:
        """The member must end right behind the blank lines of its record."""
        while self.more():
            pass
        if self.plain != BLANK:
            raise ValueError("a member holds more than one record, or its framing is broken")


def read_records(stream, with_payload: bool) -> Iterator[tuple]:
    """Sequential read of an archive: headers, block by Content-Length, digest of the payload as it passes."""
    members = Members(stream)
    while members.begin():
        first, *lines = members.until(BLANK).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        length, kind = int(fields["Content-Length"]), fields["WARC-Type"]
        sha, kept, seen = hashlib.sha1(), [], 0
        if kind == "response":
            length -= len(members.until(BLANK)) + len(BLANK)
        for piece in members.exactly(length):
            sha.update(piece)
            seen += len(piece)
            if with_payload:
                kept.append(piece)
        members.finish()
        stated, full = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        right = kind != "response" or (base64.b32encode(sha.digest()).decode() == stated and seen == full)
        yield (
            kind,
            fields.get("X-Record-Key"),
            fields.get("WARC-Target-URI"),
            full,
            stated,
            fields.get("X-Refers-To-Key"),
            right,
            b"".join(kept) if with_payload and kind == "response" else None,
        )


def read_warc(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` names, one task per archive at a time. ``verified`` is False
    where a response's payload differs from its stated digest or length; a broken framing raises. Revisits carry
    the length and digest of the payload they refer to. Payloads are kept only on request."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
        schema = pa.schema(
            [(n, pa.int64() if n == "payload_bytes" else pa.bool_() if n == "verified" else
              pa.binary() if n == "payload" else pa.string()) for n in names]
        )
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_file(archive) as stream:
                    for found in read_records(stream, with_payload):
                        rows.append((archive, *found))
                        size += 200 + (found[3] if with_payload else 0)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(partitions).mapInArrow(read, RECORD_COLUMNS)
