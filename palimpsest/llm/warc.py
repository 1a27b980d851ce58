"""WARC archives: one gzip member a record, duplicates as revisits, and a sequential reader.

Records of equal payloads share one response, that of the largest id; the others are revisits that
name it. Which record is what is settled on (id, digest) pairs alone; payloads are
shuffled once, by that pair, and packed into archives of bounded size.

Archives are rows (archive, warc) of a table, so they lie in any store that Spark can write;
`read` takes any such rows, in whatever chunks an archive's bytes come in. The reader inflates
member by member as far as it needs, frames blocks by Content-Length, and checks both digests.

Edge cases: a null or empty text is a payload of no bytes, equal to any other such; a very long text is one record,
in an archive of its own size; ties do not occur, as the largest id of equal payloads is the response; rows that repeat
id and payload are all responses; null ids and urls come back as null; an empty table gives no
archive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that the reader inflates at a time.
CHUNK = 1 << 14
LEVEL = 4
ID = "<urn:x-page:%s>"
END = b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def sha1(payload: bytes) -> str:
    """The bare base32 form of a SHA-1 digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: object, url: str | None, payload: bytes, response_id: object) -> bytes:
    """The gzip member of one record; a revisit keeps the HTTP headers only."""
    revisit = response_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", ID % ("" if page_id is None else page_id)),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.insert(3, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        headers += [("WARC-Refers-To", ID % response_id), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(text.encode()) + deflate.compress(block) + deflate.compress(END) + deflate.flush()


class Reader:
    """Reads the records of an archive one after another from chunks of its bytes."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks = chunks
        self.chunk = memoryview(b"")
        self.at = 0  # what is read of the chunk
        self.inflate = None

    def _waiting(self) -> bool:
        """Whether bytes are left, in this chunk or the next one."""
        while self.at == len(self.chunk):
            following = next(self.chunks, None)
            if following is None:
                return False
            self.chunk, self.at = memoryview(following), 0
        return True

    def _more(self, ready: bytearray) -> bool:
        """Adds inflated bytes of this member to `ready`; false at the member's end."""
        if self.inflate.eof:
            return False
        if not self._waiting():
            raise ValueError("the archive ends inside a member")
        piece = self.chunk[self.at : self.at + CHUNK]
        ready += self.inflate.decompress(piece)
        self.at += len(piece) - len(self.inflate.unused_data)
        return True

    def __iter__(self) -> Iterator[Record]:
        while self._waiting():
            self.inflate = zlib.decompressobj(31)
            ready = bytearray()
            while (head := ready.find(END)) < 0:
                if not self._more(ready):
                    raise ValueError("a record without the end of its headers")
            lines = ready[:head].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            end = head + 4 + int(headers["Content-Length"])
            while len(ready) < end + 4 and self._more(ready):
                pass
            while self._more(ready):
                pass
            if len(ready) != end + 4 or ready[end:] != END:
                raise ValueError("Content-Length does not fit the record")
            yield Record(headers, bytes(ready[head + 4 : end]))


def verified(record: Record) -> tuple[str, int, bytes | None]:
    """Record type, length of the full payload, and the payload if it is there; raises if a digest is wrong."""
    if f"sha1:{sha1(record.block)}" != record.headers["WARC-Block-Digest"]:
        raise ValueError("the block's digest is wrong")
    http, _, payload = record.block.partition(END)
    length = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: "))
    kind = record.headers["WARC-Type"]
    if kind == "revisit":
        return kind, length, None
    if len(payload) != length or f"sha1:{sha1(payload)}" != record.headers["WARC-Payload-Digest"]:
        raise ValueError("the payload's digest is wrong")
    return kind, length, payload


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(archive, warc): archives of about ARCHIVE_BYTES of payload that hold a record for every row."""
    html = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha1(html.cast("binary"))
    names = pages.select(F.col(id_col).alias("id"), digest.alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least_bytes)
    newest = names.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = names.join(newest, "digest").where(~F.col("id").eqNullSafe(F.col("response"))).select("id", "digest", "response").distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), digest.alias("digest"))
    revisits = revisits.select(F.col("id").alias("own"), F.col("digest").alias("own_digest"), "response")
    joined = rows.join(revisits, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size, first = 0, None

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.string()), pa.array([b"".join(members)], pa.binary())], names=["archive", "warc"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, text, response = (c.as_py() for c in row)
                payload = text.encode()
                members.append(member(page_id, url, payload, response))
                first = first or f"{page_id}-{sha1(payload)}.warc.gz"
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    members.clear()
                    size, first = 0, None
        if members:
            yield archive()

    return joined.select("id", "url", "html", "response").mapInArrow(run, "archive string, warc binary")


READ = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def read(stored: DataFrame) -> DataFrame:
    """A row for each record of the archives, in their order; digests and lengths are checked."""

    def number(urn: str | None) -> str | None:
        return (urn or "")[len("<urn:x-page:") : -1] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for warc in batch.column(0):
                found = []
                for record in Reader(iter([warc.as_py()])):
                    kind, length, _ = verified(record)
                    h = record.headers
                    found.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, length, h["WARC-Payload-Digest"].removeprefix("sha1:"), number(h.get("WARC-Refers-To"))))
                columns = list(zip(*found, strict=True)) or [[]] * 6
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    return stored.select("warc").mapInArrow(run, READ)
