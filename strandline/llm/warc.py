"""WARC archives with a Zstandard dictionary in a leading skippable frame, records compressed one by one."""

from __future__ import annotations

import base64
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Magic numbers of a skippable frame that holds a dictionary and of a Zstandard frame; the WARC version.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
NO_REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Uncompressed bytes after which an archive is closed, of the dictionary, and of the records that it is trained on.
ARCHIVE_BYTES = 48 << 20
DICTIONARY_BYTES = 16 << 10
TRAINING_BYTES = 1 << 20
#: Bytes of a record that are one sample, and samples that a dictionary is trained on at least.
SLICE_BYTES = 16 << 10
LEAST_SLICES = 8
LEVEL = 3


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Record:
    """One capture. payload None: a revisit of the record `refers_to`, which has an equal payload."""

    page_id: int | None
    url: str | None
    digest: bytes  # SHA-1 of the full payload
    size: int  # bytes of the full payload
    payload: bytes | None
    refers_to: int | None = None

    def to_bytes(self) -> bytes:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % self.size
        block = head + (self.payload or b"")
        kind = b"response" if self.payload is not None else b"revisit"
        fields = [
            (b"WARC-Type", kind),
            (b"WARC-Record-ID", _record_id(self.page_id)),
            (b"WARC-Date", b"1970-01-01T00:00:00Z"),
            (b"WARC-Target-URI", " ".join((self.url or "").split()).encode()),
            (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(self.digest)),
            (b"WARC-Payload-Length", b"%d" % self.size),
            (b"Content-Type", b"application/http; msgtype=response"),
            (b"Content-Length", b"%d" % len(block)),
        ]
        if self.payload is None:
            fields += [(b"WARC-Profile", NO_REVISIT), (b"WARC-Refers-To", _record_id(self.refers_to))]
        return VERSION + CRLF + b"".join(k + b": " + v + CRLF for k, v in fields) + CRLF + block + CRLF + CRLF

    @classmethod
    def from_bytes(cls, raw: bytes) -> Record:
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if lines[0] != VERSION:
            raise ValueError("not a WARC record")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        block = rest[: int(fields[b"Content-Length"])]
        response = fields[b"WARC-Type"] == b"response"
        return cls(
            _page_id(fields[b"WARC-Record-ID"]),
            fields[b"WARC-Target-URI"].decode(),
            base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")),
            int(fields[b"WARC-Payload-Length"]),
            block.partition(CRLF + CRLF)[2] if response else None,
            None if response else _page_id(fields[b"WARC-Refers-To"]),
        )


def _record_id(page_id: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def _page_id(urn: bytes) -> int | None:
    number = urn.removeprefix(b"<urn:x-page:").removesuffix(b">")
    return None if number == b"none" else int(number)


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary from slices of an archive's records, evenly spaced, about TRAINING_BYTES of them. Where there are too few
    of them, or they are too alike, to train one, the last slices are themselves the dictionary's content."""
    slices = [r[i : i + SLICE_BYTES] for r in records for i in range(0, len(r), SLICE_BYTES)]
    sample = slices[:: max(1, sum(map(len, records)) // TRAINING_BYTES)]
    try:
        if len(sample) >= LEAST_SLICES:
            return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(sample)[-DICTIONARY_BYTES:]


def write_archive(path: str, records: list[bytes]) -> None:
    """Writes an archive under another name and renames it, so a task that is lost or run twice leaves no half file."""
    fs, at = open_fs(path)
    trained = dictionary_of(records)
    shared = zstandard.ZstdCompressionDict(trained)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    with fs.open_output_stream(draft := f"{at}.{uuid.uuid4().hex[:8]}.part", compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        for r in records:
            out.write(packer.compress(r))
    fs.move(draft, at)


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[Record]:
    """The records of an archive, one after the other; no more than one record and a chunk are in memory."""
    fs, at = open_fs(path)
    with fs.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} has no dictionary")
        shared, pending = zstandard.ZstdCompressionDict(f.read(size)), b""
        unpacker = zstandard.ZstdDecompressor(dict_data=shared)
        one, out, begun = unpacker.decompressobj(), [], False
        while pending or (pending := f.read(chunk)):
            out.append(one.decompress(pending))
            pending, begun = b"", True
            if one.eof:
                yield Record.from_bytes(b"".join(out))
                pending, one, out, begun = one.unused_data, unpacker.decompressobj(), [], False
        if begun:
            raise ValueError(f"{path} ends inside a record")


# ---- tables ----


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to): the rows of pages (page_id, sha1, size), a written table, that revisit an earlier record.

    Of rows with equal digest and size of at least `least_bytes` the least page_id is the response; null page_ids come
    last. A row that repeats the response's page_id and payload is that record once more, not a revisit. Hot payloads are
    counted before the shuffle and met by broadcast.
    """
    groups = pages.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = common.written(groups.where("n > 1"), "payloads")
    out = common.join_groups(pages, groups, ["sha1", "size"], "n")
    return out.where("refers_to is not null and not (refers_to <=> page_id)").select("page_id", "sha1", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in folder and returns their paths and record counts.

    Null html is an empty payload, and null urls an empty target. One archive or more per partition, none for an empty
    partition. Payloads of revisits are dropped before anything is sent to Python. Rows may repeat; other columns are not
    read. The pages meet their revisits by (page_id, digest), which no hot payload makes uneven.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.unhex(F.sha1(body)).alias("sha1"), F.octet_length(body).cast("long").alias("size"))
    known = revisits(common.written(rows.select("page_id", "sha1", "size"), "page_keys"), least_bytes)
    known = known.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "refers_to")
    whole = rows.join(known, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    source = whole.select("page_id", "url", "sha1", "size", F.when(F.col("refers_to").isNull(), F.col("body")).alias("payload"), "refers_to", F.spark_partition_id().alias("part"))

    def run(batches):
        part, number, held, size = 0, 0, [], 0  # a task may go through several partitions, whose numbers come with their rows

        def close() -> pa.RecordBatch:
            write_archive(path := f"{folder}/pages-{part:06d}-{number:05d}.warc.zst", held)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, sha1, n, raw, refers_to, part = (c[i].as_py() for c in b.columns)
                held.append(Record(page_id, url, sha1, n, raw, refers_to).to_bytes())
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return common.written(source.mapInArrow(run, "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives named in archives (path, records): page_id, url, payload_bytes, payload_digest
    (base32 SHA-1), record_type, refers_to, payload (null for revisits). A payload that differs from its length or digest
    is an error."""

    import hashlib

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for b in batches:
            for path in b["path"].to_pylist():
                rows, size = [], 0
                for r in read_archive(path):
                    if r.payload is not None and (len(r.payload) != r.size or hashlib.sha1(r.payload).digest() != r.digest):
                        raise ValueError(f"{path}: the payload of page {r.page_id} isn't what was written")
                    kind = "revisit" if r.payload is None else "response"
                    rows.append((r.page_id, r.url, r.size, base64.b32encode(r.digest).decode(), kind, r.refers_to, r.payload))
                    size += len(r.payload or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    many = max(1, min(archives.count(), 10_000))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.repartition(many).mapInArrow(run, schema)


def default_folder(spark) -> str:
    return common.new_path(spark, "warc")



