"""Binary files: written by the tasks that make them, and read in ranges of records."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one range has, about; ranges are what tasks share.
RANGE_BYTES = 8 << 20

def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_files(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Writes a file per row of rows (name, data); returns how many there are and their bytes. A file is written under a name
    that readers pass over and renamed, so a task that is lost or run twice leaves one whole file."""

    def run(batches):
        for b in batches:
            sizes = []
            for name, data in zip(b["name"].to_pylist(), b["data"]):
                fs, at = open_fs(f"{folder}/{name}")
                place, last = posixpath.split(at)
                fs.create_dir(place, recursive=True)
                raw = data.as_py() or b""
                with fs.open_output_stream(draft := f"{place}/_{last}.{uuid.uuid4().hex[:8]}", compression=None) as out:
                    out.write(raw)
                fs.move(draft, at)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["size"])

    done = rows.select("name", "data").mapInArrow(run, "size long").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return done[0], done[1]


def records(spark: SparkSession, path: str, size: int, header: int = 0) -> DataFrame:
    """(path, record, data): the whole records of `size` bytes behind `header` bytes of each file; a rest that is no whole
    record is left out. A file is dealt out in ranges of about RANGE_BYTES, so one large file is many tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    together = max(1, RANGE_BYTES // size)
    n = F.floor((F.col("length") - header) / size)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(together).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ranges = files.select("path", n.alias("n"), F.explode(starts).alias("first")).repartition("path", "first")

    def run(batches):
        for b in batches:
            for p, n, first in zip(b["path"].to_pylist(), b["n"].to_pylist(), b["first"].to_pylist()):
                fs, at = open_fs(p)
                with fs.open_input_file(at) as f:
                    f.seek(header + first * size)
                    many = min(together, n - first)
                    raw = f.read(many * size)
                if len(raw) != many * size:
                    raise ValueError(f"{p} is shorter than it was")
                data = [raw[i : i + size] for i in range(0, len(raw), size)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * many), pa.array(range(first, first + many), pa.int64()), pa.array(data, pa.binary())], ["path", "record", "data"])

    return ranges.mapInArrow(run, "path string, record long, data binary")


def counted_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, record, data) of files that start with a 32-bit count of records of `size` bytes; another length is an error."""
    files = spark.read.format("binaryFile").load(path)
    h = F.hex(F.substring("content", 1, 4))
    count = F.conv(F.concat(*[F.substring(h, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    wrong = F.raise_error(F.format_string("%s holds %d bytes", "path", F.octet_length("content")))
    body = F.when(F.octet_length("content") == 4 + count * size, F.col("content")).otherwise(wrong)
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("record")
    rows = files.select("path", body.alias("_body"), at)
    return rows.select("path", F.col("record").cast("long").alias("record"), F.substring("_body", F.col("record") * size + 5, F.lit(size)).alias("data"))


def little_endian(value: Column) -> Column:
    """Eight hex digits of an unsigned 32-bit number, lowest byte first."""
    h = F.lpad(F.hex(value), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def floats(data: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, v): the little-endian 32-bit floats in data (keys, data)."""

    def run(batches):
        for b in batches:
            v = [np.frombuffer(x.as_buffer(), "<f4") for x in b["data"]]
            n = [len(x) for x in v]
            which = np.repeat(np.arange(len(n)), n)
            place = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, int)
            flat = np.concatenate(v) if n else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([*[b[k].take(pa.array(which)) for k in keys], pa.array(place, pa.int32()), pa.array(flat, pa.float32())], [*keys, "place", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in data.schema}
    return data.select(*keys, "data").mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "place int", "v float"]))


def with_float_bytes(rows: DataFrame, column: str, name: str = "data") -> DataFrame:
    """rows with an array of numbers as little-endian 32-bit floats in a column `name`."""
    out = rows.schema.names

    def run(batches):
        for b in batches:
            data = pa.array([np.asarray(v.as_py() or [], "<f4").tobytes() for v in b[column]], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, data], [*out, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {name} binary")


# ---- grids of tiles in PNG files ----

# Fixed value: the eight bytes that start a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"


def png_of(image: np.ndarray) -> bytes:
    """A PNG file of 8-bit gray pixels."""
    h, w = image.shape

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((h, w + 1), np.uint8)
    lines[:, 1:] = image
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def image_of(png: bytes) -> np.ndarray:
    """The pixels of an 8-bit gray PNG file, with any line filter, not interlaced."""
    if not png.startswith(PNG):
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit gray pictures are read")
    w, h = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w + 1)
    out = np.zeros((h + 1, w + 1), np.int32)  # with a line above and a column before
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = (line + up) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line) & 255
        else:
            for x in range(w):
                a, b, c = int(out[y + 1, x]), int(up[x]), int(out[y, x])
                near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
                out[y + 1, x + 1] = (int(line[x]) + ((a + b) // 2 if kind == 3 else near)) & 255
    return out[1:, 1:].astype(np.uint8)


def tile_grids(spark: SparkSession, path: str, side: int = 8, padding: int = 2) -> DataFrame:
    """(path, tile, data): the tiles of pictures that show them in rows, each with `padding` pixels around it; data are the
    tile's pixels, line by line."""

    def run(batches):
        for b in batches:
            for p, png in zip(b["path"].to_pylist(), b["content"]):
                image, step = image_of(png.as_py()), side + 2 * padding
                h, w = image.shape[0] // step, image.shape[1] // step
                cut = image[: h * step, : w * step].reshape(h, step, w, step)[:, padding : padding + side, :, padding : padding + side].transpose(0, 2, 1, 3)
                data = [t.tobytes() for t in cut.reshape(h * w, side, side)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(data), pa.string()), pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], ["path", "tile", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, tile long, data binary")


def grid_png(tiles: list[bytes], across: int, side: int = 8, padding: int = 2) -> bytes:
    """A picture of tiles in rows of `across`; places without a tile are black."""
    step = side + 2 * padding
    image = np.zeros((-(-len(tiles) // across) * step, across * step), np.uint8)
    for k, t in enumerate(tiles):
        y, x = (k // across) * step + padding, (k % across) * step + padding
        image[y : y + side, x : x + side] = np.frombuffer(t, np.uint8).reshape(side, side)
    return png_of(image)
