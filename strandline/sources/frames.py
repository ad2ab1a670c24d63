"""Raw frames, tensors and dictionaries in binary files, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import records


def _records(files: DataFrame, body: Column, size: Column, name: str) -> DataFrame:
    """(path, name, data): the whole records of each body; a rest that is no whole record is left out."""
    n = F.floor(F.octet_length(body) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias(name)
    rows = files.select("path", body.alias("_body"), size.cast("int").alias("_size"), at)
    return rows.select("path", name, F.substring("_body", F.col(name) * F.col("_size") + 1, F.col("_size")).alias("data"))


def frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(path, frame, data) of files of gray frames without a header; large files are read in ranges, by many tasks."""
    return records(spark, path, width * height).withColumnRenamed("record", "frame")


def headed_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, data, width, height) of files that start with a line of width and height."""
    files = spark.read.format("binaryFile").load(path)
    # Latin-1 keeps one character per byte, so places in the text are places in the file.
    head = F.substring_index(F.decode(F.substring("content", F.lit(1), F.lit(64)), "ISO-8859-1"), "\n", 1)
    files = files.select("path", "content", head.alias("head")).withColumn("width", F.split("head", " ")[0].cast("int")).withColumn("height", F.split("head", " ")[1].cast("int"))
    body = F.substring("content", F.length("head") + 2, F.octet_length("content"))
    out = _records(files, body, F.col("width") * F.col("height"), "frame")
    return out.join(files.select("path", "width", "height"), "path")


def pixels(frames_: DataFrame, width: int) -> DataFrame:
    """(path, frame, x, y, lum), one row per byte of data."""
    n = F.octet_length("data")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("at")
    rows = frames_.select("path", "frame", F.hex("data").alias("_hex"), at)
    lum = F.conv(F.substring("_hex", F.col("at") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("path", "frame", (F.col("at") % width).alias("x"), F.floor(F.col("at") / width).cast("int").alias("y"), lum.alias("lum"))


def words(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(path, place, value) of files of little-endian unsigned 32-bit numbers; with `expected`, another count is an error."""
    files = spark.read.format("binaryFile").load(path)
    if expected is not None:
        wrong = F.raise_error(F.format_string("%s holds %d bytes", "path", F.octet_length("content")))
        files = files.withColumn("content", F.when(F.octet_length("content") == 4 * expected, F.col("content")).otherwise(wrong))
    rows = _records(files, F.col("content"), F.lit(4), "place")
    h = F.hex("data")
    value = F.conv(F.concat(*[F.substring(h, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return rows.select("path", "place", value.alias("value"))


def symbols(spark: SparkSession, path: str, cells: int) -> DataFrame:
    """(path, frame, cell, id, invert, flip_x, flip_y) of symbol streams, frame by frame."""
    w = words(spark, path)
    v = F.col("value")
    flag = lambda m: (v.bitwiseAND(F.lit(m)) != 0)
    return w.select(
        "path", F.floor(F.col("place") / cells).alias("frame"), (F.col("place") % cells).alias("cell"), v.bitwiseAND(F.lit(0x7FF)).alias("id"),
        flag(0x800).alias("invert"), flag(0x2000).alias("flip_x"), flag(0x1000).alias("flip_y"),
    )


SKIP_SCHEMA = "tile int, on_frame int, changed_from int, changed_to int, prev_change int, next_change int, early_impact double, late_impact double"


def skips(spark: SparkSession, path: str) -> DataFrame:
    """Skip candidates from CSV with a header; an empty impact is null."""
    return spark.read.schema(SKIP_SCHEMA).option("header", True).csv(path)


def write_skips(skips_: DataFrame, path: str) -> None:
    skips_.write.option("header", True).csv(path)
