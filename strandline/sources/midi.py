"""Standard MIDI files: notes with their on and off times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "path string, track int, seq int, tick long, kind string, note int, velocity int"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the highest first."""
    value = 0
    while True:
        b = data[at]
        value, at = value << 7 | b & 127, at + 1
        if not b & 128:
            return value, at


def events_of(data: bytes) -> Iterator[tuple[int, int, str, int, int]]:
    """(track, tick, on or off, note, velocity) of a file, in its order; meta and other channel events are passed over."""
    at, track = 0, -1
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        at += 8
        if kind == b"MTrk":
            track += 1
            yield from _track(data[at : at + size], track)
        at += size


def _track(data: bytes, track: int) -> Iterator[tuple[int, int, str, int, int]]:
    at, tick, status = 0, 0, 0
    while at < len(data):
        delta, at = _number(data, at)
        tick += delta
        if data[at] & 128:
            status, at = data[at], at + 1
        if status == 0xFF:
            size, at = _number(data, at + 1)
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(data, at)
            at += size
        else:
            top = status >> 4
            if top in (8, 9):
                note, velocity = data[at], data[at + 1]
                yield track, tick, "on" if top == 9 and velocity else "off", note, velocity
            at += 1 if top in (12, 13) else 2


def written(notes: list[tuple[int, int, int, int]], per_beat: int = 480) -> bytes:
    """A file of one track from (on, off, note, velocity)."""
    marks = sorted([(on, 1, n, v) for on, _, n, v in notes] + [(off, 0, n, 0) for _, off, n, _ in notes])
    body, last = bytearray(), 0
    for tick, on, n, v in marks:
        delta, last = tick - last, tick
        parts = [delta & 127]
        while delta := delta >> 7:
            parts.append(delta & 127 | 128)
        body += bytes(reversed(parts)) + bytes([0x90 if on else 0x80, n, v])
    body += b"\0\xff\x2f\0"
    return b"MThd" + (6).to_bytes(4, "big") + (0).to_bytes(2, "big") + (1).to_bytes(2, "big") + per_beat.to_bytes(2, "big") + b"MTrk" + len(body).to_bytes(4, "big") + bytes(body)


def events(spark: SparkSession, path: str) -> DataFrame:
    """All note events of the files at path; files are read side by side, each in one task."""

    def run(batches):
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                rows = [(p, t, k, tick, kind, n, v) for k, (t, tick, kind, n, v) in enumerate(events_of(bytes(data)))]
                yield pd.DataFrame(rows, columns=["path", "track", "seq", "tick", "kind", "note", "velocity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, EVENT)


def notes(events_: DataFrame) -> DataFrame:
    """(path, on, off, track, note, velocity, disabled): each note-on ends at the next event of its pitch, whichever track that
    is on. Notes without an end or of pitch 0 are disabled."""
    w = Window.partitionBy("path", "note").orderBy("tick", "seq")
    n = events_.withColumn("off", F.lead("tick").over(w)).where("kind = 'on'")
    return n.select("path", F.col("tick").alias("on"), "off", "track", "note", "velocity", (F.col("off").isNull() | (F.col("note") < 1)).alias("disabled"))


def quantized(notes_: DataFrame, step: int = 120) -> DataFrame:
    """(path, place, note, len, run): notes by (on, track, note, off), lengths and gaps to the next note in steps of a
    sixteenth, at most 31 and 7."""
    w = Window.partitionBy("path").orderBy("on", "track", "note", "off")
    n = notes_.where("not disabled")
    steps = lambda c, most: F.least(F.lit(most), F.round(c / step)).cast("int")
    gap = F.coalesce(F.lead("on").over(w) - F.col("on"), F.lit(0))
    return n.select("path", (F.row_number().over(w) - 1).alias("place"), "note", steps(F.col("off") - F.col("on"), 31).alias("len"), steps(gap, 7).alias("run"))


def sixteenths(notes_: DataFrame, by: str, step: int = 120) -> DataFrame:
    """notes_ (by, on, off, track, note) with len and run in whole steps: a length of more than 32 steps counts as 12, a gap of
    eight or more as 7, and both are counted one tick long; len is one less than the steps. The last note's gap is 0."""
    w = Window.partitionBy(by).orderBy("on", "track", "note", "off")
    gap = F.floor((F.coalesce(F.lead("on").over(w), F.col("on") - 1) - F.col("on") + 1) / step)
    length = F.floor((F.col("off") - F.col("on") + 1) / step) - 1
    return notes_.withColumn("len", F.when(length > 31, 11).otherwise(length).cast("long")).withColumn("run", F.when(gap >= 8, 7).otherwise(gap).cast("long"))
