"""Exact dedup in batches: a binary-fuse filter per immutable snapshot screens incoming digests, positives meet the exact
buckets and are compared byte by byte, and duplicates inside the new batch are grouped on their own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct digests for which a snapshot has one filter.
BUCKET_KEYS = 8192


# ---- 3-wise binary fuse filter with 8-bit fingerprints ----


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shape(n: int) -> tuple[int, int]:
    """(segment length, number of start segments) for n keys."""
    length = 4 if n < 2 else min(1 << 18, 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return length, max(1, int(np.ceil(n * factor / length)) - 2)


def _places(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments for each key, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        g = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64) * length
    m = np.uint64(length - 1)
    slots = np.stack([first + (h & m).astype(np.int64), first + length + (g & m).astype(np.int64), first + 2 * length + ((g >> np.uint64(20)) & m).astype(np.int64)])
    return slots, (g >> np.uint64(56)).astype(np.uint8)


@dataclass
class BinaryFuse:
    """A static filter: no false negatives, about 1 / 256 false positives. Keys are distinct 64-bit numbers."""

    seed: int
    length: int
    starts: int
    table: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peels all slots that hold one key at once, round after round, and fills the table in reverse order; a new seed
        is taken when keys stay, and more room after every fourth such failure."""
        keys = np.unique(keys.astype(np.uint64))
        length, starts = _shape(len(keys))
        for seed in range(1, 200):
            if seed % 4 == 0:
                starts += max(1, starts // 8)
            size = (starts + 2) * length
            slots, prints = _places(keys, seed, length, starts)
            count, holder = np.zeros(size, np.int64), np.zeros(size, np.int64)
            ids = np.arange(len(keys))
            for s in slots:
                np.add.at(count, s, 1)
                np.bitwise_xor.at(holder, s, ids)
            order: list[tuple[np.ndarray, np.ndarray]] = []
            left = len(keys)
            single = np.flatnonzero(count == 1)
            while len(single):
                own, at = np.unique(holder[single], return_index=True)
                order.append((own, single[at]))
                left -= len(own)
                for s in slots:
                    np.subtract.at(count, s[own], 1)
                    np.bitwise_xor.at(holder, s[own], own)
                touched = np.unique(slots[:, own])
                single = touched[count[touched] == 1]
            if left == 0:
                table = np.zeros(size, np.uint8)
                for own, at in reversed(order):
                    table[at] = 0
                    a, b, c = slots[:, own]
                    table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed, length, starts, table)
        raise RuntimeError("no seed peels these keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = _places(keys.astype(np.uint64), self.seed, self.length, self.starts)
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.length, self.starts], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        seed, length, starts = np.frombuffer(raw[:24], "<i8").tolist()
        return cls(seed, length, starts, np.frombuffer(raw, np.uint8, offset=24))


# ---- batches and snapshots ----


def normalised(text: Column) -> Column:
    r"""text with each run of [\x20\x09-\x0D] as one space; null as empty. The pattern skips runs that are one space already."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


@dataclass
class Snapshots:
    """Distinct texts of batches that have been taken in, never changed: groups (batch, digest, head, n, bucket), a written
    table, and a filter for each batch and bucket: filters (batch, bucket, filter)."""

    groups: DataFrame
    filters: DataFrame


def _keys(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """First 8 bytes of each 32-byte digest."""
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 4)[:, 0].copy()


def _build(keys: tuple, group: pa.Table) -> pa.Table:
    batch, bucket = (pa.array([k.as_py()], pa.int32()) for k in keys)
    return pa.table({"batch": batch, "bucket": bucket, "filter": pa.array([BinaryFuse.build(_keys(group["digest"])).to_bytes()], pa.binary())})


def _screen(keys: tuple, incoming: pa.Table, filters: pa.Table) -> pa.Table:
    """The incoming groups that the snapshot's filter may hold."""
    if not incoming.num_rows or not filters.num_rows:
        return incoming.slice(0, 0)
    may = BinaryFuse.from_bytes(filters["filter"][0].as_py()).contains(_keys(incoming["digest"]))
    return incoming.filter(pa.array(may))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Each batch's distinct digests with head = its least (doc_id, row), nulls last, and n rows. Partial sums come before the
    shuffle, so a text that a third of all rows share is no hot group."""
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    out = rows.groupBy("batch", "digest").agg(F.min(head).alias("head"), F.count("*").alias("n"))
    return out.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshots(groups: DataFrame) -> Snapshots:
    """groups, which must be a written table, with their filters."""
    filters = groups.select("batch", "bucket", "digest").groupBy("batch", "bucket").applyInArrow(_build, "batch int, bucket int, filter binary")
    return Snapshots(groups, common.written(filters, "fuse"))


def positives(snaps: Snapshots) -> DataFrame:
    """(digest, batch, snapshot): groups of a batch that are in the exact bucket of a snapshot before it. Only groups that
    the snapshot's filter lets through are looked up there."""
    asked = snaps.groups.where("batch > 0").select("digest", "batch", "bucket", F.explode(F.sequence(F.lit(0), F.col("batch") - 1)).alias("snapshot"))
    filters = snaps.filters.withColumnRenamed("batch", "snapshot")
    kept = asked.groupBy("snapshot", "bucket").cogroup(filters.groupBy("snapshot", "bucket")).applyInArrow(_screen, asked.schema)
    exact = snaps.groups.select("digest", F.col("batch").alias("snapshot"))
    return kept.drop("bucket").join(exact, ["digest", "snapshot"])


def matches(snaps: Snapshots, texts: DataFrame) -> DataFrame:
    """(batch, digest, known): groups whose text a snapshot before theirs has, with the head that it has in the first one.

    texts (doc_id, text) is read once more, for the documents that stand for the positives' groups; others are screened out
    where they are read. Positives of one digest are equal when their bytes are: bodies are grouped by digest and body.
    """
    found = common.written(positives(snaps), "positives")
    ends = found.select("digest", "batch").unionByName(found.select("digest", F.col("snapshot").alias("batch"))).distinct()
    asked = snaps.groups.select("digest", "batch", "head", F.col("head.doc_id").alias("doc_id")).join(ends, ["digest", "batch"])
    asked = common.written(asked, "asked")
    body = common.divided(texts.select("doc_id", "text"), "doc_id", asked)[0].select("doc_id", normalised(F.col("text")).alias("body"))
    # Never null, or the join would ask for that, of all texts, before the screen.
    body = body.withColumn("digest", F.coalesce(F.unhex(F.sha2("body", 256)), F.lit(b"")))
    mine = asked.select("batch", "head", F.col("digest").alias("of"), F.col("doc_id").alias("at"))
    body = body.join(mine, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("at")))
    same = body.groupBy("digest", "body").agg(F.min(F.struct("batch", "head")).alias("first"), F.collect_set("batch").alias("batches"))
    same = same.select("digest", "first", F.explode("batches").alias("batch")).where(F.col("batch") > F.col("first.batch"))
    return same.select("batch", "digest", F.col("first.head").alias("known"))


def dedup(documents: DataFrame, cuts: int = 2) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are identical after `normalised`. The table is taken as cuts + 1 batches of ascending doc_id, as if they
    had arrived one after the other: each batch is grouped by digest, becomes a snapshot with filters, and is screened
    against the snapshots before it. Of equal texts the least doc_id stays; null doc_ids come last; of equal doc_ids just
    one row stays. Other columns are not looked at. An empty table gives an empty table.
    """
    with common.scratch(documents.sparkSession) as kept:
        source = documents.select("doc_id", "text")
        digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
        rows = common.written(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest.alias("digest")), "digests")
        kept.append(rows)
        at = [i / (cuts + 1) for i in range(1, cuts + 1)]
        total, bounds = rows.agg(F.count("*"), F.percentile_approx("doc_id", at, 10_000)).first()
        bounds = sorted(set(bounds or []))
        rows = rows.withColumn("batch", sum((F.coalesce(F.col("doc_id") > F.lit(b), F.lit(True)).cast("int") for b in bounds), F.lit(0)))
        buckets = max(1, -(-total // ((len(bounds) + 1) * BUCKET_KEYS)))
        groups = common.written(grouped(rows, buckets), "batches")
        found = matches(snapshots(groups), source)
        every = groups.join(found, ["batch", "digest"], "left").select("batch", "digest", "n", F.coalesce("known", "head").alias("first"))
        every = common.written(every.withColumn("_keeper", F.col("first.row")), "met")
        sizes = every.groupBy("_keeper").agg(F.sum("n").alias("group_size"))
        every = common.written(every.join(sizes, "_keeper"), "groups")
        kept.append(every)
        out = common.gathered(common.join_groups(rows, every, ["batch", "digest"], "n"))
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("_keeper")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of equal texts, that with the least doc_id; all columns stay.

    What goes is looked up by (doc_id, digest), and only rows whose doc_id may be among those that go are shuffled. Rows
    that repeat both doc_id and text are cut down to one, whichever. Null texts count as empty, null doc_ids come last; an
    empty table stays empty.
    """
    with common.scratch(documents.sparkSession) as kept:
        found = dedup(documents).where(~F.col("kept"))
        again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        gone = common.written(found.groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.bool_or(again).alias("once")), "gone")
        kept.append(gone)
        return common.without(documents, gone, F.sha2(normalised(F.col("text")), 256))
