"""Rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RECORD_OVERHEAD = 16


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), where u in (0, 1) comes from a 64-bit hash of key and shard.

    The largest score wins, so a shard gets its weight's share of the keys, and a shard's scores depend on no other shard.
    """
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
    return -F.lit(float(weight)) / F.ln(u)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the shard that the key belongs to. A null key is a key like any other."""
    best = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return best[0] if len(best) == 1 else F.greatest(*best)


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], new_weight: float | None = None) -> DataFrame:
    """df with `shard`, and with `grown_shard`: where the key would be with one more shard of new_weight (null: none).

    A key moves only if the new shard's score beats all others, so rows move into the new shard and nowhere else.
    `weights` are positive, one per shard. Extra columns stay; columns that are already named shard or grown_shard are
    replaced. An empty table gives an empty table.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights: one positive number per shard")
    out = df.drop("shard", "grown_shard").withColumn("_strandline_won", winner(F.col(key), weights))
    grown = F.lit(None).cast("int")
    if new_weight is not None:
        own = score(F.col(key), len(weights), new_weight)
        grown = F.when(own > F.col("_strandline_won.score"), F.lit(len(weights))).otherwise(F.col("_strandline_won.shard"))
    return out.withColumn("grown_shard", grown.cast("int")).withColumn("shard", F.col("_strandline_won.shard").cast("int")).drop("_strandline_won")


def with_slots(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    """placed with `slot`, a gapless number from 0 in each shard.

    The rows are written to the shared folder with the partition that they came from. Counts of (shard, partition) give
    where each partition starts in its shard, and rows are numbered inside (shard, partition), so no task ever holds a
    whole shard. Ties of `order` are numbered as they come.
    """
    rows = common.written(placed.drop("slot").withColumn("_strandline_part", F.spark_partition_id()), "shards")
    by = Window.partitionBy("shard").orderBy("_strandline_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_strandline_part").agg(F.count("*").alias("_strandline_n"))
    starts = starts.select("shard", "_strandline_part", F.coalesce(F.sum("_strandline_n").over(by), F.lit(0)).alias("_strandline_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_strandline_part").orderBy(*order)) - 1
    numbered = rows.withColumn("_strandline_number", number).join(starts, ["shard", "_strandline_part"])
    return numbered.withColumn("slot", (F.col("_strandline_start") + F.col("_strandline_number")).cast("long")).drop("_strandline_part", "_strandline_start", "_strandline_number")


def shard_documents(documents: DataFrame, shards: int = 40, new_weight: float | None = 1.0) -> DataFrame:
    """One row per row of documents (doc_id, text): size, checksum, shard, slot and the shard after one more is added.

    size: UTF-8 bytes of the text plus RECORD_OVERHEAD, a null text has none. Rows with one doc_id share a shard, whatever
    their texts; rows without doc_id share one too.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id", (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32")
    )
    out = with_slots(rendezvous(rows, "doc_id", [1.0] * shards, new_weight), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
