"""Joins with hot keys, and look-ups of few rows among many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a screen for each key that it holds, and in all: 16 MB, however many keys there are.
BITS_A_KEY = 64
MOST_BITS = 1 << 27


def hot_keys(groups: DataFrame, keys: list[str], size: str, least: int = 1000, most: int = 1000) -> list[int]:
    """Hashes of the keys of the `most` largest groups of `least` rows or more, `size` being how many rows a group has. No
    other group has more than a share of 1 / most of all rows."""
    largest = groups.where(F.col(size) >= least).orderBy(F.desc(size)).limit(most)
    return [r[0] for r in largest.select(F.xxhash64(*keys)).collect()]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", hot: list[int] | None = None) -> DataFrame:
    """rows joined (left or inner) to one group row per key, where `size` is how many rows the key has.

    Hot keys (see hot_keys; they may be given) are known to the driver by a hash, and their groups, a thousand at most, are
    broadcast. All others meet in a shuffle join. groups should be a written table, as it is read three times; its keys
    must have the types that they have in rows.
    """
    if hot is None:
        hot = hot_keys(groups, keys, size)
    if not hot:
        return rows.join(groups, keys, how)
    key = F.xxhash64(*keys)
    met = rows.where(key.isin(hot)).join(F.broadcast(groups.where(key.isin(hot))), keys, how)
    return met.unionByName(rows.where(~key.isin(hot)).join(groups.where(~key.isin(hot)), keys, how))


def divided(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may, can't): the rows whose key may be in the column `key` of wanted, and those whose key can't be; nulls are a key.

    Keys are screened where the rows are read, by bitmaps of their hashes that are at most MOST_BITS large and so are
    broadcast: few rows with long texts are found among many without a shuffle of all texts. With more keys than the
    bitmaps can tell apart, more rows may be wanted, and none is lost. wanted should be a written table.
    """
    count = wanted.count()
    bits = min(MOST_BITS, max(1 << 15, 1 << (count * BITS_A_KEY - 1).bit_length() if count else 0))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    at = wanted.select(place.alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("_strandline_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_strandline_bits"))
    near = rows.withColumn("_strandline_bit", F.bitmap_bit_position(place))
    near = near.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_strandline_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_strandline_bits"), (F.col("_strandline_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit: Column = F.coalesce(F.getbit(byte, F.pmod("_strandline_bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    return near.where(hit).select(*rows.columns), near.where(~hit).select(*rows.columns)


def without(documents: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """documents without the rows named in gone (doc_id, mark, once), a written table; all columns stay.

    mark is an expression over documents that tells apart rows of one doc_id. Of rows that repeat doc_id and mark with
    `once`, one stays, whichever. Nulls are equal. Only rows whose doc_id may be in gone are shuffled.
    """
    columns = documents.columns
    may, stay = divided(documents, "doc_id", gone)
    named = gone.select(F.col("doc_id").alias("_strandline_id"), F.col("mark").alias("_strandline_gone"), F.col("once").alias("_strandline_once"))
    once = named.where("_strandline_once")
    marked = may.withColumn("_strandline_mark", mark)
    same = F.col("doc_id").eqNullSafe(F.col("_strandline_id")) & (F.col("_strandline_mark") == F.col("_strandline_gone"))
    if not once.limit(1).count():
        return marked.join(named, same, "left_anti").select(*columns).unionByName(stay)
    out = marked.join(named.where("not _strandline_once"), same, "left_anti")
    one = out.join(once, same, "left_semi").dropDuplicates(["doc_id", "_strandline_mark"])
    return out.join(once, same, "left_anti").unionByName(one).select(*columns).unionByName(stay)
