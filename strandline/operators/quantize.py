"""Vector quantization of tiles: nearest codes, centroids, pruning, and dictionaries of bit masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import components
from .sequence import placed

#: Most codes of a dictionary; a dictionary is sent to every task.
MOST_CODES = 4096


def codebook(tiles: DataFrame, key: str = "vec_id", tile: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(ids, tiles) of a dictionary, in order of id; more than MOST_CODES rows are an error."""
    rows = tiles.select(key, tile).orderBy(key).limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"a dictionary has at most {MOST_CODES} codes")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def distances(x: np.ndarray, codes: np.ndarray, squared: bool) -> np.ndarray:
    """(len(x), len(codes)) Euclidean distances, or their squares; differences are taken, so equal tiles have 0."""
    out = np.empty((len(x), len(codes)))
    for k, c in enumerate(codes):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out if squared else np.sqrt(out)


def nearest(tiles: DataFrame, codes: tuple[np.ndarray, np.ndarray], bias: float = 0.0, squared: bool = False, key: str = "vec_id", tile: str = "embedding") -> DataFrame:
    """(key, code, dist): each tile's nearest code, the first of equals; `bias` times the code's rank counts as distance.

    No join: the dictionary is small by its bound and is sent along, and a batch of tiles meets it as matrices. Null tiles
    have no code and are left out.
    """
    ids, table = codes

    def run(batches):
        for b in batches:
            x = np.array(b[tile].to_pylist(), np.float64).reshape(b.num_rows, -1)
            if not len(x):
                continue
            d = distances(x, table, squared) + bias * np.arange(len(ids))
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b[key].cast(pa.int64()), pa.array(ids[best]), pa.array(d[np.arange(len(x)), best])], [key, "code", "dist"])

    return tiles.where(F.col(tile).isNotNull()).select(key, tile).mapInArrow(run, f"{key} long, code long, dist double")


def all_distances(tiles: DataFrame, codes: tuple[np.ndarray, np.ndarray], squared: bool = False, key: str = "vec_id", tile: str = "embedding") -> DataFrame:
    """(key, dist): each tile's distances to all codes, in their order, from one pass. Null tiles are left out."""
    _, table = codes

    def run(batches):
        for b in batches:
            x = np.array(b[tile].to_pylist(), np.float64).reshape(b.num_rows, -1)
            d = distances(x, table, squared) if len(x) else np.zeros((0, len(table)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(table), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b[key].cast(pa.int64()), flat], [key, "dist"])

    return tiles.where(F.col(tile).isNotNull()).select(key, tile).mapInArrow(run, f"{key} long, dist array<double>")


def sums(tiles: DataFrame, codes: tuple[np.ndarray, np.ndarray], weight: str | None = None, tile: str = "embedding") -> DataFrame:
    """(code, n, w, total): of each code, how many tiles are nearest to it, their weight and their weighted sums. A batch
    gives one row per code, so what is shuffled does not grow with the tiles. Null tiles are left out; without `weight`, or
    where it is null, a tile counts as one."""
    ids, table = codes

    def run(batches):
        for b in batches:
            x = np.array(b[tile].to_pylist(), np.float64).reshape(b.num_rows, -1)
            if not len(x):
                continue
            w = np.array([1.0 if v is None else v for v in b["w"].to_pylist()], np.float64)
            best = distances(x, table, True).argmin(axis=1)
            used = np.unique(best)
            total = np.zeros((len(ids), x.shape[1]))
            np.add.at(total, best, x * w[:, None])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * x.shape[1], pa.int32()), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(np.bincount(best, minlength=len(ids))[used]), pa.array(np.bincount(best, w, len(ids))[used]), flat], ["code", "n", "w", "total"])

    rows = tiles.where(F.col(tile).isNotNull()).select(tile, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    parts = rows.mapInArrow(run, "code long, n long, w double, total array<double>")
    lanes = [F.sum(F.col("total")[k]).alias(f"v{k}") for k in range(table.shape[1])]
    out = parts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *lanes)
    return out.select("code", "n", "w", F.array(*[f"v{k}" for k in range(table.shape[1])]).alias("total"))


def variants(table: np.ndarray, side: int) -> np.ndarray:
    """The eight variants of each tile, one after the other: bit 0 flips across, bit 1 flips down, bit 2 inverts."""
    t = table.reshape(-1, side, side)
    out = [(-1 if k & 4 else 1) * t[:, :: -1 if k & 2 else 1, :: -1 if k & 1 else 1] for k in range(8)]
    return np.stack(out, axis=1).reshape(-1, side * side)


def centroids(assigned: DataFrame, weight: str = "w", tile: str = "embedding") -> DataFrame:
    """(code, lane, mean) of (code, tile, weight): weighted means lane by lane, with partial sums before the shuffle."""
    lanes = assigned.select("code", weight, F.posexplode(tile).alias("lane", "v"))
    return lanes.groupBy("code", "lane").agg((F.sum(F.col("v").cast("double") * F.col(weight)) / F.sum(weight)).alias("mean"))


def kmeans(tiles: DataFrame, start: int, end: int, rounds: int, kill: int = 8, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ids, tiles) after `rounds` of weighted k-means with pruning.

    The start are the `start` tiles of least hashed id. From the second round on at most `kill` of the least used codes go
    per round (one in each of the first two rounds), until `end` are left; an unused code goes first, and one that stays
    keeps its place. A round is one pass over the tiles and a sum of a row per code and batch; only the dictionary is on
    the driver.
    """
    seeds = tiles.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(start, MOST_CODES))
    ids, table = codebook(seeds)
    for r in range(rounds):
        used = {}
        place = {int(c): k for k, c in enumerate(ids)}
        for row in sums(tiles, (ids, table), weight).collect():
            used[row.code] = row.n
            if row.w:
                table[place[row.code]] = np.array(row.total) / row.w
        order = sorted(range(len(ids)), key=lambda k: (used.get(int(ids[k]), 0), -k))
        most = 1 if r < 2 else kill
        gone = set(order[: max(0, min(most, len(ids) - end))])
        keep = [k for k in range(len(ids)) if k not in gone]
        ids, table = ids[keep], table[keep]
    return ids, table


def masks(tiles: DataFrame, lanes: int, threshold: float = 0.0) -> DataFrame:
    """(vec_id, mask): the first `lanes` lanes as text of 0 and 1."""
    bits = F.transform(F.slice("embedding", 1, lanes), lambda v: F.when(v > threshold, "1").otherwise("0"))
    return tiles.select("vec_id", F.array_join(bits, "").alias("mask"))


def complement(mask):
    """A mask with 0 and 1 exchanged."""
    return F.translate(mask, "01", "10")


def near_pairs(masks_: DataFrame, cutoff: int, width: int) -> DataFrame:
    """(a, b, dist), a < b: all pairs of masks that differ in fewer than `cutoff` places.

    Exact, and without comparing everything: of `cutoff` blocks of a mask at least one is equal in both, so pairs meet
    where a block is equal and are then compared as wholes. Equal masks have to be merged before (see dedup).
    """
    size = -(-width // cutoff)
    block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(cutoff - 1)), lambda i: F.struct(i.alias("i"), F.substring("mask", i * size + 1, F.lit(size)).alias("s")))).alias("block")
    keyed = masks_.select("id", "mask", block)
    other = keyed.select(F.col("id").alias("b"), F.col("mask").alias("mb"), "block")
    met = keyed.join(other, "block").where("id < b").select(F.col("id").alias("a"), "b", differing("mask", "mb").alias("dist"))
    return met.where(F.col("dist") < cutoff).distinct()


def differing(a: str, b: str):
    """In how many places two texts of 0 and 1 of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)).cast("int")


def pruned(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n) that stay when an id goes that has a pair with a more frequent one (of equals, with the smaller id): every
    more frequent neighbour counts, whether it stays or not."""
    n = counts.select("id", "n")
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    ranked = both.join(n.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
    gone = ranked.where("ny > nx or (ny = nx and y < x)").select(F.col("x").alias("id")).distinct()
    return n.join(gone, "id", "left_anti")


def near_components(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): what near pairs (a, b) hold together, for all ids (id)."""
    links = written(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), "near_pairs")
    found = components(links).select(F.col("node").alias("id"), F.col("label").alias("component"))
    return ids.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def first_match(masks_: DataFrame, order: list, width: int, cutoff: int) -> DataFrame:
    """(id, kept): masks (id, mask, ..) are taken in order, and each becomes the first kept one that differs from it in fewer
    than `cutoff` places, or is kept itself.

    Order decides, so each component of near pairs is walked on its own: components don't touch, and run in parallel.
    """
    pairs = near_pairs(masks_.select("id", "mask"), cutoff, width)
    rank = F.row_number().over(Window.partitionBy("component").orderBy(*order))
    rows = masks_.join(near_components(pairs, masks_), "id").withColumn("_rank", rank).select("id", "mask", "component", "_rank")

    def run(group):
        group = group.sort_values("_rank")
        kept: list[tuple[int, int]] = []
        out = []
        for i, mask in zip(group["id"], group["mask"]):
            bits = int(mask, 2)
            hit = next((k for k, m in kept if (bits ^ m).bit_count() < cutoff), None)
            if hit is None:
                kept.append((i, bits))
            out.append(i if hit is None else hit)
        return group[["id"]].assign(kept=out)

    return rows.groupBy("component").applyInPandas(run, "id long, kept long")


def greedy_pruned(counts: DataFrame, width: int, cutoff: int) -> DataFrame:
    """(id, n) of counts (id, mask, n) that stay when they are taken by falling n, then rising id, and one goes that is near
    one that stayed."""
    kept = first_match(counts, [F.desc("n"), F.asc("id")], width, cutoff).where("id = kept").select("id")
    return counts.select("id", "n").join(kept, "id")


def greedy_pruned_moving(counts: DataFrame, width: int, least: int, every: int) -> DataFrame:
    """(id, n) of counts (id, mask, n) that stay when they are taken by falling n, then rising id, and the k-th goes that
    differs in fewer than least + k // every places from one that stayed. A null mask has a place, differs from none and stays.

    The first mask always stays and no two differ in more than width places, so all whose cutoff is larger go without being
    compared. What is walked are the first (width - least + 1) * every - 1, whatever the number of masks; each depends on all
    before it, so that is one task's work, and at most half their square of comparisons.
    """
    ranked = placed(counts.withColumn("_fall", -F.col("n")).withColumn("_all", F.lit(0)), ["_all"], ["_fall", "id"], "_k")
    walked = max((width - least + 1) * every - 1, 2)  # two have a mask between them, as one at most is null
    head = ranked.where((F.col("_k") < walked) | F.col("mask").isNull()).withColumn("cutoff", least + F.floor((F.col("_k") + 1) / every))

    def run(batches):
        kept: list[int] = []
        for b in batches:
            stay = []
            for mask, cutoff in zip(b["mask"].to_pylist(), b["cutoff"].to_pylist()):
                bits = None if mask is None else int(mask or "0", 2)
                free = bits is None or all((bits ^ other).bit_count() >= cutoff for other in kept)
                if free and bits is not None:
                    kept.append(bits)
                stay.append(free)
            yield b.select(["id", "n"]).filter(pa.array(stay, pa.bool_()))

    return head.select("id", "n", "mask", "cutoff", "_k").repartition(1).sortWithinPartitions("_k").mapInArrow(run, "id long, n long")


def least_used(usage: DataFrame, k: int) -> DataFrame:
    """The k least used codes, of equals the larger: what a round of pruning takes away."""
    w = Window.orderBy("n", F.col("code").desc())
    return usage.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)
