"""Near-duplicate documents: fast similarity sketches of word shingles, banding, and exact verification on whole sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, joined_by
from . import common
from .words import chunks, mix, shingles, tidy

#: Sets that are compared with as many others in one task, and their bytes; a set of more bytes is a block of its own.
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Places of an inverted index that are counted at once.
SLICE = 1 << 20
#: Partners of one document that are verified in one task.
FAN = 256


@dataclass(frozen=True)
class Rule:
    """Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of `words`-word shingles.

    `bands` bands of `width` coordinates: two linked documents share no band with a chance of at most
    (1 - s ** width) ** bands, s = percent / 100; see `missed`.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    width: int = 4

    @property
    def size(self) -> int:
        return self.bands * self.width

    @property
    def missed(self) -> float:
        return (1 - (self.percent / 100) ** self.width) ** self.bands


def fast_sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(len(sets), size) coordinates of 32 bits; an empty set has zeros.

    Round r < size puts every element into a bin by a hash of its own, round size + j puts every element into bin j. A bin
    keeps the least hash of the first round that reaches it, so every bin is filled in the end, and a set of n elements
    takes about 1 + size * ln(size) / n rounds. Two sets agree in a coordinate as often as they are similar, with
    concentration as if coordinates were independent. All sets go through a round together.
    """
    n = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    best = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(n * size, bool)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * size, lengths)
    for r in range(2 * size):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            h = mix(x ^ (np.uint64(r + 1) * np.uint64(0xA0761D6478BD642F)))
        place = base + (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64) if r < size else base + (r - size)
        new = ~filled[place]
        place = place[new]
        np.minimum.at(best, place, h[new])
        filled[place] = True
        if r % 2 == 0 or r < 4:
            full = filled.reshape(n, size).all(axis=1)
            stay = ~full[base // size]
            if not stay.all():
                x, base = x[stay], base[stay]
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, size)
    out[lengths == 0] = 0
    return out


def band_keys(sketch: np.ndarray, rule: Rule) -> np.ndarray:
    """(n, bands) 64-bit keys; a key holds the number of its band."""
    with np.errstate(over="ignore"):
        cells = sketch.astype(np.uint64).reshape(len(sketch), rule.bands, rule.width)
        key = np.broadcast_to(np.arange(1, rule.bands + 1, dtype=np.uint64), cells.shape[:2]).copy()
        for k in range(rule.width):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return key


def _set_digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit digest of each set as two columns of longs."""
    with np.errstate(over="ignore"):
        one = [mix(s).sum(dtype=np.uint64) for s in sets]
        two = [mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
    return [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]


def sketch_documents(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, h (a hash of the text), n (size of the shingle set), a and b (a digest of the set), keys (one per band)."""

    def run(batches):
        for b in batches:
            for t in chunks(b["text"]):
                sets = shingles(t, rule.words)
                keys = band_keys(fast_sketch(sets, rule.size), rule).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * rule.bands, pa.int32()), pa.array(keys.ravel()))
                own = [b[c].slice(t.first, len(t)) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), *_set_digests(sets), flat], ["doc_id", "h", "n", "a", "b", "keys"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, h long, n long, a long, b long, keys array<long>")


def shingle_sets(documents: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(node, items): sorted shingle hashes, one row for each of classes (node, doc_id, a, b), a written table.

    Documents that don't stand for a class are screened out where they are read; of the others only sets are shuffled.
    """

    def run(batches):
        for b in batches:
            for t in chunks(b["text"]):
                sets = shingles(t, rule.words)
                yield pa.RecordBatch.from_arrays([*_set_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["a", "b", "items"])

    few = common.divided(documents.select("doc_id", "text"), "doc_id", classes)[0]
    sets = few.select("text").mapInArrow(tidy(run), "a long, b long, items binary").groupBy("a", "b").agg(F.first("items").alias("items"))
    return sets.join(classes.select("a", "b", "node"), ["a", "b"]).select("node", "items")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) whose whole sets pass the rule. A y with very many partners is dealt out over several tasks, each
    with a copy of its set."""
    fan = common.written(pairs.groupBy("y").agg(F.count("*").alias("n")).withColumn("fan", F.ceil(F.col("n") / FAN).cast("int")), "fan")
    dealt = common.join_groups(pairs, fan, ["y"], "n").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("fan")).cast("int")).drop("n", "fan")
    ours = sets.select(F.col("node").alias("x"), F.col("items").alias("xs"))
    theirs = sets.join(fan, sets["node"] == fan["y"]).select("y", F.col("items").alias("ys"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    both = dealt.join(ours, "x").join(theirs, ["y", "salt"]).select("x", "y", "xs", "ys")

    def run(batches):
        for b in batches:
            keep = []
            for xs, ys in zip(b["xs"], b["ys"]):
                p, q = np.frombuffer(xs.as_buffer(), np.uint64), np.frombuffer(ys.as_buffer(), np.uint64)
                least, most = sorted((len(p), len(q)))
                shared = _common(p, q) if 100 * least >= rule.percent * most else 0
                keep.append(shared > 0 and 100 * shared >= rule.percent * (len(p) + len(q) - shared))
            yield b.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return both.mapInArrow(tidy(run), "x long, y long")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared, stars) of classes (node, keys): all (key, node, c) of keys with c > 1 nodes, and (x, y), y the least node of a
    key that x has. One pair for each member of a bucket, however large the bucket is."""
    keyed = classes.select("node", F.explode("keys").alias("key"))
    buckets = common.written(keyed.groupBy("key").agg(F.min("node").alias("y"), F.count("*").alias("c")).where("c > 1"), "buckets")
    shared = common.written(common.join_groups(keyed, buckets, ["key"], "c", how="inner"), "shared")
    return shared, shared.where("node <> y").select(F.col("node").alias("x"), "y").distinct()


def unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of keys of three or more nodes (of two, the star was all there is) from more than one component.

    Keys that have the very same nodes are taken once: they are known by two exclusive ors of their nodes' hashes.
    """
    full = shared.where("c > 2").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keys = full.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q"),
    ).where("lo <> hi")
    keys = common.written(keys.groupBy("c", "p", "q").agg(F.min("key").alias("key")).select("key", "c"), "mixed_keys")
    return common.written(common.join_groups(full, keys, ["key"], "c", how="inner").drop("c"), "unsettled")


def _overlaps(flat: np.ndarray, who: np.ndarray, many: int, items: np.ndarray) -> np.ndarray:
    """How many of items each of `many` sets has; flat: all their elements in order, who: the set of each."""
    first, count = np.searchsorted(flat, items, "left"), np.searchsorted(flat, items, "right")
    count -= first
    first, count = first[count > 0], count[count > 0]
    total, out, at = np.cumsum(count), np.zeros(many, np.int64), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        n = count[at:to]
        places = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(who[places], minlength=many)
        at = to
    return out


def compared(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): the links that join components inside the keys of rows (key, node, label).

    Linked documents share a key, and where neither is the key's least node the star has not compared them. A key's nodes
    are its members; those outside its largest component are guests too, and each guest is compared with each member.
    Members and guests are dealt into blocks by count and by bytes, and a task takes one block of each, so what it holds is
    bounded. Shared shingles are counted through an inverted index of the members: pairs are compared but never written
    down, and only a link that joins two components is returned. A task ends once all it holds is one component.
    """
    sized = rows.join(sets.select("node", F.length("items").cast("long").alias("bytes")), "node")
    parts = sized.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    deal = parts.groupBy("key").agg(F.max(F.struct("n", "label", "bytes")).alias("_m"), F.sum("n").alias("c"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES, F.lit(1))).cast("int")
    deal = deal.select("key", F.col("_m.label").alias("main"), "c", blocks(F.col("c"), F.col("bytes")).alias("blocks"), blocks(F.col("c") - F.col("_m.n"), F.col("bytes") - F.col("_m.bytes")).alias("rounds"))
    dealt = common.join_groups(rows, common.written(deal, "deal"), ["key"], "c")
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(5)), F.col("rounds")).cast("int"))
    dealt = dealt.withColumn("outside", F.col("label") != F.col("main"))
    place = lambda block, turn, member, guest: F.struct(block.alias("block"), turn.alias("turn"), member.alias("member"), guest.alias("guest"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("rounds") - 1), lambda j: place(F.col("home"), j, F.lit(True), F.col("outside") & (j == F.col("turn"))))
    visits = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.col("outside") & (i != F.col("home"))), lambda i: place(i, F.col("turn"), F.lit(False), F.lit(True)))
    dealt = dealt.select("key", "node", "label", "main", F.explode(F.concat(at_home, visits)).alias("at"))
    full = dealt.join(sets, "node").select("key", "at.block", "at.turn", "node", "label", "main", "at.member", "at.guest", "items")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, labels, main = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["main"][0].as_py()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"]]
        own = np.flatnonzero(rows["member"].to_numpy(zero_copy_only=False))
        guests = np.flatnonzero(rows["guest"].to_numpy(zero_copy_only=False))
        sizes = np.array([len(items[i]) for i in own], np.int64)
        flat = np.concatenate([items[i] for i in own] or [np.zeros(0, np.uint64)])
        who = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        root = {int(v): int(v) for v in np.unique(labels)}
        apart = len(root)

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        x, y = [], []
        for i in guests if apart > 1 else []:
            both = _overlaps(flat, who, len(own), items[i])
            hits = np.flatnonzero((both > 0) & (100 * both >= rule.percent * (sizes + len(items[i]) - both)) & (labels[own] != labels[i]))
            for k in hits:
                a, b = find(int(labels[i])), find(int(labels[own[k]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    apart -= 1
                    x.append(int(nodes[i]))
                    y.append(int(nodes[own[k]]))
            if apart == 1:
                break
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return full.groupBy("key", "block", "turn").applyInArrow(run, "x long, y long")


def linked(documents: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(rows, components): rows (doc_id, h, n, a, b, keys) of all documents, and (a, b, copies, component, label) of all classes,
    where a class are the documents with one set of shingles, label is the same for all classes that links lead to from
    one another, and component their least doc_id. Both are written tables."""
    spark = documents.sparkSession
    with common.scratch(spark) as kept:
        rows = common.written(sketch_documents(documents, rule), "sketches")
        kept.append(rows)
        classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
        classes = common.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        shared, stars = candidates(classes)
        stars = common.written(stars, "stars")

        def sets_of(nodes: DataFrame) -> DataFrame:
            asked = common.written(classes.select("node", "doc_id", "a", "b").join(nodes, "node", "left_semi"), "asked")
            return common.written(shingle_sets(documents, asked, rule), "sets")

        ends = stars.select(F.col("x").alias("node")).unionByName(stars.select(F.col("y").alias("node"))).distinct()
        labels = components(verified(stars, sets_of(ends), rule))
        open_rows = unsettled(shared, labels)
        if open_rows.limit(1).count():
            more = compared(open_rows, sets_of(open_rows.select("node").distinct()), rule)
            labels = joined_by(labels, more)
        known = classes.select("node", "a", "b", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        known = common.written(known, "labelled")
        least = common.written(known.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("m")), "least")
        final = common.join_groups(known, least, ["label"], "m").select("a", "b", "copies", "component", "label")
        final = common.written(final, "components")
        kept.append(final)
    return rows, final


def near_duplicates(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z count as a-z, words are what white space (space, tab to carriage return) separates; a text of fewer words than a
    shingle has is one shingle, a null or empty text has none and is linked with nothing. component_id is the least doc_id
    that links lead to, and null where they lead to no row with a doc_id. Documents with equal sets are one class, found by
    a digest before the shuffle, and only classes take part in the rest; rows of one doc_id and different sets are judged
    each on its own. kept is doc_id = component_id, and false without doc_id. Documents are read again only where a
    candidate pair has to be verified. Other columns are not read; an empty table gives an empty table.
    """
    rows, final = linked(documents, rule)
    out = common.join_groups(rows.where("n > 0").select("doc_id", "n", "a", "b"), final.drop("label"), ["a", "b"], "copies")
    out = out.select("doc_id", "n", F.col("component")).unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False))
    return common.gathered(out).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """documents with one row of each group of linked rows, that with the least doc_id; all columns stay.

    Rows without doc_id come last: one of them stays only where its whole group has no doc_id. Null and empty texts are
    linked with nothing and all stay. Only rows whose doc_id may be among those that go are shuffled.
    """
    with common.scratch(documents.sparkSession) as kept:
        rows, final = linked(documents, rule)
        met = common.join_groups(rows.where("n > 0").select("doc_id", "h", "a", "b"), final.drop("component"), ["a", "b"], "copies")
        ends = met.groupBy("label", "doc_id", "h").agg(F.count("*").alias("n"))
        ends = common.written(ends.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")), "ends")
        first = common.written(ends.groupBy("label").agg(F.min("rank").alias("first"), F.count("*").alias("m")).where("m > 1"), "firsts")
        gone = common.join_groups(ends, first, ["label"], "m").withColumn("once", F.coalesce(F.col("rank").eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True)))
        gone = common.written(gone.where("not once or n > 1").select("doc_id", F.col("h").alias("mark"), "once"), "gone")
        kept.append(gone)
        return common.without(documents, gone, F.xxhash64("text"))
