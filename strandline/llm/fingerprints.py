"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A line longer than this counts as several paragraphs, so that a change in it does not hide the rest of it.
PARAGRAPH = 160
#: Tables of a sketch (a digest is in one cell of each), cells of a table in a fingerprint, and in a retry.
TABLES = 4
BASE_CELLS = 5
RETRY_CELLS = 7
#: Digests of both sides that a block of a retry holds on average; blocks that fail are retried with twice the cells.
BLOCK = 12
RETRIES = 3
ROUNDS = 8
#: Bounds of the ordering by doc_id: ranges found by quantiles, documents in a bucket, and buckets in all.
RANGES = 4096
BUCKET_ROWS = 250
MOST_BUCKETS = 100_000
FOUND = "array<struct<side:int,digest:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs: its lines, in pieces of PARAGRAPH code points; empty lines have none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(0xFFFFFFFF)


def _placed(key: Column, check: Column, count: Column, cells: int, seed: int) -> Column:
    """A digest with its check, its count and its cell in each table."""
    h = F.xxhash64(key, F.lit(seed))
    at = [F.pmod(F.shiftrightunsigned(h, 14 * t), F.lit(cells)).cast("int").alias(f"h{t}") for t in range(TABLES)]
    return F.struct(key.alias("k"), check.alias("s"), count.alias("c"), *at)


def sketch(keys: Column, cells: int, seed: int) -> Column:
    """TABLES * cells cells of (c, k, s), table after table: how many digests are in a cell, and the exclusive or of them
    and of their checks."""
    placed = F.transform(keys, lambda d: _placed(d, _check(d), F.lit(1), cells, seed))
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"))
    put = lambda acc, d: F.struct((acc["c"] + 1).alias("c"), acc["k"].bitwiseXOR(d["k"]).alias("k"), acc["s"].bitwiseXOR(d["s"]).alias("s"))
    numbers = F.sequence(F.lit(0), F.lit(cells - 1))

    def table(all_: Column, t: int) -> Column:
        return F.transform(numbers, lambda j: F.aggregate(all_, empty, lambda acc, d: F.when(d[f"h{t}"] == j, put(acc, d)).otherwise(acc)))

    return let(placed, lambda all_: F.concat(*[table(all_, t) for t in range(TABLES)]))


def subtract(a: Column, b: Column) -> Column:
    """Cells of a without those of b: what both have is gone."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["s"].bitwiseXOR(y["s"]).alias("s")))


def peel(difference: Column, cells: int, seed: int) -> Column:
    """(ok, found): the digests that two sketches differ by, each with its side (1: only the first has it, -1: only the
    second), and whether that is all of them.

    A cell with one digest, known by its check, gives that digest; all such digests are taken out of their cells at once,
    which leaves further cells with one. It has worked when every cell is empty. A sketch never gives more digests than it
    has cells, so it isn't tried where the sizes differ by more.
    """
    start = F.struct(difference.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("on"))
    state_type = "struct<cells:array<struct<c:int,k:bigint,s:bigint>>,found:" + FOUND + ",on:boolean>"

    def pure(cell: Column) -> Column:
        return (F.abs(cell["c"]) == 1) & (_check(cell["k"]) == cell["s"])

    def take(state: Column, keys: Column) -> Column:
        placed = F.transform(keys, lambda x: _placed(x["k"], x["s"], x["c"], cells, seed))
        out = lambda acc, x: F.struct((acc["c"] - x["c"]).alias("c"), acc["k"].bitwiseXOR(x["k"]).alias("k"), acc["s"].bitwiseXOR(x["s"]).alias("s"))

        def table(all_: Column, t: int) -> Column:
            own = F.slice(state["cells"], t * cells + 1, cells)
            return F.transform(own, lambda cell, j: F.aggregate(all_, cell, lambda acc, x: F.when(x[f"h{t}"] == j, out(acc, x)).otherwise(acc)))

        done = let(placed, lambda all_: F.concat(*[table(all_, t) for t in range(TABLES)]))
        more = F.transform(keys, lambda x: F.struct(x["c"].alias("side"), x["k"].alias("digest")))
        return F.struct(done.alias("cells"), F.concat(state["found"], more).alias("found"), F.lit(True).alias("on"))

    def turn(state: Column, _: Column) -> Column:
        keys = F.array_distinct(F.filter(state["cells"], pure))
        stop = F.struct(state["cells"], state["found"], F.lit(False).alias("on"))
        tried = let(keys, lambda k: F.when(F.size(k) == 0, stop).otherwise(take(state, k)))
        return F.when(state["on"], tried).otherwise(state).cast(state_type)

    excess = F.aggregate(F.slice(difference, 1, cells), F.lit(0), lambda n, x: n + x["c"])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start.cast(state_type), turn)
    ended = let(end, lambda s: F.struct((~F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0))).alias("ok"), s["found"].alias("found")))
    failed = F.struct(F.lit(False).alias("ok"), F.array().cast(FOUND).alias("found"))
    return F.when(F.abs(excess) > TABLES * cells, failed).otherwise(ended)


def _side(entries: Column, side: int) -> Column:
    return F.transform(F.filter(entries, lambda e: e["side"] == side), lambda e: e["digest"])


def _blocks(a: Column, b: Column) -> Column:
    """The digests of both sides in blocks of BLOCK on average by their hashes, each an array of (block, side, digest). They
    are sorted by block once and cut, so a text of very many paragraphs takes n log n steps."""
    n = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / BLOCK).cast("int"))
    entry = lambda side: lambda d: F.struct(F.pmod(F.xxhash64(d, F.lit(99)), n).cast("int").alias("block"), F.lit(side).alias("side"), d.alias("digest"))

    def cut(entries: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(entries) - 1)
        first = lambda i: (i == 0) | (F.get(entries, i)["block"] != F.get(entries, i - 1)["block"])
        part = lambda starts: lambda p, j: F.slice(entries, p + 1, F.coalesce(F.get(starts, j + 1), F.size(entries)) - p)
        return let(F.filter(numbers, first), lambda starts: F.transform(starts, part(starts)))

    return let(F.array_sort(F.concat(F.transform(a, entry(1)), F.transform(b, entry(-1)))), cut)


def _attempt(state: Column, pairs: int, cells: int, seed: int) -> Column:
    """Peels what is left of state (found, left) by sketches of these cells; what can't be told apart stays left."""
    of = lambda x, side: sketch(_side(x["entries"], side), cells, seed)
    tried = F.transform(state["left"], lambda x: F.struct(peel(subtract(of(x, 1), of(x, -1)), cells, seed).alias("got"), x.alias("x")))

    def gained(t: Column, pair: int) -> Column:
        new = F.transform(F.filter(t, lambda y: y["got"]["ok"] & (y["x"]["pair"] == pair)), lambda y: y["got"]["found"])
        return F.concat(state["found"][pair], F.flatten(new))

    return let(
        tried,
        lambda t: F.struct(
            F.array(*[gained(t, p) for p in range(pairs)]).alias("found"), F.transform(F.filter(t, lambda y: ~y["got"]["ok"]), lambda y: y["x"]).alias("left")
        ),
    )


def with_differences(rows: DataFrame, own: str, others: list[str], base: str = "_") -> DataFrame:
    """rows with `_differs`: for each of `others` the digests that are in just one of it and own, as (side, digest), side 1
    for own; and `_plain`: how many blocks no retry told apart.

    The fingerprints' cells (columns named with `base` in front) are subtracted and peeled. Where that fails the digests
    are dealt into blocks, each with a larger sketch of its own; blocks that fail are retried with twice the cells and
    other hashes. What RETRIES retries leave (two digests with equal hashes throughout) is compared as it is. Each try is
    a projection of its own.
    """
    firsts = [peel(subtract(F.col(base + own), F.col(base + c)), BASE_CELLS, 0) for c in others]
    rows = rows.withColumn("_first", F.array(*firsts))
    empty = F.array().cast("array<struct<pair:int,entries:array<struct<block:int,side:int,digest:bigint>>>>")

    def dealt(pair: int, c: str) -> Column:
        blocks = F.transform(_blocks(F.col(own), F.col(c)), lambda e: F.struct(F.lit(pair).alias("pair"), e.alias("entries")))
        return F.when(F.col("_first")[pair]["ok"], empty).otherwise(blocks)

    found = F.transform("_first", lambda f: F.when(f["ok"], f["found"]).otherwise(F.array().cast(FOUND)))
    rows = rows.withColumn("_state", F.struct(found.alias("found"), F.concat(*[dealt(p, c) for p, c in enumerate(others)]).alias("left")))
    for level in range(RETRIES):
        s = F.col("_state")
        rows = rows.withColumn("_state", F.when(F.size(s["left"]) == 0, s).otherwise(_attempt(s, len(others), RETRY_CELLS << level, level + 1)))

    def plain(pair: int) -> Column:
        left = F.filter("_state.left", lambda x: x["pair"] == pair)
        lone = lambda x, side: F.transform(F.array_except(_side(x["entries"], side), _side(x["entries"], -side)), lambda d: F.struct(F.lit(side).alias("side"), d.alias("digest")))
        return F.concat(F.col("_state.found")[pair], F.flatten(F.transform(left, lambda x: F.concat(lone(x, 1), lone(x, -1)))))

    return rows.withColumns({"_differs": F.array(*[plain(p) for p in range(len(others))]), "_plain": F.size("_state.left")}).drop("_first", "_state")


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Shared digests by all digests of two sets, from their sizes and how many are in just one; 1 for two empty sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - difference) / (total + difference)).cast("double")


def fingerprint(base: Column) -> Column:
    """The cells as text: 14 bytes a cell (count, digests, low half of the checks), in base 64."""
    hexed = F.transform(base, lambda x: F.concat(F.lpad(F.hex(x["c"].bitwiseAND(0xFFFF)), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["s"]), 8, "0")))
    return F.base64(F.unhex(F.array_join(hexed, "")))


# ---- a document, its edited text and the next document ----


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with _at and _tie, by which they are ordered, and _bucket, which ascends with them.

    The order is that of descending doc_id, nulls last, then of the texts' hashes. Ranges lie between RANGES quantiles at
    most, and a doc_id that is two of them has a range of its own. A range is cut evenly by doc_id, that of one doc_id or of
    none by hash, into buckets of about BUCKET_ROWS rows or what makes MOST_BUCKETS of them.
    """
    at = F.bitwise_not(F.col("doc_id"))
    total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    cuts = max(1, min(RANGES, total // BUCKET_ROWS))
    bounds = rows.agg(F.percentile_approx(at, [i / cuts for i in range(cuts + 1)], 10 * RANGES)).first()[0] or [0]
    lows = sorted(set(bounds) | {v + 1 for v, w in zip(bounds, bounds[1:]) if v == w and v < (1 << 63) - 1})
    ends = [*lows[1:], min(max(bounds) + 1, (1 << 63) - 1)]
    room = max(BUCKET_ROWS, -(-total // MOST_BUCKETS))
    shares = Counter(bounds)
    many = [max(1, -(-known * n // (cuts * room))) for n in (max(1, shares[v]) for v in lows)] + [max(1, -(-(total - known) // room))]
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to one constant
    step = 64
    coarse = F.greatest(F.size(F.filter(longs(lows[::step]), lambda x: x <= F.col("_at"))), F.lit(1)) - 1
    rows = rows.withColumns({"_at": F.coalesce(at, F.lit(0).cast("long")), "_tie": F.xxhash64("text")}).withColumn("_coarse", coarse)
    fine = F.greatest(F.size(F.filter(F.slice(longs(lows), F.col("_coarse") * step + 1, step), lambda x: x <= F.col("_at"))), F.lit(1)) - 1
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), len(lows)).otherwise(F.col("_coarse") * step + fine).cast("int"))
    low, end = F.get(longs(lows), F.col("_range")).cast("double"), F.get(longs(ends), F.col("_range")).cast("double")
    by_id = (F.col("_at").cast("double") - low) / F.greatest(end - low, F.lit(1.0))
    share = F.when(F.col("doc_id").isNull() | (end - low <= 1), F.col("_tie") / 2.0**64 + 0.5).otherwise(by_id)
    each = F.get(longs(many), F.col("_range"))
    part = F.least(F.greatest(F.floor(share * each), F.lit(0)), each - 1)
    return rows.withColumn("_bucket", F.col("_range").cast("long") * (1 << 20) + part).drop("_coarse", "_range")


def with_next(documents: DataFrame, carried: dict[str, Callable[[Column], Column]] | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, text, next_text): next in descending doc_id, after the last the first; nulls count as empty.

    carried: further columns as functions of the text, computed once for each document; each comes with a column for the
    next document, next_ in front. Documents are dealt into ordered buckets, and the last of a bucket gets the first of the
    bucket below from a table of one row per bucket; of that table's keys there are so few (MOST_BUCKETS and the ranges)
    that they are broadcast and put in order in one task. Null doc_ids come last; rows of equal doc_id come in order of
    their texts' hashes. Rows are shuffled once.
    """
    rows = _buckets(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    named = {"text": F.col("text")} | {k: f(F.col("text")) for k, f in (carried or {}).items()}
    heads = common.written(rows.groupBy("_bucket").agg(F.min(F.struct("_at", "_tie")).alias("head")), "bucket_heads")
    order = Window.orderBy("_bucket")
    one = F.struct("_bucket", "head")
    wanted = heads.select(F.col("_bucket").alias("_above"), F.coalesce(F.lead(one).over(order), F.first(one).over(order)).alias("w"))
    wanted = wanted.select("_above", F.col("w._bucket"), F.col("w.head._at"), F.col("w.head._tie"))
    first = rows.join(F.broadcast(wanted), ["_bucket", "_at", "_tie"]).groupBy("_above").agg(F.first("text").alias("text"))
    first = common.written(first.select(F.col("_above").alias("_bucket"), F.struct(*[c.alias(k) for k, c in named.items()]).alias("_below")), "bucket_next")
    if kept is not None:  # of a scratch block
        kept.append(first)
    own = Window.partitionBy("_bucket").orderBy("_at", "_tie")
    seen = rows.select("doc_id", "_at", "_tie", "_bucket", *[c.alias(k) for k, c in named.items()])
    seen = seen.withColumns({f"next_{k}": F.lead(k).over(own) for k in named})
    # The window has dealt the rows by bucket already, so this join moves the small table only.
    seen = seen.join(first, "_bucket", "left")
    return seen.select("doc_id", *named, *[F.coalesce(f"next_{k}", f"_below.{k}").alias(f"next_{k}") for k in named])


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many of the other (or all)."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(other, F.lit(1), k))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    A null text is empty, has no digest and an all-zero fingerprint. Equal texts have equal fingerprints. Other columns
    are not read; an empty table gives an empty table. Texts are shuffled once.
    """
    of_text = {"own": digests, "_own": lambda text: sketch(digests(text), BASE_CELLS, 0)}
    with common.scratch(documents.sparkSession) as kept:
        rows = with_next(documents, of_text, kept).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        "own", "_own", digests(F.col("edit")).alias("new"), F.col("next_own").alias("next"), F.col("next__own").alias("_next"),
    )
    rows = with_differences(rows.withColumn("_new", sketch(F.col("new"), BASE_CELLS, 0)), "own", ["new", "next"])
    near = lambda k, other: likeness(F.col("own"), F.col(other), F.size(F.col("_differs")[k]))
    rows = common.gathered(rows)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"),
        near(0, "new").alias("near_edited"), near(1, "next").alias("near_next"),
    )
