"""Runs, changes and neighbours in keyed, ordered symbol streams."""

from __future__ import annotations

from bisect import bisect_right
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import written
from ..sources.tables import SequenceSpec, stream
from .groups import join_groups


def ordered(spec: SequenceSpec) -> Window:
    return Window.partitionBy("cell").orderBy(*[f"o{i}" for i in range(1, len(spec.order) + 1)])


def numbered_runs(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """The stream with `run` (from 1 in each cell) and `pos` (from 0). One sort by cell and order serves all of it."""
    w = ordered(spec)
    s = stream(df, spec).withColumn("_new", (~F.col("symbol").eqNullSafe(F.lag("symbol").over(w))).cast("long"))
    return s.select("*", F.sum("_new").over(w).alias("run"), (F.row_number().over(w) - 1).cast("long").alias("pos")).drop("_new")


def runs(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """(cell, run, symbol, start_pos, run_len): maximal stretches of one symbol. The lengths of a cell sum to its rows."""
    g = numbered_runs(df, spec).groupBy("cell", "run")
    return g.agg(F.min("symbol").alias("symbol"), F.min("pos").alias("start_pos"), F.count("*").alias("run_len"))


def expand(runs_: DataFrame) -> DataFrame:
    """(cell, pos, symbol): runs as one row per place again."""
    at = F.explode(F.sequence("start_pos", F.col("start_pos") + F.col("run_len") - 1)).alias("pos")
    return runs_.select("cell", at, "symbol")


def changes(runs_: DataFrame) -> DataFrame:
    """(cell, run, from_sym, to_sym, run_len): runs with the symbol before them; a cell's first run changes from nothing."""
    w = Window.partitionBy("cell").orderBy("run")
    return runs_.select("cell", "run", F.lag("symbol").over(w).alias("from_sym"), F.col("symbol").alias("to_sym"), "run_len")


def late_and_early(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """(cell, pos, symbol, late, early): the symbol of the run before and after, held over the current run."""
    r, w = runs(df, spec), Window.partitionBy("cell").orderBy("run")
    r = r.select("*", F.lag("symbol").over(w).alias("late"), F.lead("symbol").over(w).alias("early"))
    at = F.explode(F.sequence("start_pos", F.col("start_pos") + F.col("run_len") - 1)).alias("pos")
    return r.select("cell", at, "symbol", "late", "early")


def triples(runs_: DataFrame, sentinel: str) -> DataFrame:
    """(cell, run, prev_sym, this_sym, next_sym), with a sentinel before the first and after the last run."""
    w = Window.partitionBy("cell").orderBy("run")
    return runs_.select(
        "cell", "run", F.coalesce(F.lag("symbol").over(w), F.lit(sentinel)).alias("prev_sym"), F.col("symbol").alias("this_sym"),
        F.coalesce(F.lead("symbol").over(w), F.lit(sentinel)).alias("next_sym"),
    )


def dense_ranks(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """counts with `rank`: 0 for the most frequent key; of equal counts the larger key comes first. counts has one row per
    symbol of the alphabet, so its order is that of a dictionary, not of the data."""
    return counts.withColumn("rank", (F.row_number().over(Window.orderBy(F.col(n).desc(), F.col(key).desc())) - 1).cast("long"))


def split_runs(runs_: DataFrame, most: int) -> DataFrame:
    """Runs longer than `most` as several pieces of at most that length: (cell, run, symbol, piece, piece_len)."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("run_len") - 1) / most))).alias("piece")
    out = runs_.select("cell", "run", "symbol", "run_len", pieces)
    return out.select("cell", "run", "symbol", "piece", F.least(F.lit(most), F.col("run_len") - F.col("piece") * most).cast("long").alias("piece_len"))


def epoch_batches(rows: DataFrame, place: str, size: int, epoch: int) -> DataFrame:
    """rows with chunk and batch: contiguous chunks of `size` places from an offset that depends on the epoch, and their
    number in the epoch's shuffled order. The order is one row per chunk; it is dealt into ranges by the digest's first
    digits and counted range by range, so no task sorts all chunks."""
    offset = int(md5(f"epoch {epoch}".encode()).hexdigest()[:4], 16) % size
    out = rows.withColumn("chunk", F.floor((F.col(place) + offset) / size))
    order = out.select("chunk").distinct().withColumn("key", F.md5(F.concat("chunk", F.lit(f"/{epoch}"))))
    order = order.withColumn("range", F.substring("key", 1, 3))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 ranges
    sizes = order.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("range").orderBy("key")
    ranked = order.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(sizes.select("range", "start")), "range")
    return out.join(ranked.select("chunk", (F.col("start") + F.col("at")).alias("batch")), "chunk")


def placed(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 0, among those of equal `by`, in the order of `order`, whose last columns must tell rows
    apart.

    Rows are dealt out in ranges of both and put in order inside a range; a range's rows are numbered where they lie, and
    from the counts of each `by` and range comes what lies before it. So a group may be as large as the table, and no task
    has more than a range.
    """
    inside = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    numbered = written(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": inside}), "placed")
    counts = numbered.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not rows
    counts = written(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))), "places")
    met = join_groups(numbered, counts, [*by, "_part"], "_n")
    return met.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_n", "_start")


def global_runs(rows: DataFrame, frame: str, order: list[str]) -> DataFrame:
    """(run, symbol, frame, run_len) of rows (frame, *order, symbol): runs in the order of frame, then order, that go on over
    the ends of frames; frame is the one that a run starts in.

    Frames are sorted each on its own. What goes on from the frame before is told from a row per frame: its first and last
    symbol and how many changes it has; these are few, and one task puts them in order.
    """
    w = Window.partitionBy(frame).orderBy(*order)
    s = rows.withColumn("_new", (~F.col("symbol").eqNullSafe(F.lag("symbol").over(w))).cast("long")).withColumn("_in", F.sum("_new").over(w))
    inner = s.groupBy(frame, "_in").agg(F.min("symbol").alias("symbol"), F.count("*").alias("n"))
    inner = written(inner, "frame_runs")
    ends = inner.groupBy(frame).agg(F.max("_in").alias("many"), F.max(F.when(F.col("_in") == 1, F.col("symbol"))).alias("head"), F.max_by("symbol", "_in").alias("tail"))
    by_frame = Window.orderBy(frame)
    goes_on = F.coalesce(F.lag("tail").over(by_frame).eqNullSafe(F.col("head")) & F.lag("many").over(by_frame).isNotNull(), F.lit(False)).cast("long")
    ends = ends.select(frame, "many", goes_on.alias("on"))
    before = by_frame.rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(frame, (F.coalesce(F.sum(F.col("many") - F.col("on")).over(before), F.lit(0)) - F.col("on")).alias("start"))
    out = inner.join(starts, frame).groupBy((F.col("start") + F.col("_in")).alias("run"))
    return out.agg(F.min("symbol").alias("symbol"), F.min(frame).alias(frame), F.sum("n").alias("run_len"))


def chosen_runs(runs_: DataFrame, symbols: tuple[str, ...], most: int) -> DataFrame:
    """(cell, run, symbol, piece, kind, n): runs of the chosen symbols in pieces of at most `most`, kind run, and all other
    events one by one, kind symbol."""
    chosen = F.col("symbol").isin(*symbols)
    pieces = F.when(chosen, F.ceil(F.col("run_len") / most)).otherwise(F.col("run_len"))
    out = runs_.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    n = F.when(chosen, F.least(F.lit(most), F.col("run_len") - F.col("piece") * most)).otherwise(F.lit(1)).cast("long")
    return out.select("cell", "run", "symbol", "piece", F.when(chosen, "run").otherwise("symbol").alias("kind"), n.alias("n"))


def each_stream(rows: DataFrame, key: str, order: list[str], columns: list[str], code, schema: str) -> DataFrame:
    """What code(key, lists of the columns in order) returns, rows of `schema` as tuples, for each key.

    Streams are dealt out by key over all tasks, however little data they are, as coding takes more time than bytes; a
    partition is sorted and its streams are coded one after the other, so a task holds one stream. One stream's rows
    depend on those before them, so it is one task's work even if it has a third of all rows. Null keys are a key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*dict.fromkeys([key, *order, *columns])).repartition(parts, key).sortWithinPartitions(key, *order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    def run(batches):
        now, held, out, begun = None, [[] for _ in columns], [], False
        for b in batches:
            keys = b[key].to_pylist()
            lists = [b[c].to_pylist() for c in columns]
            at = 0
            while at < len(keys):
                # Keys ascend, nulls first.
                to = bisect_right(keys, keys[at], at) if keys[at] is not None else next((k for k in range(at, len(keys)) if keys[k] is not None), len(keys))
                if begun and keys[at] != now:
                    out += code(now, *held)
                    held = [[] for _ in columns]
                    if len(out) > 2000:
                        yield table(out)
                        out = []
                now, begun = keys[at], True
                for h, x in zip(held, lists):
                    h += x[at:to]
                at = to
        if begun:
            out += code(now, *held)
        yield table(out)

    return dealt.mapInArrow(run, schema)


def merged(runs_: DataFrame) -> DataFrame:
    """(cell, run, symbol, start_pos, run_len) of runs some of which have got another symbol: neighbours with one symbol are
    one run again, numbered from 1."""
    w = Window.partitionBy("cell").orderBy("run")
    new = (~F.col("symbol").eqNullSafe(F.lag("symbol").over(w))).cast("long")
    s = runs_.select("cell", "run", "symbol", "start_pos", "run_len", new.alias("_new")).withColumn("_id", F.sum("_new").over(w))
    return s.groupBy("cell", F.col("_id").alias("run")).agg(F.min("symbol").alias("symbol"), F.min("start_pos").alias("start_pos"), F.sum("run_len").alias("run_len"))


def single_steps_skipped(runs_: DataFrame) -> DataFrame:
    """(cell, run, symbol, length): runs that take in the run after them if it has one step and isn't the cell's last; a run
    that is taken in takes in nothing. So of neighbouring runs of one step every other one goes, from the first that has a
    run before it."""
    w, back = Window.partitionBy("cell").orderBy("run"), Window.partitionBy("cell")
    one = (F.col("run_len") == 1) & (F.col("run") > 1) & (F.col("run") < F.max("run").over(back))
    s = runs_.select("cell", "run", "symbol", "run_len", one.alias("_one"))
    s = s.withColumn("_chain", F.sum((~F.col("_one")).cast("long")).over(w))
    nth = F.sum(F.col("_one").cast("long")).over(Window.partitionBy("cell", "_chain").orderBy("run"))
    s = s.withColumn("_gone", F.col("_one") & (nth % 2 == 1))
    s = s.withColumn("length", F.col("run_len") + F.coalesce(F.lead("_gone").over(w).cast("long"), F.lit(0)))
    return s.where("not _gone").select("cell", "run", "symbol", "length")
