"""Counts, transitions, costs, hazards and bit trees of symbol streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import probability_byte


def transitions(changes: DataFrame) -> DataFrame:
    """(from_sym, to_sym, n) at changes; a cell's first run has no transition."""
    return changes.where("from_sym is not null").groupBy("from_sym", "to_sym").agg(F.count("*").alias("n"))


def shannon(n: Column, total: Column) -> Column:
    """Bits that n of total occurrences cost under their own frequency."""
    return -F.log2(n / total) * n


def cost(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n_symbols, n, bits) of counts (.., n): what coding each group with its own frequencies costs."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total")) if by else counts.agg(F.sum("n").alias("_total"))
    joined = counts.join(totals, by) if by else counts.join(F.broadcast(totals))
    return joined.groupBy(*by).agg(F.count("*").alias("n_symbols"), F.sum("n").alias("n"), F.sum(shannon(F.col("n"), F.col("_total"))).alias("bits"))


def hazard(runs: DataFrame, cap: int = 128) -> DataFrame:
    """(symbol, k, stop, seen, prob): of the runs that reach length k + 1 how many end there, as a count and in 256ths.

    Runs of `cap` and more share the last row. Run lengths are counted first, so what is expanded is one row per symbol
    and distinct length and step, at most cap rows each, never one per run.
    """
    lengths = runs.groupBy("symbol", F.least("run_len", F.lit(cap)).alias("len")).agg(F.count("*").alias("n"))
    steps = lengths.select("symbol", "len", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("k"))
    out = steps.groupBy("symbol", "k").agg(F.sum(F.when(F.col("len") == F.col("k") + 1, F.col("n")).otherwise(0)).alias("stop"), F.sum("n").alias("seen"))
    return out.withColumn("prob", probability_byte(F.col("stop") / F.col("seen")))


def bit_tree(counts: DataFrame, bits: int) -> DataFrame:
    """(level, prefix, zero, total, prob) of counts (symbol number, n): how often the next bit is 0 after each prefix."""
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    rows = counts.select("symbol", "n", level).withColumn("prefix", F.expr(f"shiftright(symbol, {bits} - level)"))
    bit = F.expr(f"shiftright(symbol, {bits} - 1 - level) & 1")
    out = rows.groupBy("level", "prefix").agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("zero"), F.sum("n").alias("total"))
    return out.withColumn("prob", probability_byte(F.col("zero") / F.col("total")))


def lopped_size(elements: int) -> int:
    """Nodes that a probability tree keeps for that many symbols: prefixes that no symbol has are left out."""
    bits = max(1, (elements - 1).bit_length())
    return sum(-(-elements // (1 << (bits - level))) if level else 1 for level in range(bits))


def change_bits(runs_: DataFrame, cap: int = 128) -> DataFrame:
    """(cell, stay_bits, change_bits): -log2 of the chances, summed, that each step of a cell's runs stays or changes as it does,
    and that what comes is what comes.

    A run's steps cost what its symbol's hazards up to its length sum to, so a run is looked up once by (symbol, length) in
    a table of at most cap rows a symbol; steps beyond share the last row. The last run of a cell ends without a change.
    """
    h = hazard(runs_, cap).select("symbol", "k", (F.col("stop") / F.col("seen")).alias("p"))
    upto = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    stay = F.when(F.col("p") < 1, -F.log2(1 - F.col("p"))).otherwise(0.0)
    table = h.withColumn("stay", stay).select("symbol", "k", "p", "stay", F.coalesce(F.sum("stay").over(upto), F.lit(0.0)).alias("before"))
    w = Window.partitionBy("cell").orderBy("run")
    r = runs_.select("cell", "run", "symbol", "run_len", F.lead("symbol").over(w).alias("next"), F.least(F.col("run_len") - 1, F.lit(cap - 1)).alias("k"))
    moves = r.where("next is not null").groupBy("symbol", "next").agg(F.count("*").alias("n"))
    moves = moves.withColumn("move", -F.log2(F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))).drop("n")
    met = r.join(F.broadcast(table), ["symbol", "k"]).join(F.broadcast(moves), ["symbol", "next"], "left")
    beyond = F.greatest(F.col("run_len") - 1 - F.col("k"), F.lit(0)) * F.col("stay")
    change = F.when(F.col("next").isNotNull(), -F.log2("p") + F.col("move")).otherwise(0.0)
    return met.groupBy("cell").agg(F.sum(F.col("before") + beyond).alias("stay_bits"), F.sum(change).alias("change_bits"))
