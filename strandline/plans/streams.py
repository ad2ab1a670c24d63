"""Queries on symbol streams: runs, changes, counts, costs and hazards of the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sequence as Q
from ..operators import stats as A
from ..sources.tables import EVENTS, table
from .registry import query

#: Runs of the events, as common table expressions: g has one row per event, runs one per run, chg a run with its predecessor.
RUNS = """
    c AS (SELECT user_id AS cell, ts, event_id, event_type AS symbol,
                 CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new
          FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
    g AS (SELECT cell, symbol, CAST(sum(new) OVER w AS BIGINT) AS run, row_number() OVER w - 1 AS pos
          FROM c WINDOW w AS (PARTITION BY cell ORDER BY ts, event_id)),
    runs AS (SELECT cell, run, min(symbol) AS symbol, min(pos) AS start_pos, count(*) AS run_len FROM g GROUP BY cell, run),
    chg AS (SELECT cell, run, lag(symbol) OVER w AS from_sym, symbol AS to_sym, lead(symbol) OVER w AS next_sym, run_len, start_pos
            FROM runs WINDOW w AS (PARTITION BY cell ORDER BY run))
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.runs(events(spark, sf_dir), EVENTS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.changes(runs(spark, sf_dir))


@query("rle_runs", f"WITH {RUNS} SELECT * FROM runs")
def rle_runs(spark, sf_dir):
    """Maximal runs of one event type per user."""
    return runs(spark, sf_dir)


@query("run_expand", f"WITH {RUNS} SELECT cell, pos, symbol FROM g")
def run_expand(spark, sf_dir):
    """Runs as one row per event again: the inverse of rle_runs."""
    return Q.expand(runs(spark, sf_dir))


@query("rle_split", f"""WITH {RUNS} SELECT cell, run, symbol, piece, CAST(least(2, run_len - piece * 2) AS BIGINT) AS piece_len
    FROM (SELECT *, unnest(range(0, (run_len + 1) // 2)) AS piece FROM runs)""")
def rle_split(spark, sf_dir):
    """Runs in pieces of at most two, as a format with a largest run needs them."""
    return Q.split_runs(runs(spark, sf_dir), 2)


@query("raster_runs", """
    WITH s AS (SELECT ts, event_id, event_type AS symbol, date_trunc('hour', ts) AS frame FROM events),
    c AS (SELECT *, CASE WHEN symbol IS DISTINCT FROM lag(symbol) OVER (PARTITION BY frame ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM s),
    g AS (SELECT frame, symbol, CAST(sum(new) OVER (PARTITION BY frame ORDER BY ts, event_id) AS BIGINT) AS run FROM c)
    SELECT frame, run, min(symbol) AS symbol, count(*) AS run_len FROM g GROUP BY frame, run""")
def raster_runs(spark, sf_dir):
    """Runs across users within each frame of an hour."""
    w = Window.partitionBy("frame").orderBy("ts", "event_id")
    s = events(spark, sf_dir).select("ts", "event_id", F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("frame"))
    s = s.withColumn("new", (~F.col("symbol").eqNullSafe(F.lag("symbol").over(w))).cast("long")).withColumn("run", F.sum("new").over(w))
    return s.groupBy("frame", "run").agg(F.min("symbol").alias("symbol"), F.count("*").alias("run_len")).withColumn("frame", F.col("frame").cast("timestamp_ntz"))


@query("run_stats_by_symbol", f"""WITH {RUNS} SELECT symbol, count(*) AS n_runs, CAST(sum(run_len) AS BIGINT) AS n_rows, max(run_len) AS longest,
    round(count(*) * 1.0 / sum(run_len), 9) AS stop_ratio FROM runs GROUP BY symbol""")
def run_stats_by_symbol(spark, sf_dir):
    """Runs, rows and the chance that a run ends, per symbol."""
    r = runs(spark, sf_dir).groupBy("symbol")
    r = r.agg(F.count("*").alias("n_runs"), F.sum("run_len").alias("n_rows"), F.max("run_len").alias("longest"))
    return r.withColumn("stop_ratio", F.round(F.col("n_runs") / F.col("n_rows"), 9))


@query("run_position", f"""WITH {RUNS} SELECT g.cell, g.pos, g.pos - r.start_pos AS since, r.start_pos + r.run_len - 1 - g.pos AS forward
    FROM g JOIN runs r ON g.cell = r.cell AND g.run = r.run""")
def run_position(spark, sf_dir):
    """For each event how long its run has lasted and how long it will."""
    g = Q.numbered_runs(events(spark, sf_dir), EVENTS)
    w = Window.partitionBy("cell", "run")
    return g.select("cell", "pos", (F.col("pos") - F.min("pos").over(w)).alias("since"), (F.max("pos").over(w) - F.col("pos")).alias("forward"))


@query("change_rows", f"WITH {RUNS} SELECT cell, run, from_sym, to_sym, run_len FROM chg")
def change_rows(spark, sf_dir):
    """Each change with the symbols before and after and how long the latter lasts."""
    return changes(spark, sf_dir)


@query("flicker_filter", f"""WITH {RUNS} SELECT cell, run, from_sym, to_sym, run_len FROM chg
    WHERE NOT (run_len = 1 AND from_sym IS NOT NULL AND from_sym IS NOT DISTINCT FROM next_sym)""")
def flicker_filter(spark, sf_dir):
    """Changes without those that last one step and go back to the symbol before."""
    w = Window.partitionBy("cell").orderBy("run")
    c = changes(spark, sf_dir).withColumn("_next", F.lead("to_sym").over(w))
    back = (F.col("run_len") == 1) & F.col("from_sym").isNotNull() & F.col("from_sym").eqNullSafe(F.col("_next"))
    return c.where(~back).drop("_next")


@query("symbol_counts", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY event_type")
def symbol_counts(spark, sf_dir):
    """How often each event type occurs."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


@query("freq_rank_remap", """WITH n AS (SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
    SELECT symbol, n, row_number() OVER (ORDER BY n DESC, symbol DESC) - 1 AS rank FROM n""")
def freq_rank_remap(spark, sf_dir):
    """Dense ids by falling frequency."""
    return Q.dense_ranks(symbol_counts(spark, sf_dir).where("symbol is not null"), "symbol")


@query("remapped_stream", """WITH n AS (SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type),
    r AS (SELECT symbol, row_number() OVER (ORDER BY n DESC, symbol DESC) - 1 AS rank FROM n)
    SELECT event_id, rank FROM events JOIN r ON event_type = symbol""")
def remapped_stream(spark, sf_dir):
    """Events with their dense ids: a dictionary join."""
    ranks = freq_rank_remap(spark, sf_dir).select(F.col("symbol").alias("event_type"), "rank")
    return events(spark, sf_dir).join(ranks, "event_type").select("event_id", "rank")


@query("missing_symbols", """SELECT DISTINCT event_type AS symbol FROM events
    WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(*) * 5 >= (SELECT count(*) FROM events))""")
def missing_symbols(spark, sf_dir):
    """Symbols that a dictionary of those with a fifth of all events lacks."""
    counts = symbol_counts(spark, sf_dir).where("symbol is not null")
    total = symbol_counts(spark, sf_dir).agg(F.sum("n").alias("total"))
    large = counts.join(F.broadcast(total)).where("n * 5 >= total").select("symbol")
    return counts.select("symbol").join(large, "symbol", "left_anti")


@query("transitions", f"WITH {RUNS} SELECT from_sym, to_sym, count(*) AS n FROM chg WHERE from_sym IS NOT NULL GROUP BY from_sym, to_sym")
def transitions(spark, sf_dir):
    """Transition counts at changes."""
    return A.transitions(changes(spark, sf_dir))


PIVOT = ("click", "error", "purchase", "signup", "view")
#: Most symbols that a matrix has columns for.
MOST_SYMBOLS = 1000


@query("transition_pivot", f"""WITH {RUNS} SELECT to_sym, {", ".join(f'''count(*) FILTER (from_sym = '{s}') AS "{s}"''' for s in PIVOT)}
    FROM chg WHERE from_sym IS NOT NULL GROUP BY to_sym""")
def transition_pivot(spark, sf_dir):
    """The transition matrix, one row per target, with a column for each symbol of the SQL and each other one that occurs;
    more than MOST_SYMBOLS of those that occur are an error."""
    found = symbol_counts(spark, sf_dir).where("symbol is not null").select("symbol").limit(MOST_SYMBOLS + 1).collect()
    if len(found) > MOST_SYMBOLS:
        raise ValueError(f"a matrix has columns for at most {MOST_SYMBOLS} symbols")
    names = sorted({*PIVOT, *(r.symbol for r in found)})
    t = transitions(spark, sf_dir).groupBy("to_sym").pivot("from_sym", names).agg(F.sum("n"))
    return t.na.fill(0)


COSTS = f"""WITH {RUNS}, t AS (SELECT from_sym, to_sym, count(*) AS n FROM chg WHERE from_sym IS NOT NULL GROUP BY from_sym, to_sym),
    u AS (SELECT *, sum(n) OVER (PARTITION BY from_sym) AS total FROM t)"""


@query("transition_cost", f"{COSTS} SELECT from_sym, to_sym, n, round(-log2(n * 1.0 / total) * n, 6) AS bits FROM u")
def transition_cost(spark, sf_dir):
    """Transition counts with what they cost when each source symbol has its own frequencies."""
    t = transitions(spark, sf_dir)
    total = F.sum("n").over(Window.partitionBy("from_sym"))
    return t.withColumn("bits", F.round(A.shannon(F.col("n"), total), 6))


@query("entropy_bits", """WITH n AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
    SELECT count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n, round(sum(-log2(n * 1.0 / (SELECT sum(n) FROM n)) * n), 6) AS bits FROM n""")
def entropy_bits(spark, sf_dir):
    """What all events cost under their frequencies."""
    return A.cost(symbol_counts(spark, sf_dir).where("symbol is not null"), []).withColumn("bits", F.round("bits", 6))


@query("entropy_by_class", f"{COSTS} SELECT from_sym, count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n, round(sum(-log2(n * 1.0 / total) * n), 6) AS bits FROM u GROUP BY from_sym")
def entropy_by_class(spark, sf_dir):
    """What the changes cost for each source symbol."""
    return A.cost(transitions(spark, sf_dir), ["from_sym"]).withColumn("bits", F.round("bits", 6))


@query("class_symbol_counts", f"""WITH {RUNS} SELECT CASE WHEN from_sym IN ('click', 'view') THEN 0 ELSE 1 END AS class, to_sym, count(*) AS n
    FROM chg WHERE from_sym IS NOT NULL GROUP BY 1, 2""")
def class_symbol_counts(spark, sf_dir):
    """Transition rows summed by a class of their source symbol."""
    t = transitions(spark, sf_dir).withColumn("class", F.when(F.col("from_sym").isin("click", "view"), 0).otherwise(1))
    return t.groupBy("class", "to_sym").agg(F.sum("n").alias("n"))


@query("run_hazard", f"""WITH {RUNS}, l AS (SELECT symbol, least(run_len, 128) AS len FROM runs), k AS (SELECT symbol, len, unnest(range(0, len)) AS k FROM l)
    SELECT symbol, k, count(*) FILTER (len = k + 1) AS stop, count(*) AS seen,
           CAST(greatest(0, least(255, floor(count(*) FILTER (len = k + 1) * 1.0 / count(*) * 257))) AS BIGINT) AS prob FROM k GROUP BY symbol, k""")
def run_hazard(spark, sf_dir):
    """How often runs end at each length, as counts and in 256ths."""
    return A.hazard(runs(spark, sf_dir))


@query("change_late_early", f"WITH {RUNS} SELECT g.cell, g.pos, g.symbol, c.from_sym AS late, c.next_sym AS early FROM g JOIN chg c ON g.cell = c.cell AND g.run = c.run")
def change_late_early(spark, sf_dir):
    """The symbol before and after the current run, held over it."""
    return Q.late_and_early(events(spark, sf_dir), EVENTS)


@query("change_triples", f"WITH {RUNS} SELECT cell, run, coalesce(from_sym, '-') AS prev_sym, to_sym AS this_sym, coalesce(next_sym, '-') AS next_sym FROM chg")
def change_triples(spark, sf_dir):
    """Each run's symbol between its neighbours', with sentinels at both ends."""
    return Q.triples(runs(spark, sf_dir), "-")


@query("lag_line_codes", """SELECT event_id, CASE WHEN event_type = lag(event_type, 1) OVER w THEN 255 WHEN event_type = lag(event_type, 2) OVER w THEN 254
    ELSE CAST(length(event_type) AS INTEGER) END AS code FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_line_codes(spark, sf_dir):
    """255 for the same as before, 254 for the same as the one before that, else a code of the symbol."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_type")
    code = F.when(e == F.lag("event_type", 1).over(w), 255).when(e == F.lag("event_type", 2).over(w), 254).otherwise(F.length(e))
    return events(spark, sf_dir).select("event_id", code.cast("int").alias("code"))


@query("left_neighbour", """SELECT event_id, event_type = lag(event_type) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY user_id, ts, event_id) AS same_as_left FROM events""")
def left_neighbour(spark, sf_dir):
    """Whether an event equals the one of the cell before it in the same frame."""
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("user_id", "ts", "event_id")
    return events(spark, sf_dir).select("event_id", (F.col("event_type") == F.lag("event_type").over(w)).alias("same_as_left"))


@query("symbol_override", "SELECT event_id, CASE WHEN event_id BETWEEN 100 AND 200 AND user_id % 2 = 0 THEN 'view' ELSE event_type END AS symbol FROM events")
def symbol_override(spark, sf_dir):
    """Events of some cells forced to one symbol for a stretch of time."""
    forced = F.col("event_id").between(100, 200) & (F.col("user_id") % 2 == 0)
    return events(spark, sf_dir).select("event_id", F.when(forced, "view").otherwise(F.col("event_type")).alias("symbol"))


@query("interval_pairs", """
    WITH m AS (SELECT user_id, ts, event_id, event_type, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS off_ts
               FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, ts AS on_ts, off_ts, next_type = 'purchase' AS closed FROM m WHERE event_type = 'signup' AND off_ts IS NOT NULL""")
def interval_pairs(spark, sf_dir):
    """Each signup paired with what ends it: the user's next purchase or signup."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = events(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    m = m.select("user_id", "event_id", F.col("ts").alias("on_ts"), F.lead("ts").over(w).alias("off_ts"), "event_type", F.lead("event_type").over(w).alias("next_type"))
    return m.where("event_type = 'signup' and off_ts is not null").select("user_id", "event_id", "on_ts", "off_ts", (F.col("next_type") == "purchase").alias("closed"))


@query("asof_last_change", """SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def asof_last_change(spark, sf_dir):
    """For each event the user's last purchase up to then: an as-of join as a running value, without a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(w).alias("last_purchase"))


@query("change_log", """WITH b AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT * FROM b WHERE event_type IS DISTINCT FROM was)
    SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM k""")
def change_log(spark, sf_dir):
    """Versions of each user's last event type with their times: only what changed is kept."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = events(spark, sf_dir).withColumn("_was", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("_was")))
    return k.select("user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query("tumbling_bits", """WITH n AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 30 AS win FROM events)
    SELECT user_id, win, round(sum(value), 4) AS bits FROM n GROUP BY user_id, win HAVING count(*) = 30""")
def tumbling_bits(spark, sf_dir):
    """Sums of 30 events in a row; a last window that is not full is dropped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = events(spark, sf_dir).select("user_id", "value", F.floor((F.row_number().over(w) - 1) / 30).alias("win"))
    return n.groupBy("user_id", "win").agg(F.round(F.sum("value"), 4).alias("bits"), F.count("*").alias("_n")).where("_n = 30").drop("_n")


@query("bucket_resample", """WITH b AS (SELECT event_type, CAST(floor((event_id - (SELECT min(event_id) FROM events)) * 64.0 / ((SELECT max(event_id) - min(event_id) + 1 FROM events))) AS BIGINT) AS bucket, value FROM events),
    s AS (SELECT bucket, round(sum(value), 4) AS total FROM b GROUP BY bucket)
    SELECT bucket, total, max(total) OVER (ORDER BY bucket) AS scale FROM s""")
def bucket_resample(spark, sf_dir):
    """The whole stream in 64 buckets, with a running maximum as scale."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("event_id").alias("lo"), (F.max("event_id") - F.min("event_id") + 1).alias("n"))
    b = e.join(F.broadcast(ends)).select(F.floor((F.col("event_id") - F.col("lo")) * 64.0 / F.col("n")).alias("bucket"), "value")
    s = b.groupBy("bucket").agg(F.round(F.sum("value"), 4).alias("total"))
    return s.withColumn("scale", F.max("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


@query("sliding_max", """SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS peak FROM events""")
def sliding_max(spark, sf_dir):
    """The largest value in a centred window of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-15, 15)
    return events(spark, sf_dir).select("event_id", F.max("value").over(w).alias("peak"))


@query("golomb_codes", f"""WITH {RUNS}, v AS (SELECT DISTINCT run_len - 1 AS v FROM runs)
    SELECT v, concat(repeat('0', CAST(length(bin(v + 1)) - 1 AS INTEGER)), bin(v + 1)) AS code, CAST(2 * length(bin(v + 1)) - 1 AS INTEGER) AS bits FROM v""")
def golomb_codes(spark, sf_dir):
    """Exponential Golomb codes of the run lengths that occur."""
    v = runs(spark, sf_dir).select((F.col("run_len") - 1).alias("v")).distinct()
    return v.select("v", S.golomb(F.col("v")).alias("code"), S.golomb_bits(F.col("v")).cast("int").alias("bits"))


@query("golomb_size", f"WITH {RUNS} SELECT symbol, CAST(sum(2 * length(bin(run_len)) - 1) AS BIGINT) AS bits FROM runs GROUP BY symbol")
def golomb_size(spark, sf_dir):
    """Bits that the run lengths of each symbol take."""
    return runs(spark, sf_dir).groupBy("symbol").agg(F.sum(S.golomb_bits(F.col("run_len") - 1)).cast("long").alias("bits"))


@query("escape_buckets", f"""WITH {RUNS}, n AS (SELECT run_len AS v, count(*) AS n FROM runs GROUP BY run_len)
    SELECT CASE WHEN n >= 8 THEN v + 32 ELSE CAST(floor(log2(v)) AS BIGINT) END AS token, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values,
           CAST(sum(CASE WHEN n >= 8 THEN 0 ELSE n * floor(log2(v)) END) AS BIGINT) AS raw_bits FROM n GROUP BY 1""")
def escape_buckets(spark, sf_dir):
    """Frequent run lengths as tokens of their own, rare ones as the number of their bits with the bits behind it."""
    n = runs(spark, sf_dir).groupBy(F.col("run_len").alias("v")).agg(F.count("*").alias("n"))
    often, size = F.col("n") >= 8, F.floor(F.log2("v"))
    t = n.withColumn("token", F.when(often, F.col("v") + 32).otherwise(size)).withColumn("raw", F.when(often, 0).otherwise(F.col("n") * size))
    return t.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"), F.sum("raw").cast("long").alias("raw_bits"))


@query("run_histogram_split", f"""WITH {RUNS}, n AS (SELECT run_len, count(*) AS n FROM runs GROUP BY run_len)
    SELECT n >= 8 AS often, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_runs FROM n GROUP BY 1""")
def run_histogram_split(spark, sf_dir):
    """How many run lengths are frequent, and how many runs they cover."""
    n = runs(spark, sf_dir).groupBy("run_len").agg(F.count("*").alias("n"))
    return n.groupBy((F.col("n") >= 8).alias("often")).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_runs"))


@query("unified_tokens", f"""WITH {RUNS}, t AS (SELECT symbol AS token FROM runs UNION ALL SELECT 'run ' || (run_len - 1) FROM runs WHERE run_len > 1)
    SELECT token, count(*) AS n FROM t GROUP BY token""")
def unified_tokens(spark, sf_dir):
    """Symbols and run lengths counted in one alphabet."""
    r = runs(spark, sf_dir)
    t = r.select(F.col("symbol").alias("token")).unionAll(r.where("run_len > 1").select(F.concat(F.lit("run "), F.col("run_len") - 1)))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query("token_order", f"""WITH {RUNS}, o AS (SELECT cell, run, start_pos, symbol, run_len, row_number() OVER (PARTITION BY start_pos % 16 ORDER BY start_pos, cell) - 1 AS place FROM runs)
    SELECT start_pos % 16 AS lane, place, cell, symbol, run_len FROM o""")
def token_order(spark, sf_dir):
    """Runs in the order in which a decoder that walks frame by frame meets them, in 16 lanes."""
    r = runs(spark, sf_dir).withColumn("lane", F.col("start_pos") % 16)
    return Q.placed(r, ["lane"], ["start_pos", "cell"]).select("lane", "place", "cell", "symbol", "run_len")


@query("backtrack_hits", f"""WITH {RUNS} SELECT to_sym, round(avg(CASE WHEN to_sym = before THEN 1.0 ELSE 0.0 END), 9) AS hit
    FROM (SELECT *, lag(to_sym, 2) OVER (PARTITION BY cell ORDER BY run) AS before FROM chg) GROUP BY to_sym""")
def backtrack_hits(spark, sf_dir):
    """How often a change goes back to the symbol before the last one."""
    w = Window.partitionBy("cell").orderBy("run")
    c = changes(spark, sf_dir).withColumn("_before", F.lag("to_sym", 2).over(w))
    return c.groupBy("to_sym").agg(F.round(F.avg(F.when(F.col("to_sym") == F.col("_before"), 1.0).otherwise(0.0)), 9).alias("hit"))


@query("smoothed_bits", None)
def smoothed_bits(spark, sf_dir):
    """Exponential smoothing of each user's values, state carried from event to event."""
    alpha = 0.1

    def smooth(rows):
        rows = rows.sort_values(["ts", "event_id"])
        rows["smooth"] = rows["value"].ewm(alpha=alpha, adjust=False).mean().round(6)
        return rows[["event_id", "smooth"]]

    return events(spark, sf_dir).select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(smooth, "event_id long, smooth double")


@query("range_impact", """WITH v AS (SELECT user_id, ts, event_id, event_type, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_sum FROM events),
    p AS (SELECT user_id, event_id, run_sum - lag(run_sum) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS impact FROM v WHERE event_type = 'purchase')
    SELECT event_id, round(impact, 4) AS impact FROM p WHERE impact IS NOT NULL""")
def range_impact(spark, sf_dir):
    """Sum of values between a purchase and the one before, from differences of running sums instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = events(spark, sf_dir).withColumn("_sum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("event_type = 'purchase'")
    v = v.select("event_id", F.round(F.col("_sum") - F.lag("_sum").over(w), 4).alias("impact"))
    return v.where("impact is not null")


@query("fps_decimate", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 4 = 0")
def fps_decimate(spark, sf_dir):
    """Every fourth frame."""
    return events(spark, sf_dir).where("event_id % 4 = 0").select("event_id", "user_id", "event_type")


@query("value_extent", "SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY event_type")
def value_extent(spark, sf_dir):
    """Least and largest value per symbol."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
