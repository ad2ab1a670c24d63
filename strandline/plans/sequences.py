"""Further queries on sequences: runs over frame ends, runs of chosen symbols, good-enough symbols, sizes of change streams,
dictionaries with moving cutoffs, and what a match decoder needs."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gif
from ..functions import huffman as H
from ..functions import scalars as S
from ..operators import quantize as V
from ..operators import sequence as Q
from ..operators import stats as A
from ..sources.binary import write_files
from ..sources.shared import new_path, written
from .codecs import skips
from .registry import SQL, query
from .streams import RUNS, escape_buckets, events, lag_line_codes, runs
from .tiles import LEVELS, coarse, levels
from .twins import _KEPT, huffman_bits

#: Frames of an animation, and what is told of each.
GIF_FRAMES = 50
BOX = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("frame", "x", "y", "width", "height")]])


@query("raster_runs_global", """WITH s AS (SELECT ts, event_id, event_type AS symbol, date_trunc('day', ts) AS frame FROM events),
    c AS (SELECT *, CASE WHEN symbol IS DISTINCT FROM lag(symbol) OVER (ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM s),
    g AS (SELECT frame, symbol, CAST(sum(new) OVER (ORDER BY ts, event_id) AS BIGINT) AS run FROM c)
    SELECT run, min(symbol) AS symbol, min(frame)::TIMESTAMP AS frame, count(*) AS run_len FROM g GROUP BY run""")
def raster_runs_global(spark, sf_dir):
    """Runs across users in one order of all events; a day is a frame, and runs go on over midnight."""
    s = events(spark, sf_dir).select("ts", "event_id", F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").alias("frame"))
    return Q.global_runs(s, "frame", ["ts", "event_id"]).withColumn("frame", F.col("frame").cast("timestamp_ntz"))


CHOSEN = ("view", "click")


@query("chosen_runs", f"""WITH {RUNS}, p AS (SELECT cell, run, symbol, run_len, symbol IN ('view', 'click') AS chosen FROM runs),
    u AS (SELECT cell, run, symbol, chosen, CAST(unnest(range(0, CASE WHEN chosen THEN (run_len + 2) // 3 ELSE run_len END)) AS BIGINT) AS piece, run_len FROM p)
    SELECT cell, run, symbol, piece, CASE WHEN chosen THEN 'run' ELSE 'symbol' END AS kind, CAST(CASE WHEN chosen THEN least(3, run_len - piece * 3) ELSE 1 END AS BIGINT) AS n FROM u""")
def chosen_runs(spark, sf_dir):
    """Tokens of a format that codes runs of two symbols only, of at most three, and all other events one by one."""
    return Q.chosen_runs(runs(spark, sf_dir), CHOSEN, 3)


@query("good_enough", """WITH RECURSIVE e AS (SELECT user_id, event_id, round(value) AS v, round(value / 10) * 10 AS best, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, k, best AS shown, false AS kept FROM e WHERE k = 1 UNION ALL
        SELECT user_id, event_id, k, CASE WHEN stay THEN shown ELSE best END, stay FROM (SELECT e.user_id, e.event_id, e.k, e.best, s.shown,
            s.shown = e.best OR abs(s.shown - e.v) < 12 OR abs(s.shown - e.v) <= abs(e.v - e.best) + 6 AS stay FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
    SELECT event_id, shown, kept FROM s""")
def good_enough(spark, sf_dir):
    """Each user's values in steps of ten, where the last one shown stays while it is nearer than 12, or at most 6 worse than
    the best, or the best itself. What is shown decides about what comes next, so a user's events are walked in order."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        shown, out, kept = None, [], []
        for v, best in zip(rows["v"], rows["best"]):
            stay = shown is not None and (shown == best or abs(shown - v) < 12 or abs(shown - v) <= abs(v - best) + 6)
            shown = shown if stay else best
            out.append(shown)
            kept.append(stay)
        return pd.DataFrame({"event_id": rows["event_id"], "shown": out, "kept": kept})

    e = events(spark, sf_dir).where("user_id is not null and value is not null").select("user_id", "ts", "event_id", F.round("value").alias("v"), (F.round(F.col("value") / 10) * 10).alias("best"))
    return e.groupBy("user_id").applyInPandas(walk, "event_id long, shown double, kept boolean")


HAZARDS = f"""{RUNS}, l AS (SELECT symbol, least(run_len, 128) AS len FROM runs), h AS (SELECT symbol, k, count(*) FILTER (len = k + 1) * 1.0 / count(*) AS stop FROM (SELECT symbol, len, unnest(range(0, len)) AS k FROM l) GROUP BY symbol, k),
    t AS (SELECT from_sym, to_sym, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY from_sym) AS p FROM chg WHERE from_sym IS NOT NULL GROUP BY from_sym, to_sym)"""


@query("change_size_estimate", f"""WITH {HAZARDS}, u AS (SELECT cell, run, symbol, unnest(range(0, run_len)) AS k, run_len FROM runs),
    s AS (SELECT u.cell, sum(CASE WHEN u.k < u.run_len - 1 THEN -log2(1 - h.stop) ELSE 0 END) AS stay FROM u JOIN h ON h.symbol = u.symbol AND h.k = least(u.k, 127) GROUP BY u.cell),
    m AS (SELECT c.cell, sum(-log2(h.stop) - log2(t.p)) AS new FROM chg c JOIN runs b ON b.cell = c.cell AND b.run = c.run - 1 JOIN h ON h.symbol = b.symbol AND h.k = least(b.run_len - 1, 127) JOIN t ON t.from_sym = c.from_sym AND t.to_sym = c.to_sym GROUP BY c.cell)
    SELECT s.cell, round(stay, 4) AS stay_bits, round(coalesce(new, 0), 4) AS change_bits FROM s LEFT JOIN m USING (cell)""")
def change_size_estimate(spark, sf_dir):
    """Bits of each user's stream in the format that says for each step whether the symbol stays, and else which comes: sums
    of -log2 of the chances, from the runs alone."""
    return A.change_bits(runs(spark, sf_dir)).select("cell", F.round("stay_bits", 4).alias("stay_bits"), F.round("change_bits", 4).alias("change_bits"))


@query("component_sizes", f"""WITH {HAZARDS}, u AS (SELECT symbol, run_len, CAST(2 * floor(log2(run_len)) + 1 AS BIGINT) AS bits FROM runs),
    n AS (SELECT symbol, count(*) AS n, sum(count(*)) OVER () AS total FROM runs GROUP BY symbol),
    p AS (SELECT 'run lengths' AS component, symbol AS part, sum(bits)::DOUBLE AS bits FROM u GROUP BY symbol UNION ALL SELECT 'symbols', symbol, -log2(n / total) * n FROM n UNION ALL SELECT 'tables', symbol, 8.0 * count(*) FROM h GROUP BY symbol)
    SELECT component, part, round(sum(bits), 3) AS bits FROM p GROUP BY ROLLUP (component, part)""")
def component_sizes(spark, sf_dir):
    """Bits of the parts of a coded stream, symbol by symbol, with a line for each part and one for all: run lengths by
    exponential Golomb codes, symbols by their entropy, and the tables of chances, a byte each."""
    r = runs(spark, sf_dir)
    part = lambda name, df, bits: df.select(F.lit(name).alias("component"), F.col("symbol").alias("part"), bits.cast("double").alias("bits"))
    lengths = part("run lengths", r.groupBy("symbol").agg(F.sum(S.golomb_bits(F.col("run_len") - 1)).alias("b")), F.col("b"))
    n = r.groupBy("symbol").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    symbols = part("symbols", n, -F.log2(F.col("n") / total) * F.col("n"))
    tables = part("tables", A.hazard(r).groupBy("symbol").agg(F.count("*").alias("n")), 8.0 * F.col("n"))
    every = lengths.unionByName(symbols).unionByName(tables)
    return every.rollup("component", "part").agg(F.round(F.sum("bits"), 3).alias("bits"))


@query("hamming_prune_moving", _KEPT.format(order="n DESC, id", cutoff="2 + o.k // 100", select="SELECT id, n FROM t WHERE k > 0 AND id = kept"))
def hamming_prune_moving(spark, sf_dir):
    """Masks that stay when each goes that differs from a kept one in fewer places than a cutoff that grows with its rank."""
    return V.greedy_pruned_moving(coarse(spark, sf_dir), 64, 2, 100)


@query("match_needs")
def match_needs(spark, sf_dir):
    """What a decoder of all conversations' matches must look back, in notes and in bits, and the chance of a literal."""
    from .codecs import lzss_roundtrip

    m = lzss_roundtrip(spark, sf_dir).agg(F.max("look_back").alias("look_back"), F.sum("matches").alias("matches"))
    return m.select("look_back", "matches", F.length(F.bin("look_back")).alias("bits"))


@query("escape_huffman_size", f"""WITH RECURSIVE {RUNS}, n AS (SELECT run_len AS v, count(*) AS n FROM runs GROUP BY run_len),
    b AS (SELECT CASE WHEN n >= 8 THEN v + 32 ELSE CAST(floor(log2(v)) AS BIGINT) END AS token, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN n >= 8 THEN 0 ELSE n * floor(log2(v)) END) AS BIGINT) AS raw FROM n GROUP BY 1), {huffman_bits("SELECT n FROM b", "h")}
    SELECT (SELECT bits FROM h) AS code_bits, CAST(sum(raw) AS BIGINT) AS raw_bits, count(*) AS n_tokens FROM b""")
def escape_huffman_size(spark, sf_dir):
    """Bits of all run lengths when frequent ones have a Huffman code each and rare ones that of their number of bits, with
    these behind it."""
    b = {r.token: r for r in escape_buckets(spark, sf_dir).collect()}  # 32 sizes and at most as many values as occur 8 times
    sizes = (H.total_bits({k: r.n for k, r in b.items()}), sum(r.raw_bits for r in b.values()), len(b))
    return spark.createDataFrame([sizes], "code_bits long, raw_bits long, n_tokens long")


@query("line_huffman_size", f"""WITH RECURSIVE c AS ({SQL["lag_line_codes"]}), f AS (SELECT code, count(*) AS n FROM c GROUP BY code), {huffman_bits("SELECT n FROM f", "h")}
    SELECT (SELECT bits FROM h) AS bits, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_codes FROM f""")
def line_huffman_size(spark, sf_dir):
    """Bits of all events under a Huffman code of line codes, which name a repeat of one of the two events before."""
    n = {r.code: r.n for r in lag_line_codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame([(H.total_bits(n), sum(n.values()), len(n))], "bits long, n long, n_codes long")


@query("two_tree_roundtrip")
def two_tree_roundtrip(spark, sf_dir):
    """Each user's runs as one stream of bits in which a symbol's code is followed by that of its length, from two tables;
    read back and compared."""
    r = written(runs(spark, sf_dir), "coded_runs")
    tables = [{row[0]: row[1] for row in r.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).limit(1 << 16).collect()} for c in ("symbol", "run_len")]
    trees = [H.tree(t) for t in tables]
    codes = [H.codes(t) for t in trees]

    def one(bits: str, at: int, nodes: list[tuple]) -> tuple:
        k = 0  # the root
        while nodes[k][1] is not None:
            k, at = nodes[k][2 if bits[at] == "1" else 1], at + 1
        return nodes[k][3], at

    def code(cell, symbols: list[str], lengths: list[int]) -> list[tuple]:
        bits = "".join(codes[0][s] + codes[1][n] for s, n in zip(symbols, lengths))
        packed, back, at = H.unpack_msb(H.pack_msb(bits)), [], 0
        for _ in symbols:
            s, at = one(packed, at, trees[0])
            n, at = one(packed, at, trees[1])
            back.append((s, n))
        return [(cell, len(symbols), len(bits), back == list(zip(symbols, lengths)))]

    return Q.each_stream(r, "cell", ["run"], ["symbol", "run_len"], code, "cell long, n_runs long, bits long, same boolean")


@query("skips_until_size")
def skips_until_size(spark, sf_dir):
    """Skips taken in order of cost, unless their span touches one that was taken, until the stream's estimated size is under
    nine tenths of what it was: (applied, bits) of the sizes that were measured, the last of which is where it stops.

    Which skips can be taken is decided cell by cell. Sizes are measured at multiples of ten, and as more skips make the
    stream shorter, the first that is small enough is found by halving: a dozen measurements instead of thousands.
    """
    r = written(runs(spark, sf_dir), "coded_runs")

    def free(cell, run: list[int], cost: list[float], early: list[bool], a: list[int], b: list[int]) -> list[tuple]:
        taken, out = [], []
        for c, k, e, x, y in sorted(zip(cost, run, early, a, b)):
            i = bisect_left(taken, (x, y))
            if (i == 0 or taken[i - 1][1] <= x) and (i == len(taken) or y <= taken[i][0]):
                taken.insert(i, (x, y))
                out.append((cell, k, c, e))
        return out

    k = skips(spark, sf_dir).withColumn("cost", F.least("late_impact", "early_impact")).withColumn("early", F.col("early_impact") < F.col("late_impact"))
    k = Q.each_stream(k, "cell", ["run"], ["run", "cost", "early", "prev_change", "next_change"], free, "cell long, run long, cost double, early boolean")
    k = written(Q.placed(k.withColumn("_all", F.lit(0)), ["_all"], ["cost", "cell", "run"]).drop("_all"), "free_skips")
    w = Window.partitionBy("cell").orderBy("run")
    known = written(r.withColumns({"was": F.lag("symbol").over(w), "next": F.lead("symbol").over(w)}), "skip_runs")
    seen: dict[int, float] = {}

    def bits(n: int) -> float:
        if n not in seen:
            some = k.where(F.col("place") < n)
            late = some.where("not early").select("cell", "run", F.lit(True).alias("late"))
            early = some.where("early").select("cell", (F.col("run") - 1).alias("run"), F.lit(True).alias("early"))
            now = known.join(late, ["cell", "run"], "left").join(early, ["cell", "run"], "left")
            symbol = F.when(F.col("late"), F.col("was")).when(F.col("early"), F.col("next")).otherwise(F.col("symbol"))
            seen[n] = A.change_bits(Q.merged(now.withColumn("symbol", symbol))).agg(F.sum(F.col("stay_bits") + F.col("change_bits"))).first()[0] or 0.0
        return seen[n]

    target = 0.9 * bits(0)
    low, high = 0, k.count() // 10
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if bits(10 * middle) < target else (middle + 1, high)
    bits(10 * low)
    return spark.createDataFrame([(n, round(b, 3), n == 10 * low) for n, b in sorted(seen.items())], "applied long, bits double, stop boolean")


@query("transition_skip", f"""WITH RECURSIVE {RUNS}, m AS (SELECT cell, max(run) AS last FROM runs GROUP BY cell),
    e AS (SELECT r.cell, r.run, r.symbol, r.run_len, n.run_len = 1 AND r.run + 1 < m.last AS more FROM runs r JOIN m USING (cell) LEFT JOIN runs n ON n.cell = r.cell AND n.run = r.run + 1),
    w AS (SELECT * FROM e WHERE run = 1 UNION ALL SELECT e.* FROM w JOIN e ON e.cell = w.cell AND e.run = w.run + CASE WHEN w.more THEN 2 ELSE 1 END)
    SELECT cell, run, symbol, run_len + CASE WHEN more THEN 1 ELSE 0 END AS length FROM w""")
def transition_skip(spark, sf_dir):
    """Runs of which each takes in the one after it if that has a single step and isn't the last; what is taken in takes in
    nothing."""
    return Q.single_steps_skipped(runs(spark, sf_dir))


@query("gif_files", f"""WITH s AS (SELECT vec_id // {GIF_FRAMES} AS file, vec_id % {GIF_FRAMES} AS frame, vec_id, x, y, level FROM {LEVELS}),
    c AS (SELECT a.file, a.frame, a.x, a.y, a.level IS DISTINCT FROM b.level AS new FROM s a LEFT JOIN s b ON b.file = a.file AND b.frame = a.frame - 1 AND b.x = a.x AND b.y = a.y)
    SELECT CAST(file AS BIGINT) AS file, CAST(frame AS BIGINT) AS frame, CAST(coalesce(min(x) FILTER (new), 0) AS BIGINT) AS x, CAST(coalesce(min(y) FILTER (new), 0) AS BIGINT) AS y,
    CAST(coalesce(max(x) FILTER (new) - min(x) FILTER (new), 0) + 1 AS BIGINT) AS width, CAST(coalesce(max(y) FILTER (new) - min(y) FILTER (new), 0) + 1 AS BIGINT) AS height FROM c GROUP BY file, frame""")
def gif_files(spark, sf_dir):
    """Tiles in three levels as animations of fifty frames at most, written to files, and the boxes that the files say have changed."""
    t = levels(spark, sf_dir).withColumn("file", F.floor(F.col("vec_id") / GIF_FRAMES))

    def draw(file, vec_id: list[int], level: list[int]) -> list[tuple]:
        frames = np.array(level, np.uint8).reshape(-1, 8, 8)
        return [(f"tiles-{file}.gif", gif.animation(list(frames), [(0, 0, 0), (128, 128, 128), (255, 255, 255)]))]

    files = Q.each_stream(t, "file", ["vec_id", "y", "x"], ["vec_id", "level"], draw, "name string, data binary")
    write_files(files, folder := new_path(spark, "gifs"))

    def boxes(batches):
        for b in batches:
            rows = [(p, k, *box) for p, data in zip(b["path"].to_pylist(), b["content"]) for k, box in enumerate(gif.boxes(data.as_py()))]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "frame", "x", "y", "width", "height"), r)) for r in rows], schema=BOX)

    got = spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(boxes, "path string, frame long, x long, y long, width long, height long")
    return got.select(F.regexp_extract("path", r"([0-9]+)\.gif$", 1).cast("long").alias("file"), "frame", "x", "y", "width", "height")
