"""Queries that code streams and read them back, and the statistics that the codes need.

Tables of frequencies are small and come from one aggregation; coding is sequential inside a stream and runs on all
streams at once, as grouped maps.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import huffman as H
from ..functions import lz
from ..functions import rangecoder as R
from ..operators import sequence as Q
from ..operators import stats as A
from ..sources.shared import written
from ..sources.tables import EVENTS, table
from .registry import SQL, query
from .streams import RUNS, changes, events, runs, transitions

#: Most symbols of a code; its table is made on the driver and sent to every task.
MOST_SYMBOLS = 1 << 16
NOTES = """(SELECT conv_id, turn, CASE role WHEN 'user' THEN 60 WHEN 'assistant' THEN 64 ELSE 67 END AS note,
    CAST(least(31, length(text) // 64) AS INTEGER) AS len,
    CAST(least(7, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - turn, 0)) AS INTEGER) AS run FROM conversations)"""


def notes(spark, sf_dir) -> DataFrame:
    """Conversations as note sequences: the role is the note, the text's size its length, the step to the next turn its run."""
    c, w = table(spark, sf_dir, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    note = F.when(F.col("role") == "user", 60).when(F.col("role") == "assistant", 64).otherwise(67)
    run = F.least(F.lit(7), F.coalesce(F.lead("turn").over(w) - F.col("turn"), F.lit(0)))
    return c.select("conv_id", "turn", note.alias("note"), F.least(F.lit(31), F.floor(F.length("text") / 64)).cast("int").alias("len"), run.cast("int").alias("run"))


def frequencies(df: DataFrame, *by: str) -> dict:
    """A frequency table on the driver: one entry per distinct symbol. More than MOST_SYMBOLS are an error."""
    rows = df.groupBy(*by).agg(F.count("*").alias("n")).limit(MOST_SYMBOLS + 1).collect()
    if len(rows) > MOST_SYMBOLS:
        raise ValueError(f"a code has at most {MOST_SYMBOLS} symbols")
    return {(r[0] if len(by) == 1 else tuple(r[:-1])): r["n"] for r in sorted(rows, key=lambda r: tuple(map(str, r)))}


def symbols(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The events' stream with numbers for symbols, and the names of the numbers, most frequent first."""
    s = Q.numbered_runs(events(spark, sf_dir), EVENTS)
    freq = frequencies(s, "symbol")
    names = sorted(freq, key=lambda k: (-freq[k], k))
    number = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]) if names else F.create_map(F.lit(""), F.lit(0))
    return s.select("cell", "pos", F.element_at(number, F.col("symbol")).alias("code")), names


# ---- Huffman ----


def characters(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """(symbol), the characters of a table's texts."""
    return table(spark, sf_dir, source).select(F.explode(F.split("text", "")).alias("symbol")).where("symbol <> ''")


@query("char_counts", "SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY c")
def char_counts(spark, sf_dir):
    """How often each character occurs in the benchmark's texts."""
    return characters(spark, sf_dir, "benchmark").groupBy("symbol").agg(F.count("*").alias("n"))


@query("char_counts_documents", SQL["char_counts"].replace("benchmark", "documents"))
def char_counts_documents(spark, sf_dir):
    """How often each character occurs in the documents."""
    return characters(spark, sf_dir, "documents").groupBy("symbol").agg(F.count("*").alias("n"))


@query("topn_dictionary", "SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY c ORDER BY n DESC, symbol LIMIT 16")
def topn_dictionary(spark, sf_dir):
    """The sixteen most frequent characters of the benchmark's texts."""
    return char_counts(spark, sf_dir).orderBy(F.desc("n"), "symbol").limit(16)


@query("topn_dictionary_documents", SQL["topn_dictionary"].replace("benchmark", "documents"))
def topn_dictionary_documents(spark, sf_dir):
    """The sixteen most frequent characters of the documents."""
    return char_counts_documents(spark, sf_dir).orderBy(F.desc("n"), "symbol").limit(16)


def low_bits(chars: DataFrame) -> DataFrame:
    return chars.groupBy(F.ascii("symbol").bitwiseAND(127).alias("symbol")).agg(F.count("*").alias("n"))


@query("bit_tree_probs", """WITH n AS (SELECT ord(c) & 127 AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY 1),
    l AS (SELECT symbol, n, CAST(unnest(range(0, 7)) AS INTEGER) AS level FROM n),
    t AS (SELECT level, CAST(symbol >> (7 - level) AS INTEGER) AS prefix, sum(CASE WHEN (symbol >> (6 - level)) & 1 = 0 THEN n ELSE 0 END) AS zero, sum(n) AS total FROM l GROUP BY 1, 2)
    SELECT level, prefix, CAST(zero AS BIGINT) AS zero, CAST(total AS BIGINT) AS total, CAST(greatest(0, least(255, floor(zero / total * 257))) AS BIGINT) AS prob FROM t""")
def bit_tree_probs(spark, sf_dir):
    """Chances of a 0 bit after each prefix, for the low seven bits of the benchmark's characters."""
    return A.bit_tree(low_bits(characters(spark, sf_dir, "benchmark")), 7)


@query("bit_tree_probs_documents", SQL["bit_tree_probs"].replace("benchmark", "documents"))
def bit_tree_probs_documents(spark, sf_dir):
    """The same for the documents' characters."""
    return A.bit_tree(low_bits(characters(spark, sf_dir, "documents")), 7)


@query("huffman_size")
def huffman_size(spark, sf_dir):
    """Bits of all documents' characters under one Huffman code, and the entropy that bounds it."""
    c = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    freq = frequencies(c, "c")
    total = sum(freq.values())
    entropy = sum(-math.log2(n / total) * n for n in freq.values())
    return spark.createDataFrame([(len(freq), total, H.total_bits(freq), round(entropy, 3))], "n_symbols long, n long, bits long, entropy double")


@query("huffman_codes")
def huffman_codes(spark, sf_dir):
    """Codes of the documents' characters."""
    rows = {r.symbol: r.n for r in char_counts_documents(spark, sf_dir).orderBy("symbol").collect()}
    return spark.createDataFrame([(s, rows[s], len(c), c) for s, c in H.codes(H.tree(rows)).items()], "value string, freq long, bitlen int, code string")


@query("huffman_tree")
def huffman_tree(spark, sf_dir):
    """The tree of the run lengths as 24-bit numbers with distances to children."""
    freq = frequencies(runs(spark, sf_dir), "run_len")
    words = H.serialized(H.tree(freq), sorted(freq))
    return spark.createDataFrame(list(enumerate(words)), "place int, word int")


@query("huffman_tree_bytes")
def huffman_tree_bytes(spark, sf_dir):
    """The tree of the note fields as 16-bit numbers with distances to children."""
    freq = frequencies(notes(spark, sf_dir), "len")
    words = H.serialized_bytes(H.tree(freq), sorted(freq))
    return spark.createDataFrame(list(enumerate(words)), "place int, word int")


@query("huffman_roundtrip")
def huffman_roundtrip(spark, sf_dir):
    """Each user's events coded with one table, packed, read back and compared."""
    s, _ = symbols(spark, sf_dir)
    nodes = H.tree(frequencies(s, "code"))
    codes = H.codes(nodes)

    def code(cell, seq: list[int]) -> list[tuple]:
        bits = H.encode(seq, codes)
        back = H.decode(H.unpack_lsb(H.pack_lsb(bits, 32)), nodes, len(seq))
        return [(cell, len(seq), len(bits), back == seq)]

    return Q.each_stream(s, "cell", ["pos"], ["code"], code, "cell long, n long, bits long, same boolean")


@query("note_huffman")
def note_huffman(spark, sf_dir):
    """Bits of all notes with one table for whole notes, two (note; length and run) and three."""
    n = notes(spark, sf_dir)
    one = [frequencies(n, "note", "len", "run")]
    two = [frequencies(n, "note"), frequencies(n, "len", "run")]
    three = [frequencies(n, c) for c in ("note", "len", "run")]
    return spark.createDataFrame([(k, sum(map(H.total_bits, t))) for k, t in ((1, one), (2, two), (3, three))], "tables int, bits long")


@query("two_tree_size")
def two_tree_size(spark, sf_dir):
    """Bits of the runs with separate tables for symbols and lengths, and with one for both kinds of token."""
    r = runs(spark, sf_dir)
    a, b = frequencies(r, "symbol"), frequencies(r, "run_len")
    both = {("s", k): v for k, v in a.items()} | {("r", k): v for k, v in b.items()}
    return spark.createDataFrame([("separate", H.total_bits(a) + H.total_bits(b)), ("unified", H.total_bits(both))], "layout string, bits long")


# ---- range coder ----


@query("range_coder_roundtrip")
def range_coder_roundtrip(spark, sf_dir):
    """Each user's events by a tree of bits and the range coder, read back and compared."""
    s, names = symbols(spark, sf_dir)
    bits = max(1, (len(names) - 1).bit_length())
    tree = R.tree_of(frequencies(s, "code"), bits)

    def code(cell, seq: list[int]) -> list[tuple]:
        coder = R.Encoder()
        for x in seq:
            R.encode_tree(coder, x, bits, tree)
        data = coder.finish()
        back = R.Decoder(data)
        return [(cell, len(seq), data, [R.decode_tree(back, bits, tree) for _ in seq] == seq)]

    return Q.each_stream(s, "cell", ["pos"], ["code"], code, "cell long, n long, payload binary, same boolean")


def _stay_chances(runs_: DataFrame, names: list[str]) -> dict[int, list[int]]:
    """Chance in 256ths that a run goes on, by symbol and how long it has lasted; the last entry holds from there on."""
    out: dict[int, dict[int, int]] = {}
    for r in A.hazard(runs_).collect():  # at most 128 rows per symbol
        out.setdefault(names.index(r.symbol), {})[r.k] = max(0, min(255, 256 - r.prob))
    return {s: [h.get(k, h[max(h)]) for k in range(128)] for s, h in out.items()}


@query("change_coder_roundtrip")
def change_coder_roundtrip(spark, sf_dir):
    """The current format: for each step one bit, whether the symbol stays, by the hazard of its run; where it does not,
    the new symbol by the tree of the old symbol's class. Each user's stream is read back and compared."""
    r = written(runs(spark, sf_dir), "coded_runs")  # the events are put in order once; all tables come from their runs
    freq = {row.symbol: row.n for row in r.groupBy("symbol").agg(F.sum("run_len").alias("n")).collect()}
    names = sorted(freq, key=lambda k: (-freq[k], k))
    bits = max(1, len(names).bit_length())
    stay = _stay_chances(r, names)
    trees: dict[int, dict[int, int]] = {}
    rows = A.transitions(Q.changes(r)).collect()
    for k, name in enumerate(names):
        trees[k] = R.tree_of({names.index(r.to_sym): r.n for r in rows if r.from_sym == name}, bits)
    first = R.tree_of({names.index(k): n for k, n in frequencies(r.where("run = 1"), "symbol").items()}, bits)
    number = {name: k for k, name in enumerate(names)}

    def walk(n: int, same, new) -> list[int]:
        out, last, run = [], -1, 0
        for _ in range(n):
            if last >= 0 and same(stay[last][min(127, run)]):
                run += 1
            else:
                last, run = new(trees.get(last, first)), 0
            out.append(last)
        return out

    def code(cell, symbols_: list[str], lengths: list[int]) -> list[tuple]:
        seq = [number[s] for s, n in zip(symbols_, lengths) for _ in range(n)]
        coder = R.Encoder()
        cost = [0.0]
        place = [-1]

        def same(p: int) -> bool:
            place[0] += 1
            k = place[0]
            stays = seq[k] == seq[k - 1]
            coder.bit(0 if stays else 1, p)
            chance = max(1, p) / 256 if stays else max(1, 256 - p) / 256
            cost[0] -= math.log2(chance)
            if not stays:
                place[0] -= 1
            return stays

        def new(tree: dict[int, int]) -> int:
            place[0] += 1
            R.encode_tree(coder, seq[place[0]], bits, tree)
            return seq[place[0]]

        walk(len(seq), same, new)
        data = coder.finish()
        reader = R.Decoder(data)
        back = walk(len(seq), lambda p: reader.bit(p) == 0, lambda tree: R.decode_tree(reader, bits, tree))
        return [(cell, len(seq), data, round(cost[0], 6), back == seq)]

    return Q.each_stream(r, "cell", ["run"], ["symbol", "run_len"], code, "cell long, n long, payload binary, run_bits double, same boolean")


@query("unary_run_roundtrip")
def unary_run_roundtrip(spark, sf_dir):
    """Run lengths as unary codes with one chance per symbol, read back and compared."""
    r = written(runs(spark, sf_dir), "coded_runs")
    stop = {row.symbol: max(0, min(255, int((1 - row.stop_ratio) * 257 - 1.5))) for row in _stop_ratios(r).collect()}

    def code(cell, symbols_: list[str], lengths: list[int]) -> list[tuple]:
        coder = R.Encoder()
        for symbol, n in zip(symbols_, lengths):
            for _ in range(n - 1):
                coder.bit(0, stop[symbol])
            coder.bit(1, stop[symbol])
        data, back = coder.finish(), []
        reader = R.Decoder(data)
        for symbol in symbols_:
            n = 1
            while not reader.bit(stop[symbol]):
                n += 1
            back.append(n)
        return [(cell, len(lengths), len(data), back == lengths)]

    return Q.each_stream(r, "cell", ["run"], ["symbol", "run_len"], code, "cell long, n_runs long, size long, same boolean")


def _stop_ratios(runs_: DataFrame) -> DataFrame:
    return runs_.groupBy("symbol").agg((F.count("*") / F.sum("run_len")).alias("stop_ratio"))


@query("tile_pixel_roundtrip")
def tile_pixel_roundtrip(spark, sf_dir):
    """Three-level tiles pixel by pixel, high bit by chances of the last high bit and the place in its run, counted over all
    tiles, low bit by a fixed chance."""
    from .tiles import levels

    pixels_ = written(levels(spark, sf_dir), "levels")
    w = Window.partitionBy("vec_id").orderBy("y", "x")
    bit = pixels_.withColumn("bit", (F.col("level") > 0).cast("int")).withColumn("last", F.coalesce(F.lag("bit").over(w), F.lit(0)))
    turn = bit.withColumn("turn", F.sum((F.col("bit") != F.col("last")).cast("int")).over(w)).withColumn("before", F.coalesce(F.lag("turn").over(w), F.lit(0)))
    place = F.count("*").over(Window.partitionBy("vec_id", "before").orderBy("y", "x")) - 1
    seen = turn.withColumn("k", F.least(F.lit(8), place)).groupBy("last", "k").agg(F.count_if(F.col("bit") == 0).alias("zero"), F.count("*").alias("n"))
    counted = {(r.last, r.k): max(1, min(255, 257 * r.zero // r.n)) for r in seen.collect()}  # 18 rows at most
    high = {(c, k): counted.get((c, k), 128) for c in (0, 1) for k in range(9)}
    low = (210, 1)  # fixed values: chance of a 0 low bit after a high bit 0 and 1

    def coded(pixels: list[int], put) -> list[int]:
        out, last, run = [], 0, 0
        for k in range(len(pixels)):
            h = put(k, 1, high[last, min(8, run)])
            out.append(h << 1 | put(k, 0, low[h]))
            last, run = h, run + 1 if h == last else 0
        return out

    def code(vec_id, levels_: list[int]) -> list[tuple]:
        pixels = [3 if v == 2 else v for v in levels_]
        coder = R.Encoder()

        def put(k: int, shift: int, p: int) -> int:
            coder.bit(pixels[k] >> shift & 1, p)
            return pixels[k] >> shift & 1

        coded(pixels, put)
        data = coder.finish()
        reader = R.Decoder(data)
        back = coded(pixels, lambda k, shift, p: reader.bit(p))
        return [(vec_id, len(data), back == pixels)]

    return Q.each_stream(pixels_, "vec_id", ["y", "x"], ["level"], code, "vec_id long, size long, same boolean")


# ---- LZ ----


@query("lz_match_candidates", """WITH s AS (SELECT conv_id, turn, row_number() OVER w - 1 AS pos, role || '|' || lead(role, 1) OVER w || '|' || lead(role, 2) OVER w AS gram
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT b.conv_id, b.pos, min(a.pos) AS earliest, count(*) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.gram = b.gram AND a.pos <= b.pos - 3 AND a.pos >= b.pos - 1024 GROUP BY b.conv_id, b.pos""")
def lz_match_candidates(spark, sf_dir):
    """Where each place's three roles occurred before, inside the window and without overlap: the earliest place, and how
    often. By a range of positions over each gram's own sequence, so no pair is written down."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    gram = F.concat_ws("|", "role", F.lead("role", 1).over(w), F.lead("role", 2).over(w))
    s = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.when(F.lead("role", 2).over(w).isNotNull(), gram).alias("gram"))
    before = Window.partitionBy("conv_id", "gram").orderBy("pos").rangeBetween(-1024, -3)
    s = s.where("gram is not null").select("conv_id", "pos", F.min("pos").over(before).alias("earliest"), F.count("*").over(before).alias("n"))
    return s.where("n > 0")


@query("lzss_roundtrip")
def lzss_roundtrip(spark, sf_dir):
    """Each conversation's packed notes by back-references and the range coder, read back and compared."""

    def code(conv_id, note: list[int], length: list[int], step: list[int]) -> list[tuple]:
        seq = [n << 8 | a << 3 | b for n, a, b in zip(note, length, step)]
        tokens = lz.parse(seq)
        data, p = lz.encode_tokens(tokens, 16)
        deepest = max([max(t[0] - 1, t[1] - 1) for t in tokens if len(t) == 2], default=0)
        return [(conv_id, len(seq), len(data), sum(len(t) == 2 for t in tokens), p, deepest, lz.decode(data, p, len(seq), 16) == seq)]

    schema = "conv_id long, n long, size long, matches long, literal_chance long, look_back long, same boolean"
    return Q.each_stream(notes(spark, sf_dir), "conv_id", ["turn"], ["note", "len", "run"], code, schema)


def note_tables(n: DataFrame) -> tuple[list[list[tuple]], list[dict]]:
    """(trees, codes) of the two tables of notes: notes, and lengths with steps."""
    trees = [H.tree(frequencies(n, "note")), H.tree(frequencies(n.withColumn("v", F.col("len") * 8 + F.col("run")), "v"))]
    return trees, [H.codes(t) for t in trees]


def coded_notes(n: DataFrame, codes: list[dict], check=None) -> DataFrame:
    """(conv_id, n, bits, same): notes by two tables with back-references over the coded bits; check(bits, notes) says whether
    they can be read back."""

    def code(conv_id, note: list[int], length: list[int], step: list[int]) -> list[tuple]:
        seq = [(a, b * 8 + c) for a, b, c in zip(note, length, step)]
        bits = lz.reverse_encode([codes[0][a] + codes[1][b] for a, b in seq])
        return [(conv_id, len(seq), bits, check is None or check(bits, seq))]

    return Q.each_stream(n, "conv_id", ["turn"], ["note", "len", "run"], code, "conv_id long, n long, bits string, same boolean")


@query("reverse_lzss_roundtrip")
def reverse_lzss_roundtrip(spark, sf_dir):
    """Each conversation's notes by two Huffman tables, with back-references over the coded bits, read back and compared."""
    n = notes(spark, sf_dir)
    trees, codes = note_tables(n)
    group = H.group_reader(trees)
    done = coded_notes(n, codes, lambda bits, seq: lz.reverse_decode(bits, len(seq), group) == seq)
    return done.select("conv_id", "n", F.length("bits").cast("long").alias("bits"), "same")


@query("lz_bit_stats")
def lz_bit_stats(spark, sf_dir):
    """How often each bit of lengths and distances is set, over the matches of all conversations."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        tokens = [t for t in lz.parse(rows["note"].tolist()) if len(t) == 2]
        return pd.DataFrame({"distance": [t[0] for t in tokens], "length": [t[1] for t in tokens]}, dtype="int64")

    m = notes(spark, sf_dir).groupBy("conv_id").applyInPandas(run, "distance long, length long")
    f = m.select(F.explode(F.array(F.struct(F.lit("distance").alias("field"), F.col("distance").alias("v")), F.struct(F.lit("length").alias("field"), F.col("length").alias("v")))).alias("p"))
    b = f.select("p.field", "p.v", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("bit"))
    return b.groupBy("field", "bit").agg(F.sum(F.getbit("v", "bit").cast("long")).alias("ones"), F.count("*").alias("n"))


# ---- classes, simplification ----


@query("class_greedy")
def class_greedy(spark, sf_dir):
    """Source symbols put into three classes one after the other, each into the class whose cost grows least.

    Works on the transition table, which is as large as the alphabet's square, in order of symbol.
    """
    rows = transitions(spark, sf_dir).collect()
    names = sorted({r.from_sym for r in rows} | {r.to_sym for r in rows})
    freq = {s: {r.to_sym: r.n for r in rows if r.from_sym == s} for s in names}

    def bits(f: dict[str, int]) -> float:
        total = sum(f.values())
        return sum(-math.log2(n / total) * n for n in f.values() if n)

    classes: list[dict[str, int]] = [{}, {}, {}]
    put = []
    for s in names:
        grown = [{k: c.get(k, 0) + freq[s].get(k, 0) for k in c | freq[s]} for c in classes]
        best = min(range(3), key=lambda k: (bits(grown[k]) - bits(classes[k]), k))
        classes[best] = grown[best]
        put.append((s, best, round(bits(grown[best]), 6)))
    return spark.createDataFrame(put, "symbol string, class int, class_bits double")


@query("simplify_runs")
def simplify_runs(spark, sf_dir):
    """Runs given up for the symbol before them while the loss, the sum of their values, is under a budget; one pass, in
    order, so that a run that was given up lengthens the one before it, and then the cheapest run that is left."""
    budget = 30.0

    def decide(cell, run: list[int], symbol: list[str], loss: list[float], start: list[int], n: list[int]) -> list[tuple]:
        """(cell, start, n, symbol, was) of each run, in order. A run that is given up lengthens the one before it, and what
        comes after it with the same symbol as that is still a run of its own."""
        now, kept = list(symbol), []
        for k in range(1, len(now)):
            if loss[k] < budget:
                now[k] = now[k - 1]
            else:
                kept.append((loss[k], k))
        if kept:
            k = min(kept)[1]
            now[k] = now[k - 1]
        return list(zip([cell] * len(now), start, n, now, symbol))

    e = events(spark, sf_dir).where("user_id is not null and event_type is not null").select("user_id", "ts", "event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    v = Q.numbered_runs(e, EVENTS).select("cell", "run", "pos", "symbol", "o2").join(e.select(F.col("user_id").alias("cell"), F.col("event_id").alias("o2"), "value"), ["cell", "o2"])
    r = v.groupBy("cell", "run").agg(F.min("symbol").alias("symbol"), F.sum("value").alias("loss"), F.min("pos").alias("start"), F.count("*").alias("n"))
    new = Q.each_stream(r, "cell", ["run"], ["run", "symbol", "loss", "start", "n"], decide, "cell long, start long, n long, symbol string, was string")
    steps = new.select("cell", "symbol", (F.col("symbol") != F.col("was")).alias("changed"), F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
    return steps.select("cell", "pos", "symbol", "changed")


SKIPS = f"""WITH {RUNS}, v AS (SELECT user_id AS cell, row_number() OVER w - 1 AS pos, sum(value) OVER w AS total FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT c.cell, c.run, c.start_pos AS on_pos, c.from_sym AS changed_from, c.to_sym AS changed_to,
        c.start_pos - lag(c.run_len) OVER (PARTITION BY c.cell ORDER BY c.run) AS prev_change, c.start_pos + c.run_len AS next_change FROM chg c),
    k AS (SELECT s.*, round(b.total - a.total, 4) AS late_impact, round(a.total - coalesce(p.total, 0), 4) AS early_impact FROM s
        JOIN v a ON a.cell = s.cell AND a.pos = s.on_pos - 1 JOIN v b ON b.cell = s.cell AND b.pos = s.next_change - 1 LEFT JOIN v p ON p.cell = s.cell AND p.pos = s.prev_change - 1
        WHERE s.changed_from IS NOT NULL)"""


def skips(spark, sf_dir) -> DataFrame:
    """Changes that could come later or earlier, with what either would cost: sums over the runs beside them."""
    e = events(spark, sf_dir).where("event_type is not null and user_id is not null")
    v = Q.numbered_runs(events(spark, sf_dir), EVENTS).select("cell", "run", "pos", "symbol", "o2")
    v = v.join(e.select(F.col("user_id").alias("cell"), F.col("event_id").alias("o2"), "value"), ["cell", "o2"])
    r = v.groupBy("cell", "run").agg(F.min("symbol").alias("to"), F.min("pos").alias("on_pos"), F.count("*").alias("n"), F.sum("value").alias("loss"))
    w = Window.partitionBy("cell").orderBy("run")
    k = r.select(
        "cell", "run", "on_pos", F.lag("to").over(w).alias("changed_from"), F.col("to").alias("changed_to"), (F.col("on_pos") - F.lag("n").over(w)).alias("prev_change"),
        (F.col("on_pos") + F.col("n")).alias("next_change"), F.round("loss", 4).alias("late_impact"), F.round(F.lag("loss").over(w), 4).alias("early_impact"),
    )
    return k.where("changed_from is not null")


@query("skip_candidates", f"{SKIPS} SELECT cell, run, on_pos, changed_from, changed_to, prev_change, next_change, round(late_impact, 2) AS late_impact, round(early_impact, 2) AS early_impact FROM k")
def skip_candidates(spark, sf_dir):
    """All changes that could be skipped, with their impacts."""
    return skips(spark, sf_dir).withColumns({c: F.round(c, 2) for c in ("late_impact", "early_impact")})


@query("skips_applied")
def skips_applied(spark, sf_dir):
    """Skips taken from the cheapest on, unless they overlap one that was taken in the same cell, up to a total loss.

    Overlaps are inside a cell, so cells decide in parallel; the budget is each cell's own.
    """
    budget = 500.0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["cost"] = rows[["late_impact", "early_impact"]].min(axis=1)
        rows = rows.sort_values(["cost", "run"])
        taken, spent, out = [], 0.0, []  # taken spans don't overlap, so a new one is compared with its neighbours only
        for r in rows.itertuples():
            k = bisect_left(taken, (r.prev_change, r.next_change))
            free = (k == 0 or taken[k - 1][1] <= r.prev_change) and (k == len(taken) or r.next_change <= taken[k][0])
            if free and spent + r.cost <= budget:
                taken.insert(k, (r.prev_change, r.next_change))
                spent += r.cost
                out.append(r.Index)
        return rows.loc[out, ["cell", "run", "on_pos", "cost"]]

    return skips(spark, sf_dir).groupBy("cell").applyInPandas(run, "cell long, run long, on_pos long, cost double")


@query("history_references")
def history_references(spark, sf_dir):
    """Changes to symbols that are among the last fourteen written, as the place in that list."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        recent, out = [], []
        for s in rows.sort_values("run")["to_sym"]:
            out.append(recent.index(s) if s in recent else -1)
            recent = ([s] + [x for x in recent if x != s])[:14]
        return pd.DataFrame({"cell": rows.sort_values("run")["cell"], "run": rows.sort_values("run")["run"], "back": out})

    return changes(spark, sf_dir).groupBy("cell").applyInPandas(run, "cell long, run long, back int")


@query("motion_suppressed")
def motion_suppressed(spark, sf_dir):
    """Each user's values, where the last one shown is kept while the distance and what has built up stay small."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        shown, built, out = None, 0.0, []
        for v in rows["value"].fillna(0.0):
            d = 0.0 if shown is None else abs(v - shown)
            built += math.sqrt(d)
            if shown is None or d + built >= 20.0:
                shown, built = v, 0.0
            out.append(shown)
        return pd.DataFrame({"event_id": rows["event_id"], "shown": out})

    return events(spark, sf_dir).select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(run, "event_id long, shown double")


# ---- notes ----


@query("note_packed", f"SELECT conv_id, turn, CAST((note << 8) | (len << 3) | run AS INTEGER) AS packed FROM {NOTES}")
def note_packed(spark, sf_dir):
    """Notes in 16 bits: 8 for the note, 5 for its length, 3 for the step to the next."""
    from ..functions.scalars import packed_note

    return notes(spark, sf_dir).select("conv_id", "turn", packed_note(F.col("note"), F.col("len"), F.col("run")).cast("int").alias("packed"))


@query("note_pitch", f"SELECT DISTINCT note, round(pow(2.0, (note - 69) / 12.0) * 440.0, 6) AS hz FROM {NOTES}")
def note_pitch(spark, sf_dir):
    """Frequencies of the notes that occur."""
    from ..functions.scalars import pitch_hz

    return notes(spark, sf_dir).select("note").distinct().select("note", F.round(pitch_hz(F.col("note")), 6).alias("hz"))


@query("note_extent", f"SELECT conv_id, min(note) AS lo, max(note) AS hi, max(len) AS longest FROM {NOTES} GROUP BY conv_id")
def note_extent(spark, sf_dir):
    """Lowest and highest note and longest length of each conversation."""
    return notes(spark, sf_dir).groupBy("conv_id").agg(F.min("note").alias("lo"), F.max("note").alias("hi"), F.max("len").alias("longest"))


@query("note_json", f"""SELECT conv_id, turn, '{{"note":' || note || ',"len":' || len || ',"run":' || run || '}}' AS json FROM {NOTES} WHERE len >= 1""")
def note_json(spark, sf_dir):
    """Notes with a length, as JSON."""
    return notes(spark, sf_dir).where("len >= 1").select("conv_id", "turn", F.to_json(F.struct("note", "len", "run")).alias("json"))


@query("note_xml")
def note_xml(spark, sf_dir):
    """Notes as XML."""
    return notes(spark, sf_dir).select("conv_id", "turn", F.to_xml(F.struct("note", "len", "run"), {"rowTag": "note", "indent": "", "ignoreSurroundingSpaces": "true"}).alias("xml"))


@query("voice_load", f"""WITH n AS (SELECT conv_id, turn * 4 AS on_at, turn * 4 + greatest(1, len) AS off_at FROM {NOTES}), e AS (SELECT conv_id, unnest(range(on_at, off_at)) AS t FROM n)
    SELECT conv_id, t, count(*) AS sounding, count(*) > 4 AS over FROM e GROUP BY conv_id, t""")
def voice_load(spark, sf_dir):
    """How many notes sound at each tick, and whether four voices are enough."""
    n = notes(spark, sf_dir).select("conv_id", (F.col("turn") * 4).alias("a"), (F.col("turn") * 4 + F.greatest(F.lit(1), F.col("len")) - 1).alias("b"))
    e = n.select("conv_id", F.explode(F.sequence("a", "b")).alias("t")).groupBy("conv_id", "t").agg(F.count("*").alias("sounding"))
    return e.withColumn("over", F.col("sounding") > 4)


@query("voice_schedule")
def voice_schedule(spark, sf_dir):
    """The voice of each note: expired voices are freed, the first free one is taken, and without one the note is dropped."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        until, out = [0] * 4, []
        for turn, n in zip(rows["turn"], rows["len"]):
            free = [k for k in range(4) if until[k] <= turn * 4]
            if free:
                until[free[0]] = turn * 4 + max(1, n)
            out.append(free[0] if free else -1)
        return pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "voice": out})

    return notes(spark, sf_dir).groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, voice int")


@query("triangle_samples", f"""WITH n AS (SELECT DISTINCT note FROM {NOTES}), s AS (SELECT note, CAST(unnest(range(0, 64)) AS BIGINT) AS i FROM n),
    p AS (SELECT note, i, i * (pow(2.0, (note - 69) / 12.0) * 440.0) / 16000.0 AS ph FROM s)
    SELECT note, i, round(1 - 4 * abs(ph - floor(ph) - 0.5), 6) AS v FROM p""")
def triangle_samples(spark, sf_dir):
    """Triangle waves of the notes, 64 samples at 16 kHz."""
    from ..functions.scalars import pitch_hz

    s = notes(spark, sf_dir).select("note").distinct().select("note", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i"))
    ph = F.col("i") * pitch_hz(F.col("note")) / 16000.0
    return s.select("note", "i", F.round(1 - 4 * F.abs(ph - F.floor(ph) - 0.5), 6).alias("v"))


# ---- reports and sinks ----


@query("size_rollup", """SELECT l_returnflag AS component, l_linestatus AS part, count(*) AS n, round(sum(l_quantity), 2) AS size FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def size_rollup(spark, sf_dir):
    """Sizes by component and part, with subtotals and the total."""
    r = table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("part"))
    return r.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("size"))


@query("bit_pack", f"WITH {RUNS}, packed AS (SELECT cell, string_agg(CASE WHEN symbol = 'view' THEN '1' ELSE '0' END, '' ORDER BY run) AS bits FROM runs GROUP BY cell) SELECT cell, length(bits) AS n, bits FROM packed")
def bit_pack(spark, sf_dir):
    """One bit per run of each user, in order."""
    bit = F.when(F.col("symbol") == "view", "1").otherwise("0").alias("b")
    c = runs(spark, sf_dir).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("run", bit))).alias("s"))
    return c.select("cell", F.size("s").cast("long").alias("n"), F.array_join(F.col("s.b"), "").alias("bits"))


@query("c_header", "SELECT event_type AS symbol, 'static const int count_' || event_type || ' = ' || count(*) || ';' AS line FROM events GROUP BY event_type")
def c_header(spark, sf_dir):
    """Counts as lines of a C header."""
    n = events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    return n.select("symbol", F.format_string("static const int count_%s = %d;", "symbol", "n").alias("line"))


@query("sorted_notes", f"SELECT conv_id, turn, note, len, row_number() OVER (PARTITION BY note ORDER BY len DESC, conv_id, turn) AS place FROM {NOTES}")
def sorted_notes(spark, sf_dir):
    """Notes in order of length inside each pitch."""
    n = Q.placed(notes(spark, sf_dir).withColumn("_fall", -F.col("len")), ["note"], ["_fall", "conv_id", "turn"])
    return n.select("conv_id", "turn", "note", "len", (F.col("place") + 1).alias("place"))


@query("epoch_chunks", """SELECT event_id, CAST((event_id + 7) // 32 AS BIGINT) AS chunk FROM events""")
def epoch_chunks(spark, sf_dir):
    """Contiguous batches of an epoch with an offset."""
    return events(spark, sf_dir).select("event_id", F.floor((F.col("event_id") + 7) / 32).alias("chunk"))
