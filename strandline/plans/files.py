"""Queries that write files in the engine's formats and read them back: sinks and sources, each with SQL on the same values."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantize as V
from ..sources import binary as B
from ..sources import frames as R
from ..sources import midi as M
from ..sources.shared import new_path
from .codecs import NOTES, SKIPS, notes, skips
from .registry import SQL, query
from .streams import RUNS, runs, transitions
from .tiles import DIST, LANES, codes, tiles

#: Tiles that one file holds.
TOGETHER = 100
LUM = "CAST(floor((CAST(v AS DOUBLE) + 1) * 100) AS BIGINT)"


def number_in(path: Column) -> Column:
    """The number in the last part of a path."""
    return F.regexp_extract(path, r"([0-9]+)[^0-9/]*$", 1).cast("long")


def packed_hex(items: DataFrame, by: str, order: str, text: Column) -> DataFrame:
    """(by, n, hex): the hex digits of the rows of each `by`, in the order of `order`, joined."""
    s = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("h")))).alias("s"))
    return s.select(by, F.size("s").alias("n"), F.array_join(F.col("s.h"), "").alias("hex"))


def gray_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, n, hex) of the tiles as gray frames of 8 by 8 bytes, TOGETHER a file, by vec_id."""
    lum = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100)), 2, "0"))
    t = tiles(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / TOGETHER).alias("file"), F.array_join(lum, "").alias("h"))
    return packed_hex(t, "file", "vec_id", F.col("h"))


GRAY = f"""SELECT CAST(file AS BIGINT) AS file, CAST(frame AS BIGINT) AS frame, CAST(lane % 8 AS BIGINT) AS x, CAST(lane // 8 AS BIGINT) AS y, {LUM} AS lum
    FROM {LANES} JOIN (SELECT vec_id, vec_id // {TOGETHER} AS file, row_number() OVER (PARTITION BY vec_id // {TOGETHER} ORDER BY vec_id) - 1 AS frame FROM embeddings) USING (vec_id)"""


def as_pixels(frames: DataFrame) -> DataFrame:
    p = R.pixels(frames, 8)
    return p.select(number_in(F.col("path")).alias("file"), F.col("frame").cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("lum").cast("long").alias("lum"))


@query("gray_frame_files", GRAY)
def gray_frame_files(spark, sf_dir):
    """Tiles written as gray frames without a header, and read as pixels."""
    f = gray_files(spark, sf_dir).select(F.format_string("frames-%d.gray", "file").alias("name"), F.unhex("hex").alias("data"))
    B.write_files(f, folder := new_path(spark, "gray"))
    return as_pixels(R.frames(spark, folder, 8, 8))


@query("headed_frame_files", GRAY)
def headed_frame_files(spark, sf_dir):
    """The same with a line of width and height in front."""
    head = F.hex(F.lit("8 8\n").cast("binary"))
    f = gray_files(spark, sf_dir).select(F.format_string("frames-%d.dat", "file").alias("name"), F.unhex(F.concat(head, "hex")).alias("data"))
    B.write_files(f, folder := new_path(spark, "headed"))
    return as_pixels(R.headed_frames(spark, folder))


@query("tensor_files", f"""WITH f AS (SELECT vec_id // {TOGETHER} AS file FROM embeddings GROUP BY 1 HAVING count(*) = {TOGETHER})
    SELECT CAST(file AS BIGINT) AS file, CAST((row_number() OVER (PARTITION BY file ORDER BY vec_id, lane)) - 1 AS BIGINT) AS place, {LUM} * 1000 + lane AS value
    FROM (SELECT *, vec_id // {TOGETHER} AS file FROM {LANES}) JOIN f USING (file)""")
def tensor_files(spark, sf_dir):
    """Whole tensors of 32-bit words, of which a file must hold just as many as are expected."""
    word = F.transform("embedding", lambda v, k: B.little_endian(F.floor((v.cast("double") + 1) * 100) * 1000 + k))
    t = tiles(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / TOGETHER).alias("file"), F.array_join(word, "").alias("h"))
    f = packed_hex(t, "file", "vec_id", F.col("h")).where(F.col("n") == TOGETHER)
    B.write_files(f.select(F.format_string("tensor-%d.dat", "file").alias("name"), F.unhex("hex").alias("data")), folder := new_path(spark, "tensor"))
    w = R.words(spark, folder, TOGETHER * 64)
    return w.select(number_in(F.col("path")).alias("file"), F.col("place").cast("long").alias("place"), "value")


CELLS = 10


@query("symbol_stream_files", f"""WITH {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1),
    o AS (SELECT vec_id // {TOGETHER} AS file, row_number() OVER (PARTITION BY vec_id // {TOGETHER} ORDER BY vec_id) - 1 AS place, code, label FROM a JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id))
    SELECT CAST(file AS BIGINT) AS file, CAST(place // {CELLS} AS BIGINT) AS frame, CAST(place % {CELLS} AS BIGINT) AS cell, code AS id, label % 2 = 1 AS invert, max(code) OVER () AS highest FROM o""")
def symbol_stream_files(spark, sf_dir):
    """Codes of all tiles dumped as a symbol stream, frame by frame, with a flag for odd labels, and read with the highest id."""
    a = V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir)).join(tiles(spark, sf_dir).select("vec_id", "label"), "vec_id")
    word = B.little_endian(F.col("code") + F.when(F.col("label") % 2 == 1, 0x800).otherwise(0))
    f = packed_hex(a.withColumn("file", F.floor(F.col("vec_id") / TOGETHER)), "file", "vec_id", word)
    B.write_files(f.select(F.format_string("stream-%d.dat", "file").alias("name"), F.unhex("hex").alias("data")), folder := new_path(spark, "stream"))
    s = R.symbols(spark, folder, CELLS).select(number_in(F.col("path")).alias("file"), F.col("frame").cast("long").alias("frame"), F.col("cell").cast("long").alias("cell"), "id", "invert")
    return s.withColumn("highest", F.lit(s.agg(F.max("id")).first()[0]).cast("long"))


@query("counted_glyph_files", """WITH m AS (SELECT label, vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings)
    SELECT CAST(label AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS record, mask FROM m""")
def counted_glyph_files(spark, sf_dir):
    """Masks of the tiles of each label as records of 64 bits behind their count."""
    m = V.masks(tiles(spark, sf_dir), 64).join(tiles(spark, sf_dir).select("vec_id", "label"), "vec_id")
    f = packed_hex(m, "label", "vec_id", F.lpad(F.conv("mask", 2, 16), 16, "0"))
    f = f.select(F.format_string("glyphs-%d.dat", "label").alias("name"), F.unhex(F.concat(B.little_endian(F.col("n")), "hex")).alias("data"))
    B.write_files(f, folder := new_path(spark, "glyphs"))
    r = B.counted_records(spark, folder, 8)
    return r.select(number_in(F.col("path")).alias("file"), "record", F.lpad(F.conv(F.hex("data"), 16, 2), 64, "0").alias("mask"))


@query("alive_tile_files", f"""WITH {DIST}, a AS (SELECT DISTINCT code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1),
    i AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS id FROM a)
    SELECT CAST(id AS BIGINT) AS id, CAST(lane AS INTEGER) AS lane, round(CAST(v AS DOUBLE), 6) AS v FROM i JOIN {LANES} ON vec_id = code""")
def alive_tile_files(spark, sf_dir):
    """Codes that some tile uses, dumped as floats under ids without gaps."""
    t = tiles(spark, sf_dir)
    alive = V.nearest(t, codes(spark, sf_dir)).select(F.col("code").alias("vec_id")).distinct()
    w = Window.orderBy("vec_id")  # a dictionary's codes only
    kept = t.select("vec_id", "embedding").join(F.broadcast(alive), "vec_id").withColumn("id", F.row_number().over(w) - 1)
    data = B.with_float_bytes(kept.select("id", "embedding"), "embedding").select(F.lit(0).alias("file"), "id", F.hex("data").alias("h"))
    f = packed_hex(data, "file", "id", F.col("h")).select(F.lit("tiles-0.dat").alias("name"), F.unhex("hex").alias("data"))
    B.write_files(f, folder := new_path(spark, "alive"))
    v = B.floats(B.records(spark, folder, 256).select("record", "data"), "record")
    return v.select(F.col("record").alias("id"), F.col("place").alias("lane"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("sample_files", SQL["triangle_samples"].replace("round(1 - 4 * abs(ph - floor(ph) - 0.5), 6)", "round(CAST(CAST(1 - 4 * abs(ph - floor(ph) - 0.5) AS FLOAT) AS DOUBLE), 5)"))
def sample_files(spark, sf_dir):
    """Triangle waves of the notes dumped as float samples, a file a note, and read back."""
    s = notes(spark, sf_dir).select("note").distinct().select("note", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i"))
    ph = F.col("i") * S.pitch_hz(F.col("note")) / 16000.0
    v = s.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("i", (1 - 4 * F.abs(ph - F.floor(ph) - 0.5)).alias("v")))).alias("s")).select("note", F.col("s.v").alias("v"))
    f = B.with_float_bytes(v, "v").select(F.format_string("note-%d.pcm", "note").alias("name"), "data")
    B.write_files(f, folder := new_path(spark, "pcm"))
    got = B.floats(B.records(spark, folder, 4 * 64).select(number_in(F.col("path")).alias("note"), "data"), "note")
    return got.select(F.col("note").cast("int").alias("note"), F.col("place").cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query("tile_grid_files", f"""SELECT CAST(file AS BIGINT) AS file, CAST(tile AS BIGINT) AS tile, CAST(lane AS BIGINT) AS lane, {LUM} AS lum
    FROM {LANES} JOIN (SELECT vec_id, vec_id // 40 AS file, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) - 1 AS tile FROM embeddings) USING (vec_id)""")
def tile_grid_files(spark, sf_dir):
    """Tiles shown in pictures of eight in a row with two pixels around each, and cut out of them; places of a picture's
    last row that have no tile are left out by their number."""
    lum = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100)), 2, "0"))
    t = tiles(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 40).alias("file"), F.array_join(lum, "").alias("h"))
    f = packed_hex(t, "file", "vec_id", F.col("h")).select("file", "n", F.unhex("hex").alias("tiles"))

    def draw(batches):
        for b in batches:
            raw = [x.as_py() for x in b["tiles"]]
            data = [B.grid_png([r[i : i + 64] for i in range(0, len(r), 64)], 8) for r in raw]
            name = [f"grid-{n}-of-{k}.png" for k, n in zip(b["n"].to_pylist(), b["file"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(data, pa.binary())], ["name", "data"])

    B.write_files(f.mapInArrow(draw, "name string, data binary"), folder := new_path(spark, "grid"))
    g = B.tile_grids(spark, folder)
    part = lambda k: F.regexp_extract("path", r"grid-([0-9]+)-of-([0-9]+)\.png$", k).cast("long")
    g = g.select(part(1).alias("file"), part(2).alias("n"), "tile", F.hex("data").alias("h")).where("tile < n")
    lanes = g.select("file", "tile", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("lane"))
    return lanes.select("file", "tile", "lane", F.conv(F.substring("h", (F.col("lane") * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long").alias("lum"))


@query("skip_files", f"{SKIPS} SELECT CAST(cell AS INTEGER) AS tile, CAST(on_pos AS INTEGER) AS on_frame, CAST(prev_change AS INTEGER) AS prev_change, CAST(next_change AS INTEGER) AS next_change, round(late_impact, 2) AS late_impact, CASE WHEN run % 5 = 0 THEN NULL ELSE round(early_impact, 2) END AS early_impact FROM k")
def skip_files(spark, sf_dir):
    """Skip candidates as CSV with a header, where an impact that is not known is empty."""
    zero = F.lit(0)
    k = skips(spark, sf_dir).select(
        F.col("cell").cast("int").alias("tile"), F.col("on_pos").cast("int").alias("on_frame"), zero.alias("changed_from"), zero.alias("changed_to"), F.col("prev_change").cast("int").alias("prev_change"),
        F.col("next_change").cast("int").alias("next_change"), F.when(F.col("run") % 5 != 0, F.round("early_impact", 2)).alias("early_impact"), F.round("late_impact", 2).alias("late_impact"),
    ).select("tile", "on_frame", "changed_from", "changed_to", "prev_change", "next_change", "early_impact", "late_impact")
    R.write_skips(k, folder := new_path(spark, "skips"))
    return R.skips(spark, folder).drop("changed_from", "changed_to")


@query("transition_csv", f"""WITH {RUNS}, t AS (SELECT from_sym, to_sym, count(*) AS n FROM chg WHERE from_sym IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT symbol FROM runs)
    SELECT a.symbol AS to_sym, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b.symbol) AS line FROM s a CROSS JOIN s b LEFT JOIN t ON to_sym = a.symbol AND from_sym = b.symbol GROUP BY a.symbol""")
def transition_csv(spark, sf_dir):
    """The dense matrix of transitions as CSV with a header, read back line by line."""
    names = sorted(r.symbol for r in runs(spark, sf_dir).select("symbol").distinct().limit(4096).collect())
    t = transitions(spark, sf_dir).groupBy("to_sym").pivot("from_sym", names).agg(F.sum("n"))
    every = spark.createDataFrame([(n,) for n in names], "to_sym string").join(t, "to_sym", "left").na.fill(0)
    every.write.option("header", True).csv(folder := new_path(spark, "transitions"))
    back = spark.read.option("header", True).schema(", ".join(["to_sym string", *[f"`{n}` long" for n in names]])).csv(folder)
    return back.select("to_sym", F.concat_ws(",", *[F.col(f"`{n}`").cast("string") for n in names]).alias("line"))


@query("symbol_text_files", f"WITH {RUNS} SELECT symbol || ' ' || count(*) || ' ' || CAST(sum(run_len) AS BIGINT) AS line FROM runs GROUP BY symbol")
def symbol_text_files(spark, sf_dir):
    """Symbols with their runs and rows as lines of text."""
    n = runs(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("run_len").alias("rows"))
    n.select(F.concat_ws(" ", "symbol", "n", "rows").alias("value")).write.text(folder := new_path(spark, "symbols"))
    return spark.read.text(folder).select(F.col("value").alias("line"))


BITS = f"""WITH {RUNS}, s AS (SELECT cell, string_agg(CASE WHEN symbol = 'view' THEN '1' ELSE '0' END, '' ORDER BY run) AS bits FROM runs GROUP BY cell),
    w AS (SELECT cell, length(bits) AS n, rpad(bits, CAST(ceil(length(bits) / 32.0) AS INTEGER) * 32, '0') AS bits FROM s),
    y AS (SELECT cell, n, bits, CAST(unnest(range(0, length(bits) // 8)) AS INTEGER) AS k FROM w),
    z AS (SELECT cell, n, k, list_sum(list_transform(range(0, 8), lambda i: CASE WHEN substr(bits, CAST(k * 8 + i + 1 AS INTEGER), 1) = '1' THEN 1 << CAST(i AS INTEGER) ELSE 0 END)) AS lsb,
        list_sum(list_transform(range(0, 8), lambda i: CASE WHEN substr(bits, CAST(k * 8 + i + 1 AS INTEGER), 1) = '1' THEN 128 >> CAST(i AS INTEGER) ELSE 0 END)) AS msb FROM y)"""


@query("packed_bits", BITS + """ SELECT cell, n, string_agg(printf('%02X', CAST(lsb AS INTEGER)), '' ORDER BY k) FILTER (k * 8 < n) AS lsb_bytes, string_agg(printf('%02X', CAST(lsb AS INTEGER)), '' ORDER BY k) AS lsb_words,
    string_agg(printf('%02X', CAST(msb AS INTEGER)), '' ORDER BY k) FILTER (k * 8 < n) AS msb_bytes FROM z GROUP BY cell, n""")
def packed_bits(spark, sf_dir):
    """One bit per run of each user packed in bytes and in little-endian words of 32 bits, lowest bit first, and in bytes,
    highest bit first; as hex digits."""
    bit = F.when(F.col("symbol") == "view", "1").otherwise("0").alias("b")
    c = runs(spark, sf_dir).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("run", bit))).alias("s"))
    c = c.select("cell", F.size("s").cast("long").alias("n"), F.array_join(F.col("s.b"), "").alias("bits"))
    return c.select("cell", "n", F.hex(S.packed_lsb(F.col("bits"), 8)).alias("lsb_bytes"), F.hex(S.packed_lsb(F.col("bits"), 32)).alias("lsb_words"), F.hex(S.packed_msb(F.col("bits"))).alias("msb_bytes"))


@query("header_files", f"""WITH {RUNS}, n AS (SELECT symbol, count(*) AS n, CAST(sum(run_len) AS BIGINT) AS rows FROM runs GROUP BY symbol),
    b AS (SELECT symbol, CAST(greatest(0, least(255, floor(n / rows * 257))) AS BIGINT) AS prob, row_number() OVER (ORDER BY symbol) - 1 AS id FROM n),
    p AS (SELECT string_agg(printf('0x%02x', prob), ', ' ORDER BY id) AS bytes, count(*) AS k FROM b)
    SELECT 0 AS place, '#define SYMBOLS ' || k AS line FROM p UNION ALL SELECT 1, 'static const uint8_t stop_probs[' || k || '] = {{ ' || bytes || ' }};' FROM p
    UNION ALL SELECT CAST(2 + id AS INTEGER), '#define SYMBOL_' || upper(symbol) || ' ' || id FROM b""")
def header_files(spark, sf_dir):
    """A C header with the symbols' numbers and a table of stop chances in 256ths, written as text and read in order."""
    n = runs(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("run_len").alias("rows"))
    w = Window.orderBy("symbol")  # one row per symbol
    b = n.select("symbol", S.probability_byte(F.col("n") / F.col("rows")).cast("long").alias("prob"), (F.row_number().over(w) - 1).alias("id"))
    t = b.agg(F.array_sort(F.collect_list(F.struct("id", F.format_string("0x%02x", "prob").alias("h")))).alias("s")).select(F.size("s").alias("k"), F.array_join(F.col("s.h"), ", ").alias("bytes"))
    count = t.select(F.lit(0).alias("place"), F.format_string("#define SYMBOLS %d", "k").alias("line"))
    table = t.select(F.lit(1).alias("place"), F.format_string("static const uint8_t stop_probs[%d] = { %s };", "k", "bytes").alias("line"))
    lines = count.unionByName(table).unionByName(b.select((F.col("id") + 2).cast("int").alias("place"), F.format_string("#define SYMBOL_%s %d", F.upper("symbol"), "id").alias("line")))
    one = lines.orderBy("place").coalesce(1).select("line")
    one.write.text(folder := new_path(spark, "header"))
    back = spark.read.text(folder, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line"))
    return back


TICKS = f"(SELECT conv_id, turn, turn * 240 AS on_at, turn * 240 + 30 + 120 * greatest(1, len) AS off_at, note FROM {NOTES})"
MIDI = f"""e AS (SELECT conv_id, on_at AS tick, 1 AS is_on, note, turn FROM {TICKS} UNION ALL SELECT conv_id, off_at, 0, note, turn FROM {TICKS}),
    n AS (SELECT conv_id, tick AS on_at, is_on, note, lead(tick) OVER (PARTITION BY conv_id, note ORDER BY tick, is_on) AS off_at FROM e),
    k AS (SELECT conv_id, CAST(on_at AS BIGINT) AS on_at, CAST(off_at AS BIGINT) AS off_at, note FROM n WHERE is_on = 1)"""


def midi_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the conversations written as MIDI files, one each, and read back: (conv_id, on, off, note, disabled)."""
    n = notes(spark, sf_dir).select("conv_id", (F.col("turn") * 240).alias("on"), (F.col("turn") * 240 + 30 + 120 * F.greatest(F.lit(1), F.col("len"))).alias("off"), "note")

    def song(rows: pd.DataFrame) -> pd.DataFrame:
        data = M.written([(int(a), int(b), int(k), 100) for a, b, k in zip(rows["on"], rows["off"], rows["note"])])
        return pd.DataFrame({"name": [f"song-{rows['conv_id'].iloc[0]}.mid"], "data": [data]})

    f = n.groupBy("conv_id").applyInPandas(song, "name string, data binary")
    B.write_files(f, folder := new_path(spark, "songs"))
    return M.notes(M.events(spark, folder)).withColumn("conv_id", number_in(F.col("path")))


@query("midi_files", f"WITH {MIDI} SELECT conv_id, on_at, off_at, CAST(note AS INTEGER) AS note, off_at IS NULL OR note < 1 AS disabled FROM k")
def midi_files(spark, sf_dir):
    """Notes of all songs; each ends at the next event of its pitch."""
    return midi_notes(spark, sf_dir).select("conv_id", F.col("on").alias("on_at"), F.col("off").alias("off_at"), "note", "disabled")


@query("note_sixteenths", f"""WITH {MIDI}, g AS (SELECT *, lead(on_at) OVER (PARTITION BY conv_id ORDER BY on_at, note, off_at) AS next_at FROM k WHERE off_at IS NOT NULL),
    s AS (SELECT conv_id, on_at, note, CAST(floor((off_at - on_at + 1) / 120) AS BIGINT) AS len, CAST(floor((coalesce(next_at, on_at - 1) - on_at + 1) / 120) AS BIGINT) AS gap FROM g)
    SELECT conv_id, on_at, CAST(note AS INTEGER) AS note, CASE WHEN len - 1 > 31 THEN 11 ELSE len - 1 END AS len, CASE WHEN gap >= 8 THEN 7 ELSE gap END AS run FROM s""")
def note_sixteenths(spark, sf_dir):
    """Lengths and gaps of the songs' notes in sixteenths: a length over 32 counts as 12, a gap of 8 or more as 7; the last
    note has no gap."""
    q = M.sixteenths(midi_notes(spark, sf_dir).where("not disabled"), "conv_id")
    return q.select("conv_id", F.col("on").alias("on_at"), "note", "len", "run")


@query("epoch_order", """WITH c AS (SELECT event_id, (event_id + CAST(('0x' || substr(md5('epoch 3'), 1, 4)) AS BIGINT) % 32) // 32 AS chunk FROM events WHERE event_id IS NOT NULL),
    o AS (SELECT chunk, row_number() OVER (ORDER BY md5(chunk || '/3')) - 1 AS batch FROM (SELECT DISTINCT chunk FROM c))
    SELECT CAST(event_id AS BIGINT) AS event_id, CAST(chunk AS BIGINT) AS chunk, CAST(batch AS BIGINT) AS batch FROM c JOIN o USING (chunk)""")
def epoch_order(spark, sf_dir):
    """Batches of the third epoch: contiguous chunks of 32 from an offset that the epoch's number gives, in an order that it
    shuffles."""
    from ..operators.sequence import epoch_batches
    from .streams import events

    return epoch_batches(events(spark, sf_dir).where("event_id is not null").select("event_id"), "event_id", 32, 3).select("event_id", "chunk", "batch")
