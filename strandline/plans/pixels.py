"""Further queries on tiles and their pixels: levels, boxes, variants, boxes of change, blends, penalties and codebooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantize as V
from .codecs import NOTES, notes
from .registry import query
from .tiles import D2, DIST, LANES, LEVELS, codes, lanes, levels, tiles
from .variants import SOFT, _soft


@query("levels_other", f"""SELECT vec_id, CAST(lane AS INTEGER) AS lane, CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INTEGER) >> 6 AS four,
    round_even((CAST(v AS DOUBLE) + 0.5) * 2, 0) / 2 + 0.0 AS half FROM {LANES}""")
def levels_other(spark, sf_dir):
    """Values in four levels, and in halves where ties go to the even one."""
    u = F.col("v").cast("double") + 0.5
    return lanes(spark, sf_dir).select("vec_id", "lane", S.four_levels(u).alias("four"), S.half_levels(u).alias("half"))


@query("box_average_thirds", f"""SELECT vec_id, CAST(ceil((lane // 8 + 1) * 3 / 8.0) - 1 AS BIGINT) AS ty, CAST(ceil((lane % 8 + 1) * 3 / 8.0) - 1 AS BIGINT) AS tx,
    CAST(floor(sum(floor((CAST(v AS DOUBLE) + 0.5) * 255)) / count(*)) AS BIGINT) AS lum FROM {LANES} GROUP BY ALL""")
def box_average_thirds(spark, sf_dir):
    """Tiles of 8 by 8 as boxes of 3 by 3, of which box k is from k * 8 // 3 to (k + 1) * 8 // 3; whole averages."""
    at = lambda c: S.box_of(c, 8, 3).cast("long")
    p = lanes(spark, sf_dir).select("vec_id", at(F.floor(F.col("lane") / 8)).alias("ty"), at(F.col("lane") % 8).alias("tx"), F.floor((F.col("v").cast("double") + 0.5) * 255).alias("u"))
    return p.groupBy("vec_id", "ty", "tx").agg(F.floor(F.sum("u") / F.count("*")).alias("lum"))


#: A code's eight variants in SQL: bit 0 flips across, bit 1 flips down, bit 2 inverts.
VARIANTS = """v AS (SELECT vec_id AS code, CAST(k AS BIGINT) AS variant, list_transform(range(0, 64), lambda i:
        (CASE WHEN k >= 4 THEN -1 ELSE 1 END) * CAST(embedding[CAST((CASE WHEN (k // 2) % 2 = 1 THEN 7 - i // 8 ELSE i // 8 END) * 8 + (CASE WHEN k % 2 = 1 THEN 7 - i % 8 ELSE i % 8 END) + 1 AS INTEGER)] AS DOUBLE)) AS c
    FROM embeddings, (SELECT unnest(range(0, 8)) AS k) WHERE vec_id < 16)"""
BEST = f"""{VARIANTS}, d AS (SELECT vec_id, code, variant, sqrt({D2.format(a="embedding", b="c")}) AS dist FROM embeddings, v),
    b AS (SELECT vec_id, code, variant, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code, variant) = 1)"""


def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, variant, dist): each tile's nearest variant of a code; the first of equals by code, then variant."""
    ids, table = codes(spark, sf_dir)
    found = V.nearest(tiles(spark, sf_dir), (np.arange(8 * len(ids)), V.variants(table, 8)))
    number = F.element_at(F.array(*[F.lit(int(i)) for i in ids]), F.floor(F.col("code") / 8).cast("int") + 1)
    return found.select("vec_id", number.cast("long").alias("code"), F.pmod("code", F.lit(8)).alias("variant"), "dist")


@query("variant_best", f"WITH {BEST} SELECT vec_id, code, variant, round(dist, 6) AS dist FROM b")
def variant_best(spark, sf_dir):
    """The nearest code to each tile when codes may be flipped and inverted."""
    return best_variants(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query("variant_centroids", f"""WITH {BEST}, u AS (SELECT b.code, b.variant, e.label + 1 AS w, unnest(range(0, 64)) AS i, e.embedding FROM b JOIN embeddings e USING (vec_id)),
    p AS (SELECT code, w, i, (CASE WHEN variant >= 4 THEN -1 ELSE 1 END) * CAST(embedding[CAST((CASE WHEN (variant // 2) % 2 = 1 THEN 7 - i // 8 ELSE i // 8 END) * 8 + (CASE WHEN variant % 2 = 1 THEN 7 - i % 8 ELSE i % 8 END) + 1 AS INTEGER)] AS DOUBLE) AS v FROM u)
    SELECT code, CAST(i AS INTEGER) AS lane, round(sum(v * w) / sum(w), 6) AS mean FROM p GROUP BY code, i""")
def variant_centroids(spark, sf_dir):
    """Weighted means of the tiles of each code, with the flips and the inversion by which they met it undone."""
    t = tiles(spark, sf_dir).select("vec_id", "embedding", (F.col("label") + 1).alias("w"))
    a = best_variants(spark, sf_dir).join(t, "vec_id").withColumn("embedding", S.variant("embedding", F.col("variant"), 8))
    return V.centroids(a).withColumn("mean", F.round("mean", 6))


@query("hamming_to_last", """WITH m AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings)
    SELECT a.vec_id, CAST(hamming(a.mask, b.mask) AS INTEGER) AS dist FROM m a JOIN m b ON b.vec_id = a.vec_id - 1""")
def hamming_to_last(spark, sf_dir):
    """In how many lanes each tile's 64-bit mask differs from that of the tile before."""
    m = tiles(spark, sf_dir).select("vec_id", S.mask_bits(F.col("embedding"), 0.0).alias("m"))
    return m.join(m.select((F.col("vec_id") + 1).alias("vec_id"), F.col("m").alias("was")), "vec_id").select("vec_id", S.hamming(F.col("m"), F.col("was")).cast("int").alias("dist"))


@query("note_unpacked", f"SELECT conv_id, turn, note, len, run FROM {NOTES}")
def note_unpacked(spark, sf_dir):
    """Notes packed in 16 bits and taken apart again."""
    packed = notes(spark, sf_dir).select("conv_id", "turn", S.packed_note(F.col("note"), F.col("len"), F.col("run")).alias("p"))
    return packed.select("conv_id", "turn", *[c.cast("int").alias(k) for k, c in zip(("note", "len", "run"), S.unpacked_note(F.col("p")))])


@query("phase_steps", f"SELECT DISTINCT note, CAST(floor(pow(2.0, (note - 69) / 12.0) * 440.0 * 65536.0 / 16000.0 + 0.5) AS BIGINT) & 65535 AS step FROM {NOTES}")
def phase_steps(spark, sf_dir):
    """Steps of a 16-bit phase at 16 kHz for the notes that occur."""
    return notes(spark, sf_dir).select("note").distinct().select("note", S.phase_step(F.col("note"), 16000).alias("step"))


@query("strip_inverse", f"SELECT vec_id, CAST(lane AS INTEGER) AS lane, CAST(lane AS BIGINT) AS back FROM {LANES}")
def strip_inverse(spark, sf_dir):
    """Lanes found again from their places in strips."""
    at = lanes(spark, sf_dir).select("vec_id", "lane", S.strip_place(F.col("lane") % 8, F.floor(F.col("lane") / 8), 8, 4).alias("place"))
    x, y = S.strip_at(F.col("place"), 8, 4)
    return at.select("vec_id", "lane", (y * 8 + x).cast("long").alias("back"))


@query("bilinear", """WITH p AS (SELECT vec_id, embedding AS e, CAST(unnest(range(0, 256)) AS INTEGER) AS i FROM embeddings), q AS (SELECT vec_id, e, i % 16 AS px, i // 16 AS py FROM p),
    r AS (SELECT *, px // 2 AS x0, py // 2 AS y0, least(px // 2 + 1, 7) AS x1, least(py // 2 + 1, 7) AS y1, (px % 2) / 2.0 AS fx, (py % 2) / 2.0 AS fy FROM q),
    s AS (SELECT vec_id, px, py, fy, CAST(e[y0 * 8 + x0 + 1] AS DOUBLE) * (1 - fx) + CAST(e[y0 * 8 + x1 + 1] AS DOUBLE) * fx AS a, CAST(e[y1 * 8 + x0 + 1] AS DOUBLE) * (1 - fx) + CAST(e[y1 * 8 + x1 + 1] AS DOUBLE) * fx AS b FROM r)
    SELECT vec_id, px, py, round(a * (1 - fy) + b * fy, 6) + 0.0 AS v FROM s""")
def bilinear(spark, sf_dir):
    """Tiles sampled at twice their size between four pixels, edges repeated."""
    p = tiles(spark, sf_dir).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    p = p.select("vec_id", "embedding", (F.col("i") % 16).alias("px"), F.floor(F.col("i") / 16).cast("int").alias("py"))
    return p.select("vec_id", "px", "py", (F.round(S.sampled(F.col("embedding"), F.col("px") / 2, F.col("py") / 2, 8), 6) + 0.0).alias("v"))


@query("edge_blend_soft_both", f"""WITH s AS (SELECT *, lane // 8 AS y, lane % 8 AS x FROM ({SOFT.format(source=LANES)})), n AS (SELECT vec_id, y, x, c, coalesce(lag(c) OVER w, c) AS l, coalesce(lead(c) OVER w, c) AS r FROM s WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)),
    a AS (SELECT vec_id, y, x, CASE WHEN x IN (0, 7) THEN {_soft("c", "l", "r")} ELSE c END AS c FROM n),
    m AS (SELECT vec_id, y, x, c, coalesce(lag(c) OVER w, c) AS l, coalesce(lead(c) OVER w, c) AS r FROM a WINDOW w AS (PARTITION BY vec_id, x ORDER BY y))
    SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CASE WHEN y IN (0, 7) THEN {_soft("c", "l", "r")} ELSE c END, 6) AS v FROM m""")
def edge_blend_soft_both(spark, sf_dir):
    """The soft blend of levels between 0 and 2 on the edges of tiles, across and then down."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("v").cast("double") + 0.5) * 2))
    out = lanes(spark, sf_dir).select("vec_id", F.floor(F.col("lane") / 8).cast("int").alias("y"), (F.col("lane") % 8).alias("x"), c.alias("c"))
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("vec_id", across).orderBy(along)
        out = out.withColumns({"l": F.coalesce(F.lag("c").over(w), "c"), "r": F.coalesce(F.lead("c").over(w), "c")})
        out = out.withColumn("c", F.when(F.col(along).isin(0, 7), F.expr(_soft("c", "l", "r"))).otherwise(F.col("c"))).drop("l", "r")
    return out.select("vec_id", "y", "x", F.round("c", 6).alias("v"))


@query("change_box_all", f"""WITH l AS (SELECT a.vec_id, a.x, a.y, a.level <> b.level AS new FROM {LEVELS} a JOIN {LEVELS} b ON b.vec_id = a.vec_id - CASE WHEN a.vec_id % 5 = 0 THEN 0 ELSE 1 END AND a.x = b.x AND a.y = b.y)
    SELECT vec_id, coalesce(min(x) FILTER (new), 0) AS x, coalesce(min(y) FILTER (new), 0) AS y, coalesce(max(x) FILTER (new) - min(x) FILTER (new), 0) + 1 AS width,
    coalesce(max(y) FILTER (new) - min(y) FILTER (new), 0) + 1 AS height, count(*) FILTER (new) AS changed FROM l GROUP BY vec_id""")
def change_box_all(spark, sf_dir):
    """The box around what changed from the tile before, every fifth tile being shown twice: one pixel where nothing did."""
    shown = levels(spark, sf_dir)
    before = F.col("vec_id") - F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1)
    c = shown.withColumn("_b", before).join(shown.select(F.col("vec_id").alias("_b"), "x", "y", F.col("level").alias("was")), ["_b", "x", "y"])
    new = lambda k: F.when(F.col("level") != F.col("was"), F.col(k))
    box = c.groupBy("vec_id").agg(F.min(new("x")).alias("x0"), F.max(new("x")).alias("x1"), F.min(new("y")).alias("y0"), F.max(new("y")).alias("y1"), F.count(new("x")).alias("changed"))
    zero = lambda v: F.coalesce(v, F.lit(0))
    return box.select("vec_id", zero(F.col("x0")).alias("x"), zero(F.col("y0")).alias("y"), (zero(F.col("x1") - F.col("x0")) + 1).alias("width"), (zero(F.col("y1") - F.col("y0")) + 1).alias("height"), "changed")


@query("frame_loss", f"WITH {DIST}, a AS (SELECT vec_id, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1) SELECT CAST(vec_id // 10 AS BIGINT) AS frame, round(avg(dist * dist / 64), 6) AS loss, count(*) AS n FROM a GROUP BY 1")
def frame_loss(spark, sf_dir):
    """Mean squared difference between the tiles of each frame, ten to one, and their codes."""
    a = V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir), squared=True)
    return a.groupBy(F.floor(F.col("vec_id") / 10).alias("frame")).agg(F.round(F.avg(F.col("dist") / 64), 6).alias("loss"), F.count("*").alias("n"))


@query("log_penalty", f"""WITH {DIST}, p AS (SELECT vec_id, code, -dist * dist - ln(sum(exp(-dist * dist)) OVER (PARTITION BY vec_id)) AS lp FROM d WHERE code < 4),
    j AS (SELECT a.vec_id, a.code, a.lp AS la, b.lp AS lb, greatest(a.lp, b.lp) AS top FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.code = b.code)
    SELECT vec_id, code, round((-la - lb) / 2, 6) AS penalty FROM j QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY top DESC, code) = 1""")
def log_penalty(spark, sf_dir):
    """What a change to the next tile costs: the code that is likeliest in either of the two, by its mean negative log-chance."""
    d = V.all_distances(tiles(spark, sf_dir), V.codebook(tiles(spark, sf_dir).where("vec_id < 4")), squared=True)
    lp = F.transform("dist", lambda x: -x - F.ln(F.aggregate("dist", F.lit(0.0), lambda acc, y: acc + F.exp(-y))))
    p = d.select("vec_id", lp.alias("la"))
    j = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("la").alias("lb")), "vec_id")
    both = F.transform(F.arrays_zip("la", "lb"), lambda x, k: F.struct((-F.greatest(x["la"], x["lb"])).alias("top"), k.cast("long").alias("code"), ((-x["la"] - x["lb"]) / 2).alias("penalty")))
    best = F.array_min(both)
    return j.select("vec_id", best["code"].alias("code"), F.round(best["penalty"], 6).alias("penalty"))


# ---- a first codebook ----

# The lines of eight pixels that a first codebook is made of.
LINES = ("00000000", "00001111", "00111100", "01111000", "00011110", "00110011", "01100110")


@query("line_codebook", f"""WITH b AS (SELECT unnest([{", ".join(f"'{x}'" for x in LINES)}]) AS a), f AS (SELECT a FROM b UNION SELECT translate(a, '01', '10') FROM b), p AS (SELECT x.a AS a, y.a AS b FROM f x, f y),
    t AS (SELECT a, b, unnest(['and', 'or', 'xor']) AS op FROM p),
    k AS (SELECT array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN CASE op WHEN 'and' THEN substr(a, CAST(i % 8 + 1 AS INTEGER), 1) = '1' AND substr(b, CAST(i // 8 + 1 AS INTEGER), 1) = '1' WHEN 'or' THEN substr(a, CAST(i % 8 + 1 AS INTEGER), 1) = '1' OR substr(b, CAST(i // 8 + 1 AS INTEGER), 1) = '1'
        ELSE substr(a, CAST(i % 8 + 1 AS INTEGER), 1) <> substr(b, CAST(i // 8 + 1 AS INTEGER), 1) END THEN '1' ELSE '0' END), '') AS m FROM t)
    SELECT DISTINCT least(m, translate(m, '01', '10')) AS mask FROM k""")
def line_codebook(spark, sf_dir):
    """Masks that a line across and one down give by and, or and exclusive or; of a mask and its inverse, one."""
    line = spark.createDataFrame([(x,) for x in LINES], "a string")
    every = line.unionByName(line.select(F.translate("a", "01", "10").alias("a"))).distinct()
    # The crossed tables are constants: 14 lines at most on either side.
    pairs = every.crossJoin(every.withColumnRenamed("a", "b"))
    bit = lambda c, k: F.substring(F.col(c), (k + 1).cast("int"), F.lit(1)) == "1"
    place = F.sequence(F.lit(0), F.lit(63))

    def made(op):
        return F.array_join(F.transform(place, lambda i: F.when(op(bit("a", i % 8), bit("b", F.floor(i / 8))), "1").otherwise("0")), "")

    masks = F.array(made(lambda p, q: p & q), made(lambda p, q: p | q), made(lambda p, q: p != q))
    m = pairs.select(F.explode(masks).alias("m"))
    return m.select(F.least("m", V.complement(F.col("m"))).alias("mask")).distinct()
