"""Queries on tiles: the 64 numbers of an embedding are an 8 by 8 tile, its first 16 ids a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantize as V
from ..sources.tables import table
from .registry import SQL, query

D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
DIST = f"""codes AS (SELECT vec_id AS code, embedding AS c FROM embeddings WHERE vec_id < 16),
    d AS (SELECT vec_id, code, sqrt({D2.format(a="embedding", b="c")}) AS dist FROM embeddings, codes)"""
LANES = "(SELECT vec_id, unnest(range(0, 64)) AS lane, unnest(embedding) AS v FROM embeddings)"
#: Levels 0 to 2 of the lanes.
LEVELS = f"(SELECT vec_id, lane // 8 AS y, lane % 8 AS x, CAST(greatest(0, least(floor((CAST(v AS DOUBLE) + 0.5) * 2.999), 2)) AS INTEGER) AS level FROM {LANES})"


LANES_OF_A_TILE = 64


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def codes(spark: SparkSession, sf_dir: str):
    return V.codebook(tiles(spark, sf_dir).where("vec_id < 16"))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, lane, v), one row per number."""
    return tiles(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("lane", "v"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, level) in three levels."""
    level = S.gray_level(F.col("v").cast("double") + 0.5)
    return lanes(spark, sf_dir).select("vec_id", F.floor(F.col("lane") / 8).alias("y"), (F.col("lane") % 8).cast("long").alias("x"), level.alias("level"))


@query("vq_assign", f"WITH {DIST} SELECT vec_id, code, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1")
def vq_assign(spark, sf_dir):
    """Each tile's nearest code."""
    return V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query("vq_biased", f"WITH {DIST} SELECT vec_id, code, round(dist + 0.01 * code, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist + 0.01 * code, code) = 1")
def vq_biased(spark, sf_dir):
    """Nearest code when codes further down the dictionary cost more."""
    return V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir), bias=0.01).withColumn("dist", F.round("dist", 6))


@query("vq_centroids", f"""WITH {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1)
    SELECT code, CAST(lane AS INTEGER) AS lane, round(sum(CAST(v AS DOUBLE) * (label + 1)) / sum(label + 1), 6) AS mean FROM a JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) JOIN {LANES} USING (vec_id) GROUP BY code, lane""")
def vq_centroids(spark, sf_dir):
    """Means of the tiles of each code, weighted by label + 1."""
    t = tiles(spark, sf_dir)
    a = V.nearest(t, codes(spark, sf_dir)).select("vec_id", "code").join(t.select("vec_id", "embedding", (F.col("label") + 1).alias("w")), "vec_id")
    return V.centroids(a).withColumn("mean", F.round("mean", 6))


def exact_else_nearest(spark: SparkSession, sf_dir: str, lanes: int) -> DataFrame:
    """(vec_id, code, exact): of the first four tiles the one with the same mask of the first `lanes` lanes, or else the nearest."""
    t = tiles(spark, sf_dir)
    m = V.masks(t, lanes)
    exact = m.where("vec_id < 4").groupBy("mask").agg(F.min("vec_id").alias("code"))
    met = m.join(F.broadcast(exact), "mask", "left")  # masks of the codes only
    rest = t.join(met.where("code is null").select("vec_id"), "vec_id", "left_semi")
    near = V.nearest(rest, V.codebook(t.where("vec_id < 4"))).select("vec_id", "code", F.lit(False).alias("exact"))
    return met.where("code is not null").select("vec_id", "code", F.lit(True).alias("exact")).unionByName(near)


@query("vq_exact_else_nearest", f"""WITH {DIST}, m AS (SELECT vec_id, array_to_string(list_transform(embedding[1:4], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings),
    k AS (SELECT mask, min(vec_id) AS code FROM m WHERE vec_id < 4 GROUP BY mask),
    n AS (SELECT vec_id, code FROM d WHERE code < 4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1)
    SELECT m.vec_id, coalesce(k.code, n.code) AS code, k.code IS NOT NULL AS exact FROM m LEFT JOIN k USING (mask) JOIN n USING (vec_id)""")
def vq_exact_else_nearest(spark, sf_dir):
    """The code with the same coarse mask of four lanes, as the SQL has it, and only where there is none the nearest one."""
    return exact_else_nearest(spark, sf_dir, 4)


@query("vq_exact_else_nearest_whole", SQL["vq_exact_else_nearest"].replace("embedding[1:4]", "embedding"))
def vq_exact_else_nearest_whole(spark, sf_dir):
    """The code with the same mask of all lanes, and only where there is none the nearest one."""
    return exact_else_nearest(spark, sf_dir, LANES_OF_A_TILE)


@query("code_usage", f"WITH {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1) SELECT code, count(*) AS n FROM a GROUP BY code")
def code_usage(spark, sf_dir):
    """How many tiles use each code."""
    return V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("bottomk_prune", f"""WITH {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1),
    n AS (SELECT code, count(*) AS n FROM a GROUP BY code) SELECT code, n, row_number() OVER (ORDER BY n, code DESC) AS place FROM n QUALIFY place <= 8""")
def bottomk_prune(spark, sf_dir):
    """The eight least used codes."""
    return V.least_used(code_usage(spark, sf_dir), 8)


@query("code_loss", f"WITH {DIST}, a AS (SELECT vec_id, code, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1) SELECT code, round(avg(dist * dist / 64), 6) AS loss FROM a GROUP BY code")
def code_loss(spark, sf_dir):
    """Mean squared difference between tiles and their codes."""
    a = V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir), squared=True)
    return a.groupBy("code").agg(F.round(F.avg(F.col("dist") / 64), 6).alias("loss"))


@query("code_logits", f"WITH {DIST} SELECT vec_id, code, round(exp(-dist * dist) / sum(exp(-dist * dist)) OVER (PARTITION BY vec_id), 6) AS p FROM d WHERE code < 4")
def code_logits(spark, sf_dir):
    """Start of a learned sequence: a tile's chances of the first four codes from its squared distances."""
    d = V.all_distances(tiles(spark, sf_dir), V.codebook(tiles(spark, sf_dir).where("vec_id < 4")), squared=True)
    e = F.transform("dist", lambda x: F.exp(-x))
    p = d.select("vec_id", e.alias("e"), F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x).alias("s"))
    return p.select("vec_id", F.posexplode(F.transform("e", lambda x: F.round(x / F.col("s"), 6))).alias("code", "p")).withColumn("code", F.col("code").cast("long"))


@query("variant_distance", f"""WITH codes AS (SELECT embedding AS c FROM embeddings WHERE vec_id = 0),
    v AS (SELECT vec_id, unnest([0, 1]) AS variant, unnest([embedding, list_transform(embedding, lambda v: -v)]) AS e FROM embeddings),
    d AS (SELECT vec_id, variant, sqrt({D2.format(a="e", b="c")}) AS dist FROM v, codes)
    SELECT vec_id, CAST(variant AS INTEGER) AS variant, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, variant) = 1""")
def variant_distance(spark, sf_dir):
    """Whether a tile or its inverse is nearer to the first tile."""
    _, t = V.codebook(tiles(spark, sf_dir).where("vec_id = 0"))
    code = F.array(*[F.lit(float(v)) for v in t[0]])
    forms = [F.col("embedding"), F.transform("embedding", lambda v: -v)]
    best = F.array_min(F.array(*[F.struct(F.sqrt(S.squared_distance(f, code)).alias("dist"), F.lit(k).alias("variant")) for k, f in enumerate(forms)]))
    return tiles(spark, sf_dir).select("vec_id", best.alias("b")).select("vec_id", "b.variant", F.round("b.dist", 6).alias("dist"))


@query("tile_flips", f"""SELECT vec_id, lane, CAST(e[(lane // 8) * 8 + 7 - lane % 8 + 1] AS DOUBLE) AS flip_x, CAST(e[(7 - lane // 8) * 8 + lane % 8 + 1] AS DOUBLE) AS flip_y
    FROM (SELECT vec_id, embedding AS e, CAST(unnest(range(0, 64)) AS INTEGER) AS lane FROM embeddings)""")
def tile_flips(spark, sf_dir):
    """Each tile flipped in x and in y."""
    x, y = S.flipped_x(F.col("embedding"), 8), S.flipped_y(F.col("embedding"), 8)
    both = tiles(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("lane", "p"))
    return both.select("vec_id", "lane", F.col("p.x").cast("double").alias("flip_x"), F.col("p.y").cast("double").alias("flip_y"))


MASK8 = "m AS (SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings)"


@query("tile_masks", "SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings")
def tile_masks(spark, sf_dir):
    """Tiles as masks of 64 bits, written out."""
    return V.masks(tiles(spark, sf_dir), 64)


@query("tile_unpack", f"SELECT vec_id, CAST(lane AS INTEGER) AS lane, CASE WHEN v > 0 THEN 1 ELSE 0 END AS bit FROM {LANES}")
def tile_unpack(spark, sf_dir):
    """Masks as 64-bit numbers, unpacked into one row per bit again."""
    m = tiles(spark, sf_dir).select("vec_id", S.mask_bits(F.col("embedding"), 0.0).alias("bits"))
    lane = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("lane")
    return m.select("vec_id", "bits", lane).select("vec_id", "lane", F.getbit("bits", "lane").cast("int").alias("bit"))


def deduped(m: DataFrame) -> DataFrame:
    return m.groupBy("mask").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


def deduped_with_complement(m: DataFrame) -> DataFrame:
    other = V.complement(F.col("mask"))
    m = m.withColumn("inv", F.col("mask") > other).withColumn("mask", F.least("mask", other))
    return m.groupBy("mask").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.count_if("inv").alias("inverted"))


@query("tile_dedup", f"WITH {MASK8} SELECT mask, count(*) AS n, min(vec_id) AS first_id FROM m GROUP BY mask")
def tile_dedup(spark, sf_dir):
    """Distinct masks of eight lanes, as the SQL has it, with how often they occur and where first."""
    return deduped(V.masks(tiles(spark, sf_dir), 8))


@query("tile_dedup_whole", SQL["tile_dedup"].replace("embedding[1:8]", "embedding"))
def tile_dedup_whole(spark, sf_dir):
    """The same for masks of all lanes."""
    return deduped(V.masks(tiles(spark, sf_dir), LANES_OF_A_TILE))


@query("tile_dedup_complement", f"WITH {MASK8} SELECT least(mask, translate(mask, '01', '10')) AS mask, count(*) AS n, min(vec_id) AS first_id, count(*) FILTER (mask > translate(mask, '01', '10')) AS inverted FROM m GROUP BY 1")
def tile_dedup_complement(spark, sf_dir):
    """The same, where a mask and its complement are one."""
    return deduped_with_complement(V.masks(tiles(spark, sf_dir), 8))


@query("tile_dedup_complement_whole", SQL["tile_dedup_complement"].replace("embedding[1:8]", "embedding"))
def tile_dedup_complement_whole(spark, sf_dir):
    """The same for masks of all lanes."""
    return deduped_with_complement(V.masks(tiles(spark, sf_dir), LANES_OF_A_TILE))


MASK16 = "m AS (SELECT min(vec_id) AS id, mask, count(*) AS n FROM (SELECT vec_id, array_to_string(list_transform(embedding[1:16], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask FROM embeddings) GROUP BY mask)"
NEAR = "p AS (SELECT a.id AS a, b.id AS b, CAST(hamming(a.mask, b.mask) AS INTEGER) AS dist FROM m a JOIN m b ON a.id < b.id AND hamming(a.mask, b.mask) < 3)"


def coarse(spark: SparkSession, sf_dir: str, lanes: int = LANES_OF_A_TILE) -> DataFrame:
    """(id, mask, n): distinct masks of the first `lanes` lanes."""
    m = V.masks(tiles(spark, sf_dir), lanes).groupBy("mask").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return m.select("id", "mask", "n")


@query("hamming_near_pairs", f"WITH {MASK16}, {NEAR} SELECT a, b, dist FROM p")
def hamming_near_pairs(spark, sf_dir):
    """Pairs of masks of 16 lanes, as the SQL has it, that differ in fewer than three."""
    return V.near_pairs(coarse(spark, sf_dir, 16).select("id", "mask"), 3, 16)


@query("hamming_prune", f"""WITH {MASK16}, {NEAR}, e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p)
    SELECT id, n FROM m WHERE id NOT IN (SELECT x FROM e JOIN m u ON u.id = x JOIN m v ON v.id = y WHERE v.n > u.n OR (v.n = u.n AND y < x))""")
def hamming_prune(spark, sf_dir):
    """Masks of 16 lanes, as the SQL has it, without those that are near a more frequent one."""
    c = coarse(spark, sf_dir, 16)
    return V.pruned(c, V.near_pairs(c.select("id", "mask"), 3, 16))


@query("hamming_prune_whole", SQL["hamming_prune"].replace("embedding[1:16]", "embedding"))
def hamming_prune_whole(spark, sf_dir):
    """The same for masks of all lanes."""
    c = coarse(spark, sf_dir)
    return V.pruned(c, V.near_pairs(c.select("id", "mask"), 3, LANES_OF_A_TILE))


@query("hamming_prune_greedy")
def hamming_prune_greedy(spark, sf_dir):
    """Masks of all lanes in order of frequency, without those that are near one that stayed."""
    return V.greedy_pruned(coarse(spark, sf_dir), LANES_OF_A_TILE, 3)


@query("kmeans_pruned")
def kmeans_pruned(spark, sf_dir):
    """Codes of weighted k-means that starts with 32 and prunes to 16."""
    ids, t = V.kmeans(tiles(spark, sf_dir), 32, 16, 6)
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, t)], "code long, tile array<double>")


@query("halftone", f"SELECT vec_id, CAST(lane AS INTEGER) AS lane, CASE WHEN (lane % 8 + lane // 8) % 2 = 1 THEN CAST(v > 0.1 AS INTEGER) ELSE CAST(v > -0.1 AS INTEGER) END AS bit FROM {LANES}")
def halftone(spark, sf_dir):
    """Bits by a checkerboard of two thresholds."""
    bit = S.halftone(F.col("v"), F.col("lane") % 8, F.floor(F.col("lane") / 8), -0.1, 0.1)
    return lanes(spark, sf_dir).select("vec_id", "lane", bit.alias("bit"))


@query("gray_levels", f"SELECT level, count(*) AS n FROM {LEVELS} GROUP BY level")
def gray_levels(spark, sf_dir):
    """How often each of three levels occurs."""
    return levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query("box_average", f"SELECT vec_id, CAST(lane // 8 // 2 AS BIGINT) AS ty, CAST(lane % 8 // 2 AS BIGINT) AS tx, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM {LANES} GROUP BY 1, 2, 3")
def box_average(spark, sf_dir):
    """Tiles at half size, by averages of two by two."""
    ty, tx = F.floor(F.col("lane") / 16).alias("ty"), F.floor(F.col("lane") % 8 / 2).alias("tx")
    return lanes(spark, sf_dir).groupBy("vec_id", ty, tx).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


@query("unfold_tiles", """SELECT vec_id, (lane // 32) * 2 + (lane % 8) // 4 AS tile, CAST((lane // 8 % 4) * 4 + lane % 4 AS INTEGER) AS place, CAST(v AS DOUBLE) AS v
    FROM (SELECT vec_id, unnest(range(0, 64)) AS lane, unnest(embedding) AS v FROM embeddings)""")
def unfold_tiles(spark, sf_dir):
    """Each 8 by 8 tile as four of 4 by 4."""
    tile = (F.floor(F.col("lane") / 32) * 2 + F.floor(F.col("lane") % 8 / 4)).alias("tile")
    g = lanes(spark, sf_dir).groupBy("vec_id", tile).agg(F.sort_array(F.collect_list(F.struct("lane", F.col("v").cast("double").alias("v")))).alias("s"))
    return g.select("vec_id", "tile", F.posexplode("s.v").alias("place", "v"))


@query("fold_tiles", f"WITH {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1) SELECT a.vec_id, CAST(lane AS INTEGER) AS lane, CAST(v AS DOUBLE) AS v FROM a JOIN {LANES} l ON l.vec_id = a.code")
def fold_tiles(spark, sf_dir):
    """Tiles rebuilt from their codes: a lookup by code."""
    a = V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir)).select("vec_id", "code")
    t = lanes(spark, sf_dir).where("vec_id < 16").select(F.col("vec_id").alias("code"), "lane", F.col("v").cast("double").alias("v"))
    return a.join(t, "code").select("vec_id", "lane", "v")


@query("tile_blur", f"""WITH l AS (SELECT vec_id, lane, lane % 8 AS x, lane // 8 AS y, CAST(v AS DOUBLE) AS v FROM {LANES})
    SELECT a.vec_id, CAST(a.lane AS INTEGER) AS lane, round(sum(b.v * exp(-sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5)) / sum(exp(-sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5)), 6) AS v
    FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY a.vec_id, a.lane""")
def tile_blur(spark, sf_dir):
    """Tiles blurred inside themselves with weights that fall exponentially with distance."""
    import math

    w = [[math.exp(-math.hypot(a % 8 - b % 8, a // 8 - b // 8) / 0.5) for b in range(64)] for a in range(64)]
    w = [[v / sum(row) for v in row] for row in w]
    blur = [F.aggregate(F.zip_with(F.col("e"), F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in w]
    e = tiles(spark, sf_dir).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return e.select("vec_id", F.posexplode(F.array(*blur)).alias("lane", "v")).withColumn("v", F.round("v", 6))


# The level of a pixel from its own, its left and its right level, in order of centre, left, right.
BLEND = "001011111011112122122222222"


@query("edge_blend", f"""WITH l AS (SELECT vec_id, x, y, level, coalesce(lag(level) OVER w, level) AS le, coalesce(lead(level) OVER w, level) AS ri FROM {LEVELS} WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)),
    h AS (SELECT vec_id, x, y, CASE WHEN x IN (0, 7) THEN CAST(substr('{BLEND}', level * 9 + le * 3 + ri + 1, 1) AS INTEGER) ELSE level END AS level FROM l),
    v AS (SELECT vec_id, x, y, level, coalesce(lag(level) OVER w, level) AS up, coalesce(lead(level) OVER w, level) AS dn FROM h WINDOW w AS (PARTITION BY vec_id, x ORDER BY y))
    SELECT vec_id, x, y, CASE WHEN y IN (0, 7) THEN CAST(substr('{BLEND}', level * 9 + up * 3 + dn + 1, 1) AS INTEGER) ELSE level END AS level FROM v""")
def edge_blend(spark, sf_dir):
    """Levels on the edges of tiles blended with their neighbours, across and then down."""
    out = levels(spark, sf_dir)
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("vec_id", across).orderBy(along)
        a, b = F.coalesce(F.lag("level").over(w), "level"), F.coalesce(F.lead("level").over(w), "level")
        new = F.substring(F.lit(BLEND), F.col("level") * 9 + a * 3 + b + 1, F.lit(1)).cast("int")
        out = out.withColumn("level", F.when(F.col(along).isin(0, 7), new).otherwise(F.col("level")))
    return out


@query("pixel_transitions", f"""WITH l AS (SELECT vec_id, y * 8 + x AS lane, CASE WHEN level > 0 THEN 1 ELSE 0 END AS bit FROM {LEVELS}),
    c AS (SELECT *, lag(bit) OVER w AS was, CASE WHEN bit IS DISTINCT FROM lag(bit) OVER w THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY lane)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY lane) AS run FROM c),
    r AS (SELECT bit, lead(bit) OVER (PARTITION BY vec_id ORDER BY lane) AS nxt, least(8, row_number() OVER (PARTITION BY vec_id, run ORDER BY lane) - 1) AS place FROM g)
    SELECT bit, place, count(*) AS n, count(*) FILTER (nxt = 1) AS ones FROM r WHERE nxt IS NOT NULL GROUP BY bit, place""")
def pixel_transitions(spark, sf_dir):
    """How often the next pixel is 1, by a pixel's value and how far into its run it is."""
    w = Window.partitionBy("vec_id").orderBy("lane")
    p = levels(spark, sf_dir).select("vec_id", (F.col("y") * 8 + F.col("x")).alias("lane"), F.when(F.col("level") > 0, 1).otherwise(0).alias("bit"))
    p = p.withColumn("new", (~F.col("bit").eqNullSafe(F.lag("bit").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    place = F.least(F.lit(8), F.row_number().over(Window.partitionBy("vec_id", "run").orderBy("lane")) - 1).cast("long")
    r = p.select("bit", F.lead("bit").over(w).alias("nxt"), place.alias("place"))
    return r.where("nxt is not null").groupBy("bit", "place").agg(F.count("*").alias("n"), F.count_if(F.col("nxt") == 1).alias("ones"))


@query("change_box", f"""WITH l AS (SELECT a.vec_id, a.x, a.y FROM {LEVELS} a JOIN {LEVELS} b ON b.vec_id = a.vec_id - 1 AND a.x = b.x AND a.y = b.y AND a.level <> b.level)
    SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS changed FROM l GROUP BY vec_id""")
def change_box(spark, sf_dir):
    """The box around what changed from the tile before."""
    prev = levels(spark, sf_dir).select((F.col("vec_id") + 1).alias("vec_id"), "x", "y", F.col("level").alias("was"))
    c = levels(spark, sf_dir).join(prev, ["vec_id", "x", "y"]).where("level <> was")
    return c.groupBy("vec_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("changed"))


@query("strip_order", f"SELECT vec_id, CAST(lane AS INTEGER) AS lane, CAST((lane // 8 // 4) * 32 + (lane % 8) * 4 + (lane // 8) % 4 AS BIGINT) AS place FROM {LANES}")
def strip_order(spark, sf_dir):
    """Places of lanes when strips of four rows are walked column by column."""
    place = S.strip_place(F.col("lane") % 8, F.floor(F.col("lane") / 8), 8, 4)
    return lanes(spark, sf_dir).select("vec_id", "lane", place.cast("long").alias("place"))


@query("contrast", f"SELECT vec_id, CAST(lane AS INTEGER) AS lane, round(1 / (1 + exp(-10 * (CAST(v AS DOUBLE) - 0.5))), 9) AS v FROM {LANES}")
def contrast(spark, sf_dir):
    """Values through a logistic curve."""
    return lanes(spark, sf_dir).select("vec_id", "lane", F.round(S.logistic(F.col("v").cast("double")), 9).alias("v"))


@query("tile_lerp", "SELECT vec_id, round(avg(CAST(a AS DOUBLE) + (CAST(b AS DOUBLE) - CAST(a AS DOUBLE)) * 0.25), 6) AS v FROM (SELECT vec_id, unnest(embedding[1:63]) AS a, unnest(embedding[2:64]) AS b FROM embeddings) GROUP BY vec_id")
def tile_lerp(spark, sf_dir):
    """Mean of each tile sampled a quarter of the way between lanes."""
    two = F.arrays_zip(F.slice("embedding", 1, 63).alias("a"), F.slice("embedding", 2, 63).alias("b"))
    p = tiles(spark, sf_dir).select("vec_id", F.explode(two).alias("p"))
    return p.groupBy("vec_id").agg(F.round(F.avg(S.lerp(F.col("p.a").cast("double"), F.col("p.b").cast("double"), F.lit(0.25))), 6).alias("v"))
