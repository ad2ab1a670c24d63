"""Variants of the stream and tile queries: other orders, classes, blends and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantize as V
from ..operators import stats as A
from .codecs import characters
from .registry import SQL, query
from .streams import RUNS, events, runs, transitions
from .tiles import BLEND, LANES, LANES_OF_A_TILE, LEVELS, coarse, codes, lanes, levels, tiles


@query("first_match_reuse")
def first_match_reuse(spark, sf_dir):
    """Each mask of all lanes as the first mask kept before it that differs in fewer than four places."""
    return V.first_match(coarse(spark, sf_dir), [F.asc("id")], LANES_OF_A_TILE, 4)


@query("spherical_classes")
def spherical_classes(spark, sf_dir):
    """Source symbols in classes by the direction of their transition rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    t = transitions(spark, sf_dir)
    names = sorted(r.to_sym for r in t.select("to_sym").distinct().collect())
    wide = t.groupBy("from_sym").pivot("to_sym", names).agg(F.sum("n")).na.fill(0)
    rows = VectorAssembler(inputCols=names, outputCol="row").transform(wide)
    model = KMeans(k=3, featuresCol="row", distanceMeasure="cosine", seed=1).fit(rows)
    return model.transform(rows).select("from_sym", F.col("prediction").alias("class"))


def _soft(c: str, l: str, r: str) -> str:  # noqa: E741
    """The blend of three levels that are no whole numbers, by weights of the eight corners; SQL of both engines."""
    terms = []
    for k in range(8):
        at, weight = [], []
        for bit, v in zip((k >> 2 & 1, k >> 1 & 1, k & 1), (c, l, r)):
            low = f"least(1, CAST(floor({v}) AS INTEGER))"
            at.append(f"({low} + {bit})")
            weight.append(f"({v} - {low})" if bit else f"(1 - ({v} - {low}))")
        terms.append(f"CAST(substr('{BLEND}', {at[0]} * 9 + {at[1]} * 3 + {at[2]} + 1, 1) AS DOUBLE) * {' * '.join(weight)}")
    return " + ".join(terms)


SOFT = "SELECT vec_id, lane, greatest(0.0, least(2.0, (CAST(v AS DOUBLE) + 0.5) * 2)) AS c FROM {source}"


@query("edge_blend_soft", f"""WITH s AS ({SOFT.format(source=LANES)}), n AS (SELECT vec_id, lane, c, coalesce(lag(c) OVER w, c) AS l, coalesce(lead(c) OVER w, c) AS r FROM s WINDOW w AS (PARTITION BY vec_id, lane // 8 ORDER BY lane))
    SELECT vec_id, CAST(lane AS INTEGER) AS lane, round({_soft("c", "l", "r")}, 6) AS v FROM n""")
def edge_blend_soft(spark, sf_dir):
    """The blend across for levels between 0 and 2, interpolated between the table's entries."""
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id", F.floor(F.col("lane") / 8)).orderBy("lane")
    s = lanes(spark, sf_dir).withColumn("c", F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("v").cast("double") + 0.5) * 2)))
    s = s.select("vec_id", "lane", "c", F.coalesce(F.lag("c").over(w), "c").alias("l"), F.coalesce(F.lead("c").over(w), "c").alias("r"))
    return s.select("vec_id", "lane", F.round(F.expr(_soft("c", "l", "r")), 6).alias("v"))


@query("signed_codes", """WITH d AS (SELECT DISTINCT CAST(round(value) AS BIGINT) - 50 AS v FROM events WHERE value IS NOT NULL), u AS (SELECT v, abs(v) * 2 + CASE WHEN v < 0 THEN 1 ELSE 0 END + 1 AS k FROM d)
    SELECT v, concat(repeat('0', CAST(length(bin(k)) - 1 AS INTEGER)), bin(k)) AS code FROM u""")
def signed_codes(spark, sf_dir):
    """Exponential Golomb codes of signed differences."""
    v = events(spark, sf_dir).where("value is not null").select((F.round("value").cast("long") - 50).alias("v")).distinct()
    return v.select("v", S.signed_golomb(F.col("v")).alias("code"))


def reversed_low_bits(chars):
    return chars.groupBy(S.reversed_bits(F.ascii("symbol").bitwiseAND(127), 7).alias("symbol")).agg(F.count("*").alias("n"))


@query("reversed_bit_tree", """WITH n AS (SELECT CAST(ord(c) & 127 AS BIGINT) AS s, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY 1),
    r AS (SELECT ((s & 1) << 6) | ((s & 2) << 4) | ((s & 4) << 2) | (s & 8) | ((s & 16) >> 2) | ((s & 32) >> 4) | ((s & 64) >> 6) AS symbol, n FROM n),
    l AS (SELECT symbol, n, CAST(unnest(range(0, 7)) AS INTEGER) AS level FROM r),
    t AS (SELECT level, symbol >> (7 - level) AS prefix, sum(CASE WHEN (symbol >> (6 - level)) & 1 = 0 THEN n ELSE 0 END) AS zero, sum(n) AS total FROM l GROUP BY 1, 2)
    SELECT level, prefix, CAST(zero AS BIGINT) AS zero, CAST(total AS BIGINT) AS total, CAST(greatest(0, least(255, floor(zero / total * 257))) AS BIGINT) AS prob FROM t""")
def reversed_bit_tree(spark, sf_dir):
    """The bit tree of characters whose bits are reversed."""
    return A.bit_tree(reversed_low_bits(characters(spark, sf_dir, "benchmark")), 7)


@query("reversed_bit_tree_documents", SQL["reversed_bit_tree"].replace("benchmark", "documents"))
def reversed_bit_tree_documents(spark, sf_dir):
    """The same for the documents' characters."""
    return A.bit_tree(reversed_low_bits(characters(spark, sf_dir, "documents")), 7)


@query("frame_penalty", f"""SELECT a.vec_id, round(sum(abs(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE))), 6) AS penalty FROM {LANES} a JOIN {LANES} b ON b.vec_id = a.vec_id - 1 AND a.lane = b.lane GROUP BY a.vec_id""")
def frame_penalty(spark, sf_dir):
    """How much each tile differs from the one before it."""
    t = tiles(spark, sf_dir).select("vec_id", "embedding")
    before = t.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("was"))
    return t.join(before, "vec_id").select("vec_id", F.round(S.city_distance(F.col("embedding"), F.col("was")), 6).alias("penalty"))


@query("level_counts_by_label", f"SELECT label, level, count(*) AS n FROM {LEVELS} JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label, level")
def level_counts_by_label(spark, sf_dir):
    """How often each level occurs in the tiles of each label."""
    labels = tiles(spark, sf_dir).select("vec_id", F.col("label").cast("int").alias("label"))
    return levels(spark, sf_dir).join(labels, "vec_id").groupBy("label", "level").agg(F.count("*").alias("n")).withColumn("label", F.col("label").cast(tiles(spark, sf_dir).schema["label"].dataType))


@query("gray_average", "SELECT vec_id, CAST(floor((floor((CAST(embedding[1] AS DOUBLE) + 1) * 100) + floor((CAST(embedding[2] AS DOUBLE) + 1) * 100) + floor((CAST(embedding[3] AS DOUBLE) + 1) * 100)) / 3) AS BIGINT) AS gray FROM embeddings")
def gray_average(spark, sf_dir):
    """Three channels as one, by their whole average."""
    channel = [F.floor((F.col("embedding")[k].cast("double") + 1) * 100) for k in range(3)]
    return tiles(spark, sf_dir).select("vec_id", F.floor((channel[0] + channel[1] + channel[2]) / 3).alias("gray"))


@query("alive_codes", """SELECT DISTINCT symbol FROM (SELECT event_type AS symbol FROM events WHERE event_type IS NOT NULL EXCEPT SELECT event_type FROM events GROUP BY event_type HAVING count(*) * 8 < (SELECT count(*) FROM events))""")
def alive_codes(spark, sf_dir):
    """All symbols without those with less than an eighth of the events."""
    n = events(spark, sf_dir).where("event_type is not null").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    total = events(spark, sf_dir).agg(F.count("*").alias("total"))
    dead = n.join(F.broadcast(total)).where("n * 8 < total").select("symbol")
    return n.select("symbol").subtract(dead)


@query("literal_chance", f"""WITH {RUNS} SELECT symbol, CAST(greatest(0, least(255, floor(256.0 * count(*) FILTER (run_len = 1) / (count(*) + 1)))) AS BIGINT) AS chance FROM runs GROUP BY symbol""")
def literal_chance(spark, sf_dir):
    """Chance in 256ths that a run of each symbol is a single row."""
    r = runs(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("run_len") == 1).alias("one"), F.count("*").alias("n"))
    return r.select("symbol", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(256) * F.col("one") / (F.col("n") + 1)))).cast("long").alias("chance"))


@query("two_level_stop", f"""WITH {RUNS} SELECT symbol, round(count(*) FILTER (run_len = 1) * 1.0 / count(*), 9) AS first_stop,
    round(coalesce(count(*) FILTER (run_len > 1) * 1.0 / nullif(sum(run_len - 1) FILTER (run_len > 1), 0), 0), 9) AS later_stop FROM runs GROUP BY symbol""")
def two_level_stop(spark, sf_dir):
    """Chance that a run ends at its first row, and at each later one."""
    long = F.col("run_len") > 1
    r = runs(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(~long).alias("one"), F.count_if(long).alias("more"), F.sum(F.when(long, F.col("run_len") - 1).otherwise(0)).alias("rest"))
    later = F.coalesce(F.col("more") / F.nullif(F.col("rest"), F.lit(0)), F.lit(0.0))
    return r.select("symbol", F.round(F.col("one") / F.col("n"), 9).alias("first_stop"), F.round(later, 9).alias("later_stop"))


@query("coder_sizes")
def coder_sizes(spark, sf_dir):
    """Bits of the codes of all tiles: entropy, Huffman, and whole bits of a plain number."""
    from ..functions import huffman as H

    n = {r.code: r.n for r in V.nearest(tiles(spark, sf_dir), codes(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n")).collect()}
    total, wide = sum(n.values()), max(1, (len(n) - 1).bit_length())
    import math

    rows = [("entropy", round(sum(-math.log2(v / total) * v for v in n.values()), 3)), ("huffman", float(H.total_bits(n))), ("plain", float(wide * total))]
    return spark.createDataFrame(rows, "coder string, bits double")
