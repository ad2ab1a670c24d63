"""Operators that need no table of the fixtures: files in ranges, pictures, places, streams in partitions, weighted codes."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import groups, quantize, sequence
from strandline.sources import binary, shared


def test_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE_BYTES", 40)
    data = bytes(range(256)) * 3
    (tmp_path / "a.dat").write_bytes(b"head" + data + b"rest")
    (tmp_path / "b.dat").write_bytes(b"head")
    got = binary.records(spark, str(tmp_path), 16, header=4).collect()
    assert {(r.path.rpartition("/")[2], r.record): bytes(r.data) for r in got} == {("a.dat", k): data[16 * k : 16 * k + 16] for k in range(48)}


def test_counted_records(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(struct.pack("<I", 2) + b"abcdefgh")
    assert {r.record: bytes(r.data) for r in binary.counted_records(spark, str(tmp_path / "a.dat"), 4).collect()} == {0: b"abcd", 1: b"efgh"}
    (tmp_path / "b.dat").write_bytes(struct.pack("<I", 3) + b"abcdefgh")
    with pytest.raises(Exception, match="holds 12 bytes"):
        binary.counted_records(spark, str(tmp_path / "b.dat"), 4).collect()


def test_pictures_with_any_line_filter():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (10, 13), dtype=np.uint8)
    assert (binary.image_of(binary.png_of(image)) == image).all()
    wide = np.zeros((11, 14), np.int64)
    wide[1:, 1:] = image
    lines = []
    for y in range(10):
        kind, a, b, c = y % 5, wide[y + 1, :-1], wide[y, 1:], wide[y, :-1]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = (0 * a, a, b, (a + b) // 2, near)[kind]
        lines.append(bytes([kind]) + ((wide[y + 1, 1:] - guess) % 256).astype(np.uint8).tobytes())
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = binary.PNG + part(b"IHDR", struct.pack(">IIBBBBB", 13, 10, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (binary.image_of(png) == image).all()


def test_places_in_large_and_small_groups(spark):
    rows = [(k % 3 if k < 900 else 0, (k * 7919) % 10007) for k in range(3000)]
    got = sequence.placed(spark.createDataFrame(rows, "g long, v long").repartition(3), ["g"], ["v"]).collect()
    want = {}
    for g in (0, 1, 2):
        for n, v in enumerate(sorted(v for h, v in rows if h == g)):
            want[g, v] = n
    assert {(r.g, r.v): r.place for r in got} == want


def test_streams_are_whole_and_in_order(spark):
    rows = [(None if k % 7 == 0 else k % 5, k, f"v{k}") for k in range(25_000)]
    df = spark.createDataFrame(rows, "cell long, pos long, v string").orderBy(F.rand(2))
    got = sequence.each_stream(df, "cell", ["pos"], ["pos", "v"], lambda cell, pos, v: [(cell, len(pos), pos == sorted(pos), v[0])], "cell long, n long, sorted boolean, first string").collect()
    first = {}
    for cell, _, v in rows:
        first.setdefault(cell, []).append(v)
    assert {r.cell: (r.n, r.sorted, r.first) for r in got} == {c: (len(v), True, v[0]) for c, v in first.items()} and len(got) == len(first)
    assert sequence.each_stream(df.limit(0), "cell", ["pos"], ["v"], lambda cell, v: [(cell,)], "cell long").count() == 0


def test_weighted_codes_are_means_of_their_tiles(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(200, 4)), rng.integers(1, 9, 200)
    df = spark.createDataFrame([(k, [float(v) for v in row], int(n)) for k, (row, n) in enumerate(zip(x, w))], "vec_id long, embedding array<double>, w long").repartition(3)
    codes = (np.array([5, 8, 9]), x[[5, 8, 9]].copy())
    best = ((x[:, None] - codes[1][None]) ** 2).sum(2).argmin(1)
    for r in quantize.sums(df, codes, "w").collect():
        own = best == list(codes[0]).index(r.code)
        assert r.n == own.sum() and r.w == w[own].sum() and np.allclose(r.total, (x[own] * w[own, None]).sum(0))
    ids, table = quantize.kmeans(df, 12, 5, 6, weight="w")
    assert len(ids) == 5 and table.shape == (5, 4)


def test_few_rows_among_many(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))
    wanted = shared.written(spark.createDataFrame([(3,), (4,), (None,), (9999,)], "doc_id long"), "wanted")
    may, cannot = groups.divided(rows, "doc_id", wanted)
    assert may.columns == rows.columns and may.count() + cannot.count() == 5000 and may.count() < 400
    assert {3, 4, None} <= {r.doc_id for r in may.collect()} and not {3, 4, None} & {r.doc_id for r in cannot.collect()}
    gone = shared.written(spark.createDataFrame([(3, "t3", False), (4, "nothing", False), (None, "t0", True)], "doc_id long, mark string, once boolean"), "gone")
    left = groups.without(rows, gone, F.col("text")).collect()
    nulls = [r.text for r in left if r.doc_id is None]
    assert 3 not in {r.doc_id for r in left} and 4 in {r.doc_id for r in left} and nulls.count("t0") == 1
    before = [r.text for r in rows.where("doc_id is null").collect()]
    assert len(left) == 5000 - 1 - (before.count("t0") - 1)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_scratch_tables_go(spark):
    import os

    with shared.scratch(spark) as kept:
        a, b = shared.written(spark.range(5), "a"), shared.written(spark.range(6), "b")
        kept.append(b)
    assert not os.path.exists(a._strandline_path) and b.count() == 6
