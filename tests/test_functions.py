"""Golden vectors and round trips of the codecs and sources."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import gif, lz, rangecoder, scalars
from strandline.functions import huffman as H
from strandline.operators.stats import lopped_size
from strandline.sources import frames, midi

#: Twenty counts, one of them 0, from a rule.
COUNTS = {k: (k * k * 17 + 5 * k) % 301 * (k != 11) for k in range(1, 21)}


def encoded(bits):
    e = rangecoder.Encoder()
    for b, p in bits:
        e.bit(b, p)
    return e.finish()


def test_huffman_vector():
    nodes, used = H.tree(COUNTS), {k for k, n in COUNTS.items() if n}
    heap, least = sorted(n for n in COUNTS.values() if n), 0
    while len(heap) > 1:  # merging the two least weights is optimal
        least += (two := heap[0] + heap[1])
        heap = sorted([*heap[2:], two])
    table = H.codes(nodes)
    assert set(table) == used and len(nodes) == 2 * len(used) - 1 and H.total_bits(COUNTS) == least == sum(len(c) * COUNTS[k] for k, c in table.items())
    assert all(a == b or not table[a].startswith(table[b]) for a in table for b in table)
    assert H.total_bits({5: 7}) == 0 and H.decode("", H.tree({5: 7}), 3) == [5, 5, 5] and H.tree({}) == []
    for form, bits, leaf in ((H.serialized, 12, 0x800), (H.serialized_bytes, 8, 0x80)):
        inner, order = form(nodes, sorted(COUNTS)), sorted(COUNTS)
        assert len(inner) == len(used) - 1
        for k, code in table.items():  # following a code through the numbers leads to its symbol
            at = 0
            for n, c in enumerate(code):
                half = inner[at] >> (bits if c == "1" else 0) & ((1 << bits) - 1)
                if half & leaf:
                    assert n == len(code) - 1 and order[half & (leaf - 1)] == k
                else:
                    at += half


def test_range_coder_vectors():
    assert encoded([(1, 128), (0, 128), (1, 200), (0, 200)]).hex() == "5900"
    assert encoded([(int(7 * i % 3 == 0), 170) for i in range(64)]).hex() == "63a9a89edd27004c00"


def test_range_coder_round_trip():
    rng = random.Random(4)
    bits = [(rng.randint(0, 1), rng.choice([0, 255, rng.randint(0, 255)])) for _ in range(20000)]
    d = rangecoder.Decoder(encoded(bits))
    assert all(d.bit(p) == b for b, p in bits)


def test_lz_round_trips():
    rng = random.Random(5)
    for _ in range(60):
        seq = [rng.choice([1, 2, 3, 9]) for _ in range(rng.randint(0, 200))]
        data, p = lz.encode(seq)
        assert lz.decode(data, p, len(seq)) == seq
        bits = lz.reverse_encode([f"{v:04b}" for v in seq])
        assert lz.reverse_decode(bits, len(seq), lambda s, a: (s[a : a + 4], a + 4)) == [f"{v:04b}" for v in seq]
    assert lz.parse([1, 2, 3, 1, 2, 3, 4]) == [(1,), (2,), (3,), (3, 3), (4,)]


def test_tree_sizes():
    assert {n: lopped_size(n) for n in (2, 3, 5, 6, 33, 100, 192, 256)} == {2: 1, 3: 3, 5: 6, 6: 6, 33: 37, 100: 102, 192: 192, 256: 255}


def test_scalars(spark):
    n = spark.range(9).select("id", scalars.golomb(F.col("id")).alias("c"), scalars.bit_length(F.col("id")).alias("b"), scalars.reversed_bits(F.col("id"), 4).alias("r")).orderBy("id").collect()
    assert [r.c for r in n] == "1 010 011 00100 00101 00110 00111 0001000 0001001".split()
    assert [r.b for r in n] == [0, 0, 1, 2, 2, 3, 3, 3, 3]
    assert [r.r for r in n] == [int(f"{i:04b}"[::-1], 2) for i in range(9)]


def test_midi_round_trip(spark, tmp_path):
    notes = [(0, 240, 60, 90), (120, 360, 64, 80), (360, 4000, 60, 70), (400, 500, 0, 1)]
    (tmp_path / "a.mid").write_bytes(midi.written(notes))
    got = midi.notes(midi.events(spark, str(tmp_path / "*.mid")))
    assert sorted((r.on, r.off, r.note, r.velocity) for r in got.collect()) == sorted(notes)
    assert got.where("disabled").count() == 1
    assert [(r.note, r.len, r.run) for r in midi.quantized(got).orderBy("place").collect()] == [(60, 2, 1), (64, 2, 2), (60, 30, 0)]


def test_frames(spark, tmp_path):
    raw = bytes(range(24))
    (tmp_path / "raw.dat").write_bytes(raw + b"xx")
    (tmp_path / "head.dat").write_bytes(b"4 3\n" + raw)
    got = frames.frames(spark, str(tmp_path / "raw.dat"), 4, 3)
    assert [bytes(r.data) for r in got.orderBy("frame").collect()] == [raw[:12], raw[12:]]
    head = frames.headed_frames(spark, str(tmp_path / "head.dat")).orderBy("frame").collect()
    assert [(bytes(r.data), r.width, r.height) for r in head] == [(raw[:12], 4, 3), (raw[12:], 4, 3)]
    p = frames.pixels(got, 4).where("frame = 1").orderBy("y", "x").collect()
    assert [r.lum for r in p] == list(raw[12:]) and (p[5].x, p[5].y) == (1, 1)
    (tmp_path / "w.dat").write_bytes(np.array([1, 0x2805, 0xFFFFFFFF], "<u4").tobytes())
    assert [r.value for r in frames.words(spark, str(tmp_path / "w.dat"), 3).orderBy("place").collect()] == [1, 0x2805, 0xFFFFFFFF]
    s = frames.symbols(spark, str(tmp_path / "w.dat"), 2).orderBy("frame", "cell").collect()
    assert (s[1].id, s[1].invert, s[1].flip_x, s[1].flip_y) == (5, True, True, False)


def test_skips_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 4, 5, 6, None, 0.5)], frames.SKIP_SCHEMA)
    frames.write_skips(rows, str(tmp_path / "skips"))
    assert frames.skips(spark, str(tmp_path / "skips")).collect() == rows.collect()


def test_gif():
    a = np.zeros((6, 8), int)
    b = a.copy()
    b[2:4, 3:5] = 1
    assert gif.changed_box(a, b) == (3, 2, 2, 2) and gif.changed_box(a, a) == (0, 0, 1, 1)
    data = gif.animation([a, b, b], [(0, 0, 0), (255, 255, 255)])
    assert data.startswith(b"GIF89a") and data.endswith(b"\x3b") and data.count(b"\x21\xf9\x04") == 3
    assert gif.packed(bytes([0, 0, 0, 1, 1, 0]), 1)[:1] == b"\x02"
