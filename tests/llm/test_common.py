"""Joins with hot groups, written tables, and words found in bytes."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import common, words


def test_hot_groups_meet_all_their_rows(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 700).cast("long").alias("k"))
    groups = common.written(rows.where("k < 600").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")), "groups")
    left = common.join_groups(rows, groups, ["k"], "n")
    assert left.count() == 6000 and left.where("k < 600 and least is null").count() == 0 and left.where("k >= 600 and least is not null").count() == 0
    inner = common.join_groups(rows, groups, ["k"], "n", how="inner")
    assert inner.count() == rows.where("k < 600").count() and inner.where("k = 0").agg(F.max("least")).first()[0] == 0
    none = common.join_groups(rows, groups.limit(0), ["k"], "n")
    assert none.count() == 6000 and none.where("n is not null").count() == 0


def test_words_and_their_hashes():
    texts = ["One two\tTWO", "", None, "two", " lead", "é\x0bÉ two\n", "x" * 9000, "a b" * 50, "two"]
    found = []
    for size in (16, 1 << 20):
        got = {}
        for t in words.chunks(pa.array(texts), size):
            start, end, hashed = words.words(t)
            for a, b, h, d in zip(start, end, hashed, t.doc_of(start)):
                got.setdefault(t.first + int(d), []).append((t.data[a:b].tobytes().decode(), int(h)))
        low = lambda s: s.translate({i: i + 32 for i in range(65, 91)})
        assert {k: [w for w, _ in v] for k, v in got.items()} == {k: w for k, t in enumerate(texts) if (w := re.findall(r"[^\x20\x09-\x0D]+", t or ""))}
        known = {}
        for v in got.values():
            for w, h in v:
                assert known.setdefault(low(w), h) == h
        assert len(set(known.values())) == len(known)
        found.append(got)
    assert found[0] == found[1]


def test_shingles_of_short_and_repeating_texts():
    (t,) = words.chunks(pa.array(["", "a", "A", "a b", "b a", "a b c", "a a a a a", "a b c d"]))
    s = words.shingles(t, 3)
    assert [len(x) for x in s] == [0, 1, 1, 1, 1, 1, 1, 2]
    assert s[1] == s[2] and s[3] != s[4] and s[5][0] in s[7] and np.all(s[7][1:] > s[7][:-1])


def test_slices_of_arrays():
    column = pa.array(["zero", None, "one two", "three"]).slice(1)
    (t,) = words.chunks(column)
    assert [t.data[a:b].tobytes() for a, b in zip(t.offsets[:-1], t.offsets[1:])] == [b"", b"one two", b"three"]
