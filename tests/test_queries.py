"""Every query with SQL against DuckDB on the smallest tables, and invariants of those without."""

import datetime as dt
import math
from pathlib import Path

import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v.isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    other = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())
    assert rows == other and rows


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.endswith("_roundtrip")])
def test_round_trips(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(r.same for r in rows)


def test_runs_are_conserved(spark):
    q = registry.QUERIES
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    runs = q["rle_runs"](spark, SF).collect()
    assert sum(r.run_len for r in runs) == rows
    assert sum(r.n for r in q["transitions"](spark, SF).collect()) + len({r.cell for r in runs}) == len(runs)
    assert sum(r.seen for r in q["run_hazard"](spark, SF).where("k = 0").collect()) == len(runs)
    # streaming keeps each user's last run in its state
    assert q["streaming_runs"](spark, SF).count() == len(runs) - len({r.cell for r in runs})


def test_streamed_runs_do_not_depend_on_files(spark, tmp_path):
    import os
    import random
    from itertools import groupby

    import pyarrow.parquet as pq

    whole = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    (tmp_path / "events.parquet").mkdir()
    size, order = -(-whole.num_rows // 20), random.Random(5).sample(range(20), 20)
    for k, at in enumerate(order):
        path = tmp_path / "events.parquet" / f"part-{k:02}.parquet"
        pq.write_table(whole.slice(at * size, size), path)
        os.utime(path, (1_700_000_000 + k * 60,) * 2)
    want = []
    rows = sorted((r["user_id"], r["ts"], r["event_id"], r["event_type"]) for r in whole.to_pylist())
    for user, mine in groupby(rows, lambda r: r[0]):
        runs = [list(g) for _, g in groupby(mine, lambda r: r[3])]
        want += [(user, g[0][3], g[0][1].replace(tzinfo=None), len(g)) for g in runs[:-1]]
    got = registry.QUERIES["streaming_runs"](spark, str(tmp_path)).selectExpr("cell", "symbol", "cast(start_ts as timestamp_ntz) start_ts", "run_len").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_huffman_is_within_its_bounds(spark):
    r = registry.QUERIES["huffman_size"](spark, SF).first()
    assert r.entropy <= r.bits < r.entropy + r.n
    one, two, three = (x.bits for x in registry.QUERIES["note_huffman"](spark, SF).orderBy("tables").collect())
    assert one > 0 and two > 0 and three > 0


def test_other_queries_give_rows(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        if not name.endswith("_roundtrip"):
            assert registry.QUERIES[name](spark, SF).count() > 0, name


def test_greedy_pruning_keeps_what_is_far_apart(spark):
    from strandline.plans.tiles import coarse

    c = {r.id: (r.mask, r.n) for r in coarse(spark, SF).collect()}
    kept = {r.id for r in registry.QUERIES["hamming_prune_greedy"](spark, SF).collect()}
    want = []
    for i in sorted(c, key=lambda k: (-c[k][1], k)):
        if all(sum(a != b for a, b in zip(c[i][0], c[k][0])) >= 3 for k in want):
            want.append(i)
    assert kept == set(want)


def test_moving_pruning_of_many_masks(spark, tmp_path):
    """More masks than can stay by their rank, where all pairs are near by the last cutoff; stopped if it takes a minute."""
    import threading

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    x = rng.choice((-0.5, 0.5), (8000, 64))
    x[7000:] = x[rng.integers(0, 50, 1000)] * np.where(rng.random((1000, 64)) < 0.01, -1, 1)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)))}), tmp_path / "embeddings.parquet")
    bits = [int("".join("01"[int(v > 0)] for v in t), 2) for t in x]
    n, first = {}, {}
    for k, b in enumerate(bits):
        n[b] = n.get(b, 0) + 1
        first.setdefault(b, k)
    kept = []
    for k, b in enumerate(sorted(n, key=lambda b: (-n[b], first[b])), 1):
        if all((b ^ o).bit_count() >= 2 + k // 100 for o in kept):
            kept.append(b)
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = registry.QUERIES["hamming_prune_moving"](spark, str(tmp_path)).collect()
    finally:
        late.cancel()
    assert len(n) > 6300 and sorted((r.id, r.n) for r in got) == sorted((first[b], n[b]) for b in kept)


@pytest.mark.parametrize("tiles", ["SELECT * FROM embeddings", "SELECT vec_id, CASE WHEN vec_id % 9 > 0 THEN embedding END AS embedding FROM embeddings", "SELECT vec_id, CASE WHEN vec_id < 499 THEN embedding END AS embedding FROM embeddings", "SELECT * FROM embeddings WHERE false"])
@pytest.mark.parametrize("least, every", [(2, 100), (40, 3), (70, 1)])
def test_moving_pruning_with_null_tiles(spark, duck, tmp_path, tiles, least, every):
    """Against the SQL, with cutoffs below, up to and over the lanes of a tile; a null tile has a place, and nothing is near it."""
    from strandline.operators import quantize
    from strandline.plans.tiles import coarse

    duck.execute(f"COPY ({tiles}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    sql = registry.SQL["hamming_prune_moving"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'").replace("2 + o.k // 100", f"{least} + o.k // {every}")
    got = quantize.greedy_pruned_moving(coarse(spark, str(tmp_path)), 64, least, every).collect()
    assert sorted((r.id, r.n) for r in got) == sorted(duck.execute(sql).fetchall())


def test_tiles_are_compared_in_all_lanes(spark, tmp_path):
    """Tiles that agree in the first quarter: a copy, near ones and far ones, against brute force."""
    import random

    rng = random.Random(7)
    base = [rng.choice((-0.5, 0.5)) for _ in range(64)]
    flip = lambda *at: [-v if i in at else v for i, v in enumerate(base)]
    t = [base, flip(*range(16, 64)), flip(20, 40), base, flip(20, 40, 63), flip(30, 31, 32), [-v for v in base], flip(*range(32, 48)), flip(*range(33, 48))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(t)], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    bits = ["".join("01"[v > 0] for v in v) for v in t]
    ids = {m: bits.index(m) for m in bits}
    n = {i: bits.count(m) for m, i in ids.items()}
    far = lambda a, b: sum(x != y for x, y in zip(bits[a], bits[b]))

    def walked(order, cutoff):
        kept = {}
        for i in order:
            kept[i] = next((k for k in kept if kept[k] == k and far(i, k) < cutoff), i)
        return kept

    by_n = sorted(n, key=lambda i: (-n[i], i))
    assert {r.id for r in run("hamming_prune_greedy")} == {i for i, k in walked(by_n, 3).items() if i == k}
    assert {r.id: r.kept for r in run("first_match_reuse")} == walked(sorted(n), 4)
    assert {r.id for r in run("hamming_prune_whole")} == {i for i in n if not any(far(i, k) < 3 and by_n.index(k) < by_n.index(i) for k in n)}
    assert {(r.mask, r.n, r.first_id) for r in run("tile_dedup_whole")} == {(m, n[i], i) for m, i in ids.items()}
    folded = [min(m, m.translate({48: 49, 49: 48})) for m in bits]
    assert {(r.mask, r.n, r.first_id) for r in run("tile_dedup_complement_whole")} == {(m, folded.count(m), folded.index(m)) for m in folded}
    assert {r.vec_id for r in run("vq_exact_else_nearest_whole") if r.exact} == {k for k, m in enumerate(bits) if m in bits[:4]}


def test_huffman_codes_cover_all_documents(spark, duck):
    got = {r.value: r.freq for r in registry.QUERIES["huffman_codes"](spark, SF).collect()}
    assert got == dict(duck.execute(registry.SQL["char_counts"].replace("benchmark", "documents")).fetchall())


def test_pivot_has_all_symbols(spark, tmp_path):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "refund").otherwise(F.col("event_type"))).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {(r.from_sym, r.to_sym): r.n for r in registry.QUERIES["transitions"](spark, str(tmp_path)).collect()}
    got = [r.asDict() for r in registry.QUERIES["transition_pivot"](spark, str(tmp_path)).collect()]
    assert {(c, r["to_sym"]): n for r in got for c, n in r.items() if c != "to_sym" and n} == want and any("refund" in k for k in want)


def test_skips_do_not_overlap(spark):
    k = {(r.cell, r.run): r for r in registry.QUERIES["skip_candidates"](spark, SF).collect()}
    taken = [k[r.cell, r.run] for r in registry.QUERIES["skips_applied"](spark, SF).collect()]
    for cell in {r.cell for r in taken}:
        spans = sorted((r.prev_change, r.next_change) for r in taken if r.cell == cell)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_skips_stop_at_the_target(spark):
    rows = sorted(registry.QUERIES["skips_until_size"](spark, SF).collect(), key=lambda r: r.applied)
    (stop,) = [r for r in rows if r.stop]
    target = 0.9 * rows[0].bits
    assert rows[0].applied == 0 and stop.bits < target and stop.applied % 10 == 0
    before = [r for r in rows if r.applied == stop.applied - 10]
    assert before and before[0].bits >= target


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
