"""Registered queries against their SQL, empty tables, mined rules against all combinations, and the pipeline's stages."""

import itertools
import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from strandline.llm import common, packing, quality, queries, secrets, url_rules, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, want.fetchall()))


def test_empty_tables_give_empty_tables(spark, documents, labels, tmp_path):
    none = documents.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judge(pages, spark.createDataFrame([], "url string, bad boolean"), queries.HOST_RULES).count() == 0
    assert warc.read(warc.write(pages, warc.default_folder(spark))).count() == 0
    assert secrets.redact_documents(none, secrets.model_from(none, labels)).count() == 0
    none.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_archive_has_a_dictionary(tmp_path):
    records = [warc.Record(k, "http://h/", b"\0" * 20, n, bytes([k]) * n) for k, n in enumerate([0, 10, 300_000])]
    for many in (1, 2, 3):
        path = str(tmp_path / f"{many}.warc.zst")
        warc.write_archive(path, [r.to_bytes() for r in records[:many]])
        head = open(path, "rb").read(8)
        assert int.from_bytes(head[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(head[4:], "little") > 8
        assert list(warc.read_archive(path, chunk=777)) == records[:many]


@pytest.mark.parametrize("rows_of_index", [0, 100_000])
def test_mined_rules_are_those_of_all_combinations(spark, monkeypatch, rows_of_index):
    monkeypatch.setattr(url_rules, "INDEX_ROWS", rows_of_index)
    rng = random.Random(12)
    rows = []
    for _ in range(500):
        tokens = sorted(rng.sample("abcdef", rng.randint(0, 4)))
        bad = rng.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.7 if "c" in tokens else 0.15)
        rows.append((tokens, bad))
    labelled = spark.createDataFrame([*rows, (["a"], None), (None, True)], "tokens array<string>, bad boolean")
    known = [(frozenset(t), b) for t, b in rows] + [(frozenset(), True)]
    total, base = len(known), sum(b for _, b in known) / len(known)
    n, bad = Counter(), Counter()
    for t, b in known:
        for size in range(1, len(t) + 1):
            for part in itertools.combinations(sorted(t), size):
                n[part] += 1
                bad[part] += b
    least = 20
    sure = {r: bad[r] / n[r] for r in n if bad[r] >= least and bad[r] / n[r] >= 0.6 and bad[r] / n[r] / base >= 1.5}
    want = {r for r in sure if not any(p != r and set(p) < set(r) and sure[p] >= sure[r] for p in sure)}
    rules = common.written(url_rules.mine(labelled, min_rows=least), "rules")
    got = {tuple(r.rule): r.confidence for r in rules.collect()}
    assert set(got) == want and want and all(got[r] == pytest.approx(sure[r]) for r in want)
    sets = [(k, sorted(rng.sample("abcdefg", rng.randint(0, 6)))) for k in range(200)]
    hits = {r.k: (r.confidence, tuple(r.mined_rule)) for r in url_rules.matched(spark.createDataFrame(sets, "k long, tokens array<string>"), "k", rules).collect()}
    assert hits == {k: max((got[r], r) for r in want if set(r) <= set(t)) for k, t in sets if any(set(r) <= set(t) for r in want)}


def test_quality_and_packing_stages(spark, documents, labels, tmp_path):
    from tokenizers import Tokenizer

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    field = quality.train(documents, labels)
    scores = {}
    for r, s in zip(documents.coalesce(1).collect(), quality.score_documents(documents.coalesce(1), field).collect()):
        assert r.doc_id == s.doc_id
        scores[r.doc_id, r.text] = s.score
    kept = Counter((r.doc_id, r.text) for r in stages["quality"](spark, documents, str(tmp_path)).collect())
    assert kept == Counter((r.doc_id, r.text) for r in documents.collect() if scores[r.doc_id, r.text] >= quality.THRESHOLD)
    t = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in documents.collect())
    pieces = stages["packing"](spark, documents, str(tmp_path)).collect()
    got, places = Counter(), {}
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.LENGTH


def test_rows_without_id_or_of_one_id_are_linked(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = text.replace("twenty", "twentyone")
    rows = [(None, text, 1), (None, near, 2), (7, "alone in the world of words here", 3), (7, text + " and", 4), (9, "x", 5), (None, None, 6), (None, "", 7), (9, "x", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    from strandline.llm import near_dedup

    got = {r.row for r in near_dedup.keep_first(df, near_dedup.Rule(3, 80)).collect()}
    assert got - {5, 8} == {3, 4, 6, 7} and len(got & {5, 8}) == 1
    nulls = spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string, row long")
    assert len({1, 2} & {r.row for r in near_dedup.keep_first(nulls, near_dedup.Rule(3, 80)).collect()}) == 1


def test_many_partitions_in_few_tasks(spark, documents):
    """Written tables have fewer files than there are partitions here; partitions keep apart."""
    path = common.vocabulary("byte_bpe_50k.json")
    spread = documents.select("doc_id", "text").repartition(40)
    pieces = packing.pack(spread, path, length=256, open_windows=2).collect()
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('<p>', id, '</p>') AS html").repartition(40)
    got = warc.read(warc.write(pages, warc.default_folder(spark))).collect()
    assert sorted(r.page_id for r in got) == list(range(300))
    from strandline.llm import sharding

    slots = {}
    for r in sharding.shard_documents(spread, 5).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
