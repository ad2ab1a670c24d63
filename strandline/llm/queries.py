"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, exact_dedup, fingerprints, near_dedup, packing, quality, secrets, sharding, url_rules, warc
from .common import table, vocabulary


def op1_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and a digest of the fixed patterns' spans, and all spans.

    One row per row of documents; null and empty texts have no spans and the digest of an empty string. Rows that repeat
    are judged each; rows without doc_id too. No table, no rows; other columns are not read.
    """
    documents = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(documents, secrets.model_from(documents, table(spark, sf_dir, "labels")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written_spans(F.col("base")), 256).alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"),
    )


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 by the key law, and where they go when shard 40 is added.

    Null texts have a size of 16. Rows of one doc_id share a shard, as do all without one; slots of equal rows are dealt as
    they come. No table, no rows; other columns are not read.
    """
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40, 1.0)


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    Null and empty texts have no digests, an all-zero fingerprint and a likeness of 1 to one another. Rows of equal doc_id
    follow each other by their texts' hashes, rows without one come last; a single row is its own next one.
    """
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents.

    Null texts are empty ones. The least doc_id stays, nulls come last, and of rows that repeat both doc_id and text one is
    kept. No table, no rows; other columns are not read.
    """
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, by a field trained on labelled documents that are not held out.

    One row per row of documents; null and empty texts are one empty line and have a score like any other. Without labels
    every score is 0.5. A row without doc_id is scored and never learned from; repeated rows score alike.
    """
    documents = table(spark, sf_dir, "documents")
    scored = quality.score_documents(documents, quality.train(documents, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


#: Host rules of the page filter.
HOST_RULES = (
    url_rules.HostRule("block", "net"),
    url_rules.HostRule("allow", "example.net", "/en/"),
    url_rules.HostRule("block", "example.com", "/de/"),
    url_rules.HostRule("allow", "org", "/fr/"),
)


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by host rules, else by rules mined from the labels of the documents that pages were made from (the
    number in a page's path is the document's): a page is bad when its document has quality 0 or is toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    source = pages.select("url", number.try_cast("long").alias("doc_id"))
    return url_rules.judge(pages, source.join(bad, "doc_id").select("url", "bad"), HOST_RULES)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids.

    Null and empty texts are one id, the end's. Each row is a document of its own, whether or not it repeats another or has
    a doc_id; a text of any length is cut into as many windows as it fills. No table, no rows.
    """
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back.

    Null html is an empty payload. Of equal payloads the least page_id is the response, nulls last; a row that repeats its
    page_id and payload is that response once more. No table, no archive and no rows.
    """
    archives = warc.write(table(spark, sf_dir, "pages"), warc.default_folder(spark), least_bytes=0)
    return warc.read(archives).drop("payload", "url")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of three-word shingles at a similarity of 0.85.

    Null and empty texts, and those of white space, are linked with nothing. Rows of one doc_id and different texts are
    judged each; a component without any doc_id has none. No table, no rows; other columns are not read.
    """
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Rule(words=3, percent=85, bands=28, width=5))


def op10_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded.

    Null and empty texts have no ids and the digests of an empty string. Rows are coded each on its own, whether or not
    they repeat; texts and words may be of any length. No table, no rows.
    """
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))

def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_secret_spans that SQL can express: the fixed patterns' counts and digest."""
    return op1_secret_spans(spark, sf_dir).drop("spans")


def fingerprint_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_iblt_fingerprints that SQL can express: lengths, edited texts and likenesses."""
    return op6_iblt_fingerprints(spark, sf_dir).drop("fingerprint", "edited_fingerprint")


def url_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_url_verdicts that SQL can express: hosts, paths and the rule that fits."""
    return op4_url_verdicts(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_spans,
        op2_rendezvous_shards,
        op3_line_quality,
        op4_url_verdicts,
        op5_pack_sequences,
        op6_iblt_fingerprints,
        op7_exact_dedup,
        op8_warc_records,
        op9_near_duplicates,
        op10_bpe_digests,
        secret_base_spans,
        fingerprint_likeness,
        url_host_rules,
    )
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "secret_base_spans": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, 'assign' AS kind, 12 AS least, regexp_extract_all(t, '(?s)(.*?)(?:(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)|\z)', 1) AS g, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS w, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM d UNION ALL SELECT doc_id, 'access' AS kind, 18 AS least, regexp_extract_all(t, '(?s)(.*?)(?:AKIA[A-Z0-9]+|\z)', 1) AS g, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) AS w, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) AS v FROM d UNION ALL SELECT doc_id, 'hex' AS kind, 16 AS least, regexp_extract_all(t, '(?s)(.*?)(?:[0-9a-f]+|\z)', 1) AS g, regexp_extract_all(t, '[0-9a-f]+', 0) AS w, regexp_extract_all(t, '[0-9a-f]+', 0) AS v FROM d),
        p AS (SELECT doc_id, kind, least, w, v, unnest(range(1, len(w) + 1)) AS i, list_transform(g, lambda x: length(x)) AS gl, list_transform(w, lambda x: length(x)) AS wl FROM m),
        s AS (SELECT doc_id, kind, list_sum(gl[1:i]) + coalesce(list_sum(wl[1:i - 1]), 0) AS a, wl[i] AS n FROM p WHERE length(v[i]) >= least),
        o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN o USING (doc_id)
    """,
    "fingerprint_likeness": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nx FROM documents),
        e AS (SELECT *, length(t) AS n, substr(t, 1, length(t) - length(t) // 3) || substr(nx, 1, length(t) // 3) AS ed FROM d),
        l AS (SELECT doc_id, n, ed, list_distinct(regexp_extract_all(t, '[^\n]{1,160}')) AS a, list_distinct(regexp_extract_all(ed, '[^\n]{1,160}')) AS b, list_distinct(regexp_extract_all(nx, '[^\n]{1,160}')) AS c FROM e),
        i AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM l)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE ab / (len(a) + len(b) - ab) END AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE ac / (len(a) + len(c) - ac) END AS near_next FROM i
    """,
    "op8_warc_records": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q
    """,
    "op9_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS items FROM d),
        n AS (SELECT doc_id, len(items) AS n FROM s), e AS (SELECT doc_id, n, hash(unnest(items)) AS item FROM s JOIN n USING (doc_id)),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS met FROM e a JOIN e b ON a.item = b.item AND a.doc_id > b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM c WHERE 100 * met >= 85 * (nx + ny - met) UNION ALL SELECT y, x FROM c WHERE 100 * met >= 85 * (nx + ny - met)),
        r AS (SELECT x AS doc_id, x AS to_id FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.to_id),
        k AS (SELECT doc_id, min(to_id) AS least FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM n LEFT JOIN k USING (doc_id)
    """,
    "url_host_rules": r"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r AS (SELECT * FROM (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/')) v(h, f)),
            b AS (SELECT page_id, max_by(h || f, length(h || f)) AS rule FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
        SELECT page_id, host, path, rule FROM p LEFT JOIN b USING (page_id)
    """,
}
