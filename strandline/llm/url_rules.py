"""URL filtering by host and path rules and, where none fits, by association rules mined with FP-growth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BAD = "label=bad"
#: Rows of the inverted index up to which it is broadcast, and how often a larger one is dealt out.
INDEX_ROWS = 100_000
SALTS = 32


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host and all its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and for urls without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null and for urls without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits (host and path together), or null. Rules are few: each is one comparison in the projection."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a url: host labels by their distance from the end, words of the path, keys of the query.

    Digits become 0, so that numbered pages share tokens. Text without letters or digits gives no token.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    hosts = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    words = F.transform(
        F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0"))
    )
    keys = F.transform(F.regexp_extract_all(query, F.lit(r"(?:^|&)([^&=]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), F.lower(x)))
    return F.array_distinct(F.concat(hosts, words, F.coalesce(keys, F.array().cast("array<string>"))))


def url_tokens(url: Column) -> Column:
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    return tokens(host_of(url), path_of(url), query)


def mine(labelled: DataFrame, min_support: float = 0.002, min_rows: int = 20, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """(rule, need, confidence, support): token combinations that speak for a bad page.

    labelled: (tokens, bad boolean); a null label is no label. FP-growth counts the label as one more token. Of the rules
    with the label as consequent those stay that have the support (a share of the labelled rows, and min_rows of them at
    least), the confidence and the lift, and whose confidence is above that of every rule that is part of them: what a part says as surely is not said
    twice. No labelled row gives no rule.
    """
    rows = labelled.where("bad is not null").select(
        F.array_union(F.coalesce("tokens", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    total = max(1, rows.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / total)), minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    found = found.select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    part, seen = found.select(F.col("rule").alias("part"), F.col("confidence").alias("had")), F.explode("rule").alias("token")
    inner = part.select("part", "had", F.explode("part").alias("token")).join(found.select("rule", "confidence", seen), "token")
    inner = inner.groupBy("part", "rule").agg(F.count("*").alias("n"), F.first("had").alias("had"), F.first("confidence").alias("confidence"))
    weaker = inner.where((F.col("n") == F.size("part")) & (F.size("part") < F.size("rule")) & (F.col("had") >= F.col("confidence")))
    return found.join(weaker.select("rule").distinct(), "rule", "left_anti").withColumn("need", F.size("rule"))


def matched(pages: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule, confidence): the surest rule whose tokens all are among the page's.

    pages: (key, tokens), one row per key. An inverted index, token to the rules that have it, meets the pages' tokens; a
    rule holds where as many of its tokens were met as it needs. Only tokens of some rule are met at all: a page
    contributes a row for each rule that shares a token with it. rules should be a written table.
    """
    index = rules.select(F.explode("rule").alias("token"), F.col("rule"), "need", "confidence")
    asked = pages.select(key, F.explode("tokens").alias("token"))
    if index.limit(INDEX_ROWS + 1).count() <= INDEX_ROWS:
        met = asked.join(F.broadcast(index), "token")
    else:  # a token that most pages have is dealt out over SALTS tasks, each with its part of the index
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).drop("salt")
    whole = met.groupBy(key, "rule", "need", "confidence").agg(F.count("*").alias("n")).where("n = need")
    best = whole.groupBy(key).agg(F.max(F.struct("confidence", "rule")).alias("_best"))
    return best.select(key, F.col("_best.rule").alias("mined_rule"), F.col("_best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[HostRule], **mining: float) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, mined_rule, confidence.

    A fitting host rule decides; else the page is blocked where a mined rule matches and allowed where none does.
    labelled: (url, bad). Null urls, and urls without ://, have an empty host and path: no rule fits, no token, allowed.
    Pages are matched by the distinct token sets, so repeated urls and many pages of one site cost one match; mined_rule
    is empty where the method found none, and null where a host rule decided.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_tokens(F.col("url")).alias("tokens"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[x for r in rules for x in (F.lit(r.text), F.lit(r.verdict))]) if rules else F.lit(None).cast("map<string,string>")
    by_rule = rows.where("rule is not null").select(
        "page_id", "host", "path", "rule", F.element_at(said, F.col("rule")).alias("verdict"),
        F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"),
    )
    open_rows = rows.where("rule is null").withColumn("tokens", F.array_sort("tokens")).withColumn("set", F.xxhash64("tokens"))
    sets = common.written(open_rows.groupBy("set").agg(F.min("tokens").alias("tokens"), F.count("*").alias("n")), "token_sets")
    mined = common.written(mine(labelled.select(url_tokens(F.col("url")).alias("tokens"), "bad"), **mining), "url_rules")
    hits = common.written(sets.select("set", "n").join(matched(sets, "set", mined), "set", "left"), "url_hits")
    judged = common.join_groups(open_rows.select("page_id", "host", "path", "rule", "set"), hits, ["set"], "n")
    by_method = judged.select(
        "page_id", "host", "path", "rule", F.when(F.col("mined_rule").isNull(), "allow").otherwise("block").alias("verdict"),
        F.concat_ws(" ", "mined_rule").alias("mined_rule"), "confidence",
    )
    return by_rule.unionByName(by_method)
