"""Secret scans: fixed patterns, and strings that a Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns by kind, in their order of precedence, with the least length of what they must capture.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: Of a run that is shorter than this, nothing is said: in sf0.1 the longest ordinary run that scores as random has 10.
LEAST = 13
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches of a text that are worked on together.
TOGETHER = 64


@dataclass(frozen=True)
class MarkovRatio:
    """log P(b | a, random) - log P(b | a, ordinary) for characters a, b of ALPHABET (place 0: any other), row by row."""

    table: tuple[float, ...]

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio of a string's transitions; the same as score_of on a column."""
        at = [ALPHABET.find(c) + 1 for c in text]
        return sum(self.table[a * SIDE + b] for a, b in zip(at, at[1:])) / max(1, len(at) - 1)


def train(samples: DataFrame, backoff: float = 5.0) -> MarkovRatio | None:
    """A model from labelled samples (text, random boolean): transition counts of both classes. To a character's transitions
    `backoff` more are added as its class's characters are distributed, and to those half of one each.

    Counting is one aggregation over all samples; only the counts, at most 2 * SIDE ** 2 numbers, reach the driver. None
    if a class has no sample: then nothing can be compared. Null texts or labels are no samples.
    """
    chars = F.split("text", "")  # with an empty string at the end, which is no character
    pairs = samples.where("text is not null and random is not null").select("random", F.explode(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.length("text")).alias("b"))).alias("p"))
    at = lambda c: F.coalesce(F.instr(F.lit(ALPHABET), c), F.lit(0))
    counted = pairs.where("p.a is not null and p.b is not null and p.a <> '' and p.b <> ''").groupBy("random", at(F.col("p.a")).alias("a"), at(F.col("p.b")).alias("b")).count()
    counts = {True: [0.0] * SIDE**2, False: [0.0] * SIDE**2}
    seen = set()
    for random, a, b, n in counted.collect():
        counts[random][a * SIDE + b] += n
        seen.add(random)
    if len(seen) < 2:
        return None
    for n in counts.values():
        seen_b = [0.5 + sum(n[b::SIDE]) for b in range(SIDE)]
        share = [backoff * x / sum(seen_b) for x in seen_b]
        for a in range(SIDE):
            row = [x + y for x, y in zip(n[a * SIDE : (a + 1) * SIDE], share)]
            n[a * SIDE : (a + 1) * SIDE] = [math.log(x / sum(row)) for x in row]
    return MarkovRatio(tuple(round(a - b, 6) for a, b in zip(counts[True], counts[False])))


def generated_samples(spark, rows: int = 2000) -> DataFrame:
    """Random strings, (text, random = true), from a hash of a counter: base64, base32-like, hex with mixed case, url-safe."""
    h = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512))
    kinds = [F.base64(h), F.translate(F.base64(h), "+/=", "-_A"), F.upper(F.translate(F.base64(h), "+/=", "248"))]
    return spark.range(0, rows, 1, 4).select(F.explode(F.array(*kinds)).alias("text"), F.lit(True).alias("random"))


def ordinary_samples(texts: DataFrame) -> DataFrame:
    """Identifiers, (text, random = false), made of the words of texts (text): as they are, in capitals, joined with and
    without a mark between them, numbered, dated, and between rules of one repeated mark."""
    word = texts.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) >= 2")
    number = F.pmod(F.xxhash64("w"), F.lit(2100)).cast("string")
    forms = [F.col("w"), F.upper("w"), F.concat_ws("_", "w", F.lower("w")), F.concat_ws("-", F.lower("w"), "w"), F.concat_ws("/", "w", F.concat("w", number))]
    # What has no digit or no letter is judged as well, so the class also knows joined capitals, dates and rules.
    forms += [F.concat(F.lower("w"), F.initcap("w"), F.initcap(F.substring("w", 2, 99))), F.concat_ws("_", F.upper("w"), F.upper("w")), F.concat_ws("-", number, F.reverse(number), number), F.concat_ws("T", number, number)]
    forms += [F.concat(F.repeat(F.lit(c), 3), "w", F.repeat(F.lit(c), 3)) for c in "+/_=-"]
    return word.select(F.explode(F.array(*forms)).alias("text"), F.lit(False).alias("random"))


# ---- spans ----


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """items in arrays of TOGETHER."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(TOGETHER)), lambda i: F.slice(items, i + 1, TOGETHER))


def _spans(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """(start, kind, end) of the pattern's leftmost matches that do not overlap and whose group has `least` characters.

    The matches come with the text between them, so positions are sums of lengths, in code points. Texts without a match
    are not taken apart.
    """
    # The alternative \z takes what follows the last match, which else would be searched again from each of its characters.
    gaps = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)(?:{pattern}|\z)"), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), inner.alias("inner"))
    sizes = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["inner"]).alias("inner")))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["inner"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def of_block(start: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def of_all(all_: Column) -> Column:
        # Appending copies, so spans are gathered in blocks, from where each block starts.
        blocks = _blocks(all_)
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["whole"], F.lit(0)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + length(b))))
        several = _let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: of_block(F.get(at, i), b))))
        return F.when(F.size(all_) <= TOGETHER, of_block(F.lit(0), all_)).otherwise(several)

    return F.when(text.rlike(pattern), _let(sizes, of_all)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    # A shorter run of hex digits or capitals fails as a whole, so those two may ask for their length in the pattern; the
    # value of an assignment may not, as a failing match still takes up its text.
    found = (_spans(text, ASSIGN, 0, 12, 2), _spans(text, r"AKIA[A-Z0-9]{14,}", 1, 18), _spans(text, r"[0-9a-f]{16,}", 2, 16))
    return F.array_sort(F.concat(*found))


def score_of(token: Column, model: MarkovRatio) -> Column:
    """Mean log-likelihood ratio of a string's transitions. Each character is looked up once."""
    table = F.split(F.lit(",".join(map(str, model.table))), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, at: Column) -> Column:
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * SIDE + at))
        return F.struct(at.alias("last"), (acc["sum"] + gain).alias("sum"), (acc["n"] + 1).alias("n"))

    return F.aggregate(places, start, step, lambda acc: acc["sum"] / F.greatest(acc["n"] - 1, F.lit(1)))


def _uncovered(run: Column, base: Column) -> Column:
    """What is left of a run, as spans of its kind, when base spans, which come by start, are cut out of it."""
    span = lambda a, b: F.array(F.struct(a.alias("start"), run["kind"].alias("kind"), b.alias("end")))
    start = F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, b: Column) -> Column:
        cut = (b["start"] < run["end"]) & (acc["at"] < b["end"])
        spans = F.when(cut & (acc["at"] < b["start"]), F.concat(acc["spans"], span(acc["at"], b["start"]))).otherwise(acc["spans"])
        return F.struct(F.when(cut, b["end"]).otherwise(acc["at"]).alias("at"), spans.alias("spans"))

    rest = lambda acc: F.when(acc["at"] < run["end"], F.concat(acc["spans"], span(acc["at"], run["end"]))).otherwise(acc["spans"])
    return F.aggregate(base, start, step, rest)


def find_secrets(documents: DataFrame, model: MarkovRatio | None, margin: float = 0.5) -> DataFrame:
    """documents (doc_id, text, ...) with `base` and `spans`: arrays of (start, kind, end), code points, end exclusive.

    kind is a place in KINDS. `base` has the fixed patterns' spans; `spans` has those and, of kind random, what base spans
    leave of the runs of CANDIDATE: each piece of LEAST characters or more whose mean log-likelihood ratio is at least `margin`. Null and empty texts have none. No shuffle and no Python; columns named base or spans are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = documents.drop("base", "spans").withColumn("base", base_spans(text))
    if model is None:
        return out.withColumn("spans", F.col("base"))
    runs = _spans(text, CANDIDATE, 3, 1)
    reach = F.transform(_blocks(F.col("base")), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans")))
    near = lambda r: lambda run: F.flatten(F.transform(F.filter(r, lambda b: (b["low"] < run["end"]) & (b["high"] > run["start"])), lambda b: b["spans"]))
    pieces = _let(reach, lambda r: F.flatten(F.transform(runs, lambda s: _uncovered(s, near(r)(s)))))
    pieces = F.filter(pieces, lambda s: s["end"] - s["start"] >= LEAST)
    out = out.withColumn("_strandline_more", F.when(F.size("base") > 0, pieces).otherwise(runs))
    token = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    more = F.filter("_strandline_more", lambda s: score_of(token(s), model) >= margin)
    spans = F.when(F.size("_strandline_more") > 0, F.array_sort(F.concat("base", more))).otherwise(F.col("base"))
    return out.withColumn("spans", spans).drop("_strandline_more")


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span, or chain of overlapping spans, as one mark. Null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(new).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def model_from(documents: DataFrame, labels: DataFrame, sample_rows: int = 200) -> MarkovRatio | None:
    """A model whose ordinary class are the words of at most `sample_rows` documents with quality 1 (those whose hashed
    doc_id is least), and whose random class is generated. The ids are bounded by that parameter, so they are broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    return train(ordinary_samples(texts).unionByName(generated_samples(documents.sparkSession)))


def redact_documents(documents: DataFrame, model: MarkovRatio | None) -> DataFrame:
    """documents with the secrets in their texts redacted, and n_chars, if it is there, set to the new length."""
    whole = documents.select("text", F.struct(*documents.columns).alias("_document"))
    found = find_secrets(whole, model).withColumn("_redacted", redacted(F.col("text"), F.col("spans")))
    field = lambda c: F.col("_document").getField(c)
    named = {"text": F.col("_redacted")}
    if "n_chars" in documents.columns:
        length = F.when(F.size("spans") > 0, F.length("_redacted")).otherwise(field("n_chars"))
        named["n_chars"] = length.cast(documents.schema["n_chars"].dataType)
    return found.select(*[named.get(c, field(c)).alias(c) for c in documents.columns])
