"""A training corpus from documents: quality, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. What a stage writes is what the next one reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, exact_dedup, near_dedup, packing, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on the labelled ones among docs, does not reject.

    Null and empty texts are one empty line and judged like others; repeated rows are judged alike. Without labels all stay.
    """
    return common.gathered(quality.keep_good(docs, common.table(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the least doc_id; nulls come last, null texts are empty ones, and of rows
    that repeat both one stays."""
    return common.gathered(exact_dedup.keep_first(docs))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.8 the one with the least doc_id; nulls come
    last. Null and empty texts are linked with nothing."""
    return common.gathered(near_dedup.keep_first(docs, near_dedup.Rule(words=5, percent=80)))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark; null texts stay null."""
    return common.gathered(secrets.redact_documents(docs, secrets.model_from(docs, common.table(spark, sf_dir, "labels"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids; null and empty texts are one id, and every row is a document."""
    return common.gathered(packing.pack(docs, common.vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: Classifier, sketches and tokenizer are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir. What a stage wrote is there until the next one has ended."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as kept:
            docs = common.written(stage(spark, docs, sf_dir), f"stage_{name}")
            kept.append(docs)
        if last:
            common.remove(spark, last)
        last = docs._strandline_path
    return STAGES[-1][1](spark, docs, sf_dir)
