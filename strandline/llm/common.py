"""What the corpus operators share: their tables and vocabularies, and the library's written tables and joins of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.groups import divided, hot_keys, join_groups, without
from ..sources.shared import gathered, new_path, remove, scratch, shared_dir, written

__all__ = ["divided", "gathered", "hot_keys", "join_groups", "new_path", "remove", "scratch", "shared_dir", "table", "vocabulary", "without", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
