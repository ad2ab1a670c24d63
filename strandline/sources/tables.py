"""Readers for the Parquet tables and for keyed, ordered symbol streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class SequenceSpec:
    """How a table is read as one ordered symbol stream per cell.

    `order` must be total inside a cell, otherwise runs depend on the engine's tie order.
    """

    cell: str
    order: tuple[str, ...]
    symbol: str


EVENTS = SequenceSpec("user_id", ("ts", "event_id"), "event_type")


def stream(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Columns (cell, o1.., symbol) of a keyed stream; rows without a cell or symbol are no part of any sequence."""
    order: list[Column] = [F.col(c).alias(f"o{i}") for i, c in enumerate(spec.order, 1)]
    return df.where(F.col(spec.cell).isNotNull() & F.col(spec.symbol).isNotNull()).select(
        F.col(spec.cell).alias("cell"), *order, F.col(spec.symbol).alias("symbol")
    )
