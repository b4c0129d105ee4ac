"""Newest versions of records that arrive more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], arrived: str = "ingested_at", columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest `arrived`.

    Null keys are a key of their own; a null `arrived` is older than any other. Rows that tie are taken
    in descending order of the other columns, so that the result never depends on the order of the input.
    The window's rank limit is applied before the shuffle as well, so repeats of a hot key don't travel.
    """
    columns = columns or [c for c in df.columns if c not in {*keys, arrived}]
    columns = [c for c in columns if c not in {*keys, arrived}]
    picked = df.select(*keys, arrived, *columns)
    order = [F.col(arrived).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns)]
    ranked = picked.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__place = 1").drop("__place")
