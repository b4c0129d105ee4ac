"""Sessions and newest versions of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.sessions import SessionTable


def windows(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(key, start, end, n) of a stream (key, ts timestamp): sessions closed once the watermark has passed them.

    Events later than the lateness are dropped; `into_table` takes events of any lateness.
    """
    grouped = events.withWatermark("ts", lateness).groupBy("key", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("w")


def into_table(events: DataFrame, table: SessionTable, checkpoint: str):
    """A query that applies each batch of a stream (key, time) to the table, each once."""

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch.select("key", "time"), tag=str(number))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def once(stream: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """A stream without rows whose key came before, within the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, keys: list[str], arrived: str, columns: list[str]) -> DataFrame:
    """The newest version of every key so far (update or complete mode); ties by the greatest columns."""
    newest = stream.groupBy(*keys).agg(F.max(F.struct(arrived, *columns)).alias("v"))
    return newest.select(*keys, *(F.col(f"v.{c}").alias(c) for c in (arrived, *columns)))
