"""Queries that run a table through Structured Streaming; their results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.sessions import SessionTable
from kinfold.plans import file_queries
from kinfold.sources.tables import table
from kinfold.storage import Scratch
from kinfold.streaming.sessions import into_table


def stream_event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the event stream, applied batch by batch to a session table."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = stream.select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"))
    scratch = Scratch(spark, "stream")
    sessions = SessionTable(spark, f"{scratch.path}/table", 1800)
    query = into_table(events, sessions, f"{scratch.path}/checkpoint").start()
    query.awaitTermination()
    return sessions.read().select(F.col("key").cast("long").alias("user_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("n").alias("n_events"))


QUERIES = {"stream_event_sessions": stream_event_sessions}
SQL = {"stream_event_sessions": file_queries.SQL["event_sessions"]}
