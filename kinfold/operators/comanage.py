"""Pairs of things that one session handles alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.places import first_rows
from kinfold.operators.sessions import sessions
from kinfold.storage import Scratch

DAY = 86400
ROWS_OF_ALL_SESSIONS = 1000
BLOCK = 1000


def label(events: DataFrame, gap: int, scratch: Scratch) -> DataFrame:
    """Events (key, time, ...) with the start and end of their session, session_start and session_end, which are null where key or time is.

    Sessions are found by `sessions` and joined back by span of time, so neither a key nor a long session is one group. A span
    is at least as long as the gap, so a session has no more spans than events. The hint keeps the spans from being broadcast:
    Spark takes them to be no larger than the file of sessions that they come from.
    """
    found = scratch.cut(sessions(events.withColumn("arrived", F.timestamp_seconds("time")), gap, "arrived", ()), "sessions")
    span = lambda time: F.floor(F.col(time) / max(DAY, gap))
    spans = found.select("key", F.col("start").alias("session_start"), F.col("end").alias("session_end"), F.explode(F.sequence(span("start"), span("end"))).alias("span"))
    dated = events.withColumn("span", span("time"))
    own = (F.col("e.key") == F.col("s.key")) & (F.col("e.span") == F.col("s.span")) & F.col("time").between(F.col("session_start"), F.col("session_end"))
    return dated.alias("e").join(spans.alias("s").hint("merge"), own, "left").select("e.*", "session_start", "session_end").drop("span")


def item_pairs(rows: DataFrame, by: list[str], scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(by, a, b): all pairs a < b of the items of a group, however large; repeated rows count once. Keys (by) and items must not be null.

    Groups of one row are left out before items are compared. A group of more than `block` items is dealt in blocks by hash and
    every two blocks meet by themselves, so its pairs are made by many tasks.
    """
    groups = scratch.cut(rows.groupBy(*by).count().where("count > 1").select(*by), "groups")
    many = scratch.cut(rows.join(groups, by, "left_semi").select(*by, "item").distinct(), "many")
    parts = F.ceil(F.count(F.lit(1)) / block).cast("int")
    large = scratch.cut(many.groupBy(*by).agg(parts.alias("parts")).where("parts > 1"), "large")
    small = many.join(large, by, "left_anti")
    found = small.withColumnRenamed("item", "a").join(small.withColumnRenamed("item", "b"), by).where("a < b")
    dealt = many.join(large, by).withColumn("own", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = dealt.select(*by, F.col("own").alias("i"), every.alias("j"), F.col("item").alias("a"))
    b = dealt.select(*by, every.alias("i"), F.col("own").alias("j"), F.col("item").alias("b"))
    return found.unionByName(a.join(b, [*by, "i", "j"]).where("a < b").drop("i", "j"))


def comanaged(events: DataFrame, gap: int, scratch: Scratch, rows_of_all: int | None = ROWS_OF_ALL_SESSIONS, block: int = BLOCK) -> DataFrame:
    """(key, session_start, target, a, b): pairs a < b of items with one target in one session.

    events: (key, time, target, item string). Of each session at most max(rows_of_all div sessions of the key, 1)
    rows are taken, in the order of the items' SHA-256: a sampling step of the method, not a guard. With rows_of_all None
    all rows are taken. A row without an item belongs to its session like any other, but is never taken; a row without a time
    is a session by itself. Rows without a key are left out.
    """
    labelled = label(events.where("key is not null"), gap, scratch)
    by = ["key", "session_start"]
    if rows_of_all is None:
        rows = labelled.where("session_start is not null and target is not null and item is not null").select(*by, "target", "item")
        return item_pairs(scratch.cut(rows, "labelled"), [*by, "target"], scratch, block)
    labelled = scratch.cut(labelled, "labelled")
    sizes = labelled.groupBy("key", "session_start").agg(F.count("item").alias("size"), F.count(F.lit(1)).alias("rows"))
    n = F.sum(F.when(F.col("session_start").isNull(), F.col("rows")).otherwise(1))
    limits = sizes.groupBy("key").agg(F.greatest(F.floor(F.lit(rows_of_all) / n), F.lit(1)).alias("limit"))
    labelled = labelled.where("session_start is not null and item is not null")
    # only sessions above their limit are hashed and sorted
    above = scratch.cut(sizes.join(limits, "key").where(F.col("size") > F.col("limit")).select("key", "session_start", "limit"), "above")
    hashed = labelled.join(above, by).withColumn("h", F.unhex(F.sha2("item", 256)))
    taken = first_rows(hashed, by, ["h", "item"], rows_of_all).where(F.col("place") <= F.col("limit")).select(*by, "target", "item")
    some = labelled.join(above, by, "left_anti").select(*by, "target", "item").unionByName(taken)
    a = some.select("key", "session_start", "target", F.col("item").alias("a"))
    b = some.select("key", "session_start", "target", F.col("item").alias("b"))
    # a session has at most rows_of_all rows here
    return a.join(b, ["key", "session_start", "target"]).where("a < b").distinct()
