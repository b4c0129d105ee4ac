"""A log of commands joined with what they concern, and states rebuilt from it.

A log has (user_id, cmd_id, time, tie, cmd); items say what each command concerned: (user_id, cmd_id, object_id,
target_id), target_id being the folder that it went to. Commands of one user are ordered by time, then tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: commands that only look, and those that move, bring in, remove or rename
LOOKING, MOVING, REMOVING, RENAMING, MAKING = ("open", "find"), ("paste", "move"), ("rm",), ("rename",), ("mkdir",)


def with_items(log: DataFrame, items: DataFrame, objects_only: bool = False) -> DataFrame:
    """Every command with each of its items; commands without one are left out, and with objects_only items without an object."""
    kept = items.where("object_id is not null") if objects_only else items
    return log.join(kept, ["user_id", "cmd_id"])


def with_destinations(moved: DataFrame, folders: DataFrame) -> DataFrame:
    """Moved objects with the folder (user_id, target_id, name) that they went to; its name is null if it isn't known."""
    named = folders.select("user_id", "target_id", F.col("name").alias("target_name"))
    return moved.join(named, ["user_id", "target_id"], "left")


def of_known(rows: DataFrame, files: DataFrame, folders: DataFrame, key: str = "object_id") -> DataFrame:
    """Rows whose key is an id of the user's files or folders (each user_id, id)."""
    known = files.select("user_id", F.col("id").alias(key)).unionByName(folders.select("user_id", F.col("id").alias(key))).distinct()
    return rows.join(known, ["user_id", key], "left_semi")


def looked_up(rows: DataFrame, files: DataFrame, folders: DataFrame, key: str = "object_id") -> DataFrame:
    """Rows with kind ('file', 'folder' or null) and name of the object that the key names; a file goes before a folder of the
    same id. files and folders: (user_id, id, name), one row a key."""
    f = files.select("user_id", F.col("id").alias(key), F.lit("file").alias("kind"), "name")
    d = folders.select("user_id", F.col("id").alias(key), F.lit("folder").alias("kind"), "name")
    known = f.unionByName(d).groupBy("user_id", key).agg(F.min(F.struct("kind", "name")).alias("o"))
    return rows.join(known, ["user_id", key], "left").select(*rows.columns, F.col("o.kind").alias("kind"), F.col("o.name").alias("name"))


def _last(value: Column, when: Column, order: Column) -> Column:
    """The value of the last row for which the condition holds and the value isn't null."""
    return F.max_by(value, F.when(when & value.isNotNull(), order))


def replayed(base: DataFrame, log: DataFrame, until: int | None = None) -> DataFrame:
    """The objects of base (user_id, id, parent_id, name, trashed) after the commands up to `until` (inclusive; None: all).

    log: commands with items (user_id, time, tie, cmd, object_id, target_id, new_name). A moving command sets the parent and
    brings a removed object back, a removing one sets trashed, a renaming one the name; nulls change nothing, and of commands for one
    object the last counts, each for its own column. Objects that base doesn't have stay out. n_commands counts what was
    replayed; other columns of base stay. One pass: each column is an aggregate of the log per object, so neither a state nor an order of rows is kept.
    """
    rows = log if until is None else log.where(F.col("time") <= until)
    order, cmd = F.struct("time", "tie"), F.col("cmd")
    changes = rows.where("object_id is not null and time is not null").groupBy("user_id", F.col("object_id").alias("id")).agg(
        _last(F.col("target_id"), cmd.isin(*MOVING), order).alias("__parent"),
        _last(F.col("new_name"), cmd.isin(*RENAMING), order).alias("__name"),
        _last(cmd.isin(*REMOVING), cmd.isin(*REMOVING, *MOVING), order).alias("__trashed"),
        F.sum(cmd.isin(*MOVING, *RENAMING, *REMOVING).cast("long")).alias("__n"),
    )
    both = base.join(changes, ["user_id", "id"], "left")
    return both.select(
        *(c for c in base.columns if c not in ("parent_id", "name", "trashed")),
        F.coalesce("__parent", "parent_id").alias("parent_id"),
        F.coalesce("__name", "name").alias("name"),
        F.coalesce("__trashed", "trashed").alias("trashed"),
        F.coalesce("__n", F.lit(0)).alias("n_commands"),
    )


def visible(objects: DataFrame, until: int) -> DataFrame:
    """Objects that were there at a time: created by then (null: always), not trashed; locked are those of others."""
    return objects.where((F.col("created_time").isNull() | (F.col("created_time") <= until)) & ~F.coalesce("trashed", F.lit(False))).withColumn("locked", ~F.coalesce("is_owner", F.lit(False)))


def lookup(listed: DataFrame, pairs: DataFrame, both_ways: bool = True) -> DataFrame:
    """Rows of pairs (user_id, file_id_a, file_id_b, ...) that a list (user_id, a, b) names, in either order or only as given."""
    if not both_ways:
        return pairs.join(listed.select("user_id", F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b")).distinct(), ["user_id", "file_id_a", "file_id_b"], "left_semi")
    named = listed.select("user_id", F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")).where("a is not null and b is not null").distinct()
    keyed = pairs.withColumns({"__a": F.least("file_id_a", "file_id_b"), "__b": F.greatest("file_id_a", "file_id_b")})
    return keyed.join(named, ["user_id", "__a", "__b"], "left_semi").drop("__a", "__b")
