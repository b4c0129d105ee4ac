"""Activity records: JSON to actions and the items they concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds of create and comment actions, in the order in which they are looked for
CREATE, COMMENT = ("new", "upload", "copy"), ("post", "assignment", "suggestion")
ITEM = "driveItem: struct<name: string, title: string, driveFile: string, driveFolder: struct<type: string>>"
SCHEMA = f"primaryActionDetail string, timestamp string, timeRange struct<startTime: string, endTime: string>, targets array<struct<{ITEM}>>"
ROOT_TYPE = "MY_DRIVE_ROOT"


def _get(path: str) -> Column:
    return F.get_json_object("detail", f"$.{path}")


def parse(lines: DataFrame, column: str = "value", scope: str = "user_id") -> DataFrame:
    """Actions (scope, act_id, cmd, subtype, old_name, new_name, is_copy, time, detail, targets) of JSON lines.

    act_id is a hash of scope and line, so a repeated record has the same one. A time range counts by its end. Lines
    that aren't records are left out.
    """
    r = lines.select(scope, F.sha2(F.concat_ws("|", scope, column), 256).alias("act_id"), F.from_json(column, SCHEMA).alias("r")).where("r.primaryActionDetail is not null")
    rows = r.select(
        scope, "act_id", F.col("r.primaryActionDetail").alias("detail"), F.get(F.json_object_keys("r.primaryActionDetail"), F.lit(0)).alias("cmd"), F.col("r.targets").alias("targets"),
        F.unix_timestamp(F.try_to_timestamp(F.coalesce("r.timestamp", "r.timeRange.endTime"))).alias("time"),
    )
    first = lambda kind, names: F.coalesce(*(F.when(_get(f"{kind}.{n}").isNotNull(), n) for n in names))
    subtype = F.when(F.col("cmd") == "create", first("create", CREATE)).when(F.col("cmd") == "comment", first("comment", COMMENT))
    return rows.select(
        scope, "act_id", "cmd", subtype.alias("subtype"), _get("rename.oldTitle").alias("old_name"), _get("rename.newTitle").alias("new_name"),
        (F.coalesce(subtype, F.lit("")) == "copy").alias("is_copy"), "time", "detail", "targets",
    )


def _id(name: Column) -> Column:
    return F.get(F.split(name, "/"), F.lit(1))


def items(actions: DataFrame, scope: str = "user_id") -> DataFrame:
    """(scope, act_id, role, file_id, folder_id, old_parent_id): the targets of every action, and the destination of moves
    ('destination': the first parent added) and the originals of copies ('original').

    An item is a file, a folder, or both if its kind isn't told; the top folder's id is 'root'. Targets of a move have the
    first parent removed as old_parent_id.
    """
    moved = lambda side: F.get(F.from_json(_get(f"move.{side}"), f"array<struct<{ITEM}>>"), F.lit(0))["driveItem"]["name"]
    each = actions.select(scope, "act_id", "cmd", F.explode("targets").alias("t"), _id(moved("removedParents")).alias("old_parent_id"))
    item = F.col("t.driveItem")
    is_file, is_folder = item["driveFile"].isNotNull(), item["driveFolder"].isNotNull()
    own = F.when(item["driveFolder"]["type"] == ROOT_TYPE, "root").otherwise(_id(item["name"]))
    targets = each.where(item.isNotNull()).select(
        scope, "act_id", F.lit("target").alias("role"), F.when(is_file | ~is_folder, own).alias("file_id"), F.when(is_folder | ~is_file, own).alias("folder_id"), "old_parent_id"
    )
    none = F.lit(None).cast("string")
    to = actions.select(scope, "act_id", F.lit("destination").alias("role"), none.alias("file_id"), _id(moved("addedParents")).alias("folder_id"), none.alias("old_parent_id")).where("folder_id is not null")
    original = _id(_get("create.copy.originalObject.driveItem.name"))
    copied = actions.select(scope, "act_id", F.lit("original").alias("role"), original.alias("file_id"), none.alias("folder_id"), none.alias("old_parent_id")).where("file_id is not null")
    return targets.unionByName(to).unionByName(copied)
