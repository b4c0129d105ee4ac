"""Listings of a drive: JSON records to files, folders and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the type of a folder, and the columns read of a record
FOLDER_TYPE = "application/vnd.google-apps.folder"
NATIVE_TYPES = "application/vnd.google-apps."
NAME_LENGTH = 240
SCHEMA = (
    "id string, name string, mimeType string, size string, fullFileExtension string, parents array<string>, modifiedTime string, shared boolean, ownedByMe boolean, "
    "trashed boolean, webViewLink string, imageMediaMetadata string, permissions array<struct<emailAddress: string, role: string>>"
)


def parse(lines: DataFrame, column: str = "value", scope: str = "user_id") -> DataFrame:
    """Records of JSON lines with their scope; lines that aren't records, or have no id, are left out."""
    return lines.select(scope, F.from_json(column, SCHEMA).alias("r")).select(scope, "r.*").where("id is not null")


def split(records: DataFrame, scope: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(files, folders) of records that aren't trashed; repeated ids count once, the last modified one.

    Names are cut to NAME_LENGTH characters and '...', extensions lower-cased; a record without parent lies in 'root'.
    """
    live = records.where("not coalesce(trashed, false)")
    at = F.unix_timestamp(F.try_to_timestamp(F.col("modifiedTime")))
    rows = live.select(
        scope,
        "id",
        F.when(F.length("name") >= NAME_LENGTH, F.concat(F.substring("name", 1, NAME_LENGTH), F.lit("..."))).otherwise(F.col("name")).alias("name"),
        F.coalesce(F.get("parents", F.lit(0)), F.lit("root")).alias("parent_id"),
        F.lower("fullFileExtension").alias("file_extension"),
        F.expr("try_cast(size as bigint)").alias("size"),
        at.alias("last_modified"),
        F.col("mimeType").alias("mime"),
        F.coalesce("shared", F.lit(False)).alias("is_shared"),
        F.coalesce("ownedByMe", F.lit(False)).alias("is_owner"),
        F.coalesce(F.col("mimeType").startswith(NATIVE_TYPES), F.lit(False)).alias("is_native"),
        F.col("imageMediaMetadata").alias("media_info"),
    )
    columns = [c for c in rows.columns if c not in (scope, "id", "last_modified")]
    last = rows.groupBy(scope, "id").agg(F.max(F.struct("last_modified", *columns)).alias("v")).select(scope, "id", "v.*")
    is_folder = F.coalesce(F.col("mime") == FOLDER_TYPE, F.lit(False))
    return last.where(~is_folder), last.where(is_folder).drop("file_extension", "media_info", "is_native")


def shares(records: DataFrame, scope: str = "user_id") -> DataFrame:
    """(scope, id, shared_user): everybody but owners with an address, once."""
    each = records.select(scope, "id", F.explode("permissions").alias("p"))
    return each.where("p.emailAddress is not null and coalesce(p.role, '') <> 'owner'").select(scope, "id", F.col("p.emailAddress").alias("shared_user")).distinct()

