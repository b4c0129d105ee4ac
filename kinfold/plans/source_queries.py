"""Queries that read the tables as a source would give them - records of a listing, of an activity log, files with content, a
stream - each with its SQL; and the registered SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import registry as functions
from kinfold.plans.file_queries import _new, _over, _sql_new, _BIGRAMS
from kinfold.sources import activity, content, listing
from kinfold.sources.tables import table
from kinfold.storage import Scratch, file_system
from kinfold.streaming.sessions import latest, once


def _iso(seconds: F.Column) -> F.Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Listing records (user_id, value) of files and folders as JSON."""
    columns = ["name", "parent_id", "size", "last_modified", "is_shared", "is_owner", "trashed"]
    files = _new(spark, folder, "files", [*columns, "file_extension", "goog_mime_type"]).withColumnRenamed("goog_mime_type", "mime")
    folders = _new(spark, folder, "folders", columns).withColumns({"file_extension": F.lit(None).cast("string"), "mime": F.lit(listing.FOLDER_TYPE)})
    owner = F.struct(F.concat("user_id", F.lit("@e")).alias("emailAddress"), F.lit("owner").alias("role"))
    reader = F.struct(F.concat(F.lit("r-"), "id").alias("emailAddress"), F.lit("reader").alias("role"))
    rows = files.unionByName(folders).where("user_id is not null and id is not null")
    record = F.struct(
        "id", "name", F.col("mime").alias("mimeType"), F.col("size").cast("string").alias("size"), F.col("file_extension").alias("fullFileExtension"), F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).alias("parents"),
        _iso(F.col("last_modified")).alias("modifiedTime"), F.col("is_shared").alias("shared"), F.col("is_owner").alias("ownedByMe"), "trashed", F.when(F.col("is_shared"), F.array(owner, reader, reader)).otherwise(F.array(owner)).alias("permissions"),
    )
    return rows.select("user_id", F.to_json(record).alias("value"))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files and folders of a listing's records."""
    files, folders = listing.split(listing.parse(_records(spark, folder)))
    columns = ["user_id", "id", "name", "parent_id", "size", "last_modified", "is_shared", "is_owner"]
    none = F.lit(None).cast("string")
    return files.select(*columns, "file_extension", "is_native", F.lit(False).alias("is_folder")).unionByName(folders.select(*columns, none.alias("file_extension"), F.lit(False).alias("is_native"), F.lit(True).alias("is_folder")))


def listed_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Who else sees what, of a listing's records."""
    return listing.shares(listing.parse(_records(spark, folder)))


def _activities(spark: SparkSession, folder: str) -> DataFrame:
    """Activity records (user_id, value) of the commands as JSON."""
    c = _new(spark, folder, "command_history", ["time_run", "cmd", "old_name", "new_name"]).where("user_id is not null and rand_id is not null and time_run <> 0")
    item = lambda n: F.struct(F.struct(F.concat(F.lit("items/"), n).alias("name")).alias("driveItem"))
    cmd = F.lower(F.trim("cmd"))
    empty = F.struct(F.lit("x").alias("kind"))
    detail = (
        F.when(cmd == "rename", F.to_json(F.struct(F.struct(F.col("old_name").alias("oldTitle"), F.col("new_name").alias("newTitle"), F.lit("x").alias("kind")).alias("rename"))))
        .when(cmd == "paste", F.to_json(F.struct(F.struct(F.array(item(F.concat(F.lit("to-"), "rand_id"))).alias("addedParents"), F.array(item(F.concat(F.lit("from-"), "rand_id"))).alias("removedParents")).alias("move"))))
        .when(cmd == "duplicate", F.to_json(F.struct(F.struct(F.struct(item(F.concat(F.lit("of-"), "rand_id")).alias("originalObject")).alias("copy")).alias("create"))))
        .when(cmd == "mkdir", F.to_json(F.struct(F.struct(empty.alias("new")).alias("create"))))
        .when(cmd == "rm", F.to_json(F.struct(empty.alias("delete"))))
    )
    made = F.when(cmd == "mkdir", F.lit('"driveFolder": {"type": "STANDARD"}')).otherwise('"driveFile": {}')
    target = F.concat(F.lit('[{"driveItem": {"name": "items/'), "rand_id", F.lit('", '), made, F.lit("}}]"))
    time = F.when(F.length("rand_id") % 2 == 0, F.concat(F.lit('"timestamp": "'), _iso(F.col("time_run")), F.lit('"'))).otherwise(F.concat(F.lit('"timeRange": {"startTime": "2000-01-01T00:00:00Z", "endTime": "'), _iso(F.col("time_run")), F.lit('"}')))
    return c.where(detail.isNotNull()).select("user_id", F.concat(F.lit('{"primaryActionDetail": '), detail, F.lit(", "), time, F.lit(', "targets": '), target, F.lit("}")).alias("value"))


def activity_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Actions of activity records, by what they are."""
    found = activity.parse(_activities(spark, folder))
    return found.groupBy("user_id", "cmd", "subtype", "old_name", "new_name", "is_copy", "time").agg(F.count(F.lit(1)).alias("n"))


def activity_items(spark: SparkSession, folder: str) -> DataFrame:
    """What activity records concern."""
    return activity.items(activity.parse(_activities(spark, folder))).select("user_id", "role", "file_id", "folder_id", "old_parent_id")


def file_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Length and hash of the text of files, documents written as plain text, tables of commas or tabs, or JSON in turn."""
    ext = F.element_at(F.array(*(F.lit(e) for e in ("txt", "csv", "tsv", "json", "bin"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = table(spark, folder, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return content.texts(files).select("path", F.length("text").alias("n"), F.md5("text").alias("hash"))


def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """What the registered SQL functions make of file names."""
    functions.register(spark)
    rows = _new(spark, folder, "files", ["name", "original_name", "size"])
    e = lambda s, a: F.expr(s).alias(a)
    return rows.select(
        "user_id", "id", e("kf_trunc(name, 12)", "short"), e("kf_short_hash(id)", "hash"), e("kf_copy_name(name)", "copy"), e("kf_extension(name)", "ext"), e("kf_edit_distance(name, original_name)", "distance"),
        e("round(kf_jaccard(kf_bigrams(lower(name)), kf_bigrams(lower(original_name))), 6)", "similarity"), e("array_join(kf_name_tokens(name), '|')", "tokens"), e("kf_size_text(cast(size AS DOUBLE))", "size_text"),
        e("round(kf_balanced(0.5D, cast(length(name) AS DOUBLE) / 100), 6)", "balanced"), e("round(kf_cosine(array(cast(length(name) AS DOUBLE), 1D), array(2D, 3D)), 6)", "cosine"), e("round(kf_euclidean(array(cast(length(name) AS DOUBLE), 1D), array(2D, 3D)), 6)", "euclidean"),
    )


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them; a stream can't be based on a single file."""
    path = f"{folder}/{name}.parquet"
    fs, at = file_system(spark, path)
    read = spark.readStream.schema(table(spark, folder, name).schema)
    return read.parquet(path) if fs.getFileStatus(at).isDirectory() else read.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _written(stream: DataFrame, scratch: Scratch) -> DataFrame:
    out = f"{scratch.path}/out"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return scratch.spark.read.schema(stream.schema).parquet(out)


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a stream of commands, of which repeats within a year are dropped."""
    rows = _stream(spark, folder, "command_history").where("user_id is not null and rand_id is not null and ingested_at is not null").select("user_id", "rand_id", F.col("ingested_at").cast("timestamp").alias("at"))
    return _written(once(rows, ["user_id", "rand_id"], "at", "366 days"), Scratch(spark, "once")).select("user_id", "rand_id")


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every file of a stream, each state that is published put over the last one."""
    scratch = Scratch(spark, "latest")
    rows = _stream(spark, folder, "files").where("user_id is not null and id is not null").select("user_id", "id", "ingested_at", "name", "size")
    state = latest(rows, ["user_id", "id"], "ingested_at", ["name", "size"])
    out = f"{scratch.path}/out"

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = state.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(state.schema).parquet(out).select("user_id", "id", "name", "size")


QUERIES = {f.__name__: f for f in (listed_files, listed_shares, activity_actions, activity_items, file_texts, sql_functions, stream_once, stream_latest)}

_BOTH = f"""
b as (
  select user_id, id, name, parent_id, size, last_modified, is_shared, is_owner, trashed, lower(file_extension) as file_extension, goog_mime_type like 'application/vnd.google-apps.%' as is_native, false as is_folder from {_sql_new('files')}
  union all select user_id, id, name, parent_id, size, last_modified, is_shared, is_owner, trashed, null, false, true from {_sql_new('folders')}
)
"""
_ACTS = f"""
a as (
  select user_id, rand_id, time_run as time, lower(trim(cmd, ' ')) as c, old_name, new_name from {_sql_new('command_history')} where user_id is not null and rand_id is not null and time_run <> 0
), k as (select * from a where c in ('rename', 'paste', 'duplicate', 'mkdir', 'rm'))
"""
_TEXT_SIM = "case when name is null or original_name is null then 0.0 else len(list_intersect(p, q))::double / greatest(len(list_distinct(list_concat(p, q))), 1) end"

SQL = {
    "listed_files": f"""
with {_BOTH} select user_id, id, case when length(name) >= 240 then name[:240] || '...' else name end as name, coalesce(parent_id, 'root') as parent_id, size, last_modified, coalesce(is_shared, false) as is_shared, coalesce(is_owner, false) as is_owner,
  file_extension, coalesce(is_native, false) as is_native, is_folder from b where user_id is not null and id is not null and not coalesce(trashed, false)
""",
    "listed_shares": f"with {_BOTH} select distinct user_id, id, 'r-' || id as shared_user from b where user_id is not null and id is not null and is_shared",
    "activity_actions": f"""
with {_ACTS} select user_id, case c when 'paste' then 'move' when 'duplicate' then 'create' when 'mkdir' then 'create' when 'rm' then 'delete' else c end as cmd, case c when 'duplicate' then 'copy' when 'mkdir' then 'new' end as subtype,
  case when c = 'rename' then old_name end as old_name, case when c = 'rename' then new_name end as new_name, c = 'duplicate' as is_copy, time, count(*) as n from k group by all
""",
    "activity_items": f"""
with {_ACTS} select user_id, 'target' as role, case when c <> 'mkdir' then rand_id end as file_id, case when c = 'mkdir' then rand_id end as folder_id, case when c = 'paste' then 'from-' || rand_id end as old_parent_id from k
union all select user_id, 'destination', null, 'to-' || rand_id, null from k where c = 'paste'
union all select user_id, 'original', 'of-' || rand_id, null, null from k where c = 'duplicate'
""",
    "file_texts": """
with t as (
  select '/d/' || doc_id || '.' || ['txt', 'csv', 'tsv', 'json', 'bin'][doc_id % 5 + 1] as path,
    case when text is null then null else case doc_id % 5 when 0 then text when 1 then replace(text, ',', ' ') when 2 then replace(text, chr(9), ' ') when 3 then '' end end as t from documents
)
select path, length(t)::integer as n, md5(t) as hash from t
""",
    "sql_functions": f"""
with f as (select *, {_over(_BIGRAMS, x='lower(name)')} as p, {_over(_BIGRAMS, x='lower(original_name)')} as q from {_sql_new('files')})
select user_id, id, case when length(name) >= 12 then name[:12] || '...' else name end as short, sha256(id)[:32] as hash, case when contains(name, '.') then regexp_replace(name, '\\.([^.]*)$', '_copy.\\1') else name || '_copy' end as copy,
  case when contains(name, '.') then list_extract(string_split(name, '.'), -1) end as ext, coalesce(levenshtein(name, original_name), 1000)::integer as distance, round({_TEXT_SIM}, 6) as similarity,
  array_to_string(regexp_split_to_array(lower(name), '[._~+ -]'), '|') as tokens,
  case when size is null then null when size = 0 then '---' when size <= 1000000 then format('{{:,.1f}}', size / 1e3) || ' Kb' when size <= 1000000000 then format('{{:,.1f}}', size / 1e6) || ' Mb' else format('{{:,.1f}}', size / 1e9) || ' Gb' end as size_text,
  round(1 / (0.25 / 0.5::double + 0.75 / (length(name)::double / 100)), 6) as balanced, round((2 * length(name)::double + 3) / (sqrt(length(name)::double * length(name) + 1) * sqrt(13::double)), 6) as cosine,
  round(sqrt((length(name)::double - 2) * (length(name)::double - 2) + 4), 6) as euclidean
from f
""",
    "stream_once": "select distinct user_id, rand_id from command_history where user_id is not null and rand_id is not null and ingested_at is not null",
    "stream_latest": f"select user_id, id, name, size from {_sql_new('files')} where user_id is not null and id is not null",
}
