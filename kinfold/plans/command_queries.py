"""Queries on the log of commands and what it concerns, on states rebuilt from it and on keyed changes, each with its SQL.

What a command concerned is the recommendation that it names: its file (by path hash) and the folder that it goes to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import records
from kinfold.operators import commands, pairs
from kinfold.operators.comanage import comanaged
from kinfold.operators.places import places
from kinfold.operators.versions import newest
from kinfold.plans.file_queries import KEYS, _new, _pairs, _sql_new, _SQL_PAIRS, pair_scores
from kinfold.plans.file_queries import SQL as FILE_SQL
from kinfold.sinks import KeyedTable, updated
from kinfold.sources.tables import table
from kinfold.storage import Scratch

UNTIL = 1455000000  # 2016-02-09 06:40:00
MOVES_S, REMOVALS_S = 90 * 86400, 20 * 86400


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = _new(spark, folder, "command_history", ["time_run", "cmd", "new_name", "rec_result_id"]).where("user_id is not null and rand_id is not null")
    cmd = F.lower(F.regexp_replace("cmd", r"^\s+|\s+$", ""))
    return rows.select("user_id", F.col("rand_id").alias("cmd_id"), F.col("time_run").alias("time"), F.col("rand_id").alias("tie"), cmd.alias("cmd"), "new_name", "rec_result_id")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, cmd_id, object_id, target_id)"""
    recs = _new(spark, folder, "recommends", ["rec_path_hash", "dst_hash"]).select("user_id", F.col("rand_id").alias("rec_result_id"), F.col("rec_path_hash").alias("object_id"), F.col("dst_hash").alias("target_id"))
    named = _log(spark, folder).where("rec_result_id is not null").select("user_id", "cmd_id", "rec_result_id")
    return named.join(recs, ["user_id", "rec_result_id"]).select("user_id", "cmd_id", "object_id", "target_id")


def _objects(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(user_id, id, name): one row a path hash, the least name of those that share it."""
    return _new(spark, folder, name, ["path_hash", "name"]).where("path_hash is not null").groupBy("user_id", F.col("path_hash").alias("id")).agg(F.min("name").alias("name"))


def _logged(spark: SparkSession, folder: str, objects_only: bool = True) -> DataFrame:
    log = _log(spark, folder).drop("rec_result_id").where("time <> 0")
    return commands.with_items(log, _items(spark, folder), objects_only)


def command_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every command with the objects that it concerned and where they went."""
    return _logged(spark, folder).select("user_id", "cmd_id", "cmd", "time", "object_id", "target_id")


def command_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Moved objects with the name of the folder that they went to, null if the user has none such."""
    folders = _objects(spark, folder, "folders").withColumnRenamed("id", "target_id")
    moved = _logged(spark, folder).where(F.col("cmd").isin(*commands.MOVING))
    return commands.with_destinations(moved, folders).select("user_id", "cmd_id", "object_id", "target_id", "target_name")


def command_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and name of what every command concerned, null for what the listings don't have."""
    found = commands.looked_up(_logged(spark, folder).select("user_id", "cmd_id", "object_id"), _objects(spark, folder, "files"), _objects(spark, folder, "folders"))
    return found.select("user_id", "cmd_id", "object_id", "kind", "name")


def known_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands on objects that a listing has."""
    return commands.of_known(_logged(spark, folder), _objects(spark, folder, "files"), _objects(spark, folder, "folders")).select("user_id", "cmd_id", "cmd")


def new_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Commands that made a folder, with the object that each concerned."""
    return _logged(spark, folder).where(F.col("cmd").isin(*commands.MAKING)).select("user_id", "cmd_id", "time", "object_id")


def files_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Parent, name and state of every file after the commands up to a past time."""
    base = _new(spark, folder, "files", ["path_hash", "parent_hash", "name", "trashed"]).where("id is not null").select("user_id", F.col("path_hash").alias("id"), F.col("id").alias("file_id"), F.col("parent_hash").alias("parent_id"), "name", "trashed")
    return commands.replayed(base, _logged(spark, folder), UNTIL).select("user_id", "file_id", F.col("parent_id").alias("parent_hash"), "name", "trashed", "n_commands")


def files_now(spark: SparkSession, folder: str) -> DataFrame:
    """The same after all commands."""
    base = _new(spark, folder, "files", ["path_hash", "parent_hash", "name", "trashed"]).where("id is not null").select("user_id", F.col("path_hash").alias("id"), F.col("id").alias("file_id"), F.col("parent_hash").alias("parent_id"), "name", "trashed")
    return commands.replayed(base, _logged(spark, folder)).select("user_id", "file_id", F.col("parent_id").alias("parent_hash"), "name", "trashed", "n_commands")


def visible_files(spark: SparkSession, folder: str) -> DataFrame:
    """Live files that were there at a past time, and whether the user may not change them."""
    return commands.visible(_new(spark, folder, "files", ["created_time", "trashed", "is_owner"]), UNTIL).select("user_id", "id", "locked")


def last_touches(spark: SparkSession, folder: str) -> DataFrame:
    """The time of the last command on every file, 0 if there was none."""
    files = _new(spark, folder, "files", ["path_hash"]).select("user_id", "id", F.col("path_hash").alias("object_id"))
    last = _logged(spark, folder).groupBy("user_id", "object_id").agg(F.max("time").alias("t"))
    return files.join(last, ["user_id", "object_id"], "left").select("user_id", "id", F.coalesce("t", F.lit(0)).alias("last_touch"))


def _order_items(spark: SparkSession, folder: str) -> DataFrame:
    """(key, time, target, item, flag): orders as commands and their lines as what these concern. Times are rounded to seconds, halves to even ones."""
    time = F.rint(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).cast("long")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("key"), time.alias("time"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("target"), F.col("l_partkey").cast("string").alias("item"), F.col("l_returnflag").alias("flag"))
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


def moved_together(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of parts of the same supplier in one session of a customer's orders, at pauses of more than 90 days."""
    found = comanaged(_order_items(spark, folder).select("key", "time", "target", "item"), MOVES_S, Scratch(spark, "moves"), rows_of_all=None)
    return found.select(F.col("key").alias("custkey"), "session_start", "target", "a", "b")


def removed_together(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of returned parts in one session of a customer's orders, at pauses of more than 20 days."""
    events = _order_items(spark, folder).where("flag = 'R'").select("key", "time", F.lit("").alias("target"), "item")
    found = comanaged(events, REMOVALS_S, Scratch(spark, "removals"))
    return found.select(F.col("key").alias("custkey"), "session_start", "a", "b")


def pair_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one listed pair of every user, given the other way round than it lies first."""
    some = _pairs(spark, folder, ["find_cert"]).where("user_id is not null")
    listed = some.groupBy("user_id").agg(F.min(F.struct("file_id_a", "file_id_b")).alias("p")).select("user_id", F.col("p.file_id_b").alias("a"), F.col("p.file_id_a").alias("b"))
    one, two = commands.lookup(listed, some), commands.lookup(listed, some, both_ways=False)
    return one.select("user_id", "file_id_a", "file_id_b").join(two.select("user_id", "file_id_a", "file_id_b", F.lit(True).alias("as_given")), ["user_id", "file_id_a", "file_id_b"], "left").fillna(False, ["as_given"])


def command_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 25 of every user's commands in order, and the minutes since the user's first."""
    log = _log(spark, folder).where("time <> 0")
    placed = places(log.select("user_id", "time", "tie"), ["user_id"], ["time", "tie"], Scratch(spark, "batches"))
    first = log.groupBy("user_id").agg(F.min("time").alias("first"))
    return placed.join(first, "user_id").select("user_id", F.col("tie").alias("rand_id"), records.batches(F.col("place"), 25).alias("batch"), records.minutes_since(F.col("first"), F.col("time")).alias("minutes"))


def merged_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stored predictions of all pairs, with the new ones put over them where a pair has any: one score stands for all actions."""
    columns = [f"{a}_{c}" for a in ("find", "move", "del") for c in ("pred", "true_cert")]
    target = _pairs(spark, folder, columns)
    new = pair_scores(spark, folder).select("user_id", "file_id_a", "file_id_b", *(F.col("pred" if c.endswith("_pred") else "p").alias(c) for c in columns))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    return updated(target, new, KEYS["simils"], columns).select(*KEYS["simils"], *(c if c.endswith("_pred") else number(c).alias(c) for c in columns))


def upserted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files by key, put into a table of parts in two batches by arrival: the later version replaces the earlier."""
    rows = table(spark, folder, "files").where("user_id is not null and id is not null").select("user_id", "id", "name", "error", "ingested_at")
    scratch = Scratch(spark, "upsert")
    cut = rows.select(F.percentile_approx("ingested_at", 0.6)).first()[0]
    kept = KeyedTable(spark, f"{scratch.path}/table", rows.schema, ["user_id", "id"])
    at = F.lit(cut).cast(rows.schema["ingested_at"].dataType)
    for batch in (rows.where(F.col("ingested_at") <= at), rows.where(F.col("ingested_at") > at)):
        kept.upsert(newest(batch, KEYS["files"], columns=["name", "error"]))
    return kept.read().select("user_id", "id", "name", "error")


def ranked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every pair among the pairs of its lesser file: positive ones first, then by score, ties by the other file."""
    both = pairs.neighbours(pair_scores(spark, folder).select("user_id", "file_id_a", "file_id_b", "pred", "p"), ["pred", "p"]).where("user_id is not null")
    placed = places(both, ["user_id", "file_id"], [F.col("pred").desc(), F.col("p").desc(), F.col("other_id").asc()], Scratch(spark, "ranked"))
    return placed.select("user_id", "file_id", "other_id", "pred", "p", "place")


QUERIES = {
    f.__name__: f
    for f in (
        command_items, command_moves, command_objects, known_commands, new_folders, files_as_of, files_now, visible_files, last_touches, moved_together, removed_together,
        pair_lookup, command_batches, merged_scores, upserted_files, ranked_scores,
    )
}

_CMD = "lower(regexp_replace(cmd, '^\\s+|\\s+$', '', 'g'))"
_LOG = f"log as (select user_id, rand_id as cmd_id, time_run as time, {_CMD} as cmd, new_name, rec_result_id from {_sql_new('command_history')} where user_id is not null and rand_id is not null)"
_LOGGED = f"""{_LOG}, li as (
  select l.user_id, l.cmd_id, l.time, l.cmd, l.new_name, r.rec_path_hash as object_id, r.dst_hash as target_id
  from log l join {_sql_new('recommends')} r on r.user_id = l.user_id and r.rand_id = l.rec_result_id where r.rec_path_hash is not null and l.time <> 0
)"""
_OBJECTS = "(select user_id, path_hash as id, min(name) as name from {} where path_hash is not null group by all)"
_FILES, _FOLDERS = _OBJECTS.format(_sql_new("files")), _OBJECTS.format(_sql_new("folders"))


def _sql_replayed(until: str) -> str:
    return f"""
with {_LOGGED}, c as (
  select user_id, object_id as id, arg_max(target_id, (time, cmd_id)) filter (cmd in ('paste', 'move') and target_id is not null) as parent,
    arg_max(new_name, (time, cmd_id)) filter (cmd = 'rename' and new_name is not null) as name,
    arg_max(cmd = 'rm', (time, cmd_id)) filter (cmd in ('rm', 'paste', 'move')) as trashed, count(*) filter (cmd in ('paste', 'move', 'rename', 'rm')) as n
  from li {until} group by all
)
select f.user_id, f.id as file_id, coalesce(c.parent, f.parent_hash) as parent_hash, coalesce(c.name, f.name) as name, coalesce(c.trashed, f.trashed) as trashed, coalesce(c.n, 0)::bigint as n_commands
from {_sql_new('files')} f left join c on c.user_id = f.user_id and c.id = f.path_hash where f.id is not null
"""


def _sql_together(cond: str, target: str, gap: int, rows: int | None = None) -> str:
    """rows: of all sessions of a customer, dealt evenly; None takes all rows."""
    taken = "c as (select *, min(t) over (partition by custkey, k) as session_start from s)"
    if rows:
        taken = f"""n as (select custkey, count(distinct k) as n from s group by all),
r as (select s.*, n, min(t) over (partition by s.custkey, k) as session_start, row_number() over (partition by s.custkey, k order by sha256(item), item) as place from s join n on n.custkey = s.custkey),
c as (select * from r where place <= least({rows}, greatest({rows} // n, 1)))"""
    return f"""
with e as (
  select o_custkey::varchar as custkey, epoch(o_orderdate::timestamp)::bigint as t, {target} as target, l_partkey::varchar as item from lineitem join orders on o_orderkey = l_orderkey where {cond}
), m as (select *, case when t - lag(t) over (partition by custkey order by t) <= {gap} then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by custkey order by t rows unbounded preceding) as k from m),
{taken}
select distinct a.custkey, a.session_start, {'a.target, ' if target != "''" else ''}a.item as a, b.item as b from c a join c b on a.custkey = b.custkey and a.k = b.k and a.target = b.target and a.item < b.item
"""


SQL = {
    "command_items": f"with {_LOGGED} select user_id, cmd_id, cmd, time, object_id, target_id from li",
    "command_moves": f"with {_LOGGED} select li.user_id, cmd_id, object_id, target_id, f.name as target_name from li left join {_FOLDERS} f on f.user_id = li.user_id and f.id = li.target_id where cmd in ('paste', 'move')",
    "command_objects": f"""
with {_LOGGED} select li.user_id, cmd_id, object_id, case when f.id is not null then 'file' when d.id is not null then 'folder' end as kind, case when f.id is not null then f.name else d.name end as name
from li left join {_FILES} f on f.user_id = li.user_id and f.id = li.object_id left join {_FOLDERS} d on d.user_id = li.user_id and d.id = li.object_id
""",
    "known_commands": f"""
with {_LOGGED} select user_id, cmd_id, cmd from li where exists (select 1 from {_FILES} f where f.user_id = li.user_id and f.id = li.object_id) or exists (select 1 from {_FOLDERS} f where f.user_id = li.user_id and f.id = li.object_id)
""",
    "new_folders": f"with {_LOGGED} select user_id, cmd_id, time, object_id from li where cmd = 'mkdir'",
    "files_as_of": _sql_replayed(f"where time <= {UNTIL}"),
    "files_now": _sql_replayed(""),
    "visible_files": f"select user_id, id, not coalesce(is_owner, false) as locked from {_sql_new('files')} where (created_time is null or created_time <= {UNTIL}) and not coalesce(trashed, false)",
    "last_touches": f"""
with {_LOGGED}, t as (select user_id, object_id, max(time) as t from li group by all)
select f.user_id, f.id, coalesce(t, 0)::bigint as last_touch from {_sql_new('files')} f left join t on t.user_id = f.user_id and t.object_id = f.path_hash
""",
    "moved_together": _sql_together("true", "l_suppkey::varchar", MOVES_S),
    "removed_together": _sql_together("l_returnflag = 'R'", "''", REMOVALS_S, 1000),
    "pair_lookup": f"""
with s as (select user_id, file_id_a, file_id_b from {_SQL_PAIRS} where user_id is not null),
l as (select user_id, file_id_b as a, file_id_a as b from s qualify row_number() over (partition by user_id order by file_id_a, file_id_b) = 1)
select s.user_id, file_id_a, file_id_b, file_id_a = a and file_id_b = b as as_given from s join l on l.user_id = s.user_id and (file_id_a = a and file_id_b = b or file_id_a = b and file_id_b = a)
""",
    "command_batches": f"""
with {_LOG} select user_id, cmd_id as rand_id, (row_number() over (partition by user_id order by time, cmd_id) - 1) // 25 as batch, (time - min(time) over (partition by user_id)) // 60 as minutes from log where time <> 0
""",
    "merged_scores": f"""
with n as ({FILE_SQL['pair_scores']}), o as (select * from {_SQL_PAIRS})
select o.user_id, o.file_id_a, o.file_id_b, {', '.join(f"coalesce(n.pred, o.{a}_pred) as {a}_pred, coalesce(n.p, case when not isnan(o.{a}_true_cert) then o.{a}_true_cert end) as {a}_true_cert" for a in ('find', 'move', 'del'))}
from o left join n on n.user_id = o.user_id and n.file_id_a = o.file_id_a and n.file_id_b = o.file_id_b
""",
    "upserted_files": f"select user_id, id, name, error from {_sql_new('files')} where user_id is not null and id is not null",
    "ranked_scores": f"""
with n as ({FILE_SQL['pair_scores']}), b as (select user_id, file_id_a as file_id, file_id_b as other_id, pred, p from n union all select user_id, file_id_b, file_id_a, pred, p from n)
select *, row_number() over (partition by user_id, file_id order by pred desc, p desc, other_id) as place from b where user_id is not null
""",
}
