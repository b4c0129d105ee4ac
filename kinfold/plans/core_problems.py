"""Queries of the general data problems (sessions, orphan references, hierarchies) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.hierarchy import hierarchy
from kinfold.operators.orphans import faulty_references, target_states
from kinfold.operators.sessions import sessions
from kinfold.operators.versions import newest
from kinfold.sources.tables import table
from kinfold.storage import Scratch

SESSION_GAP_S = 1800


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user's commands; the table takes them in three batches, in order of arrival."""
    commands = newest(table(spark, folder, "command_history"), ["user_id", "rand_id"], columns=["time_run"])
    events = commands.where("time_run is not null and time_run <> 0").select(
        F.concat(F.lit("u"), "user_id").alias("key"), F.col("time_run").alias("time"), "ingested_at"
    )
    found = sessions(events, SESSION_GAP_S)
    return found.select(F.expr("substr(key, 2)").alias("user_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("n").alias("n_events"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of files, commands and pairs to folders, recommendations and files that are at fault."""
    files, commands, simils = (table(spark, folder, t) for t in ("files", "command_history", "simils"))
    folders, recommends = table(spark, folder, "folders"), table(spark, folder, "recommends")
    columns = ["ref_table", "kind", "scope", "row_id", "key", "at"]

    def rows(df: DataFrame, ref_table: str, kind: str, row_id: str, key: str) -> DataFrame:
        return df.select(F.lit(ref_table).alias("ref_table"), F.lit(kind).alias("kind"), F.col("user_id").alias("scope"), F.col(row_id).alias("row_id"), F.col(key).alias("key"), F.col("ingested_at").alias("at")).select(*columns)

    of_files = rows(newest(files, ["user_id", "id"], columns=["rand_id", "parent_id"]), "files", "folders", "rand_id", "parent_id")
    of_commands = rows(newest(commands, ["user_id", "rand_id"], columns=["rec_result_id"]), "command_history", "recommends", "rand_id", "rec_result_id")
    pairs = simils.where("file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b")
    pairs = pairs.groupBy("user_id", "file_id_a", "file_id_b").agg(F.max("ingested_at").alias("ingested_at"))
    of_pairs = rows(pairs, "simils", "files", "file_id_b", "file_id_a")
    refs = of_files.unionByName(of_commands).unionByName(of_pairs).where("key is not null and key not in ('', 'root')")
    targets = target_states(folders, "folders", "user_id", "id", "trashed", "ingested_at")
    targets = targets.unionByName(target_states(recommends, "recommends", "user_id", "rand_id", "deleted", "ingested_at"))
    targets = targets.unionByName(target_states(files, "files", "user_id", "id", "trashed", "ingested_at"))
    found = faulty_references(refs, targets, Scratch(spark, "p3"))
    period = F.concat(F.lpad(F.year("at").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month("at").cast("string"), 2, "0"))
    return found.select("ref_table", F.col("scope").alias("user_id"), "row_id", F.col("key").alias("ref_id"), "reason", period.alias("period"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty references per table, month and reason."""
    return p3_found(spark, folder).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root, descendants and state of every folder."""
    folders = newest(table(spark, folder, "folders"), ["user_id", "id"], columns=["parent_id", "name"])
    files = newest(table(spark, folder, "files"), ["user_id", "id"], columns=["parent_id"])
    parent = F.when(~F.col("parent_id").isin("", "root"), F.col("parent_id")).alias("parent")
    nodes = folders.select(F.col("user_id").alias("scope"), "id", parent, "name")
    items = files.where("id is not null").select(F.col("user_id").alias("scope"), F.col("parent_id").alias("parent"))
    found = hierarchy(nodes, items, Scratch(spark, "p6"))
    return found.select(
        F.col("scope").alias("user_id"), F.col("id").alias("folder_id"), "state", "root_id", "depth", F.col("n_nodes").alias("n_folders"), F.col("n_items").alias("n_files"), "full_path"
    )


_P3 = """
with fi as (
  select user_id, id, rand_id, parent_id, ingested_at from files qualify row_number() over (partition by user_id, id order by ingested_at desc) = 1
), ch as (
  select user_id, rand_id, rec_result_id, ingested_at from command_history qualify row_number() over (partition by user_id, rand_id order by ingested_at desc) = 1
), si as (
  select user_id, file_id_a, file_id_b, max(ingested_at) as ingested_at from simils
  where file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b group by all
), refs as (
  select 'files' as ref_table, user_id, rand_id as row_id, parent_id as ref_id, ingested_at from fi
  union all select 'command_history', user_id, rand_id, rec_result_id, ingested_at from ch
  union all select 'simils', user_id, file_id_b, file_id_a, ingested_at from si
), t as (
  select 'files' as ref_table, user_id, id, min(ingested_at) as first, arg_max(trashed, ingested_at) as dead from folders group by all
  union all select 'command_history', user_id, rand_id, min(ingested_at), arg_max(deleted, ingested_at) from recommends group by all
  union all select 'simils', user_id, id, min(ingested_at), arg_max(trashed, ingested_at) from files group by all
), j as (
  select r.ref_table, r.user_id, r.row_id, r.ref_id, strftime(r.ingested_at, '%Y-%m') as period,
    case when t.id is null then 'missing' when t.dead then 'deleted' when t.first > r.ingested_at then 'late' end as reason
  from refs r left join t on t.ref_table = r.ref_table and t.user_id = r.user_id and t.id = r.ref_id
  where r.ref_id is not null and r.ref_id not in ('', 'root') and r.user_id is not null
)
select ref_table, user_id, row_id, ref_id, reason, period from j where reason is not null
"""

SQL = {
    "p2_found": """
with v as (
  select user_id, rand_id, time_run, row_number() over (partition by user_id, rand_id order by ingested_at desc) as rn from command_history
), e as (
  select user_id, time_run as t from v where rn = 1 and time_run is not null and time_run <> 0 and user_id is not null
), m as (
  select user_id, t, case when t - lag(t) over (partition by user_id order by t) <= 1800 then 0 else 1 end as fresh from e
), s as (
  select user_id, t, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as k from m
)
select user_id, min(t)::bigint as start_time, max(t)::bigint as end_time, count(*)::bigint as n_events from s group by user_id, k
""",    "p3_found": _P3,
    "p3_counts": f"select ref_table, period, reason, count(*)::bigint as n from ({_P3}) group by all",
    "p6_found": """
with recursive fo as (
  select user_id, id, name, case when parent_id in ('', 'root') then null else parent_id end as parent_id from folders
  where user_id is not null and id is not null
  qualify row_number() over (partition by user_id, id order by ingested_at desc) = 1
), fi as (
  select user_id, id, parent_id from files where id is not null qualify row_number() over (partition by user_id, id order by ingested_at desc) = 1
), n as (
  select a.user_id, a.id, coalesce(a.name, '') as name, b.id as parent from fo a left join fo b on a.user_id = b.user_id and a.parent_id = b.id
), up(user_id, id, anc) as (
  select user_id, id, parent from n where parent is not null
  union
  select up.user_id, up.id, n.parent from up join n on n.user_id = up.user_id and n.id = up.anc where n.parent is not null
), tree(user_id, id, root_id, depth, full_path) as (
  select user_id, id, id, 0::bigint, '/' || name from n where parent is null
  union all
  select n.user_id, n.id, t.root_id, t.depth + 1, t.full_path || '/' || n.name from tree t join n on n.user_id = t.user_id and n.parent = t.id
), own as (
  select user_id, parent_id as id, count(*) as k from fi group by all
), below as (
  select up.user_id, up.anc as id, count(*) as n_folders, sum(coalesce(own.k, 0)) as under
  from up left join own on own.user_id = up.user_id and own.id = up.id group by all
), ring as (
  select user_id, id from up where id = anc
)
select n.user_id, n.id as folder_id, case when t.id is not null then 'tree' when r.id is not null then 'cycle' else 'under_cycle' end as state,
  coalesce(t.root_id, '') as root_id, coalesce(t.depth, -1) as depth,
  (case when t.id is null then -1 else coalesce(b.n_folders, 0) end)::bigint as n_folders,
  (case when t.id is null then -1 else coalesce(o.k, 0) + coalesce(b.under, 0) end)::bigint as n_files,
  coalesce(t.full_path, '') as full_path
from n left join tree t on t.user_id = n.user_id and t.id = n.id left join ring r on r.user_id = n.user_id and r.id = n.id
left join below b on b.user_id = n.user_id and b.id = n.id left join own o on o.user_id = n.user_id and o.id = n.id
""",
}

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_counts": p3_counts, "p6_found": p6_found}
