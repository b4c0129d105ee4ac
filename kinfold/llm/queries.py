"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.groups import consolidate
from kinfold.llm.leakage import leaks
from kinfold.llm.packing import pack
from kinfold.llm.subsequences import frequent_subsequences
from kinfold.llm.topn import top_n
from kinfold.llm.truncation import truncated
from kinfold.operators.versions import newest
from kinfold.sources.tables import table
from kinfold.storage import Scratch


def _no_time() -> F.Column:
    return F.lit("0001-01-01").cast("timestamp_ntz")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every file that a positive pair links; of versions that tie for the newest, a positive one counts."""
    simils = table(spark, folder, "simils").where("file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b and user_id is not null")
    at = F.coalesce("ingested_at", _no_time())
    newest = simils.groupBy("user_id", "file_id_a", "file_id_b").agg(F.max(at).alias("last"), F.max(F.when(F.col("move_pred"), at)).alias("last_true"))
    pairs = newest.where("last_true = last").select(F.col("user_id").alias("scope"), F.col("file_id_a").alias("a"), F.col("file_id_b").alias("b"))
    found = consolidate(pairs, Scratch(spark, "p1"))
    return found.select(F.col("scope").alias("user_id"), F.col("id").alias("file_id"), "group_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three partners of the highest move_cert of every user's file_id_a."""
    simils = table(spark, folder, "simils").where("file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b and user_id is not null")
    version = F.struct(F.coalesce("ingested_at", _no_time()).alias("at"), F.col("move_cert").alias("m"), F.col("del_cert").alias("d"))
    newest = simils.groupBy("user_id", "file_id_a", "file_id_b").agg(F.max(version).alias("v"))
    # adding 0.0 turns -0.0 into 0.0; NaN is greater than 1
    scored = newest.where("v.m between 0 and 1").select(
        "user_id", "file_id_a", "file_id_b", (F.col("v.m") + 0.0).alias("m"), F.when(F.col("v.d").between(0, 1), F.col("v.d") + 0.0).otherwise(-1.0).alias("d")
    )
    scratch = Scratch(spark, "p5")
    # the range sort looks at its input twice, for the limits and for the rows
    scored = scratch.cut(scored, "scored")
    best = top_n(scored, ["user_id", "file_id_a"], [F.col("m").desc(), F.col("d").desc(), F.col("file_id_b").asc()], 3, scratch)
    return best.select("user_id", "file_id_a", F.col("place").cast("int").alias("place"), "file_id_b")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of 3 to 5 commands that at least 40 % of the users go through."""
    commands = newest(table(spark, folder, "command_history"), ["user_id", "rand_id"], columns=["time_run", "cmd"])
    item = F.lower(F.regexp_replace("cmd", r"^\s+|\s+$", ""))
    events = commands.where("time_run <> 0").select(F.col("user_id").alias("entity"), item.alias("item"), F.col("time_run").alias("time"), F.col("rand_id").alias("tie"))
    return frequent_subsequences(events.where("item <> ''"), "2/5", (3, 5), Scratch(spark, "p4"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their containers of 2,048 tokens."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return pack(documents, 2048, Scratch(spark, "p7")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a stretch of an evaluation item."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")
    return leaks(documents, items, Scratch(spark, "p8"))


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return truncated(documents, Scratch(spark, "p9"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _truncated(spark, folder).select(F.col("id").alias("doc_id"))


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each source were cut off, and where."""
    found = _truncated(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_cut"), *(F.sum((F.col("reason") == r).cast("long")).alias(f"n_{r}") for r in ("mark", "line", "word", "sentence"))
    )
    texts = table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    joined = texts.join(found.withColumnRenamed("source", "f_source"), F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source")
    return joined.fillna(0, ["n_cut", "n_mark", "n_line", "n_word", "n_sentence"])


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p7_containers": p7_containers, "p8_found": p8_found, "p9_found": p9_found, "p9_sources": p9_sources}

SQL = {
    "p1_found": """
with recursive v as (
  select user_id, file_id_a as a, file_id_b as b, move_pred from simils
  where file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b
  qualify row_number() over (partition by user_id, file_id_a, file_id_b order by ingested_at desc) = 1
), e as (
  select user_id, a, b from v where move_pred union select user_id, b, a from v where move_pred
), r(user_id, file_id, other) as (
  select user_id, a, b from e union select r.user_id, r.file_id, e.b from r join e on e.user_id = r.user_id and e.a = r.other
)
select user_id, file_id, least(file_id, min(other)) as group_id from r group by user_id, file_id
""",
    "p4_found": """
with recursive v as (
  select user_id, rand_id, time_run, lower(regexp_replace(cmd, '^\\s+|\\s+$', '', 'g')) as cmd from command_history
  qualify row_number() over (partition by user_id, rand_id order by ingested_at desc) = 1
), s as (
  select user_id, cmd, row_number() over (partition by user_id order by time_run, rand_id) as k from v
  where time_run is not null and time_run <> 0 and cmd is not null and cmd <> ''
), firsts as (
  select a.user_id, a.k, b.cmd, min(b.k) as nk from (select user_id, k from s union all select distinct user_id, 0 from s) a
  join s b on a.user_id = b.user_id and b.k > a.k group by all
), p(user_id, pattern, k, n) as (
  select user_id, cmd, nk, 1 from firsts where k = 0
  union all
  select p.user_id, p.pattern || '>' || f.cmd, f.nk, p.n + 1 from p join firsts f on f.user_id = p.user_id and f.k = p.k where p.n < 5
)
select pattern, count(*)::bigint as support from p where n >= 3 group by pattern
having count(*) * 5 >= 2 * (select count(distinct user_id) from s)
""",
    "p5_found": """
with v as (
  select user_id, file_id_a, file_id_b, move_cert, del_cert from simils
  where file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b
  qualify row_number() over (partition by user_id, file_id_a, file_id_b order by ingested_at desc) = 1
), r as (
  select user_id, file_id_a, file_id_b, row_number() over (partition by user_id, file_id_a
    order by move_cert desc, case when not isnan(del_cert) and del_cert between 0 and 1 then del_cert else -1 end desc, file_id_b) as place
  from v where not isnan(move_cert) and move_cert between 0 and 1
)
select user_id, file_id_a, place::integer as place, file_id_b from r where place <= 3
""",
}
