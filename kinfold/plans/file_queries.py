"""Queries on files, folders, pairs, commands and recommendations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import kinds, measures, text
from kinfold.operators import explain, pairs, rules, states
from kinfold.operators.comanage import comanaged
from kinfold.operators.hierarchy import resolve
from kinfold.operators.places import first_rows, places
from kinfold.operators.sessions import sessions
from kinfold.operators.versions import newest
from kinfold.sources.tables import table
from kinfold.storage import Scratch

KEYS = {"files": ["user_id", "id"], "folders": ["user_id", "id"], "command_history": ["user_id", "rand_id"], "recommends": ["user_id", "rand_id"], "simils": ["user_id", "file_id_a", "file_id_b"]}
AS_OF = "2016-02-01 00:00:00"

# weights stand in for trained ones, which no public file has; the sources of a score are data, not code
COEFFICIENTS = {
    "all_other": {"bin_simil": 2.0, "perm_simil": 0.6, "tree_dist": 1.8, "size_dist": 0.4, "bigram_simil": 2.4, "last_mod_simil": 0.9},
    "image": {"color_sim": 0.7, "obj_sim": 1.1, "bin_simil": 1.5, "perm_simil": 0.5, "tree_dist": 2.0, "size_dist": 0.3, "bigram_simil": 2.2, "last_mod_simil": 1.2},
    "text": {"tfidf_sim": 2.5, "word_vec_sim": 0.8, "bin_simil": 1.2, "perm_simil": 0.4, "tree_dist": 1.6, "size_dist": 0.2, "bigram_simil": 2.1, "last_mod_simil": 0.7},
}
INTERCEPTS = {"all_other": -4.0, "image": -4.5, "text": -4.2}


def _new(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    return newest(table(spark, folder, name), KEYS[name], columns=columns)


def _sql_new(name: str) -> str:
    return f"(select * from {name} qualify row_number() over (partition by {', '.join(KEYS[name])} order by ingested_at desc) = 1)"


def _pairs(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    some = _new(spark, folder, "simils", columns)
    return some.where("file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b")


_SQL_PAIRS = f"(select * from {_sql_new('simils')} where file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b)"


def file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of every file by its extension and by its name, and gates for text, image and table steps."""
    files = _new(spark, folder, "files", ["name", "file_extension"])
    kind = kinds.kind(F.lower("file_extension"))
    return files.select("user_id", "id", kind.alias("kind"), kinds.name_kind(F.col("name")).alias("name_kind"), (kind == "text").alias("is_text"), (kind == "image").alias("is_image"), (kind == "spreadsheet").alias("is_table"))


def _sql_in(column: str, exts: str) -> str:
    return f"{column} in ({', '.join(repr(e) for e in exts.split())})"


_SQL_KIND = "case " + " ".join(f"when {_sql_in('lower(file_extension)', e)} then '{k}'" for k, e in reversed(kinds.KINDS.items())) + " else 'other' end"
_SQL_NAME_KIND = (
    "case when name is null or contains(list_extract(string_split(lower(name), '/'), -1), '~') or contains(list_extract(string_split(lower(name), '/'), -1), '$') "
    "or not contains(name, '.') or name like '.%' or len(string_split(name, '.')) > 14 then 'other' "
    + " ".join(f"when {_sql_in('list_extract(string_split(lower(name), chr(46)), -1)', e)} then '{k}'" for k, e in kinds.NAME_KINDS.items())
    + " else 'other' end"
)


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """What the string functions make of every file's name and size."""
    n = F.col("name")
    return _new(spark, folder, "files", ["name", "size"]).select(
        "user_id",
        "id",
        text.trunc(n, 12).alias("short"),
        text.short_hash(F.concat_ws("/", "user_id", "id")).alias("hash"),
        text.copy_name(n).alias("copy"),
        text.extension(n).alias("ext"),
        F.size(text.ngrams(F.lower(n))).alias("n_bigrams"),
        F.array_join(text.name_tokens(n), "|").alias("tokens"),
        F.array_join(text.prefixes(n, 2, 6), "|").alias("prefixes"),
        text.clean_header(n).alias("header"),
        text.natural_key(n).alias("natural_key"),
        F.coalesce(text.size_text(F.col("size").cast("double")), F.lit("?")).alias("size_text"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every live folder and file in its parent's listing: folders first, names in natural order."""
    columns = ["name", "parent_id", "trashed", "size", "is_owner"]
    folders = _new(spark, folder, "folders", columns).withColumn("is_dir", F.lit(1))
    files = _new(spark, folder, "files", columns).withColumn("is_dir", F.lit(0))
    rows = folders.unionByName(files).where("not trashed and user_id is not null and id is not null")
    rows = rows.select("user_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "id", "is_dir", F.coalesce(text.natural_key(F.col("name")), F.lit("")).alias("key"), F.coalesce("is_owner", F.lit(False)).alias("can_write"))
    placed = places(rows, ["user_id", "parent_id"], [F.col("is_dir").desc(), F.col("key").asc(), F.col("id").asc()], Scratch(spark, "listing"))
    return placed.select("user_id", "parent_id", "id", "is_dir", "can_write", "place")


def folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Live files, their bytes, and live subfolders of every live folder."""
    folders = _new(spark, folder, "folders", ["parent_id", "trashed"]).where("not trashed and id is not null")
    files = _new(spark, folder, "files", ["parent_id", "trashed", "size"]).where("not trashed")
    n_files = files.groupBy("user_id", F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    n_subs = folders.groupBy("user_id", F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_subfolders"))
    out = folders.select("user_id", "id").join(n_files, ["user_id", "id"], "left").join(n_subs, ["user_id", "id"], "left")
    return out.select("user_id", "id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_files", "bytes", "n_subfolders")))


def subtree_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of the live files at any depth below every folder that leads to a root."""
    folders = _new(spark, folder, "folders", ["parent_id", "name"]).where("user_id is not null and id is not null")
    nodes = folders.select(F.col("user_id").alias("scope"), "id", F.col("parent_id").alias("parent"), "name")
    scratch = Scratch(spark, "sizes")
    tree, _ = resolve(nodes, scratch)
    files = _new(spark, folder, "files", ["parent_id", "trashed", "size"]).where("not trashed")
    own = files.groupBy(F.col("user_id").alias("scope"), F.col("parent_id").alias("id")).agg(F.sum("size").alias("own"))
    tree = scratch.cut(tree.select("scope", "id", F.concat("ancestors", F.array("id")).alias("up")).join(own, ["scope", "id"], "left"), "tree")
    sums = tree.select("scope", F.explode("up").alias("id"), "own").groupBy("scope", "id").agg(F.sum("own").alias("bytes"))
    return sums.select(F.col("scope").alias("user_id"), "id", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def pair_names(spark: SparkSession, folder: str) -> DataFrame:
    """Features of all listed pairs from names, paths, sizes and times."""
    files = _new(spark, folder, "files", ["name", "size", "last_modified", "path"])
    return pairs.name_features(_pairs(spark, folder, ["find_pred"]), files)


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all pairs from their stored features, and the two features that weigh most."""
    features = sorted({f for fs in measures.FEATURES.values() for f in fs})
    ext = lambda c: F.regexp_extract(c, r"\.([^.]*)$", 1)
    some = _pairs(spark, folder, ["filename_a", "filename_b", *features]).withColumns({"ext_a": ext("filename_a"), "ext_b": ext("filename_b")})
    out = pairs.scores(some, COEFFICIENTS, INTERCEPTS)
    return out.select("user_id", "file_id_a", "file_id_b", "kind", F.round("p", 6).alias("p"), "pred", F.round("cert", 6).alias("cert"), "top_feat", "second_feat")


def _sql_scaled(name: str) -> str:
    x = f"case when not isnan({name}) then {name}::double end"
    x = f"ln(1 + {x})" if name in measures.LOGARITHMS else x
    # least and greatest of SQL leave nulls out
    x = f"case when ({x}) is not null then least(greatest({x}, 0.0::double), {measures.FEATURE_MAX[name]}::double) / {measures.FEATURE_MAX[name]}::double end"
    return f"abs(1 - {x})" if name in measures.DISTANCES else x


def _sql_scores() -> str:
    parts = []
    for kind, features in measures.FEATURES.items():
        terms = [(f, f"(({_sql_scaled(f)}) * {COEFFICIENTS[kind][f]}::double)") for f in features]
        z = " + ".join([f"{INTERCEPTS[kind]}::double", *(t for _, t in terms)])
        ranked = ", ".join(f"{{'w': -round(abs({t}), 9), 'f': '{f}'}}" for f, t in terms)
        parts.append(f"select user_id, file_id_a, file_id_b, kind, 1 / (1 + exp(-({z}))) as p, list_sort([{ranked}]) as r from k where kind = '{kind}' and ({z}) is not null")
    kind = _SQL_KIND.replace("file_extension", "regexp_extract(filename_{}, '\\.([^.]*)$', 1)")
    a, b = kind.replace("{}", "a"), kind.replace("{}", "b")
    return f"""
with k as (
  select *, case when ({a}) = 'image' and ({b}) = 'image' then 'image' when ({a}) = 'text' and ({b}) = 'text' then 'text' else 'all_other' end as kind from {_SQL_PAIRS}
), s as ({' union all '.join(parts)})
select user_id, file_id_a, file_id_b, kind, round(p, 6) as p, p > 0.65 as pred, round(greatest(p, 1 - p), 6) as cert, r[1].f as top_feat, r[2].f as second_feat from s
"""


def pair_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Positive and nearly positive partners of every file, a pair given both ways round counted once."""
    some = pairs.canonical(_pairs(spark, folder, ["find_pred", "find_cert"]), "file_id_a", "file_id_b")
    once = some.groupBy("user_id", "file_id_a", "file_id_b").agg(F.max("find_pred").alias("positive"), F.max(measures.near_miss(F.col("find_cert"))).alias("near"))
    both = pairs.neighbours(once, ["positive", "near"])
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return both.groupBy("user_id", "file_id").agg(count("positive").alias("n_positive"), count("near").alias("n_near"), F.count(F.lit(1)).alias("n_pairs"))


def listing_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Live files added, removed or changed between a past time and the end."""
    columns = ["name", "parent_id", "size", "trashed"]
    files = table(spark, folder, "files").where("user_id is not null and id is not null")
    old = states.as_of(files, KEYS["files"], AS_OF, columns).where("not trashed")
    new = newest(files, KEYS["files"], columns=columns).where("not trashed")
    return states.difference(old, new, KEYS["files"], ["name", "parent_id", "size"])


def command_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's commands that change something, numbered in the order in which they are replayed."""
    commands = _new(spark, folder, "command_history", ["time_run", "cmd", "old_name", "new_name"])
    cmd = F.lower(F.regexp_replace("cmd", r"^\s+|\s+$", ""))
    rows = commands.where("time_run <> 0").select("user_id", "time_run", "rand_id", cmd.alias("cmd"), "old_name", "new_name").where("cmd not in ('', 'open', 'find')")
    said = F.when(F.col("cmd") == "rename", F.concat(F.lit("rename "), F.coalesce("old_name", F.lit("?")), F.lit(" to "), F.coalesce("new_name", F.lit("?")))).otherwise(F.col("cmd"))
    placed = places(rows.select("user_id", "time_run", "rand_id", "cmd", said.alias("entry")), ["user_id"], ["time_run", "rand_id"], Scratch(spark, "plan"))
    return placed.select("user_id", "place", "rand_id", "cmd", "entry", F.date_format(F.timestamp_seconds("time_run"), "yyyy-MM-dd HH:mm:ss").alias("at"))


def command_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The last header given up to every command of a user."""
    commands = _new(spark, folder, "command_history", ["time_run", "assoc_header"]).where("user_id is not null and time_run <> 0")
    out = states.carried(commands.select("user_id", "rand_id", "time_run", "assoc_header"), "user_id", "time_run", "rand_id", "assoc_header")
    return out.select("user_id", "rand_id", F.col("carried").alias("header"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the event stream's users, at pauses of more than half an hour."""
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.col("ts").alias("arrived"))
    found = sessions(events, 1800, "arrived")
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("n").alias("n_events"))


def event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events of one kind in one session of a user."""
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.col("event_type").alias("target"), F.col("event_id").cast("string").alias("item")
    )
    found = comanaged(events, 1800, Scratch(spark, "pairs"))
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("target").alias("event_type"), "a", "b")


def unaccepted(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations that were sent and not accepted, of files of which none was accepted."""
    recs = _new(spark, folder, "recommends", ["rec_path_hash", "sent", "accepted", "action"]).where("rec_path_hash is not null")
    taken = recs.where("accepted").select("user_id", "rec_path_hash").distinct()
    return recs.where("sent and not accepted").join(taken, ["user_id", "rec_path_hash"], "left_anti").select("user_id", "rand_id", "rec_path_hash", "action")


def best_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Of every file's recommendations the one of the greatest strength times what remains, the rest marked."""
    recs = _new(spark, folder, "recommends", ["rec_path_hash", "strength", "num_remain", "action"]).where("user_id is not null and rec_path_hash is not null")
    score = F.round(F.coalesce(measures.number_or_null(F.col("strength")) * F.col("num_remain"), F.lit(-1.0)), 9)
    placed = places(recs.select("user_id", "rec_path_hash", "rand_id", "action", score.alias("score")), ["user_id", "rec_path_hash"], [F.col("score").desc(), F.col("rand_id").asc()], Scratch(spark, "recs"))
    return placed.select("user_id", "rec_path_hash", "rand_id", "action", "score", (F.col("place") == 1).alias("first"))


def action_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations, faded and accepted ones by action and month."""
    recs = _new(spark, folder, "recommends", ["action", "faded", "accepted", "timestamp"])
    month = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(f"n_{c}")
    return recs.groupBy("action", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), one("faded"), one("accepted"))


def token_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For every folder of a user, the name token that tells its files best from the user's others."""
    files = _new(spark, folder, "files", ["name", "parent_id"]).where("user_id is not null and parent_id is not null and name is not null")
    rows = files.select(F.col("user_id").alias("scope"), F.col("parent_id").alias("grp"), "id", text.name_tokens(F.col("name")).alias("tokens"))
    return rules.token_rules(rows).withColumnsRenamed({"scope": "user_id", "grp": "parent_id"})


def range_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For every folder of a user, the range of modification times, and how well it tells its files."""
    files = _new(spark, folder, "files", ["parent_id", "last_modified"])
    rows = files.select(F.col("user_id").alias("scope"), F.col("parent_id").alias("grp"), F.col("last_modified").alias("value"))
    return rules.range_rules(rows, Scratch(spark, "ranges")).withColumnsRenamed({"scope": "user_id", "grp": "parent_id"})


def strata_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty pairs of each combination of predictions, drawn by hash."""
    some = _pairs(spark, folder, ["find_pred", "move_pred"]).where("user_id is not null")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    h = F.sha2(F.concat_ws("|", "user_id", "file_id_a", "file_id_b"), 256)
    rows = some.select(F.concat_ws("/", said("find_pred"), said("move_pred")).alias("stratum"), h.alias("h"), "user_id", "file_id_a", "file_id_b")
    return first_rows(rows, ["stratum"], ["h"], 20).drop("h")


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the files' JSON columns; null where a column isn't JSON or has no such field."""
    files = _new(spark, folder, "files", ["media_info", "doc_metadata"])
    number = lambda c, p: F.get_json_object(c, p).cast("long")
    return files.select("user_id", "id", number("media_info", "$.width").alias("width"), number("media_info", "$.height").alias("height"), number("doc_metadata", "$.pages").alias("pages"))


def ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Every folder's ancestors with their level, 1 for the parent; of folders that lead to a root."""
    folders = _new(spark, folder, "folders", ["parent_id", "name"])
    tree, _ = resolve(folders.where("user_id is not null and id is not null").select(F.col("user_id").alias("scope"), "id", F.col("parent_id").alias("parent"), "name"), Scratch(spark, "ancestors"))
    each = tree.select("scope", "id", F.size("ancestors").alias("n"), F.posexplode("ancestors").alias("i", "ancestor_id"))
    return each.select(F.col("scope").alias("user_id"), "id", "ancestor_id", (F.col("n") - F.col("i")).alias("level"))


def folder_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kind that all files of a folder have, or 'mixed'."""
    files = _new(spark, folder, "files", ["parent_id", "file_extension"]).where("user_id is not null and parent_id is not null")
    kind = kinds.kind(F.lower("file_extension"))
    both = files.groupBy("user_id", "parent_id").agg(F.min(kind).alias("a"), F.max(kind).alias("b"), F.count(F.lit(1)).alias("n"))
    return both.select("user_id", "parent_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("kind"), "n")


def token_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The greedy rule of name tokens of every folder's files, among all files of the user."""
    files = _new(spark, folder, "files", ["name", "parent_id"])
    rows = files.select(F.col("user_id").alias("scope"), F.col("parent_id").alias("grp"), F.col("id").alias("item"), text.name_tokens(F.col("name")).alias("tokens"))
    return explain.token_sets(rows, Scratch(spark, "sets")).withColumnsRenamed({"scope": "user_id", "grp": "parent_id"})


def pair_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level trees that tell each user's positive pairs by their features, made from a bounded sample and counted over all pairs."""
    features = ["bigram_simil", "tree_dist", "bin_simil"]
    some = _pairs(spark, folder, ["move_pred", *features])
    rows = some.select(F.col("user_id").alias("scope"), F.concat_ws("|", "file_id_a", "file_id_b").alias("item"), F.col("move_pred").alias("label"), *features)
    return explain.leaves(rows, features, Scratch(spark, "trees")).withColumnRenamed("scope", "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        file_kinds, file_names, listing, folder_counts, subtree_sizes, pair_names, pair_scores, pair_degrees, listing_changes, command_plan,
        command_headers, event_sessions, event_pairs, unaccepted, best_recommendations, action_counts, token_rules, range_rules, strata_sample, json_fields,
        ancestors, folder_kinds, token_sets, pair_trees,
    )
}

_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: case when regexp_full_match(p, '[0-9]+') then lpad(p, 20, '0') else p end), '')"
_BALANCED = "case when abs(rec) <= 1e-8 or abs(prec) <= 1e-8 then 0.0 else 1 / (0.25 / rec + 0.75 / prec) end"
_BIGRAMS = "case when length(x) >= 2 then list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) else [] end"
_JACCARD = "coalesce(case when len(list_distinct(list_concat(p, q))) = 0 then 0.0 else len(list_intersect(p, q))::double / len(list_distinct(list_concat(p, q))) end, 0.0)"


def _over(template: str, **names: str) -> str:
    """A template with its one-letter names replaced."""
    import re

    return re.sub(r"\b([a-z])\b(?!')", lambda m: names.get(m[1], m[1]), template)


_EVENTS = """
e as (select user_id, event_id, event_type, epoch_us(ts) // 1000000 as t from events),
m as (select *, case when t - lag(t) over (partition by user_id order by t) <= 1800 then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as k from m)
"""

SQL = {
    "file_kinds": f"""
select user_id, id, {_SQL_KIND} as kind, {_SQL_NAME_KIND} as name_kind, ({_SQL_KIND}) = 'text' as is_text, ({_SQL_KIND}) = 'image' as is_image, ({_SQL_KIND}) = 'spreadsheet' as is_table
from {_sql_new('files')}
""",
    "file_names": f"""
select user_id, id, case when length(name) >= 12 then name[:12] || '...' else name end as short, sha256(user_id || '/' || id)[:32] as hash,
  case when contains(name, '.') then regexp_replace(name, '\\.([^.]*)$', '_copy.\\1') else name || '_copy' end as copy,
  case when contains(name, '.') then list_extract(string_split(name, '.'), -1) end as ext,
  len({_over(_BIGRAMS, x='lower(name)')})::integer as n_bigrams,
  array_to_string(regexp_split_to_array(lower(name), '[._~+ -]'), '|') as tokens,
  array_to_string(list_transform(range(2, least(length(name), 6) + 1), lambda i: lower(name)[:i]), '|') as prefixes,
  lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as header, {_NATURAL} as natural_key,
  coalesce(case when size = 0 then '---' when size <= 1000000 then format('{{:,.1f}}', size / 1e3) || ' Kb' when size <= 1000000000 then format('{{:,.1f}}', size / 1e6) || ' Mb'
    else format('{{:,.1f}}', size / 1e9) || ' Gb' end, '?') as size_text
from {_sql_new('files')}
""",
    "listing": f"""
with r as (
  select user_id, coalesce(parent_id, '') as parent_id, id, 1 as is_dir, name, coalesce(is_owner, false) as can_write from {_sql_new('folders')} where not trashed and id is not null
  union all select user_id, coalesce(parent_id, ''), id, 0, name, coalesce(is_owner, false) from {_sql_new('files')} where not trashed and id is not null
)
select user_id, parent_id, id, is_dir, can_write, row_number() over (partition by user_id, parent_id order by is_dir desc, coalesce({_NATURAL}, ''), id) as place from r where user_id is not null
""",
    "folder_counts": f"""
with fo as (select user_id, id, parent_id from {_sql_new('folders')} where not trashed and id is not null),
nf as (select user_id, parent_id as id, count(*) as n_files, sum(size) as bytes from {_sql_new('files')} where not trashed group by all),
ns as (select user_id, parent_id as id, count(*) as n_subfolders from fo group by all)
select fo.user_id, fo.id, coalesce(n_files, 0)::bigint as n_files, coalesce(bytes, 0)::bigint as bytes, coalesce(n_subfolders, 0)::bigint as n_subfolders
from fo left join nf on nf.user_id = fo.user_id and nf.id = fo.id left join ns on ns.user_id = fo.user_id and ns.id = fo.id
""",
    "subtree_sizes": f"""
with recursive fo as (select user_id, id, parent_id from {_sql_new('folders')} where user_id is not null and id is not null),
n as (select a.user_id, a.id, b.id as parent from fo a left join fo b on a.user_id = b.user_id and a.parent_id = b.id),
t(user_id, id, up) as (
  select user_id, id, [id] from n where parent is null
  union all select n.user_id, n.id, list_append(t.up, n.id) from t join n on n.user_id = t.user_id and n.parent = t.id
), own as (select user_id, parent_id as id, sum(size) as own from {_sql_new('files')} where not trashed group by all),
x as (select user_id, id as node, unnest(up) as id from t)
select x.user_id, x.id, coalesce(sum(own), 0)::bigint as bytes from x left join own on own.user_id = x.user_id and own.id = x.node group by all
""",
    "pair_names": f"""
with f as (select user_id, id, name, size, last_modified, string_split(path, '/')[:-2] as d from {_sql_new('files')}),
p as (
  select s.user_id, s.file_id_a, s.file_id_b, a.name as n1, b.name as n2, a.size as s1, b.size as s2, a.last_modified as t1, b.last_modified as t2, a.d as d1, b.d as d2
  from {_SQL_PAIRS} s join f a on a.user_id = s.user_id and a.id = s.file_id_a join f b on b.user_id = s.user_id and b.id = s.file_id_b
), g as (select *, {_over(_BIGRAMS, x='lower(n1)')} as b1, {_over(_BIGRAMS, x='lower(n2)')} as b2,
  list_distinct(regexp_split_to_array(lower(n1), '[._~+ -]')) as k1, list_distinct(regexp_split_to_array(lower(n2), '[._~+ -]')) as k2,
  len(list_filter(range(1, least(len(d1), len(d2)) + 1), lambda i: d1[:i] = d2[:i])) as shared from p)
select user_id, file_id_a, file_id_b, coalesce(levenshtein(n1, n2), 1000)::integer as edit_dist,
  round(case when n1 is null or n2 is null then 0.0 else {_over(_JACCARD, p='b1', q='b2')} end, 6) as bigram_simil,
  round(case when n1 is null or n2 is null then 0.0 else {_over(_JACCARD, p='k1', q='k2')} end, 6) as token_simil,
  (len(d1) + len(d2) - 2 * shared)::integer as tree_dist, abs(s1 - s2) as size_dist, abs(t1 - t2) as last_mod_dist
from g
""",
    "pair_scores": _sql_scores(),
    "pair_degrees": f"""
with c as (
  select user_id, least(file_id_a, file_id_b) as a, greatest(file_id_a, file_id_b) as b, max(find_pred) as positive,
    max(case when isnan(find_cert) then false else abs(coalesce(find_cert, 0) - 0.5) <= 0.1 + 1e-5 * 0.5 end) as near from {_SQL_PAIRS} group by all
), n as (select user_id, a as file_id, positive, near from c union all select user_id, b, positive, near from c)
select user_id, file_id, count(*) filter (positive)::bigint as n_positive, count(*) filter (near)::bigint as n_near, count(*)::bigint as n_pairs from n group by all
""",
    "listing_changes": f"""
with o as (
  select user_id, id, name, parent_id, size from (select * from files where ingested_at <= timestamp '{AS_OF}' qualify row_number() over (partition by user_id, id order by ingested_at desc) = 1)
  where not trashed and user_id is not null and id is not null
), n as (select user_id, id, name, parent_id, size from {_sql_new('files')} where not trashed and user_id is not null and id is not null)
select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change
from o full join n on n.user_id = o.user_id and n.id = o.id
where o.id is null or n.id is null or o.name is distinct from n.name or o.parent_id is distinct from n.parent_id or o.size is distinct from n.size
""",
    "command_plan": f"""
with c as (
  select user_id, time_run, rand_id, lower(regexp_replace(cmd, '^\\s+|\\s+$', '', 'g')) as cmd, old_name, new_name from {_sql_new('command_history')} where time_run <> 0
)
select user_id, row_number() over (partition by user_id order by time_run, rand_id) as place, rand_id, cmd,
  case when cmd = 'rename' then 'rename ' || coalesce(old_name, '?') || ' to ' || coalesce(new_name, '?') else cmd end as entry, strftime(make_timestamp(time_run * 1000000), '%Y-%m-%d %H:%M:%S') as at
from c where cmd not in ('', 'open', 'find')
""",
    "command_headers": f"""
select user_id, rand_id, last_value(assoc_header ignore nulls) over (partition by user_id order by time_run, rand_id rows unbounded preceding) as header
from {_sql_new('command_history')} where user_id is not null and time_run <> 0
""",
    "event_sessions": f"with {_EVENTS} select user_id, min(t)::bigint as start_time, max(t)::bigint as end_time, count(*)::bigint as n_events from s group by user_id, k",
    "event_pairs": f"""
with {_EVENTS},
n as (select user_id, count(distinct k) as n from s group by all),
r as (select s.*, n, row_number() over (partition by s.user_id, k order by sha256(event_id::varchar), event_id::varchar) as place from s join n on n.user_id = s.user_id),
c as (select user_id, k, event_type, event_id::varchar as item from r where place <= least(1000, greatest(1000 // n, 1)))
select distinct a.user_id, a.event_type, a.item as a, b.item as b from c a join c b on a.user_id = b.user_id and a.k = b.k and a.event_type = b.event_type and a.item < b.item
""",
    "unaccepted": f"""
with r as (select * from {_sql_new('recommends')} where rec_path_hash is not null)
select user_id, rand_id, rec_path_hash, action from r where sent and not accepted
  and not exists (select 1 from r x where x.accepted and x.user_id = r.user_id and x.rec_path_hash = r.rec_path_hash)
""",
    "best_recommendations": f"""
with r as (
  select user_id, rec_path_hash, rand_id, action, round(coalesce(case when not isnan(strength) then strength end * num_remain, -1.0), 9) as score
  from {_sql_new('recommends')} where user_id is not null and rec_path_hash is not null
)
select *, row_number() over (partition by user_id, rec_path_hash order by score desc, rand_id) = 1 as first from r
""",
    "action_counts": f"""
select action, strftime(make_timestamp("timestamp" * 1000000), '%Y-%m') as month, count(*)::bigint as n, count(*) filter (faded)::bigint as n_faded, count(*) filter (accepted)::bigint as n_accepted
from {_sql_new('recommends')} group by all
""",
    "token_rules": f"""
with f as (select user_id, parent_id, id, list_distinct(regexp_split_to_array(lower(name), '[._~+ -]')) as k from {_sql_new('files')} where user_id is not null and parent_id is not null and name is not null),
g as (select user_id, parent_id, count(*) as n_group from f group by all),
t as (select user_id, parent_id, token, count(*) as n_in from (select user_id, parent_id, unnest(k) as token from f) where token <> '' group by all),
u as (select user_id, token, sum(n_in) as n_all from t group by all),
r as (
  select t.user_id, t.parent_id, t.token, n_in, (n_all - n_in)::bigint as n_out, n_group, n_in / n_group as rec, n_in / (n_group + n_all - n_in) as prec
  from t join u on u.user_id = t.user_id and u.token = t.token join g on g.user_id = t.user_id and g.parent_id = t.parent_id
), s as (select *, round({_BALANCED}, 5) as score from r)
select user_id, parent_id, token, n_in, n_out, n_group, round(rec, 5) as recall, round(prec, 5) as precision, score from s
qualify row_number() over (partition by user_id, parent_id order by score desc, token) = 1
""",
    "range_rules": f"""
with f as (select user_id, parent_id, last_modified as v from {_sql_new('files')} where user_id is not null and parent_id is not null and last_modified is not null),
g as (select user_id, parent_id, min(v) as low, max(v) as high, count(*) as n_group from f group by all),
r as (
  select g.*, n_group as n_in, (select count(*) from f where f.user_id = g.user_id and f.v between g.low and g.high) - n_group as n_out, 1.0::double as rec from g
), s as (select *, n_in / (n_group + n_out) as prec from r)
select user_id, parent_id, low, high, n_in, n_out, n_group, round(rec, 5) as recall, round(prec, 5) as precision, round({_BALANCED}, 5) as score from s
""",
    "strata_sample": f"""
select coalesce(find_pred::varchar, 'none') || '/' || coalesce(move_pred::varchar, 'none') as stratum, user_id, file_id_a, file_id_b,
  row_number() over (partition by find_pred, move_pred order by sha256(user_id || '|' || file_id_a || '|' || file_id_b)) as place
from {_SQL_PAIRS} where user_id is not null qualify place <= 20
""",
    "ancestors": f"""
with recursive fo as (select user_id, id, parent_id from {_sql_new('folders')} where user_id is not null and id is not null),
n as (select a.user_id, a.id, b.id as parent from fo a left join fo b on a.user_id = b.user_id and a.parent_id = b.id),
t(user_id, id, up) as (
  select user_id, id, []::varchar[] from n where parent is null
  union all select n.user_id, n.id, list_prepend(t.id, t.up) from t join n on n.user_id = t.user_id and n.parent = t.id
)
select user_id, id, unnest(up) as ancestor_id, generate_subscripts(up, 1)::integer as level from t
""",
    "folder_kinds": f"""
select user_id, parent_id, case when min({_SQL_KIND}) = max({_SQL_KIND}) then min({_SQL_KIND}) else 'mixed' end as kind, count(*) as n
from {_sql_new('files')} where user_id is not null and parent_id is not null group by all
""",
    "json_fields": f"""
select user_id, id, (media_info->>'$.width')::bigint as width, (media_info->>'$.height')::bigint as height, (doc_metadata->>'$.pages')::bigint as pages from {_sql_new('files')}
""",
}
