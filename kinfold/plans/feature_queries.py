"""Queries on features, records, codes, groups and explanations, each with its SQL.

Where the tables have no column for an input, another stands in: pairs are a user's successive documents, labels and colours are made of parts'
names and keys, and word vectors count a word's documents by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import measures, records, text
from kinfold.operators import features, groups, rules, vectors
from kinfold.operators.hierarchy import positional_codes, resolve, siblings
from kinfold.operators.places import places
from kinfold.plans.file_queries import _BALANCED, _BIGRAMS, _new, _over, _pairs, _sql_new, _sql_scaled, _SQL_PAIRS
from kinfold.plans.file_queries import SQL as FILE_SQL
from kinfold.plans.text_queries import _NEXT, _WORDS
from kinfold.sources.content import header_row
from kinfold.sources.tables import table
from kinfold.storage import Scratch

LEAST_GROUP = 3


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "user_id", "text")


def _next_of(spark: SparkSession, documents: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(doc_id, next_id, va, vb): a value (doc_id, column) of every document and of the user's next one."""
    following = vectors.successors(documents, "user_id", "doc_id", Scratch(spark, "next"))
    side = lambda s: values.select(F.col("doc_id").alias(s), F.col(column).alias(f"v{s}"))
    return following.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.col("a").alias("doc_id"), F.col("b").alias("next_id"), "va", "vb")


def doc_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header cells of every text read as a table of commas; '' if its first line isn't one."""
    return _documents(spark, folder).where("text is not null").select("doc_id", F.array_join(header_row(F.col("text")), "|").alias("header"))


def doc_schema_next(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard of the headers of every table and the user's next document, null unless both are tables."""
    documents = _documents(spark, folder)
    head = header_row(F.col("text"))
    values = documents.select("doc_id", F.when(F.size(head) > 1, head).alias("h"))
    both = _next_of(spark, documents, values, "h")
    return both.select("doc_id", "next_id", F.round(features.header_similarity(F.col("va"), F.col("vb")), 6).alias("schema_sim"))


def doc_minhash_next(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated content similarity of every document and the user's next one, by MinHash of 64-character pieces."""
    documents = _documents(spark, folder)
    values = documents.select("doc_id", features.signature(features.chunks(F.col("text"))).alias("s"))
    both = _next_of(spark, documents, values, "s")
    return both.select("doc_id", "next_id", F.round(features.signature_similarity(F.col("va"), F.col("vb")), 6).alias("bin_simil"))


def doc_vectors_next(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the mean word vectors of every document and the user's next one; 0 for one without words."""
    documents = table(spark, folder, "documents").select("doc_id", "user_id", "source", "text")
    scratch = Scratch(spark, "wordvectors")
    terms = scratch.cut(vectors.term_counts(documents.select("doc_id", "text")), "terms")
    sources = [r[0] for r in documents.select("source").distinct().orderBy("source").collect() if r[0] is not None]  # the dimensions of a vector
    of = terms.join(documents.select("doc_id", "source"), "doc_id").groupBy("term").agg(*(F.sum((F.col("source") == s).cast("double")).alias(f"d{i}") for i, s in enumerate(sources)), F.count(F.lit(1)).alias("n"))
    ranked = places(of.withColumn("one", F.lit(0)), ["one"], [F.col("n").desc(), F.col("term").asc()], scratch)
    vector_table = ranked.select(F.col("term").alias("word"), F.col("place").alias("rank"), F.array(*(F.coalesce(f"d{i}", F.lit(0.0)) for i in range(len(sources)))).alias("vector"))
    means = scratch.cut(features.mean_vectors(terms, features.word_vectors(vector_table)), "means")
    both = _next_of(spark, documents, means, "vector")
    return both.select("doc_id", "next_id", F.round(F.coalesce(measures.cosine(F.col("va"), F.col("vb")), F.lit(0.0)), 6).alias("word_vec_sim"))


def part_images(spark: SparkSession, folder: str) -> DataFrame:
    """Label and colour similarity of every part and the next one, from stored lists of labels and colours."""
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("[('"), F.replace("p_name", F.lit(" "), F.lit("', 0.9), ('")), F.lit("', 0.5)]"))).alias("labels"),
        F.when(F.col("p_partkey") % 7 != 0, F.concat_ws(",", (F.col("p_partkey") * 37 % 256).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_size").cast("string")), (F.col("p_size") * 5).cast("string"))).alias("color"),
    )
    seen = parts.select("p_partkey", records.labels(F.col("labels")).alias("l"), records.color(F.col("color")).alias("c"))
    following = seen.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("l").alias("l2"), F.col("c").alias("c2"))
    both = seen.join(following, "p_partkey")
    return both.select("p_partkey", F.round(records.color_similarity(F.col("c"), F.col("c2")), 6).alias("color_sim"), F.round(text.jaccard(F.array_distinct("l"), F.array_distinct("l2")), 6).alias("obj_sim"))


def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a sample of every user's files that are chosen for pairs."""
    files = _new(spark, folder, "files", ["sel_for_simils"]).where("sel_for_simils")
    return features.sampled_pairs(files)


def file_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Places of every file name's bigrams in the code of names."""
    return _new(spark, folder, "files", ["name"]).select("user_id", "id", F.coalesce(F.array_join(F.transform(records.name_code(F.lower("name")), lambda x: x.cast("string")), "|"), F.lit("")).alias("code"))


def file_records(spark: SparkSession, folder: str) -> DataFrame:
    """What explanations know of every file, and an id that follows from its key."""
    files = _new(spark, folder, "files", ["name", "path", "size", "last_modified"])
    none = F.array().cast("array<string>")
    r = files.select("user_id", "id", "path", records.attributes(F.col("name"), F.col("path"), F.col("size"), F.col("last_modified"), none, F.lit(None).cast("string"), none).alias("r"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), "|"), F.lit(""))
    return r.select("user_id", "id", F.col("r.date").alias("date"), joined("r.ext").alias("ext"), joined("r.start_tokens").alias("start_tokens"), joined("r.name_tokens").alias("name_tokens"), joined("r.bare_tokens").alias("bare_tokens"), F.coalesce(F.array_join("r.folders", "|"), F.lit("")).alias("folders"), F.coalesce(F.array_join(records.path_prefixes(F.col("path")), "|"), F.lit("")).alias("prefixes"))


def _folders(spark: SparkSession, folder: str) -> DataFrame:
    folders = _new(spark, folder, "folders", ["parent_id", "name"]).where("user_id is not null and id is not null")
    return folders.select(F.col("user_id").alias("scope"), "id", F.col("parent_id").alias("parent"), "name")


def folder_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Depth, place and group of every folder that leads to a root, roots being of depth 1, as numbers and as bits; none beyond the greatest depth."""
    scratch = Scratch(spark, "codes")
    tree, _ = resolve(_folders(spark, folder), scratch)
    codes = positional_codes(tree, scratch).select("scope", "id", "depth", "place", records.place_group(F.col("above")).alias("grp"))
    return codes.where("grp is not null").select(F.col("scope").alias("user_id"), "id", "depth", "place", F.col("grp").cast("string").alias("grp"), records.code_bits(F.col("depth"), F.col("place"), F.col("grp")).alias("bits"))


def folder_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Steps between every folder that leads to a root and the user's first one, by their place codes."""
    scratch = Scratch(spark, "distances")
    tree, _ = resolve(_folders(spark, folder), scratch)
    codes = scratch.cut(positional_codes(tree, scratch).select("scope", "id", F.concat("above", F.array("place")).alias("at")), "at")
    first = codes.groupBy("scope").agg(F.min(F.struct("id", "at")).alias("f"))
    return codes.join(first, "scope").select(F.col("scope").alias("user_id"), "id", records.code_distance(F.col("at"), F.col("f.at")).alias("distance"))


def folder_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """The ancestors of every user's deepest folder with the folders beside each of them."""
    scratch = Scratch(spark, "siblings")
    nodes = scratch.cut(_folders(spark, folder), "nodes")
    tree, _ = resolve(nodes, scratch)
    deepest = tree.groupBy("scope").agg(F.min(F.struct((-F.col("depth")).alias("d"), "id")).alias("m")).select("scope", F.col("m.id").alias("id"))
    return siblings(tree.join(deepest, ["scope", "id"], "left_semi"), tree).select(F.col("scope").alias("user_id"), F.col("id").alias("folder_id"), "level", "sibling_id")


def worst_features(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled features of all pairs, nulls as the worst value, and their sum."""
    names = measures.COMMON_FEATURES
    some = _pairs(spark, folder, list(names))
    # scaled() turns distances over; or_worst does so itself
    bare = {f: F.when(F.lit(f in measures.DISTANCES), 1 - measures.scaled(f, F.col(f))).otherwise(measures.scaled(f, F.col(f))) for f in names}
    rows = some.select("user_id", "file_id_a", "file_id_b", *(records.or_worst(f, x).alias(f) for f, x in bare.items()))
    total = rows[names[0]]
    for f in names[1:]:
        total = total + F.col(f)
    return rows.select("user_id", "file_id_a", "file_id_b", *(F.round(f, 6).alias(f) for f in names), F.round(total, 6).alias("total"))


def neighbour_split(spark: SparkSession, folder: str) -> DataFrame:
    """How many of every file's pairs are above the threshold of a deletion, and how many aren't."""
    split = groups.split_neighbours(_pairs(spark, folder, ["del_true_cert"]).withColumnRenamed("del_true_cert", "cert"))
    return split.groupBy("user_id", "file_id").agg(F.sum(F.col("inside").cast("long")).alias("n_inside"), F.sum((~F.col("inside")).cast("long")).alias("n_outside"))


def file_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that seeds found, in the order of ids; a file in an earlier group founds none."""
    some = _pairs(spark, folder, ["del_true_cert"]).withColumnRenamed("del_true_cert", "cert")
    return groups.neighbourhoods(some, Scratch(spark, "groups"), least=LEAST_GROUP)


def _discriminated(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "discrimination")
    some = _pairs(spark, folder, ["del_true_cert"]).withColumnRenamed("del_true_cert", "cert")
    split = groups.split_neighbours(some).where("inside").select("user_id", F.col("file_id").alias("grp"), F.col("other_id").alias("id")).distinct()
    files = scratch.cut(_new(spark, folder, "files", ["parent_id"]).where("parent_id is not null").select("user_id", "id", F.col("parent_id").alias("folder")), "files")
    members = split.join(files, ["user_id", "id"]).select(F.col("user_id").alias("scope"), "grp", "folder")
    sizes = files.groupBy(F.col("user_id").alias("scope"), "folder").agg(F.count(F.lit(1)).alias("n"))
    return groups.discrimination(members, sizes)


def group_discrimination(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest and the least share of a folder that every file's certain neighbours hold."""
    found = _discriminated(spark, folder)
    return found.select(F.col("scope").alias("user_id"), F.col("grp").alias("file_id"), F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


def group_halves(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a file's neighbours are in the half of the user's that hold the greatest least share of a folder."""
    scratch = Scratch(spark, "halves")
    rows = scratch.cut(_discriminated(spark, folder).select("scope", "grp", F.round("least", 6).alias("least")), "rows")
    found = groups.halves(rows, "scope", "least", "grp", lambda r, k, o: places(r, k, o, scratch))
    return found.select(F.col("scope").alias("user_id"), F.col("grp").alias("file_id"), "least", "best")


def group_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations of every folder's files of four kinds, as JSON, with their score, that as a share of the group's scores,
    whether it is complex, and whether it is the best."""
    scratch = Scratch(spark, "rules")
    files = scratch.cut(_new(spark, folder, "files", ["name", "parent_id", "size", "last_modified"]).where("user_id is not null and parent_id is not null"), "files")
    scoped = files.select(F.col("user_id").alias("scope"), F.col("parent_id").alias("grp"), "id", "name", "size", "last_modified")
    token = rules.token_rules(scoped.where("name is not null").select("scope", "grp", "id", text.name_tokens(F.col("name")).alias("tokens")))
    out = token.select("scope", "grp", F.lit("token").alias("kind"), F.to_json(F.struct("token")).alias("rule"), "score")
    for column in ("size", "last_modified"):
        ranges = rules.range_rules(scoped.select("scope", "grp", F.col(column).alias("value")), scratch)
        out = out.unionByName(ranges.select("scope", "grp", F.lit(column).alias("kind"), F.to_json(F.struct("low", "high")).alias("rule"), "score"))
    seed = scoped.where("id is not null").groupBy("scope", "grp").agg(F.min("id").alias("id"))
    out = out.unionByName(seed.select("scope", "grp", F.lit("seed").alias("kind"), F.to_json(F.struct("id")).alias("rule"), F.lit(0.0).alias("score")))
    out = scratch.cut(out, "out")
    both = out.groupBy("scope", "grp").agg(F.sum("score").alias("total"), F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))  # four rows a group
    j = out.join(both, ["scope", "grp"])
    share = F.when(F.col("total") > 0, F.round(F.col("score") / F.col("total"), 5)).otherwise(0.0)
    return j.select(F.col("scope").alias("user_id"), F.col("grp").alias("parent_id"), "kind", "rule", "score", share.alias("share"), F.col("kind").isin("size", "last_modified").alias("is_complex"), (F.col("kind") == F.col("b.kind")).alias("best"))


def kind_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names of every user's live top folders, in one list."""
    folders = _new(spark, folder, "folders", ["parent_id", "name", "trashed"]).where("not trashed and user_id is not null and (parent_id is null or parent_id in ('', 'root'))")
    return folders.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("name", F.lit("")))), "|").alias("names"))


def folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """The best token rule of every folder with the files that it stands for: rule, folder and file in one row."""
    files = _new(spark, folder, "files", ["name", "parent_id"]).where("user_id is not null and parent_id is not null and name is not null")
    scoped = files.select(F.col("user_id").alias("scope"), F.col("parent_id").alias("grp"), "id", text.name_tokens(F.col("name")).alias("tokens"))
    found = rules.token_rules(scoped).select("scope", "grp", "token", "score")
    names = _new(spark, folder, "folders", ["name"]).select(F.col("user_id").alias("scope"), F.col("id").alias("grp"), F.col("name").alias("folder_name"))
    held = scoped.join(found, ["scope", "grp"]).where(F.array_contains("tokens", F.col("token"))).join(names, ["scope", "grp"])
    return held.select(F.col("scope").alias("user_id"), F.col("grp").alias("parent_id"), "folder_name", "id", "token", "score")


def part_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that share a part with the part of the next key, and those of either only: sets by joins, not by lists."""
    held = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    n = held.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    both = held.join(held.select((F.col("l_partkey") - 1).alias("l_partkey"), "l_suppkey"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    after = n.select((F.col("l_partkey") - 1).alias("l_partkey"), F.col("n").alias("m"))
    j = n.join(after, "l_partkey").join(both, "l_partkey", "left").select("l_partkey", "n", "m", F.coalesce("k", F.lit(0)).alias("k"))
    return j.select("l_partkey", F.col("k").alias("n_both"), (F.col("n") - F.col("k")).alias("n_only"), (F.col("m") - F.col("k")).alias("n_next_only"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_headers, doc_schema_next, doc_minhash_next, doc_vectors_next, part_images, candidate_pairs, file_codes, file_records, folder_codes, folder_distances, folder_siblings,
        worst_features, neighbour_split, file_groups, group_discrimination, group_halves, group_rules, kind_names, folder_report, part_shares,
    )
}

_HEAD = """
hl as (select doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(replace(x, ',', ''), ' ') <> '')[1] as line from documents where text is not null),
hc as (select doc_id, len(string_split(line, ',')) as n, list_filter(list_transform(string_split(line, ','), lambda c: lower(regexp_replace(c, '[^\\p{L}\\p{N}]+', '', 'g'))), lambda c: c <> '') as cells from hl),
h as (select doc_id, case when len(cells) > 0.9 * n then cells else []::varchar[] end as cells from hc)
"""
_SPLIT = f"""
s as (select user_id, file_id_a as a, file_id_b as b, coalesce(not isnan(del_true_cert) and del_true_cert > 0.65, false) as inside from {_SQL_PAIRS}),
b as (select user_id, a as file_id, b as other_id, inside from s union all select user_id, b, a, inside from s)
"""
_FOLDER_TREE = f"""
fo as (select user_id, id, parent_id from {_sql_new('folders')} where user_id is not null and id is not null),
n as (select a.user_id, a.id, b.id as parent from fo a left join fo b on a.user_id = b.user_id and a.parent_id = b.id),
p as (select *, least(row_number() over (partition by user_id, coalesce(parent, '') order by id) - 1, 20)::hugeint as place from n)
"""
_CODES = f"""
{_FOLDER_TREE}, t(user_id, id, depth, place, grp, spots) as (
  select user_id, id, 1, place, 0::hugeint, [place] from p where parent is null
  union all select p.user_id, p.id, t.depth + 1, p.place, case when t.depth < 19 then 20 * t.grp + t.place end, list_append(t.spots, p.place) from t join p on p.user_id = t.user_id and p.parent = t.id
)
"""
_JOINED = "coalesce(array_to_string(list_sort(list_distinct({})), '|'), '')"
_TOKENS = "regexp_split_to_array(lower(name), '[._~+ -]')"
_BARE = f"list_filter({_TOKENS}, lambda t: t <> coalesce(case when contains(name, '.') then list_extract(string_split(lower(name), '.'), -1) end, ''))"
_PREFIXES = "case when length(name) >= 2 then list_transform(range(2, least(length(name), {}) + 1), lambda i: lower(name)[:i]) else [] end"
_DISCRIMINATED = f"""
{_SPLIT}, f as (select user_id, id, parent_id as folder from {_sql_new('files')} where parent_id is not null),
z as (select user_id, folder, count(*) as n from f group by all),
k as (select d.user_id, d.file_id, f.folder, count(*) as k from (select distinct user_id, file_id, other_id from b where inside) d join f on f.user_id = d.user_id and f.id = d.other_id group by all),
dd as (select k.user_id, k.file_id, round(max(k / n), 6) as most, round(min(k / n), 6) as least from k join z on z.user_id = k.user_id and z.folder = k.folder group by all)
"""


def _sql_range(column: str) -> str:
    return FILE_SQL["range_rules"].replace("last_modified", column)


def _sql_bits(x: str, n: int) -> str:
    return f"lpad(case when {x} = 0 then '0' else ltrim(bin({x}), '0') end, {n}, '0')"


SQL = {
    "doc_headers": f"with {_HEAD} select doc_id, array_to_string(cells, '|') as header from h",
    "doc_schema_next": f"""
with {_NEXT}, {_HEAD}, v as (select doc_id, list_distinct(cells) as c from h where len(cells) > 1)
select a as doc_id, b as next_id, round(case when x.c is not null and y.c is not null then len(list_intersect(x.c, y.c))::double / len(list_distinct(list_concat(x.c, y.c))) end, 6) as schema_sim
from nx left join v x on x.doc_id = a left join v y on y.doc_id = b
""",
    "doc_minhash_next": f"""
with {_NEXT}, p as (select distinct doc_id, unnest(list_transform(range(0, (length(text) + 63) // 64), lambda i: substr(text, i * 64 + 1, 64))) as p from documents where length(text) > 0),
x as (select distinct doc_id, ('0x' || md5(p)[:7])::bigint as x from p), i as (select unnest(range(1, 129)) as i),
m as (select doc_id, i, min(((i * 7919 + 1) * x + i * 104729) % 2147483647) as m from x, i group by all),
s as (select nx.a, nx.b, count(*) as k from nx join m u on u.doc_id = nx.a join m w on w.doc_id = nx.b and w.i = u.i and w.m = u.m group by all)
select nx.a as doc_id, nx.b as next_id, round(coalesce(k / 128, 0.0), 6) as bin_simil from nx left join s on s.a = nx.a and s.b = nx.b
""",
    "doc_vectors_next": f"""
with {_NEXT}, t as (select doc_id, source, unnest({_WORDS}) as term from documents), tf as (select doc_id, source, term, count(*)::double as tf from t group by all),
c as (select term, source, count(*)::double as x from tf where source is not null group by all), z as (select term, sqrt(sum(x * x)) as z from c group by all),
u as (select c.term, c.source as i, x / z as x from c join z on z.term = c.term), w as (select doc_id, sum(tf) as w from tf group by all),
m as (select tf.doc_id, i, sum(u.x * tf.tf) as m from tf join u on u.term = tf.term group by all), l as (select doc_id, sqrt(sum(m * m)) as l from m group by all),
d as (select nx.a, nx.b, sum(p.m * q.m) as d from nx join m p on p.doc_id = nx.a join m q on q.doc_id = nx.b and q.i = p.i group by all)
select nx.a as doc_id, nx.b as next_id, round(coalesce(d / (x.l * y.l), 0.0), 6) as word_vec_sim from nx left join d on d.a = nx.a and d.b = nx.b left join l x on x.doc_id = nx.a left join l y on y.doc_id = nx.b
""",
    "part_images": """
with p as (
  select p_partkey, case when p_partkey % 11 <> 0 then list_distinct(string_split(p_name, ' ')) else [] end as l,
    case when p_partkey % 7 <> 0 then [p_partkey * 37 % 256, case when p_partkey % 5 = 0 then 0 else p_size end, p_size * 5] end as c from part
)
select a.p_partkey, round(case when a.c is null or b.c is null then 0.0 else (abs(a.c[1] - b.c[1]) + abs(a.c[2] - b.c[2]) + abs(a.c[3] - b.c[3])) / 3 end, 6) as color_sim,
  round(case when len(list_distinct(list_concat(a.l, b.l))) = 0 then 0.0 else len(list_intersect(a.l, b.l))::double / len(list_distinct(list_concat(a.l, b.l))) end, 6) as obj_sim
from p a join p b on b.p_partkey = a.p_partkey + 1
""",
    "candidate_pairs": f"""
with s as (select user_id, id from {_sql_new('files')} where sel_for_simils and user_id is not null and id is not null qualify row_number() over (partition by user_id order by sha256(id), id) <= 1000)
select a.user_id, a.id as a, b.id as b from s a join s b on b.user_id = a.user_id and a.id < b.id
""",
    "file_codes": f"""
with g as (select user_id, id, {_over(_BIGRAMS, x='lower(name)')} as b from {_sql_new('files')}),
c as (select user_id, id, list_transform(b, lambda x: [strpos('abcdefghijklmnopqrstuvwxyz_-()', x[1]), strpos('abcdefghijklmnopqrstuvwxyz_-()', x[2])]) as c from g)
select user_id, id, coalesce(array_to_string(list_sort(list_distinct(list_transform(c, lambda q: case when q[1] = 0 or q[2] = 0 or q[1] = q[2] then 870 else (q[1] - 1) * 29 + q[2] - 1 - case when q[2] > q[1] then 1 else 0 end end))), '|'), '') as code from c
""",
    "file_records": f"""
select user_id, id, last_modified as date, coalesce(case when contains(name, '.') then list_extract(string_split(name, '.'), -1) else '' end, '') as ext, {_JOINED.format(_PREFIXES.format(999))} as start_tokens,
  case when name is null then '' else {_JOINED.format(f"list_concat({_BARE}, {_PREFIXES.format(6)})")} end as name_tokens, {_JOINED.format(_BARE)} as bare_tokens,
  coalesce(array_to_string(string_split(path, '/')[2:-2], '|'), '') as folders,
  coalesce(array_to_string(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/') || '/'), '|'), '') as prefixes
from {_sql_new('files')}
""",
    "folder_codes": f"""
with recursive {_CODES}
select user_id, id, depth::bigint as depth, place::bigint as place, grp::varchar as grp,
  {_sql_bits('depth', 5)} || {_sql_bits('place::bigint', 5)} || {_sql_bits('(grp // 576460752303423488)::bigint', 59)} || {_sql_bits('(grp % 576460752303423488)::bigint', 59)} as bits
from t where grp is not null
""",
    "folder_distances": f"""
with recursive {_CODES}, f as (select user_id, id, spots from t qualify row_number() over (partition by user_id order by id) = 1),
d as (select t.user_id, t.id, len(t.spots) as n, len(f.spots) as m, len(list_filter(range(1, least(len(t.spots), len(f.spots)) + 1), lambda i: t.spots[1:i] = f.spots[1:i])) as k from t join f on f.user_id = t.user_id)
select user_id, id, (n + m - 2 * k - case when k < least(n, m) then 2 else 0 end)::integer as distance from d
""",
    "folder_siblings": f"""
with recursive {_CODES}, d as (select user_id, id from t qualify row_number() over (partition by user_id order by depth desc, id) = 1),
up(user_id, folder_id, anc, level) as (
  select n.user_id, n.id, n.parent, 1 from n join d on d.user_id = n.user_id and d.id = n.id where n.parent is not null
  union all select up.user_id, up.folder_id, n.parent, up.level + 1 from up join n on n.user_id = up.user_id and n.id = up.anc where n.parent is not null
)
select up.user_id, up.folder_id, up.level, s.id as sibling_id from up join n a on a.user_id = up.user_id and a.id = up.anc
join t ts on ts.user_id = up.user_id join n s on s.user_id = ts.user_id and s.id = ts.id and s.parent is not distinct from a.parent
""",
    "worst_features": f"""
with w as (select user_id, file_id_a, file_id_b, {', '.join(f"coalesce({_sql_scaled(f)}, 0.0::double) as {f}" for f in measures.COMMON_FEATURES)} from {_SQL_PAIRS})
select user_id, file_id_a, file_id_b, {', '.join(f"round({f}, 6) as {f}" for f in measures.COMMON_FEATURES)}, round({' + '.join(measures.COMMON_FEATURES)}, 6) as total from w
""",
    "neighbour_split": f"with {_SPLIT} select user_id, file_id, count(*) filter (inside)::bigint as n_inside, count(*) filter (not inside)::bigint as n_outside from b group by all",
    "group_discrimination": f"with {_DISCRIMINATED} select user_id, file_id, most, least from dd",
    "group_halves": f"""
with {_DISCRIMINATED} select user_id, file_id, least, row_number() over (partition by user_id order by least desc, file_id) <= count(*) over (partition by user_id) // 2 as best from dd
""",
    "group_rules": f"""
with a as (
  select user_id, parent_id, 'token' as kind, '{{"token":' || to_json(token)::varchar || '}}' as rule, score from ({FILE_SQL['token_rules']})
  union all select user_id, parent_id, 'size', '{{"low":' || low || ',"high":' || high || '}}', score from ({_sql_range('size')})
  union all select user_id, parent_id, 'last_modified', '{{"low":' || low || ',"high":' || high || '}}', score from ({FILE_SQL['range_rules']})
  union all select user_id, parent_id, 'seed', '{{"id":' || to_json(min(id))::varchar || '}}', 0.0::double from {_sql_new('files')} where user_id is not null and parent_id is not null and id is not null group by user_id, parent_id
)
select user_id, parent_id, kind, rule, score, case when sum(score) over g > 0 then round(score / sum(score) over g, 5) else 0.0 end as share, kind in ('size', 'last_modified') as is_complex,
  row_number() over (partition by user_id, parent_id order by score desc, kind) = 1 as best
from a window g as (partition by user_id, parent_id)
""",
    "kind_names": f"""
select user_id, array_to_string(list_sort(list(coalesce(name, ''))), '|') as names from {_sql_new('folders')} where not trashed and user_id is not null and (parent_id is null or parent_id in ('', 'root')) group by all
""",
    "folder_report": f"""
with r as ({FILE_SQL['token_rules']}), f as (select user_id, parent_id, id, {_TOKENS} as k from {_sql_new('files')} where user_id is not null and parent_id is not null and name is not null)
select f.user_id, f.parent_id, d.name as folder_name, f.id, r.token, r.score from f join r on r.user_id = f.user_id and r.parent_id = f.parent_id and list_contains(f.k, r.token) join {_sql_new('folders')} d on d.user_id = f.user_id and d.id = f.parent_id
""",
    "part_shares": """
with h as (select l_partkey, list_distinct(list(l_suppkey)) as s from lineitem group by all)
select a.l_partkey, len(list_intersect(a.s, b.s)) as n_both, len(a.s) - len(list_intersect(a.s, b.s)) as n_only, len(b.s) - len(list_intersect(a.s, b.s)) as n_next_only from h a join h b on b.l_partkey = a.l_partkey + 1
""",
}
