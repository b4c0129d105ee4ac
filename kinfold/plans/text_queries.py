"""Queries on documents, embeddings, orders and shared users, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import measures, text
from kinfold.functions.stem import STOP_WORDS, stems
from kinfold.operators import vectors
from kinfold.operators.places import places
from kinfold.operators.search import search
from kinfold.sources.tables import table
from kinfold.storage import Scratch

CHUNK = 64
TOP_SHARED = 1000


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and inverse frequency of every term, and whether it is neither rare nor common."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    n = documents.count()
    df = vectors.document_frequencies(documents)
    return df.select("term", "df", F.round("idf", 6).alias("idf"), ((F.col("df") >= 0.2 * n) & (F.col("df") <= 0.8 * n)).alias("kept"))


def doc_stems(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each English stem stands, words without content left out; every word is stemmed once."""
    counts = vectors.term_counts(table(spark, folder, "documents").select("doc_id", "text")).where(~F.col("term").isin(*sorted(STOP_WORDS)))
    vocabulary = counts.select("term").distinct().select("term", stems("term").alias("stem"))
    each = counts.join(vocabulary, "term").groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
    return each.groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def doc_next_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the term weights of every document and the user's next one."""
    documents = table(spark, folder, "documents").select("doc_id", "user_id", "text")
    scratch = Scratch(spark, "next")
    following = scratch.cut(vectors.successors(documents, "user_id", "doc_id", scratch), "following")
    found = vectors.cosines(following, scratch.cut(vectors.tfidf(documents.select("doc_id", "text"), scratch), "weights"))
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("next_id"), F.round("cosine", 6).alias("cosine"))


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Shared 64-character pieces of every document and the user's next one, as exact content similarity."""
    documents = table(spark, folder, "documents").select("doc_id", "user_id", "text")
    n = F.ceil(F.length("text") / CHUNK).cast("int")
    pieces = F.when(F.length("text") > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("text", (i - 1) * CHUNK + 1, F.lit(CHUNK))))).otherwise(F.array().cast("array<string>"))
    cut = documents.select("doc_id", pieces.alias("p"))
    following = vectors.successors(documents, "user_id", "doc_id", Scratch(spark, "chunks"))
    both = following.join(cut.select(F.col("doc_id").alias("a"), F.col("p").alias("pa")), "a").join(cut.select(F.col("doc_id").alias("b"), F.col("p").alias("pb")), "b")
    return both.select(F.col("a").alias("doc_id"), F.col("b").alias("next_id"), F.round(text.jaccard(F.col("pa"), F.col("pb")), 6).alias("bin_simil"))


def doc_search(spark: SparkSession, folder: str) -> DataFrame:
    """Text documents of the last thirty days that hold the word 'folder' and have 'draft' in their name."""
    documents = table(spark, folder, "documents")
    return search(documents, word="folder", name="draft", kind="text", days=30, now="2016-02-28 00:00:00").select("doc_id", "user_id", "fname")


def doc_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of each source's documents: small up to the first quartile's place, large from the third's on, both inclusive."""
    documents = table(spark, folder, "documents").where("source is not null and n_chars is not null").select("source", "n_chars", "doc_id")
    n = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    placed = places(documents, ["source"], ["n_chars", "doc_id"], Scratch(spark, "quartiles")).join(n, "source")
    at = F.col("place") - 1
    return placed.select("doc_id", "source", (at <= F.floor(0.25 * F.col("n"))).alias("small"), (at >= F.floor(0.25 * F.col("n"))).alias("medium_up"), (at >= F.floor(0.75 * F.col("n"))).alias("large"))


def doc_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without tags and entities: their lengths and hashes."""
    documents = table(spark, folder, "documents")
    bare = text.strip_markup(F.col("text"))
    return documents.select("doc_id", F.length(bare).alias("n_bare"), text.short_hash(bare).alias("hash"))


def emb_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine and distance of every vector to the mean of its label."""
    rows = table(spark, folder, "embeddings")
    both = rows.join(vectors.centroids(rows.where("label is not null"), "label", "embedding"), "label")
    return both.select("vec_id", F.round(measures.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"), F.round(measures.euclidean(F.col("embedding"), F.col("centroid")), 6).alias("distance"))


def emb_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors nearest to every vector whose id is divisible by 20, and which lie within the radius."""
    rows = table(spark, folder, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.nearest(rows, rows.where("id % 20 = 0"), 5)
    return found.select("query_id", "other_id", F.round("distance", 6).alias("distance"), (F.col("distance") < 0.15).alias("within"), "place")


def share_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Index of every supplier by how many parts it shares, the 999 most frequent apart, the rest in the last bucket."""
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    n = pairs.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_parts"))
    placed = places(n.select(F.lit(0).alias("one"), "l_suppkey", "n_parts"), ["one"], [F.col("n_parts").desc(), F.col("l_suppkey").asc()], Scratch(spark, "share"))
    return placed.select("l_suppkey", "n_parts", F.least(F.col("place") - 1, F.lit(TOP_SHARED - 1)).alias("bucket"))


def share_next(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard of the suppliers of every part and the part of the next key; 0 if either has one supplier or none."""
    held = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    n = held.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    after = n.select((F.col("l_partkey") - 1).alias("l_partkey"), F.col("n").alias("m"))
    # shared ones by a join on (part, supplier), so no part's suppliers are one list
    both = held.join(held.select((F.col("l_partkey") - 1).alias("l_partkey"), "l_suppkey"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    j = n.join(after, "l_partkey").join(both, "l_partkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    simil = F.when((F.col("n") <= 1) | (F.col("m") <= 1), 0.0).otherwise(F.col("k") / (F.col("n") + F.col("m") - F.col("k")))
    return j.select("l_partkey", F.round(simil, 6).alias("perm_simil"))


def last_touch(spark: SparkSession, folder: str) -> DataFrame:
    """The last order of every customer and its greatest order key of that moment; null and 0 without one."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, folder, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.col("o.o_orderdate").alias("last_at"), F.coalesce("o.o_orderkey", F.lit(0)).alias("last_key"))


def event_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last value of every kind of event of a user as of a past time, and a field of its properties."""
    events = table(spark, folder, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    last = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value", "props")).alias("e"))
    return last.select("user_id", "event_type", F.round("e.value", 6).alias("value"), F.get_json_object("e.props", "$.k").cast("long").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (doc_terms, doc_stems, doc_next_cosine, doc_chunks, doc_search, doc_quartiles, doc_markup, emb_centroids, emb_nearest, share_rank, share_next, last_touch, event_state)
}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+')"
_NEXT = "nx as (select doc_id as a, lead(doc_id) over (partition by user_id order by doc_id) as b from documents where user_id is not null qualify b is not null)"

SQL = {
    "doc_terms": f"""
with t as (select distinct doc_id, unnest({_WORDS}) as term from documents),
d as (select term, count(*) as df, (select count(*) from documents) as n from t group by term)
select term, df, round(ln((1.0 + n) / (1 + df)) + 1, 6) as idf, df >= 0.2 * n and df <= 0.8 * n as kept from d
""",
    "doc_next_cosine": f"""
with {_NEXT}, t as (select doc_id, unnest({_WORDS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
df as (select term, ln((1.0::double + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf group by term),
w as (select doc_id, tf.term, tf * idf as w from tf join df on df.term = tf.term),
v as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w),
d as (select a, b, sum(x.w * y.w) as c from nx join v x on x.doc_id = a join v y on y.doc_id = b and y.term = x.term group by all)
select nx.a as doc_id, nx.b as next_id, round(coalesce(c, 0.0), 6) as cosine from nx left join d on d.a = nx.a and d.b = nx.b
""",
    "doc_chunks": f"""
with {_NEXT}, p as (select doc_id, case when length(text) > 0 then list_distinct(list_transform(range(0, (length(text) + 63) // 64), lambda i: substr(text, i * 64 + 1, 64))) else [] end as p from documents),
j as (select a, b, x.p as pa, y.p as pb from nx join p x on x.doc_id = a join p y on y.doc_id = b)
select a as doc_id, b as next_id, round(case when len(list_distinct(list_concat(pa, pb))) = 0 then 0.0 else len(list_intersect(pa, pb))::double / len(list_distinct(list_concat(pa, pb))) end, 6) as bin_simil from j
""",
    "doc_search": f"""
select doc_id, user_id, fname from documents where gentype = 'text' and ingested_at >= timestamp '2016-02-28' - interval 30 days and contains(lower(fname), 'draft') and list_contains({_WORDS}, 'folder')
""",
    "doc_quartiles": """
with r as (select doc_id, source, row_number() over (partition by source order by n_chars, doc_id) - 1 as k, count(*) over (partition by source) as n from documents where source is not null and n_chars is not null)
select doc_id, source, k <= floor(0.25 * n) as small, k >= floor(0.25 * n) as medium_up, k >= floor(0.75 * n) as large from r
""",
    "doc_markup": """
with a as (
  select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from documents
), b as (
  select doc_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from a
), c as (select doc_id, trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as t from b)
select doc_id, length(t)::integer as n_bare, sha256(t)[:32] as hash from c
""",
    "emb_centroids": """
with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where label is not null),
c as (select label, i, avg(x) as m from e group by all), j as (select vec_id, x, m from e join c on c.label = e.label and c.i = e.i)
select vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as cosine, round(sqrt(sum((x - m) * (x - m))), 6) as distance from j group by vec_id
""",
    "emb_nearest": """
with q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 20 = 0), r as (select vec_id as other_id, embedding::double[] as b from embeddings),
d as (select query_id, other_id, list_distance(a, b) as distance from q join r on query_id <> other_id)
select query_id, other_id, round(distance, 6) as distance, distance < 0.15 as within, row_number() over (partition by query_id order by distance, other_id)::integer as place from d qualify place <= 5
""",
    "share_rank": """
with n as (select l_suppkey, count(distinct l_partkey) as n_parts from lineitem group by all)
select l_suppkey, n_parts, least(row_number() over (order by n_parts desc, l_suppkey) - 1, 999) as bucket from n
""",
    "share_next": """
with h as (select l_partkey, list_distinct(list(l_suppkey)) as s from lineitem group by all)
select a.l_partkey, round(case when len(a.s) <= 1 or len(b.s) <= 1 then 0.0 else len(list_intersect(a.s, b.s))::double / len(list_distinct(list_concat(a.s, b.s))) end, 6) as perm_simil
from h a join h b on b.l_partkey = a.l_partkey + 1
""",
    "last_touch": """
with o as (select o_custkey, o_orderdate, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey, o_orderdate as last_at, coalesce(o_orderkey, 0) as last_key from customer left join o on o_custkey = c_custkey
""",
    "event_state": """
with e as (select * from events where ts <= timestamp '2024-01-20' qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
select user_id, event_type, round(value, 6) as value, (props->>'$.k')::bigint as k from e
""",
}
