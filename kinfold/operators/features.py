"""Features of pairs that need more than names: headers, content, words, labels; and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators.places import first_rows

# fixed values: a content's chunk, hashes of a signature, the prime of their family, words of a vector table, files of a sample
CHUNK, HASHES, PRIME = 64, 128, 2147483647
VECTOR_WORDS = 500_000
SAMPLE = 1000


def chunks(content: Column, size: int = CHUNK) -> Column:
    """Distinct pieces of `size` characters, in order; none of a null or empty text."""
    n = F.ceil(F.length(content) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(content, (i - 1) * size + 1, F.lit(size)))
    return F.when(F.length(content) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def signature(pieces: Column) -> Column:
    """A MinHash signature: of each of HASHES functions the least value over the pieces; null without pieces.

    A piece's number is the first seven hex digits of its MD5; function i (from 1) is ((7919 i + 1) x + 104729 i) mod PRIME.
    """
    numbers = F.transform(pieces, lambda p: F.conv(F.substring(F.md5(p), 1, 7), 16, 10).cast("bigint"))
    least = lambda i: F.array_min(F.transform(numbers, lambda x: F.pmod((i * 7919 + 1) * x + i * 104729, F.lit(PRIME))))
    return F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: least(i.cast("bigint"))))


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures, an estimate of the pieces' Jaccard; 0.0 where one is null, as of empty content."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.coalesce(same / HASHES, F.lit(0.0))


def header_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two headers; null unless both are tables (headers not null)."""
    return text.jaccard(F.array_distinct(a), F.array_distinct(b))


def word_vectors(vectors: DataFrame, words: int = VECTOR_WORDS) -> DataFrame:
    """(word, vector) of length one: of a table (word, rank, vector) its first words by rank; vectors of zeros stay."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform("vector", lambda x: x / norm)).otherwise(F.col("vector"))
    return vectors.where(F.col("rank") <= words).select("word", unit.alias("vector"))


def mean_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, vector): the mean of the vectors of a document's words, each time that it stands there; documents without
    known words are left out. documents: (doc_id, term, tf); the sums are combined before the shuffle, one row a dimension."""
    each = documents.join(vectors.select(F.col("word").alias("term"), "vector"), "term").select("doc_id", "tf", F.posexplode("vector").alias("i", "x"))
    means = each.groupBy("doc_id", "i").agg((F.sum(F.col("x") * F.col("tf")) / F.sum("tf")).alias("m"))
    return means.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


def sampled_pairs(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(user_id, a, b), a < b: all pairs of at most `sample` files a user, those with the least SHA-256 of their id.

    The sample is the operator's feature and bounds the pairs of a user at sample (sample - 1) / 2.
    """
    ids = files.where("user_id is not null and id is not null").select("user_id", "id").distinct()
    some = first_rows(ids.select("user_id", F.sha2("id", 256).alias("h"), "id"), ["user_id"], ["h", "id"], sample)
    a, b = some.select("user_id", F.col("id").alias("a")), some.select("user_id", F.col("id").alias("b"))
    return a.join(b, "user_id").where("a < b")
