"""Vectors: term weights of texts, centroids and nearest rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators.places import places
from kinfold.storage import Scratch

QUERIES_A_PASS = 2048


def term_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of documents (doc_id, text); null texts have no terms."""
    terms = documents.select("doc_id", F.explode(text.words(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df, idf) over all documents; idf = ln((1 + n) / (1 + df)) + 1, n the number of rows."""
    n = documents.count()
    df = documents.select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)


def tfidf(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, term, weight) of unit vectors.

    Texts are taken apart once: document frequencies are counts of the written (document, term) rows. Terms join their idf
    on the term; a term that a third of all rows hold is split by adaptive execution.
    """
    counts, n = scratch.cut(term_counts(documents), "terms"), documents.count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(df, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b) by unit vectors (doc_id, term, weight); 0.0 without a shared term."""
    x = vectors.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa"))
    y = vectors.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def successors(rows: DataFrame, key: str, by: str, scratch: Scratch) -> DataFrame:
    """(a, b): every row's `by` and that of the next row of the same key."""
    placed = places(rows.where(F.col(key).isNotNull() & F.col(by).isNotNull()).select(key, by), [key], [by], scratch)
    following = placed.select(key, (F.col("place") - 1).alias("place"), F.col(by).alias("b"))
    return placed.select(key, "place", F.col(by).alias("a")).join(following, [key, "place"]).select("a", "b")


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): mean of the vectors of each key, position by position, combined before the shuffle."""
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _distances(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(own), -1)
            for q in range(len(ids)):
                diff = x - queries[q]
                d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                keep = own != ids[q]
                d, i = np.concatenate([best[q][0], d[keep]]), np.concatenate([best[q][1], own[keep]])
                order = np.lexsort((i, d))[:k]
                best[q] = d[order], i[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(b[0]) for b in best])), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], names=["query_id", "other_id", "distance"]
        )

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, queries_a_pass: int = QUERIES_A_PASS) -> DataFrame:
    """(query_id, other_id, distance, place): the k rows (id bigint, vector) nearest to each query, itself left out.

    Queries are taken in passes of bounded size, each against all rows; partitions keep their k best a query.
    """
    n, out = queries.count(), None
    passes = max(1, -(-n // queries_a_pass))
    for p in range(passes):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).orderBy("id").collect()
        if not own:
            continue
        ids = np.array([r[0] for r in own], dtype=np.int64)
        vectors = np.array([r[1] for r in own], dtype=np.float64)
        part = rows.select("id", "vector").mapInArrow(_distances(ids, vectors, k), "query_id long, other_id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, other_id long, distance double, place int")
    by = Window.partitionBy("query_id").orderBy("distance", "other_id")  # at most k rows a partition and query
    return out.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
