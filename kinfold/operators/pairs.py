"""Features, scores and neighbours of pairs of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import measures, text
from kinfold.functions.kinds import kind, pair_kind


def canonical(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the lesser id first; pairs with a null or of an id with itself are left out."""
    ok = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ok.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def name_features(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Features of pairs (user_id, file_id_a, file_id_b) that files (user_id, id, name, size, last_modified, path) give.

    Pairs of which a file isn't listed are left out. Distances of null sizes or times are null. The joins are on
    (user, file); adaptive execution splits those of a hot file, as each side of files has one row a key.
    """
    columns = ["name", "size", "last_modified", "path"]
    side = lambda s: files.select("user_id", F.col("id").alias(f"file_id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    both = pairs.select("user_id", "file_id_a", "file_id_b").join(side("a"), ["user_id", "file_id_a"]).join(side("b"), ["user_id", "file_id_b"])
    return both.select(
        "user_id",
        "file_id_a",
        "file_id_b",
        text.edit_distance(F.col("name_a"), F.col("name_b")).alias("edit_dist"),
        F.round(text.bigram_similarity(F.col("name_a"), F.col("name_b")), 6).alias("bigram_simil"),
        F.round(text.token_similarity(F.col("name_a"), F.col("name_b")), 6).alias("token_simil"),
        measures.path_distance(F.col("path_a"), F.col("path_b")).alias("tree_dist"),
        F.abs(F.col("size_a") - F.col("size_b")).alias("size_dist"),
        F.abs(F.col("last_modified_a") - F.col("last_modified_b")).alias("last_mod_dist"),
    )


def scores(pairs: DataFrame, coefficients: dict[str, dict[str, float]], intercepts: dict[str, float]) -> DataFrame:
    """Logistic score of pairs with features and the extensions ext_a, ext_b; by the kind of the pair.

    A pair with a null or NaN in a feature of its kind has no score and is left out. Positive is p > 0.65; certainty
    is the greater of p and 1 - p; top_feat and second_feat are the terms of the greatest absolute value, ties by name.
    """
    which = pair_kind(kind(F.lower("ext_a")), kind(F.lower("ext_b")))
    out = None
    for name, features in measures.FEATURES.items():
        terms = {f: measures.scaled(f, F.col(f)) for f in features}
        own = pairs.withColumn("kind", which).where(F.col("kind") == name).select("user_id", "file_id_a", "file_id_b", "kind", *(t.alias(f) for f, t in terms.items()))
        own = own.dropna(subset=list(features))
        weighed = [F.col(f) * coefficients[name][f] for f in features]
        p = measures.logistic(weighed, intercepts[name])
        ranked = F.array_sort(F.array(*(F.struct((-F.round(F.abs(t), 9)).alias("w"), F.lit(f).alias("f")) for f, t in zip(features, weighed))))
        part = own.select("user_id", "file_id_a", "file_id_b", "kind", p.alias("p"), ranked.getItem(0)["f"].alias("top_feat"), ranked.getItem(1)["f"].alias("second_feat"))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"pred": F.col("p") > measures.POSITIVE, "cert": F.greatest("p", 1 - F.col("p"))})


def degrees(pairs: DataFrame) -> DataFrame:
    """(user_id, file_id, degree): pairs (user_id, file_id_a, file_id_b) that each file is in; combined before the shuffle."""
    return pairs.select("user_id", F.explode(F.array("file_id_a", "file_id_b")).alias("file_id")).groupBy("user_id", "file_id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(pairs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """Both directions of every pair: (user_id, file_id, other_id, kept columns)."""
    one = pairs.select("user_id", F.col("file_id_a").alias("file_id"), F.col("file_id_b").alias("other_id"), *keep)
    return one.unionByName(pairs.select("user_id", F.col("file_id_b").alias("file_id"), F.col("file_id_a").alias("other_id"), *keep))
