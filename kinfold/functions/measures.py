"""Distances, scales and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: greatest value of each feature in training, which scales it
FEATURE_MAX = {
    "tfidf_sim": 1.0,
    "word_vec_sim": 1.0,
    "color_sim": 183.0,
    "obj_sim": 0.667,
    "token_simil": 1.0,
    "bin_simil": 1.0,
    "perm_simil": 1.0,
    "tree_dist": 15.0,
    "size_dist": 21.92,
    "bigram_simil": 1.0,
    "last_mod_simil": 21.167,
}
# fixed values: features that are distances, of which two are taken as logarithms
DISTANCES = ("color_sim", "tree_dist", "size_dist", "last_mod_simil")
LOGARITHMS = ("size_dist", "last_mod_simil")
# fixed values: features of each kind of pair
COMMON_FEATURES = ("bin_simil", "perm_simil", "tree_dist", "size_dist", "bigram_simil", "last_mod_simil")
FEATURES = {"all_other": COMMON_FEATURES, "image": ("color_sim", "obj_sim", *COMMON_FEATURES), "text": ("tfidf_sim", "word_vec_sim", *COMMON_FEATURES)}
# fixed values: a certainty above it is positive; near misses lie about 0.5
POSITIVE, NEAR, NEAR_WIDTH = 0.65, 0.5, 0.1
# fixed values: weights of recall and precision
WEIGHTS = (0.25, 0.75)


def path_distance(a: Column, b: Column) -> Column:
    """Steps between the folders of two paths through their last common folder; names aren't counted."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n, m = F.size(x) - 1, F.size(y) - 1
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, m), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (i <= n) & (i <= m) & (F.get(x, i - 1) == F.get(y, i - 1)), i).otherwise(acc),
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(n + m - 2 * shared)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0.0 if one has length 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def number_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def scaled(name: str, x: Column) -> Column:
    """A feature from 0 to 1, 1 the most alike: logarithm, clamp, scale, then distances turned over."""
    x = number_or_null(x)
    x = F.log1p(x) if name in LOGARITHMS else x
    # greatest and least leave nulls out
    x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(FEATURE_MAX[name])) / FEATURE_MAX[name])
    return F.abs(1 - x) if name in DISTANCES else x


def logistic(terms: list[Column], intercept: float) -> Column:
    z = F.lit(intercept)
    for t in terms:
        z = z + t
    return 1 / (1 + F.exp(-z))


def near_miss(x: Column) -> Column:
    """Whether a certainty, null as 0, is about 0.5."""
    return F.abs(F.coalesce(x, F.lit(0.0)) - NEAR) <= NEAR_WIDTH + 1e-5 * NEAR


def balanced(recall: Column, precision: Column) -> Column:
    """Weighted harmonic mean; 0.0 if a part is about 0."""
    low = (F.abs(recall) <= 1e-8) | (F.abs(precision) <= 1e-8)
    return F.when(low, 0.0).otherwise(1 / (WEIGHTS[0] / recall + WEIGHTS[1] / precision))


def color_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two [r, g, b]; 0.0 where one is the missing colour [-1, -1, -1]."""
    none = F.array(F.lit(-1), F.lit(-1), F.lit(-1))
    diff = F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q).cast("double")), F.lit(0.0), lambda s, v: s + v) / 3
    return F.when((a == none) | (b == none), 0.0).otherwise(diff)
