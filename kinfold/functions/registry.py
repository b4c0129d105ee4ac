"""The string and number functions as SQL functions of a session; their bodies are SQL, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(parameters) -> type: body
FUNCTIONS = {
    "kf_trunc(s STRING, n INT) RETURNS STRING": "CASE WHEN length(s) >= n THEN concat(substring(s, 1, n), '...') ELSE s END",
    "kf_short_hash(s STRING) RETURNS STRING": "substring(sha2(s, 256), 1, 32)",
    "kf_edit_distance(a STRING, b STRING) RETURNS INT": "coalesce(levenshtein(a, b), 1000)",
    "kf_bigrams(s STRING) RETURNS ARRAY<STRING>": "CASE WHEN length(s) >= 2 THEN array_distinct(transform(sequence(1, length(s) - 1), i -> substr(s, i, 2))) ELSE cast(array() AS ARRAY<STRING>) END",
    "kf_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(array_union(a, b)) = 0 THEN 0.0D ELSE cast(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) END",
    "kf_name_tokens(s STRING) RETURNS ARRAY<STRING>": "split(lower(s), '[._~+ -]')",
    "kf_copy_name(s STRING) RETURNS STRING": "CASE WHEN contains(s, '.') THEN regexp_replace(s, '\\\\.([^.]*)$', '_copy.$1') ELSE concat(s, '_copy') END",
    "kf_extension(s STRING) RETURNS STRING": "CASE WHEN contains(s, '.') THEN element_at(split(s, '\\\\.'), -1) END",
    "kf_size_text(n DOUBLE) RETURNS STRING": "CASE WHEN abs(n) <= 1e-8 THEN '---' WHEN n <= 1e6 THEN concat(format_number(n / 1e3, 1), ' Kb') WHEN n <= 1e9 THEN concat(format_number(n / 1e6, 1), ' Mb') ELSE concat(format_number(n / 1e9, 1), ' Gb') END",
    "kf_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x), sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x))), 0.0D)",
    "kf_euclidean(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0D, (s, x) -> s + x))",
    "kf_balanced(r DOUBLE, p DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(r) <= 1e-8 OR abs(p) <= 1e-8 THEN 0.0D ELSE 1 / (0.25 / r + 0.75 / p) END",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(", 1)[0] for head in FUNCTIONS]
