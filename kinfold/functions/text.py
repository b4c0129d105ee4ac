"""String functions as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that part name tokens, and those that part words of a text
NAME_SPLIT = r"[._~+ -]"
TEXT_SPLIT = r"[\r\n\-_+%^*.?!&@#$'\"| ]"

# fixed value: distance that stands for a missing name
NO_NAME_DISTANCE = 1000


def trunc(s: Column, n: int) -> Column:
    """The first n characters and '...' of strings of n or more; null and shorter ones unchanged."""
    return F.when(F.length(s) >= n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def short_hash(s: Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, 32)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; NO_NAME_DISTANCE where a name is null."""
    return F.coalesce(F.levenshtein(a, b), F.lit(NO_NAME_DISTANCE))


def ngrams(s: Column, n: int = 2) -> Column:
    """Distinct substrings of length n; none for shorter or null strings."""
    at = F.sequence(F.lit(1), F.length(s) - (n - 1))
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united distinct entries; 0.0 if both are empty, null if one is null."""
    both = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the lower-case bigrams; 0.0 where a string is null."""
    return F.coalesce(jaccard(ngrams(F.lower(a)), ngrams(F.lower(b))), F.lit(0.0))


def name_tokens(s: Column) -> Column:
    """Lower-case pieces between name separators, empty ones included."""
    return F.split(F.lower(s), NAME_SPLIT)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the name tokens; 0.0 where a string is null."""
    return F.coalesce(jaccard(name_tokens(a), name_tokens(b)), F.lit(0.0))


def copy_name(s: Column) -> Column:
    """The name of a copy: '_copy' before the last extension, or at the end without one."""
    return F.when(s.contains("."), F.regexp_replace(s, r"\.([^.]*)$", "_copy.$1")).otherwise(F.concat(s, F.lit("_copy")))


def extension(s: Column) -> Column:
    """The part after the last dot; null without a dot."""
    return F.when(s.contains("."), F.element_at(F.split(s, r"\."), -1))


def text_tokens(s: Column, tokens: int = 1000, length: int = 1000) -> Column:
    """The first `tokens` pieces of a text, each cut to `length`."""
    return F.transform(F.slice(F.split(s, TEXT_SPLIT), 1, tokens), lambda t: F.substring(t, 1, length))


def prefixes(s: Column, least: int = 2, most: int = 999) -> Column:
    """Distinct lower-case prefixes of at least `least` characters, shortest first."""
    n = F.least(F.length(s), F.lit(most))
    return F.when(F.length(s) >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.substr(F.lower(s), F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def folder_names(path: Column) -> Column:
    """Names of the folders of a path '/a/b/name', the last part left out."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))


def clean_header(s: Column) -> Column:
    """A header cell in lower case without marks and spaces."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]+", ""))


def natural_key(s: Column, width: int = 20) -> Column:
    """A sort key in which digit runs count as numbers: lower case, runs padded with zeros to `width`."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def size_text(size: Column) -> Column:
    """A size in Kb, Mb or Gb with one decimal; '---' for 0."""
    return (
        F.when(F.abs(size) <= 1e-8, "---")
        .when(size <= 1_000_000, F.concat(F.format_number(size / 1e3, 1), F.lit(" Kb")))
        .when(size <= 1_000_000_000, F.concat(F.format_number(size / 1e6, 1), F.lit(" Mb")))
        .otherwise(F.concat(F.format_number(size / 1e9, 1), F.lit(" Gb")))
    )


def words(s: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}_\p{M}]+)"), 1)


def strip_markup(s: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags out, common entities resolved, spaces united."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
