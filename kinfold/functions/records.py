"""Records of files as Column expressions: attributes, stored lists and colours, codes of names and places."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import measures, text

# fixed values: letters of name codes; the greatest depth and fan of place codes, bits of their parts; tokens kept of a list
ALPHABET, OTHER = "abcdefghijklmnopqrstuvwxyz_-()", "*"
MAX_DEPTH, MAX_FAN = 20, 20
CODE_BITS = (5, 5, 118)
SHARED_TOKENS = 1000
# fixed value: the colour of what has none
NO_COLOR = (-1, -1, -1)


def shared_tokens(a: Column) -> Column:
    """The first SHARED_TOKENS entries."""
    return F.slice(a, 1, SHARED_TOKENS)


def row_id(*parts: Column | str) -> Column:
    """An id that follows from what it is an id of, so that a run that is repeated gives the same."""
    return text.short_hash(F.to_json(F.array(*(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts))))


def bigram_universe() -> list[str]:
    """The bigrams that name codes know: two different letters of ALPHABET, in its order, and OTHER for all others."""
    return ["".join(p) for p in permutations(ALPHABET, 2)] + [OTHER]


def name_code(name: Column) -> Column:
    """Places (from 0) of a name's bigrams in `bigram_universe`, the last one for those that aren't in it; ascending, distinct.

    The place follows from the letters: pairs are in the order of the first letter, then of the second without the first.
    """
    n, last = len(ALPHABET), len(ALPHABET) * (len(ALPHABET) - 1)

    def place(b: Column) -> Column:
        i, j = (F.position(F.substring(b, k, 1), F.lit(ALPHABET)) for k in (1, 2))
        return F.when((i == 0) | (j == 0) | (i == j), last).otherwise((i - 1) * (n - 1) + (j - 1) - F.when(j > i, 1).otherwise(0))

    return F.array_sort(F.array_distinct(F.transform(text.ngrams(name), place)))


def labels(stored: Column) -> Column:
    """The single-word labels of a stored list of quoted labels; none of a null."""
    return F.coalesce(F.regexp_extract_all(stored, F.lit(r"(?U)'(\w+)'"), 1), F.array().cast("array<string>"))


def color(stored: Column) -> Column:
    """The numbers of a stored 'r,g,b', an empty one as 0; the missing colour of a null."""
    parts = F.transform(F.split(stored, ","), lambda x: F.when(x == "", 0).otherwise(x.try_cast("int")))
    return F.when(stored.isNull(), F.array(*(F.lit(c) for c in NO_COLOR))).otherwise(parts)


def color_similarity(a: Column, b: Column) -> Column:
    """The colour difference; 0.0 where a colour hasn't three numbers."""
    return F.when((F.size(a) != 3) | (F.size(b) != 3), 0.0).otherwise(measures.color_difference(a, b))


def path_prefixes(path: Column) -> Column:
    """'/', '/a/', '/a/b/' of '/a/b'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def code_distance(a: Column, b: Column) -> Column:
    """Steps between two folders by the places (from the root down) of their ancestors and themselves; two below one are 0 apart."""
    n, m = F.size(a), F.size(b)
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, m), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (i <= m) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(acc)
    )
    return n + m - 2 * shared - F.when(shared < F.least(n, m), 2).otherwise(0)


def place_group(places: Column) -> Column:
    """The group number of a place code: the ancestors' places (from the root down) as digits to the base MAX_FAN; null
    beyond MAX_DEPTH."""
    digits = F.aggregate(places, F.lit(0).cast("decimal(38,0)"), lambda g, p: (g * MAX_FAN + p).cast("decimal(38,0)"))
    return F.when(F.size(places) < MAX_DEPTH, digits)


def code_bits(depth: Column, place: Column, group: Column) -> Column:
    """A place code (depth, place, group) as a string of 128 binary digits."""
    split = F.lit(2**59).cast("decimal(38,0)")
    low = F.pmod(group, split).cast("bigint")
    high = ((group - low) / split).cast("bigint")
    binary = lambda x, n: F.lpad(F.bin(x.cast("bigint")), n, "0")
    return F.concat(binary(depth, CODE_BITS[0]), binary(place, CODE_BITS[1]), binary(high, CODE_BITS[2] - 59), binary(low, 59))


def or_worst(feature: str, x: Column) -> Column:
    """A scaled feature before its distances are turned over, a null as the worst value: 1 of a distance, 0 of a similarity; turned over then."""
    number = measures.number_or_null(x)
    distance = feature in (*measures.DISTANCES, "edit_dist")
    return F.abs(1 - F.coalesce(number, F.lit(1.0))) if distance else F.coalesce(number, F.lit(0.0))


def batches(place: Column, size: int) -> Column:
    """The number (from 0) of the batch of `size` rows that a place (from 1) is in."""
    return F.floor((place - 1) / size)


def minutes_since(start: Column, now: Column) -> Column:
    """Whole minutes between two epoch seconds."""
    return F.floor((now - start) / 60)


def attributes(name: Column, path: Column, size: Column, modified: Column, shared: Column, content: Column, found: Column) -> Column:
    """What explanations know of a file, as one record."""
    tokens = text.name_tokens(name)
    own = F.array_except(tokens, F.array(F.coalesce(text.extension(F.lower(name)), F.lit(""))))
    return F.struct(
        modified.alias("date"),
        size.alias("size"),
        F.when(name.contains("."), F.array(text.extension(name))).otherwise(F.array().cast("array<string>")).alias("ext"),
        text.prefixes(name).alias("start_tokens"),
        F.array_union(own, text.prefixes(name, 2, 6)).alias("name_tokens"),
        own.alias("bare_tokens"),
        text.text_tokens(content).alias("text_tokens"),
        shared_tokens(shared).alias("shared"),
        text.folder_names(path).alias("folders"),
        found.alias("labels"),
    )
