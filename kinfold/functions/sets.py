"""Operations on arrays taken as sets, and quotas over strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect_all(sets: Column) -> Column:
    """Entries that all arrays of an array of arrays have; none of an empty array."""
    return F.when(F.size(sets) > 0, F.aggregate(sets, F.get(sets, F.lit(0)), lambda a, b: F.array_intersect(a, b))).otherwise(F.slice(F.flatten(sets), 1, 0))


def union_all(sets: Column) -> Column:
    """Distinct entries of all arrays of an array of arrays."""
    return F.array_distinct(F.flatten(sets))


def holds(tokens: Column, any_of: list[list[str]]) -> Column:
    """Whether an array holds all tokens of at least one of the lists; False for a null array."""
    each = [reduce(lambda a, b: a & b, (F.array_contains(tokens, t) for t in some), F.lit(True)) for some in any_of]
    return F.coalesce(reduce(lambda a, b: a | b, each, F.lit(False)), F.lit(False))


def even_partition(total: int, parts: int) -> list[int]:
    """total as `parts` whole numbers that differ by one at most, the greater first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def quotas(total: int, available: list[int]) -> list[int]:
    """Shares of total over strata as even as what they have allows; what a stratum lacks goes to the others in turn."""
    taken = [0] * len(available)
    left = min(total, sum(available))
    while left:
        some = [i for i, n in enumerate(available) if taken[i] < n]
        for i, share in zip(some, even_partition(left, len(some))):
            extra = min(share, available[i] - taken[i])
            taken[i] += extra
            left -= extra
    return taken
