"""Conjunctive search over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text

DAY = 86400


def condition(
    word: str | None = None, name: str | None = None, owner: str | None = None, kind: str | None = None, days: int | None = None, now: str | None = None,
    columns: dict[str, str] | None = None,
) -> Column:
    """AND of what is given: a word of the text, a part of the name, the owner, the kind, and an age in days before `now`.

    Words and names are compared in lower case; nulls match nothing. The plain comparisons reach the scan.
    """
    c = {"text": "text", "name": "fname", "owner": "user_id", "kind": "gentype", "time": "ingested_at"} | (columns or {})
    parts = []
    if owner is not None:
        parts.append(F.col(c["owner"]) == owner)
    if kind is not None:
        parts.append(F.col(c["kind"]) == kind)
    if days is not None:
        parts.append(F.col(c["time"]) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))
    if name is not None:
        parts.append(F.lower(c["name"]).contains(name.lower()))
    if word is not None:
        parts.append(F.array_contains(text.words(F.col(c["text"])), word.lower()))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(documents: DataFrame, **wanted) -> DataFrame:
    return documents.where(condition(**wanted))
