"""References to records that are missing, withdrawn or arrive later, found with key bitmaps.

Keys of targets and references get integer codes in one dictionary table. Per kind of target, range of codes
and period, one bitmap holds the keys that are referenced; others hold the live targets by the period of their
first arrival. Reference AND NOT (live targets of earlier periods) leaves the keys that can be at fault; they are
decoded through the dictionary, and only the rows that name them are compared with their target exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.storage import Scratch

RANGE_BITS = 15  # 32,768 keys in a bitmap, Spark's own bitmap size
NEVER = -1  # the period of a row without arrival: no target counts as earlier


def period_of(ts: F.Column) -> F.Column:
    """Months since year 0; NEVER where the time is null."""
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(NEVER))


def target_states(df: DataFrame, kind: str, scope: str, key: str, withdrawn: str, arrived: str) -> DataFrame:
    """(kind, scope, key, first, dead): first arrival of any version, and whether the newest version is withdrawn.

    If versions tie for the newest, one that is withdrawn counts. Null scopes and keys can't be referenced.
    """
    last = F.max(arrived)
    return (
        df.where(F.col(scope).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.lit(kind).alias("kind"), F.col(scope).alias("scope"), F.col(key).alias("key"))
        .agg(
            F.min(arrived).alias("first"),
            F.max(F.when(F.col(withdrawn), F.coalesce(arrived, F.lit("0001-01-01").cast("timestamp_ntz")))).alias("__dead_at"),
            F.coalesce(last, F.lit("0001-01-01").cast("timestamp_ntz")).alias("__last"),
        )
        .select("kind", "scope", "key", "first", F.coalesce(F.col("__dead_at") >= F.col("__last"), F.lit(False)).alias("dead"))
    )


@F.pandas_udf(T.BinaryType())
def _pack(bitmaps: pd.Series) -> pd.Series:
    return bitmaps.map(lambda b: zlib.compress(bytes(b), 1))


def _surviving(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: bits of each period's references that no live target of an earlier period has."""
    size = (1 << RANGE_BITS) // 8
    bits = {True: {}, False: {}}
    for is_ref, period, packed in zip(rows["is_ref"], rows["period"], rows["packed"]):
        bits[bool(is_ref)][int(period)] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    targets = sorted(bits[False].items())
    held, at, codes, periods = np.zeros(size, dtype=np.uint8), 0, [], []
    first = int(rows["range"].iloc[0]) << RANGE_BITS
    for period, refs in sorted(bits[True].items()):
        while at < len(targets) and targets[at][0] < period:
            held, at = held | targets[at][1], at + 1
        left = np.flatnonzero(np.unpackbits(refs & ~held, bitorder="little"))
        codes.append(first + left)
        periods.append(np.full(len(left), period))
    codes = np.concatenate(codes) if codes else np.zeros(0)
    return pd.DataFrame({"code": codes.astype(np.int64), "period": np.concatenate(periods).astype(np.int32) if periods else np.zeros(0, np.int32)})


def faulty_references(refs: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """References whose target is missing, dead or late.

    refs: (kind, scope, key, at, and columns of the row); targets: as `target_states` gives them, united over
    kinds. Returns the columns of refs and reason: 'missing' without target; else 'deleted' if it is dead; else
    'late' if it first arrived after `at`. A null `at` or first arrival is never late. Null scopes or keys are no
    references. Repeated references are all returned. Hot keys are aggregated before they are shuffled, and the
    rows that name a surviving key are joined with one row a key, which adaptive execution splits.
    """
    refs = scratch.cut(refs.where("scope is not null and key is not null").withColumn("__period", period_of(F.col("at"))), "refs")
    named = refs.groupBy("kind", "scope", "key").agg(F.collect_set("__period").alias("periods"))  # at most one entry a month
    known = targets.select("kind", "scope", "key", "first", "dead", F.lit(True).alias("is_target"), F.array().cast("array<int>").alias("periods"))
    asked = named.select("kind", "scope", "key", F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(False).alias("dead"), F.lit(False).alias("is_target"), "periods")
    dictionary = (
        known.unionByName(asked)
        .groupBy("kind", "scope", "key")
        .agg(F.min("first").alias("first"), F.max("dead").alias("dead"), F.max("is_target").alias("is_target"), F.flatten(F.collect_list("periods")).alias("periods"))
        .withColumn("code", F.monotonically_increasing_id())
    )
    dictionary = scratch.cut(dictionary, "dictionary")

    place = [F.shiftright("code", RANGE_BITS).alias("range"), F.col("code").bitwiseAND((1 << RANGE_BITS) - 1).alias("bit")]
    asked_bits = dictionary.select("kind", *place, F.lit(True).alias("is_ref"), F.explode("periods").alias("period"))
    live_bits = dictionary.where("is_target and not dead").select("kind", *place, F.lit(False).alias("is_ref"), period_of(F.col("first")).alias("period"))
    bitmaps = (
        asked_bits.unionByName(live_bits)
        .groupBy("kind", "range", "is_ref", "period")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        .select("range", "is_ref", "period", "kind", _pack("bitmap").alias("packed"))
    )
    left = bitmaps.groupBy("kind", "range").applyInPandas(_surviving, "code long, period int")

    suspects = dictionary.select("code", "kind", "scope", "key", "first", "dead", "is_target").join(left, "code")
    suspects = suspects.select("kind", "scope", "key", F.col("period").alias("__period"), "first", "dead", "is_target")
    reason = (
        F.when(~F.col("is_target"), "missing").when(F.col("dead"), "deleted").when(F.col("first") > F.col("at"), "late")
    )
    found = refs.join(suspects, ["kind", "scope", "key", "__period"]).withColumn("reason", reason)
    return found.where("reason is not null").drop("__period", "first", "dead", "is_target")
