"""Records as of a time, differences of two states, and values carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.versions import newest

DAY = 86400


def as_of(df: DataFrame, keys: list[str], when: str, columns: list[str], arrived: str = "ingested_at") -> DataFrame:
    """Newest versions among the rows that had arrived by the time (inclusive)."""
    return newest(df.where(F.col(arrived) <= F.lit(when).cast(df.schema[arrived].dataType)), keys, arrived, columns)


def difference(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change): 'added', 'removed' or 'changed' (null-safe, in any of the columns); equal rows are left out.

    Each side has one row a key, without nulls in it.
    """
    o = old.select(*keys, F.struct(*columns).alias("__old"))
    n = new.select(*keys, F.struct(*columns).alias("__new"))
    both = o.join(n, keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def carried(rows: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Rows with `carried`: the last value that isn't null up to the row, in the order (time, tie) of its key; the value
    column, time (epoch seconds) and tie must be named apart from 'carried'. Null without one; null times come first.

    A key is cut into days: windows run within a day, and over the days' last values, one row a day.
    """
    day = F.coalesce(F.floor(F.col(time) / DAY), F.lit(-(2**40)))
    dated = rows.withColumn("__day", day)
    order = [F.col(time).asc_nulls_first(), F.col(tie)]
    within = Window.partitionBy(key, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = dated.withColumn("__own", F.last(value, ignorenulls=True).over(within))
    last = dated.where(F.col(value).isNotNull()).groupBy(key, "__day").agg(F.max_by(value, F.struct(F.col(time), F.col(tie))).alias("__v"))
    days = dated.select(key, "__day").distinct().join(last, [key, "__day"], "left")
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.last("__v", ignorenulls=True).over(before)).drop("__v")
    out = filled.join(days, [key, "__day"], "left")
    return out.withColumn("carried", F.coalesce("__own", "__before")).drop("__day", "__own", "__before")
