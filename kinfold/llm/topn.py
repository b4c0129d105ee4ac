"""The best rows of every group, by one global sort.

Rows are range-partitioned and sorted on (group, order) as a whole, so a group of any size spreads over as many partitions as
it needs. A partition counts the rows of its groups as they pass; the count of the group that it ends with, summed over
the partitions before, turns the place within a partition into the exact place within the group. Only groups that go on
from one partition to the next need such sums: at most two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.storage import Scratch

_PLACE, _PARTITION, _COUNT = "__place", "__partition", "__count"


def _best_of_partition(width: int, n: int):
    """Of sorted batches whose first `width` columns are the group: the rows at places up to n of their run, with the place and
    the partition; and one row for the last run, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, so_far = TaskContext.get().partitionId(), None, 0

        def out(batch: pa.RecordBatch, place: np.ndarray, count: int) -> pa.RecordBatch:
            k = batch.num_rows
            extra = [pa.array(place, pa.int64()), pa.array(np.full(k, pid), pa.int32()), pa.array(np.full(k, count), pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, _PLACE, _PARTITION, _COUNT])

        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            keys, fresh = batch.columns[:width], np.zeros(k, dtype=bool)
            for column in keys:
                fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, k - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = tuple(c[0].as_py() for c in keys) != last
            begin = np.maximum.accumulate(np.where(fresh, np.arange(k), 0))
            place = np.arange(k) - begin + 1
            place[: int(np.argmax(fresh)) if fresh.any() else k] += so_far
            some = np.flatnonzero(place <= n)
            yield out(batch.take(pa.array(some)), place[some], 0)
            so_far, end = int(place[-1]), batch.slice(k - 1)
            last = tuple(c[k - 1].as_py() for c in keys)
        if so_far:
            yield out(end, np.zeros(1, dtype=np.int64), so_far)

    return run


def top_n(rows: DataFrame, group: list[str], order: list, n: int, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """The first n rows of every group in the given order, with their place (bigint, from 1).

    order: sort expressions that make the order total, so that no tie is left to chance; rows equal in all of them take places
    in no fixed order, and repeated rows take one each. Rows with a null in the group are left out. Other columns of any
    name are kept; none may be named place. An empty table gives an empty result.
    """
    named = [c for c in rows.columns if c not in group]
    held = rows.select(*group, *named).dropna(subset=group)
    by = [*group, *order]
    ordered = (held.repartitionByRange(partitions, *by) if partitions else held.repartitionByRange(*by)).sortWithinPartitions(*by)
    schema = T.StructType([*ordered.schema.fields, T.StructField(_PLACE, T.LongType()), T.StructField(_PARTITION, T.IntegerType()), T.StructField(_COUNT, T.LongType())])
    best = scratch.cut(ordered.mapInArrow(_best_of_partition(len(group), n), schema), "best")
    ends = best.where(F.col(_COUNT) > 0).select(*group, _PARTITION, F.col(_COUNT).alias("__n"))
    # a partition other than the first of a group begins with it, so its first place is there
    goes_on = best.where(F.col(_PLACE) == 1).select(*group, _PARTITION).join(ends.select(*group).distinct(), group, "left_semi").withColumn("__n", F.lit(0).cast("long"))
    before = Window.partitionBy(*group).orderBy(_PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    each = ends.unionByName(goes_on).groupBy(*group, _PARTITION).agg(F.sum("__n").alias("__n"))
    sums = each.select(*group, _PARTITION, F.sum("__n").over(before).alias("__before")).where("__before > 0")
    placed = best.where(F.col(_PLACE) > 0).join(sums, [*group, _PARTITION], "left")
    placed = placed.withColumn("place", F.col(_PLACE) + F.coalesce("__before", F.lit(0))).where(F.col("place") <= n)
    return placed.select(*rows.columns, "place")
