"""Exact places of rows within groups of any size.

Rows are range-partitioned and sorted on (group, order), so a group spreads over as many partitions as it needs. The
counts of the groups that partitions end with, prefix-summed over the partitions, turn the place within a partition into
the place within the group. Of each partition only its last group's count is needed: one row a partition.
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


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Indices of the rows of a sorted batch whose key differs from the row before; 0 is left out."""
    n, differs = batch.num_rows, np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        col = batch.column(batch.schema.get_field_index(k))
        differs |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def _placed(keys: list[str]):
    """Adds the place within the partition's run of the group, and at the end one row more with the negative count of the
    last group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before, last, end = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            begin = np.concatenate([[0], _starts(batch, keys)]).astype(np.int64)
            base = np.zeros(batch.num_rows, dtype=np.int64)
            base[begin] = begin
            place = np.arange(batch.num_rows) - np.maximum.accumulate(base) + 1
            if tuple(c[0].as_py() for c in at) == last:
                place[: begin[1] if len(begin) > 1 else None] += before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(place), pid, dtype=np.int32))], names=[*batch.schema.names, "place", "pid"])
            before, end = int(place[-1]), batch.slice(batch.num_rows - 1)
            last = tuple(c[batch.num_rows - 1].as_py() for c in at)
        if end is not None:
            yield pa.RecordBatch.from_arrays([*end.columns, pa.array([-before], type=pa.int64()), pa.array([pid], type=pa.int32())], names=[*end.schema.names, "place", "pid"])

    return run


def places(rows: DataFrame, keys: list[str], order: list, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """Rows with their place (bigint, from 1) in the order of their group (keys).

    order: sort expressions that should make the order total; rows equal in all of them take places in no fixed order,
    and repeated rows take one each. Keys must not be null. rows has no columns place and pid.
    """
    spread = rows.repartitionByRange(partitions, *keys, *order) if partitions else rows.repartitionByRange(*keys, *order)
    ordered = spread.sortWithinPartitions(*keys, *order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("place", T.LongType()), T.StructField("pid", T.IntegerType())])
    placed = scratch.cut(ordered.mapInArrow(_placed(keys), schema), "placed")
    tails = placed.where("place < 0").select(*keys, "pid", (-F.col("place")).alias("size"))
    # where such a group goes on, prefix sums over the partitions; at most two rows a partition
    heads = placed.where("place > 0").select(*keys, "pid").distinct().join(tails.select(*keys).distinct(), keys, "left_semi")
    runs = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = tails.unionByName(heads.withColumn("size", F.lit(0).cast("long"))).groupBy(*keys, "pid").agg(F.sum("size").alias("size"))
    sums = sums.select(*keys, "pid", F.coalesce(F.sum("size").over(runs), F.lit(0)).alias("__before"))
    out = placed.where("place > 0").join(sums, [*keys, "pid"], "left").withColumn("place", F.col("place") + F.coalesce("__before", F.lit(0)))
    return out.select(*rows.columns, "place")


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Samples: the first n rows of each group with their place (bigint), n being small; each task sends on no more than n rows
    a group. Ties as in `places`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", at).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))
