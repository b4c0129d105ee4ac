"""Values that are strict prefixes of longer values, by a self-join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.storage import Scratch

LEAST, FACTOR = 32, 4  # lengths of the hashed prefixes: 32, 128, 512 ... characters


def _length(k: Column) -> Column:
    return (F.lit(LEAST) * F.pow(F.lit(float(FACTOR)), k)).cast("int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted distinct (h, text): (h, the next text's part behind this one) where it begins with this one; and the first
    and the last row of the partition, for which `edge` is 1 and 2."""
    pid = TaskContext.get().partitionId()
    h0, t0, first = None, None, True

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["h", "text", "behind", "edge", "pid"])

    for batch in batches:
        out = []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first:
                out.append((h, t, None, 1, pid))
                first = False
            elif t.startswith(t0):
                out.append((h0, None, t[len(t0) : len(t0) + 16], 0, pid))
            h0, t0 = h, t
        if out:
            yield batch_of(out)
    if not first:
        yield batch_of([(h0, t0, None, 2, pid)])


def longer_copies(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, behind): texts that are strict prefixes of another, with the next characters of one such longer text.

    texts: (h binary, text), one row per distinct text. Texts of fewer than LEAST characters are left out, as short texts
    begin many others by chance. Every text is hashed at its greatest fixed length (it asks) and at all its fixed lengths
    (it answers); only texts that share such a hash go on. They are sorted as a whole: in sorted order a strict prefix
    stands directly before a text that it begins, so neighbours, and the edges of partitions, show every one of them.
    """
    k = F.floor(F.log(float(FACTOR), F.length("text") / LEAST) + F.lit(1e-9)).cast("int")
    long = texts.where(F.length("text") >= LEAST).select("h", k.alias("k"), "text")
    hashes = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.xxhash64(i, F.substr("text", F.lit(1), _length(i))))
    hashed = scratch.cut(long.select("h", "k", hashes.alias("hashes")), "hashed")
    # a text that answers at its own greatest length alone isn't asked: the count takes its own hash in
    each = hashed.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = hashed.select(F.element_at("hashes", -1).alias("key")).distinct().join(each, "key", "left_semi")
    held = hashed.select("h", F.explode("hashes").alias("key")).join(asked, "key", "left_semi").select("h").distinct()
    near = texts.join(scratch.cut(held, "held"), "h", "left_semi").select("h", "text")  # written first: if few, no text is shuffled for it
    ordered = near.repartitionByRange("text").sortWithinPartitions("text")
    found = scratch.cut(ordered.mapInArrow(_neighbours, "h binary, text string, behind string, edge int, pid int"), "neighbours")
    # the last row of a partition and the first of the next that has any: two rows a partition
    by = Window.orderBy("pid", "edge")
    edges = found.where("edge > 0").select("h", "text", "edge", F.lead("text").over(by).alias("next_text"))
    edges = edges.where(F.col("edge") == 2).where(F.col("next_text").startswith(F.col("text")))
    return found.where("edge = 0").select("h", "behind").unionByName(edges.select("h", F.substr("next_text", F.length("text") + 1, F.lit(16)).alias("behind")))
