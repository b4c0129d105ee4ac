"""Frequent subsequences, gaps allowed, by two-phase partition mining.

Every partition of the sequences is mined at the same share of its own sequences; a pattern frequent in all is
frequent in one of them, so the union of what the partitions find holds every frequent pattern. A second pass counts
these candidates exactly over every sequence. Sequences are first reduced to the shortest ones that hold the same
subsequences up to the greatest length, so an entity of any number of events becomes a short row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.storage import Scratch

BLOCK_ENTITIES, PATTERNS_A_BATCH = 5000, 50_000
LEAST_ENTITIES, LEAST_SUPPORT, BLOCK_LETTERS = 250, 10, 4_000_000  # a block of long sequences ends sooner, but not before these
ITEMS_TO_BROADCAST, CANDIDATES_A_PASS = 50_000, 500_000


def reduce_word(word: list[int], k: int) -> list[int]:
    """The word without the letters that no subsequence of up to k letters needs.

    A letter's x is the least length at which a subsequence can need it when read from the left, its y from the
    right; it can go if x + y > k + 1. Words may be reduced piece by piece: the equivalence holds under joining.
    """
    n: dict[int, int] = {}
    top, xs = 1, []
    letters = set(word)
    n = dict.fromkeys(letters, 1)
    for c in word:
        x = n[c]
        xs.append(x)
        if x > k:
            continue
        n[c] = top = x + 1
        for a, v in n.items():
            if v > top:
                n[a] = top
    n = dict.fromkeys(letters, 1)
    kept = []
    for c, x in zip(reversed(word), reversed(xs)):
        y = n[c]
        if x + y <= k + 1:
            kept.append(c)
            n[c] = top = y + 1
            for a, v in n.items():
                if v > top:
                    n[a] = top
    kept.reverse()
    return kept


def _words(k: int):
    """Of a partition sorted by (entity, order): one reduced word for each entity in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        entity, word, done = None, [], []

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.string()), pa.array([pid] * len(done), pa.int32()), pa.array([d[1] for d in done], pa.list_(pa.int32()))], names=["entity", "pid", "word"]
            )
            done.clear()
            return out

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names, codes = batch.column(0), batch.column(1).to_pylist()
            differs = pa.compute.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
            for lo, hi in zip(cuts, cuts[1:]):
                name = names[lo].as_py()
                if name != entity and entity is not None:
                    done.append((entity, reduce_word(word, k)))
                    word = []
                entity = name
                word += codes[lo:hi]
                if len(word) > 50_000:
                    word = reduce_word(word, k)
            if len(done) > 5000:
                yield flush()
        if entity is not None:
            done.append((entity, reduce_word(word, k)))
        if done:
            yield flush()

    return run


class Block:
    """Sequences as sorted lists of places: what is kept is in proportion to their letters, however many items there are."""

    def __init__(self, words: list[list[int]], n_items: int):
        self.n, self.n_items = len(words), n_items
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=self.n)
        letters = np.fromiter((c for w in words for c in w), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(self.n), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.span = int(sizes.max(initial=0)) + 1
        # of each (sequence, item) the places in order; code = (sequence, item, place)
        self.code = np.sort((of * n_items + letters) * self.span + place)
        own = self.code // self.span
        last = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]])) if len(own) else np.zeros(0, dtype=np.int64)
        self.of, self.item, self.last = own[last] // n_items, own[last] % n_items, self.code[last] % self.span

    def supports(self, at: np.ndarray) -> np.ndarray:
        """For every item, in how many sequences it stands at the place `at` or later."""
        return np.bincount(self.item[self.last >= at[self.of]], minlength=self.n_items)

    def after(self, at: np.ndarray, item: int) -> np.ndarray:
        """The places behind the first such item at `at` or later in each sequence; span where there is none."""
        alive = np.flatnonzero(at < self.span)
        own = (alive * self.n_items + item) * self.span
        found = np.searchsorted(self.code, own + at[alive])
        code = self.code[np.minimum(found, len(self.code) - 1)]
        there = (found < len(self.code)) & (code < own + self.span)
        out = np.full(self.n, self.span, dtype=np.int64)
        out[alive[there]] = (code - own)[there] + 1
        return out

    def extensions(self, choose, depth: int, at: np.ndarray | None = None, pattern: tuple = ()) -> Iterator[tuple[tuple, int]]:
        """(pattern, support) of the extensions that choose(pattern, supports) accepts, depth first; one list of places a level
        is held."""
        at = np.zeros(self.n, dtype=np.int64) if at is None else at
        support = self.supports(at)
        for c in choose(pattern, support):
            yield (*pattern, c), int(support[c])
            if depth > 1:
                yield from self.extensions(choose, depth - 1, self.after(at, c), (*pattern, c))


def _blocks(batches: Iterator[pa.RecordBatch], n_items: int, least: int) -> Iterator[Block]:
    """Blocks of BLOCK_ENTITIES sequences, or of at least `least` if they have BLOCK_LETTERS letters; the last of a partition
    may be smaller only if it is the only one."""
    held, ready, letters = [], None, 0
    for batch in batches:
        for word in batch.column(0).to_pylist():
            held.append(word)
            letters += len(word)
            if len(held) >= BLOCK_ENTITIES or len(held) >= least and letters >= BLOCK_LETTERS:
                if ready:
                    yield Block(ready, n_items)
                ready, held, letters = held, [], 0
    if ready and len(held) >= least:
        yield Block(ready, n_items)
        ready = None
    if ready or held:
        yield Block([*(ready or []), *held], n_items)


def _mine(n_items: int, share: Fraction, length: int):
    """Phase one: patterns with the share of a block's sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, n_items, max(LEAST_ENTITIES, math.ceil(LEAST_SUPPORT / share))):
            need = max(1, math.ceil(share * block.n))
            found = []
            for p, _ in block.extensions(lambda _, s, need=need: np.flatnonzero(s >= need).tolist(), length):
                found.append(list(p))
                if len(found) >= PATTERNS_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["pattern"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["pattern"])

    return run


def _count(n_items: int, children: dict[tuple, list[int]], number: dict[tuple, int], length: int):
    """Phase two: support of every candidate. children: what to go on with, also from prefixes that are counted elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), dtype=np.int64)
        for block in _blocks(batches, n_items, LEAST_ENTITIES):
            for p, support in block.extensions(lambda p, _: children.get(p, ()), length):
                if p in number:
                    total[number[p]] += support
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["i", "support"])

    return run


def frequent_subsequences(events: DataFrame, share: str | Fraction, lengths: tuple[int, int], scratch: Scratch, block_entities: int = BLOCK_ENTITIES, candidates_a_pass: int = CANDIDATES_A_PASS) -> DataFrame:
    """(pattern, support) of the item sequences of lengths[0] to lengths[1], items joined by '>', that the given
    share of all entities hold in order, gaps and repeats allowed.

    events: (entity, item, time, tie), ordered by time, then tie (rows equal in both are ordered by item). Rows with
    a null in entity, item or time are left out; entities without other rows don't count. Items below the share are
    left out before sequences are built, as no frequent pattern holds them. An empty table gives an empty result.
    The list of frequent items has at most (distinct items an entity, on average) / share entries. Candidates are counted in
    passes of about candidates_a_pass neighbours in the order of patterns, so the driver holds no more of them at a time.
    """
    spark, share = events.sparkSession, Fraction(share)
    events = scratch.cut(events.where("entity is not null and item is not null and time is not null").select("entity", "item", "time", "tie"), "events")
    held = scratch.cut(events.select("entity", "item").distinct(), "held")
    total = held.select("entity").distinct().count()
    need = max(1, math.ceil(share * total))
    items = sorted(r[0] for r in held.groupBy("item").count().where(F.col("count") >= need).select("item").collect())
    empty = spark.createDataFrame([], "pattern string, support long")
    if not items:
        return empty
    k = lengths[1]
    codes = spark.createDataFrame(list(enumerate(items)), "code int, item string")
    coded = events.join(F.broadcast(codes) if len(items) <= ITEMS_TO_BROADCAST else codes, "item")
    # the order is part of the range, so a long sequence spreads over partitions
    ordered = coded.repartitionByRange("entity", "time", "tie").sortWithinPartitions("entity", "time", "tie", "item").select("entity", "code")
    words = ordered.mapInArrow(_words(k), "entity string, pid int, word array<int>")
    joined = words.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("pid", "word"))).alias("w"))
    sequences = scratch.cut(joined.select(F.flatten(F.col("w.word")).alias("word")).repartition(max(1, math.ceil(total / block_entities))), "sequences")

    local = sequences.mapInArrow(_mine(len(items), share, k), "pattern array<int>").where(F.size("pattern") >= lengths[0]).distinct()
    local, seen = scratch.measured(local, "candidates", n=F.count(F.lit(1)))
    passes = max(1, math.ceil(seen["n"] / candidates_a_pass))
    if passes > 1:
        # ranges of patterns in their order, so a pass holds neighbours that share their prefixes
        local = scratch.cut(local.repartitionByRange(passes, "pattern").withColumn("pass", F.spark_partition_id()), "passes")
    out = None
    for i in range(passes):
        some = local if passes == 1 else local.where(F.col("pass") == i)
        patterns = [tuple(r[0]) for r in some.select("pattern").collect()]
        number = {p: i for i, p in enumerate(patterns)}
        children: dict[tuple, set[int]] = {}
        for p in patterns:
            for d in range(len(p)):
                children.setdefault(p[:d], set()).add(p[d])
        ways = {p: sorted(c) for p, c in children.items()}
        counted = sequences.mapInArrow(_count(len(items), ways, number, k), "i long, support long").groupBy("i").agg(F.sum("support").alias("support"))
        counted = counted.where(F.col("support") >= need)
        named = spark.createDataFrame([(i, ">".join(items[c] for c in p)) for p, i in number.items()], "i long, pattern string")
        part = counted.join(named, "i").select("pattern", "support")
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out
