"""Filling containers of fixed capacity by sum-of-squares packing.

Each item goes where the squared counts of open containers per gap sum up to the least; so no gap becomes common,
and gaps stay that later items can fill. Items are dealt to groups of bounded size by hash, and each group is packed by
itself: a group leaves a few open containers, the last of tens of thousands of items. Those rows are dealt and packed
once more, so only the groups of the last round leave some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.storage import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
GROUP_ROWS = 20_000
LOOSE = 0.98  # containers filled less than this are packed again in the second round


def token_counts(tokenizer: str, chunk: int = 256):
    """Adds n_tokens to batches (id, text): whole texts, special strings as ordinary text; null counts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.no_truncation()
        t.encode_special_tokens = True
        for batch in batches:
            sizes = []
            for lo in range(0, batch.num_rows, chunk):
                texts = [x or "" for x in batch.column(1).slice(lo, chunk).to_pylist()]
                sizes += [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item, taken in the order given; sizes from 1 to capacity."""
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("sizes must be from 1 to the capacity")
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(count[s:capacity])
        # the change of the sum: one container fewer at its gap, one more at what is left of it
        after = 2 * count[gaps] + 1
        if len(gaps) and gaps[0] == 0:
            after[0] = 0
        change = after + 1 - 2 * count[gaps + s]
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(np.argmin(change)) if len(gaps) else -1
        if best >= 0 and change[best] <= fresh:
            gap = int(gaps[best]) + s
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        out[i] = b
        left = gap - s
        if left:
            count[left] += 1
            open_at[left].append(b)
    return out


def _pack(capacity: int, round_: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large items first, so that small ones are left to fill the gaps; ties by id, so that no order of arrival matters
        rows = rows.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        number = sum_of_squares(rows["size"].to_numpy(), capacity)
        group = int(rows["group"].iloc[0])
        load = np.bincount(number, weights=rows["size"].to_numpy())
        return pd.DataFrame(
            {"id": rows["id"], "piece": rows["piece"], "size": rows["size"], "container": (round_ << 60) + (group << 32) + number, "load": load[number].astype(np.int64)}
        )

    return run


def pack(documents: DataFrame, capacity: int, scratch: Scratch, tokenizer: str = TOKENIZER, group_rows: int = GROUP_ROWS, loose: float = LOOSE) -> DataFrame:
    """(id, piece, first_token, n_tokens, container) of every piece of every document (id bigint, text).

    A text of up to `capacity` tokens is one piece (0); a longer one is cut at every `capacity` tokens. Null and empty
    texts have no tokens: one row of n_tokens 0 and a null container. Repeated ids are packed as rows of their own;
    a null id is kept. Token counts are those of the whole text.
    """
    counted = documents.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(token_counts(tokenizer), "id long, n_tokens long")
    pieces = counted.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("size"))
    pieces = scratch.cut(pieces, "pieces")
    n = pieces.count()

    def packed(rows: DataFrame, groups: int, round_: int) -> DataFrame:
        dealt = rows.select("id", "piece", "size", F.pmod(F.xxhash64("id", "piece", F.lit(round_)), F.lit(groups)).alias("group"))
        return dealt.groupBy("group").applyInPandas(_pack(capacity, round_), "id long, piece int, size long, container long, load long")

    first = scratch.cut(packed(pieces.where("size > 0"), max(1, -(-n // group_rows)), 0), "first")
    full = first.where(F.col("load") >= loose * capacity)
    rest = first.where(F.col("load") < loose * capacity)
    left = rest.count()
    second = packed(rest, max(1, -(-left // group_rows)), 1)
    none = pieces.where("size = 0").select("id", "piece", "size", F.lit(None).cast("long").alias("container"))
    out = full.select("id", "piece", "size", "container").unionByName(second.select("id", "piece", "size", "container")).unionByName(none)
    return out.select("id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("first_token"), F.col("size").alias("n_tokens"), "container")
