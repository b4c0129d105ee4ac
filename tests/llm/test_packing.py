import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm.packing import pack, sum_of_squares


def brute(sizes, capacity):
    """Tries every open container and a new one, and takes the least sum of squares; ties as the operator."""
    bins, out = [], []

    def cost(gaps):
        n = {}
        for g in gaps:
            if 0 < g < capacity:
                n[g] = n.get(g, 0) + 1
        return sum(v * v for v in n.values())

    for s in sizes:
        options = []
        for b, gap in enumerate(bins):
            if gap >= s:
                options.append((cost([*bins[:b], gap - s, *bins[b + 1 :]]), 0, gap))
        options.append((cost([*bins, capacity - s]), 1, capacity))
        best = min(options)
        out.append(best[0])
        if best[1]:
            bins.append(capacity - s)
        else:
            b = max(i for i, g in enumerate(bins) if g == best[2])
            bins[b] -= s
    return out, bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_steps_are_the_least(sizes):
    number = sum_of_squares(np.array(sizes, dtype=np.int64), 12)
    costs, bins = brute(sizes, 12)
    load = np.bincount(number, weights=sizes) if sizes else np.zeros(0)
    assert (load <= 12).all()
    assert sorted(load.astype(int).tolist()) == sorted(12 - g for g in bins)


def test_pack(spark, scratch):
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 90, 300))]
    texts += [(1000, "word " * 250), (1001, None), (1002, ""), (1003, "<|endoftext|>"), (None, "word"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "id long, text string, size int").repartition(3)
    rows = pack(df, 100, scratch, group_rows=120).collect()
    load, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        if r["container"] is not None:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
    assert max(load.values()) <= 100
    total = sum(load.values())
    assert total / 100 / len(load) > 0.9
    assert [p for p in sorted(pieces[1000])] == [(0, 0, 100), (1, 100, 100), (2, 200, sum(p[2] for p in pieces[1000]) - 200)]
    assert [r["container"] for r in rows if r["id"] in (1001, 1002)] == [None, None] and pieces[1001] == [(0, 0, 0)]
    assert pieces[1003][0][2] > 1 and None in pieces and len(pieces[5]) == 2
    assert pack(df.limit(0), 100, scratch).count() == 0


def test_large_sample_is_well_filled():
    sizes = np.random.default_rng(1).integers(20, 900, 5000)
    number = sum_of_squares(np.sort(sizes)[::-1], 2048)
    assert sizes.sum() / 2048 / (number.max() + 1) > 0.99
    with pytest.raises(ValueError):
        sum_of_squares(np.array([2049]), 2048)
