import itertools
import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm.subsequences import _blocks, frequent_subsequences, reduce_word


def subs(word, k):
    return {c for n in range(1, k + 1) for c in itertools.combinations(word, n)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=8), st.integers(1, 4))
def test_a_reduced_word_holds_the_same(word, more, k):
    short = reduce_word(word, k)
    assert subs(short, k) == subs(word, k)
    # pieces may be reduced before they are joined
    assert subs(reduce_word(short + reduce_word(more, k), k), k) == subs(word + more, k)


def test_long_words_become_short():
    rng = random.Random(1)
    assert len(reduce_word([rng.randrange(7) for _ in range(20_000)], 5)) < 300


def brute(events, share, lengths):
    by = {}
    for e, i, t, tie in events:
        if None not in (e, i, t):
            by.setdefault(e, []).append((t, tie, i))
    n = Counter()
    for rows in by.values():
        word = [i for _, _, i in sorted(rows)]
        n.update({c for c in subs(word, lengths[1]) if len(c) >= lengths[0]})
    need = max(1, math.ceil(share * len(by)))
    return {">".join(c): k for c, k in n.items() if k >= need}


def test_against_brute_force(spark, scratch):
    rng = random.Random(2)
    events = [(f"e{rng.randrange(25)}", rng.choice("aaabbcd"), rng.randrange(1000), f"{j:04d}") for j in range(260)]
    events += [("hot", rng.choice("abc"), 5, f"x{j:03d}") for j in range(16)] + [(None, "a", 1, "q"), ("e1", None, 1, "r"), ("e2", "a", None, "s"), ("lone", "zz", 1, "t")]
    rng.shuffle(events)
    df = spark.createDataFrame([(*e, "x") for e in events], "entity string, item string, time long, tie string, code string").repartition(3)
    expected = brute(events, 0.4, (2, 4))
    for a_pass in (500_000, max(1, len(expected) // 4)):
        found = frequent_subsequences(df, "2/5", (2, 4), scratch, block_entities=7, candidates_a_pass=a_pass)
        assert {r["pattern"]: r["support"] for r in found.collect()} == expected


def test_many_items_and_long_sequences(spark, scratch):
    rng = random.Random(3)
    items = [f"i{k:04d}" for k in range(3000)]
    events = []
    for e in range(300):
        word = rng.sample(items, 400) + rng.choices(items, k=200) + (["x", *rng.choices(items, k=50), "y", *rng.choices(items, k=50), "z"] if e % 5 else [])
        events += [(f"e{e}", c, t, "") for t, c in enumerate(word)]
    df = spark.createDataFrame(events, "entity string, item string, time long, tie string")
    found = {r["pattern"]: r["support"] for r in frequent_subsequences(df, "1/8", (2, 3), scratch).collect()}
    assert found["x>y>z"] == 240 and found["x>z"] == 240
    pairs = Counter()
    words = {}
    for e, c, _, _ in events:
        words.setdefault(e, []).append(c)
    some = {c for p in found for c in p.split(">")} | {"i0001", "i0002"}
    for w in words.values():
        pairs.update(subs([c for c in w if c in some and c in ("x", "y", "z", "i0001", "i0002")], 2))
    assert {">".join(p): n for p, n in pairs.items() if len(p) == 2 and n >= 38} == {p: n for p, n in found.items() if p.count(">") == 1 and set(p.split(">")) <= {"x", "y", "z", "i0001", "i0002"}}


def test_blocks_have_a_least_size():
    import pyarrow as pa

    words = [[0] * 50_000] * 700
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32()))], names=["word"])
    assert [b.n for b in _blocks(iter([batch]), 3, 250)] == [250, 450]
    assert [b.n for b in _blocks(iter([batch.slice(0, 100)]), 3, 250)] == [100]


def test_empty(spark, scratch):
    df = spark.createDataFrame([], "entity string, item string, time long, tie string")
    assert frequent_subsequences(df, "2/5", (3, 5), scratch).count() == 0
