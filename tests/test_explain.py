import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kinfold.functions import sets
from kinfold.operators import explain


def test_greedy_tokens():
    inside = [{"a", "x"}, {"a", "y"}, {"b"}]
    outside = [{"a"}, {"c"}, {"x"}]
    rule, score = explain.greedy_tokens(inside, outside)
    assert rule == [["a"], ["b"]] and score == explain.balanced(1.0, 3 / 4)
    assert explain.greedy_tokens([set()], [{"a"}]) == ([], 0.0)


def test_best_split_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 5, (12, 2)).astype(float), rng.integers(0, 2, 12).astype(float)
        best = min(
            (round(sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[x[:, f] <= t], y[x[:, f] > t])), 9)) for f in range(2) for t in np.unique(x[:, f])[:-1]
        )
        assert explain.best_split(x, y)[0] == best
    assert explain.best_split(np.ones((3, 1)), np.array([0.0, 1.0, 1.0])) is None


def test_tree_separates_and_groups_run_apart(spark, scratch):
    rows = [("u", f"{i}", i >= 5, float(i), 1.0) for i in range(10)] + [("v", "1", True, 1.0, float("nan")), ("v", "2", None, 1.0, 1.0), ("v", "3", True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scope string, item string, label boolean, f double, g double")
    found = {tuple(r) for r in explain.leaves(df, ["f", "g"], scratch).collect()}
    assert found == {("u", "f <= 4.5", 5, 0), ("u", "f > 4.5", 5, 5), ("v", "all", 1, 1)}
    tokens = spark.createDataFrame([("u", "p", "1", ["a", ""]), ("u", "q", "2", ["b"]), ("u", "q", "3", None)], "scope string, grp string, item string, tokens array<string>")
    assert {(r["grp"], r["rule"]) for r in explain.token_sets(tokens, scratch).collect()} == {("p", "a"), ("q", "b")}


def test_sets_and_quotas(spark):
    df = spark.createDataFrame([([["a", "b"], ["b", "c"]],), ([],)], "s array<array<string>>")
    assert [r[0] for r in df.select(sets.intersect_all(F.col("s"))).collect()] == [["b"], []]
    assert [r[0] for r in df.select(sets.union_all(F.col("s"))).collect()] == [["a", "b", "c"], []]
    assert spark.createDataFrame([(["a", "b"],), (None,)], "t array<string>").select(sets.holds(F.col("t"), [["c"], ["a", "b"]])).collect() == [(True,), (False,)]
    assert sets.even_partition(7, 3) == [3, 2, 2]
    for total, available in itertools.product((0, 5, 20), ([3, 1, 9], [0, 0], [10, 10])):
        taken = sets.quotas(total, available)
        assert sum(taken) == min(total, sum(available)) and all(t <= a for t, a in zip(taken, available))
    assert sets.quotas(9, [1, 9, 9]) == [1, 4, 4]


def test_leaves_count_all_rows_not_the_sample(spark, scratch):
    rows = [("u", f"{i}", i >= 50, float(i >= 50), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "scope string, item string, label boolean, f double, g double")
    found = {tuple(r) for r in explain.leaves(df, ["f", "g"], scratch, sample=40).collect()}
    assert found == {("u", "f <= 0.5", 50, 0), ("u", "f > 0.5", 150, 150)}


def test_token_sets_equal_the_greedy_search_over_all_items(spark, scratch):
    rng = random.Random(5)
    rows = [(rng.choice("uv"), f"g{rng.randrange(4)}", f"{i}", rng.sample("abcdefgh", rng.randrange(0, 5)) + [""]) for i in range(120)]
    rows += [("u", "g0", "0", ["a"]), ("w", "only", "1", ["z", "z"]), ("w", "only", "2", None), ("x", "none", "3", []), (None, "g", "4", ["a"]), ("u", None, "5", ["a"])]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "scope string, grp string, item string, tokens array<string>, best double, done boolean")
    expected = {}
    for scope in "uvwx":
        own = [(g, set(t or ()) - {""}) for s, g, _, t in rows if s == scope and g]
        for grp in {g for g, _ in own}:
            rule, score = explain.greedy_tokens([t for g, t in own if g == grp], [t for g, t in own if g != grp])
            if rule:
                expected[scope, grp] = (" or ".join("+".join(s) for s in rule), score)
    found = {(r["scope"], r["grp"]): (r["rule"], r["score"]) for r in explain.token_sets(df, scratch).collect()}
    assert found == expected and any(" or " in r for r, _ in found.values()) and any("+" in r for r, _ in found.values())
    assert explain.token_sets(df.limit(0), scratch).count() == 0
