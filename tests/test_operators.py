import datetime as dt
import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import pairs, rules, states, vectors
from kinfold.operators.comanage import DAY, comanaged, label
from kinfold.operators.places import first_rows, places
from kinfold.operators.search import search
from kinfold.operators.versions import newest


def test_newest_takes_the_last_and_breaks_ties_by_value(spark):
    t = lambda d: dt.datetime(2016, 1, d)
    rows = [("a", 1, t(1)), ("a", 2, t(3)), ("a", 3, t(2)), ("b", 1, t(1)), ("b", 5, t(1)), ("c", 9, None), ("c", 1, t(1)), (None, 1, t(1)), (None, 2, t(2))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, v int, ingested_at timestamp_ntz, rn string")
    assert {r["id"]: r["v"] for r in newest(df, ["id"], columns=["v"]).collect()} == {"a": 2, "b": 5, "c": 1, None: 2}
    assert newest(df.limit(0), ["id"]).count() == 0


def test_places_are_exact_across_partitions(spark, scratch):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, i int").repartition(5)
    found = {(r["g"], r["i"]): r["place"] for r in places(df, ["g"], [F.col("s").desc(), F.col("i").asc()], scratch, partitions=7).collect()}
    by = defaultdict(list)
    for g, s, i in rows:
        by[g].append((-s, i))
    assert found == {(g, i): n + 1 for g, v in by.items() for n, (_, i) in enumerate(sorted(v))}
    top = first_rows(df, ["g"], [F.col("s").desc(), F.col("i").asc()], 3)
    assert {(r["g"], r["place"], r["i"]) for r in top.collect()} == {(g, n, i) for (g, i), n in found.items() if n <= 3}
    assert places(df.limit(0), ["g"], ["s"], scratch).count() == 0


def test_range_and_token_rules(spark, scratch):
    rng = random.Random(5)
    rows = [("u", rng.choice("xyz"), rng.randrange(50)) for _ in range(200)] + [("u", None, 3), ("v", "x", 1)]
    df = spark.createDataFrame(rows, "scope string, grp string, value int")
    found = {(r["scope"], r["grp"]): (r["low"], r["high"], r["n_in"], r["n_out"]) for r in rules.range_rules(df, scratch).collect()}
    for (scope, grp), (low, high, n_in, n_out) in found.items():
        own = [v for s, g, v in rows if (s, g) == (scope, grp)]
        others = [v for s, g, v in rows if s == scope and g not in (grp, None) and min(own) <= v <= max(own)]
        assert (low, high, n_in, n_out) == (min(own), max(own), len(own), len(others))
    tokens = spark.createDataFrame([("u", "p", 1, ["a", "b", "a"]), ("u", "p", 2, ["a"]), ("u", "q", 3, ["a", "c", ""]), ("u", "r", 4, [])], "scope string, grp string, item int, tokens array<string>")
    best = {r["grp"]: (r["token"], r["n_in"], r["n_out"]) for r in rules.token_rules(tokens).collect()}
    assert best == {"p": ("a", 2, 1), "q": ("c", 1, 0)}


def test_carried_and_difference(spark):
    rows = [("u", 10, "1", None), ("u", 20, "2", "A"), ("u", 90_000, "3", None), ("u", 200_000, "4", "B"), ("u", 900_000, "5", None), ("u", None, "0", "Z"), ("v", 1, "1", None)]
    df = spark.createDataFrame(rows, "k string, t long, i string, h string")
    found = {(r["k"], r["i"]): r["carried"] for r in states.carried(df, "k", "t", "i", "h").collect()}
    assert found == {("u", "0"): "Z", ("u", "1"): "Z", ("u", "2"): "A", ("u", "3"): "A", ("u", "4"): "B", ("u", "5"): "B", ("v", "1"): None}
    old = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), ("c", 1, None)], "id string, v int, w string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("d", 1, None)], "id string, v int, w string")
    assert {tuple(r) for r in states.difference(old, new, ["id"], ["v", "w"]).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_pairs(spark):
    df = spark.createDataFrame([("u", "b", "a"), ("u", "a", "a"), ("u", None, "a"), ("u", "a", "c")], "user_id string, file_id_a string, file_id_b string")
    some = pairs.canonical(df, "file_id_a", "file_id_b")
    assert {tuple(r) for r in some.collect()} == {("u", "a", "b"), ("u", "a", "c")}
    assert {tuple(r) for r in pairs.degrees(some).collect()} == {("u", "a", 2), ("u", "b", 1), ("u", "c", 1)}
    assert pairs.neighbours(some, []).count() == 4


def test_comanaged_pairs(spark, scratch):
    rows = [("u", 0, "t", "1"), ("u", 50, "t", "2"), ("u", 60, "s", "3"), ("u", 500, "t", "4"), ("u", 501, "t", "4"), (None, 1, "t", "5"), ("u", 510, None, "6"), ("u", 511, None, "7")]
    df = spark.createDataFrame(rows, "key string, time long, target string, item string")
    assert {(r["a"], r["b"], r["target"]) for r in comanaged(df, 100, scratch).collect()} == {("1", "2", "t")}


def test_rows_without_item_or_time_count_to_sessions(spark, scratch):
    rows = [("u", 0, "t", "1"), ("u", 90, None, None), ("u", 180, "t", "2"), ("u", 500, "t", None), ("v", None, "t", "8"), ("v", None, "t", "9"), ("v", 0, "t", "1"), ("v", 0, "t", "2"), ("w", 0, "t", "1"), ("w", 0, "t", "2")]
    found = comanaged(spark.createDataFrame(rows, "key string, time long, target string, item string"), 100, scratch, 4)
    # u has two sessions with two rows each; v three with one each, as rows without a time are one by themselves
    assert {tuple(r) for r in found.select("key", "session_start", "a", "b").collect()} == {("u", 0, "1", "2"), ("w", 0, "1", "2")}


def test_comanaged_pairs_of_sessions_above_their_limit(spark, scratch):
    rng = random.Random(13)
    sizes = [("k", 0, 3), ("k", 5000, 4), ("k", 10000, 12), ("l", 0, 8), ("m", 0, 9), ("m", 5000, 2)]
    rows = [(key, start + rng.randrange(3) * 50, rng.choice("st"), f"{key}{start}{i}") for key, start, size in sizes for i in range(size)]
    expected = set()
    for key, start, _ in sizes:
        own = sorted((r for r in rows if r[0] == key and start <= r[1] < start + 200), key=lambda r: hashlib.sha256(r[3].encode()).hexdigest())
        own = own[: max(8 // sum(s[0] == key for s in sizes), 1)]
        expected |= {(key, min(r[1] for r in rows if r[0] == key and start <= r[1] < start + 200), t, a, b) for _, _, t, a in own for _, _, u, b in own if t == u and a < b}
    found = comanaged(spark.createDataFrame(rows, "key string, time long, target string, item string"), 200, scratch, 8)
    assert {tuple(r) for r in found.select("key", "session_start", "target", "a", "b").collect()} == expected and expected


def test_comanaged_pairs_of_all_rows(spark, scratch):
    """Groups in one, two and many blocks, with repeated rows and rows without key, time, target or item."""
    rng = random.Random(16)
    rows = [(key, start + rng.randrange(3) * 50, t, f"{rng.randrange(2 * size)}") for key, start, t, size in [("k", 0, "s", 40), ("k", 0, "t", 5), ("k", 5000, "t", 9), ("l", 0, "s", 1)] for _ in range(size)]
    odd = [(None, 0, "s", "x"), ("k", None, "s", "x"), ("k", 50, None, "x"), ("k", 50, None, "y"), ("k", 50, "s", None)]
    starts = {by: min(r[1] for r in rows if (r[0], r[1] // 5000) == by) for by in {(r[0], r[1] // 5000) for r in rows}}
    expected = {(r[0], starts[r[0], r[1] // 5000], r[2], r[3], o[3]) for r in rows for o in rows if r[0] == o[0] and r[1] // 5000 == o[1] // 5000 and r[2] == o[2] and r[3] < o[3]}
    df = spark.createDataFrame(rows + rows[:20] + odd, "key string, time long, target string, item string")
    for block in (4, 1000):
        found = [tuple(r) for r in comanaged(df, 200, scratch, None, block).select("key", "session_start", "target", "a", "b").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_sessions_of_long_gaps_are_joined_back_without_a_broadcast(spark, scratch):
    rng, gap = random.Random(12), 90 * DAY
    rows = [(rng.choice("kl"), rng.randrange(-400, 4000) * DAY // 2, str(i)) for i in range(120)] + [("k", 0, "x"), ("k", gap, "y"), ("k", 0, "z")]
    found = label(spark.createDataFrame(rows, "key string, time long, item string"), gap, scratch)
    expected = {}
    for key in "kl":
        run = []
        for _, t, item in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            run = [*run, (t, item)] if run and t - run[-1][0] <= gap else [(t, item)]
            expected |= {i: (key, run[0][0], t) for _, i in run}
    assert {r["item"]: (r["key"], r["session_start"], r["session_end"]) for r in found.collect()} == expected and len(set(expected.values())) > 4
    assert found.count() == len(rows) and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    found = {(r["query_id"], r["place"]): r["other_id"] for r in vectors.nearest(df, df.where("id % 20 = 0"), 4, queries_a_pass=2).collect()}
    for q in (0, 20, 40):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [found[q, p] for p in range(1, 5)] == np.argsort(d)[:4].tolist()
    assert vectors.nearest(df, df.limit(0), 3).count() == 0


def test_tfidf_of_equal_texts(spark, scratch):
    df = spark.createDataFrame([(1, "a b b"), (2, "b a b"), (3, None), (4, "c")], "doc_id long, text string")
    pairs_ = spark.createDataFrame([(1, 2), (1, 4), (1, 3)], "a long, b long")
    found = {(r["a"], r["b"]): round(r["cosine"], 9) for r in vectors.cosines(pairs_, vectors.tfidf(df, scratch)).collect()}
    assert found == {(1, 2): 1.0, (1, 4): 0.0, (1, 3): 0.0}


def test_search_pushes_plain_conditions_down(spark, scratch):
    df = spark.createDataFrame([("The Folder", "Draft 1", "u", "text"), (None, None, "u", "text")], "text string, fname string, user_id string, gentype string")
    held = scratch.cut(df, "docs")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = search(held, word="folder", name="draft", owner="u", kind="text")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u)" in plan and "EqualTo(gentype,text)" in plan
