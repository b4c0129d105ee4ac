import random

from pyspark.sql import functions as F

from kinfold.llm.topn import top_n


def test_hot_group_with_ties(spark, scratch):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(200)}", rng.randrange(3), f"{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, s int, i string").repartition(6)
    best = top_n(df, ["g"], [F.col("s").desc(), F.col("i").asc()], 3, scratch, partitions=9)
    by = {}
    for g, s, i in rows:
        by.setdefault(g, []).append((-s, i))
    expected = {(g, n + 1, i) for g, v in by.items() for n, (_, i) in enumerate(sorted(v)[:3])}
    assert {(r["g"], r["place"], r["i"]) for r in best.collect()} == expected


def test_repeated_rows_and_empty(spark, scratch):
    df = spark.createDataFrame([("a", 1)] * 5, "g string, s int")
    assert sorted(r["place"] for r in top_n(df, ["g"], ["s"], 3, scratch).collect()) == [1, 2, 3]
    assert top_n(df.limit(0), ["g"], ["s"], 3, scratch).count() == 0


def test_one_group_over_all_partitions_nulls_and_other_columns(spark, scratch):
    df = spark.createDataFrame([("a", i, None if i % 7 else i, "x", i) for i in range(1000)] + [(None, 1, 1, "x", 1), ("b", 0, None, "y", 2)], "g string, s int, count long, size string, pid int")
    best = top_n(df.repartition(5), ["g"], [F.col("s").desc()], 450, scratch, partitions=8)
    assert best.columns == ["g", "s", "count", "size", "pid", "place"]
    assert {(r["g"], r["place"], r["s"]) for r in best.collect()} == {("a", k + 1, 999 - k) for k in range(450)} | {("b", 1, 0)}
    two = df.where("g is not null").withColumn("h", F.col("s") % 2)
    assert top_n(two, ["g", "h"], ["s"], 2, scratch, partitions=6).count() == 5
