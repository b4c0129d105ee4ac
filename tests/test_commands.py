import random

from kinfold.operators import commands, features, groups
from kinfold.sinks import KeyedTable, append, updated, view

LOG = "user_id string, cmd_id string, time long, tie string, cmd string, new_name string, extra int"


def test_replay_equals_a_fold_of_the_log(spark):
    rng = random.Random(21)
    base = [("u", f"f{i}", "p0", f"n{i}", i % 3 == 0, "kept") for i in range(6)]
    log = [("u", f"c{i}", rng.randrange(20), f"t{i:02d}", rng.choice(["paste", "move", "rm", "rename", "open", None]), rng.choice([None, "new", "other"]), 1) for i in range(60)]
    items = [("u", f"c{i}", rng.choice([None, "f0", "f1", "f2", "f9"]), rng.choice([None, "p1", "p2"])) for i in range(60)]
    joined = commands.with_items(spark.createDataFrame(log, LOG), spark.createDataFrame(items, "user_id string, cmd_id string, object_id string, target_id string"), objects_only=True)
    frame = spark.createDataFrame(base, "user_id string, id string, parent_id string, name string, trashed boolean, note string")
    for until in (None, 9, -1):
        state = {b[1]: [b[2], b[3], b[4], 0] for b in base}
        for (_, _, t, _, cmd, name, _), (_, _, obj, to) in sorted(zip(log, items), key=lambda x: (x[0][2], x[0][3])):
            if obj not in state or (until is not None and t > until):
                continue
            s = state[obj]
            if cmd in ("paste", "move"):
                s[0], s[2] = to or s[0], False
            elif cmd == "rm":
                s[2] = True
            elif cmd == "rename":
                s[1] = name or s[1]
            s[3] += cmd in ("paste", "move", "rm", "rename")
        found = {r["id"]: [r["parent_id"], r["name"], r["trashed"], r["n_commands"]] for r in commands.replayed(frame, joined, until).collect()}
        assert found == state
    assert commands.replayed(frame, joined.limit(0)).columns == ["user_id", "id", "note", "parent_id", "name", "trashed", "n_commands"]


def test_pairs_are_looked_up_either_way(spark):
    pairs = spark.createDataFrame([("u", "a", "b", 1), ("u", "b", "a", 2), ("v", "a", "b", 3), ("u", "c", None, 4)], "user_id string, file_id_a string, file_id_b string, n int")
    listed = spark.createDataFrame([("u", "b", "a"), ("u", "b", "a"), ("u", None, "c")], "user_id string, a string, b string")
    assert sorted(r["n"] for r in commands.lookup(listed, pairs).collect()) == [1, 2]
    assert [r["n"] for r in commands.lookup(listed, pairs, both_ways=False).collect()] == [2]


def test_groups_equal_the_greedy_walk(spark, scratch):
    rng = random.Random(22)
    pairs = [(rng.choice("uv"), f"f{rng.randrange(25):02d}", f"f{rng.randrange(25):02d}", rng.choice([0.9, 0.66, 0.65, 0.1, None, float("nan")])) for _ in range(90)]
    df = spark.createDataFrame([*pairs, (None, "a", "b", 0.9), ("u", None, "b", 0.9)], "user_id string, file_id_a string, file_id_b string, cert double")
    for least in (1, 3):
        expected = set()
        for user in "uv":
            near = {}
            for u, a, b, c in pairs:
                if u == user and a != b and c is not None and c > 0.65:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
            seen = set()
            for f in sorted(near):
                if f not in seen and len(near[f]) >= least:
                    seen |= near[f]
                    expected |= {(user, f, g) for g in near[f]}
        found = {tuple(r) for r in groups.neighbourhoods(df, scratch, least=least).collect()}
        assert found == expected and found


def test_keyed_table(spark, scratch, tmp_path):
    schema = "k string, j int, v string, w int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table = KeyedTable(spark, f"{scratch.path}/k", rows().schema, ["k", "j"], parts=8)
    assert table.read().count() == 0
    table.upsert(rows(*[(f"k{i}", i, "old", i) for i in range(100)]))
    before = table.table.manifest()[1]["parts"]
    version = table.upsert(rows(("k1", 1, "new", None), ("z", 1, "new", 5)))
    after = table.table.manifest()[1]["parts"]
    assert version == 2 and sum(before.get(k) != v for k, v in after.items()) <= 2
    table.update(rows(("k2", 2, "upd", 9), ("none", 0, "upd", 9), ("k1", 1, None, 7)), ["v", "w"])
    table.delete(spark.createDataFrame([("k3", 3)], "k string, j int"))
    found = {(r["k"], r["j"]): (r["v"], r["w"]) for r in table.read().collect()}
    assert len(found) == 100 and ("k3", 3) not in found and ("none", 0) not in found
    assert found["k1", 1] == ("new", 7) and found["k2", 2] == ("upd", 9) and found["z", 1] == ("new", 5) and found["k9", 9] == ("old", 9)
    assert table.upsert(rows()) == table.table.version
    old = updated(rows(("a", 1, "x", 1), (None, 1, "x", 1)), spark.createDataFrame([("a", 1, "y", None)], schema), ["k", "j"], ["v", "w"])
    assert {tuple(r) for r in old.collect()} == {("a", 1, "y", 1), (None, 1, "x", 1)}
    append(rows(("a", 1, "x", 1)), str(tmp_path / "t"))
    append(rows(("b", 1, "x", 1)), str(tmp_path / "t"))
    assert view(spark.read.parquet(str(tmp_path / "t")), "kept_rows").count() == 2 == spark.sql("select * from kept_rows").count()


def test_signatures_estimate_the_jaccard(spark):
    texts = ["".join(f"{(i * 7 + j):064d}" for j in range(40)) for i in range(0, 6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, ""), (10, None)], "i int, t string").select("i", features.signature(features.chunks(features.F.col("t"))).alias("s"))
    both = df.alias("a").crossJoin(df.alias("b")).select(features.F.col("a.i").alias("i"), features.F.col("b.i").alias("j"), features.signature_similarity(features.F.col("a.s"), features.F.col("b.s")).alias("x"))
    found = {(r["i"], r["j"]): r["x"] for r in both.collect()}
    assert found[0, 0] == 1.0 and found[9, 9] == 0.0 == found[0, 10]
    shared = 40 - 7
    assert abs(found[0, 1] - shared / (80 - shared)) < 0.15
