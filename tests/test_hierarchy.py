from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinfold.operators import hierarchy as module
from kinfold.operators.hierarchy import hierarchy
from kinfold.plans import core_problems

NODES = "scope string, id string, parent string, name string, depth int, root_id string"


def run(spark, scratch, nodes, items, **k):
    n = spark.createDataFrame([(*x, 1, "x") for x in nodes], NODES)
    i = spark.createDataFrame(items, "scope string, parent string")
    return {(r["scope"], r["id"]): (r["state"], r["root_id"], r["depth"], r["n_nodes"], r["n_items"], r["full_path"]) for r in hierarchy(n, i, scratch, **k).collect()}


@pytest.mark.parametrize("width", [1, 2, 4])
def test_trees_rings_and_what_leads_into_them(spark, scratch, width):
    nodes = [
        ("u", "a", None, "A"), ("u", "b", "a", "B/ "), ("u", "c", "b", None), ("u", "d", "gone", "D"), ("u", "r1", "r2", "R"), ("u", "r2", "r1", "R"), ("u", "x", "r1", "X"),
        ("u", "y", "x", "Y"), ("u", "self", "self", "S"), ("v", "b", "a", "B"), (None, "n", None, "N"), ("u", None, None, "N"),
    ]
    items = [("u", "a"), ("u", "c"), ("u", "c"), ("u", "gone"), ("u", None), ("u", "x"), (None, "a"), ("v", "b")]
    lost = ("", -1, -1, -1, "")
    assert run(spark, scratch, nodes, items, width=width) == {
        ("u", "a"): ("tree", "a", 0, 2, 3, "/A"), ("u", "b"): ("tree", "a", 1, 1, 2, "/A/B/ "), ("u", "c"): ("tree", "a", 2, 0, 2, "/A/B/ /"), ("u", "d"): ("tree", "d", 0, 0, 0, "/D"),
        ("u", "r1"): ("cycle", *lost), ("u", "r2"): ("cycle", *lost), ("u", "x"): ("under_cycle", *lost), ("u", "y"): ("under_cycle", *lost), ("u", "self"): ("cycle", *lost),
        ("v", "b"): ("tree", "b", 0, 0, 1, "/B"),
    }


@pytest.mark.parametrize("width", [1, 4])
def test_deep_chain_and_long_ring(spark, scratch, width):
    nodes = [("u", f"n{i}", f"n{i - 1}" if i else None, f"{i}") for i in range(13)] + [("u", f"r{i}", f"r{(i + 1) % 7}", "r") for i in range(7)]
    nodes += [("u", f"t{i}", f"t{i - 1}" if i else "r3", "t") for i in range(9)]
    found = run(spark, scratch, nodes, [("u", "n12")], width=width)
    assert found["u", "n12"] == ("tree", "n0", 12, 0, 1, "/" + "/".join(map(str, range(13))))
    assert found["u", "n0"][3:5] == (12, 1)
    assert {i for (_, i), v in found.items() if v[0] == "cycle"} == {f"r{i}" for i in range(7)}
    assert {i for (_, i), v in found.items() if v[0] == "under_cycle"} == {f"t{i}" for i in range(9)}


def test_empty(spark, scratch):
    assert run(spark, scratch, [], []) == {}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_frontier_joins_give_the_rows(spark, monkeypatch, sf):
    folder = Path("/root/testdata") / sf
    if not folder.exists():
        pytest.skip("the test tables aren't there")
    calls, down = [], module._down
    monkeypatch.setattr(module, "_down", lambda *a: calls.append(1) or down(*a))
    found = core_problems.p6_found(spark, str(folder)).where("state = 'tree'").agg(F.count(F.lit(1)), F.max("depth")).first()
    # the steps give the first levels, each round of two frontiers twice as many as the round before
    assert found[0] and len(calls) >= 2 and module.WIDTH * (2 * 2 ** (len(calls) // 2) - 1) > found[1] >= module.WIDTH
