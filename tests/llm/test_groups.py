import random

import pytest

from kinfold.llm.groups import consolidate


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b in pairs:
        if None in (s, a, b) or a == b:
            continue
        x, y = find((s, a)), find((s, b))
        up[max(x, y)] = min(x, y)
    return {(s, i): find((s, i))[1] for s, i in list(up)}


def run(spark, scratch, pairs, **k):
    df = spark.createDataFrame([(*p, "g", 1) for p in pairs], "scope string, a string, b string, group_id string, u int")
    rows = consolidate(df, scratch, **k).collect()
    found = {(r["scope"], r["id"]): r["group_id"] for r in rows}
    assert len(found) == len(rows)
    return found


def shapes(rng):
    """A path, a ring, a star, a tree, a ring with tails, two rings on one bridge, and a random graph."""
    name = lambda p, i: f"{p}{rng.random():.6f}-{i}"
    path = [name("p", i) for i in range(60)]
    ring = [name("r", i) for i in range(17)]
    star = [name("s", i) for i in range(50)]
    tree = [name("t", i) for i in range(60)]
    mesh = [name("m", i) for i in range(40)]
    two = [name("w", i) for i in range(20)]
    out = list(zip(path, path[1:])) + [(ring[i], ring[i - 1]) for i in range(17)] + [(star[0], x) for x in star[1:]]
    out += [(tree[i], tree[rng.randrange(i)]) for i in range(1, 60)]
    out += [tuple(rng.sample(mesh, 2)) for _ in range(110)]
    out += [(two[i], two[i - 1]) for i in range(1, 10)] + [(two[0], two[9]), (two[4], two[13])] + [(two[i], two[i - 1]) for i in range(11, 20)] + [(two[10], two[19])]
    out += [(ring[3], path[5])] if rng.random() < 0.5 else []
    return out


@pytest.mark.parametrize("share", [0.05, 1.1])
def test_random_shapes(spark, scratch, share):
    rng = random.Random(int(share * 100))
    pairs = [("u", a, b) for a, b in shapes(rng)] + [("v", a, b) for a, b in shapes(rng)]
    pairs += [("u", b, a) for _, a, b in pairs[:50]] + [("u", "x", "x"), ("u", None, "x"), (None, "a", "b"), ("v", "ä", "z"), ("u", "ä", "a")]
    rng.shuffle(pairs)
    assert run(spark, scratch, pairs, strip_share=share) == brute(pairs)


def test_empty(spark, scratch):
    assert run(spark, scratch, []) == {}
    assert run(spark, scratch, [("u", "a", "a")]) == {}
