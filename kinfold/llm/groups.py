"""Groups of records that are linked directly or through others.

Vertices of degree one are stripped and chains of degree-two vertices are compressed by list ranking (pointer
jumping over the arcs of the chains), again and again; what is left, the core, is solved by contracting every
vertex into its least neighbour; then the removed vertices get their labels back. Every table of a round holds
pairs of 64-bit codes that keep the order of (scope, id), so the least code of a group is its least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.storage import Scratch

STRIP_SHARE = 0.1  # rounds go on while they remove at least this share of the vertices


def _degrees(edges: DataFrame) -> DataFrame:
    """(x, d, n1, n2): degree, least and greatest neighbour; fixed-width aggregates, combined before the shuffle."""
    arcs = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("w").alias("y")), F.struct(F.col("w").alias("x"), F.col("u").alias("y")))).alias("e"))
    return arcs.select("e.x", "e.y").groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.min("y").alias("n1"), F.max("y").alias("n2"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in gone (x)."""
    return edges.join(gone.select(F.col("x").alias("u")), "u", "left_anti").join(gone.select(F.col("x").alias("w")), "w", "left_anti").select("u", "w")


def _chain_ends(chain: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(x, e1, e2, least) of the degree-two vertices (x, n1, n2): the ends of x's chain, null on a pure ring; and their number.

    List ranking on arcs: the arc (f, t) leads from chain vertex f to its neighbour t and on to (t, the other
    neighbour of t). Each round joins every open arc with the arc that it points to, so that it doubles its reach; an
    arc that has come to an end is written once and only looked up from then on.
    """
    other = chain.select(F.col("x").alias("t"), F.col("n1").bitwiseXOR(F.col("n2")).alias("both"))
    arcs = chain.select(F.col("x").alias("f"), F.explode(F.array("n1", "n2")).alias("t")).join(other, "t", "left")
    arcs = arcs.select(
        "f",
        "t",
        F.col("t").alias("hf"),
        F.col("both").bitwiseXOR(F.col("f")).alias("ht"),
        F.when(F.col("both").isNull(), F.col("t")).alias("end"),
        F.least("f", "t").alias("least"),
    )
    open_ = F.col("end").isNull()
    measures = {"n": F.sum(open_.cast("long")), "least": F.sum(F.when(open_, F.col("least")).cast("decimal(38,0)"))}
    folder, last = f"arcs{scratch.number()}", None
    arcs, state = scratch.add(arcs, folder, **measures)
    schema = arcs.schema
    while state["n"] and state != last:  # till all have ended, or only rings are left, each arc of which has seen the least vertex
        last = state
        ended = scratch.all(folder, schema).where(~open_)
        head = arcs.where(open_).unionByName(ended)
        head = head.select(F.col("f").alias("hf"), F.col("t").alias("ht"), F.col("hf").alias("hf2"), F.col("ht").alias("ht2"), F.col("end").alias("end2"), F.col("least").alias("least2"))
        moved = arcs.where(open_).join(head, ["hf", "ht"]).select(
            "f", "t", F.col("hf2").alias("hf"), F.col("ht2").alias("ht"), F.col("end2").alias("end"), F.least("least", "least2").alias("least")
        )
        arcs, state = scratch.add(moved, folder, **measures)
    done = scratch.all(folder, schema).where(~open_).unionByName(arcs.where(open_))
    ends = done.groupBy(F.col("f").alias("x")).agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("least").alias("least"))
    ends, seen = scratch.measured(ends, "ends", n=F.count(F.lit(1)))
    return ends, seen["n"]


def _core(edges: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """Solves any graph of n edges: (x, p) of the vertices contracted in each round, until no edge is left.

    Every vertex hooks to its least neighbour; the only rings of that are pairs, whose lesser end is the root.
    Each round leaves at most half of the vertices.
    """
    removed = []
    while n:
        least = scratch.cut(_degrees(edges).select("x", F.col("n1").alias("p")), "least")
        back = least.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        # the lesser of a pair that hooks to each other is no link: it is the root
        hooks = least.join(back, "p").where("not (pp = x and x < p)").select("x", "p")
        hooks = _jump(hooks, scratch)
        at = hooks.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        to = hooks.select(F.col("x").alias("w"), F.col("p").alias("pw"))
        joined = edges.join(at, "u", "left").join(to, "w", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pw", "w").alias("b")).where("a <> b")
        edges, seen = scratch.measured(joined.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w")).distinct(), "edges", n=F.count(F.lit(1)))
        n = seen["n"]
        removed.append(hooks)
    return removed


def _jump(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (x, p) of a forest, each lead to its root by pointer jumping; roots are no x. A link that has come to its root is
    written once and only looked up from then on."""
    folder, open_ = f"links{scratch.number()}", F.col("open")
    # whether p is a root is known as soon as p has been looked up
    links, seen = scratch.add(links.select("x", "p", F.lit(True).alias("open")), folder, n=F.count(F.lit(1)))
    schema = links.schema
    while seen["n"]:
        known = links.where(open_).unionByName(scratch.all(folder, schema).where(~open_))
        onward = known.select(F.col("x").alias("p"), F.col("p").alias("pp"), F.col("open").alias("o"))
        moved = links.where(open_).join(onward, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.coalesce("o", F.lit(False)).alias("open"))
        links, seen = scratch.add(moved, folder, n=F.sum(open_.cast("long")))
    return scratch.all(folder, schema).where(~open_).select("x", "p")


def consolidate(pairs: DataFrame, scratch: Scratch, strip_share: float = STRIP_SHARE) -> DataFrame:
    """(scope, id, group_id) of every id that some pair of its scope links to another; group_id is the group's least id.

    pairs: (scope, a, b), strings. Orders and repeats of a pair don't matter. Rows with a null, and pairs of an
    id with itself, link nothing. An empty table gives an empty result. Least is by bytes.
    """
    linked = pairs.where("scope is not null and a is not null and b is not null and a <> b")
    linked = scratch.cut(linked.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    names = scratch.cut(linked.select("scope", F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    names = names.repartitionByRange("scope", "id").sortWithinPartitions("scope", "id").withColumn("v", F.monotonically_increasing_id())
    names = scratch.cut(names, "names")
    code = linked.join(names.select("scope", F.col("id").alias("a"), F.col("v").alias("u")), ["scope", "a"])
    code = code.join(names.select("scope", F.col("id").alias("b"), F.col("v").alias("w")), ["scope", "b"])
    edges, seen = scratch.measured(code.select("u", "w"), "edges", n=F.count(F.lit(1)))
    n_edges = seen["n"]
    scratch.drop(linked)

    removed: list[DataFrame] = []
    while n_edges:
        # strip the vertices of degree one; of a pair by itself the lesser stays as the root
        degrees, seen = scratch.measured(_degrees(edges), "degrees", n=F.count(F.lit(1)), leaves=F.sum((F.col("d") == 1).cast("long")), chain=F.sum((F.col("d") == 2).cast("long")))
        total, gone = seen["n"], 0
        if seen["leaves"]:
            leaf = degrees.where("d = 1").select("x", F.col("n1").alias("p"))
            mate = leaf.select(F.col("x").alias("p"), F.lit(True).alias("mate"))
            strip, met = scratch.measured(leaf.join(mate, "p", "left").where("mate is null or x > p").select("x", "p"), "strip", n=F.count(F.lit(1)))
            gone += met["n"]
            removed.append(strip)
            old, (edges, met) = edges, scratch.measured(_without(edges, strip), "edges", n=F.count(F.lit(1)))
            n_edges = met["n"]
            scratch.drop(old, degrees)
            if not n_edges:
                break
            degrees, seen = scratch.measured(_degrees(edges), "degrees", chain=F.sum((F.col("d") == 2).cast("long")))
        # compress the chains of degree two
        if seen["chain"]:
            ends, n = _chain_ends(degrees.where("d = 2").select("x", "n1", "n2"), scratch)
            # a chain hangs on its lesser end, a ring on its least vertex
            hang = ends.select("x", F.coalesce("e1", "least").alias("p")).where("x <> p")
            gone += n
            removed.append(hang)
            bridged = ends.where("e1 <> e2").select(F.least("e1", "e2").alias("u"), F.greatest("e1", "e2").alias("w"))
            old, (edges, met) = edges, scratch.measured(_without(edges, ends).unionByName(bridged).distinct(), "edges", n=F.count(F.lit(1)))
            n_edges = met["n"]
            scratch.drop(old)
        scratch.drop(degrees)
        if gone < strip_share * total:
            break
    removed += _core(edges, n_edges, scratch)

    # labels go back: every removed vertex points to one that was removed later or to the root of its group
    label = names.select("scope", "id", F.col("v"))
    if not removed:
        return label.select("scope", "id", F.col("id").alias("group_id"))
    links = removed[0]
    for r in removed[1:]:
        links = links.unionByName(r)
    links = _jump(links, scratch)
    label = label.join(links.select(F.col("x").alias("v"), "p"), "v", "left").select("scope", "id", "v", F.coalesce("p", "v").alias("root"))
    label = scratch.cut(label, "label")
    least = label.groupBy("root").agg(F.min("v").alias("v"))
    least = least.join(names.select("v", F.col("id").alias("group_id")), "v").select("root", "group_id")
    return label.join(least, "root").select("scope", "id", "group_id")
