"""Hierarchies from parent links: paths, depths, roots, descendants and cycles.

Frontiers move down from the roots; a join of the frontier with the nodes that aren't reached yet extends paths, depths
and the list of ancestors. Every such node knows its nearest ancestors, so a frontier is several levels wide and a join
takes as many at once; what is left after a round doubles its steps, and the next frontiers are twice as wide. Ancestor
pairs give the descendants. Nodes that no frontier reaches lead into a ring: of them, the ring is the set that the
parent function, iterated often enough, still hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.records import MAX_FAN
from kinfold.operators.places import places
from kinfold.storage import Scratch

WIDTH = 4  # levels of the first frontier


def _longer(steps: DataFrame, upper: DataFrame) -> DataFrame:
    """Steps with those of their tops put before them."""
    u = upper.select("scope", F.col("id").alias("top"), F.col("top").alias("top2"), F.col("above").alias("above2"), F.col("names").alias("names2"))
    both = steps.join(u, ["scope", "top"])
    return both.select("scope", "id", F.col("top2").alias("top"), F.concat("above2", "above").alias("above"), F.concat("names2", "names").alias("names"))


def _steps(nodes: DataFrame, scratch: Scratch, width: int) -> tuple[DataFrame, int]:
    """(scope, id, top, above, names): of every node the ids of its `width` nearest ancestors, the farthest (top) first,
    and the names below top down to its own; top is null if a root comes before, above and names then begin at the root.

    Steps of one level are joined with each other, so that they double. With it the number of nodes that have a top.
    """
    known = nodes.select("scope", F.col("id").alias("parent"), F.lit(True).alias("has_parent"))
    steps = nodes.join(known, ["scope", "parent"], "left").select(
        "scope",
        "id",
        F.when(F.col("has_parent"), F.col("parent")).alias("top"),
        F.when(F.col("has_parent"), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("above"),
        F.array("name").alias("names"),
    )
    open_ = F.sum(F.col("top").isNotNull().cast("long"))
    (steps, seen), reach = scratch.measured(steps, "steps", n=open_), 1
    while reach < width:
        longer = _longer(steps.where("top is not null"), steps)
        old, reach = steps, reach * 2
        steps, seen = scratch.measured(steps.where("top is null").unionByName(longer), "steps", n=open_)
        scratch.drop(old)
    return steps, seen["n"] or 0


def _down(frontier: DataFrame, rest: DataFrame) -> DataFrame:
    """The nodes as many levels below the frontier's nodes as their steps go up: those whose top is one of them."""
    f = frontier.select("scope", F.col("id").alias("top"), "root_id", "depth", "full_path", "ancestors")
    return rest.join(f, ["scope", "top"]).select(
        "scope",
        "id",
        "root_id",
        (F.col("depth") + F.size("above")).cast("long").alias("depth"),
        F.concat("full_path", F.lit("/"), F.array_join("names", "/")).alias("full_path"),
        F.concat("ancestors", "above").alias("ancestors"),
    )


def resolve(nodes: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(scope, id, root_id, depth, full_path, ancestors) of all nodes that lead to a root, and (scope, id, parent) of the
    other nodes, parent being an ancestor a fixed number of levels up.

    nodes: (scope, id, parent, name), one row per (scope, id), none null. A parent that is null or no node of
    the scope makes a root of depth 0; a null name counts as ''. There is no bound on the depth. width: levels of the
    first frontier, a power of two; each round takes two frontiers and then doubles the steps of what is left.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    nodes = scratch.cut(nodes.select("scope", "id", "parent", F.coalesce("name", F.lit("")).alias("name")), "nodes")
    steps, left = _steps(nodes, scratch, width)
    first = steps.where("top is null").select(
        "scope",
        "id",
        F.coalesce(F.get("above", F.lit(0)), "id").alias("root_id"),
        F.size("above").cast("long").alias("depth"),
        F.concat(F.lit("/"), F.array_join("names", "/")).alias("full_path"),
        F.col("above").alias("ancestors"),
    )
    (frontier, _), rest, schema = scratch.add(first, "levels"), steps.where("top is not null"), first.schema
    while left:
        next_ = _down(frontier, rest)
        frontier, seen = scratch.add(next_.unionByName(_down(next_, rest)), "levels", n=F.count(F.lit(1)))
        left -= seen["n"]
        if not left or not seen["n"]:
            break
        # what is still left has its top among what is left
        rest = scratch.cut(_longer(rest, rest).join(frontier.select("scope", "id"), ["scope", "id"], "left_anti"), "rest")
    out = scratch.all("levels", schema)
    unreached = rest.join(out.select("scope", "id"), ["scope", "id"], "left_anti").select("scope", "id", F.col("top").alias("parent"))
    return out, unreached


def rings(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(scope, id) of the nodes on a ring, of nodes (scope, id, parent) that all lead into one; parent may be an ancestor
    a fixed number of levels up.

    The image of the parent function, doubled each time, shrinks until the function permutes it: the rings.
    """
    step = nodes.select("scope", F.col("id").alias("x"), F.col("parent").alias("y"))
    image = step.select("scope", "y").distinct().count()
    while image:
        for _ in range(2):
            onward = step.select("scope", F.col("x").alias("y"), F.col("y").alias("z"))
            step = step.join(onward, ["scope", "y"]).select("scope", "x", F.col("z").alias("y"))
        step = scratch.cut(step, "step")
        last, image = image, step.select("scope", "y").distinct().count()
        if image == last:
            break
    return step.select("scope", F.col("y").alias("id")).distinct()


def hierarchy(nodes: DataFrame, items: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """(scope, id, state, root_id, depth, n_nodes, n_items, full_path) of every node.

    nodes: (scope, id, parent, name), one row per (scope, id), rows with null scope or id left out; items: (scope,
    parent), one row per item; items without such a node count nowhere. state is 'cycle' for nodes on a ring,
    'under_cycle' for those that lead into one, else 'tree'; n_nodes and n_items count everything below at any depth.
    If not 'tree', root_id and full_path are '' and the numbers -1. Items are counted per node before they are joined.
    """
    nodes = nodes.where("scope is not null and id is not null")
    tree, lost = resolve(nodes, scratch, width)
    held = items.where("scope is not null and parent is not null").groupBy("scope", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("own"))
    tree = scratch.cut(tree.join(held, ["scope", "id"], "left").withColumn("own", F.coalesce("own", F.lit(0))), "tree")
    pairs = tree.select("scope", F.explode("ancestors").alias("id"), "own")
    below = pairs.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("own").alias("under"))
    done = tree.join(below, ["scope", "id"], "left").select(
        "scope",
        "id",
        F.lit("tree").alias("state"),
        "root_id",
        "depth",
        F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"),
        (F.col("own") + F.coalesce("under", F.lit(0))).cast("long").alias("n_items"),
        "full_path",
    )
    lost = scratch.cut(lost, "lost")
    on_ring = rings(lost, scratch).withColumn("ring", F.lit(True))
    minus = F.lit(-1).cast("long")
    odd = lost.join(on_ring, ["scope", "id"], "left").select(
        "scope",
        "id",
        F.when(F.col("ring"), "cycle").otherwise("under_cycle").alias("state"),
        F.lit("").alias("root_id"),
        minus.alias("depth"),
        minus.alias("n_nodes"),
        minus.alias("n_items"),
        F.lit("").alias("full_path"),
    )
    return done.unionByName(odd)


def positional_codes(tree: DataFrame, scratch: Scratch, fan: int = MAX_FAN) -> DataFrame:
    """(scope, id, depth, place, above) of the nodes of `resolve`: depth from 1, the place among the nodes of the same parent
    by id (from 0; `fan` for all beyond that many), and the places of the ancestors, the root first."""
    parent = F.coalesce(F.element_at(F.when(F.size("ancestors") > 0, F.col("ancestors")), -1), F.lit(""))
    rows = tree.select("scope", "id", parent.alias("parent"), "ancestors")
    placed = scratch.cut(places(rows, ["scope", "parent"], ["id"], scratch).withColumn("place", F.least(F.col("place") - 1, F.lit(fan))), "placed")
    each = placed.select("scope", F.col("id").alias("node"), F.posexplode("ancestors").alias("i", "id")).join(placed.select("scope", "id", "place"), ["scope", "id"])
    # one entry an ancestor: as long as the list that the node has already
    above = each.groupBy("scope", F.col("node").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "place"))), lambda s: s["place"]).alias("above"))
    none = F.array().cast("array<bigint>")
    return placed.join(above, ["scope", "id"], "left").select("scope", "id", (F.size("ancestors") + 1).cast("long").alias("depth"), "place", F.coalesce("above", none).alias("above"))


def siblings(chosen: DataFrame, tree: DataFrame) -> DataFrame:
    """(scope, id, level, sibling_id): for each chosen node (of `resolve`) its ancestors, level 1 being the parent, with all
    nodes of the tree that have the same parent as the ancestor, itself included; roots are beside roots."""
    parent = F.coalesce(F.element_at(F.when(F.size("ancestors") > 0, F.col("ancestors")), -1), F.lit(""))
    up = chosen.select("scope", "id", F.size("ancestors").alias("n"), F.posexplode("ancestors").alias("i", "ancestor"), "ancestors")
    up = up.select("scope", "id", (F.col("n") - F.col("i")).alias("level"), F.when(F.col("i") > 0, F.get("ancestors", F.col("i") - 1)).otherwise("").alias("parent"))
    return up.join(tree.select("scope", parent.alias("parent"), F.col("id").alias("sibling_id")), ["scope", "parent"]).select("scope", "id", "level", "sibling_id")
