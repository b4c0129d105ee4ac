"""Decision rules for groups: greedy token sets and two-level trees.

A group is a set of items of a scope that a rule should tell from the others. Token sets are found by aggregates over all
items. Trees are fitted on a bounded sample of each scope, drawn by hash; their leaves are then counted over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.measures import WEIGHTS
from kinfold.functions.measures import balanced as balanced_column
from kinfold.operators.places import first_rows
from kinfold.storage import Scratch

SAMPLE = 1000


def balanced(recall: float, precision: float) -> float:
    return 0.0 if recall <= 1e-8 or precision <= 1e-8 else round(1 / (WEIGHTS[0] / recall + WEIGHTS[1] / precision), 5)


def greedy_tokens(inside: list[set], outside: list[set], alternatives: int = 2) -> tuple[list[list[str]], float]:
    """Up to `alternatives` sets of tokens, an item fits if it has all of one; with the score of the whole rule.

    Each set grows by the token that raises the score the most, ties to the least token, while any raises it; the next
    set starts from the items that the first ones leave.
    """
    rule: list[list[str]] = []
    best = 0.0

    def score(rule: list[list[str]]) -> float:
        fits = [sum(any(set(s) <= x for s in rule) for x in part) for part in (inside, outside)]
        return balanced(fits[0] / len(inside), fits[0] / (len(inside) + fits[1])) if inside else 0.0

    for _ in range(alternatives):
        own: list[str] = []
        while True:
            left = [x for x in inside if set(own) <= x and not any(set(s) <= x for s in rule)]
            tried = [(-score([*rule, [*own, t]]), t) for t in sorted(set().union(*left) - set(own))] if left else []
            if not tried or -min(tried)[0] <= best:
                break
            best, own = -min(tried)[0], [*own, min(tried)[1]]
        if not own:
            break
        rule.append(own)
    return rule, best


def _gini(positive: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = positive / np.maximum(n, 1)
    return n * 2 * share * (1 - share)


def best_split(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
    """(impurity after, feature, threshold) of the best cut x <= threshold, halfway between neighbours; ties to the first."""
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, p = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n = cut + 1.0
        impurity = _gini(p[cut], n) + _gini(p[-1] - p[cut], len(v) - n)
        k = int(np.argmin(impurity))
        found = (round(float(impurity[k]), 9), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None or found[0] < best[0]:
            best = found
    return best


def tree(x: np.ndarray, y: np.ndarray, names: list[str], depth: int = 2) -> list[tuple[str, list[int], list[float], list[bool]]]:
    """The leaves of a tree of the depth: the clause, and its features, thresholds and whether it takes the values up to them."""

    def grow(at: np.ndarray, clause: str, path: list[tuple[int, float, bool]], d: int) -> list[tuple[str, list[int], list[float], list[bool]]]:
        split = best_split(x[at], y[at]) if d and 0 < y[at].sum() < len(at) else None
        if split is None:
            return [(clause or "all", [f for f, _, _ in path], [t for _, t, _ in path], [low for _, _, low in path])]
        _, f, t = split
        low, to = x[at, f] <= t, " and " if clause else ""
        return grow(at[low], f"{clause}{to}{names[f]} <= {t:g}", [*path, (f, t, True)], d - 1) + grow(at[~low], f"{clause}{to}{names[f]} > {t:g}", [*path, (f, t, False)], d - 1)

    return grow(np.arange(len(y)), "", [], depth)


def _holders(items: DataFrame, sets: DataFrame, rare: DataFrame) -> DataFrame:
    """Items (scope, item, tokens, grp) with each of the sets (scope, s: array) that they hold, s not empty.

    They meet on the rarest token of the set, so a set meets no more items than hold that token.
    """
    each = sets.select("scope", "s", F.explode("s").alias("token")).join(rare, ["scope", "token"])
    key = each.groupBy("scope", "s").agg(F.min(F.struct("n", "token")).alias("m")).select("scope", "s", F.col("m.token").alias("token"))
    at = items.select("scope", "item", "grp", "tokens", F.explode("tokens").alias("token"))
    return at.join(key, ["scope", "token"]).where(F.size(F.array_except("s", "tokens")) == 0).select("scope", "s", "item", "grp", "tokens")


def token_sets(rows: DataFrame, scratch: Scratch, alternatives: int = 2) -> DataFrame:
    """(scope, grp, rule, score): the greedy rule of each group (rows: scope, grp, item, tokens array), as `greedy_tokens` finds
    it with all items of the scope; groups that no token tells have no rule.

    All groups grow their sets side by side, a token a round. What a token would add is counted by aggregates: of the own
    items directly, of the scope's by the items that hold the set (each different set once, whatever the number of groups
    that have it); the items of an earlier set are taken off by counting those that hold both sets.
    """
    ok = rows.where("scope is not null and grp is not null and item is not null")
    tokens = F.array_sort(F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))))
    items = scratch.cut(ok.select("scope", "grp", F.struct("grp", "item").alias("item"), tokens.alias("tokens")), "items")
    rare = scratch.cut(items.select("scope", F.explode("tokens").alias("token")).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("n")), "rare")
    none = F.array().cast("array<string>")
    # rule: the finished sets; own: the set that grows; k, o: items in and outside that the finished sets fit
    state = items.groupBy("scope", "grp").agg(F.count(F.lit(1)).alias("size"))
    state = scratch.cut(state.select("scope", "grp", "size", F.array().cast("array<array<string>>").alias("rule"), none.alias("own"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("oo"), F.lit(0.0).alias("best"), F.lit(False).alias("done")), "state")
    while True:
        open_ = state.where("not done")
        before = F.when(F.size("rule") > 0, F.col("rule")[0]).otherwise(none)
        asked = scratch.cut(open_.select("scope", "grp", "own", before.alias("before"), F.array_sort(F.array_union("own", before)).alias("both")), "asked")
        left = (F.size(F.array_except("own", "tokens")) == 0) & ((F.size("before") == 0) | (F.size(F.array_except("before", "tokens")) > 0))
        inside = items.join(asked, ["scope", "grp"]).where(left).select("scope", "grp", F.explode(F.array_except("tokens", "own")).alias("token"))
        inside = inside.groupBy("scope", "grp", "token").agg(F.count(F.lit(1)).alias("i"))
        # of the scope: what holds own and the token, less what holds the earlier set as well
        sets = asked.select("scope", F.col("own").alias("s")).unionByName(asked.where("size(before) > 0").select("scope", F.col("both").alias("s"))).where("size(s) > 0").distinct()
        held = _holders(items, scratch.cut(sets, "sets"), rare).select("scope", "s", F.explode("tokens").alias("token")).groupBy("scope", "s", "token").agg(F.count(F.lit(1)).alias("n"))
        held = scratch.cut(held.unionByName(rare.select("scope", none.alias("s"), "token", "n")), "held")
        tried = inside.join(asked, ["scope", "grp"])
        tried = tried.join(held.select("scope", F.col("s").alias("own"), "token", "n"), ["scope", "own", "token"])
        tried = tried.join(held.select("scope", F.col("s").alias("both"), "token", F.col("n").alias("shared")), ["scope", "both", "token"], "left")
        n_all = F.col("n") - F.when(F.size("before") > 0, F.coalesce("shared", F.lit(0))).otherwise(0)
        tried = tried.select("scope", "grp", "token", "i", (n_all - F.col("i")).alias("x")).join(open_.select("scope", "grp", "size", "k", "o"), ["scope", "grp"])
        recall, precision = (F.col("k") + F.col("i")) / F.col("size"), (F.col("k") + F.col("i")) / (F.col("size") + F.col("o") + F.col("x"))
        tried = tried.withColumn("score", F.round(balanced_column(recall, precision), 5))
        found = tried.groupBy("scope", "grp").agg(F.min(F.struct((-F.col("score")).alias("s"), "token", "i", "x")).alias("t"))
        grown = open_.join(found, ["scope", "grp"], "left")
        better = F.coalesce(-F.col("t.s") > F.col("best"), F.lit(False))
        ends = ~better & ((F.size("own") == 0) | (F.size("rule") + 1 >= alternatives))
        rule = F.when(better | (F.size("own") == 0), F.col("rule")).otherwise(F.concat("rule", F.array("own")))
        fixed = better | (F.size("own") == 0)
        grown = grown.select(
            "scope", "grp", "size", rule.alias("rule"), F.when(better, F.concat("own", F.array("t.token"))).otherwise(none).alias("own"),
            F.when(fixed, F.col("k")).otherwise(F.col("k") + F.col("ok")).alias("k"), F.when(fixed, F.col("o")).otherwise(F.col("o") + F.col("oo")).alias("o"),
            F.when(better, F.col("t.i")).otherwise(0).cast("long").alias("ok"), F.when(better, F.col("t.x")).otherwise(0).cast("long").alias("oo"),
            F.when(better, -F.col("t.s")).otherwise(F.col("best")).alias("best"), ends.alias("done"),
        )
        old = state
        state, seen = scratch.measured(state.where("done").unionByName(grown), "state", n=F.sum((~F.col("done")).cast("long")))
        scratch.drop(old, asked, held)
        if not seen["n"]:
            break
    return state.where("size(rule) > 0").select("scope", "grp", F.array_join(F.transform("rule", lambda s: F.array_join(s, "+")), " or ").alias("rule"), F.col("best").alias("score"))


def leaves(rows: DataFrame, features: list[str], scratch: Scratch, depth: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(scope, clause, n, n_positive): leaves of the decision tree of each scope (rows: scope, item, label boolean, features).

    Rows with a null label or a null or NaN feature are left out. The tree is made from at most `sample` rows a scope,
    drawn by SHA-256 of the item; n and n_positive count all rows.
    """
    ok = rows.where("scope is not null and item is not null and label is not null")
    for f in features:
        ok = ok.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    ok = scratch.cut(ok.select("scope", "item", "label", *(F.col(f).cast("double").alias(f) for f in features)), "rows")
    some = first_rows(ok.select("scope", F.sha2("item", 256).alias("h"), "item", "label", *features), ["scope"], ["h", "item"], sample)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        out = tree(part[features].to_numpy(dtype=float), part["label"].to_numpy(dtype=float), features, depth)
        return pd.DataFrame([(part["scope"].iloc[0], *leaf) for leaf in out], columns=["l_scope", "clause", "f", "t", "low"])

    made = some.groupBy("scope").applyInPandas(run, "l_scope string, clause string, f array<int>, t array<double>, low array<boolean>")
    made = scratch.cut(made.select("l_scope", "clause", F.arrays_zip("f", "t", "low").alias("path")), "leaves")
    all_rows = ok.select("scope", F.col("label").cast("long").alias("positive"), F.array(*features).alias("v"))
    fits = F.forall("path", lambda p: (F.get(F.col("v"), p["f"]) <= p["t"]) == p["low"])
    counted = all_rows.join(made, (F.col("scope") == F.col("l_scope")) & fits).groupBy("scope", "clause")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("n_positive"))
