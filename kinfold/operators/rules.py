"""Rules that explain groups: tokens and ranges, with recall, precision and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.measures import balanced
from kinfold.operators.places import places
from kinfold.storage import Scratch


def _scored(df: DataFrame) -> DataFrame:
    """recall = n_in / n_group, precision = n_in / (n_group + n_out)."""
    recall, precision = F.col("n_in") / F.col("n_group"), F.col("n_in") / (F.col("n_group") + F.col("n_out"))
    return df.withColumns({"recall": F.round(recall, 5), "precision": F.round(precision, 5), "score": F.round(balanced(recall, precision), 5)})


def token_rules(rows: DataFrame) -> DataFrame:
    """(scope, grp, token, n_in, n_out, n_group, recall, precision, score): the best single token of each group.

    rows: (scope, grp, item, tokens array). n_out counts the scope's items outside the group that have the token.
    Ties go to the least token. Groups without tokens have no rule.
    """
    sizes = rows.groupBy("scope", "grp").agg(F.count(F.lit(1)).alias("n_group"))
    each = rows.select("scope", "grp", F.explode(F.array_distinct("tokens")).alias("token")).where("token <> ''")
    within = each.groupBy("scope", "grp", "token").agg(F.count(F.lit(1)).alias("n_in"))
    whole = within.groupBy("scope", "token").agg(F.sum("n_in").alias("n_all"))
    rules = within.join(whole, ["scope", "token"]).join(sizes, ["scope", "grp"]).withColumn("n_out", F.col("n_all") - F.col("n_in"))
    best = _scored(rules).groupBy("scope", "grp").agg(F.min(F.struct((-F.col("score")).alias("s"), "token", "n_in", "n_out", "n_group", "recall", "precision", "score")).alias("r"))
    return best.select("scope", "grp", "r.token", "r.n_in", "r.n_out", "r.n_group", "r.recall", "r.precision", "r.score")


def range_rules(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(scope, grp, low, high, n_in, n_out, n_group, recall, precision, score): the range of each group's values.

    rows: (scope, grp, value); rows with a null aren't counted. How many values of the scope lie in a range follows from
    the places of its ends among all values, so no group meets the scope's rows in a join.
    """
    rows = rows.where("scope is not null and grp is not null and value is not null").select("scope", "grp", "value")
    groups = scratch.cut(rows.groupBy("scope", "grp").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n_group")), "groups")
    ends = groups.select("scope", "grp", F.explode(F.array(F.struct(F.col("low").alias("value"), F.lit(0).alias("at")), F.struct(F.col("high").alias("value"), F.lit(2).alias("at")))).alias("e")).select("scope", "e.value", "e.at", "grp")
    points = rows.select("scope", "value", F.lit(1).alias("at"), F.lit("").alias("grp"))
    order = ["value", "at", "grp"]
    among_all = places(points.unionByName(ends), ["scope"], order, scratch).where("at <> 1")
    among_ends = places(ends, ["scope"], order, scratch).withColumnRenamed("place", "own")
    before = among_all.join(among_ends, ["scope", *order]).select("scope", "grp", "at", (F.col("place") - F.col("own")).alias("n"))
    inside = before.groupBy("scope", "grp").agg((F.sum(F.when(F.col("at") == 2, F.col("n")).otherwise(-F.col("n")))).alias("n_range"))
    rules = groups.join(inside, ["scope", "grp"]).withColumn("n_in", F.col("n_group")).withColumn("n_out", F.col("n_range") - F.col("n_group"))
    return _scored(rules).select("scope", "grp", "low", "high", "n_in", "n_out", "n_group", "recall", "precision", "score")
