"""Groups of files that predictions bring together, and what can be said of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.measures import POSITIVE
from kinfold.operators.pairs import neighbours
from kinfold.storage import Scratch


def split_neighbours(pairs: DataFrame, threshold: float = POSITIVE) -> DataFrame:
    """(user_id, file_id, other_id, inside): both directions of every scored pair (user_id, file_id_a, file_id_b, cert), and
    whether its certainty is above the threshold; a null or NaN isn't."""
    cert = F.col("cert").cast("double")
    return neighbours(pairs.select("user_id", "file_id_a", "file_id_b", F.coalesce(~F.isnan(cert) & (cert > threshold), F.lit(False)).alias("inside")), ["inside"])


def seeds(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(user_id, file_id): the files that found a group, of links (user_id, file_id, other_id) in both directions.

    Files are taken in the order of their ids, and one that lies in the group of an earlier seed founds none. All files whose
    lesser neighbours are decided are decided at once: a round finds seeds (no open lesser neighbour, none a seed) and
    takes their neighbours out, so no order of rows is kept and no user is one task.
    """
    lesser = scratch.cut(links.where("other_id < file_id").select("user_id", "file_id", "other_id").distinct(), "lesser")
    open_, seen = scratch.measured(links.select("user_id", "file_id").distinct(), "open", n=F.count(F.lit(1)))
    schema, folder = open_.schema, f"seeds{scratch.number()}"
    scratch.add(open_.limit(0), folder)
    while seen["n"]:
        waits = lesser.join(open_.withColumnRenamed("file_id", "other_id"), ["user_id", "other_id"], "left_semi").select("user_id", "file_id")
        found, _ = scratch.add(open_.join(waits, ["user_id", "file_id"], "left_anti"), folder)
        taken = links.join(found, ["user_id", "file_id"], "left_semi").select("user_id", F.col("other_id").alias("file_id"))
        open_, seen = scratch.measured(open_.join(found.unionByName(taken), ["user_id", "file_id"], "left_anti"), "open", n=F.count(F.lit(1)))
    return scratch.all(folder, schema)


def neighbourhoods(pairs: DataFrame, scratch: Scratch, threshold: float = POSITIVE, least: int = 1) -> DataFrame:
    """(user_id, seed_id, file_id): each seed's group, the files that it has a certain pair with; groups may share files.

    Only files with at least `least` such pairs found groups. A pair with a null or of a file with itself counts nowhere.
    """
    ok = pairs.where("user_id is not null and file_id_a is not null and file_id_b is not null and file_id_a <> file_id_b")
    links = scratch.cut(split_neighbours(ok, threshold).where("inside").select("user_id", "file_id", "other_id").distinct(), "links")
    able = links.groupBy("user_id", "file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("user_id", "file_id")
    among = links.join(able, ["user_id", "file_id"], "left_semi")
    # a file that can't found a group doesn't keep others from it
    both = among.join(able.withColumnRenamed("file_id", "other_id"), ["user_id", "other_id"], "left_semi").select("user_id", "file_id", "other_id")
    lone = able.join(both.select("user_id", "file_id").distinct(), ["user_id", "file_id"], "left_anti")
    found = seeds(scratch.cut(both, "both"), scratch).unionByName(lone)
    return links.join(found, ["user_id", "file_id"], "left_semi").select("user_id", F.col("file_id").alias("seed_id"), F.col("other_id").alias("file_id"))


def discrimination(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, grp, most, least): of the folders that a group's members lie in, the greatest and the least share that the group
    holds. members: (scope, grp, folder); sizes: (scope, folder, n), all files of a folder."""
    held = members.groupBy("scope", "grp", "folder").agg(F.count(F.lit(1)).alias("k")).join(sizes, ["scope", "folder"])
    share = F.col("k") / F.col("n")
    return held.groupBy("scope", "grp").agg(F.max(share).alias("most"), F.min(share).alias("least"))


def halves(rows: DataFrame, scope: str, by: str, tie: str, places) -> DataFrame:
    """Rows with `best`: whether they are in the first half (rounded down) of their scope by descending `by`, ties by `tie`."""
    n = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("__n"))
    return places(rows, [scope], [F.col(by).desc(), F.col(tie).asc()]).join(n, scope).withColumn("best", F.col("place") <= F.floor(F.col("__n") / 2)).drop("__n", "place")
