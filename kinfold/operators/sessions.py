"""Sessions of activity, kept in an incremental table.

A session is a run of events of one key in which neighbours are at most `gap` seconds apart. Events and
sessions are both intervals (start, end, n), so one merge serves for both. No step collects a key: the
time axis is cut into buckets, a bucket is merged by itself (at most one row a second after the first
aggregation), and only the first and the last component of a bucket go on to the next coarser level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.storage import Scratch, VersionedTable

BUCKET_S, FANOUT, PARTS, SPAN_S = 6 * 3600, 1024, 16, 7 * 86400
BUCKET_GAPS, SPAN_GAPS = 12, 336  # buckets and spans are at least so many gaps long

SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


def _bucket(time: Column, base: int, width: int) -> Column:
    """Whole numbers throughout: a quotient of doubles would lose seconds of far times."""
    off = time - F.lit(base)
    return ((off - F.pmod(off, F.lit(width))) / F.lit(width)).cast("long")


def _merge_level(df: DataFrame, base: int, width: int, gap: int) -> DataFrame:
    """Components within each (key, bucket of the start), with their number c and the last number of the bucket."""
    bucket = _bucket(F.col("start"), base, width)
    own = Window.partitionBy("key", "bucket")
    by = own.orderBy("start", "end", "n")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("bucket", bucket).withColumn("new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    placed = marked.withColumn("c", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.sum("new").over(own))
    return placed.groupBy("key", "bucket", "c", "last").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def merge_intervals(df: DataFrame, gap: int, limits: tuple[int, int], bucket_s: int = BUCKET_S, fanout: int = FANOUT) -> DataFrame:
    """Unites intervals (key, start, end, n) of one key that are at most `gap` >= 1 apart.

    limits: bounds of all starts and ends. Intervals that cross bucket limits are cut there into touching
    pieces (their n stays with the first), which the coarser levels join again. Rows of one group: below
    bucket_s pieces on the first level, at most 2 * fanout on the others, whatever the share of a key.
    """
    if gap < 1:
        raise ValueError("gap must be 1 second or more")
    base = limits[0]
    first, last = _bucket(F.col("start"), base, bucket_s), _bucket(F.col("end"), base, bucket_s)
    pieces = (
        df.select("key", "start", "end", "n", F.explode(F.sequence(first, last)).alias("b"), first.alias("b0"))
        .select(
            "key",
            F.greatest(F.col("start"), F.col("b") * bucket_s + F.lit(base)).alias("start"),
            F.least(F.col("end"), (F.col("b") + 1) * bucket_s + F.lit(base - 1)).alias("end"),
            F.when(F.col("b") == F.col("b0"), F.col("n")).otherwise(0).cast("long").alias("n"),
        )
        .groupBy("key", "start", "end")
        .agg(F.sum("n").alias("n"))
    )
    width, level, out = bucket_s, _merge_level(pieces, base, bucket_s, gap), None
    while limits[1] - base >= width:
        # a bucket's inner components can't reach a neighbour bucket; the exchange below `level` is reused
        inner = (F.col("c") > 1) & (F.col("c") < F.col("last"))
        done = level.where(inner).select("key", "start", "end", "n")
        out = done if out is None else out.unionByName(done)
        width *= fanout
        level = _merge_level(level.where(~inner).select("key", "start", "end", "n"), base, width, gap)
    rest = level.select("key", "start", "end", "n")
    return rest if out is None else out.unionByName(rest)


class SessionTable:
    """Sessions (key, start, end, n) that grow by batches of events.

    `apply` finds the batch's local sessions, compares them with the stored sessions within the gap, merges
    components that the batch bridges, and replaces the affected rows in one atomic commit. The order in which
    events arrive doesn't matter; an event applied twice counts twice, so corrections must be resolved before.
    Events with null key or time belong to no session. An empty batch commits nothing.

    Sessions lie in parts by the span of time that they start in and by a hash of their key. The manifest knows the times
    of every part, so a batch reads only parts that hold its keys' hashes and reach its times, and writes only those of
    them in which a session changes or is new. parts: hashes a span; span_s: seconds of a span; a table keeps those that it was
    made with.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int, bucket_s: int | None = None, parts: int = PARTS, span_s: int | None = None):
        self.spark, self.gap, self.bucket_s = spark, gap, bucket_s or max(BUCKET_S, BUCKET_GAPS * gap)
        self.table = VersionedTable(spark, path, SCHEMA, ("start", "end"))
        held = self.table.manifest()[1]["parts"]
        layout = next(iter(held)).split("-")[0].split("x") if held else (parts, span_s or max(SPAN_S, SPAN_GAPS * gap))
        self.parts, self.span_s = int(layout[0]), int(layout[1])
        self.scratch = Scratch(spark, "sessions")

    def _hash(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.parts))

    def _part(self) -> Column:
        """Layout, span and hash: names of parts tell how the table is laid out."""
        return F.concat_ws("-", F.lit(f"{self.parts}x{self.span_s}"), F.replace(_bucket(F.col("start"), 0, self.span_s).cast("string"), F.lit("-"), F.lit("m")), self._hash().cast("string"))

    def _near(self, df: DataFrame, names: list[str]) -> DataFrame:
        """One row for each bucket that the interval, widened by the gap, touches."""
        lo, hi = _bucket(F.col("start") - self.gap, 0, self.bucket_s), _bucket(F.col("end") + self.gap, 0, self.bucket_s)
        return df.select(*names, F.explode(F.sequence(lo, hi)).alias("b"))

    def _reached(self, local: DataFrame, held: dict) -> list[str]:
        """Stored parts that may hold a session within the gap of a local one; local ones are summed up by hash and span."""
        spans: dict[str, list[tuple[int, int]]] = {}
        for h, lo, hi in local.groupBy(self._hash().alias("h"), _bucket(F.col("start"), 0, self.span_s).alias("s")).agg(F.min("start"), F.max("end")).select("h", "min(start)", "max(end)").collect():
            spans.setdefault(str(h), []).append((lo - self.gap, hi + self.gap))
        return [k for k, v in held.items() if any(lo <= v["hi"] and hi >= v["lo"] for lo, hi in spans.get(k.rsplit("-", 1)[1], ()))]

    def apply(self, events: DataFrame, tag: str | None = None) -> int:
        """events: (key string, time bigint); returns the table's version. A batch with the tag of the last commit was
        applied already and is left out, so a stream that repeats its last batch counts it once."""
        version, manifest = self.table.manifest()
        if tag is not None and tag == manifest["tag"]:
            return version
        points = events.where("key is not null and time is not null").groupBy("key", F.col("time").cast("long").alias("start"))
        points = points.agg(F.count(F.lit(1)).alias("n")).select("key", "start", F.col("start").alias("end"), "n")
        points, seen = self.scratch.measured(points, "points", lo=F.min("start"), hi=F.max("end"))
        if seen["lo"] is None:
            return version
        local = merge_intervals(points, self.gap, (seen["lo"], seen["hi"]), self.bucket_s)
        if not version:
            return self.table.replace(local.withColumn("part", self._part()), None, tag, version)
        local = self.scratch.cut(local, "local")
        reached = self._reached(local, manifest["parts"])
        stored = self.table.read(reached)
        s = self._near(stored, ["key", "start", "end", "n"])
        l = self._near(local, ["key", F.col("start").alias("l_start"), F.col("end").alias("l_end")])
        reach = (F.col("l_start") <= F.col("end") + self.gap) & (F.col("l_end") >= F.col("start") - self.gap)
        affected = s.join(l, ["key", "b"]).where(reach).select("key", "start", "end", "n").distinct()
        both, seen = self.scratch.measured(affected.withColumn("old", F.lit(True)).unionByName(local.withColumn("old", F.lit(False))), "both", lo=F.min("start"), hi=F.max("end"))
        merged = merge_intervals(both.drop("old"), self.gap, (seen["lo"], seen["hi"]), self.bucket_s)
        # a merged row starts where one of its rows starts, so it falls into a part that one of them has
        touched = [r[0] for r in both.select(self._part().alias("part")).distinct().collect()]
        kept = self.table.read(touched).join(both.where("old").select("key", "start"), ["key", "start"], "left_anti")
        return self.table.replace(kept.select("key", "start", "end", "n").unionByName(merged).withColumn("part", self._part()), touched, tag, version)

    def read(self) -> DataFrame:
        return self.table.read()


def sessions(events: DataFrame, gap: int, arrived: str = "ingested_at", shares: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Sessions (key, start, end, n) of events (key, time, arrived), built through a `SessionTable`.

    The table takes the events in batches by order of arrival, cut at the given shares (approximate quantiles)
    of `arrived`; events without it come with the first batch. The result doesn't depend on the shares.
    """
    spark = events.sparkSession
    scratch = Scratch(spark, "session-events")
    held = scratch.cut(events.select("key", "time", F.col(arrived).alias("arrived")), "events")
    table = SessionTable(spark, f"{scratch.path}/table", gap)
    cuts = sorted(set(held.select(F.percentile_approx("arrived", list(shares))).first()[0] or [])) if shares else []
    kind = held.schema["arrived"].dataType
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = F.lit(True) if lo is None else F.col("arrived") > F.lit(lo).cast(kind)
        upper = F.lit(True) if hi is None else F.col("arrived") <= F.lit(hi).cast(kind)
        table.apply(held.where((own & upper) | (F.col("arrived").isNull() & F.lit(lo is None))))
    return table.read()
