"""Writing: appending, views, keyed updates and upserts with atomic commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.storage import VersionedTable


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of files."""
    rows.write.mode("append").parquet(path)


def view(rows: DataFrame, name: str) -> DataFrame:
    """A session view of rows, for SQL."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def updated(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with the columns of the source's row of the same keys, where it has one and the value isn't null.

    The source has one row a key; keys that only it has change nothing. Null keys match nothing.
    """
    new = source.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in columns))
    both = target.join(new, keys, "left")
    return both.select(*(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else c for c in target.columns))


class KeyedTable:
    """Rows by key, in parts by a hash of the key, of which a change replaces only those that it touches, in one commit.

    rows: one row a key without nulls in it. A table keeps the number of parts that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], parts: int = 64):
        self.keys = keys
        self.table = VersionedTable(spark, path, schema, (keys[0], keys[0]))
        held = self.table.manifest()[1]["parts"]
        self.parts = int(next(iter(held)).split("-")[0]) if held else parts

    def _part(self) -> Column:
        return F.concat_ws("-", F.lit(str(self.parts)), F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("string"))

    def read(self) -> DataFrame:
        return self.table.read()

    def _replace(self, changed: DataFrame, merge) -> int:
        version = self.table.version
        touched = [r[0] for r in changed.select(self._part().alias("part")).distinct().collect()]  # `parts` rows at most
        if not touched:
            return version
        rows = merge(self.table.read(touched), changed).select(*self.table.schema.fieldNames(), self._part().alias("part"))
        return self.table.replace(rows, touched, version=version)

    def update(self, source: DataFrame, columns: list[str]) -> int:
        """Sets columns of the rows whose key the source has; the version."""
        return self._replace(source, lambda old, new: updated(old, new, self.keys, columns))

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in, in place of those of the same key."""
        return self._replace(rows, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new.select(*old.columns)))

    def delete(self, keys: DataFrame) -> int:
        """Takes the rows of the given keys out."""
        return self._replace(keys, lambda old, gone: old.join(gone, self.keys, "left_anti"))
