"""Tables written in the cluster's shared folder, to cut lineage and to keep state.

An executor that is lost takes its shuffle files and cached blocks with it; a table in the shared
folder stays. The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
temporary folder is used on a local master only; on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="kinfold-"))
    return f"file://{_local_folder[0]}"


@atexit.register
def _clean() -> None:
    """Removes the temporary folder of a local run; below a named folder, each `Scratch` removes its own."""
    for path in _local_folder:
        shutil.rmtree(path, ignore_errors=True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


class Scratch:
    """Intermediate tables of one operator run, each in its own folder below the shared folder.

    A result is read from them lazily, so they stay until `clear` is called, the `with` block that they were made in ends,
    or the driver does: the file system, whichever it is, deletes the folder when it is closed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/kinfold-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        fs, at = file_system(spark, self.path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def number(self) -> int:
        """A number that no other table of the run has."""
        self._n += 1
        return self._n

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns it as read back: computed once, with its lineage cut."""
        self._n += 1
        path = f"{self.path}/{self._n:04d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinfold_path = path  # keeps the path with the frame for drop()
        return out

    def measured(self, df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
        """Like `cut`, with aggregates of the rows written, taken while they are: no job of their own reads the table."""
        seen = Observation()
        return self.cut(df.observe(seen, *(a.alias(k) for k, a in aggregates.items())), name), seen.get

    def add(self, df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
        """Like `measured`, into a folder that `all` reads as one table."""
        self._n += 1
        path, seen = f"{self.path}/{name}/{self._n:04d}", Observation()
        aggregates = aggregates or {"n": F.count(F.lit(1))}
        df.observe(seen, *(a.alias(k) for k, a in aggregates.items())).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def all(self, name: str, schema) -> DataFrame:
        """All tables added under a name."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            path = getattr(df, "_kinfold_path", None)
            if path:
                remove(self.spark, path)

    def clear(self) -> None:
        """Deletes the run's whole folder; its result can't be read afterwards."""
        remove(self.spark, self.path)


class VersionedTable:
    """A table of parts whose files change together: readers see the last manifest that was committed.

    Each commit writes the changed parts into a folder of its own, then a manifest that names the folder, the number of
    rows and the bounds of every part. The manifest is made under a temporary name and gets its own without ever replacing
    another: that is the commit. A writer that dies before it leaves the old state in force, one that comes second fails.
    The table stays where it is when the session ends. schema: that of the rows, without the part column (a string);
    bounds: the columns whose least and greatest values the manifest keeps, one each.
    """

    def __init__(self, spark: SparkSession, path: str, schema, bounds: tuple[str, str], part: str = "part"):
        self.spark, self.path, self.schema, self.bounds, self.part = spark, path.rstrip("/"), schema, bounds, part

    def _names(self) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def _load(self, name: str) -> dict:
        fs, at = file_system(self.spark, f"{self.path}/manifests/{name}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> tuple[int, dict]:
        """The last version and its {"parts": {part: {"path", "n", "lo", "hi"}}, "tag"}; version 0 is before the first commit."""
        names = self._names()
        return (int(names[-1][:-5]), self._load(names[-1])) if names else (0, {"parts": {}, "tag": None})

    @property
    def version(self) -> int:
        return self.manifest()[0]

    @property
    def tag(self) -> str | None:
        """What the last commit was given as its tag."""
        return self.manifest()[1]["tag"]

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows of the last committed version (empty before the first), only of the given parts if there are any given;
        no file of another part is opened."""
        held = self.manifest()[1]["parts"]
        paths = sorted(v["path"] for k, v in held.items() if parts is None or k in parts)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, parts: list[str] | None, tag: str | None = None, version: int | None = None) -> int:
        """Makes rows (with the part column) the whole content of the given parts, of all parts if None; returns the new
        version. It fails if the table isn't at `version` any more (where it is now, if not given)."""
        now, old = self.manifest()
        now = now if version is None else version
        folder = f"{self.path}/v{now + 1:06d}-{uuid.uuid4().hex[:8]}"
        # adaptive execution unites small parts in a task and splits large ones
        rows.hint("rebalance", self.part).write.mode("overwrite").partitionBy(self.part).parquet(folder)
        lo, hi = self.bounds
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.part, T.StringType())])).parquet(folder)
        sizes = written.groupBy(self.part).agg(F.count(F.lit(1)), F.min(lo), F.max(hi)).collect()  # one row a part
        kept = {} if parts is None else {k: v for k, v in old["parts"].items() if k not in set(parts)}
        new = {str(p): {"path": f"{folder}/{self.part}={p}", "n": n, "lo": a, "hi": b} for p, n, a, b in sizes}
        self._commit(now + 1, {"parts": kept | new, "tag": tag})
        return now + 1

    def _commit(self, version: int, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, at = file_system(self.spark, f"{self.path}/manifests/{version:06d}.json")
        fs, tmp = file_system(self.spark, f"{self.path}/manifests/.{version:06d}-{uuid.uuid4().hex[:8]}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(tmp.toUri().getPath(), at.toUri().getPath())  # fails if the name is taken
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(tmp, at, none)  # without OVERWRITE it fails if the name is taken
        except (FileExistsError, Py4JJavaError) as e:
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer") from e
        finally:
            fs.delete(tmp, False)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes folders that none of the last `keep` manifests names; readers and writers must be done with them."""
        used = {os.path.dirname(p["path"]).rsplit("/", 1)[1] for name in self._names()[-keep:] for p in self._load(name)["parts"].values()}
        fs, at = file_system(self.spark, self.path)
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("v") and name not in used:
                fs.delete(s.getPath(), True)
