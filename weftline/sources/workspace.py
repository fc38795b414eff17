"""Workspaces: named Parquet tables published together by one manifest, which is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.access import saved

#: Folders of one table beyond which a commit merges the newest, and how many times the newer ones' bytes a folder must have to be left out.
MOST_FOLDERS, TIER = 8, 4


class Workspace:
    """Named tables under one folder, in versions.

    A version's manifest lists each table's folders, oldest first: a commit appends small folders of
    changed rows, of which the newest row of a key counts, or replaces a table. Where folders are too
    many, the newest of like size are merged to one: a folder is rewritten only when newer rows have
    grown to a part of it, so a small batch leaves large folders alone. Readers take the
    highest manifest that Spark has committed, so a commit that fails anywhere changes nothing, and
    all tables of a commit appear at once. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, tuple[str, ...]] | None = None, schemas: dict[str, str] | None = None, partitions: dict[str, str] | None = None):
        self.spark, self.path, self.keys, self.schemas, self.partitions = spark, path.rstrip("/"), keys or {}, schemas or {}, partitions or {}

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The highest committed version, 0 for none."""
        place, fs = self._folder(f"{self.path}/manifest")
        found = [s.getPath() for s in fs.listStatus(place)] if fs.exists(place) else []
        success = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        return max((int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(success(p))), default=0)

    def folders(self) -> dict[str, list[str]]:
        version = self._version()
        if not version:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={version}").orderBy("name", "place").collect()  # a few for each table
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r["name"], []).append(r["folder"])
        return out

    def exists(self, name: str) -> bool:
        return name in self.folders()

    def missing(self, *names: str) -> list[str]:
        """Those of the tables that are not there."""
        return sorted(set(names) - set(self.folders()))

    def _layers(self, name: str, folders: list[str]) -> list[DataFrame]:
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        return [reader.parquet(f"{self.path}/tables/{f}") for f in folders]

    def layers(self, name: str) -> list[DataFrame]:
        """A table's folders, oldest first; of rows of one key the newest folder's counts."""
        return self._layers(name, self.folders().get(name, []))

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        parts = self._layers(name, folders)
        if len(parts) == 1:
            return parts[0]
        key = self.keys.get(name, ())
        every = parts[0].withColumn("_age", F.lit(0))
        for k, part in enumerate(parts[1:], 1):
            every = every.unionByName(part.withColumn("_age", F.lit(k)))
        if not key:
            return every.drop("_age")
        rest = [c for c in parts[0].columns if c not in key]
        if not rest:
            return every.select(*key).distinct()
        return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "_age").alias("_row")).select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in parts[0].columns])

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self.folders()[name])

    def read_or(self, name: str, schema: str) -> DataFrame:
        folders = self.folders()
        return self._rows(name, folders[name]) if name in folders else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written beside the tables, for use within a commit's work."""
        path = f"{self.path}/staging/{name}-{uuid.uuid4().hex}"
        saved(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Write all tables, then the manifest that shows them."""
        version, folders = self._version(), self.folders()
        for name, rows, fresh in [*((n, r, False) for n, r in (append or {}).items()), *((n, r, True) for n, r in (replace or {}).items())]:
            held = [] if fresh else folders.get(name, [])
            folders[name] = self._merged(name, [*held, self._write(name, rows)])
        listed = [(name, k, f) for name, parts in folders.items() for k, f in enumerate(parts)]
        self.spark.createDataFrame(listed, "name string, place int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version + 1}")

    def _bytes(self, folder: str) -> int:
        place, fs = self._folder(f"{self.path}/tables/{folder}")
        return fs.getContentSummary(place).getLength()

    def _merged(self, name: str, folders: list[str]) -> list[str]:
        """The folders, oldest first; beyond ``MOST_FOLDERS`` the newest ones as one, from the first that is not much larger than all after it."""
        if len(folders) <= MOST_FOLDERS:
            return folders
        size = [self._bytes(f) for f in folders]
        first = len(folders) - 2
        while first and size[first - 1] <= TIER * sum(size[first:]):
            first -= 1
        return [*folders[:first], self._write(name, self._rows(name, folders[first:]))]

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        saved(rows, f"{self.path}/tables/{folder}", *([self.partitions[name]] if name in self.partitions else []))
        return folder

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        self.commit(replace={name: rows})
        return self.read(name)

    def drop(self, name: str) -> None:
        self.write(name, self.read(name).limit(0))

    def vacuum(self) -> None:
        """Delete staged rows and all folders that the manifest in force does not list; for when no one reads older versions."""
        used = {f for parts in self.folders().values() for f in parts}
        for top in ("staging", "tables"):
            place, fs = self._folder(f"{self.path}/{top}")
            for s in fs.listStatus(place) if fs.exists(place) else []:
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)

    def stats(self) -> DataFrame:
        """Rows of each table of the graph that is there."""
        there = self.folders()
        parts = [self.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("docs", "chunks", "entities", "facts", "edges") if n in there]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
