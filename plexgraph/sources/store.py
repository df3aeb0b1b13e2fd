"""Versioned Parquet tables: every commit writes new snapshots, then one pointer file.

A reader sees the old version or the new one, never a mixture; a restore moves the pointer to a kept
version, or brings back a copy that lies outside the store.  Paths go through Hadoop's file systems, so a store may lie anywhere Spark reads.

A table with a collection column has a folder for each collection in each commit's folder.  A version
names the folders that it consists of, so a commit of some collections writes theirs alone and goes
on naming the others' where they lie: {table: {commit folder: [collection folders], or [] for all}}."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

#: A version: for each table its commits' folders, with the collections' folders that count.
Folders = dict[str, dict[str, list[str]]]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, version: int) -> Folders:
        rows = self.spark.read.text(f"{self.root}/versions/{self._read_name(version)}").collect()  # one small file
        return json.loads("".join(r.value for r in rows))

    def current(self) -> Folders:
        found = self._versions()
        return self._read(found[-1]) if found else {}

    def table(self, name: str, only: list[str] | None = None) -> DataFrame:
        """The table, empty if it was never written; of a table by collections, those in only, whose folders alone are listed."""
        base, kept = f"{self.root}/data/{name}", self.current().get(name, {})
        if only is not None and self._by_collection(name):
            wanted = {self._folder(x) for x in only}
            kept = {c: own for c, xs in kept.items() if (own := [x for x in xs or self._folders(name, c) if x in wanted])}
        paths = [f"{base}/{c}/{x}" if x else f"{base}/{c}" for c, xs in kept.items() for x in xs or [""]]
        empty = self.spark.createDataFrame([], TABLES[name])
        if not paths:
            return empty
        return self.spark.read.schema(TABLES[name]).option("basePath", base).parquet(*paths).select(*empty.columns)

    def commit(self, only: list[str] | None = None, **tables: DataFrame) -> int:
        """Write tables as one new version.  The pointer is created, not replaced: of two writers one fails.

        With only, the tables by collections are written for those alone (their other rows are not
        looked at), and all other collections keep the files that they have."""
        before, after = self.current(), {}
        for name, df in tables.items():
            want = self.spark.createDataFrame([], TABLES[name]).schema
            commit = f"commit={uuid.uuid4().hex}"
            own = df.select(*[df[f.name].cast(f.dataType) for f in want])
            if not self._by_collection(name):
                own.write.parquet(f"{self.root}/data/{name}/{commit}")
                after[name] = {commit: []}
                continue
            if only is not None:
                own = own.where(F.col("collection").isin(only))
            own.write.partitionBy("collection").parquet(f"{self.root}/data/{name}/{commit}")
            kept = {}
            if only is not None:
                replaced = {self._folder(x) for x in only}
                kept = {c: rest for c, xs in before.get(name, {}).items() if (rest := [x for x in xs or self._folders(name, c) if x not in replaced])}
            after[name] = kept | ({commit: []} if self._folders(name, commit) else {})
        return self._point(before | after)

    def _by_collection(self, name: str) -> bool:
        return TABLES[name].startswith("collection string,") or ", collection string" in TABLES[name]

    def _folder(self, collection: str) -> str:
        """The name of a collection's folder, escaped as Spark's writer does."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("collection", collection)

    def _folders(self, name: str, commit: str) -> list[str]:
        """The collection folders of a commit."""
        found = (x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/data/{name}/{commit}")))
        return sorted(x for x in found if x.startswith("collection="))

    def _point(self, paths: Folders) -> int:
        found = self._versions()
        version = (found[-1] if found else 0) + 1
        self._write(f"{self.root}/versions/{version:08d}", json.dumps(paths))
        return version

    def _read_name(self, version: int) -> str:
        return f"{version:08d}"

    def restore(self, version: int) -> int:
        """Make an older version the newest."""
        return self._point(self._read(version))

    def backup(self, folder: str, keep: int = 10, clock=time.time) -> str:
        """Copy the newest version to a folder of its own below `folder`, and keep the newest `keep` copies; returns the copy's path.

        A copy shares nothing with the store, so it outlives pruning and damage."""
        at = f"{folder.rstrip('/')}/{int(clock() * 1000):015d}"
        paths = self.current()
        for name in paths:
            self.table(name).write.parquet(f"{at}/{name}")
        self._write(f"{at}/tables.json", json.dumps(sorted(paths)))
        copies = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if self._fs.exists(self._path(f"{folder}/{x.getPath().getName()}/tables.json")))
        for old in copies[:-keep] if keep > 0 else []:
            self._fs.delete(self._path(f"{folder}/{old}"), True)
        return at

    def restore_copy(self, at: str) -> int:
        """Make a copy the newest version: its tables are written first, so a failure leaves the store as it was."""
        names = json.loads("".join(r.value for r in self.spark.read.text(f"{at}/tables.json").collect()))
        return self.commit(**{n: self.spark.read.schema(TABLES[n]).parquet(f"{at}/{n}") for n in names})

    def size(self) -> int:
        """Bytes below the store's root."""
        at = self._path(self.root)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def _write(self, at: str, text: str) -> None:
        out = self._fs.create(self._path(at), False)
        out.write(bytearray(text.encode()))
        out.close()

    def prune(self, keep: int = 10) -> int:
        """Forget all versions but the newest `keep`, and data that only they had."""
        found = self._versions()
        old, new = found[:-keep], found[-keep:]
        used: dict[str, set[str]] = {}  # commit folders with what is used of them; "" is all
        for v in new:
            for name, own in self._read(v).items():
                for c, xs in own.items():
                    used.setdefault(f"data/{name}/{c}", set()).update(xs or [""])
        gone = set()
        for v in old:
            for name, own in self._read(v).items():
                for c, xs in own.items():
                    at = f"data/{name}/{c}"
                    if at not in used:
                        gone.add(at)
                    elif "" not in used[at]:
                        gone |= {f"{at}/{x}" for x in xs or self._folders(name, c) if x not in used[at]}
        for v in old:
            self._fs.delete(self._path(f"{self.root}/versions/{self._read_name(v)}"), False)
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)
        return len(old)
