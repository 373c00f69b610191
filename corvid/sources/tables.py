"""Stored tables, snapshots and payloads in a folder that driver and executors share.

A table is a list of folders of Parquet files, named by its latest commit. A commit is one small file with the next number,
created only if it does not exist, so of two writers that start from the same state one fails (``Conflict``) and reads again.
Folders are never changed, and a reader keeps the list that it began with. A commit that a dying writer left unfinished is
passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import stores


class Conflict(Exception):
    """Another writer committed first."""


class Folder:
    """Files by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def create(self, name: str, content: bytes) -> bool:
        """False if the file exists already; never overwrites."""
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:  # Hadoop's own exceptions differ by file system
            if self.fs.exists(self.at(name)):
                return False
            raise e
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return True

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.at(name), True))


class Table:
    """A table with appends, keyed upserts and deletes."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: tuple[str, ...] = ()):
        self.spark, self.schema, self.keys, self.folder = spark, schema, keys, Folder(spark, root)

    def _state(self) -> tuple[int, list[str]]:
        names = self.folder.names("commits")
        for name in reversed(names):
            try:
                return int(names[-1].split(".")[0]), json.loads(self.folder.read(f"commits/{name}"))["folders"]
            except ValueError:
                continue  # unfinished
        return -1 if not names else int(names[-1].split(".")[0]), []

    def _commit(self, after: int, folders: list[str]) -> None:
        if not self.folder.create(f"commits/{after + 1:012d}.json", json.dumps({"folders": folders}).encode()):
            raise Conflict(self.folder.root)

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder.root}/data/{name}")
        return name

    def read(self) -> DataFrame:
        _, folders = self._state()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.folder.root}/data/{n}" for n in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        after, folders = self._state()
        self._commit(after, [*folders, self._written(rows.select(*self.read().columns))])

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        """Rows of the same keys are replaced; of several new ones the last by ``order`` stays."""
        after, _ = self._state()
        now = self.read()
        self._commit(after, [self._written(stores.upsert(now, rows.select(*now.columns), self.keys, order))])

    def replace(self, rows: DataFrame) -> None:
        """The rows are all that the table holds from then on; they may come from the table itself."""
        after, _ = self._state()
        self._commit(after, [self._written(rows.select(*self.read().columns))])

    def delete(self, which: Column) -> None:
        """Deletes the rows for which ``which`` is true; what is null stays."""
        after, _ = self._state()
        self._commit(after, [self._written(self.read().where(~F.coalesce(which, F.lit(False))))])

    def vacuum(self) -> None:
        """Deletes folders that the latest commit does not name. No reader of older states may be left."""
        _, folders = self._state()
        for name in set(self.folder.names("data")) - set(folders):
            self.folder.delete(f"data/{name}")


def write_snapshots(docs: DataFrame, root: str) -> None:
    """docs (document_id, version_num, content, canonical_json) as files below document and version; written by the tasks."""
    docs.select("document_id", "version_num", "content", "canonical_json").write.mode("append").partitionBy("document_id", "version_num").parquet(root)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


class Payloads:
    """Payloads by locator: staged before a submission is accepted, deleted when its operation has ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def stage(self, content: bytes) -> str:
        """The locator of the content; equal contents have one."""
        import hashlib

        name = hashlib.sha256(content).hexdigest()
        self.folder.create(name, content)
        return name

    def open(self, locator: str) -> bytes:
        if "/" in locator or not locator:
            raise ValueError("no locator")
        return self.folder.read(locator)

    def delete(self, locator: str) -> bool:
        if "/" in locator or not locator:
            raise ValueError("no locator")
        return self.folder.delete(locator)
