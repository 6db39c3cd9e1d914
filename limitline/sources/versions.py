"""Stored tables with versions: replaced as a whole or by month, cloned without a copy.

A table is a folder of manifests, one small file per version, which list the data folders
of that version. Data is written first and the manifest last, by creating a file that
must not exist yet; so a version is there as a whole or not at all, readers of an older one
are not disturbed, and of two writers one fails. A clone lists the same data folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "_part"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


class TableExists(PySparkException):
    """The table, or the version that was to be written, is already there."""


class VersionedTable:
    """A stored table under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files, through Hadoop's file system: any store that Spark writes to

    def _files(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), made

    def _list(self, path: str) -> list[str]:
        fs, at = self._files(path)
        return [status.getPath().toString() for status in fs.listStatus(at)] if fs.exists(at) else []

    def _commit(self, version: int, manifest: dict) -> None:
        fs, at = self._files(f"{self.root}/versions/{version:010d}.json")
        if fs.exists(at):
            raise TableExists(f"version {version} of {self.root} is already there")
        out = fs.create(at, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # ---- reading

    def versions(self) -> list[int]:
        names = (path.rpartition("/")[2] for path in self._list(f"{self.root}/versions"))
        return sorted(int(name[:10]) for name in names if name.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"no table at {self.root}")
            version = found[-1]
        fs, at = self._files(f"{self.root}/versions/{version:010d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, parts: Iterable | None = None) -> DataFrame:
        """The rows of a version, by default the last; of the given parts only, if any are."""
        manifest = self.manifest(version)
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = None if parts is None else {_name(p) for p in parts}
        folders = [f["path"] for f in manifest["folders"] if wanted is None or f["part"] in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # ---- writing

    def _write(self, df: DataFrame, by: str | None) -> list[dict]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(path)
            return [{"path": path, "part": None}]
        # The column stays in the files; its copy names the folders.
        df.withColumn(_PART, F.col(by).cast("string")).write.partitionBy(_PART).parquet(path)
        folders = [f for f in self._list(path) if f.rpartition("/")[2].startswith(f"{_PART}=")]
        return [{"path": f, "part": f.rpartition("=")[2]} for f in folders]

    def _next(self) -> int:
        found = self.versions()
        return found[-1] + 1 if found else 1

    def create(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Store a new table, one folder per value of ``by``; fails if there is one."""
        if self.exists():
            raise TableExists(f"{self.root} is already there")
        return self.replace(df, by)

    def replace(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Create the table or replace it as a whole; a failed write leaves the old version."""
        version = self._next()
        folders = self._write(df, by)
        self._commit(version, {"schema": df.schema.jsonValue(), "by": by, "folders": folders})
        return self.read(version)

    def replace_parts(self, df: DataFrame, parts: Iterable) -> DataFrame:
        """Replace some parts by the rows of ``df``, all of which lie in them; the others keep their files."""
        version, old = self._next(), self.manifest()
        gone = {_name(p) for p in parts}
        folders = self._write(df.select(*T.StructType.fromJson(old["schema"]).names), old["by"])
        strange = {f["part"] for f in folders} - gone
        if strange:
            raise ValueError(f"rows outside the parts to replace: {sorted(strange)}")
        kept = [f for f in old["folders"] if f["part"] not in gone]
        self._commit(version, {**old, "folders": kept + folders})
        return self.read(version)

    def clone(self, root: str) -> VersionedTable:
        """A new table at ``root`` that starts as this one and shares its files."""
        other = VersionedTable(self.spark, root)
        if other.exists():
            raise TableExists(f"{root} is already there")
        other._commit(1, self.manifest())
        return other

    def drop(self) -> None:
        """Forget all versions. Data files stay, as clones may read them."""
        fs, at = self._files(f"{self.root}/versions")
        fs.delete(at, True)


def _name(part) -> str:
    return NULL_PART if part is None else str(part)
