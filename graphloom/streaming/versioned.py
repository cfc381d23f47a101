"""Immutable table versions with manifests, and the record deltas between them.

A table is a folder of Parquet files that are never changed. A version is a JSON manifest naming
the live data files and, for each, the deletion vectors that hide some of its rows. A commit is
one exclusive create of the next manifest, so a run that dies before it leaves nothing behind but
files no manifest names; whoever comes second to the same version number fails. Readers of a
version never see later commits. The delta of two versions comes from their manifests alone: rows
of added files were added, rows of removed files and rows newly hidden were removed.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import hadoop

_FILE, _POS = "__file", "__pos"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedTable:
    """A versioned table at ``path``; made empty on first use. Columns starting with two
    underscores are reserved."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # manifests

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def latest(self) -> int:
        """The last committed version; 0 is the empty table."""
        fs, p = hadoop(self.spark, f"{self.path}/_manifests")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")], default=0)

    def manifest(self, version: int) -> dict[str, Any]:
        """``files``: data folder -> list of deletion vector folders; ``properties`` of the commit."""
        if version == 0:
            return {"version": 0, "files": {}, "properties": {}}
        fs, p = hadoop(self.spark, self._manifest_path(version))
        stream = fs.open(p)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return json.loads(text)

    def properties(self) -> dict[str, Any]:
        return self.manifest(self.latest())["properties"]

    # reading

    def _empty(self, *more: T.StructField) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *more]))

    def _scan(self, folders: list[str], positions: bool = False) -> DataFrame:
        if not folders:
            return self._empty(*([T.StructField(_FILE, T.StringType()), T.StructField(_POS, T.LongType())] if positions else []))
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        if positions:
            df = df.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_POS))
        return df

    def _vectors(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{_FILE} string, {_POS} long").parquet(*[f"{self.path}/{f}" for f in folders])

    def _live(self, files: dict[str, list[str]]) -> DataFrame:
        plain = [f for f, dv in files.items() if not dv]
        out = self._scan(plain, positions=True)
        hidden = {f: dv for f, dv in files.items() if dv}
        if hidden:
            dead = self._vectors(sorted({x for dv in hidden.values() for x in dv}))
            out = out.unionByName(self._scan(list(hidden), positions=True).join(dead, [_FILE, _POS], "left_anti").select(*out.columns))
        return out

    def read(self, version: int | None = None, positions: bool = False) -> DataFrame:
        """The rows of a version. ``positions`` adds the file and row number that ``commit`` takes
        to hide rows."""
        df = self._live(self.manifest(self.latest() if version is None else version)["files"])
        return df if positions else df.drop(_FILE, _POS)

    def removes(self, since: int, until: int) -> bool:
        """Were rows removed between two versions? Told by the manifests alone."""
        old, new = self.manifest(since)["files"], self.manifest(until)["files"]
        return any(f not in new or set(new[f]) - set(dv) for f, dv in old.items())

    def changes(self, since: int, until: int) -> DataFrame:
        """Rows added and removed between two versions, as ``_change`` insert or delete. A row both
        added and removed between them doesn't appear."""
        old, new = self.manifest(since)["files"], self.manifest(until)["files"]
        added = self._live({f: dv for f, dv in new.items() if f not in old}).drop(_FILE, _POS).withColumn("_change", F.lit("insert"))
        gone = self._live({f: dv for f, dv in old.items() if f not in new}).drop(_FILE, _POS)
        fresh = {f: [x for x in new[f] if x not in old[f]] for f in old if f in new and set(new[f]) - set(old[f])}
        if fresh:
            dead = self._vectors(sorted({x for dv in fresh.values() for x in dv}))
            gone = gone.unionByName(self._live({f: old[f] for f in fresh}).join(dead, [_FILE, _POS], "left_semi").drop(_FILE, _POS))
        return added.unionByName(gone.withColumn("_change", F.lit("delete")))

    # writing

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a new folder that no manifest names yet."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.path}/{name}")
        return name

    def stage_split(self, rows: DataFrame, by: Column, parts: int) -> list[str]:
        """Write rows to ``parts`` folders in one pass, each row to the one that ``by`` numbers."""
        name = f"data/{uuid.uuid4().hex}"
        cols = [F.col(f.name).cast(f.dataType) for f in self.schema.fields]
        rows.select(*cols, by.cast("int").alias("__part")).write.partitionBy("__part").parquet(f"{self.path}/{name}")
        fs, _ = hadoop(self.spark, self.path)
        made = [f"{name}/__part={i}" for i in range(parts)]
        for m in made:
            # a part without rows is an empty folder
            fs.mkdirs(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m}"))
        return made

    def stage_vector(self, rows: DataFrame) -> str:
        """Write file and row numbers (as given by ``read(positions=True)``) of rows to hide."""
        name = f"dv/{uuid.uuid4().hex}"
        rows.select(_FILE, _POS).write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, base: int, add: list[str] = (), hide: list[str] = (), remove: list[str] = (), properties: dict[str, Any] | None = None) -> int:
        """Make version ``base + 1`` out of ``base``; fails if somebody else has made it already.
        ``hide``: vectors laid over all files of ``base``."""
        files = {f: [*dv, *hide] for f, dv in self.manifest(base)["files"].items() if f not in remove}
        return self.commit_files(base, files | {f: [] for f in add}, properties)

    def commit_files(self, base: int, files: dict[str, list[str]], properties: dict[str, Any] | None = None) -> int:
        """Make version ``base + 1`` with exactly ``files`` (folder -> its deletion vectors)."""
        body = {"version": base + 1, "files": files, "properties": self.manifest(base)["properties"] | (properties or {})}
        self._create(self._manifest_path(base + 1), json.dumps(body))
        return base + 1

    def _create(self, path: str, text: str) -> None:
        """Whole or not at all, and never over an existing file: written aside, then renamed."""
        sc = self.spark.sparkContext
        fs, aside = hadoop(self.spark, f"{self.path}/_aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.writeBytes(text)
        finally:
            out.close()
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs.mkdirs(target.getParent())
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        none = sc._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Exception as e:
            fs.delete(aside, False)
            raise CommitConflict(f"{path} exists") from e
