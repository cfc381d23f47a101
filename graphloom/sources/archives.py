"""Uploads: files out of archives, and which of them are let in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.sources.files import IGNORED


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes, or null for one that leads out of its folder, names a
    drive, or is empty."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+", ""), r"(?:^|(?<=/))(?:\./)+|/+(?=/)", "")
    bad = F.contains(p, F.lit(":")) | F.array_contains(F.split(p, "/"), "..") | (p == "")
    return F.when(~bad, p)


def admitted(path: Column) -> Column:
    """Sources outside ignored folders, and artifacts wherever they are."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    inside = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED]))
    return X.artifact_kind(path).isNotNull() | (X.source_lang(path).isNotNull() & ~inside)


def entries(archives: DataFrame) -> DataFrame:
    """(archive, path, content, error) of the files in zip archives (path, content), one archive a
    task. Entries whose names are unsafe are left out; one that can't be read gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["archive", "path", "content", "error"]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(name, None, None, str(e))], columns=cols)
                    continue
                with z:
                    for i in z.infolist():
                        if not i.is_dir():
                            try:
                                yield pd.DataFrame([(name, i.filename, z.read(i), None)], columns=cols)
                            except Exception as e:  # one bad entry is skipped
                                yield pd.DataFrame([(name, i.filename, None, str(e)[:200])], columns=cols)

    e = archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary, error string")
    return e.withColumn("path", safe_path(F.col("path"))).filter("path is not null or error is not null")


def sources(uploaded: DataFrame, repo: str) -> DataFrame:
    """(repo, relpath, lang, sha, source) of the admitted sources of ``uploaded`` (path, content)."""
    u = uploaded.withColumn("relpath", safe_path(F.col("path"))).filter(F.col("relpath").isNotNull() & F.col("content").isNotNull())
    u = u.filter(admitted(F.col("relpath")) & X.source_lang(F.col("relpath")).isNotNull())
    src = F.decode("content", "UTF-8")
    return u.select(F.lit(repo).alias("repo"), "relpath", X.source_lang(F.col("relpath")).alias("lang"), X.body_hash(src).alias("sha"), src.alias("source"))
