"""Source trees and graph documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X

#: Folders a source scan doesn't enter.
IGNORED = (
    "node_modules", "target", "build", "out", "bin", "dist", "__pycache__", ".git", ".idea", ".venv", "venv",
    "env", ".gradle", ".mvn", ".pytest_cache", ".mypy_cache", "site-packages", "__MACOSX",
)


def names(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, path, length) of every file under ``root``; no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    return df.select(F.substring(path, F.length(base) + 1, 1 << 20).alias("relpath"), "path", "length")


def _inside_ignored(relpath) -> Column:
    return F.arrays_overlap(F.split(relpath, "/"), F.array(*[F.lit(x) for x in IGNORED])) | F.startswith(F.substring_index(relpath, "/", -1), F.lit("._"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, kind) of build artifacts, those in build folders too; no content is read."""
    n = names(spark, root).filter(~F.startswith(F.substring_index("relpath", "/", -1), F.lit("._")))
    return n.select("relpath", X.artifact_kind(F.col("relpath")).alias("kind")).filter("kind is not null")


def source_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, relpath, lang, sha, source) of every source file under ``root``. Folders are listed
    first: only files outside ignored folders, of a known language and no artifacts, are opened."""
    wanted = names(spark, root).filter(~_inside_ignored(F.col("relpath")) & X.source_lang(F.col("relpath")).isNotNull())
    folders = [r["d"] for r in wanted.select(F.regexp_replace("path", "[^/]*$", "").alias("d")).distinct().collect()]  # folders with sources
    if not folders:
        return spark.createDataFrame([], "repo string, relpath string, lang string, sha string, source string")
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    rel = F.substring(F.regexp_replace("path", "^file:/*", "/"), F.length(base) + 1, 1 << 20)
    df = spark.read.format("binaryFile").load([d.replace("%20", " ") for d in folders])
    out = df.select(rel.alias("relpath"), "content").filter(~_inside_ignored(F.col("relpath")) & X.source_lang(F.col("relpath")).isNotNull())
    src = F.decode("content", "UTF-8")
    return out.select(F.lit(repo).alias("repo"), "relpath", X.source_lang(F.col("relpath")).alias("lang"), X.body_hash(src).alias("sha"), src.alias("source"))


def call_oracle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Calls a compiler has resolved (tab-separated, eight columns) and the files it got through
    (rows that start with @FILE)."""
    cols = "caller_class string, caller string, caller_arity string, callee_class string, callee string, callee_arity string, file string, line string"
    t = spark.read.schema(cols).option("sep", "\t").option("quote", "").csv(path)
    rows = t.filter("caller_class <> '@FILE' and callee is not null")
    n = [c for c in t.columns if c not in ("caller_arity", "callee_arity", "line")]
    return rows.select(*n, *[F.col(c).try_cast("int").alias(c) for c in ("caller_arity", "callee_arity", "line")]), t.filter("caller_class = '@FILE'").select(F.col("caller").alias("file")).distinct()


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(test, category, real, cwe) of a benchmark's expected results; comments and short rows are left out."""
    t = spark.read.schema("test string, category string, real string, cwe string").option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return t.dropna(subset=["test", "category", "real"]).withColumn("real", F.lower("real") == "true")


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports, one JSON object a line."""
    return spark.read.json(path)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of exported graph documents (one JSON object with two lists each)."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines under ``path``/nodes and ``path``/edges."""
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")
