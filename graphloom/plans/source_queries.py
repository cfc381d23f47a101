"""From source texts to a resolved graph. Parsing has no SQL; the tests compare with cases, and
``extract_recall`` with the nodes that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import extract as E
from graphloom.operators import resolve as R
from graphloom.plans.common import Registry, table
from graphloom.session import Scratch, files_of, spread

query = Registry()
QUERIES, SQL = query.queries, query.sql

_done: dict[tuple, tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {}


def _extracted(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, nodes, refs, edges), written once per session and state of the input."""
    key = (spark.sparkContext.applicationId, d, files_of(spark, f"{d}/file_info.parquet"))
    if key not in _done:
        f = table(spark, d, "file_info").select("repo", "relpath", "lang", "source").filter("repo is not null and lang is not null")
        s = Scratch(spark, "extract")
        x, _ = s.write(E.extract(spread(f, spark)), "files")
        nodes, refs, edges = E.tables(x)
        _done[key] = (x, s.write(nodes, "nodes")[0], s.write(refs, "refs")[0], s.write(edges, "edges")[0])
    return _done[key]


def _hierarchy(nodes: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of the links to superclasses and interfaces that have one target only."""
    up = refs.filter("type in ('EXTENDS', 'IMPLEMENTS')")
    t = R.types(up, R.Names(nodes, edges, refs)).withColumn("n", F.count("cand").over(W.partitionBy("ref_id"))).filter("n = 1 and cand is not null")
    return t.join(up.select("ref_id", "src"), "ref_id").select("src", F.col("cand").alias("dst")).distinct()


def _resolved(spark, d) -> DataFrame:
    _, nodes, refs, edges = _extracted(spark, d)
    contains = edges.filter("type = 'CONTAINS'").select("src", "dst")
    return R.resolve(refs, nodes, contains, _hierarchy(nodes, refs, contains))


@query()
def extract_counts(spark, d):
    """Nodes by language, label and kind; files that can't be read by their error."""
    x, nodes, _, _ = _extracted(spark, d)
    bad = x.filter("error is not null").groupBy("lang", F.lit("(error)").alias("label"), F.substring_index("error", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.groupBy("lang", "label", "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(bad)


@query()
def extract_recall(spark, d):
    """Of the known nodes with a place in a file, how many come out of the sources under the same name
    and line, and how many of those with the same signature and last line."""
    n = table(spark, d, "nodes").filter("label in ('Function', 'Class', 'Field', 'Table') and file is not null and start_line is not null").groupBy("id").agg(F.max_by(F.struct("repo", "file", "lang", "label", "name", "start_line", "end_line", "signature"), "last_indexed").alias("n")).select("id", "n.*")
    _, nodes, _, _ = _extracted(spark, d)
    g = nodes.select("repo", "file", "label", "name", "start_line", F.col("end_line").alias("g_end"), F.col("signature").alias("g_signature")).dropDuplicates(["repo", "file", "label", "name", "start_line"])
    j = n.join(g.withColumn("found", F.lit(True)), ["repo", "file", "label", "name", "start_line"], "left")
    return j.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n_known"), F.count_if("found").alias("n_found"), F.count_if(F.col("end_line") == F.col("g_end")).alias("n_same_end"), F.count_if(F.col("signature") == F.col("g_signature")).alias("n_same_signature"))


@query()
def ref_counts(spark, d):
    """References by type, and how many name a receiver, its type and the number of arguments."""
    r = _extracted(spark, d)[2]
    return r.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("recv") != "").alias("n_receiver"), F.count_if(F.col("recv_type") != "").alias("n_typed"), F.count_if(F.col("call_arity") >= 0).alias("n_arity"))


@query()
def endpoints(spark, d):
    """Endpoints that functions expose."""
    return _extracted(spark, d)[1].filter("label = 'Endpoint'").select("repo", "file", "method", "route")


@query()
def resolve_refs(spark, d):
    """Every reference of the sources with what it was resolved to, and how."""
    return _resolved(spark, d).select("ref_id", "type", "src", "dst", "strategy", "confidence", "outcome")


@query()
def resolve_coverage(spark, d):
    """References per final type and outcome."""
    return R.coverage(_resolved(spark, d))


@query()
def cap_counts(spark, d):
    """References given up since their name is too common, by type."""
    r = _resolved(spark, d).filter("outcome = 'unresolved' and strategy like 'name%'")
    return r.groupBy("type", "strategy").agg(F.count_distinct("ref_id").alias("n_dropped"))
