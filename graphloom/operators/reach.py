"""Marks of functions: which reach a dangerous operation, and which are reached from an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import calls as C
from graphloom.operators import graph as G

#: Annotations of functions that are called from outside.
ENTRY_ANNOTATIONS = "WebService WebMethod Path GET POST PUT DELETE RequestMapping GetMapping PostMapping PutMapping DeleteMapping RestController Controller".split()
#: What a summary may say a function touches that makes it a sink.
SUMMARY_SINKS = "sql exec file deserialize response reflection".split()


def trusted_calls(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, strategy) between functions over trusted calls, one row a pair."""
    fn = functions.select("id").distinct()
    e = edges.filter((F.col("type") == "CALLS") & G.trusted(F.col("strategy"))).select("src", "dst", "strategy").dropna(subset=["src", "dst"])
    e = e.groupBy("src", "dst").agg(F.min("strategy").alias("strategy"))
    return e.join(fn.withColumnRenamed("id", "src"), "src", "left_semi").join(fn.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "strategy")


def external_kinds(edges: DataFrame, external: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, kind, name) of the external kinds each function calls directly. ``external``: node_id,
    kind, name. Calls are combined per function and target first."""
    x = external.select(F.col("node_id").alias("dst"), "kind", "name").filter("kind is not null")
    x = x.filter(F.col("kind").isin(kinds)) if kinds else x
    e = edges.filter((F.col("type") == "CALLS_EXTERNAL") & F.col("src").isNotNull()).select("src", "dst").distinct()
    return e.join(x, "dst").select(F.col("src").alias("id"), "kind", "name")


def sink_seeds(functions: DataFrame, nodes: DataFrame, edges: DataFrame, external: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(id, kind): functions with a dangerous external call, with catalogued weaknesses, and, if
    there are summaries (id, summary_hash, touches), those whose fresh summary names a sink. Of
    several origins the first counts, in this order of their reliability: calls, summaries (they give
    no kind), the catalog."""
    fn = functions.select("id", "body_hash").distinct()
    direct = external_kinds(edges, external, C.DANGEROUS).select("id", "kind").distinct().join(fn.select("id"), "id", "left_semi")
    found = direct
    if summaries is not None:
        s = summaries.join(fn, "id").filter((F.col("summary_hash") == F.col("body_hash")) & F.arrays_overlap("touches", F.array(*[F.lit(x) for x in SUMMARY_SINKS])))
        found = found.unionByName(s.select("id", F.lit(None).cast("string").alias("kind")).join(direct.select("id"), "id", "left_anti"))
    t = nodes.filter("label = 'Function' and taint_categories is not null").select("id", F.explode("taint_categories").alias("category")).distinct()
    t = t.join(found.select("id"), "id", "left_anti").select("id", C.category_kind(F.col("category")).alias("kind")).distinct()
    return found.unionByName(t)


def entry_seeds(functions: DataFrame, nodes: DataFrame, edges: DataFrame, annotations: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(id, why) of the functions where something comes in: annotated as entry, exposed as an
    endpoint, the service method of a page, a reader of untrusted data, and, if given, those whose
    summary says so (id, sig_entry). ``annotations``: node_id, name."""
    fn = functions.select("id", "lang", "name").distinct()
    a = annotations.filter(F.regexp_replace("name", "^@", "").isin(ENTRY_ANNOTATIONS)).select(F.col("node_id").alias("dst")).distinct()
    out = edges.filter("type = 'ANNOTATED_WITH'").join(a, "dst", "left_semi").select(F.col("src").alias("id"), F.lit("annotation").alias("why"))
    out = out.unionByName(edges.filter("type = 'EXPOSES'").select(F.col("src").alias("id"), F.lit("endpoint").alias("why")))
    out = out.unionByName(fn.filter("lang = 'jsp' and name = '_jspService'").select("id", F.lit("page").alias("why")))
    out = out.unionByName(nodes.filter("label = 'Function' and taint_source").select("id", F.lit("source").alias("why")))
    if signals is not None:
        out = out.unionByName(signals.filter("sig_entry").select("id", F.lit("summary").alias("why")))
    return out.dropna(subset=["id"]).distinct().join(fn.select("id"), "id", "left_semi")


def reaches_sink(seeds: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions from which a seed can be reached."""
    return G.closure(seeds.select("id").distinct(), calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reaches_kinds(seeds: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, kind) pairs: the kinds each function reaches."""
    return G.closure(seeds.select("id", "kind").dropna().distinct(), calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def sink_paths(entries: DataFrame, sinks: DataFrame, calls: DataFrame, reach: DataFrame, hubs: DataFrame, max_hops: int, min_hops: int = 0) -> DataFrame:
    """(ids, strategies, hops) of the trails from an entry to a sink over functions that all reach a
    sink, around hubs."""
    gone = hubs.select("id")
    ok = reach.select("id").join(gone, "id", "left_anti")
    e = calls.join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    # only edges from which a sink is still reachable without hubs lead to the end of a path
    ends = sinks.select("id").distinct().join(ok, "id", "left_semi")
    alive = G.closure(ends, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "strategy")
    p = G.trails(entries.select("id").distinct().join(alive, "id", "left_semi"), e, max_hops, min_hops)
    return p.withColumn("last", F.element_at("ids", -1)).join(ends.withColumnRenamed("id", "last"), "last", "left_semi").drop("last")


def leak_paths(acquirers: DataFrame, calls: DataFrame, hubs: DataFrame, max_hops: int) -> DataFrame:
    """Trails below every function that acquires a connection, to any end, around hubs."""
    gone = hubs.select("id")
    e = calls.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "strategy")
    return G.trails(acquirers.select("id").distinct().join(gone, "id", "left_anti"), e, max_hops)


def on_path(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """``paths`` with ``has_sanitizer``: is any of its functions in ``marks`` (id)?"""
    hit = paths.select("ids", F.explode(F.array_distinct("ids")).alias("id")).join(marks.select("id").distinct(), "id", "left_semi").select("ids").distinct().withColumn("has_sanitizer", F.lit(True))
    return paths.join(hit, "ids", "left").withColumn("has_sanitizer", F.coalesce("has_sanitizer", F.lit(False)))
