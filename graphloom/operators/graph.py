"""Reachability, bounded trails, neighbourhoods and hierarchy walks over edge tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.session import Scratch

#: Rows of two ids and a word up to which a table is sent to all tasks, after it has been counted.
SMALL = 400_000
#: New rows up to which a round walks HOPS steps in one job.
FEW, HOPS = 50_000, 5


def trusted(strategy: Column) -> Column:
    """Edges precise enough to walk on; a null strategy is not."""
    s = F.coalesce(strategy, F.lit(""))
    return (s == "bytecode") | F.startswith(s, F.lit("receiver_type")) | F.startswith(s, F.lit("same_"))


class Edges:
    """Edges ready for many joins on ``key``: written once and counted; sent to all tasks if they
    are few, else kept on the executors' disks in partitions of the key, so that only frontiers
    move."""

    def __init__(self, scratch: Scratch, edges: DataFrame, key: str):
        self.key = key
        written, self.n = _counted(scratch, edges, "edges")
        self.kept = self.n > SMALL
        self.df = written.repartition(key).persist(StorageLevel.DISK_ONLY) if self.kept else F.broadcast(written)

    def follow(self, frontier: DataFrame, at: str, rows: int) -> DataFrame:
        """Inner join of ``frontier``.``at`` with the key."""
        f = F.broadcast(frontier) if self.kept and rows <= SMALL else frontier
        return f.join(self.df, f[at] == self.df[self.key])

    def done(self) -> None:
        if self.kept:
            self.df.unpersist()


def _counted(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write and count in one job."""
    seen = Observation()
    out, _ = scratch.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids reachable from ``seeds`` over ``edges`` (src, dst), and what comes with the seed.

    ``seeds`` has id and any further columns (a kind, say), which are carried along, so this is
    reachability per value of them. Semi-naive: each round joins only what is new, in one job that
    writes to the shared folder. It ends when nothing new turns up, however long the chains are;
    cycles end so too. Null ids and ends are left out; no seeds give an empty result.
    """
    scratch = Scratch(seeds.sparkSession, "closure")
    tags = [c for c in seeds.columns if c != "id"]
    seen, n = _counted(scratch, seeds.dropna(subset=["id"]).distinct(), "seen")
    e = Edges(scratch, edges.select("src", "dst").dropna().distinct(), "src")
    frontier = seen
    while n:
        # long chains of few rows are walked several steps a job
        level, step = frontier, None
        for _ in range(1 if n > FEW else HOPS):
            level = e.follow(level, "id", n).select(F.col("dst").alias("id"), *tags).distinct()
            step = level if step is None else step.unionByName(level)
        frontier, n = _counted(scratch, step.distinct().join(seen, ["id", *tags], "left_anti"), "round")
        seen = seen.unionByName(frontier) if n else seen
    e.done()
    return seen


def trails(starts: DataFrame, edges: DataFrame, max_hops: int, min_hops: int = 0) -> DataFrame:
    """Every walk of ``min_hops`` to ``max_hops`` edges from ``starts`` (id) that uses no edge
    twice: (ids, strategies, hops). ``edges`` has src, dst, strategy, one row per pair.

    Hop by hop self-joins; the number of walks is what the graph has, so cut hubs and edges first.
    """
    scratch = Scratch(starts.sparkSession, "trails")
    e = Edges(scratch, edges.select("src", "dst", F.coalesce("strategy", F.lit("")).alias("strategy")), "src")
    walk, n = _counted(scratch, starts.select(F.array("id").alias("ids"), F.array().cast("array<string>").alias("strategies"), F.col("id").alias("at")), "hop0")
    out = walk if min_hops <= 0 else walk.limit(0)
    for hop in range(1, max_hops + 1):
        if not n:
            break
        step = e.follow(walk, "at", n)
        # an edge is a pair of neighbours in the walk
        used = F.exists(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids")).alias("b")), lambda p: (p["a"] == F.col("src")) & (p["b"] == F.col("dst"))) if hop > 1 else F.lit(False)
        step = step.filter(~used).select(F.concat("ids", F.array("dst")).alias("ids"), F.concat("strategies", F.array("strategy")).alias("strategies"), F.col("dst").alias("at"))
        walk, n = _counted(scratch, step, f"hop{hop}")
        if hop >= min_hops:
            out = out.unionByName(walk)
    e.done()
    return out.select("ids", "strategies", (F.size("ids") - 1).alias("hops"))


def hubs(calls: DataFrame, least: int) -> DataFrame:
    """Called functions with at least ``least`` calls: (id, callers)."""
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers")).filter(F.col("callers") >= least)


#: Trust in a hop by how it was resolved.
TRUST = {
    "bytecode": 1.0, "receiver_type": 0.8, "receiver_type_inherited": 0.75, "same_scope": 0.7, "same_file": 0.65,
    "receiver_type_hint": 0.55, "imports_qualified": 0.55, "imports": 0.45, "name": 0.1,
}
_UNKNOWN, _NO_HOP = 0.3, 0.95


def hop_trust(strategy: Column) -> Column:
    """By the part before '+'; exact names first, then the longest that it starts with."""
    base = F.substring_index(strategy, "+", 1)
    out = F.lit(_UNKNOWN)
    for k in sorted(TRUST, key=len):
        out = F.when(F.startswith(base, F.lit(k)), F.lit(TRUST[k])).otherwise(out)
    for k in TRUST:
        out = F.when(base == k, F.lit(TRUST[k])).otherwise(out)
    return F.when(F.coalesce(strategy, F.lit("")) == "", F.lit(_UNKNOWN)).otherwise(out)


def path_score(strategies: Column, has_sanitizer: Column, hops: Column) -> Column:
    """The weakest hop counts; halved by a sanitizer, a tenth off beyond six hops."""
    weakest = F.array_min(F.transform(strategies, hop_trust))
    s = weakest * F.when(has_sanitizer, 0.5).otherwise(1.0) * F.when(hops > 6, 0.9).otherwise(1.0)
    return F.round(F.when(F.size(strategies) == 0, F.lit(_NO_HOP)).otherwise(s), 3)


def longest_per_ends(paths: DataFrame) -> DataFrame:
    """Of the paths with the same first and last node the longest, then the smallest by ids."""
    key = [F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last")]
    best = F.min_by(F.struct("ids", "strategies", "hops"), F.struct(-F.col("hops"), F.col("ids")))
    return paths.groupBy(*key).agg(best.alias("p")).select("first", "last", "p.ids", "p.strategies", "p.hops")


def neighbourhood(edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, other, depth) of everything called in up to ``hops`` steps; once per depth."""
    e = edges.select("src", "dst").distinct()
    level = e.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    out = level.withColumn("depth", F.lit(1))
    for d in range(2, hops + 1):
        level = level.join(e, level["other"] == e["src"]).select("id", F.col("dst").alias("other")).distinct()
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def ancestors(links: DataFrame) -> DataFrame:
    """(id, ancestor, depth), nearest depth each, over ``links`` (child, parent); cycle-safe, and
    complete whatever the depth."""
    scratch = Scratch(links.sparkSession, "ancestors")
    e = Edges(scratch, links.dropna().select("child", "parent").distinct(), "child")
    seen, n = _counted(scratch, e.df.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).filter("id <> ancestor"), "up")
    frontier, d = seen, 1
    while n:
        d += 1
        step = e.follow(frontier, "ancestor", n).select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).filter("id <> ancestor").distinct()
        frontier, n = _counted(scratch, step.join(seen, ["id", "ancestor"], "left_anti"), "up")
        seen = seen.unionByName(frontier) if n else seen
    e.done()
    return seen


def top(df: DataFrame, limit: int, *order: Column) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows by ``order`` and whether there were more: one row more is fetched
    to tell. ``order`` must decide ties."""
    more = df.orderBy(*order).limit(limit + 1)
    rows = more.count()
    return more.orderBy(*order).limit(limit), rows > limit
