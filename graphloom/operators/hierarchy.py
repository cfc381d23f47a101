"""Parent links to full hierarchies by parallel tree contraction.

Each round rakes all leaves and splices an independent set out of the unary chains, so a forest
of n nodes is gone after O(log n) rounds whatever its depth. What a round removes is recorded with
the link it had at that time; the records are then undone in reverse, which gives every node the
root and depth (and path) of the node it hung on. What contraction can't remove is a cycle: it
shrinks to a node that is its own parent. Every round works on tables written to the shared
folder; a node with very many children only ever appears as a pre-aggregated count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.session import Scratch

MAX_ROUNDS = 400


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: tree, id, root_id, depth, parent_id and, if asked for, path (root first)."""

    nodes: DataFrame
    rounds: int


def parent_links(df: DataFrame, tree: str, child: str | Column, parent: str | Column) -> DataFrame:
    """Distinct (tree, id, par) without null ends. A child given several parents in one tree keeps
    the smallest; ``conflicts`` lists such children."""
    c = F.col(child) if isinstance(child, str) else child
    p = F.col(parent) if isinstance(parent, str) else parent
    links = df.select(F.col(tree).alias("tree"), c.alias("id"), p.alias("par")).dropna(subset=["id", "par"])
    return links.groupBy("tree", "id").agg(F.min("par").alias("par"))


def conflicts(df: DataFrame, tree: str, child: str | Column, parent: str | Column) -> DataFrame:
    """Children with more than one distinct parent in a tree, and how many they have."""
    c = F.col(child) if isinstance(child, str) else child
    p = F.col(parent) if isinstance(parent, str) else parent
    links = df.select(F.col(tree).alias("tree"), c.alias("id"), p.alias("par")).dropna(subset=["id", "par"])
    n = links.groupBy("tree", "id").agg(F.min("par").alias("lo"), F.max("par").alias("hi"), F.count_distinct("par").alias("n_parents"))
    return n.filter(F.col("lo") != F.col("hi")).select("tree", "id", "n_parents")


def _coin(col: str, round_no: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col), F.lit(round_no)), F.lit(2)) == 1


def contract(links: DataFrame, with_paths: bool = False, scratch: Scratch | None = None) -> Hierarchy:
    """Roots and depths of every node of ``links`` (tree, id, par; one row per tree and id).

    A node whose way up never ends gets depth -1 and, as root_id, the smallest id on the loop;
    with paths, its path is null. Roots themselves get no row. An empty input gives an empty result.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark, "hierarchy")
    seg = [F.array().cast(f"array<{links.schema['id'].dataType.simpleString()}>").alias("seg")] if with_paths else []
    # w: links between id and par; low: smallest id spliced out between them; seg: those ids, upwards
    live, _ = scratch.write(links.select("tree", "id", "par", F.col("par").alias("parent_id"), F.lit(1).alias("w"), F.col("id").alias("low"), *seg), "links")
    records: list[DataFrame] = []
    cores: list[DataFrame] = []
    cols = live.columns
    rounds = 0
    while True:
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"tree contraction didn't end after {MAX_ROUNDS} rounds")
        # a node that is its own parent is what is left of a loop
        core = live.filter(F.col("id") == F.col("par"))
        rest = live.filter(F.col("id") != F.col("par"))
        kids = rest.groupBy("tree", F.col("par").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min("id").alias("only"))
        state = rest.join(kids, ["tree", "id"], "left").withColumn("spliced", F.coalesce((F.col("kids") == 1) & _coin("id", rounds) & ~_coin("par", rounds), F.lit(False)))
        extra = ["kids", "only", "spliced"]
        marked = core.select(*cols, F.lit(None).cast("long").alias("kids"), F.lit(None).cast(links.schema["id"].dataType).alias("only"), F.lit(False).alias("spliced")).unionByName(state.select(*cols, *extra))
        # a spliced node has one child, so its link goes to that child by id: no parent is a join key
        up = marked.filter("spliced").select("tree", F.col("only").alias("id"), F.col("par").alias("up_par"), F.col("w").alias("up_w"), F.col("low").alias("up_low"), *([F.col("seg").alias("up_seg")] if with_paths else []))
        joined = marked.filter(~F.col("spliced")).join(up, ["tree", "id"], "left")
        hit = F.col("up_par").isNotNull()
        moved = joined.select(
            "tree", "id", F.coalesce("up_par", "par").alias("par"), "parent_id",
            F.when(hit, F.col("w") + F.col("up_w")).otherwise(F.col("w")).alias("w"),
            F.when(hit, F.least("low", "up_low")).otherwise(F.col("low")).alias("low"),
            *([F.when(hit, F.concat("seg", F.array("par"), "up_seg")).otherwise(F.col("seg")).alias("seg")] if with_paths else []),
            F.when(F.col("id") == F.col("par"), 2).when(F.col("kids").isNull(), 1).otherwise(0).alias("gone"),
        )
        spliced = marked.filter("spliced").select(*cols, F.lit(1).alias("gone"))
        seen = Observation()
        step = moved.select(*cols, "gone").unionByName(spliced).observe(seen, *[F.count_if(F.col("gone") == g).alias(f"n{g}") for g in range(3)])
        step, _ = scratch.write(step, f"step{rounds}")
        counts = {g: seen.get[f"n{g}"] for g in range(3)}
        if counts.get(1):
            records.append(step.filter("gone = 1").drop("gone"))
        if counts.get(2):
            cores.append(step.filter("gone = 2").drop("gone"))
        live = step.filter("gone = 0").drop("gone")
        if not counts.get(0):
            break

    path = [F.lit(None).cast(f"array<{links.schema['id'].dataType.simpleString()}>").alias("path")] if with_paths else []
    done: DataFrame | None = None
    for c in cores:
        row = c.select("tree", "id", F.col("low").alias("root_id"), F.lit(-1).alias("depth"), "parent_id", *path)
        done = row if done is None else done.unionByName(row)
    for r in reversed(records):
        if done is None:
            out = r.select("tree", "id", F.col("par").alias("root_id"), F.col("w").alias("depth"), "parent_id", *([F.concat(F.array("par"), F.reverse("seg"), F.array("id")).alias("path")] if with_paths else []))
        else:
            above = done.select("tree", F.col("id").alias("par"), F.col("root_id").alias("up_root"), F.col("depth").alias("up_depth"), *([F.col("path").alias("up_path")] if with_paths else []))
            j = r.join(above, ["tree", "par"], "left")
            loose = F.col("up_root").isNull()
            out = j.select(
                "tree", "id", F.coalesce("up_root", "par").alias("root_id"),
                F.when(loose, F.col("w")).when(F.col("up_depth") < 0, F.lit(-1)).otherwise(F.col("up_depth") + F.col("w")).alias("depth"), "parent_id",
                *([F.concat(F.when(loose, F.array("par")).otherwise(F.col("up_path")), F.reverse("seg"), F.array("id")).alias("path")] if with_paths else []),
            )
        part, _ = scratch.write(out, "done")
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = live.select("tree", "id", F.col("par").alias("root_id"), F.col("w").alias("depth"), "parent_id", *path)
    return Hierarchy(done, rounds)


def descendants(nodes: DataFrame) -> DataFrame:
    """(tree, ancestor_id, id, distance) for every node and each of its ancestors, the root
    included; from the paths of ``contract(..., with_paths=True)``. Members and followers of loops
    have no path and so no rows."""
    n = nodes.filter(F.col("path").isNotNull()).select("tree", "id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"), "depth")
    return n.select("tree", "ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))
