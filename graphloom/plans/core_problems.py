"""Queries of the general data operators: hierarchies (3), incremental runs (5), heavy keys (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import balance, hierarchy
from graphloom.session import Scratch
from graphloom.streaming import incremental


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tree_links(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "edges").filter(F.col("type").isin("CONTAINS", "EXTENDS"))
    down = F.col("type") == "CONTAINS"
    return hierarchy.parent_links(e, "type", F.when(down, F.col("dst")).otherwise(F.col("src")), F.when(down, F.col("src")).otherwise(F.col("dst")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    n = hierarchy.contract(_tree_links(spark, d)).nodes
    return n.select(F.col("tree").alias("type"), "id", "root_id", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its path from the root; loop members and what hangs on them have none."""
    n = hierarchy.contract(_tree_links(spark, d), with_paths=True).nodes
    return n.select(F.col("tree").alias("type"), "id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """For every node that has any: how many descendants, and how deep they go."""
    n = hierarchy.contract(_tree_links(spark, d), with_paths=True).nodes
    pairs = hierarchy.descendants(n)
    return pairs.groupBy(F.col("tree").alias("type"), F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").cast("int").alias("height"))


def p3_loops(spark: SparkSession, d: str) -> DataFrame:
    """Per loop (smallest id on it): the nodes whose way up ends in it."""
    n = hierarchy.contract(_tree_links(spark, d)).nodes.filter("depth < 0")
    return n.groupBy(F.col("tree").alias("type"), F.col("root_id").alias("loop_id")).agg(F.count(F.lit(1)).alias("n_nodes"))


def _runs(spark: SparkSession, d: str) -> list[incremental.Run]:
    rows = _table(spark, d, "run_index").filter("scan_seq is not null").select("run_no", "scan_seq", "schema_version", "error", "finished_at").collect()  # one row per run
    return [incremental.Run(r["run_no"], r["scan_seq"], r["schema_version"], r["error"] is not None or r["finished_at"] is None) for r in rows]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "function_log").select("write_seq", "op", "id", "body_hash", "summary_hash", "sig_schema_version")
    return incremental.take_up(log, _runs(spark, d), Scratch(spark, "feed").root)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "edges")
    return balance.heavy_keys(e, ["type", "dst"], "dst", 0.01).select("type", "dst")


def p7_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct sources of every (type, dst), heavy or not."""
    return balance.summarize(_table(spark, d, "edges"), ["type", "dst"], distinct="src")


def p7_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Links per label of what they point at: the skewed side joined without one task per key."""
    label = _table(spark, d, "nodes").groupBy(F.col("id").alias("dst")).agg(F.max("label").alias("label"))
    e = _table(spark, d, "edges").select("type", "dst")
    j = balance.balanced_join(e, label, ["dst"], "left")
    return j.groupBy("type", F.coalesce("label", F.lit("(none)")).alias("label")).agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES = {
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_loops": p3_loops,
    "p5_found": p5_found, "p7_found": p7_found, "p7_per_key": p7_per_key, "p7_labelled": p7_labelled,
}

_UP = """links as (
  select distinct type, case when type = 'CONTAINS' then dst else src end as id, case when type = 'CONTAINS' then src else dst end as par
  from edges where type in ('CONTAINS', 'EXTENDS') and src is not null and dst is not null),
up as (
  select type, id, par as top, 1 as depth, [id, par] as path, false as looped from links
  union all
  select up.type, up.id, links.par, depth + 1, list_append(path, links.par), list_contains(path, links.par)
  from up join links on links.type = up.type and links.id = up.top where not looped),
ends as (select type, id, max(depth) as depth, max_by(top, depth) as top, max_by(path, depth) as path, bool_or(looped) as looped from up group by type, id),
found as (
  select type, id, case when looped then list_min(path[list_position(path, top):]) else top end as root_id,
    cast(case when looped then -1 else depth end as integer) as depth, case when looped then null else array_to_string(list_reverse(path), '/') end as path
  from ends)"""

SQL = {
    "p3_found": f"with recursive {_UP} select type, id, root_id, depth from found",
    "p3_paths": f"with recursive {_UP} select type, id, root_id, depth, path from found",
    "p3_descendants": f"with recursive {_UP} select u.type, u.top as id, count(*) as n_descendants, cast(max(u.depth) as integer) as height from up u join found f on f.type = u.type and f.id = u.id where f.depth >= 0 group by u.type, u.top",
    "p3_loops": f"with recursive {_UP} select type, root_id as loop_id, count(*) as n_nodes from found where depth < 0 group by type, root_id",
    "p5_found": """with runs as (select run_no, scan_seq, schema_version from run_index where scan_seq is not null),
writes as (select distinct write_seq, op, id, nullif(body_hash, '') as body, nullif(summary_hash, '') as summary, sig_schema_version as version from function_log),
seen as (select run_no, schema_version, writes.* from runs join writes on write_seq <= scan_seq),
ends as (select run_no, id, max(write_seq) filter (where op = 'delete') as deleted from seen group by run_no, id),
states as (
  select s.run_no, s.id, any_value(schema_version) as wanted, max_by(body, write_seq) filter (where body is not null) as body,
    max_by(summary, write_seq) filter (where summary is not null) as summary, max_by(version, write_seq) filter (where version is not null) as version
  from seen s join ends e on e.run_no = s.run_no and e.id = s.id where write_seq > coalesce(deleted, -1) group by s.run_no, s.id)
select run_no, id from states where body is not null and (summary is null or summary <> body or coalesce(version, 0) < wanted)""",
    "p7_found": "select type, dst from edges where dst is not null group by type, dst having count(*) * 100 >= (select count(*) from edges)",
    "p7_per_key": "select type, dst, count(*) as n_rows, count(distinct src) as n_distinct from edges group by type, dst",
    "p7_labelled": "select type, coalesce(label, '(none)') as label, count(*) as n_edges from edges left join (select id, max(label) as label from nodes group by id) n on n.id = edges.dst group by 1, 2",
}
