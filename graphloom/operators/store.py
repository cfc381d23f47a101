"""Property-graph tables kept by keyed upserts: last write wins, property by property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_value(col: str, order: Column) -> Column:
    """Last non-null value by ``order``; of equal orders the larger value."""
    return F.max(F.when(F.col(col).isNotNull(), F.struct(order.alias("o"), F.col(col).alias("v"))))["v"].alias(col)


def upsert(rows: DataFrame, keys: list[str], order: Column, properties: list[str]) -> DataFrame:
    """One row per key with the last written value of each property; null means not written.

    All properties are merged by one partial aggregate. Rows with a null key are left out.
    """
    return rows.dropna(subset=keys).groupBy(*keys).agg(*[last_value(p, order) for p in properties])


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` patched by ``new`` (one row per key each): new values win where they are set."""
    a, b = old.alias("a"), new.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cols = [F.coalesce(F.col(f"b.{c}") if c in new.columns else F.lit(None), F.col(f"a.{c}") if c in old.columns else F.lit(None)).alias(c) for c in dict.fromkeys([*old.columns, *new.columns])]
    return a.join(b, cond, "full_outer").select(*cols)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: pre-reduced in each task, nulls equal each other."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(best.alias("__r"))
    return out.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def with_endpoints(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends exist in ``ids`` (id)."""
    a = ids.select(F.col("id").alias("src")).distinct()
    b = ids.select(F.col("id").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with a destination that is null or nowhere."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, repo: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of ``files`` (file) of a repository."""
    gone = nodes.filter(F.col("repo") == repo).join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    keep = nodes.join(gone, "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return keep, kept


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relpath, change) of added, changed and deleted files; both sides hold (relpath, sha)."""
    j = old.select("relpath", F.col("sha").alias("a"), F.lit(True).alias("in_a")).join(new.select("relpath", F.col("sha").alias("b"), F.lit(True).alias("in_b")), "relpath", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("relpath", change.alias("change")).filter("change is not null")


def set_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent fingerprint: the sum of the rows' MD5 numbers modulo 2**128, as 32 hex
    digits, and the number of rows. Nulls count as empty."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    limb = lambda i: F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    s = rows.select(digest.alias("d")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(limb(i), F.lit(0).cast("decimal(30,0)")).alias(f"l{i}") for i in range(4)])
    base = F.lit(2**32).cast("decimal(20,0)")
    carry, parts = F.lit(0).cast("decimal(30,0)"), []
    for i in (3, 2, 1, 0):
        total = F.col(f"l{i}").cast("decimal(30,0)") + carry
        parts.insert(0, F.lpad(F.lower(F.hex((total % base).cast("long"))), 8, "0"))
        carry = F.floor(total / base).cast("decimal(30,0)")
    return s.select("n_rows", F.concat(*parts).alias("hash"))


def chunked(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Numbers the rows of each group in batches of ``size``, and their places in the group."""
    at = rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    return at.withColumn("batch", F.floor(F.col("place") / size).cast("int"))
