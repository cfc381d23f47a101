"""The catalog of known methods: merged from a mined and a curated table, gated by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import calls as C

#: Fixed value: owners for which the curated entry replaces the mined one.
CURATED_WINS = ["java.sql.PreparedStatement"]


def merge(mined: DataFrame, curated: DataFrame) -> DataFrame:
    """One catalog of both (owner, role, category, method, positions), methods in lower case.

    An owner has one entry: the mined, its sinks before its sources, except for ``CURATED_WINS``;
    the curated where there is no mined one. Owners under javax are known under jakarta too, unless
    that owner has an entry of its own; such a pair counts as one ``entry``. Rows without owner or
    method are left out.
    """
    rank = F.when(F.col("from") == "curated", F.when(F.col("owner").isin(CURATED_WINS), 0).otherwise(3)).otherwise(F.when(F.col("role") == "sink", 1).otherwise(2))
    all_ = mined.withColumn("from", F.lit("mined")).unionByName(curated.withColumn("from", F.lit("curated"))).dropna(subset=["owner", "method"]).withColumn("rank", rank)
    own = all_.withColumn("best", F.min("rank").over(W.partitionBy("owner"))).filter("rank = best").withColumn("entry", F.col("owner"))
    alias = own.filter(F.startswith("owner", F.lit("javax."))).withColumn("owner", F.concat(F.lit("jakarta."), F.substring("owner", 7, 1 << 20)))
    alias = alias.join(own.select("owner").distinct(), "owner", "left_anti")
    cols = ["entry", "owner", "role", "category", F.lower("method").alias("method"), "positions"]
    return own.select(*cols).unionByName(alias.select(*cols)).dropDuplicates(["owner", "method"])


def enabled(category: Column, setting: str = "recommended") -> Column:
    """Is a category switched on? ``setting`` is off, all, recommended, or a list with commas."""
    low = setting.strip().lower()
    if low in ("", "off", "0", "false", "no"):
        return F.lit(False)
    if low == "all":
        return F.lit(True)
    if low == "recommended":
        return ~F.coalesce(category.isin(C.NOT_RECOMMENDED), F.lit(False))
    return F.coalesce(category.isin([p.strip() for p in setting.split(",") if p.strip()]), F.lit(False))


def classify_calls(calls: DataFrame, entries: DataFrame, setting: str = "recommended", include_other: bool = False) -> DataFrame:
    """``calls`` (owner, method, return_type, ...) with their ``kind``; null is no work of interest,
    or ``other`` if all external calls are wanted."""
    hit = C.lookup(calls, entries, ["role", "category", "positions"])
    known = F.when(enabled(F.col("category"), setting), C.role_kind(F.col("role"), F.col("category")))
    kind = C.classify(F.col("owner"), F.col("method"), F.col("return_type"), known)
    return hit.withColumn("kind", F.coalesce(kind, F.lit("other")) if include_other else kind)


def inert(entries: DataFrame, setting: str = "recommended") -> DataFrame:
    """Owners none of whose methods classifies, so that their entries never come to bear."""
    k = classify_calls(entries.select("owner", "method", F.lit("").alias("return_type")), entries, setting)
    return k.groupBy("owner").agg(F.bool_or(F.col("kind").isNotNull()).alias("live")).filter("not live").select("owner")


def in_repo_acquires(functions: DataFrame) -> DataFrame:
    """(src, id, name, fqn, kind): an external node for every function that returns a connection."""
    return functions.filter(C.is_connection(F.col("return_type"))).select(F.col("id").alias("src"), F.concat(F.lit("acq:"), F.col("fqn")).alias("id"), "name", "fqn", F.lit("db_acquire").alias("kind")).distinct()
