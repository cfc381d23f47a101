"""Per-key work without stragglers: fragment and replicate by load.

Keys are given a load (their number of rows, counted with map-side combining). Whole keys are
packed into tasks, largest first; a key whose load is beyond a task's share is split into shards
in proportion to its load. The other side of a join is copied only to the shards of split keys.
The plan of a run is small whatever the data: the keys worth splitting are at most
``tasks * split_factor`` (each holds at least one part in so many of all rows), all others are
placed by the hash bucket they fall into, 16 buckets a task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets for each task, and at least.
PER_TASK, BUCKETS = 16, 1024
_ID = "__task"
_SHARD = "__shard"
_SHARDS = "__shards"
_BUCKET = "__bucket"
_HOT = "__hot"


@dataclass(frozen=True)
class Placement:
    """Where rows go: ``bucket_task`` by hash bucket, ``hot`` = (key values, [task of each shard])."""

    tasks: int
    total: int
    bucket_task: tuple[int, ...]
    hot: tuple[tuple[tuple, tuple[int, ...]], ...]

    def loads(self, bucket_rows: dict[int, int], hot_rows: dict[tuple, int]) -> list[int]:
        """Rows per task under this placement."""
        out = [0] * self.tasks
        for b, n in bucket_rows.items():
            out[self.bucket_task[b]] += n
        for key, at in self.hot:
            for t in at:
                out[t] += ceil(hot_rows[key] / len(at))
        return out


def slots(spark: SparkSession) -> int:
    """Tasks to pack keys into."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_loads(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, null keys included; one partial aggregate per task before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def place(df: DataFrame, keys: list[str], tasks: int, split_factor: int = 2, buckets: int | None = None) -> tuple[Placement, dict[int, int], dict[tuple, int]]:
    """Pack keys and buckets of keys into ``tasks`` by load.

    A key with more than ``total / (tasks * split_factor)`` rows gets one shard for each such
    share. What reaches the driver is at most ``buckets`` numbers and ``tasks * split_factor`` keys.
    The loads are counted in one pass; the total comes from the row counts of the scan.
    """
    buckets = buckets or max(BUCKETS, PER_TASK * tasks)
    total = df.count()
    share = max(1, ceil(total / max(1, tasks * split_factor)))
    is_hot = F.col("n_rows") > share
    per = key_loads(df, keys).groupBy(bucket_of(keys, buckets).alias("b"))
    hot_rows, bucket_rows = {}, {}
    for r in per.agg(F.sum(F.when(~is_hot, F.col("n_rows"))).alias("n"), F.collect_list(F.when(is_hot, F.struct(*keys, "n_rows"))).alias("hot")).collect():
        if r["n"]:
            bucket_rows[r["b"]] = r["n"]
        for h in r["hot"]:
            hot_rows[tuple(h[k] for k in keys)] = h["n_rows"]

    units: list[tuple[float, int, object]] = [(n, 0, b) for b, n in bucket_rows.items()]
    for key, n in hot_rows.items():
        shards = ceil(n / share)
        units += [(n / shards, 1, (key, i)) for i in range(shards)]
    units.sort(key=lambda u: (-u[0], u[1], repr(u[2])))
    heap = [(0.0, t) for t in range(tasks)]
    bucket_task = [b % tasks for b in range(buckets)]
    hot_at: dict[tuple, dict[int, int]] = {k: {} for k in hot_rows}
    for load, kind, what in units:
        have, t = heapq.heappop(heap)
        heapq.heappush(heap, (have + load, t))
        if kind:
            hot_at[what[0]][what[1]] = t
        else:
            bucket_task[what] = t
    hot = tuple((k, tuple(at[i] for i in range(len(at)))) for k, at in sorted(hot_at.items(), key=lambda x: repr(x[0])))
    return Placement(tasks, total, tuple(bucket_task), hot), bucket_rows, hot_rows


def _hot_table(spark: SparkSession, df: DataFrame, keys: list[str], p: Placement) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField(_HOT, T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(*k, list(at)) for k, at in p.hot], schema)


def _with_hot(df: DataFrame, keys: list[str], p: Placement) -> DataFrame:
    """``df`` with the task list of each split key, null for the others. The table is bounded (see ``place``)."""
    hot = _hot_table(df.sparkSession, df, keys, p)
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(hot[f"__k{i}"])
        cond = c if cond is None else cond & c
    return df.join(F.broadcast(hot), cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _bucket_task(keys: list[str], p: Placement) -> Column:
    tasks = F.array(*[F.lit(t) for t in p.bucket_task]) if len(p.bucket_task) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, p.bucket_task)) + "]"), "array<int>")
    return F.get(tasks, bucket_of(keys, len(p.bucket_task)))


def scatter(df: DataFrame, keys: list[str], p: Placement, shard_by: list[str] | None = None) -> DataFrame:
    """Send each row to its task. Rows of a split key are dealt to its shards by the hash of
    ``shard_by`` (by default of all columns, equal rows then stay together)."""
    cols = shard_by if shard_by is not None else [c for c in df.columns]
    d = _with_hot(df, keys, p)
    pick = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.size(_HOT)).cast("int")
    d = d.withColumn(_SHARD, F.when(F.col(_HOT).isNull(), F.lit(0)).otherwise(pick))
    d = d.withColumn(_ID, F.when(F.col(_HOT).isNull(), _bucket_task(keys, p)).otherwise(F.get(_HOT, F.col(_SHARD))))
    return d.drop(_HOT).repartitionById(p.tasks, F.col(_ID))


def replicate(df: DataFrame, keys: list[str], p: Placement) -> DataFrame:
    """The matching side: rows of split keys are copied to each shard, all others go to one task."""
    d = _with_hot(df, keys, p)
    d = d.withColumn(_SHARD, F.explode(F.when(F.col(_HOT).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(_HOT) - 1))))
    d = d.withColumn(_ID, F.when(F.col(_HOT).isNull(), _bucket_task(keys, p)).otherwise(F.get(_HOT, F.col(_SHARD))))
    return d.drop(_HOT)


def _summaries(df: DataFrame, keys: list[str], distinct: str | None, tasks: int | None, split_factor: int) -> tuple[DataFrame, int]:
    tasks = tasks or slots(df.sparkSession)
    need = df.select(*keys, *([distinct] if distinct and distinct not in keys else []))
    p, _, _ = place(need, keys, tasks, split_factor)
    if distinct is None:
        # equal keys are combined in each task before they are sent; a split key's parts go to its shards
        pre = need.groupBy(*keys, F.spark_partition_id().alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        at = scatter(pre, keys, p, ["__part"])
        n_distinct = []
    else:
        pre = need.groupBy(*dict.fromkeys([*keys, distinct])).agg(F.count(F.lit(1)).alias("__n"))
        at = scatter(pre, keys, p, [distinct])
        n_distinct = [F.count(distinct).alias("n_distinct")]
    part = at.groupBy(_ID, _SHARD, *keys).agg(F.sum("__n").alias("n_rows"), *n_distinct)
    return part.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *([F.sum("n_distinct").alias("n_distinct")] if distinct else [])), p.total


def summarize(df: DataFrame, keys: list[str], distinct: str | None = None, tasks: int | None = None, split_factor: int = 2) -> DataFrame:
    """One row per key: ``n_rows``, and with ``distinct`` the exact number of its distinct non-null
    values as ``n_distinct``.

    Distinct counting needs every row of a key; a split key's rows are dealt to its shards by the
    hash of the counted column, so the shards' counts add up. Null keys form a group of their own.
    An empty input gives an empty result. Names with two leading underscores are reserved.
    """
    return _summaries(df, keys, distinct, tasks, split_factor)[0]


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", tasks: int | None = None, split_factor: int = 2) -> DataFrame:
    """Join on ``keys`` (same names on both sides), the large and skewed side on the left.

    ``how`` is inner, left or left_semi/left_anti; null keys match nothing, as in SQL, and rows
    with them are spread over the tasks for a left or anti join by their own hash bucket.
    Other columns of the right side that clash with the left get the suffix ``_right``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    tasks = tasks or slots(left.sparkSession)
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed(clash)
    p, _, _ = place(left.select(*keys), keys, tasks, split_factor)
    a = scatter(left, keys, p)
    b = replicate(right.dropna(subset=keys), keys, p).repartitionById(p.tasks, F.col(_ID))
    return a.join(b, [*keys, _SHARD, _ID], how).drop(_SHARD, _ID)


def heavy_keys(df: DataFrame, keys: list[str], not_null: str, least_share: float, distinct: str | None = None, tasks: int | None = None, split_factor: int = 2) -> DataFrame:
    """Keys holding at least ``least_share`` of all rows (null keys count in the total only)."""
    per, total = _summaries(df, keys, distinct, tasks, split_factor)
    return per.filter(F.col(not_null).isNotNull() & (F.col("n_rows") >= F.lit(total) * F.lit(least_share)))
