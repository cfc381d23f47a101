"""Runs that take up only what is new or changed, and survive failed runs.

The function log is a versioned table: every load of rows is a version, named by a manifest. A run
takes the difference between the manifests of the version that the last successful run saw and of
its own: rows of added files, and rows removed with their files or hidden by deletion vectors. It
folds the added rows per function (with partial aggregates, so one busy function is no problem);
functions that lost rows are folded again from the version's own rows. The old state rows of the
touched functions are hidden by a deletion vector and the new ones added. What a run has to do is
carried the same way: the picks of the version before, less the touched functions, plus those
touched functions that need work; only a new schema version looks at all functions again. State,
picks and the number of the log version come in one commit. A run that fails before it leaves files
that no manifest names, so the next one, in this session or another, starts from the same version:
nothing is skipped and nothing done twice. A row that arrives late, with an older number than rows
already seen, is in an added file and is taken up as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import Scratch
from graphloom.streaming.versioned import VersionedTable

_STAMPED = [("body", "body_hash", "string"), ("summary", "summary_hash", "string"), ("schema", "sig_schema_version", "int")]

LOG = T.StructType([T.StructField("write_seq", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("op", "id", "body_hash", "summary_hash")] + [T.StructField("sig_schema_version", T.IntegerType())])
STATE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("deleted_at", T.LongType())]
    + [f for name, _, kind in _STAMPED for f in (T.StructField(f"{name}_at", T.LongType()), T.StructField(name, T.IntegerType() if kind == "int" else T.StringType()))]
)
PICKS = T.StructType([T.StructField("id", T.StringType())])


def _last(name: str, value: Column, at: Column) -> list[Column]:
    """The value written last and its stamp; of equal stamps the larger value."""
    pair = F.max(F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("v"))))
    return [pair["at"].alias(f"{name}_at"), pair["v"].alias(name)]


def fold_log(log: DataFrame) -> DataFrame:
    """Log rows to one ``STATE`` row per function. Null and empty properties were not written;
    rows without an id are left out; repeated rows change nothing."""
    at = F.col("write_seq")
    written = F.col("op") != "delete"
    cols: list[Column] = [F.max(F.when(F.col("op") == "delete", at)).alias("deleted_at")]
    for name, column, kind in _STAMPED:
        value = F.when(written, F.nullif(F.col(column), F.lit("")) if kind == "string" else F.col(column))
        cols += _last(name, value, at)
    return log.filter(F.col("id").isNotNull() & at.isNotNull() & F.col("op").isNotNull()).groupBy("id").agg(*cols)


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both inputs hold at most one row per function."""
    both = old.select(*STATE.names).unionByName(new.select(*STATE.names))
    cols: list[Column] = [F.max("deleted_at").alias("deleted_at")]
    for name, _, _ in _STAMPED:
        cols += _last(name, F.col(name), F.col(f"{name}_at"))
    return both.groupBy("id").agg(*cols)


def needs_work(schema_version: int) -> Column:
    """On ``STATE`` rows: there is a body, and its summary is missing, of another body, or of an older schema."""

    def live(name: str) -> Column:
        return F.when(F.col("deleted_at").isNull() | (F.col(f"{name}_at") > F.col("deleted_at")), F.col(name))

    body, summary, schema = live("body"), live("summary"), live("schema")
    return body.isNotNull() & (~body.eqNullSafe(summary) | (F.coalesce(schema, F.lit(0)) < F.lit(schema_version)))


@dataclass
class Run:
    run_no: int
    scan_seq: int
    schema_version: int
    failed: bool


class ChangeFeed:
    """Log, state and picks under one folder, which outlives the session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.log = VersionedTable(spark, f"{root}/log", LOG)
        self.state = VersionedTable(spark, f"{root}/state", STATE)
        self.picks = VersionedTable(spark, f"{root}/picks", PICKS)

    def append(self, rows: DataFrame) -> int:
        """Add log rows as a new version."""
        return self.log.commit(self.log.latest(), add=[self.log.stage(rows)])

    def load(self, rows: DataFrame, marks: list[int]) -> list[int]:
        """Add log rows as one version for each mark (rising ``write_seq``, inclusive), and one more
        for what lies beyond the last. One pass over the rows. Gives the version of each mark."""
        part = F.lit(len(marks))
        for i in reversed(range(len(marks))):
            part = F.when(F.col("write_seq") <= marks[i], F.lit(i)).otherwise(part)
        versions = []
        for folder in self.log.stage_split(rows, part, len(marks) + 1):
            versions.append(self.log.commit(self.log.latest(), add=[folder]))
        return versions[:-1]

    def process(self, run: Run, version: int | None = None) -> DataFrame:
        """What ``run`` has to do about the log as of ``version`` (by default the latest), as ids;
        commits unless the run failed."""
        until = self.log.latest() if version is None else version
        base = self.picks.latest()
        done = self.picks.manifest(base)["properties"]
        since, files = done.get("log_version", 0), done.get("state", {})
        scratch = Scratch(self.spark, "run")
        changes = self.log.changes(since, until)
        added = changes.filter("_change = 'insert'")
        if self.log.removes(since, until):
            lost, _ = scratch.write(changes.filter("_change = 'delete'").select("id").dropna().distinct(), "lost")
            again = fold_log(self.log.read(until).join(lost, "id", "left_semi"))
            # a function of which nothing is left keeps a row without properties, which hides its old state
            nothing = lost.join(again.select("id"), "id", "left_anti")
            again = again.unionByName(nothing, allowMissingColumns=True)
            delta, _ = scratch.write(fold_log(added.join(lost, "id", "left_anti")).withColumn("__whole", F.lit(False)).unionByName(again.withColumn("__whole", F.lit(True))), "delta")
        else:
            delta, _ = scratch.write(fold_log(added).withColumn("__whole", F.lit(False)), "delta")
        ids = delta.select("id")
        if not files:
            touched, vector = delta.drop("__whole"), None
        else:
            old, _ = scratch.write(self.state._live(files).join(ids, "id", "left_semi"), "old")
            base_rows = old.join(delta.filter("__whole").select("id"), "id", "left_anti") if self.log.removes(since, until) else old
            touched, _ = scratch.write(merge_states(base_rows, delta.drop("__whole")), "touched")
            vector = self.state.stage_vector(old)
        # everything is staged first and named by the one manifest at the end
        state = {f: [*dv, *([vector] if vector else [])] for f, dv in files.items()} | {self.state.stage(touched): []}
        if done.get("schema_version") != run.schema_version:
            todo = self.state._live(state).filter(needs_work(run.schema_version)).select("id")
        else:
            kept = self.picks.read(base).join(ids, "id", "left_anti")
            todo = touched.filter(needs_work(run.schema_version)).select("id").unionByName(kept)
        folder = self.picks.stage(todo)
        if not run.failed:
            self.picks.commit_files(base, {folder: []}, {"state": state, "log_version": until, "schema_version": run.schema_version, "run_no": run.run_no})
        scratch.drop(scratch.root)
        return self.spark.read.schema(PICKS).parquet(f"{self.picks.path}/{folder}")


def take_up(log: DataFrame, runs: list[Run], root: str) -> DataFrame:
    """(run_no, id) for each run in turn, of a log not loaded before. An empty list of runs gives an
    empty result. Rows without an id or a number are left out; rows delivered twice change nothing."""
    spark = log.sparkSession
    feed = ChangeFeed(spark, root)
    if not runs:
        return spark.createDataFrame([], "run_no int, id string")
    marks = sorted({r.scan_seq for r in runs})
    at = dict(zip(marks, feed.load(log, marks), strict=True))
    out: DataFrame | None = None
    for run in sorted(runs, key=lambda r: (r.scan_seq, r.run_no)):
        part = feed.process(run, at[run.scan_seq]).select(F.lit(run.run_no).cast("int").alias("run_no"), "id")
        out = part if out is None else out.unionByName(part)
    return out
