"""Session helpers: the shared folder, written cuts of lineage, and sizes of partitions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset and the session runs on
    one machine, as in tests, a local folder is made; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def files_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of the files at ``path``: the state of an input."""
    fs, p = hadoop(spark, path)
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; a missing one is no error."""
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


class Scratch:
    """Written intermediate tables under the shared folder.

    A table written there cuts the lineage and survives the loss of executors. ``drop`` deletes the
    tables no longer needed; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the gateway may have gone first
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)

    def write(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
        """Write ``df`` as Parquet and give it back as a scan, with its path."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for p in paths:
            remove(self.spark, p)


def cores(spark: SparkSession) -> int:
    """Task slots; before executors register this is the configured default parallelism."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Give a scan enough tasks for work in Python.

    A table of few files or row groups comes in few tasks. Only where that leaves at least half of
    the cores idle the rows are dealt out evenly, which moves them once.
    """
    if df.rdd.getNumPartitions() * 2 > cores(spark):
        return df
    return df.repartition(3 * cores(spark))


def local_session(n: int | str = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
