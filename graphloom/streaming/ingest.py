"""Incremental ingest as a stream: new file rows are merged into the latest state per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.store import upsert


def ingest_files(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Merge Parquet files that appear in ``incoming`` (file_info rows) into versions of ``table``,
    one folder per batch, keyed by (repo, relpath); a batch repeated after a failure overwrites its
    own folder, so nothing is doubled. Runs until all that is there is taken up."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        rows = batch
        if batch_id:
            rows = s.read.schema(batch.schema).parquet(f"{table}/v{batch_id - 1}").unionByName(batch)
        rest = [c for c in batch.columns if c not in ("repo", "relpath")]
        upsert(rows, ["repo", "relpath"], F.col("file_id"), rest).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v{batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
