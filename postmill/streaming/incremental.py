"""Incremental deduplication of arriving batches against the state of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import new_state, sequential
from ..operators.sinks import append_ignoring
from ..schemas import STATE


def deduplicate_batches(stream: DataFrame, history_path: str, state_path: str, out_path: str, checkpoint: str):
    """Start a query that runs :func:`sequential` on every micro-batch and keeps the state in files.

    A batch that is run again after a failure writes the same rows to its own folder, and the
    appends ignore what is there already, so the outcome is that of one run.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        read = lambda path, schema: spark.read.schema(schema).option("ignoreMissingFiles", True).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
        history = read(history_path, batch.drop("ordinal", "job_fingerprint").schema)
        state = read(state_path, STATE)
        told = sequential(batch, history.join(batch.select("raw_id"), "raw_id", "left_anti"), state)
        told.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done = spark.read.parquet(f"{out_path}/batch={number}")
        append_ignoring(new_state(done, state), state_path, "fingerprint")
        append_ignoring(done.select(*history.columns), history_path, "raw_id")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def late_counts(stream: DataFrame, stamp: str, delay: str, window: str, key: str) -> DataFrame:
    """Counts by key and tumbling window; rows later than ``delay`` are left out."""
    return stream.withWatermark(stamp, delay).groupBy(F.window(stamp, window), key).agg(F.count("*").alias("n"))
