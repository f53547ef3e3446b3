"""Batches that arrive one after the other are deduplicated against what came before."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postmill.streaming.first_writer import RESULT, first_writers, recorded
from postmill.streaming.incremental import deduplicate_batches, late_counts

SCHEMA = "raw_id string, run_id string, source_name string, source_job_id string, source_url string, job_fingerprint string, collected_at string, ordinal bigint"


def test_incremental_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a1", "r1", "s", None, "u1", "f1", "t", 1), ("a2", "r1", "s", None, "u2", "f1", "t", 2), ("a3", "r1", "s", "j1", "u3", "f3", "t", 3)],
        [("b1", "r2", "s", None, "u9", "f1", "t", 1), ("b2", "r2", "s", None, "u3", "f7", "t", 2), ("b3", "r2", "s", "j1", "u8", "f8", "t", 3), ("b4", "r2", "s", None, "u7", "f9", "t", 4)],
    ]
    told = {}
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = deduplicate_batches(stream, str(tmp_path / "history"), str(tmp_path / "state"), out, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = {r.raw_id: (r.is_duplicate, r.duplicate_of_job_id) for r in spark.read.parquet(out).collect()}
    assert told == {"a1": (False, None), "a2": (True, "a1"), "a3": (False, None), "b1": (True, "a1"), "b2": (True, "a3"), "b3": (True, None), "b4": (False, None)}
    assert {r.fingerprint for r in spark.read.parquet(str(tmp_path / "state")).collect()} == {"f1", "f3", "f9"}


def test_late_counts(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:00:10' as ts, 'a' as k union all select timestamp'2026-01-01 00:01:10', 'a'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    query = late_counts(stream, "ts", "1 minute", "1 minute", "k").writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("late").select(F.col("n")).collect()) == [1, 1]


WRITES = "job_fingerprint string, raw_id string, ordinal bigint, source_name string, collected_at string, extra int"


def plain_first_writers(batches, state=()):
    first, out = dict(state), set()
    for rows in batches:
        for fp, raw, _, source, at, _ in sorted((r for r in rows if r[0]), key=lambda r: (r[2], r[1])):
            first.setdefault(fp, raw)
            out.add((fp, raw, raw != first[fp], None if raw == first[fp] else first[fp], source, at))
    return out


def test_first_writers_go_on_after_a_stop(spark, tmp_path):
    """Each batch is a run of its own over one checkpoint, the last one fails once; rows of a common fingerprint wait in the state store."""
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    state = [("old", "z9"), ("f3", "z8")]
    batches = [
        [("hot", f"a{i:02d}", 100 - i, "s", "t1", 0) for i in range(40)] + [("f1", "a98", 2, "s", "t1", 0), ("f1", "a99", 1, "s", "t1", 0), ("old", "a97", 1, "s", "t1", 0), (None, "a96", 1, "s", "t1", 0), ("", "a95", 1, "s", "t1", 0)],
        [("hot", "b0", -5, "s", "t2", 0), ("f1", "a99", 1, "s", "t2", 0), ("f2", "b2", 3, None, None, 0), ("f3", "b3", 1, "s", "t2", 0)],
        [("f2", "c0", 0, "s", "t3", 0), ("f4", "c1", 0, "s", "t3", 0)],
    ]
    known = spark.createDataFrame([(fp, raw, "s", "t0") for fp, raw in state], "fingerprint string, first_raw_id string, source_name string, recorded_at string")

    def run(fail=False):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail:
                raise RuntimeError("lost")

        stream = spark.readStream.schema(WRITES).parquet(source)
        first_writers(stream, known).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, WRITES).coalesce(1).write.mode("append").parquet(source)
            if i == 2:
                with pytest.raises(StreamingQueryException):
                    run(fail=True)
            run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    told = spark.read.parquet(out)
    columns = [c.split()[0] for c in RESULT.split(", ")]
    want = plain_first_writers(batches, state)
    assert {tuple(r) for r in told.select(columns).collect()} == want and told.count() == 49
    new = {(r.fingerprint, r.first_raw_id) for r in recorded(told).collect()}
    assert new == {("hot", "a39"), ("f1", "a99"), ("f2", "b2"), ("f4", "c1")}
    once = first_writers(spark.createDataFrame(batches[0], WRITES))
    assert {tuple(r) for r in once.collect()} == plain_first_writers(batches[:1])
