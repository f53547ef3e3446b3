"""Appends are published whole or not at all, by one of several writers; changes rewrite the touched runs only."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from postmill.operators import publishing
from postmill.sources import files

RAW, RUN = "raw_id string, run_id string", "run_id string, started_at string"


def rows(spark, run, ids):
    return spark.createDataFrame([(f"r{i}", run) for i in ids], RAW)


def run(spark, name):
    return spark.createDataFrame([(name, "t")], RUN)


def state(spark, root):
    raw, runs = (publishing.read_published(spark, root, t, s) for t, s in (("raw_jobs", RAW), ("collection_runs", RUN)))
    return sorted(r.raw_id for r in raw.collect()), sorted(r.run_id for r in runs.collect())


def parts(root):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(root) for name in names)


def test_a_run_is_appended_whole(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert state(spark, root) == ([], [])
    assert publishing.append_run(run(spark, "a"), rows(spark, "a", [1, 2, 2, 3]), root) == 1
    assert publishing.append_run(run(spark, "b"), rows(spark, "b", [3, 4]), root) == 2
    assert publishing.append_run(run(spark, "b"), rows(spark, "b", [3, 4]), root) == 3  # again: nothing is added
    assert state(spark, root) == (["r1", "r2", "r3", "r4"], ["a", "b"])
    none = spark.createDataFrame([(None, "c"), (None, "c")], RAW)
    publishing.append_run(run(spark, "c"), none, root)
    assert publishing.read_published(spark, root, "raw_jobs", RAW, 3).count() == 1


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "jobs")
    publishing.append_run(run(spark, "a"), rows(spark, "a", [1]), root)
    before = parts(root)
    broken = rows(spark, "b", range(2, 40)).withColumn("raw_id", F.when(F.col("raw_id") == "r30", F.raise_error("lost")).otherwise(F.col("raw_id")))
    with pytest.raises(Exception, match="lost"):
        publishing.append_run(run(spark, "b"), broken, root)
    with pytest.raises(Exception, match="lost"):  # the second table fails: the first isn't visible either
        publishing.publish_append(root, {"raw_jobs": (rows(spark, "b", [9]), "raw_id"), "collection_runs": (run(spark, "b").withColumn("started_at", F.raise_error("lost").cast("string")), "run_id")})
    assert state(spark, root) == (["r1"], ["a"]) and parts(root) == before
    publishing.append_run(run(spark, "b"), rows(spark, "b", [1, 2]), root)
    assert state(spark, root) == (["r1", "r2"], ["a", "b"])


def test_concurrent_writers_add_no_key_twice(spark, tmp_path, monkeypatch):
    """Three writers that all have read the same state before any of them publishes."""
    root, real, gate = str(tmp_path / "jobs"), publishing._publish, threading.Barrier(3)
    first = threading.local()

    def publish(*args):
        if not getattr(first, "passed", False):
            first.passed = True
            gate.wait(120)
        return real(*args)

    monkeypatch.setattr(publishing, "_publish", publish)
    numbers = []
    write = lambda name, ids: numbers.append(publishing.append_run(run(spark, name), rows(spark, name, ids), root))
    writers = [threading.Thread(target=write, args=(name, ids)) for name, ids in (("a", range(6)), ("b", range(3, 9)), ("a", range(5, 12)))]
    for w in writers:
        w.start()
    for w in writers:
        w.join(240)
    assert sorted(numbers) == [1, 2, 3]
    assert state(spark, root) == (sorted(f"r{i}" for i in range(12)), ["a", "b"])


def test_only_touched_runs_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"run-{i % 4}" if i % 5 else None, None) for i in range(40)], "id int, run_id string, flag string")
    df.write.partitionBy("run_id").parquet(path)
    kept = lambda: {(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}
    before = kept()
    assert publishing.change_partitions(spark, path, (F.col("run_id") == "run-1") & (F.col("id") > 10), lambda d: d.withColumn("flag", F.lit("x"))) == 1
    after = kept()
    assert {k for k in before if "run_id=run-1" not in k[0]} == set(before) & set(after) and all(before[k] == after[k] for k in set(before) & set(after))
    table = lambda: sorted(((r.id, r.run_id, r.flag) for r in spark.read.schema(df.schema).parquet(path).collect()), key=str)
    want = [(i, r, "x" if r == "run-1" and i > 10 else None) for i, r, _ in (tuple(x) for x in df.collect())]
    assert table() == sorted(want, key=str)
    assert publishing.change_partitions(spark, path, F.col("run_id").isin("run-2") | F.col("run_id").isNull(), lambda d: d.limit(0)) == 2
    assert table() == sorted([w for w in want if w[1] not in ("run-2", None)], key=str)
    assert publishing.change_partitions(spark, path, F.col("flag") == "none", lambda d: d) == 0
    assert publishing.change_partitions(spark, path, (F.col("run_id") == "run-0") & (F.col("flag").isNull()), lambda d: d.unionByName(d.withColumn("flag", F.lit("copy")))) == 1
    assert len(table()) == len([w for w in want if w[1] not in ("run-2", None)]) + len([w for w in want if w[1] == "run-0"])


def test_the_latest_runs_files_only_are_read(spark, tmp_path):
    spark.sql("select id, concat('run-', id % 6) as run_id, concat('s', cast(id / 6 as int) % 2) as source_name from range(60)").write.partitionBy("run_id", "source_name").parquet(str(tmp_path / "t"))
    runs = spark.createDataFrame([(f"run-{i}", f"t{i if i < 5 else 0}") for i in range(6)], "run_id string, started_at string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        latest = files.of_latest_run(spark.read.parquet(str(tmp_path / "t")), runs)
        plan = latest._jdf.queryExecution().executedPlan()
        assert sorted(r.id for r in latest.collect()) == list(range(4, 60, 6))
        leaf = next(x for x in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())) if "PartitionFilters" in x.verboseStringWithOperatorId())
        assert "Subquery" in leaf.verboseStringWithOperatorId()
        assert leaf.metrics().apply("numPartitions").value() == 2  # of twelve
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert files.of_latest_run(spark.read.parquet(str(tmp_path / "t")), runs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"tags":["a","b"],"data":[{"id":1}]}', [1]), ('{"data":{"tags":["x"],"jobs":[{"id":2},{"id":3}]}}', [2, 3]), ('{"x":{"y":{"z":[{"id":4}]}}}', [4]), ('[{"id":5}]', [5]),
        ('{"a":[1],"b":{"c":[]}}', None), ('{"results":[{"id":6}],"first":[{"id":0}]}', [6]), ('{"data":{"z":[{"id":7}]},"aa":[{"id":8}]}', [7]), ('{"aa":[[{"id":9}]]}', None),
        ('{"data":[],"b":{"c":[{"id":10}]}}', [10]), ("null", None), ("{", None), ("3", None), ("", None), (None, None),
    ],
)
def test_rows_of_an_answer(spark, answer, want):
    found = spark.createDataFrame([(answer,)], "j string").select(F.transform(files.nested_rows(F.col("j")), lambda v: F.try_variant_get(v, "$.id", "int")).alias("ids")).first().ids
    assert found == want


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    """Eight writers claim each number at the same instant: one is told that it has it, and its entry is what stands there."""
    root, writers = str(tmp_path / "jobs"), 8
    for number in range(1, 16):
        gate, told = threading.Barrier(writers), {}

        def claim(i, number=number, gate=gate, told=told):
            gate.wait(60)
            told[i] = publishing._publish(spark, root, number, {"raw_jobs": f"raw_jobs/{i}"})

        threads = [threading.Thread(target=claim, args=(i,)) for i in range(writers)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        winners = [i for i, won in told.items() if won]
        assert len(told) == writers and len(winners) == 1
        assert publishing._published(spark, root, number - 1) == {number: {"raw_jobs": f"raw_jobs/{winners[0]}"}}
    assert not [d for _, folders, _ in os.walk(os.path.join(root, "parts")) for d in folders]


def test_a_rename_replaces_no_entry(spark, tmp_path):
    """Between a writer's look at a number and its rename another may have taken it: the disk's rename has to fail then."""
    ours, theirs = (str(tmp_path / x) for x in ("ours", "theirs"))
    assert publishing._publish(spark, ours, 1, {"raw_jobs": "a"}) and publishing._publish(spark, theirs, 1, {"raw_jobs": "b"})
    with pytest.raises(OSError):
        os.rename(f"{theirs}/published/000000000001", f"{ours}/published/000000000001")
    assert publishing._published(spark, ours) == {1: {"raw_jobs": "a"}}
