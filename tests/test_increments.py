"""What is added run by run, trigger by trigger, or looked up in bucketed tables equals the same work at once."""

import json

from pyspark.sql import functions as F

from postmill.operators import dedup, reports, run_totals
from postmill.sources.paged import PagedListing

HISTORY = "raw_id string, run_id string, source_name string, source_job_id string, source_url string"


def test_reports_by_run_equal_the_full_scan(spark, tmp_path):
    root = str(tmp_path / "totals")
    assert run_totals.duplicate_count(spark, root, "url").first() == (0, 0, 0)
    rows = [(f"run-{i % 3}", f"u{i % 17}" if i % 5 else None, [None, "a", "b", "", "a,b"][i % 5 if i % 7 else 0]) for i in range(100)]
    df = spark.createDataFrame(rows, "run_id string, url string, city string")
    for run in ("run-0", "run-1", "run-1", "run-2"):
        run_totals.add_run(run, df.where(F.col("run_id") == run), root, ["city"], ["url"])
    assert sorted(map(tuple, run_totals.frequencies(spark, root, "city").collect())) == sorted(map(tuple, reports.frequencies(df, "city").collect()))
    assert run_totals.top_k(spark, root, "city", 3).collect() == reports.top_k(df, "city", 3).collect()
    assert run_totals.duplicate_count(spark, root, "url").first() == reports.duplicate_count(df, "url").first()
    assert sorted(map(tuple, run_totals.run_counts(spark, root).collect())) == sorted(map(tuple, df.groupBy("run_id").count().collect()))
    # an empty run, and a key that is new in a later one
    run_totals.add_run("run-3", df.limit(0), root, ["city"], ["url"])
    run_totals.add_run("run-4", spark.createDataFrame([("run-4", "new", "a")], df.schema), root, ["city"], ["url"])
    assert run_totals.duplicate_count(spark, root, "url").first()["distinct_n"] == 18


def test_a_growing_listing_is_read_once(spark, tmp_path):
    """Pages come, the last one grows, a trigger fails and is run again: each record arrives once."""
    spark.dataSource.register(PagedListing)
    folder, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    page = lambda n, ids: (folder / f"{n}.json").write_text(json.dumps({"hits": 99, "jobs": [{"id": i} for i in ids]}))

    def trigger(fail=False):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail:
                raise RuntimeError("lost")

        stream = spark.readStream.format("paged_listing").option("path", str(folder)).option("max_pages", 2).load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        except Exception:
            assert fail
        finally:
            query.stop()

    page(1, [1, 2])
    page(2, [3])
    trigger()
    page(2, [3, 4])
    page(3, [5])
    trigger(fail=True)
    page(3, [5, 6])
    (folder / "4.json").write_text("{")
    trigger()
    page(4, [7])
    page(5, [8])
    page(6, [9])
    trigger()
    found = sorted((r.page, r.position, json.loads(r.record)["id"]) for r in spark.read.parquet(out).collect())
    assert found == [(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (3, 0, 5), (3, 1, 6), (4, 0, 7), (5, 0, 8), (6, 0, 9)]


def exchanges(df, table):
    """Exchanges of a plan between the scan of ``table`` and the top."""
    found = []

    def walk(node, above):
        name = node.nodeName()
        if name.startswith("Scan") and table in node.verboseStringWithOperatorId():
            found.append(sum("Exchange" in x for x in above))
        for i in range(node.children().size()):
            walk(node.children().apply(i), [*above, name])

    walk(df._jdf.queryExecution().executedPlan(), [])
    assert found
    return max(found)


def test_bucketed_lookups_shuffle_the_batch_only(spark):
    history = spark.createDataFrame([(f"h{i:03d}", f"run-{i % 4}", "ab"[i % 2], str(i % 30) if i % 3 else "", f"u{i % 40}" if i % 11 else None) for i in range(200)], HISTORY)
    state = spark.createDataFrame([(f"f{i % 25}", f"h{i:03d}", "s", "t") for i in range(60)], "fingerprint string, first_raw_id string, source_name string, recorded_at string")
    batch = spark.createDataFrame([(f"b{i:03d}", f"run-{i % 2}", "ab"[i % 2], str(i % 50), f"u{i % 60}", f"f{i % 40}") for i in range(90)], HISTORY + ", job_fingerprint string")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.sql("create database if not exists lookups")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        dedup.save_lookups(history, state, "lookups", 4)
        plain = [dedup.with_native_id_seen(batch, history), dedup.with_url_of_other_run(batch, history), dedup.with_prior_fingerprint(batch, state)]
        ids, urls, prints = (spark.table(f"lookups.{t}") for t in ("seen_ids", "seen_urls", "seen_fingerprints"))
        bucketed = [dedup.with_native_id_seen(batch, ids), dedup.with_url_of_other_run(batch, urls), dedup.with_prior_fingerprint(batch, prints)]
        for a, b in zip(plain, bucketed, strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert exchanges(bucketed[0], "seen_ids") == 0 and exchanges(bucketed[1], "seen_urls") == 0
        # behind the lookup itself, what was found is compared with the batch's own ids: that is of the batch's size
        assert exchanges(bucketed[2], "seen_fingerprints") <= 1
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
        spark.sql("drop database lookups cascade")
