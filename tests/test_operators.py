"""Quality rules, duplicates, reports, pages, sources and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedup, html, quality, reports, sets, sinks
from postmill.plans import medallion
from postmill.schemas import CANONICAL, FLAG, RAW_JOBS, STATE
from postmill.sources import crawl, files, payload
from postmill.sources.paged import PagedListing, search

BASE = {
    "raw_id": "r1", "source_name": "jooble", "source_job_id": "n-77", "source_url": "https://jobs.example/n-77", "job_fingerprint": "f0", "title": "Ward Nurse", "company_name": "Palm Clinic",
    "location_raw": "Jeddah, KSA", "location_city": "Jeddah", "location_country": "KSA", "career_level": "Senior", "salary_min": 7000.0, "salary_max": 7000.0,
    "posting_date": "2026-04-02", "collected_at": "2026-04-20T00:00:00+00:00",
}
SCHEMA = ", ".join(f"{k} {'double' if k.startswith('salary') else 'string'}" for k in BASE)
#: What is changed in the record above, the rule that fires, and whether it rejects. 180 days before collection is 2025-10-22.
CASES = [
    ({}, None, False), ({"posting_date": "2025-10-22"}, None, False), ({"posting_date": "2025-10-21"}, "STALE-001", False), ({"posting_date": "2026-04-20"}, None, False), ({"posting_date": "2026-04-21"}, "ERR-001", False),
    ({"title": "B" * 300}, None, False), ({"title": "B" * 301}, "ERR-003", True), ({"title": None}, "REQ-001", True),
    ({"source_job_id": None}, None, False), ({"source_job_id": None, "job_fingerprint": None}, "REQ-002", True), ({"source_url": None}, "REQ-003", True), ({"collected_at": None}, "REQ-004", True),
    ({"salary_max": 6999.0}, "ERR-002", True), ({"salary_max": None}, None, False), ({"location_country": "Jordan"}, "ERR-004", False), ({"location_country": None}, None, False),
    ({"company_name": None}, "WARN-001", False), ({"location_raw": None}, "WARN-002", False), ({"career_level": "Unspecified"}, "WARN-003", False), ({"posting_date": None}, "WARN-004", False),
    ({"company_name": None, "location_city": None}, "WARN-005", False),
]


def test_rules(spark):
    rows = [tuple((BASE | o | {"raw_id": f"r{i:02d}"}).values()) for i, (o, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, SCHEMA)
    py = {r.raw_id: r for r in quality.evaluate(df, py=True).collect()}
    default = {r.raw_id: r for r in quality.evaluate(df).collect()}
    assert len(py) == len(default) == len(CASES)
    for i, (_, rule, rejected) in enumerate(CASES):
        got = [f.rule for f in py[f"r{i:02d}"].quality_flags]
        assert (rule in got) if rule else got == []
        assert py[f"r{i:02d}"].is_rejected == rejected == default[f"r{i:02d}"].is_rejected
        if rule not in ("REQ-001", "REQ-002", "STALE-001", "ERR-001", None):
            assert rule in [f.rule for f in default[f"r{i:02d}"].quality_flags]
    both = spark.createDataFrame([tuple((BASE | {"source_url": None, "salary_min": 2.0, "salary_max": 1.0}).values())], SCHEMA)
    assert quality.evaluate(both).first().rejection_reason.startswith("REQ-003")
    assert quality.evaluate(both, py=True).first().rejection_reason.startswith("ERR-002")
    assert quality.quality_log(quality.evaluate(both)).count() == 2
    again = quality.append_flag(quality.append_flag(quality.evaluate(both), F.lit(True), "WARN-005", "warning", "m"), F.lit(True), "WARN-005", "warning", "m")
    assert [f.rule for f in again.first().quality_flags] == ["REQ-003", "ERR-002", "WARN-005"]


def fold(batch, history, state):
    """The sequential semantics, row by row."""
    ids = {r["raw_id"] for r in batch}
    first = {}
    for fp, raw in state:
        first[fp] = min(first.get(fp, raw), raw)
    urls, fps, out = {}, {}, {}
    for r in sorted(batch, key=lambda r: r["ordinal"]):
        native, fp, url = r["source_job_id"], r["job_fingerprint"], r["source_url"]
        if native and any(h["source_name"] == r["source_name"] and h["source_job_id"] == native for h in history):
            out[r["raw_id"]] = (True, None)
        elif not native and fp and fp in fps:
            out[r["raw_id"]] = (True, fps[fp])
        elif not native and fp and fp in first and first[fp] not in ids:
            out[r["raw_id"]] = (True, first[fp])
        elif url in urls:
            out[r["raw_id"]] = (True, urls[url])
        elif url and (other := [h["raw_id"] for h in history if h["source_url"] == url and h["run_id"] != r["run_id"]]):
            out[r["raw_id"]] = (True, min(other))
        else:
            out[r["raw_id"]] = (False, None)
            urls[url] = r["raw_id"]
            if not native and fp:
                fps[fp] = r["raw_id"]
    return out


def test_sequential_dedup_equals_the_fold(spark):
    rnd = random.Random(5)
    raw = "raw_id string, run_id string, source_name string, source_job_id string, source_url string, job_fingerprint string, collected_at string, ordinal bigint"
    for n in (0, 6, 60):
        def make(prefix, run, k):
            return {"raw_id": f"{prefix}{k:03d}", "run_id": run, "source_name": rnd.choice("ab"), "source_job_id": rnd.choice([None, None, "", "1", "2"]), "source_url": rnd.choice([None, *"uvwxyz"]), "job_fingerprint": rnd.choice(["", *"ABCDEF"]), "collected_at": "t", "ordinal": k}
        batch = [make("n", "new", k) for k in range(n)]
        history = [make("h", rnd.choice(["new", "old"]), k) for k in range(n // 6)]
        state = [(rnd.choice("ABQ"), rnd.choice(["n001", "zz", "yy"])) for _ in range(n // 20)]
        frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], raw)
        known = spark.createDataFrame([(a, b, "s", "t") for a, b in state], STATE)
        got = dedup.sequential(frame(batch), frame(history), known)
        assert {r.raw_id: (r.is_duplicate, r.duplicate_of_job_id) for r in got.collect()} == fold(batch, history, state)
    counter = [("r1", "A", "u1"), ("r2", "A", "u2"), ("r3", "B", "u2")]
    rows = [{"raw_id": a, "run_id": "new", "source_name": "s", "source_job_id": None, "source_url": u, "job_fingerprint": f, "collected_at": "t", "ordinal": i} for i, (a, f, u) in enumerate(counter)]
    told = dedup.sequential(frame(rows), frame([]), spark.createDataFrame([], STATE))
    assert {r.raw_id: r.is_duplicate for r in told.collect()} == {"r1": False, "r2": True, "r3": False}
    assert {r.fingerprint: r.first_raw_id for r in dedup.new_state(told, spark.createDataFrame([("A", "x", "s", "t")], STATE)).collect()} == {"B": "r3"}


def test_first_by_fingerprint_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b", "f", "1"), ("a", "f", "1"), ("c", "f", "0"), ("d", "g", "9")], "raw_id string, job_fingerprint string, collected_at string")
    assert {r.raw_id: r.duplicate_of_raw_id for r in dedup.first_by_fingerprint(df).collect()} == {"a": "c", "b": "c", "c": None, "d": None}


def raw(i, source, **body):
    return (f"r{i}", "run", source, None, body.pop("u", f"https://x/{i}"), json.dumps(body, ensure_ascii=False), "2026-09-05T00:00:00+00:00")


def test_bronze_to_gold_drops_nothing_silently(spark):
    rows = [
        raw(1, "careerjet", title="Engineer", company="Acme", locations="Riyadh", salary="5000", date="d"), raw(2, "careerjet", title="Nurse (SAUDI NATIONAL)", company="ADDAR GROUP", locations="Jedda, KSA"),
        raw(3, "careerjet", title="ENGINEER", company="ACME LLC", locations="riyadh"), raw(4, "careerjet", title=None, company="X"),
        raw(5, "jooble", title="Cook", company="Y", location="Riyadh", salary="null", updated="2026-09-01T00:00:00.0000000"), raw(6, "tanqeeb", job_title="Cook", company="Z", city="Cairo", country="Egypt", posting_date="2026-09-01"),
        raw(7, "techmap", title="Cook", company="Z", city="Riyadh", country="", date_created="2026-09-01T02:20:00Z"),
    ]
    df = spark.createDataFrame(rows, RAW_JOBS)
    by_source = sets.concatenate(*[payload.staged(df, s) for s in payload.MAPPINGS])
    assert sorted(map(tuple, by_source.collect()), key=str) == sorted(map(tuple, payload.staged_union(df).collect()), key=str)
    assert tuple(by_source.columns) == CANONICAL
    silver = {r.raw_id: r for r in medallion.silver(df).collect()}
    assert len(silver) == 7 and all(len(r.job_fingerprint) == 64 for r in silver.values())
    assert silver["r3"].duplicate_of_raw_id == "r1" and silver["r4"].is_rejected and silver["r7"].location_country == "Saudi Arabia"
    assert silver["r5"].salary_raw is None and str(silver["r5"].posting_date) == "2026-09-01" and silver["r6"].out_of_region
    gold = medallion.with_surrogates(medallion.gold(df))
    assert sorted(r.raw_id for r in gold.collect()) == ["r1", "r2", "r5", "r6", "r7"] and len(gold.columns) == 33
    good, bad = sinks.loadable(medallion.silver(df))
    assert good.count() == 5 and bad.count() == 0
    py = medallion.standardize_py(medallion.clean_py(df)).collect()
    assert {r.raw_id: r.title for r in py}["r6"] is None


def test_gold_plan_has_one_scan_and_no_sort_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([raw(1, "jooble", title="a")], RAW_JOBS).write.parquet(path)
    plan = medallion.gold(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "PushedFilters" in plan


def odd_rows():
    """Copies, copies of rejected rows, ties, missing parts, inverted salaries."""
    bodies = [dict(title="Engineer", company="Acme LLC", locations="Riyadh", salary="5000"), dict(title="ENGINEER", company="Acme", locations="riyadh", salary="9000 - 5000"), dict(title=None, company="X"), dict(title="T" * 301, company="Y"), dict(company="X", salary="7"), {}]
    rows = [raw(i, ("careerjet", "jooble", "other")[i % 7 % 3], **bodies[i % 6]) for i in range(40)]
    rows += [(*raw(50 + i, "careerjet", **bodies[0])[:4], None, "{}", None) for i in range(2)] + [raw(50, "tanqeeb", job_title="Cook", company="Z", city="Cairo", country="Egypt", posting_date="2026-09-01")]
    return rows + rows[:1]


def test_gold_and_silver_of_few_columns_are_those_of_all(spark):
    """Queries of few columns parse and clean what these need and no more; rows and values are those of the whole layers."""
    df = spark.createDataFrame(odd_rows(), RAW_JOBS)
    whole, plain = medallion.silver(df), medallion.gold(df)
    of_silver = whole.where(~F.col("is_duplicate") & ~F.col("is_rejected")).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, of_silver.collect())) and plain.count() >= 3
    for only in (("title", "source_name"), ("quality_flags",), ("rejection_reason", "salary_min", "location_city", "out_of_region")):
        for few, layer in ((medallion.gold(df, only), plain), (medallion.silver(df, only), whole)):
            columns = sorted({*only, "raw_id", "is_duplicate"} & {*layer.columns})
            assert sorted(map(str, few.select(columns).collect())) == sorted(map(str, layer.select(columns).collect())), only
    plan = medallion.judged(df, ["raw_id", "is_rejected"])._jdf.queryExecution().optimizedPlan().toString()
    assert "negotiable" in plan and "fresh" not in plan and "SAR" not in plan and "qassim" not in plan and "description" not in plan
    assert set(medallion.parsed(df, ["source_name"]).columns) == {"raw_id", "source_name", "collected_at", "job_fingerprint", "is_rejected"}


def test_rules_are_applied_before_rows_are_written(spark):
    """What follows the written rows is joins: no rule in tasks whose number doesn't grow with the rows; a fingerprint that all share is no single task's."""
    df = spark.createDataFrame(odd_rows(), RAW_JOBS)
    for layer in (medallion.gold(df), medallion.silver(df)):
        assert "low-confidence" not in layer._jdf.queryExecution().optimizedPlan().toString()
    assert "job_fingerprint" in (plan := medallion.gold(df, ["raw_id"])._jdf.queryExecution().optimizedPlan().toString()) and "LeftSemi" in plan and plan[plan.index("LeftSemi") :].split("\n")[0].count("raw_id") > 0


def test_rules_have_no_lambda(spark):
    """A lambda's whole argument is interpreted, row by row: flags are made without one, and are those that a filtered list would have."""
    df = spark.createDataFrame(odd_rows(), RAW_JOBS)
    rules = quality.default_rules()
    rows = medallion.standardized(df).cache()
    plan = quality.evaluate(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("InMemoryRelation")[0]
    filtered = F.array_compact(F.array(*[F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.id), F.lit(r.severity), r.message)) for r in rules if r.flags]))
    got = quality.evaluate(rows).select("quality_flags", filtered.cast(f"array<{FLAG}>").alias("want")).collect()
    assert [r.quality_flags for r in got] == [r.want for r in got] and len({len(r.want) for r in got}) > 1


def test_what_rules_say_needs_no_other_rows(spark, tmp_path):
    """Flags, rejections and the log of one posting don't hang on others: no join, and the rows that Silver has, ids and fingerprints repeated or not."""
    from postmill.plans import queries as Q

    df = spark.createDataFrame(odd_rows(), RAW_JOBS)
    df = df.unionByName(df)
    of_silver, alone = (d.select("raw_id", "quality_flags", "is_rejected", "rejection_reason") for d in (medallion.silver(df), medallion.judged(df, quality.JUDGED)))
    assert sorted(map(str, alone.collect())) == sorted(map(str, of_silver.collect()))
    spark.range(300).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2020-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("quality_flags", "quality_log", "is_rejected", "rejection_reason", "flag_backfill", "flag_lateral_count"):
        assert "Join" not in Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString(), name


def test_views_over_parsed_postings_parse_no_more(spark):
    df = spark.createDataFrame(odd_rows(), RAW_JOBS)
    told = {}
    for rows in (None, medallion.parsed(df)):
        names = medallion.create_views(df, rows)
        told[rows is None] = [sorted(map(str, spark.table(n).collect())) for n in names]
        assert ("json" in spark.table("fct_jobs")._jdf.queryExecution().optimizedPlan().toString()) == (rows is None)
    assert told[True] == told[False]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", None)], "k string, v int")
    assert {r.k: (r.n, r.percent) for r in reports.frequencies(df, "k").collect()} == {"a": (2, 50.0), "(none)": (1, 25.0), "b": (1, 25.0)}
    assert {r.column_name: (r.missing, r.rate) for r in reports.column_profile(df, ["k", "v"]).collect()} == {"k": (1, 0.25), "v": (1, 0.25)}
    assert reports.matched_pairs(df, df, "k").first().matched == 5
    assert reports.matched_pairs(df.limit(0), df, "k").first().matched == 0
    assert reports.only_left(df, df.where("k = 'a'"), "k").count() == 2
    assert [r.k for r in reports.top_k(df, "k", 1).collect()] == ["a"]
    assert reports.unaccepted_values(df, "k", ["a"]).collect() == [("b", 1)]


def test_detail_page(spark):
    job = {"@type": "JobPosting", "title": "LD title", "hiringOrganization": {"name": "Org"}, "datePosted": "2026-01-02", "description": "<p>" + "long text " * 8 + "</p>", "jobLocation": {"address": {"addressLocality": "Abha"}}, "baseSalary": {"currency": "USD", "value": {"minValue": 5, "maxValue": 9}}}
    page = f'''<script type="application/ld+json">[{{"@type":"Thing"}},{json.dumps(job)}]</script><a data-job-id="12"></a><a data-job-id="12"></a><a href="/jobs/0345.html"></a>
      <h1 class="job-title-text">Cook</h1><span class="job-meta-item">Saudi Arabia,  Jeddah</span><span class="job-meta-item">Saudi Arabia</span>
      <span class="job-tag">Show original</span><span class="job-tag">Full Time</span><span class="job-tag">Remote</span><div class="meta-data"><b>Experience</b><i>2 years</i><b>Gender</b><i>any</i></div>'''
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string")
    got = html.details(df.withColumns({"seeds": html.seed_ids(F.col("html")), "links": html.link_ids(F.col("html"))}), "html", ("seeds", "links")).collect()
    r = got[0]
    assert (r.seeds, r.links, r.title, r.company, r.city, r.employment_type, r.work_mode) == (["12"], ["345"], "Cook", "Org", "Jeddah", "Full Time", "Remote")
    assert (r.experience, r.gender, r.salary, r.posting_date) == ("2 years", "any", "5-9 USD", "2026-01-02") and r.job_description.startswith("long text")
    assert got[1].title is None and got[2].city is None


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": 1, "t": "a"}, {"id": 2, "t": "b"}]))
    jobs = files.json_array(spark, str(tmp_path / "jobs.json"))
    bronze = files.to_raw(jobs, "run", "jooble", F.col("id"), F.concat(F.lit("u"), "id"), F.lit("t"))
    assert bronze.count() == 2 and bronze.columns == [c.split()[0] for c in RAW_JOBS.split(", ")]
    (tmp_path / "x.csv").write_bytes("﻿a,b\n1,\"x\n\"\"y\"\"\"\n".encode())
    assert files.csv_with_bom(spark, str(tmp_path / "x.csv")).collect() == [("1", 'x\n"y"')]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a </loc></url><url><loc>https://b</loc></url></urlset>")
    assert sorted(r.url for r in files.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()) == ["https://a", "https://b"]
    for page, rows in ((1, [{"a": 1}, {"a": 2}]), (2, [{"a": 3}]), (3, [])):
        (tmp_path / f"{page}.json").write_text(json.dumps(rows))
    spark.dataSource.register(PagedListing)
    assert spark.read.format("paged_listing").option("path", str(tmp_path)).load().count() == 3
    out = str(tmp_path / "table")
    sinks.append_ignoring(bronze, out, "raw_id")
    sinks.append_ignoring(bronze, out, "raw_id")
    assert spark.read.parquet(out).count() == 2
    sinks.csv_export(bronze, str(tmp_path / "csv"), ["raw_id", "source_job_id"])
    assert sinks.layer_table(None, "t") == "default.t" and sinks.layer_table(" gold ", "t") == "gold.t"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 1)], "src int, dst int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.depth for r in crawl.reachable(seeds, edges).collect()} == {1: 0, 2: 1, 3: 2}
    nested = spark.createDataFrame([('{"status":"ok","data":[{"a":1},{"a":2}]}',)], "j string")
    assert nested.select(F.size(files.nested_rows(F.col("j")))).first()[0] == 2


def test_pages_end_where_the_listing_does(spark, tmp_path):
    spark.dataSource.register(PagedListing)
    for name, pages in {"hits": [{"hits": 3, "jobs": [{"a": 1}, {"a": 2}]}, {"hits": 3, "jobs": [{"a": 3}]}, {"hits": 3, "jobs": [{"a": 4}]}], "broken": [[{"a": 1}], "{", [{"a": 2}]], "empty": [[{"a": 1}], [], [{"a": 2}]], "none": []}.items():
        (tmp_path / name).mkdir()
        for i, page in enumerate(pages):
            (tmp_path / name / f"{i + 1}.json").write_text(page if isinstance(page, str) else json.dumps(page))
    got = {name: search(spark, str(tmp_path / name), "nurse", "Riyadh") for name in ("hits", "broken", "empty", "none")}
    assert {k: v.count() for k, v in got.items()} == {"hits": 3, "broken": 1, "empty": 1, "none": 0}
    assert got["hits"].select("keywords", "search_location").distinct().collect() == [("nurse", "Riyadh")]
    assert search(spark, f"file://{tmp_path}/hits", "", "", max_pages=1).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", 'say "x", y', None), ("a", "line\nbreak", 2)], "id string, text string, n int").coalesce(1)
    sinks.csv_export(df, str(tmp_path / "csv"), ["id", "text", "n"])
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfid,text,n\n")
    assert files.csv_with_bom(spark, str(tmp_path / "csv")).select("id", "text").collect() == df.select("id", "text").collect()
    for rows in (df, df.limit(1), df.limit(0), df.unionByName(df).repartition(3)):
        sinks.json_array_export(rows, str(tmp_path / "json"))
        (file,) = (tmp_path / "json").glob("*.txt")
        assert sorted(json.loads(file.read_text()), key=str) == sorted((r.asDict() for r in rows.collect()), key=str)
        for x in (tmp_path / "json").iterdir():
            x.unlink()
        (tmp_path / "json").rmdir()


def test_quality_logs_are_appended_once(spark, tmp_path):
    log = spark.createDataFrame([("r1", [("REQ-003", "error", "m"), ("WARN-001", "warning", "n")])], "raw_id string, quality_flags array<struct<rule:string,severity:string,message:string>>")
    for _ in range(2):
        sinks.append_ignoring(quality.quality_log(log), str(tmp_path / "log"), "log_id")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_loads_and_guards(spark, tmp_path):
    rows = [("a", "1.5", "2", False, False), ("b", "x", None, False, False), ("c", "1", "1", True, False), ("d", None, "1" * 20, False, None), ("e", None, None, None, False)]
    df = spark.createDataFrame(rows, "raw_id string, salary_min string, salary_max string, is_rejected boolean, is_duplicate boolean")
    computed = spark.sparkContext.accumulator(0)
    counted = df.mapInArrow(lambda batches: (computed.add(b.num_rows) or b for b in batches), df.schema)
    assert sinks.load(counted.where("raw_id <> 'b' and raw_id <> 'd'"), str(tmp_path / "t")).first() == (2, 2, 0, 2, True)
    assert computed.value == 5  # the input is computed once, by the write
    assert sinks.load(df, str(tmp_path / "t")).first() == (4, 2, 2, 2, True)
    assert sinks.load(df.limit(0), str(tmp_path / "none")).first() == (0, 0, 0, 0, True)
    assert spark.read.parquet(str(tmp_path / "t-failed")).count() == 2
    flag = lambda d: d.withColumn("salary_min", F.lit("0"))
    assert sinks.guarded_update(df, F.col("salary_min").isNull(), flag, 2).where("salary_min = '0'").count() == 5
    for change, expected in ((flag, 3), (lambda d: d.limit(1), 2)):
        with pytest.raises(ValueError):
            sinks.guarded_update(df, F.col("salary_min").isNull(), change, expected)
    assert sinks.smoke(spark, str(tmp_path / "smoke"))
    with pytest.raises(NotImplementedError):
        files.government_csv(spark)
    assert sinks.layer_table(" gold ", "jobs") == "gold.jobs" and sinks.layer_table(None, "jobs") == "default.jobs"


def test_databases(spark):
    sinks.create_tables(spark, "old_db")
    sinks.reload(spark.range(3), "old_db.extra")
    spark.sql("INSERT INTO old_db.raw_jobs SELECT 'r', 'j', 'u', '{}', 't', concat('run-', id), 'jooble' FROM range(3)")
    spark.sql("CREATE VIEW old_db.lower AS SELECT id + 1 AS id FROM `old_db`.extra")
    spark.sql("CREATE VIEW old_db.upper AS SELECT *, 'old_db.extra' AS note FROM old_db.lower")
    assert sorted(sinks.rename_database(spark, "old_db", "new_db")) == ["collection_runs", "extra", "lower", "processed_fingerprints", "raw_jobs", "upper"]
    assert spark.table("new_db.extra").count() == 3 and not spark.catalog.databaseExists("old_db")
    assert sorted(tuple(r) for r in spark.table("new_db.upper").collect()) == [(i, "old_db.extra") for i in (1, 2, 3)]
    assert set(spark.table("new_db.raw_jobs").columns) == set(spark.createDataFrame([], RAW_JOBS).columns)
    assert {c.name for c in spark.catalog.listColumns("new_db.raw_jobs") if c.isPartition} == {"run_id", "source_name"}
    assert spark.table("new_db.raw_jobs").where("run_id = 'run-1'").count() == 1
    sinks.drop_database(spark, "new_db")
    files.bind({"some_source": spark.range(2)})
    assert spark.sql("select * from some_source").count() == 2


def test_updated_times_stand_in(spark):
    df = spark.createDataFrame([("2026-01-02",), ("",), (None,)], "updated string")
    assert [r.collected_at for r in files.with_updated(df, "updated", "t0").collect()] == ["2026-01-02", "t0", "t0"]


def test_the_crawl_stops_at_its_cap(spark):
    edges = spark.createDataFrame([(1, i) for i in range(10, 20)] + [(10, 30), (30, 40)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    reach = lambda **k: [(r.node, r.depth) for r in crawl.reachable(seeds, edges, **k).orderBy("depth", "node").collect()]
    assert reach(most=3) == [(1, 0), (10, 1), (11, 1)]
    assert len(reach(most=None)) == 12 and (40, 3) in reach(depth=3, most=None)


def greedy(rows):
    urls, prints, kept = set(), set(), []
    for o, _, fp, url in sorted(rows):
        if url not in urls and (fp is None or fp not in prints):
            kept.append(o)
            urls.add(url)
            prints |= {fp} - {None}
    return kept


def test_a_chain_is_decided_in_few_rounds(spark, caplog):
    """Rows that share url and fingerprint in turn, 10,000 of them, beside unlinked ones."""
    rows = [(i, f"r{i}", f"f{(i + 1) // 2}", f"u{i // 2}") for i in range(10_000)] + [(20_000 + i, f"s{i}", None, f"v{i % 700}") for i in range(1000)]
    df = spark.createDataFrame(rows, "_o bigint, raw_id string, _fp string, _url string").repartition(4)
    with caplog.at_level("DEBUG", logger="postmill.operators.dedup"):
        got = sorted(r._o for r in dedup._first_comers(df).collect())
    assert got == greedy(rows)
    assert 0 < sum("round" in r.message for r in caplog.records) < 30


def test_components_and_parts_of_them_in_order(spark, monkeypatch, caplog):
    """Chains that no single task may hold: components once, then the first rows of each, again and again."""
    monkeypatch.setattr(dedup, "FOLD_ROWS", 40)
    monkeypatch.setattr(dedup, "KEY_ROUNDS", 1)
    rnd = random.Random(8)
    rows = [(i, f"r{i}", f"f{(i + 1) // 2}", f"u{i // 2}") for i in range(300)]
    rows += [(1000 + i, f"s{i}", rnd.choice([None, f"g{rnd.randrange(60)}"]), f"v{rnd.randrange(60)}") for i in range(400)]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    rows = [(o, *r[1:]) for o, r in zip(order, rows, strict=True)]
    df = spark.createDataFrame(rows, "_o bigint, raw_id string, _fp string, _url string").repartition(4)
    with caplog.at_level("DEBUG", logger="postmill.operators.dedup"):
        assert sorted(r._o for r in dedup._first_comers(df).collect()) == greedy(rows)
    assert sum("components" in r.message for r in caplog.records) <= 12


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (600, 600)], "a bigint, b bigint")
    got = {r.node: r.component for r in dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_chains_leave_the_rounds_by_keys_early(spark, monkeypatch):
    """Rows that share their keys in turn: one round by keys, then components, not a round for every two rows decided."""
    monkeypatch.setattr(dedup, "FOLD_ROWS", 300)
    rounds, real = [], dedup._key_round
    monkeypatch.setattr(dedup, "_key_round", lambda d: rounds.append(1) or real(d))
    rows = spark.range(2000).selectExpr("id as _o", "cast(id as string) as raw_id", "case when id % 500 > 0 then concat('f', floor((id + 1) / 2)) end as _fp", "concat('u', floor(id / 2)) as _url")
    assert sorted(r._o for r in dedup._first_comers(rows).collect()) == list(range(0, 2000, 2))
    assert len(rounds) == 1


def test_components_of_near_edges(spark, monkeypatch):
    rnd = random.Random(8)
    near = [(i, a := rnd.randrange(3000), a + rnd.choice([0, 1, 2, 700])) for i in range(1500)]
    want = {x: x for _, *e in near for x in e}
    for _ in range(60):
        for _, a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    edges = spark.createDataFrame(near, "_o long, a long, b long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = {r.node: r.component for r in dedup._near_components(edges, "_o").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    assert len({(got[x], want[x]) for x in want}) == len(set(want.values())) == len(set(got.values()))


def test_payloads_do_not_go_through_deduplication(spark, monkeypatch, tmp_path):
    from postmill.plans import queries as Q

    widths, real = [], dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda d, label: widths.append(d.columns) or real(d, label))
    spark.range(300).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2020-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    assert Q.QUERIES["dedup_sequential"](spark, str(tmp_path)).count() == 100
    assert widths and not any({"raw_payload", "description", "title"} & set(w) for w in widths)
