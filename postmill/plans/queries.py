"""Queries of the driver's contract, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import postings as P
from ..functions.text import blank_to_null
from ..operators import dedup, html, quality, reports, sets
from ..schemas import STATE
from ..session import spread, stage
from ..sources import crawl, files, payload
from . import medallion
from .oracle import CHAIN
from .pages_sql import FACTS, LISTINGS, NESTED_PAGES, PAGES
from .postings_sql import POSTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL; {chain} stands for the common table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{chain}", CHAIN)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).createOrReplaceTempView("orders")
    return spark.sql(POSTINGS)


def staged(spark, sf_dir, only=None):
    return payload.staged_union(postings(spark, sf_dir), only)


def cleaned(spark, sf_dir, *only):
    """Cleaned postings; of the columns that are made, those named (all if none is)."""
    return medallion.clean(staged(spark, sf_dir, medallion.needed(only) if only else None), only or None)


def silver(spark, sf_dir, *only):
    """Silver; with ``only`` no more of its columns than those and what duplicates and rejections need."""
    return medallion.silver(postings(spark, sf_dir), only or None)


def judged(spark, sf_dir, *only):
    """Silver without what other rows say: one row for each of its rows, so that nothing is written or joined."""
    return medallion.judged(postings(spark, sf_dir), only)


def gold(spark, sf_dir, *only):
    return medallion.gold(postings(spark, sf_dir), only or None)


def silver_py(spark, sf_dir):
    return quality.evaluate(medallion.standardize_py(medallion.clean_py(postings(spark, sf_dir))), py=True)


# -- staging and fields -------------------------------------------------------


@query("{chain} select * from staged")
def stg_union_canonical(spark, sf_dir):
    return staged(spark, sf_dir)


@query("select event_id, cast(props ->> '$.k' as bigint) as k from events")
def payload_path_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("{chain} select raw_id, title, saudi_national_only from cleaned")
def clean_title(spark, sf_dir):
    return cleaned(spark, sf_dir, "title", "saudi_national_only").select("raw_id", "title", "saudi_national_only")


@query("{chain} select raw_id, company_name from cleaned")
def clean_company(spark, sf_dir):
    return cleaned(spark, sf_dir, "company_name").select("raw_id", "company_name")


@query()
def clean_company_py(spark, sf_dir):
    return staged(spark, sf_dir, ("company_raw",)).select("raw_id", P.clean_company_py(F.col("company_raw")).alias("company_name"))


@query("{chain} select raw_id, location_city, location_country from cleaned")
def parse_location(spark, sf_dir):
    return cleaned(spark, sf_dir, "location_city", "location_country").select("raw_id", "location_city", "location_country")


@query("{chain} select raw_id, job_fingerprint from printed")
def fingerprint3(spark, sf_dir):
    return cleaned(spark, sf_dir, "job_fingerprint").select("raw_id", "job_fingerprint")


@query("{chain} select raw_id, case when source_name = 'careerjet' then job_fingerprint else sha256(coalesce(upper(trim(title)), 'NULL') || '|' || coalesce(upper(trim(company_name)), 'NULL') || '|' || coalesce(upper(trim(location_city)), 'NULL') || '|' || coalesce(cast(posting_date as varchar), 'NULL')) end as job_fingerprint from printed")
def fingerprint4(spark, sf_dir):
    dated = ~F.col("source_name").isin(*medallion.SOURCES_WITHOUT_DATE)
    made = P.fingerprint(F.col("title"), F.col("company_name"), F.col("location_city"), F.col("posting_date").cast("string"), dated)
    return cleaned(spark, sf_dir, *medallion.PRINTED, "posting_date").select("raw_id", made.alias("job_fingerprint"))


@query("{chain} select raw_id, career_level from standardized")
def career_level(spark, sf_dir):
    return medallion.standardize(cleaned(spark, sf_dir, "career_level_raw"), ["career_level"]).select("raw_id", "career_level")


@query("{chain} select raw_id, case when regexp_matches(career_level_raw, 'vp\\b', 'i') and career_level = 'Unspecified' then 'Executive' else career_level end as career_level from standardized")
def career_level_py(spark, sf_dir):
    return cleaned(spark, sf_dir, "career_level_raw").select("raw_id", P.career_level(F.col("career_level_raw"), py=True).alias("career_level"))


@query("{chain} select raw_id, cast(salary_min as double) as salary_min, cast(salary_max as double) as salary_max, salary_currency, salary_period from standardized")
def salary_parse(spark, sf_dir):
    d = medallion.standardized(postings(spark, sf_dir), list(P.salary(F.col("salary_raw"))))
    return d.select("raw_id", F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"), "salary_currency", "salary_period")


_PY_SALARY = P.SALARY_PY.removeprefix("(?iU)")


@query(
    "{chain}, g as (select raw_id, regexp_extract(salary_raw, '" + _PY_SALARY + "', ['s', 'c', 'lo', 'hi', 'p', 'q'], 'i') as m, "
    "salary_raw is not null and lower(trim(salary_raw)) not in ('negotiable','undisclosed','competitive','tbd','n/a','na') and regexp_matches(salary_raw, '[\\d,]+') as ok from staged) "
    "select raw_id, case when ok then try_cast(replace(m.lo, ',', '') as double) end as salary_min, case when ok then try_cast(nullif(replace(m.hi, ',', ''), '') as double) end as salary_max, "
    "case when ok then case m.s when '$' then 'USD' when '£' then 'GBP' when '€' then 'EUR' else coalesce(nullif(upper(m.c), ''), 'SAR') end end as salary_currency, "
    "case when ok then case lower(m.p || m.q) when 'month' then 'monthly' when 'year' then 'annual' when 'annual' then 'annual' when 'hour' then 'hourly' else 'unspecified' end end as salary_period from g"
)
def salary_parse_py(spark, sf_dir):
    return staged(spark, sf_dir, ("salary_raw",)).select("raw_id", *[c.alias(n) for n, c in P.salary_py(F.col("salary_raw")).items()])


@query("{chain} select raw_id, out_of_region from standardized")
def out_of_region(spark, sf_dir):
    return medallion.standardize(cleaned(spark, sf_dir, "location_country"), ["out_of_region"]).select("raw_id", "out_of_region")


# -- duplicates ---------------------------------------------------------------


@query("{chain} select raw_id, is_duplicate, duplicate_of_raw_id from deduplicated")
def dedup_first_by_fp(spark, sf_dir):
    keys = stage(cleaned(spark, sf_dir, "job_fingerprint").select("raw_id", "collected_at", "job_fingerprint"), "keys")  # read twice, cleaned once
    return dedup.first_by_fingerprint(keys).select("raw_id", "is_duplicate", "duplicate_of_raw_id")


@query(
    "with f as (select doc_id, sha256(coalesce(text, '')) as fp from documents) "
    "select doc_id, doc_id <> min(doc_id) over (partition by fp) as is_duplicate, nullif(min(doc_id) over (partition by fp), doc_id) as duplicate_of_raw_id from f"
)
def dedup_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp"))
    return dedup.first_by_fingerprint(d, "fp", "doc_id", "doc_id").select("doc_id", "is_duplicate", "duplicate_of_raw_id")


def _batch(spark, sf_dir):
    d = medallion.clean_py(postings(spark, sf_dir))
    return d.withColumn("ordinal", F.substring("raw_id", 5, 9).cast("bigint"))


def _history(spark, sf_dir):
    return postings(spark, sf_dir).where("run_id <> 'run-0'").withColumn("source_job_id", F.when(F.col("source_name") == "techmap", F.col("source_job_id")))


def _state(spark, sf_dir):
    """Fingerprints of the earlier runs' first postings."""
    d = medallion.clean_py(postings(spark, sf_dir)).where("run_id = 'run-1'")
    return d.groupBy(F.col("job_fingerprint").alias("fingerprint")).agg(F.min("raw_id").alias("first_raw_id"), F.lit("x").alias("source_name"), F.lit("y").alias("recorded_at"))


@query("select o_orderkey, o_orderkey % 1000 % 2 = 1 as is_duplicate, case when o_orderkey % 1000 % 2 = 1 then o_orderkey - 1 end as duplicate_of from orders")
def dedup_chain(spark, sf_dir):
    """Postings of which each shares its url with one neighbour and its fingerprint with the other, a thousand in a chain: every other one stays."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    fp = F.when(F.col("ordinal") % 1000 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), F.floor((F.col("ordinal") + 1) / 2)))
    batch = o.select(
        F.col("ordinal").cast("string").alias("raw_id"), F.lit("run-0").alias("run_id"), F.lit("jooble").alias("source_name"), F.lit("").alias("source_job_id"),
        F.concat(F.lit("u"), F.floor(F.col("ordinal") / 2)).alias("source_url"), fp.alias("job_fingerprint"), F.lit("t").alias("collected_at"), "ordinal",
    )
    none = spark.createDataFrame([], batch.schema)
    told = dedup.sequential(batch, none, spark.createDataFrame([], STATE))
    return told.select(F.col("ordinal").alias("o_orderkey"), "is_duplicate", F.col("duplicate_of_job_id").cast("bigint").alias("duplicate_of"))


@query()
def dedup_sequential(spark, sf_dir):
    batch = _batch(spark, sf_dir).where("run_id = 'run-0'")
    batch = batch.select("raw_id", "run_id", "source_name", "source_job_id", "source_url", "job_fingerprint", "ordinal")  # payloads and texts would go through every join
    return dedup.sequential(batch, _history(spark, sf_dir), _state(spark, sf_dir)).select("raw_id", "is_duplicate", "duplicate_of_job_id")


@query(
    "{chain}, firsts as (select job_fingerprint, min(raw_id) as first_raw_id from printed group by 1), state as (select job_fingerprint from printed where run_id = 'run-1') "
    "select f.job_fingerprint as fingerprint, min(p.raw_id) as first_raw_id from printed p join firsts f using (job_fingerprint) where p.run_id = 'run-0' and job_fingerprint not in (select job_fingerprint from state) group by 1"
)
def state_upsert_first_wins(spark, sf_dir):
    d = cleaned(spark, sf_dir).withColumns({"ordinal": F.substring("raw_id", 5, 9).cast("bigint"), "is_duplicate": F.lit(False)})
    state = d.where("run_id = 'run-1'").select(F.col("job_fingerprint").alias("fingerprint")).distinct()
    return dedup.new_state(d.where("run_id = 'run-0'"), state).select("fingerprint", "first_raw_id")


@query(
    "{chain} select p.raw_id, min(h.raw_id) as url_raw_id from postings p left join postings h on h.source_url = p.source_url and h.run_id <> p.run_id group by 1"
)
def late_run_lookup(spark, sf_dir):
    d = postings(spark, sf_dir)
    return dedup.with_url_of_other_run(d, d).select("raw_id", "url_raw_id")


@query("{chain} select p.raw_id, exists(select 1 from postings h where h.run_id <> 'run-0' and h.source_name = p.source_name and h.source_job_id = p.source_job_id and h.source_job_id <> '') as native_seen from postings p where run_id = 'run-0'")
def native_id_probe(spark, sf_dir):
    d = postings(spark, sf_dir)
    return dedup.with_native_id_seen(d.where("run_id = 'run-0'"), d.where("run_id <> 'run-0'")).select("raw_id", "native_seen")


# -- quality and Gold ---------------------------------------------------------


@query("{chain} select raw_id, array_to_string(list_transform(quality_flags, lambda f: f.rule), ',') as rules, array_to_string(list_transform(quality_flags, lambda f: f.severity || ':' || f.message), '; ') as messages from silver")
def quality_flags(spark, sf_dir):
    messages = F.array_join(F.transform("quality_flags", lambda f: F.concat(f["severity"], F.lit(":"), f["message"])), "; ")
    return judged(spark, sf_dir, "quality_flags").select("raw_id", quality.rule_ids().alias("rules"), messages.alias("messages"))


@query("{chain} select raw_id, is_rejected from silver")
def is_rejected(spark, sf_dir):
    return judged(spark, sf_dir, "is_rejected").select("raw_id", "is_rejected")


@query("{chain} select raw_id, rejection_reason from silver")
def rejection_reason(spark, sf_dir):
    return judged(spark, sf_dir, "rejection_reason").select("raw_id", "rejection_reason")


@query()
def quality_flags_py(spark, sf_dir):
    return silver_py(spark, sf_dir).select("raw_id", quality.rule_ids().alias("rules"), "is_rejected", "rejection_reason")


@query("{chain} select job_id, f.rule as rule_name, f.severity as severity, f.message as message from (select raw_id as job_id, unnest(quality_flags) as f from silver)")
def quality_log(spark, sf_dir):
    return quality.quality_log(judged(spark, sf_dir, "quality_flags")).select("job_id", "rule_name", "severity", "message")


@query(
    "{chain} select * exclude (quality_flags, salary_min, salary_max), cast(salary_min as double) as salary_min, cast(salary_max as double) as salary_max, array_to_string(list_transform(quality_flags, lambda f: f.rule), ',') as rules from gold"
)
def gold_fct(spark, sf_dir):
    d = medallion.gold(postings(spark, sf_dir))
    return d.withColumns({"salary_min": F.col("salary_min").cast("double"), "salary_max": F.col("salary_max").cast("double"), "rules": quality.rule_ids()}).drop("quality_flags")


@query("{chain} select raw_id, array_to_string(list_transform(quality_flags, lambda f: f.rule), ',') || case when company_name is null and location_city is null and not list_contains(list_transform(quality_flags, lambda f: f.rule), 'WARN-005') then case when len(quality_flags) > 0 then ',' else '' end || 'WARN-005' else '' end as rules from silver")
def flag_backfill(spark, sf_dir):
    both = F.col("company_name").isNull() & F.col("location_city").isNull()
    d = quality.append_flag(judged(spark, sf_dir, "quality_flags", "company_name", "location_city"), both, "WARN-005", "warning", "low-confidence fingerprint")
    return d.select("raw_id", quality.rule_ids().alias("rules"))


@query("{chain} select count(distinct raw_id) as flagged from (select raw_id, unnest(quality_flags) as f from silver) where f.rule = 'WARN-005'")
def flag_lateral_count(spark, sf_dir):
    return judged(spark, sf_dir, "quality_flags").agg(F.count_if(quality.has_rule("WARN-005")).alias("flagged"))


@query("{chain} select count(*) filter (title is null) as title_nulls, count(*) filter (source_name is null) as source_name_nulls, count(*) filter (collected_at is null) as collected_at_nulls from gold")
def tests_not_null(spark, sf_dir):
    return reports.not_null_violations(gold(spark, sf_dir, "title", "source_name"), ["title", "source_name", "collected_at"])


@query("{chain} select raw_id, count(*) as n from gold group by 1 having count(*) > 1")
def tests_unique(spark, sf_dir):
    return reports.unique_violations(gold(spark, sf_dir, "raw_id"), "raw_id")


@query("{chain} select source_name, count(*) as n from gold where source_name not in ('careerjet', 'jooble') group by 1")
def tests_accepted_values(spark, sf_dir):
    return reports.unaccepted_values(gold(spark, sf_dir, "source_name"), "source_name", ["careerjet", "jooble"])


@query(
    "{chain} select source_name, nullif(case when source_name = 'careerjet' then '' else trim(source_job_id) end, '') as source_job_id, "
    "case when source_name = 'careerjet' then sha256(coalesce(nullif(trim(upper(title_raw)), ''), 'NULL') || '|' || coalesce(nullif(trim(upper(company_raw)), ''), 'NULL') || '|' || coalesce(nullif(trim(upper(case when contains(location_raw, ',') then split_part(location_raw, ',', 1) else location_raw end)), ''), 'NULL')) end as job_fingerprint, "
    "nullif(trim(title_raw), '') as title, nullif(trim(company_raw), '') as company_name, nullif(trim(case when contains(location_raw, ',') then split_part(location_raw, ',', 1) else location_raw end), '') as location_city, "
    "case when contains(location_raw, ',') then nullif(trim(regexp_extract(location_raw, ',(.*)', 1)), '') end as location_country, "
    "case when source_name <> 'careerjet' then left(nullif(trim(posting_date_raw), ''), 10) end as posting_date, nullif(trim(source_url), '') as source_url from staged"
)
def demo_canonical9(spark, sf_dir):
    return medallion.demo_rows(staged(spark, sf_dir))


# -- reconciliation -----------------------------------------------------------


def _both_paths(spark, sf_dir):
    """Gold, and the fingerprints of the other path; both of postings that are cleaned once."""
    rows = medallion.parsed(postings(spark, sf_dir), ["source_name", "is_rejected"])
    return medallion.gold_of(rows), rows.where("source_name <> 'techmap'").select("job_fingerprint")


@query("{chain}, other as (select job_fingerprint from printed where source_name <> 'techmap') select count(*) as matched from gold join other using (job_fingerprint)")
def recon_matched(spark, sf_dir):
    return reports.matched_pairs(*_both_paths(spark, sf_dir), "job_fingerprint")


@query("{chain}, other as (select job_fingerprint from printed where source_name <> 'techmap') select raw_id from gold where job_fingerprint not in (select job_fingerprint from other)")
def recon_gold_only(spark, sf_dir):
    return reports.only_left(*_both_paths(spark, sf_dir), "job_fingerprint").select("raw_id")


# -- reports ------------------------------------------------------------------


@query("{chain} select source_name, count(*) as n from postings group by 1")
def counts_by_source(spark, sf_dir):
    return reports.counts_by(postings(spark, sf_dir), "source_name")


@query("{chain} select count(distinct source_url) as urls from postings")
def distinct_urls(spark, sf_dir):
    return postings(spark, sf_dir).agg(F.count_distinct("source_url").alias("urls"))


@query("{chain} select coalesce(location_city, '(no city)') as location_city, count(*) as n, 100.0::double * count(*) / sum(count(*)) over () as percent from cleaned group by 1")
def freq_percent(spark, sf_dir):
    return reports.frequencies(cleaned(spark, sf_dir, "location_city"), "location_city", "(no city)")


@query("{chain} select min(collected_at) as first, max(collected_at) as last, substr(max(collected_at), 1, 10) as last_day from postings")
def minmax_ts(spark, sf_dir):
    return reports.min_max(postings(spark, sf_dir), "collected_at")


_PROFILED = ["title", "company_name", "location_city", "location_country", "posting_date", "salary_raw"]


@query("{chain} " + " union all ".join(f"select '{c}' as column_name, count(*) filter ({c} is null or cast({c} as varchar) = '') as missing, count(*) filter ({c} is null or cast({c} as varchar) = '')::double / count(*) as rate from cleaned" for c in _PROFILED))
def column_profile(spark, sf_dir):
    return reports.column_profile(cleaned(spark, sf_dir), _PROFILED)


@query("{chain} select count(*) filter (coalesce(source_job_id, '') <> '') as with_native_id, count(*) filter (coalesce(source_job_id, '') = '' and coalesce(job_fingerprint, '') <> '') as fingerprint_only, count(*) filter (coalesce(source_job_id, '') = '' and coalesce(job_fingerprint, '') = '') as neither from printed")
def key_coverage(spark, sf_dir):
    return reports.key_coverage(cleaned(spark, sf_dir, "job_fingerprint"))


@query("{chain} select count(*) as n, count(distinct source_url) as distinct_n, count(source_url) - count(distinct source_url) as duplicates from postings")
def dup_count(spark, sf_dir):
    return reports.duplicate_count(postings(spark, sf_dir), "source_url")


@query(
    "{chain}, f as (select coalesce(location_city, '(no city)') as value, count(*) as n from cleaned group by 1), u as (select count(*) as n, count(distinct source_url) as d, count(source_url) as k from postings) "
    "select 'city' as report, value, n, 100.0::double * n / sum(n) over () as share from f union all select 'rows', 'all', n, null from u union all select 'urls', 'distinct', d, null from u union all select 'urls', 'duplicates', k - d, null from u"
)
def reports_by_run(spark, sf_dir):
    """Frequencies and duplicate counts merged from what each run added, the last run twice; no posting is read again."""
    from ..operators import run_totals
    from ..session import scratch

    rows, root = stage(cleaned(spark, sf_dir, "location_city").select("run_id", "source_url", "location_city"), "totals"), scratch(spark, "totals")
    for run in ("run-0", "run-1", "run-2", "run-2"):
        run_totals.add_run(run, rows.where(F.col("run_id") == run), root, ["location_city"], ["source_url"])
    cities = run_totals.frequencies(spark, root, "location_city", "(no city)").select(F.lit("city").alias("report"), F.col("location_city").alias("value"), "n", F.col("percent").alias("share"))
    counts = run_totals.duplicate_count(spark, root, "source_url")
    told = F.inline(F.array(*[F.struct(F.lit(r).alias("report"), F.lit(v).alias("value"), F.col(c).alias("n")) for r, v, c in (("rows", "all", "n"), ("urls", "distinct", "distinct_n"), ("urls", "duplicates", "duplicates"))]))
    return cities.unionByName(counts.select(told).withColumn("share", F.lit(None).cast("double")))


@query("{chain} select raw_id, (title is null)::int + (company_name is null)::int + (location_city is null)::int as missing from cleaned")
def row_null_count(spark, sf_dir):
    return cleaned(spark, sf_dir, *medallion.PRINTED).select("raw_id", quality.missing_parts().alias("missing"))


@query("{chain} select run_id, min(collected_at) as started_at from postings group by run_id order by started_at desc, run_id desc limit 1")
def latest_run(spark, sf_dir):
    return reports.latest_run(postings(spark, sf_dir).groupBy("run_id").agg(F.min("collected_at").alias("started_at")))


@query("{chain} select raw_id, collected_at from postings order by collected_at desc, raw_id limit 5")
def recent_5(spark, sf_dir):
    return reports.most_recent(postings(spark, sf_dir).select("raw_id", "collected_at"), "collected_at", "raw_id", 5)


@query("{chain} select title, count(*) as n from cleaned group by 1 order by n desc, title nulls first limit 10")
def top_k_freq(spark, sf_dir):
    return reports.top_k(cleaned(spark, sf_dir, "title"), "title", 10)


@query("{chain} select raw_id, run_id from postings where run_id = 'run-1'")
def run_scan(spark, sf_dir):
    return files.of_run(postings(spark, sf_dir), "run-1").select("raw_id", "run_id")


@query("{chain} select raw_id from postings where run_id like 'run-2%'")
def run_prefix_scan(spark, sf_dir):
    return files.of_run_prefix(postings(spark, sf_dir), "run-2").select("raw_id")


@query("{chain} select run_id, case when run_id = 'run-1' then '2026-09-09' end as completed_at from postings group by 1")
def run_completion(spark, sf_dir):
    from ..operators.sinks import complete_run

    runs = postings(spark, sf_dir).select("run_id").distinct().withColumn("completed_at", F.lit(None).cast("string"))
    return complete_run(runs, "run-1", F.lit("2026-09-09"))


@query("{chain} select raw_id from postings where run_id = 'run-2'")
def append_ignore(spark, sf_dir):
    d = postings(spark, sf_dir).select("raw_id", "run_id")
    return dedup.append_new(d.where("run_id <> 'run-2'"), d).select("raw_id")


@query("{chain} select raw_id, cast(salary_min as decimal(15,2)) as salary_min, cast(salary_max as decimal(15,2)) as salary_max from gold")
def loadable_rows(spark, sf_dir):
    from ..operators.sinks import loadable

    return loadable(silver(spark, sf_dir, "salary_min", "salary_max"))[0].select("raw_id", "salary_min", "salary_max")


@query("select o_orderkey, o_orderkey * 10 + unnest([1, 2]) as item from orders")
def nested_lists(spark, sf_dir):
    """Rows of API answers of several shapes, wherever the list of objects stands in them."""
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey"))
    rows = F.concat(F.lit('[{"id":'), F.col("o_orderkey") * 10 + 1, F.lit('},{"id":'), F.col("o_orderkey") * 10 + 2, F.lit("}]"))
    shapes = [
        ('{"tags":["a","b"],"data":', "}"), ('{"data":{"n":[1,2],"jobs":', '},"errors":[{"e":1}]}'), ('{"status":"ok","meta":{"x":{"rows":', "}}}"),
        ('{"data":{"other":', '},"aa":[[{"id":0}]],"errors":[{"e":1}]}'), ('{"results":', ',"data":{}}'), ("", ""),
    ]
    answer = F.coalesce(*[F.when(F.col("o_orderkey") % len(shapes) == i, F.concat(F.lit(a), rows, F.lit(b))) for i, (a, b) in enumerate(shapes)])
    found = o.select("o_orderkey", F.explode(files.nested_rows(answer)).alias("row"))
    return found.select("o_orderkey", F.try_variant_get("row", "$.id", "bigint").alias("item"))


@query("{chain} select raw_id, run_id, (select count(distinct run_id) from postings) as runs from postings")
def committed_runs(spark, sf_dir):
    """Runs and their rows appended in one step each, one of them twice, the second with rows of the first: no row is there twice."""
    from ..operators.publishing import append_run, read_published
    from ..schemas import RUNS
    from ..session import scratch

    raw = stage(postings(spark, sf_dir), "raw")
    root, schema = scratch(spark, "jobs"), "raw_id string, run_id string"
    for run in ("run-0", "run-1", "run-1", "run-2"):
        rows = raw.where(F.col("run_id").isin("run-0", "run-1") if run == "run-1" else F.col("run_id") == run).select("raw_id", "run_id")
        head = files.run_row(raw.where(F.col("run_id") == run), run, "all", "collected_at")
        append_run(spark.createDataFrame(head.collect(), RUNS), rows, root)  # one row
    runs = read_published(spark, root, "collection_runs", RUNS)
    return read_published(spark, root, "raw_jobs", schema).withColumn("runs", runs.agg(F.count("*")).scalar())


@query(
    "{chain} select raw_id, run_id, case when run_id = 'run-1' and source_name = 'jooble' then 'WARN-005' end as flag from postings where not (run_id = 'run-2' and source_name = 'tanqeeb')"
)
def run_changes(spark, sf_dir):
    """A flag added to some rows of one run and some rows of another deleted in a partitioned table: only those runs are rewritten."""
    from ..operators.publishing import change_partitions
    from ..session import scratch

    path = scratch(spark, "jobs")
    rows = postings(spark, sf_dir).select("raw_id", "source_name", F.lit(None).cast("string").alias("flag"), "run_id")
    rows.write.partitionBy("run_id").parquet(path)
    change_partitions(spark, path, (F.col("run_id") == "run-1") & (F.col("source_name") == "jooble"), lambda d: d.withColumn("flag", F.lit("WARN-005")))
    change_partitions(spark, path, (F.col("run_id") == "run-2") & (F.col("source_name") == "tanqeeb"), lambda d: d.limit(0))
    return spark.read.schema(rows.schema).parquet(path).select("raw_id", "run_id", "flag")


@query(
    "{chain}, told as (select raw_id, job_fingerprint, first_value(raw_id) over (partition by job_fingerprint order by run_id, raw_id) as first_id from printed where job_fingerprint <> '') "
    "select raw_id, raw_id <> first_id as is_duplicate, nullif(first_id, raw_id) as duplicate_of_raw_id from told"
)
def first_writer_stream(spark, sf_dir):
    """Postings as a stream of one batch for each run: the first writer of a fingerprint is kept in the state store."""
    from ..session import scratch
    from ..streaming.first_writer import first_writers

    rows = stage(cleaned(spark, sf_dir, "job_fingerprint").select("raw_id", "run_id", "source_name", "collected_at", "job_fingerprint"), "writes")
    rows = rows.withColumn("ordinal", F.substring("raw_id", 5, 9).cast("bigint"))
    source, out, checkpoint = (scratch(spark, k) for k in ("writes-in", "writes-out", "writes-checkpoint"))
    for run in ("run-0", "run-1", "run-2"):
        rows.where(F.col("run_id") == run).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        first_writers(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out).select("raw_id", "is_duplicate", "duplicate_of_raw_id")


# -- sets ---------------------------------------------------------------------


@query("select lang as v, count(*) as n from (select lang from documents union all select source from documents) group by 1")
def bag_concat(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return sets.concatenate(d.select(F.col("lang").alias("v")), d.select(F.col("source").alias("v"))).groupBy("v").agg(F.count("*").alias("n"))


@query("select user_id, array_to_string(list(event_type order by first), ',') as types, sum(n)::bigint as n from (select user_id, event_type, min(struct_pack(ts := ts, id := event_id)) as first, count(*) as n from events group by 1, 2) group by 1")
def ordered_distinct(spark, sf_dir):
    every = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    ordered = read(spark, sf_dir, "events").groupBy("user_id").agg(every.alias("e"))
    return ordered.select("user_id", F.array_join(sets.ordered_distinct(F.transform("e", lambda x: x["event_type"])), ",").alias("types"), F.size("e").cast("bigint").alias("n"))


@query("select distinct user_id + 1400 as user_id from events where user_id + 1400 not in (select o_custkey from orders)")
def id_set_diff(spark, sf_dir):
    ids = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return sets.difference(read(spark, sf_dir, "events").select((F.col("user_id") + 1400).alias("user_id")), ids, "user_id")


@query("{chain} select key, count(*) as n from (select unnest(json_keys(raw_payload)) as key from postings) group by 1")
def key_union(spark, sf_dir):
    return sets.key_union(postings(spark, sf_dir), "raw_payload")


@query("{chain} select raw_id, case when raw_payload ->> '$.title' <> '' then raw_payload ->> '$.title' else nullif(raw_payload ->> '$.job_title', '') end as first_title from postings")
def first_truthy(spark, sf_dir):
    return postings(spark, sf_dir).select("raw_id", F.coalesce(payload.text("title"), payload.text("job_title")).alias("first_title"))


# -- pages and crawl ----------------------------------------------------------


@query("select page_id, array_to_string(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)).list_sort(), ' ') as links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as n from pages")
def page_ids(spark, sf_dir):
    found = html.links(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(found), " ").alias("links"), F.size(found).cast("bigint").alias("n"))


@query("select page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') as title from pages")
def page_title_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.element_text(F.col("html"), "h1").alias("title"))


@query()
def page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.plain_text(F.col("html")).alias("text"))


@query()
def page_kv(spark, sf_dir):
    return html.details(spread(read(spark, sf_dir, "pages").select("page_id", "html")), "html", ("page_id",))


@query("select page_id, regexp_extract(url, '/(\\d+)', 1) as native_id from pages")
def page_native_id(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("native_id"))


@query(
    "with recursive edges as (select o_custkey as src, (o_orderkey * 7 + o_custkey) % 1500 as dst from orders), walk(node, depth) as (select 1::bigint, 0 union select dst, depth + 1 from walk join edges on src = node where depth < 2) "
    "select node, min(depth) as depth from walk group by 1"
)
def frontier_bfs(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.expr("(o_orderkey * 7 + o_custkey) % 1500").alias("dst"))
    seeds = spark.range(1).select(F.lit(1).cast("bigint").alias("node"))
    return crawl.reachable(seeds, edges, depth=2, most=None)


@query("with s as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as first_key from orders) select o_orderkey, rank, first_key from s")
def window_first_value(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"), F.first("o_orderkey").over(whole).alias("first_key"))


@query("select doc_id, nullif(trim(source), '') as source, left(text, 10) as head from documents")
def blank_and_head(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", blank_to_null(F.trim("source")).alias("source"), F.left("text", F.lit(10)).alias("head"))


def _detail_pages(spark, sf_dir):
    spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).createOrReplaceTempView("orders")
    spark.sql(FACTS).createOrReplaceTempView("facts")
    return spark.sql(PAGES)


_PAY = "case when pay = 8 then '5000 a month' when shape = 0 then null when pay < 3 then low || '-' || high || ' SAR' when pay < 5 then low || ' SAR' end"


@query(
    f"with facts as ({FACTS}) select id, title, company, city, posting_date, employment_type, work_mode, experience, gender, {_PAY} as salary, "
    "case when shape <> 0 and id % 2 = 0 then about else about || ' & more' end as job_description from facts"
)
def page_details(spark, sf_dir):
    names = ("title", "company", "city", "posting_date", "employment_type", "work_mode", "experience", "gender", "salary", "job_description")
    return html.details(_detail_pages(spark, sf_dir), "html", ("id",)).select("id", *names)


@query(
    f"with facts as ({FACTS}) select id, title || '(m/f)' as title, company, city, about || chr(10) || 'one' || chr(10) || 'two & three' || chr(10) || 'end' as job_description, coalesce(experience, 'none') as experience, "
    "'a & b, c, d' as required_skills, '/apply/' || id as apply_path, 'Riyadh' || chr(10) || city as sites, 2 as n_sites from facts"
)
def page_nested(spark, sf_dir):
    """Fields of pages whose elements hold elements of the same name."""
    names = ("title", "company", "city", "job_description", "experience", "required_skills", "apply_path")
    spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).createOrReplaceTempView("orders")
    spark.sql(FACTS).createOrReplaceTempView("facts")
    pages = spark.sql(NESTED_PAGES)
    found = html.details(pages, "html", ("id",), {"sites": "site"})
    return found.select("id", *names, F.array_join("sites", "\n").alias("sites"), F.size("sites").alias("n_sites"))


@query(
    "select cast(floor(o_orderkey / 100) as bigint) as page, array_to_string(list_sort(list_distinct(list(lpad(cast(o_orderkey as varchar), 9, '0')))), ',') as seeds, "
    "array_to_string(list_sort(list_distinct(list_concat(list(cast(o_orderkey as varchar)), list(cast(o_orderkey % 50 as varchar))))), ',') as links from orders group by 1"
)
def page_seeds(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    found = {"seeds": html.seed_ids(F.col("html")), "links": html.link_ids(F.col("html"))}
    return spark.sql(LISTINGS).select("page", *[F.array_join(F.array_sort(c), ",").alias(n) for n, c in found.items()])


@query(
    f"with recursive facts as ({FACTS}), edges as (select id as src, (id * 3 + 1) % 400 as dst from facts union select id, (id * 5 + 2) % 400 from facts), "
    "walk(node, depth) as (select unnest([1, 7, 33])::bigint, 0 union select dst, depth + 1 from walk join edges on src = node where depth < 2), "
    "capped as (select node, min(depth) as depth from walk group by 1 order by 2, 1 limit 12) select id, depth, title from capped join facts on id = node"
)
def crawl_scan(spark, sf_dir):
    front = spark.range(1).select(F.lit('<a data-job-id="7">x</a><a href="/j/01.html">1</a><a href="/j/033.html">2</a><a href="/j/01.html">3</a>').alias("html"))
    pages = _detail_pages(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    found = crawl.scan(front, pages, depth=2, most=12, order=F.col("node").cast("bigint"))
    return found.select(F.col("id").cast("bigint").alias("id"), "depth", "title")


# -- loads, layers and guards -------------------------------------------------


@query(
    "{chain} select 'postings' as layer, count(*) as n from postings union all select 'staged', count(*) from staged union all select 'silver', count(*) from silver union all select 'gold', count(*) from gold"
)
def layer_counts(spark, sf_dir):
    raw = postings(spark, sf_dir)
    rows = medallion.parsed(raw, ["is_rejected"])  # parsed once for both layers
    return reports.layer_counts({"postings": raw, "staged": payload.known(raw), "silver": medallion.silver_of(rows), "gold": medallion.gold_of(rows)})


@query("{chain}, w as (select * from silver where not is_rejected and not is_duplicate) select count(*) as expected, count(*) as loaded, 0::bigint as failed, count(*) as stored, true as agrees from w")
def load_check(spark, sf_dir):
    from ..operators.sinks import load
    from ..session import scratch

    return load(silver(spark, sf_dir, "salary_min", "salary_max").select("raw_id", "salary_min", "salary_max", "is_rejected", "is_duplicate"), scratch(spark, "load"))


@query(
    "{chain}, w as (select raw_id, substr(raw_id, 5)::bigint % 7 = 0 as broken from silver where not is_rejected and not is_duplicate) "
    "select count(*) as expected, count(*) filter (not broken) as loaded, count(*) filter (broken) as failed, count(*) filter (not broken) as stored, true as agrees from w"
)
def load_failures(spark, sf_dir):
    """A load in which every seventh posting's salary doesn't fit its column: those rows are set aside, the others are loaded."""
    from ..operators.sinks import load
    from ..session import scratch

    broken = F.substring("raw_id", 5, 9).cast("bigint") % 7 == 0
    rows = silver(spark, sf_dir, "salary_min", "salary_max").select("raw_id", F.when(broken, F.lit(1e15)).otherwise(F.col("salary_min").cast("double")).alias("salary_min"), "salary_max", "is_rejected", "is_duplicate")
    return load(rows, scratch(spark, "load"))


@query(
    "{chain} select run_id, count(*) - count(distinct source_url) as duplicates, count(distinct source_url) - count(distinct source_url) filter (source_job_id = '') as loaded, count(distinct source_url) filter (source_job_id = '') as failed from postings group by 1"
)
def run_reports(spark, sf_dir):
    counts = postings(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("fetched"), F.count_distinct("source_url").alias("stored"), F.count_distinct(F.when(F.col("source_job_id") == "", F.col("source_url"))).alias("failed"))
    return counts.select("run_id", reports.run_report(F.col("fetched"), F.col("stored"), F.col("failed")).alias("r")).select("run_id", "r.duplicates", "r.loaded", "r.failed")


@query("select distinct source from documents where source not in ('src0', 'src1')")
def unexpected_names(spark, sf_dir):
    return reports.unexpected(read(spark, sf_dir, "documents"), ["src0", "src1"], "source")


@query("{chain} select count(*) as n, count(*) as keys, 0::bigint as null_keys from gold")
def tests_surrogate(spark, sf_dir):
    d = medallion.with_surrogates(medallion.gold(postings(spark, sf_dir)))
    return d.agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("keys"), F.count_if(F.col("job_id").isNull()).alias("null_keys"))


@query("{chain} select raw_id, run_id from postings where run_id = (select run_id from postings group by 1 order by min(collected_at) desc, run_id desc limit 1)")
def latest_run_scan(spark, sf_dir):
    d = postings(spark, sf_dir).select("raw_id", "run_id", "collected_at")
    runs = d.groupBy("run_id").agg(F.min("collected_at").alias("started_at"))
    return files.of_latest_run(d, runs).select("raw_id", "run_id")


@query("{chain} select raw_id, title from cleaned order by raw_id limit 3")
def first_3(spark, sf_dir):
    return reports.first_rows(cleaned(spark, sf_dir, "title").select("raw_id", "title"), "raw_id", 3)


@query("{chain} select source_name, count(*) as n from gold group by 1")
def view_counts(spark, sf_dir):
    raw = postings(spark, sf_dir)
    medallion.create_views(raw, medallion.parsed(raw))
    return spark.sql("select source_name, count(*) as n from fct_jobs group by source_name")
