"""Bronze to Gold: stages that add columns, composed into one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import postings as P
from ..functions.text import blank_to_null, evaluated
from ..operators import dedup, quality
from ..schemas import GOLD
from ..session import stage
from ..sources import payload

#: Sources whose date is when they were asked, not when a posting appeared.
SOURCES_WITHOUT_DATE = ("careerjet",)


#: What a fingerprint is made of.
PRINTED = ("title", "company_name", "location_city")


def clean(staged: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """The cleaned columns and the fingerprint, or those of them that ``only`` names: unused ones behind the border of ``evaluated`` would be computed."""
    wanted = lambda name: only is None or name in only or ("job_fingerprint" in only and name in PRINTED)
    parts = _parts(staged, wanted)
    city, country = P.parse_location(F.col("location_raw"), (F.col("_first"), F.col("_second")))
    made = {
        "title": P.clean_title(F.col("title_raw")),
        "saudi_national_only": P.national_only(F.col("title_raw")),
        "company_name": P.clean_company(F.col("company_raw"), F.col("_bare")),
        "location_city": city,
        "location_country": country,
        "posting_date": F.col("posting_date_raw").try_cast("date"),
        "career_level_raw": F.col("title_raw"),
    }
    out = evaluated(parts, {name: c for name, c in made.items() if wanted(name)}).drop("_suffixless", "_bare", "_primary", "_first", "_second")
    out = out.withColumnRenamed("company_raw", "company_name_raw").drop("posting_date_raw")
    return evaluated(out, {"job_fingerprint": P.fingerprint(*map(F.col, PRINTED))}) if wanted("job_fingerprint") else out


def _parts(staged: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
    """``staged`` with the texts that cleaned columns read several times, some in branches that share nothing, as columns: made once for a row."""
    if wanted("company_name"):
        staged = staged.withColumn("_suffixless", P.without_suffix(F.col("company_raw"))).withColumn("_bare", P.expanded(F.col("_suffixless")))
    if wanted("location_city") or wanted("location_country"):
        first, second = P.place_parts(F.col("_primary"))
        staged = staged.withColumn("_primary", P.primary_place(F.col("location_raw"))).withColumns({"_first": first, "_second": second})
    return staged


def standardize(cleaned: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """The standardized columns, or those of them that ``only`` names."""
    made = {"career_level": P.career_level(F.col("career_level_raw")), **P.salary(F.col("salary_raw")), "out_of_region": P.out_of_region(F.col("location_country"))}
    return evaluated(cleaned, {name: c for name, c in made.items() if only is None or name in only})


#: What columns are made of, as far as it isn't itself a column that every posting has.
MADE_OF = {
    "quality_flags": (*quality.REJECTING, "location_country", "company_name", "location_raw", "career_level", "posting_date", "location_city"),
    "is_rejected": quality.REJECTING, "rejection_reason": quality.REJECTING, "job_fingerprint": PRINTED,
    "career_level": ("career_level_raw",), "out_of_region": ("location_country",), **dict.fromkeys(("salary_min", "salary_max", "salary_currency", "salary_period"), ("salary_raw",)),
    "title": ("title_raw",), "saudi_national_only": ("title_raw",), "career_level_raw": ("title_raw",), "company_name": ("company_raw",), "company_name_raw": ("company_raw",),
    "location_city": ("location_raw",), "location_country": ("location_raw",), "posting_date": ("posting_date_raw",),
}


def needed(only: Collection[str]) -> set[str]:
    """The columns and all that they are made of."""
    found, new = set(), set(only)
    while new:
        found |= new
        new = {x for name in new for x in MADE_OF.get(name, ())} - found
    return found


def standardized(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """All postings, mapped, cleaned and standardized; lazy. Of the columns those that ``only`` needs (all if it is None)."""
    names = None if only is None else needed(only)
    return standardize(clean(payload.staged_union(raw, names), names), names)


def judged(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """The same with what the rules say, which doesn't hang on other rows; lazy."""
    return quality.evaluate(standardized(raw, only), only=only)


#: What finding originals reads.
_KEYS = ("raw_id", "collected_at", "job_fingerprint")


def parsed(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Judged postings, written to the shared folder: what reads them more than once doesn't parse and clean again.

    With ``only`` they have the columns that it names, those that duplicates are found by and is_rejected. All work on
    rows is done before, in tasks of a bounded number of rows; what follows are joins.
    """
    if only is None:
        return stage(judged(raw), "standardized")
    kept = {*only, *_KEYS, "is_rejected"} - {"is_duplicate", "duplicate_of_raw_id"}
    rows = judged(raw, kept)
    return stage(rows.select(*[c for c in rows.columns if c in kept]), "standardized")


def silver_of(rows: DataFrame) -> DataFrame:
    """Judged postings with their duplicates; none is dropped. Reads ``rows`` twice: for the originals and for all."""
    found = dedup.first_by_fingerprint(rows)
    return found.select(*[c for c in found.columns if c not in quality.JUDGED], *[c for c in quality.JUDGED if c in found.columns])


def gold_of(rows: DataFrame) -> DataFrame:
    """Of judged postings the curated ones: neither duplicate nor rejected; those of Gold's columns that ``rows`` has."""
    kept = dedup.originals(rows, rows.where(~F.col("is_rejected")))
    return kept.select(*[c for c in GOLD if c in kept.columns])


def silver(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    return silver_of(parsed(raw, only))


def gold(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    return gold_of(parsed(raw, only))


def with_surrogates(curated: DataFrame) -> DataFrame:
    """Gold as written: a random key first, the time of processing last."""
    return curated.select(F.uuid().alias("job_id"), *GOLD, F.current_timestamp().alias("processed_at"))


def clean_py(raw: DataFrame) -> DataFrame:
    """The row-at-a-time path's cleaning: one list of payload keys, acronyms kept, four-part fingerprints."""
    df = payload.generic(raw)
    has_date = ~F.col("source_name").isin(*SOURCES_WITHOUT_DATE)
    city, country = P.parse_location(blank_to_null(F.col("location_raw")))
    df = evaluated(df, {
        "title": P.clean_title(F.col("title_raw")),
        "saudi_national_only": P.national_only(F.col("title_raw")),
        "company_name": P.clean_company_py(F.col("company_raw")),
        "location_city": blank_to_null(city),
        "location_country": country,
        "posting_date": F.when(has_date, F.col("posting_date_raw")),
        "career_level_raw": F.col("title_raw"),
    })
    made = P.fingerprint(F.col("title"), F.col("company_name"), F.col("location_city"), F.col("posting_date_raw"), has_date)
    return evaluated(df, {"job_fingerprint": made}).withColumnRenamed("company_raw", "company_name_raw")


def standardize_py(cleaned: DataFrame) -> DataFrame:
    return evaluated(cleaned, {"career_level": P.career_level(F.col("career_level_raw"), py=True), **P.salary_py(F.col("salary_raw")), "out_of_region": P.out_of_region(F.col("location_country"))})


def demo_rows(df: DataFrame) -> DataFrame:
    """The nine demo columns of one source's rows: split at the first comma, no aliases, blank-safe fingerprints."""
    place = blank_to_null(F.trim(F.col("location_raw")))
    comma = place.contains(",")
    city = F.when(comma, blank_to_null(F.trim(F.split_part(place, F.lit(","), F.lit(1))))).otherwise(place)
    country = F.when(comma, blank_to_null(F.trim(F.regexp_extract(place, r"(?s),(.*)", 1))))
    title, company = blank_to_null(F.trim(F.col("title_raw"))), blank_to_null(F.trim(F.col("company_raw")))
    keyless = F.col("source_name").isin(*SOURCES_WITHOUT_DATE)
    return df.select(
        "source_name",
        F.when(~keyless, blank_to_null(F.trim("source_job_id"))).alias("source_job_id"),
        F.when(keyless, P.fingerprint_blank_safe(title, company, city)).alias("job_fingerprint"),
        title.alias("title"),
        company.alias("company_name"),
        city.alias("location_city"),
        country.alias("location_country"),
        F.when(~keyless, F.left(blank_to_null(F.trim("posting_date_raw")), F.lit(10))).alias("posting_date"),
        blank_to_null(F.trim("source_url")).alias("source_url"),
    )


#: Of each layer's view the relation it is made of.
VIEWS = {"stg_jobs": payload.staged_union, "int_jobs_cleaned": lambda raw: clean(payload.staged_union(raw)), "int_jobs_silver": lambda raw: silver_of(judged(raw)), "fct_jobs": lambda raw: gold_of(judged(raw))}
#: Of the views over postings that are parsed already.
VIEWS_OF_PARSED = {"int_jobs_silver": silver_of, "fct_jobs": gold_of}


def create_views(raw: DataFrame, rows: DataFrame | None = None) -> list[str]:
    """A session view for each layer over ``raw``; nothing is computed until one is read.

    Silver and Gold read postings twice. With ``rows`` (those of :func:`parsed`) they read these instead of
    parsing and cleaning ``raw`` at each reading, twice.
    """
    for name, layer in VIEWS.items():
        of_parsed = VIEWS_OF_PARSED.get(name) if rows is not None else None
        (of_parsed(rows) if of_parsed else layer(raw)).createOrReplaceTempView(name)
    return list(VIEWS)
