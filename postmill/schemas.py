"""Schemas of the relations between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bronze: one row for each posting, with an opaque payload.
RAW_JOBS = "raw_id string, run_id string, source_name string, source_job_id string, source_url string, raw_payload string, collected_at string"
#: Every source's staging relation: these columns, in this order.
CANONICAL = (
    "raw_id", "run_id", "source_name", "source_job_id", "source_url", "collected_at",
    "title_raw", "company_raw", "location_raw", "description", "salary_raw", "api_date_raw", "posting_date_raw",
)
#: Gold, without the surrogate key and the time of processing that come first and last.
GOLD = (
    "raw_id", "run_id", "source_name", "source_job_id", "source_url", "job_fingerprint", "title", "title_raw", "company_name",
    "company_name_raw", "location_city", "location_country", "location_raw", "career_level", "career_level_raw", "salary_min",
    "salary_max", "salary_currency", "salary_period", "salary_raw", "description", "posting_date", "api_date_raw",
    "saudi_national_only", "out_of_region", "is_duplicate", "duplicate_of_raw_id", "is_rejected", "rejection_reason",
    "quality_flags", "collected_at",
)
RUNS = "run_id string, started_at string, completed_at string, source_name string, records_fetched int, notes string"
STATE = "fingerprint string, first_raw_id string, source_name string, recorded_at string"
FLAG = "struct<rule:string,severity:string,message:string>"


def require_canonical(df: DataFrame) -> DataFrame:
    """Fail early if a staging relation isn't of the canonical shape."""
    if tuple(df.columns) != CANONICAL:
        raise ValueError(f"not the canonical columns: {df.columns}")
    return df
