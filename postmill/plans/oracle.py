"""The same relations as SQL for DuckDB: a chain of common table expressions over the postings."""

from __future__ import annotations

from ..functions import postings as P
from .postings_sql import POSTINGS

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TEXT = lambda key: f"nullif(raw_payload ->> '$.{key}', '')"
_AT = lambda key: f"raw_payload ->> '$.{key}'"
_PLACE = f"case when {_TEXT('city')} is not null then {_TEXT('city')} || ', ' || coalesce({_TEXT('country')}, 'Saudi Arabia') else {_TEXT('country')} end"
_BY = lambda **c: "case source_name " + " ".join(f"when '{s}' then {e}" for s, e in c.items()) + " end"


def title_case(e: str, pieces: str = "[A-Za-z]+|[^A-Za-z]+") -> str:
    return f"array_to_string(list_transform(regexp_extract_all({e}, '{pieces}'), lambda w: upper(w[1]) || lower(w[2:])), '')"


_NATIONAL = lambda lead: "|".join(rf"{lead}\(?\s*{p}\s*\)?" for p in P.NATIONALS) + "|" + P.NATIONALS_ARABIC
_BARE = f"regexp_replace(coalesce(company_raw, ''), '{P.LEGAL_SUFFIX}', '', 'gi')"
for _short, _long in P.ABBREVIATIONS.items():
    _BARE = rf"regexp_replace({_BARE}, '\b{_short}\.?\b', '{_long}', 'gi')"
_ALIASES = " ".join(f"when lower(loc_token1) = '{a}' then '{c}'" for a, c in P.CITY_ALIASES.items())
_LEVELS = " ".join(f"when regexp_matches(career_level_raw, '{p}', 'i') then '{level}'" for level, p in P.LEVELS)
_TOLD = f"(salary_raw is not null and lower(trim(salary_raw)) not in {_LIST(P.NO_SALARY)})"
_NUMBER = rf"({_TOLD} and regexp_matches(salary_raw, '[\d,]+'))"
_PARTS = "((title is null)::int + (company_name is null)::int + (location_city is null)::int)"
_FLAGS = [
    ("REQ-003", "error", "source_url is null", "'source_url is null'"),
    ("REQ-004", "error", "collected_at is null", "'collected_at is null'"),
    ("ERR-002", "error", "salary_min > salary_max", "'salary_min (' || salary_min || ') > salary_max (' || salary_max || ')'"),
    ("ERR-003", "error", "length(coalesce(title, '')) > 300", "'title length ' || length(title) || ' exceeds 300 chars'"),
    ("ERR-004", "warning", f"lower(location_country) not in {_LIST(P.HOME_CODES)}", "'location_country ''' || location_country || ''' is not Saudi Arabia'"),
    ("WARN-001", "warning", "company_name is null", "'company_name is null'"),
    ("WARN-002", "warning", "location_raw is null", "'location_raw is null'"),
    ("WARN-003", "info", "career_level = 'Unspecified'", "'career_level could not be mapped'"),
    ("WARN-004", "info", "posting_date is null", "'posting_date is null'"),
    ("WARN-005", "warning", f"{_PARTS} >= 2", f"'low-confidence fingerprint: ' || {_PARTS} || '/3 fingerprint components (title, company_name, location_city) are null/empty'"),
]
_FLAG_ARRAY = "list_filter([" + ", ".join(f"case when {c} then {{'rule': '{r}', 'severity': '{s}', 'message': {m}}} end" for r, s, c, m in _FLAGS) + "], lambda f: f is not null)"

CHAIN = rf"""
with postings as materialized ({POSTINGS}),
staged as (
    select raw_id, run_id, source_name, source_job_id, source_url, collected_at,
        {_BY(careerjet=_TEXT("title"), jooble=_TEXT("title"), tanqeeb=_TEXT("job_title"), techmap=_TEXT("title"))} as title_raw,
        {_TEXT("company")} as company_raw,
        {_BY(careerjet=_TEXT("locations"), jooble=_TEXT("location"), tanqeeb=_PLACE, techmap=_PLACE)} as location_raw,
        {_BY(careerjet=_TEXT("description"), jooble=_TEXT("snippet"), tanqeeb=_TEXT("job_description"), techmap="null")} as description,
        {_BY(careerjet=_TEXT("salary"), jooble=f"nullif({_TEXT('salary')}, 'null')", tanqeeb=_TEXT("salary"), techmap="null")} as salary_raw,
        {_BY(careerjet=_AT("date"), jooble=_AT("updated"), tanqeeb=_AT("scraped_at"), techmap=_AT("date_created"))} as api_date_raw,
        {_BY(careerjet="null", jooble=_AT("updated"), tanqeeb=_AT("posting_date"), techmap=_AT("date_created"))} as posting_date_raw
    from postings
),
tokens as (
    select *,
        regexp_matches(coalesce(title_raw, ''), '{_NATIONAL("")}', 'i') as saudi_national_only,
        nullif(trim(regexp_replace(regexp_replace(coalesce(title_raw, ''), '{_NATIONAL(chr(92) + "s*")}', '', 'gi'), '\s{{2,}}', ' ', 'g')), '') as title,
        nullif(trim({title_case(_BARE)}), '') as company_name,
        trim(split_part(coalesce(location_raw, ''), ' - ', 1)) as primary_loc
    from staged
),
split as (
    select *, trim(split_part(primary_loc, ',', 1)) as loc_token1, nullif(trim(regexp_extract(primary_loc, ',\s*(.*)', 1)), '') as loc_token2 from tokens
),
cleaned as (
    select raw_id, run_id, source_name, source_job_id, source_url, collected_at, title_raw, company_raw as company_name_raw, location_raw, description, salary_raw, api_date_raw,
        title, saudi_national_only, company_name, title_raw as career_level_raw,
        case when location_raw is null or lower(loc_token1) in {_LIST(P.COUNTRY_NAMES)} then null {_ALIASES}
            else {title_case("loc_token1", "[^ '']+|[ '']")} end as location_city,
        case when location_raw is null then null when lower(loc_token1) in {_LIST(P.COUNTRY_NAMES)} then 'Saudi Arabia' when loc_token2 is null then null
            when lower(loc_token2) in {_LIST(P.COUNTRY_NAMES + P.REGIONS)} then 'Saudi Arabia' else loc_token2 end as location_country,
        try_cast(left(posting_date_raw, 10) as date) as posting_date
    from split
),
printed as (
    select *, sha256(coalesce(upper(trim(title)), 'NULL') || '|' || coalesce(upper(trim(company_name)), 'NULL') || '|' || coalesce(upper(trim(location_city)), 'NULL')) as job_fingerprint from cleaned
),
standardized as (
    select *,
        case when career_level_raw is null then 'Unspecified' {_LEVELS} else 'Unspecified' end as career_level,
        case when {_NUMBER} then try_cast(replace(regexp_extract(salary_raw, '[\d,]+'), ',', '') as bigint) end as salary_min,
        case when {_TOLD} then try_cast(replace(regexp_extract(salary_raw, '[\d,]+\s*[-–]\s*([\d,]+)', 1), ',', '') as bigint) end as salary_max,
        case when {_NUMBER} then case when contains(salary_raw, '$') then 'USD' when contains(salary_raw, '£') then 'GBP' when contains(salary_raw, '€') then 'EUR'
            else coalesce(nullif(regexp_extract(salary_raw, '^\s*([A-Z]{{2,3}})\s*[\d,]', 1), ''), 'SAR') end end as salary_currency,
        case when {_NUMBER} then case when regexp_matches(salary_raw, 'per\s+month|/\s*month', 'i') then 'monthly' when regexp_matches(salary_raw, 'per\s+year|/\s*year|/\s*annual', 'i') then 'annual'
            when regexp_matches(salary_raw, 'per\s+hour|/\s*hour', 'i') then 'hourly' else 'unspecified' end end as salary_period,
        coalesce(lower(location_country) not in {_LIST(P.HOME_CODES)}, false) as out_of_region
    from printed
),
deduplicated as (
    select * exclude (rank, winner), rank > 1 as is_duplicate, case when rank > 1 then winner end as duplicate_of_raw_id from (
        select *, row_number() over (partition by job_fingerprint order by collected_at, raw_id) as rank, first_value(raw_id) over (partition by job_fingerprint order by collected_at, raw_id) as winner from standardized
    )
),
silver as (
    select *, {_FLAG_ARRAY} as quality_flags,
        (title is null or (source_job_id is null and job_fingerprint is null) or source_url is null or collected_at is null or length(coalesce(title, '')) > 300 or coalesce(salary_min > salary_max, false)) as is_rejected,
        case when title is null then 'REQ-001: title is null or empty' when source_job_id is null and job_fingerprint is null then 'REQ-002: no source_job_id and no job_fingerprint'
            when source_url is null then 'REQ-003: source_url is null' when collected_at is null then 'REQ-004: collected_at is null'
            when length(coalesce(title, '')) > 300 then 'ERR-003: title length > 300 chars' when salary_min > salary_max then 'ERR-002: salary_min > salary_max' end as rejection_reason
    from deduplicated
),
gold as (select * from silver where not is_duplicate and not is_rejected)
"""
