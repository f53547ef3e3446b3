"""A deterministic Bronze table of postings over the star-schema test tables, in SQL that Spark and DuckDB both run.

One source for each remainder of the order key; dirt (qualifiers, suffixes, odd places, salaries,
missing values, repeated urls, long titles, stale dates) by other remainders.
"""

POSTINGS = """
with base as (
    select o_orderkey as k, o_custkey as c, cast(cast(o_orderdate as date) as string) as d,
        case o_orderkey % 4 when 0 then 'careerjet' when 1 then 'jooble' when 2 then 'tanqeeb' else 'techmap' end as source_name
    from orders
),
facts as (
    select k, c, d, source_name,
        case k % 11 when 0 then 'Senior Software Engineer' when 1 then 'Sales Manager' when 2 then 'Fresh Graduate - Accounting' when 3 then 'Mid-Level Java Developer'
            when 4 then 'Executive Director' when 5 then 'SVP Sales' when 6 then 'CASHIER' when 7 then 'Head of Engineering' when 8 then 'Marketing Intern'
            when 9 then 'Sr. Data Analyst' else 'Nurse' end as role,
        case c % 9 when 0 then 'INTERNATIONAL TRADING CORPORATION' when 1 then 'AECOM' when 2 then 'Foo Intl.' when 3 then 'Acme Solutions LLC' when 4 then 'X Co., Ltd'
            when 5 then 'Global Mgmt Services' when 6 then '' when 7 then 'o''neil al-faisal grp' else 'Costco' end as firm,
        case k % 12 when 0 then 'Riyadh, Saudi Arabia' when 1 then 'الرياض, Saudi Arabia' when 2 then 'Jedda, Saudi Arabia' when 3 then 'Dammam, KSA' when 4 then 'Riyadh'
            when 5 then 'Saudi Arabia' when 6 then 'Dammam, Ash Sharqiyah' when 7 then 'Al Khubar, Ash Sharqiyah - Riyadh' when 8 then 'Yanbu'' al bahr, Al Madinah'
            when 9 then 'Cairo, Egypt' when 10 then '' else ', X' end as place,
        case k % 7 when 0 then 'Riyadh' when 1 then 'jiddah' when 2 then '' when 3 then 'Al Qurayyat' when 4 then 'MAKKAH' when 5 then 'Diriyah' else 'hail' end as city,
        case k % 5 when 0 then 'Saudi Arabia' when 1 then '' when 2 then 'Egypt' when 3 then 'ksa' else 'Al Jawf' end as country,
        case k % 10 when 0 then '10000 - 16000 per month' when 1 then '95000 per year' when 2 then '$4000 per month' when 3 then 'SAR 5000 / month' when 4 then '8000'
            when 5 then 'Negotiable' when 6 then '' when 7 then '9000 - 5000 per month' when 8 then 'Up to 5000' else '12,500 per hour' end as salary
    from base
),
named as (
    select k, c, d, source_name, firm, place, city, country, salary,
        case when k % 97 = 0 then repeat('Very Long Title ', 20) when k % 13 = 0 then role || ' (SAUDI NATIONAL)' when k % 13 = 1 then 'Saudi Nationals Only - ' || role
            when k % 13 = 2 then '' when k % 13 = 3 then role || '   Team  ' || cast(c % 20 as string) when k % 13 = 4 then role || ' متاح للسعوديين'
            else role || ' ' || cast(c % 20 as string) end as title,
        'https://jobs.example/' || source_name || '/' || cast(case when k % 23 = 0 then k % 46 else k end as string) as url,
        '2026-09-0' || cast(1 + k % 7 as string) || 'T00:00:00+00:00' as collected
    from facts
)
select 'raw-' || lpad(cast(k as string), 9, '0') as raw_id,
    'run-' || cast(k % 3 as string) as run_id,
    source_name,
    case when source_name = 'careerjet' then null when k % 59 = 0 then '' else 'id' || cast(k as string) end as source_job_id,
    case when k % 101 = 0 then null else url end as source_url,
    case source_name
        when 'careerjet' then '{"title":"' || title || '","company":"' || firm || '","locations":"' || place || '","description":"About ' || title || '","salary":"' || salary || '","date":"' || collected || '","url":"' || url || '","site":"x"}'
        when 'jooble' then '{"title":"' || title || '","company":"' || firm || '","location":"' || city || '","snippet":"<b>x</b>","salary":"' || case when k % 2 = 0 then 'null' else '' end || '","updated":"' || d || 'T08:00:00.0000000","id":' || cast(k as string) || ',"link":"' || url || '"}'
        when 'tanqeeb' then '{"job_title":"' || title || '","company":"' || firm || '","city":' || case when city = '' then 'null' else '"' || city || '"' end || ',"country":"' || country || '","job_description":"","salary":"' || salary || '","posting_date":"' || d || '","scraped_at":"' || collected || '"}'
        else '{"title":"' || title || '","company":"' || firm || '","city":"' || city || '","country":"' || country || '","date_created":"' || d || 'T02:20:00Z","has_salary":false}'
    end as raw_payload,
    collected as collected_at
from named
"""
