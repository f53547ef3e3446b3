"""Table-driven cases of the posting functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postmill.functions import postings as P
from postmill.functions import text as T


def apply(spark, rows, **columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()], "i").orderBy("i").drop("i").collect()]


def x():
    return F.col("x")


def test_titles(spark):
    cases = {
        "Project Manager (SAUDI NATIONAL)": ("Project Manager", True),
        "(SAUDI NATIONAL) Project Manager": ("Project Manager", True),
        "Software Engineer": ("Software Engineer", False),
        "مهندس برمجيات متاح للسعوديين": ("مهندس برمجيات", True),
        None: (None, False),
        "": (None, False),
        "Senior   Data  Engineer": ("Senior Data Engineer", False),
        "Saudi Nationals Only - Nurse": ("- Nurse", True),
    }
    assert apply(spark, list(cases), t=P.clean_title(x()), f=P.national_only(x())) == list(cases.values())


def test_companies(spark):
    cases = {
        "INTERNATIONAL TRADING CORPORATION": ("International Trading Corporation", "International Trading Corporation"),
        "AECOM": ("Aecom", "AECOM"),
        "STC Communications": ("Stc Communications", "STC Communications"),
        "Acme Solutions LLC": ("Acme Solutions", "Acme Solutions"),
        "Global Tech Ltd.": ("Global Tech", "Global Tech"),
        "ARAMCO INTL": ("Aramco International", "Aramco International"),
        "Foo Intl.": ("Foo International.", "Foo International"),
        "Costco": ("Costco", "Costco"),
        "LLC": (None, None),
        "X Co., Ltd": ("X Co.", "X Co."),
        "": (None, None),
        None: (None, None),
    }
    assert apply(spark, list(cases), a=P.clean_company(x()), b=P.clean_company_py(x())) == list(cases.values())


def test_locations(spark):
    cases = {
        "Riyadh, Saudi Arabia": ("Riyadh", "Saudi Arabia"),
        "الرياض, Saudi Arabia": ("Riyadh", "Saudi Arabia"),
        "Jedda, Saudi Arabia": ("Jeddah", "Saudi Arabia"),
        "Dammam, KSA": ("Dammam", "Saudi Arabia"),
        "Riyadh": ("Riyadh", None),
        None: (None, None),
        "Saudi Arabia": (None, "Saudi Arabia"),
        "Dammam, Ash Sharqiyah": ("Dammam", "Saudi Arabia"),
        "Al Khubar, Ash Sharqiyah - Riyadh": ("Al Khobar", "Saudi Arabia"),
        "Yanbu' al Bahr, Al Madinah": ("Yanbu' Al Bahr", "Saudi Arabia"),
        "Al Qurayyat, Al Jawf": ("Al Qurayyat", "Saudi Arabia"),
        "Cairo, Egypt": ("Cairo", "Egypt"),
    }
    city, country = P.parse_location(x())
    assert apply(spark, list(cases), a=city, b=country) == list(cases.values())


def test_salaries(spark):
    cases = {
        "10000 - 16000 per month": (10000, 16000, "SAR", "monthly"),
        "95000 per year": (95000, None, "SAR", "annual"),
        "$4000 per month": (4000, None, "USD", "monthly"),
        "SAR 5000 / month": (5000, None, "SAR", "monthly"),
        "8000": (8000, None, "SAR", "unspecified"),
        "Negotiable": (None,) * 4,
        "": (None,) * 4,
        None: (None,) * 4,
    }
    assert apply(spark, list(cases), **P.salary(x())) == list(cases.values())
    assert apply(spark, list(cases), **P.salary_py(x())) == list(cases.values())
    assert apply(spark, ["Up to 5000", ", 500"], **P.salary_py(x()))[0][2] == "TO"
    assert apply(spark, ["Up to 5000", ", 500"], **P.salary(x())) == [(5000, None, "SAR", "unspecified"), (None, None, "SAR", "unspecified")]


@pytest.mark.parametrize("py", [False, True])
def test_levels(spark, py):
    cases = {
        "Senior Software Engineer": "Senior", "Sr. Data Analyst": "Senior", "Lead DevOps Engineer": "Senior", "Project Manager": "Manager", "Head of Engineering": "Manager",
        "Director of Finance": "Executive", "Executive Director": "Executive", "Junior Developer": "Entry", "Marketing Intern": "Entry", "Fresh Graduate - Accounting": "Entry",
        "Mid-Level Java Developer": "Mid", "Cashier": "Unspecified", None: "Unspecified", "": "Unspecified", "SVP Sales": "Executive" if py else "Unspecified",
    }
    assert [r[0] for r in apply(spark, list(cases), a=P.career_level(x(), py))] == list(cases.values())


def test_fingerprints(spark):
    row = spark.createDataFrame([("Cashier", "Shahini Group", "riyadh", "2026-01-01")], "t string, c string, l string, d string")
    null = F.lit(None).cast("string")
    got = row.select(
        P.fingerprint(F.col("t"), F.col("c"), F.col("l")), P.fingerprint(null, null, null), P.fingerprint(F.col("t"), F.col("c"), F.col("l"), F.col("d")), P.fingerprint_blank_safe(F.lit(" "), null, F.lit(""))
    ).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert list(got) == [sha("CASHIER|SHAHINI GROUP|RIYADH"), sha("NULL|NULL|NULL"), sha("CASHIER|SHAHINI GROUP|RIYADH|2026-01-01"), sha("NULL|NULL|NULL")]


def test_title_case_equals_str_title(spark):
    words = ["o'neil al-faisal", "abc DEF", "x1y2", "ÉCOLE été", "", " a  b "]
    assert [r[0] for r in apply(spark, words, a=T.title_case(x()))] == [w.title() for w in words]


def test_payloads_are_parsed_once_with_the_values_of_lookups(spark):
    """One parse for all keys gives what a lookup of each key gives, on odd payloads too; no lookup is left in the plan of usual rows."""
    from postmill.sources import payload

    odd = [
        '{"title":"a","company":"b"}', '{"title":"a","title":"b"}', '{"title":null,"title":"b","Title":"c"}', '{"title":{"x": [1, 2]},"company":[1,"2"],"salary":1.50,"date":1e3}', '{"title":"a","company":"b"', '{"title":"a"} tail',
        '[{"title":"a"}]', '"title"', "", "{}", "not json", None, '{"title":"","company":true}', '{"title":"\\u00e9\\n\\"q\\"","company":"  b "}', ' {"title" : "a"}', '{"a":{"title":"no"},"title":"yes"}', '{"title":"a","x":"\\z"}', '{"Title":"T","COMPANY":"C"}',
    ]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(odd)], "i int, raw_payload string")
    keys = ["title", "Title", "company", "salary", "date"]
    opened = payload._opened(rows, keys)
    for r in opened.select("i", *[payload._at(k).alias(f"got{n}") for n, k in enumerate(keys)], *[payload.at(k).alias(f"want{n}") for n, k in enumerate(keys)]).collect():
        assert r[1 : 1 + len(keys)] == r[1 + len(keys) :], odd[r.i]
    for source, mapping in payload.KEYS.items():
        assert set(mapping) == {k for k in ("title", "company", "locations", "location", "description", "snippet", "salary", "date", "updated", "job_title", "job_description", "city", "country", "scraped_at", "posting_date", "date_created") if any(f"_json_{k}" == w for c in payload.MAPPINGS[source]() for w in __import__("re").findall(r"_json_\w+", str(c)))}


def test_title_case_of_plain_and_other_texts(spark):
    from postmill.functions.text import AFTER_SPACE_OR_APOSTROPHE, title_case

    texts = ["", "a", "  two  WORDS ", "o'neil al-faisal", "x\n", "é ABC", "AB1cd", "tab\tb", None, "Saudi", "ﬁne aB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for boundary in (None, AFTER_SPACE_OR_APOSTROPHE):
        words = F.split("t", boundary or r"(?<=\P{L})(?=\p{L})")
        plain = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")
        got = title_case(F.col("t"), boundary) if boundary else title_case(F.col("t"))
        assert [r for r in df.select(got.alias("g"), plain.alias("w")).collect() if r.g != r.w] == []


def test_only_the_columns_that_are_asked_for_are_made(spark, tmp_path):
    """A query of one field evaluates no other, and tasks have a bounded number of rows."""
    from postmill import session
    from postmill.plans import queries as Q

    spark.range(450_000).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2020-01-01' as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    orders = spark.read.parquet(str(tmp_path / "orders.parquet"))
    assert session.spread(orders).rdd.getNumPartitions() == 4  # cores
    wide = session.spread(orders.unionByName(orders).unionByName(orders))  # 1,350,000 rows
    sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) <= 1.1 * session.TASK_ROWS
    plan = Q.QUERIES["out_of_region"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "GmbH" not in plan and "negotiable" not in plan and "sha2" not in plan


def test_places_are_cut_as_by_parts(spark):
    """Cut at fixed texts, without a pattern compiled for each row, where split_part cuts; texts that are read twice are columns."""
    from postmill.plans import medallion

    texts = ["", " - ", "a", "a - b - c", ", X", "a,b,c", " - a, b", "Al Khubar, Ash Sharqiyah - Riyadh", "a -b", ",", "  ", None, "الرياض, Saudi Arabia", "a,\nb", "A - , B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    primary = F.trim(F.split_part(F.coalesce("t", F.lit("")), F.lit(" - "), F.lit(1)))
    first = F.trim(F.split_part(primary, F.lit(","), F.lit(1)))
    got = df.select(P.primary_place(F.col("t")).alias("p"), P.place_parts(P.primary_place(F.col("t")))[0].alias("f"), primary.alias("wp"), first.alias("wf")).collect()
    assert [(r.p, r.f) for r in got] == [(r.wp, r.wf) for r in got]
    staged = df.select(F.col("t").alias("location_raw"), F.col("t").alias("company_raw"), F.col("t").alias("title_raw"), F.col("t").alias("posting_date_raw"))
    cleaned = medallion.clean(staged, ("location_city", "location_country", "company_name"))
    city, country = P.parse_location(F.col("location_raw"))
    for r in cleaned.select("*", city.alias("c"), country.alias("d"), P.clean_company(F.col("company_name_raw")).alias("e")).collect():
        assert (r.location_city, r.location_country, r.company_name) == (r.c, r.d, r.e)
    assert "split_part" not in (plan := cleaned._jdf.queryExecution().optimizedPlan().toString()) and plan.count("GmbH") == 1 and not [c for c in cleaned.columns if c.startswith("_")]
