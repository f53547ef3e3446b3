"""Reading listing and detail pages with expressions: ids, JSON-LD, marked text, key-value blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, evaluated, split_before_capitals, strip_all
from . import elements as E

# Words of tags that don't count, employment types, work modes, names of the country, classes of the detail page.
SKIPPED_TAG_WORDS = ("translat", "arabic", "original", "show", "عربي")
EMPLOYMENT = ("full time", "part time", "internship", "freelance", "contract", "temporary")
WORK_MODES = ("on-site", "remote", "hybrid")
COUNTRY_WORDS = ("saudi", "saudi arabia", "")
CLASSES = {
    "title": "job-title-text", "company": "job-meta-company", "item": "job-meta-item", "date": "job-date", "tag": "job-tag", "block": "meta-data", "text": "text-html", "apply": "apply-btn", "skills": "*skill",
}
DETAIL_KEYS = ("experience", "education", "gender", "category", "industry", "salary")
SHORTEST_DESCRIPTION = 50


def seed_ids(page: Column) -> Column:
    """Distinct ids of data-job-id attributes, in page order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'data-job-id="(\d+)"'), F.lit(1)))


def link_ids(page: Column) -> Column:
    """Distinct ids of links that end in 0<id>.html, in page order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"0(\d+)\.html"), F.lit(1)))


def links(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1)))


def plain_text(fragment: Column) -> Column:
    """Tags become line breaks, runs of white space around them one, entities of markup are decoded."""
    bare = F.regexp_replace(F.regexp_replace(fragment, r"(?is)<(script|style)\b.*?</\1>", "\n"), r"<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip_all(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def element_text(page: Column, tag: str) -> Column:
    return blank_to_null(F.trim(F.regexp_replace(F.regexp_extract(page, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]+>", "")))


def texts_of(elements: Column, name: str, between: str = "") -> Column:
    """The whole texts of all elements of a name, in page order; ``elements`` with their parts."""
    return F.transform(F.filter(elements, lambda e: e["name"] == name), lambda e: F.array_join(e["parts"], between))


def first_text(elements: Column, name: str, between: str = "") -> Column:
    """The whole text of the first element of a name; null if there is none."""
    return F.get(texts_of(elements, name, between), F.lit(0))


def class_body(page: Column, css_class: str) -> Column:
    """The markup inside the first element of a class, elements of the same name in it included; empty if there is none."""
    found = E.marked(page, {"x": css_class})
    return F.when(page.isNotNull(), F.coalesce(F.get(E.bodies(page, found, "x"), F.lit(0)), F.lit("")))


def class_text(page: Column, css_class: str, between: str = "") -> Column:
    """The whole text of the first element of a class; null if it is blank or there is none."""
    return blank_to_null(first_text(E.with_parts(page, E.marked(page, {"x": css_class})), "x", between))


def class_texts(page: Column, css_class: str, between: str = "") -> Column:
    """The whole texts of all elements of a class."""
    return texts_of(E.with_parts(page, E.marked(page, {"x": css_class})), "x", between)


def job_json(page: Column) -> Column:
    """The JSON-LD object whose @type is JobPosting (a variant), whether it stands alone or in an array."""
    bodies = F.regexp_extract_all(page, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    wrapped = F.transform(bodies, lambda b: F.when(F.trim(b).startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]"))))
    objects = F.flatten(F.transform(wrapped, lambda b: F.coalesce(F.try_variant_get(F.try_parse_json(b), "$", "array<variant>"), F.array().cast("array<variant>"))))
    return F.get(F.filter(objects, lambda o: F.try_variant_get(o, "$['@type']", "string") == "JobPosting"), F.lit(0))


def from_job(job: Column, path: str) -> Column:
    return blank_to_null(F.try_variant_get(job, path, "string"))


def class_texts(page: Column, css_class: str) -> Column:
    """The texts of all elements of a class."""
    found = F.regexp_extract_all(page, F.lit(rf'(?is)<(\w+)[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</\1>'), F.lit(2))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " ")))


def title_and_company(elements: Column, job: Column) -> dict[str, Column]:
    """A marked title counts even if it is blank, a marked company only if it isn't."""
    there = F.exists(elements, lambda e: e["name"] == "title")
    return {
        "title": F.when(there, blank_to_null(first_text(elements, "title"))).otherwise(from_job(job, "$.title")),
        "company": F.coalesce(blank_to_null(first_text(elements, "company")), from_job(job, "$.hiringOrganization.name")),
    }


def city(items: Column, job: Column) -> Column:
    """What the last meta item names: after its comma if it has one, unless that is the country; else the JSON-LD address."""
    squeezed = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    named = F.transform(squeezed, lambda x: F.when(x.contains(","), F.trim(F.regexp_extract(x, r"(?s),(.*)", 1))).otherwise(x))
    places = F.filter(named, lambda x: ~F.lower(x).isin(*COUNTRY_WORDS))
    address = "$.jobLocation.address"
    return F.coalesce(F.try_element_at(places, F.lit(-1)), from_job(job, f"{address}.addressLocality"), from_job(job, f"{address}.addressRegion"))


def posted_on(elements: Column, job: Column) -> Column:
    """The stamp of the first date element, else the JSON-LD date."""
    return F.coalesce(E.attribute(F.get(E.start_tags(elements, "date"), F.lit(0)), "data-datetime"), from_job(job, "$.datePosted"))


def kept_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~F.lower(t).rlike("|".join(SKIPPED_TAG_WORDS)))


def employment_type(tags: Column, last: bool = True) -> Column:
    """The last (or first) tag that is an employment type."""
    return F.try_element_at(F.filter(kept_tags(tags), lambda t: F.lower(t).isin(*EMPLOYMENT)), F.lit(-1 if last else 1))


def work_mode(tags: Column) -> Column:
    return F.try_element_at(F.filter(kept_tags(tags), lambda t: F.lower(t).isin(*WORK_MODES)), F.lit(-1))


def description(fragment: Column, fallback: Column) -> Column:
    """The fragment's text, or the fallback's (text already) where that is under 50 characters."""
    text = blank_to_null(E.text_of(fragment, "\n"))
    return F.when(F.length(text) >= SHORTEST_DESCRIPTION, text).otherwise(F.coalesce(blank_to_null(fallback), text))


def key_values(block: Column) -> Column:
    """A map from the lower-cased first line to the second of each part of a text block; a part begins with a capital.

    Of parts with the same key the last counts; parts of one line don't.
    """
    lines = F.transform(split_before_capitals(block), lambda part: F.filter(F.transform(F.split(part, "\n"), F.trim), lambda x: x != ""))
    pairs = F.transform(F.filter(lines, lambda x: F.size(x) >= 2), lambda x: F.struct(F.lower(F.get(x, F.lit(0))).alias("key"), F.get(x, F.lit(1)).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p["key"])))


def detail(values: Column, word: str) -> Column:
    """The value whose key contains the word, the last of several."""
    found = F.filter(F.map_entries(values), lambda e: e["key"].contains(word))
    return F.try_element_at(found, F.lit(-1))["value"]


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    unit = F.concat(F.lit(" "), F.coalesce(currency, F.lit("SAR")))
    both = F.concat(low, F.lit("-"), high, unit)
    return F.when(low.isNotNull() & high.isNotNull(), both).otherwise(F.concat(F.coalesce(low, high), unit))


def detail_record(elements: Column, job: Column, values: Column) -> dict[str, Column]:
    """All fields of a detail page, by name, from its marked elements with their parts, its JSON-LD object and its key-value block."""
    tags = texts_of(elements, "tag")
    amount = lambda k: from_job(job, f"$.baseSalary.value.{k}")
    named = {k: detail(values, k) for k in DETAIL_KEYS}
    named["salary"] = F.coalesce(named["salary"], salary_text(amount("minValue"), amount("maxValue"), from_job(job, "$.baseSalary.currency")))
    return title_and_company(elements, job) | named | {
        "city": city(texts_of(elements, "item", " "), job),
        "posting_date": posted_on(elements, job),
        "employment_type": employment_type(tags),
        "work_mode": work_mode(tags),
        "job_description": description(from_job(job, "$.description"), first_text(elements, "text", "\n")),
        "required_skills": first_text(elements, "skills", ", "),
        "apply_path": E.attribute(F.get(E.start_tags(elements, "apply"), F.lit(0)), "data-url"),
    }


def details(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = (), also: dict[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` and all fields of :func:`detail_record`; a page's tags are gone through once for all fields.

    ``also``: further selectors by name, each an array of the whole texts of its elements in page order.
    """
    also = also or {}
    found = pages.select(*keep, E.marked(F.col(page), CLASSES | also).alias("_elements"), job_json(F.col(page)).alias("_job"))
    found = evaluated(found, {"_values": key_values(first_text(F.col("_elements"), "block", "\n"))})
    fields = detail_record(F.col("_elements"), F.col("_job"), F.col("_values")) | {name: texts_of(F.col("_elements"), name, " ") for name in also}
    return found.select(*keep, *[c.alias(name) for name, c in fields.items()])
