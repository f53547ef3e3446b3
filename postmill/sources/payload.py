"""Staging: each source's payload keys onto the canonical columns, as data."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.postings import HOME
from ..functions.text import blank_to_null
from ..schemas import CANONICAL, require_canonical


def at(key: str) -> Column:
    """A payload's value as text; absent keys and JSON null give null."""
    return F.get_json_object("raw_payload", f"$.{key}")


def text(key: str) -> Column:
    return blank_to_null(at(key))


def _opened(raw: DataFrame, keys: list[str]) -> DataFrame:
    """``raw`` with the payload's values as columns (see :func:`_at`), each payload parsed once for all keys.

    They are those of :func:`at`: a payload that repeats a key, of which that gives the first, is looked up key by key.
    """
    opened = raw.select("*", F.json_tuple("raw_payload", *keys).alias(*map(_column, keys)))
    names = F.json_object_keys("raw_payload")
    opened = opened.withColumn("_json_twice", F.size(F.array_distinct(names)) < F.size(names))
    return opened.withColumns({_column(k): F.when(F.col("_json_twice"), at(k)).otherwise(_at(k)) for k in keys})


def _column(key: str) -> str:
    """The name of a key's column; names of columns don't differ by case alone."""
    return f"_json_{key}" if key.islower() else f"_json_upper_{key.lower()}"


def _at(key: str) -> Column:
    return F.col(_column(key))


def _text(key: str) -> Column:
    return blank_to_null(_at(key))


def _place(city: str, country: str) -> Column:
    """City and country as one text; a city alone is at home."""
    return F.when(_text(city).isNotNull(), F.concat(_text(city), F.lit(", "), F.coalesce(_text(country), F.lit(HOME)))).otherwise(_text(country))


def nothing() -> Column:
    return F.lit(None).cast("string")


#: Of each source the seven payload columns, in canonical order.
MAPPINGS = {
    "careerjet": lambda: (_text("title"), _text("company"), _text("locations"), _text("description"), _text("salary"), _at("date"), nothing()),
    "jooble": lambda: (_text("title"), _text("company"), _text("location"), _text("snippet"), F.nullif(_text("salary"), F.lit("null")), _at("updated"), _at("updated")),
    "tanqeeb": lambda: (_text("job_title"), _text("company"), _place("city", "country"), _text("job_description"), _text("salary"), _at("scraped_at"), _at("posting_date")),
    "techmap": lambda: (_text("title"), _text("company"), _place("city", "country"), nothing(), nothing(), _at("date_created"), _at("date_created")),
}
#: Of each source the payload's keys that each of its seven columns reads.
FIELDS = {
    "careerjet": (("title",), ("company",), ("locations",), ("description",), ("salary",), ("date",), ()),
    "jooble": (("title",), ("company",), ("location",), ("snippet",), ("salary",), ("updated",), ("updated",)),
    "tanqeeb": (("job_title",), ("company",), ("city", "country"), ("job_description",), ("salary",), ("scraped_at",), ("posting_date",)),
    "techmap": (("title",), ("company",), ("city", "country"), (), (), ("date_created",), ("date_created",)),
}
#: Of each source the payload's keys that its mapping reads.
KEYS = {source: tuple(dict.fromkeys(k for keys in fields for k in keys)) for source, fields in FIELDS.items()}


def known(raw: DataFrame) -> DataFrame:
    """Rows of sources that have a mapping: as many as the staging relation has."""
    return raw.where(F.col("source_name").isin(*MAPPINGS))


def staged(raw: DataFrame, source: str) -> DataFrame:
    """One source's staging relation; partitions of other sources aren't read."""
    columns = [c.alias(name) for name, c in zip(CANONICAL[6:], MAPPINGS[source](), strict=True)]
    rows = _opened(raw.where(F.col("source_name") == source), list(KEYS[source]))
    return require_canonical(rows.select(*CANONICAL[:6], *columns))


def staged_union(raw: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """All sources in the canonical shape.

    One scan with the mapping chosen by source, instead of a scan for each source and a union:
    the payload is read and parsed once. Rows of other sources are left out. Of the payload's columns
    those that ``only`` names (all if it is None) are made, the others are left out.
    """
    made = [(i, name) for i, name in enumerate(CANONICAL[6:]) if only is None or name in only]
    keys = sorted({k for fields in FIELDS.values() for i, _ in made for k in fields[i]})
    rows = _opened(known(raw), keys) if keys else known(raw)
    mapped = {s: make() for s, make in MAPPINGS.items()}
    columns = []
    for i, name in made:
        choice = reduce(lambda c, s: c.when(F.col("source_name") == s, mapped[s][i]), list(mapped)[1:], F.when(F.col("source_name") == list(mapped)[0], mapped[list(mapped)[0]][i]))
        columns.append(choice.alias(name))
    out = rows.select(*CANONICAL[:6], *columns)
    return require_canonical(out) if only is None else out


def generic(raw: DataFrame) -> DataFrame:
    """One list of keys for every source, the first present wins."""
    first = lambda *keys: F.coalesce(*[_text(k) for k in keys])
    made = {
        "title_raw": first("title", "Title"),
        "company_raw": first("company", "Company"),
        "location_raw": first("locations", "location", "Location"),
        "description": first("description", "Description"),
        "salary_raw": first("salary", "Salary"),
        "posting_date_raw": first("date", "Date"),
    }
    keys = ["title", "Title", "company", "Company", "locations", "location", "Location", "description", "Description", "salary", "Salary", "date", "Date"]
    return _opened(raw, keys).select(*[c for c in raw.columns if c not in made], *[c.alias(name) for name, c in made.items()])
