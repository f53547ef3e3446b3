"""What a posting's fields mean: title, company, location, level, salary, fingerprint.

Each function comes in the default semantics and, where the row-at-a-time path of the domain
differs, in a ``_py`` variant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFTER_NON_LETTER, AFTER_SPACE_OR_APOSTROPHE, blank_to_null, having, squeeze, strip_all, title_case

# Qualifiers, suffixes, abbreviations, places, levels, terms.
NATIONALS = (r"SAUDI\s*NATIONALS?\s*ONLY", r"SAUDI\s*NATIONALS?", r"Saudi\s*Only", r"Saudis?\s*Only")
NATIONALS_ARABIC = r"متاح\s*للسعوديين"
#: What every text with a qualifier, with a legal suffix has in it.
NATIONAL_WORDS = ("saudi", "متاح")
SUFFIX_WORDS = ("ltd", "llc", "l.l.c", "co", "inc", "plc", "gmbh", "s.a.")
LEGAL_SUFFIX = r"\s*,?\s*\b(Ltd\.?|LLC\.?|L\.L\.C\.?|Co\.?|Corp\.?|Inc\.?|PLC\.?|GmbH|S\.A\.)\s*$"
ABBREVIATIONS = {"Intl": "International", "Mgmt": "Management", "Grp": "Group"}
COUNTRY_NAMES = ("saudi arabia", "ksa", "المملكة العربية السعودية")
HOME = "Saudi Arabia"
HOME_CODES = ("saudi arabia", "ksa")
CITY_ALIASES = {
    "ar riyadh": "Riyadh",
    "الرياض": "Riyadh",
    "jedda": "Jeddah",
    "jiddah": "Jeddah",
    "جدة": "Jeddah",
    "dammam": "Dammam",
    "الدمام": "Dammam",
    "al khobar": "Al Khobar",
    "al khubar": "Al Khobar",
    "الخبر": "Al Khobar",
    "makkah": "Mecca",
    "mecca": "Mecca",
    "مكة": "Mecca",
    "madinah": "Medina",
    "medina": "Medina",
    "al madinah": "Medina",
    "المدينة": "Medina",
}
REGIONS = (
    "ash sharqiyah", "eastern province", "al qasim", "qassim", "makkah", "makkah al mukarramah", "al madinah", "madinah", "al jawf", "al jouf",
    "riyadh", "jizan", "jazan", "aseer", "asir", "najran", "al baha", "tabuk", "hail", "northern borders",
)
LEVELS = (
    ("Entry", r"entry\s*level|fresh\s*grad|junior|\bintern\b|\btrainee\b"),
    ("Mid", r"intermediate|mid[\s\-]level|mid$"),
    ("Senior", r"\bsenior\b|\bsr\.?\b|\blead\b"),
    ("Manager", r"\bmanager\b|management|\bhead\s+of\b"),
    ("Executive", r"executive|director|c[\s\-]?level|\bvp\b|vice\s*president"),
)
EXECUTIVE_PY = r"executive|director|c[\s\-]?level|vp\b|vice\s*president"
NO_SALARY = ("negotiable", "undisclosed", "competitive", "tbd", "n/a", "na")
SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR"}
PERIODS = {"month": "monthly", "year": "annual", "annual": "annual", "hour": "hourly"}
SALARY_PY = r"(?iU)([$£€])?([A-Z]{2,3})?\s*([\d,]+)(?:\s*[-–]\s*([\d,]+))?(?:\s+per\s+(month|year|hour)|\s*/\s*(month|year|annual|hour))?"


def _qualifier(lead: str) -> str:
    return "|".join(rf"{lead}\(?\s*{p}\s*\)?" for p in NATIONALS) + f"|{NATIONALS_ARABIC}"


def national_only(raw: Column) -> Column:
    text = F.coalesce(raw, F.lit(""))
    return having(text, NATIONAL_WORDS, text.rlike("(?i)" + _qualifier("")), F.lit(False))


def clean_title(raw: Column) -> Column:
    """The title without nationality qualifiers; empty becomes null."""
    text = F.coalesce(raw, F.lit(""))
    return blank_to_null(F.trim(squeeze(having(text, NATIONAL_WORDS, F.regexp_replace(text, "(?i)" + _qualifier(r"\s*"), ""), text))))


def _expand(c: Column, pattern: str) -> Column:
    return having(c, tuple(k.lower() for k in ABBREVIATIONS), reduce(lambda x, k: F.regexp_replace(x, "(?i)" + pattern.format(k), ABBREVIATIONS[k]), ABBREVIATIONS, c), c)


def without_suffix(raw: Column) -> Column:
    """Without one legal suffix; missing is empty."""
    text = F.coalesce(raw, F.lit(""))
    return having(text, SUFFIX_WORDS, F.regexp_replace(text, "(?i)" + LEGAL_SUFFIX, ""), text)


def expanded(bare: Column) -> Column:
    """With abbreviations expanded."""
    return _expand(bare, r"\b{}\.?\b")


def clean_company(raw: Column, bare: Column | None = None) -> Column:
    """Without one legal suffix, abbreviations expanded (``bare``, where that is there as a column), in title case; empty becomes null."""
    return blank_to_null(F.trim(title_case(expanded(without_suffix(raw)) if bare is None else bare)))


def clean_company_py(raw: Column) -> Column:
    """As above, but acronyms (words of three to five capitals) stay in capitals."""
    bare = _expand(strip_all(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?iU)" + LEGAL_SUFFIX, "")), r"\b{}\b\.?")
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    acronyms = F.transform(F.filter(words(bare), lambda w: w.rlike(r"^\p{Lu}{3,5}$")), F.lower)
    titled = title_case(bare, AFTER_NON_LETTER)
    kept = F.array_join(F.transform(words(titled), lambda w: F.when(F.array_contains(acronyms, F.lower(w)), F.upper(w)).otherwise(w)), " ")
    return blank_to_null(F.when(F.size(acronyms) > 0, kept).otherwise(titled))


def primary_place(raw: Column) -> Column:
    """The text before " - "; missing is empty."""
    return F.trim(F.substring_index(F.coalesce(raw, F.lit("")), " - ", 1))


def place_parts(primary: Column) -> tuple[Column, Column]:
    """What stands before and behind the first comma; of the latter empty becomes null."""
    return F.trim(F.substring_index(primary, ",", 1)), blank_to_null(F.trim(F.regexp_extract(primary, r",\s*(.*)", 1)))


def parse_location(raw: Column, parts: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """(city, country): the text before " - ", split at its first comma (``parts``, where they are there as columns)."""
    first, second = place_parts(primary_place(raw)) if parts is None else parts
    aliases = F.create_map(*[F.lit(x) for pair in CITY_ALIASES.items() for x in pair])
    is_country = F.lower(first).isin(*COUNTRY_NAMES)
    city = F.when(raw.isNull() | is_country, F.lit(None)).otherwise(F.coalesce(F.element_at(aliases, F.lower(first)), title_case(first, AFTER_SPACE_OR_APOSTROPHE)))
    home = F.lower(second).isin(*COUNTRY_NAMES, *REGIONS)
    country = F.when(raw.isNull(), F.lit(None)).when(is_country, HOME).when(second.isNull(), F.lit(None)).when(home, HOME).otherwise(second)
    return city, country


def out_of_region(country: Column) -> Column:
    return F.coalesce(~F.lower(country).isin(*HOME_CODES), F.lit(False))


def career_level(raw: Column, py: bool = False) -> Column:
    """The first level whose pattern occurs in the raw title."""
    out = None
    for level, pattern in LEVELS:
        if py and level == "Executive":
            pattern = EXECUTIVE_PY
        hit = raw.rlike(("(?iU)" if py else "(?i)") + pattern)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("Unspecified")


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,0)")


def salary(raw: Column) -> dict[str, Column]:
    """salary_min, salary_max, salary_currency, salary_period; each looked for anywhere in the text."""
    told = raw.isNotNull() & ~F.lower(F.trim(raw)).isin(*NO_SALARY)
    number = told & raw.rlike(r"[\d,]+")
    code = blank_to_null(F.regexp_extract(raw, r"^\s*([A-Z]{2,3})\s*[\d,]", 1))
    currency = F.when(raw.contains("$"), "USD").when(raw.contains("£"), "GBP").when(raw.contains("€"), "EUR").otherwise(F.coalesce(code, F.lit("SAR")))
    period = (
        F.when(raw.rlike(r"(?i)per\s+month|/\s*month"), "monthly")
        .when(raw.rlike(r"(?i)per\s+year|/\s*year|/\s*annual"), "annual")
        .when(raw.rlike(r"(?i)per\s+hour|/\s*hour"), "hourly")
        .otherwise("unspecified")
    )
    return {
        "salary_min": F.when(number, _number(F.regexp_substr(raw, F.lit(r"[\d,]+")))),
        "salary_max": F.when(told, _number(F.regexp_extract(raw, r"[\d,]+\s*[-–]\s*([\d,]+)", 1))),
        "salary_currency": F.when(number, currency),
        "salary_period": F.when(number, period),
    }


def salary_py(raw: Column) -> dict[str, Column]:
    """The same fields by one pattern around the first number, as doubles; a number of commas only is null."""
    group = lambda i: F.regexp_extract(raw, SALARY_PY, i)
    found = raw.isNotNull() & (raw != "") & ~F.lower(strip_all(raw)).isin(*NO_SALARY) & raw.rlike(SALARY_PY)
    symbols = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    periods = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    value = lambda i: F.replace(group(i), F.lit(","), F.lit("")).try_cast("double")
    currency = F.coalesce(F.element_at(symbols, group(1)), blank_to_null(F.upper(group(2))), F.lit("SAR"))
    period = F.coalesce(F.element_at(periods, F.lower(F.concat(group(5), group(6)))), F.lit("unspecified"))
    return {
        "salary_min": F.when(found, value(3)),
        "salary_max": F.when(found, value(4)),
        "salary_currency": F.when(found, currency),
        "salary_period": F.when(found, period),
    }


def fingerprint(title: Column, company: Column, city: Column, posting_date: Column | None = None, with_date: Column | None = None) -> Column:
    """SHA-256 of the upper-cased parts; missing ones count as NULL. The date goes in where ``with_date`` holds."""
    part = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit("NULL"))
    three = F.concat(part(title), F.lit("|"), part(company), F.lit("|"), part(city))
    if posting_date is not None:
        four = F.concat(three, F.lit("|"), F.coalesce(blank_to_null(posting_date), F.lit("NULL")))
        three = F.when(with_date, four).otherwise(three) if with_date is not None else four
    return F.sha2(three, 256)


def fingerprint_blank_safe(title: Column, company: Column, city: Column) -> Column:
    """As above with three parts, but what is empty after trimming counts as missing too."""
    part = lambda c: F.coalesce(blank_to_null(F.trim(F.upper(c))), F.lit("NULL"))
    return F.sha2(F.concat(part(title), F.lit("|"), part(company), F.lit("|"), part(city)), 256)
