"""The rule engine: rules are data; a record is flagged, perhaps rejected, never dropped.

Two orders of the same rules: the default one flags every firing rule and gives the first
rejection as reason; the ``py`` one stops at fatal rules, knows two more, and gives the last.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.postings import HOME_CODES
from ..functions.text import evaluated
from ..schemas import FLAG

LONGEST_TITLE, STALE_DAYS = 300, 180


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    condition: Column
    message: Column
    rejects: bool = False
    stops: bool = False
    flags: bool = True


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def missing_parts(missing=lambda c: F.col(c).isNull()) -> Column:
    """How many of title, company and city are missing."""
    return sum((missing(c).cast("int") for c in ("title", "company_name", "location_city")), F.lit(0))


def default_rules() -> list[Rule]:
    """In the order of flags; reasons follow REASON_ORDER."""
    null = lambda c: F.col(c).isNull()
    parts = missing_parts()
    foreign = F.col("location_country").isNotNull() & ~F.lower("location_country").isin(*HOME_CODES)
    inverted = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull() & (F.col("salary_min") > F.col("salary_max"))
    return [
        Rule("REQ-001", "error", null("title"), F.lit("title is null or empty"), rejects=True, flags=False),
        Rule("REQ-002", "error", null("source_job_id") & null("job_fingerprint"), F.lit("no source_job_id and no job_fingerprint"), rejects=True, flags=False),
        Rule("REQ-003", "error", null("source_url"), F.lit("source_url is null"), rejects=True),
        Rule("REQ-004", "error", null("collected_at"), F.lit("collected_at is null"), rejects=True),
        Rule("ERR-002", "error", inverted, F.concat(F.lit("salary_min ("), _text("salary_min"), F.lit(") > salary_max ("), _text("salary_max"), F.lit(")")), rejects=True),
        Rule("ERR-003", "error", F.length(F.coalesce("title", F.lit(""))) > LONGEST_TITLE, F.concat(F.lit("title length "), F.length("title").cast("string"), F.lit(" exceeds 300 chars")), rejects=True),
        Rule("ERR-004", "warning", foreign, F.concat(F.lit("location_country '"), F.col("location_country"), F.lit("' is not Saudi Arabia"))),
        Rule("WARN-001", "warning", null("company_name"), F.lit("company_name is null")),
        Rule("WARN-002", "warning", null("location_raw"), F.lit("location_raw is null")),
        Rule("WARN-003", "info", F.col("career_level") == "Unspecified", F.lit("career_level could not be mapped")),
        Rule("WARN-004", "info", null("posting_date"), F.lit("posting_date is null")),
        Rule("WARN-005", "warning", parts >= 2, F.concat(F.lit("low-confidence fingerprint: "), parts.cast("string"), F.lit("/3 fingerprint components (title, company_name, location_city) are null/empty"))),
    ]


#: Reasons in the default order, with the texts that differ from the flags' messages.
REASON_ORDER = ("REQ-001", "REQ-002", "REQ-003", "REQ-004", "ERR-003", "ERR-002")
REASONS = {"ERR-003": "title length > 300 chars", "ERR-002": "salary_min > salary_max"}


def moment(c: Column) -> Column:
    """A timestamp from an ISO text, or from its first ten characters; else null."""
    return F.coalesce(F.try_to_timestamp(c), F.left(c, F.lit(10)).try_cast("timestamp"))


def py_rules() -> list[Rule]:
    parts = missing_parts(_missing)
    posted, collected = moment(F.col("posting_date").cast("string")), moment(F.col("collected_at"))
    inverted = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull() & (F.col("salary_min") > F.col("salary_max"))
    foreign = ~_missing("location_country") & ~F.lower("location_country").isin(*HOME_CODES)
    says = lambda *p: F.concat(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(p)])
    return [
        Rule("REQ-001", "error", _missing("title"), F.lit("title is null or empty"), rejects=True, stops=True),
        Rule("REQ-002", "error", _missing("source_job_id") & _missing("job_fingerprint"), F.lit("no source_job_id and no job_fingerprint — cannot deduplicate"), rejects=True, stops=True),
        Rule("REQ-003", "error", _missing("source_url"), F.lit("source_url is null"), rejects=True),
        Rule("REQ-004", "error", _missing("collected_at"), F.lit("collected_at is null"), rejects=True),
        Rule("ERR-003", "error", F.length("title") > LONGEST_TITLE, says("title length ", F.length("title").cast("string"), " exceeds 300 chars — likely scraping artifact"), rejects=True, stops=True),
        Rule("ERR-002", "error", inverted, says("salary_min (", _text("salary_min"), ") > salary_max (", _text("salary_max"), ") — inverted range"), rejects=True),
        Rule("WARN-001", "warning", _missing("company_name"), F.lit("company_name is null")),
        Rule("WARN-002", "warning", _missing("location_raw"), F.lit("location_raw is null")),
        Rule("WARN-003", "info", F.col("career_level") == "Unspecified", F.lit("career_level could not be mapped")),
        Rule("WARN-004", "info", _missing("posting_date"), F.lit("posting_date is null")),
        Rule("WARN-005", "warning", parts >= 2, says("low-confidence fingerprint: ", parts.cast("string"), "/3 fingerprint components (title, company_name, location_city) are null/empty — deduplication reliability is degraded for this record")),
        Rule("ERR-001", "error", posted > collected, says("posting_date ", _text("posting_date"), " is in the future")),
        Rule("ERR-004", "warning", foreign, says("location_country '", F.col("location_country"), "' is not Saudi Arabia")),
        Rule("STALE-001", "warning", (collected - posted) > F.expr(f"interval {STALE_DAYS} days"), says("posting_date ", _text("posting_date"), " is more than 180 days before collection")),
    ]


#: What the default rules add, and the columns that those which reject read.
JUDGED = ("quality_flags", "is_rejected", "rejection_reason")
REJECTING = ("title", "source_job_id", "job_fingerprint", "source_url", "collected_at", "salary_min", "salary_max")


def evaluate(df: DataFrame, py: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """Add quality_flags, is_rejected and rejection_reason, or those of them that ``only`` names; a narrow transformation.

    Without the flags, ``df`` needs no more columns than REJECTING and its id."""
    rules = py_rules() if py else default_rules()
    if only is not None and not py and "quality_flags" not in only:
        rules = [r for r in rules if r.rejects]
    fires, stopped = {}, F.lit(False)
    for rule in rules:
        fires[rule.id] = F.coalesce(rule.condition, F.lit(False)) & ~stopped
        if rule.stops:
            stopped = stopped | F.coalesce(rule.condition, F.lit(False))
    none = F.array().cast(f"array<{FLAG}>")
    flag = lambda r: F.array(F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), r.message.alias("message")).cast(FLAG))
    flags = F.concat(none, *[F.when(fires[r.id], flag(r)).otherwise(none) for r in rules if r.flags])  # a filter's lambda would have all rules interpreted
    rejecting = [r for r in rules if r.rejects]
    rejected = F.lit(False)
    for r in rejecting:
        rejected = rejected | fires[r.id]
    if py:  # the last one wins
        reasons = [F.when(fires[r.id], F.concat(F.lit(f"{r.id}: "), r.message)) for r in reversed(rejecting)]
    else:
        by_id = {r.id: r for r in rejecting}
        reasons = [F.when(fires[i], F.concat(F.lit(f"{i}: "), F.lit(REASONS[i]) if i in REASONS else by_id[i].message)) for i in REASON_ORDER]
    made = {"quality_flags": flags, "is_rejected": rejected, "rejection_reason": F.coalesce(*reasons)}
    return evaluated(df, {name: c for name, c in made.items() if only is None or name in only})


def quality_log(flagged: DataFrame) -> DataFrame:
    """One row for each firing of a rule; the id is made of the row and the rule, so that appending again ignores it."""
    rows = flagged.select(F.col("raw_id").alias("job_id"), F.explode("quality_flags").alias("f"))
    return rows.select(F.sha2(F.concat_ws("|", "job_id", F.col("f.rule")), 256).alias("log_id"), "job_id", F.col("f.rule").alias("rule_name"), "f.severity", "f.message", F.current_timestamp().alias("logged_at"))


def rule_ids(flags: str = "quality_flags") -> Column:
    return F.array_join(F.transform(F.col(flags), lambda f: f["rule"]), ",")


def has_rule(rule: str, flags: str = "quality_flags") -> Column:
    return F.exists(F.col(flags), lambda f: f["rule"] == rule)


def append_flag(df: DataFrame, condition: Column, rule: str, severity: str, message: str) -> DataFrame:
    """Append a flag where the condition holds and the flag isn't there yet; running it again changes nothing."""
    flags = F.coalesce("quality_flags", F.array().cast(f"array<{FLAG}>"))
    new = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")).cast(FLAG)
    missing = ~F.exists(flags, lambda f: f["rule"] == rule)
    return df.withColumn("quality_flags", F.when(condition & missing, F.array_append(flags, new)).otherwise(F.col("quality_flags")))
