"""Readers of files and tables of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds a JSON array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def csv_with_bom(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, quoted line breaks and perhaps a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """The <loc> values of an XML sitemap."""
    return spark.read.format("xml").option("rowTag", "url").load(path).select(F.trim("loc").alias("url"))


def government_csv(spark: SparkSession, path: str | None = None) -> DataFrame:
    raise NotImplementedError("this source has no export yet")


def to_raw(df: DataFrame, run_id: str, source: str, source_job_id: Column, url: Column, collected_at: Column) -> DataFrame:
    """Rows of a source as Bronze rows: the whole row becomes the payload."""
    payload = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(source), url, payload), 256).alias("raw_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(source).alias("source_name"),
        source_job_id.cast("string").alias("source_job_id"),
        url.alias("source_url"),
        payload.alias("raw_payload"),
        collected_at.alias("collected_at"),
    )


def synthetic_id(fingerprint: Column) -> Column:
    """An id for sources that have none."""
    return F.concat(F.lit("fp-"), fingerprint)


def run_row(df: DataFrame, run_id: str, source: str, stamp: str) -> DataFrame:
    """The run's row, from the least and greatest time of its records."""
    return df.agg(
        F.lit(run_id).alias("run_id"), F.min(stamp).alias("started_at"), F.max(stamp).alias("completed_at"), F.lit(source).alias("source_name"), F.count("*").cast("int").alias("records_fetched"), F.lit(None).cast("string").alias("notes")
    )


def of_run(raw: DataFrame, run_id: str) -> DataFrame:
    return raw.where(F.col("run_id") == run_id)


def of_latest_run(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of the run that started last: its id is a scalar subquery, so that a table partitioned by run reads that run's files only."""
    last = runs.agg(F.max(F.struct("started_at", "run_id"))["run_id"].alias("run_id"))
    return raw.where(F.col("run_id") == last.scalar())


def with_updated(df: DataFrame, updated: str, started_at: str) -> DataFrame:
    """collected_at of sources that say when a record was updated; else when the run began."""
    return df.withColumn("collected_at", F.coalesce(blank_to_null(F.col(updated)), F.lit(started_at)))


def bind(tables: dict[str, DataFrame]) -> None:
    """Name relations for SQL (session views): a model's text names its sources, not their places."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def of_run_prefix(raw: DataFrame, prefix: str) -> DataFrame:
    return raw.where(F.col("run_id").startswith(prefix))


#: Fixed: keys under which an answer's rows are looked for, the outer one and those inside it, in this order.
OUTER, INNER = "data", ("jobs", "results", "job_listings")
#: How deep a list of rows is looked for.
MOST_LEVELS = 8


def _rows_of(value: Column) -> Column:
    """A variant as an array of variants if it is a list whose first element is an object; else null."""
    found = F.try_variant_get(value, "$", "array<variant>")
    return F.when(F.schema_of_variant(F.try_variant_get(value, "$[0]", "variant")).startswith("OBJECT"), found)


def _children(value: Column) -> Column:
    """The values of an object, in the order of their keys in a variant (by name); null if it isn't one."""
    return F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))


def nested_rows(json_text: Column) -> Column:
    """The rows in an API's answer, as an array of variants; null if there are none.

    First ``data`` itself if it is a list of objects, then ``jobs``, ``results`` or ``job_listings`` in it or beside it; else the
    first list whose first element is an object, in ``data`` and then anywhere, level by level (MOST_LEVELS at most), by key within
    a level. Lists of anything else (words, numbers, lists) are passed over, and not looked into.
    """
    whole = F.try_parse_json(json_text)
    data = F.try_variant_get(whole, f"$.{OUTER}", "variant")
    named = [_rows_of(F.try_variant_get(whole, path, "variant")) for k in INNER for path in (f"$.{OUTER}.{k}", f"$.{k}")]
    return F.coalesce(_rows_of(whole), _rows_of(data), *named, _searched(data), _searched(whole))


def _searched(value: Column) -> Column:
    """The first list of objects anywhere in an object, level by level."""
    begin = F.struct(F.array(value).alias("level"), F.lit(None).cast("array<variant>").alias("found"))

    def down(state: Column, _: Column) -> Column:
        values = F.flatten(F.filter(F.transform(state["level"], _children), lambda x: x.isNotNull()))
        found = F.get(F.filter(F.transform(values, _rows_of), lambda x: x.isNotNull()), F.lit(0))
        return F.when(state["found"].isNotNull() | (F.size(state["level"]) == 0), state).otherwise(F.struct(values.alias("level"), found.alias("found")))

    return F.when(value.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), begin, down, lambda s: s["found"]))


def filled(c: str) -> Column:
    """A CSV value, stripped; blank is null."""
    return blank_to_null(F.trim(F.col(c)))


def day(c: str) -> Column:
    return F.left(filled(c), F.lit(10))
