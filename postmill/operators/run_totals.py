"""Reports that are kept by run: each run adds its own counts and keys, reports merge those and read no postings.

Three tables are appended to in one step for each run (see :mod:`publishing`): how often each value of each
counted column occurs in the run, how many rows it has, and the keys that no earlier run had. A run that is
added again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publishing import publish_append, read_published

VALUES, SIZES, KEYS = "id string, run_id string, column_name string, value string, n bigint", "run_id string, n bigint, n_keys bigint", "id string, key_name string, key string"


def add_run(run_id: str, rows: DataFrame, root: str, counted: list[str], keys: list[str]) -> None:
    """Add the totals of one run's rows: counts of the values of ``counted`` columns, distinct values of ``keys`` columns."""
    spark = rows.sparkSession
    name = lambda *parts: F.to_json(F.array(*parts))  # noqa: E731  no two different lists of parts have one name
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in counted])).alias("p")
    values = rows.select(pairs).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))
    values = values.select(name(F.lit(run_id), "column_name", "value").alias("id"), F.lit(run_id).alias("run_id"), "column_name", "value", "n")
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("key_name"), F.col(c).cast("string").alias("key")) for c in keys])).alias("p")
    distinct = rows.select(found).where("p.key is not null").select("p.key_name", "p.key").distinct()
    sizes = rows.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("n"), F.count(keys[0]).alias("n_keys"))
    if not read_published(spark, root, "sizes", SIZES).where(F.col("run_id") == run_id).isEmpty():
        return
    publish_append(root, {"values": (values, "id"), "sizes": (sizes, "run_id"), "keys": (distinct.select(name("key_name", "key").alias("id"), "key_name", "key"), "id")})


def frequencies(spark: SparkSession, root: str, column: str, label: str = "(none)") -> DataFrame:
    """As :func:`reports.frequencies` over all runs' rows."""
    parts = read_published(spark, root, "values", VALUES).where(F.col("column_name") == column)
    counts = parts.groupBy(F.coalesce("value", F.lit(label)).alias(column)).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.lit(100.0) * F.col("n") / total).alias("percent"))


def top_k(spark: SparkSession, root: str, column: str, k: int) -> DataFrame:
    """As :func:`reports.top_k` over all runs' rows."""
    parts = read_published(spark, root, "values", VALUES).where(F.col("column_name") == column)
    return parts.groupBy(F.col("value").alias(column)).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def duplicate_count(spark: SparkSession, root: str, key: str) -> DataFrame:
    """As :func:`reports.duplicate_count` over all runs' rows; ``key`` is the first of the keys that the runs were added with."""
    distinct = read_published(spark, root, "keys", KEYS).where(F.col("key_name") == key).agg(F.count("*")).scalar()
    sizes = read_published(spark, root, "sizes", SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n_keys"))
    return sizes.select("n", distinct.alias("distinct_n"), (F.col("n_keys") - distinct).alias("duplicates"))


def run_counts(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, n): rows of each run."""
    return read_published(spark, root, "sizes", SIZES).select("run_id", "n")
