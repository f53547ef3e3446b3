"""Counts, profiles, rankings, reconciliation and data tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def frequencies(df: DataFrame, key: str, label: str = "(none)") -> DataFrame:
    """Value, count and percent of all rows; null has a label. The total is summed over the groups, not the rows."""
    counts = df.groupBy(F.coalesce(F.col(key), F.lit(label)).alias(key)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total), F.lit(True)).select(key, "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing, rate): null or empty values of each column, in one pass."""
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c)
    one = df.agg(F.count("*").alias("_n"), *[missing(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])).alias("p")
    return one.select("_n", pairs).select("p.column_name", "p.missing", (F.col("p.missing") / F.col("_n")).alias("rate"))


def key_coverage(df: DataFrame) -> DataFrame:
    """Rows by the key they can be deduplicated with: a native id, else a fingerprint, else none."""
    has_id, has_fp = F.coalesce(F.col("source_job_id") != "", F.lit(False)), F.coalesce(F.col("job_fingerprint") != "", F.lit(False))
    return df.agg(F.count_if(has_id).alias("with_native_id"), F.count_if(~has_id & has_fp).alias("fingerprint_only"), F.count_if(~has_id & ~has_fp).alias("neither"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_n"), (F.count(key) - F.count_distinct(key)).alias("duplicates"))


def min_max(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last"), F.substring(F.max(c), 1, 10).alias("last_day"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last; a grouped maximum, not a sort."""
    return runs.agg(F.max(F.struct("started_at", "run_id")).alias("r")).select("r.run_id", "r.started_at")


def most_recent(df: DataFrame, order: str, row_id: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(order), F.asc(row_id)).limit(k)


def matched_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many pairs of rows share the key, from counts of each side: hot keys cost no more than others."""
    left = a.groupBy(key).agg(F.count("*").alias("x"))
    right = b.groupBy(key).agg(F.count("*").alias("y"))
    return left.join(right, key).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("matched"))


def only_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unaccepted_values(df: DataFrame, c: str, accepted: list[str]) -> DataFrame:
    return df.where(~F.col(c).isin(*accepted)).groupBy(c).agg(F.count("*").alias("n"))


def run_report(fetched: Column, stored: Column, failed: Column) -> Column:
    return F.struct((fetched - stored).alias("duplicates"), (stored - failed).alias("loaded"), failed.alias("failed"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, n): how many rows each layer holds."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    return reduce(DataFrame.unionByName, counts)


def unexpected(actual: DataFrame, expected: list[str], key: str) -> DataFrame:
    """Names that are there but aren't expected, as orphaned schemas are."""
    return actual.where(F.col(key).isNotNull() & ~F.col(key).isin(*expected)).select(key).distinct()


def first_rows(df: DataFrame, key: str, k: int) -> DataFrame:
    """A sample of ``k`` rows that is the same on every run: the first by key."""
    return df.orderBy(key).limit(k)
