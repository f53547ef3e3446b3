"""Bags, ordered distinct values, differences and unions of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concatenate(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, parts)


def ordered_distinct(values: Column) -> Column:
    """An array's distinct values, in order of first occurrence."""
    return F.array_distinct(values)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def key_union(df: DataFrame, json_column: str) -> DataFrame:
    """The keys that occur in a column of JSON objects, with how many have them."""
    return df.select(F.explode(F.json_object_keys(json_column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
