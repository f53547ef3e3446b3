"""Writing tables, files and state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_JOBS, RUNS, STATE
from ..session import stage
from .dedup import append_new


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_ignoring(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table at ``path`` doesn't hold yet."""
    spark = df.sparkSession
    existing = spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], df.schema)
    append_new(existing, df, key).write.mode("append").parquet(path)


def reload(df: DataFrame, table: str) -> None:
    """Replace a table's rows."""
    df.write.mode("overwrite").saveAsTable(table)


def complete_run(runs: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The runs with one run's completion set."""
    return runs.withColumn("completed_at", F.when(F.col("run_id") == run_id, at).otherwise(F.col("completed_at")))


def csv_export(df: DataFrame, path: str, columns: list[str], parts: int = 1) -> None:
    """The given columns, null as empty, in ``parts`` files that each begin with a byte order mark.

    The mark stands in front of the first column's name, so each file's first bytes are the mark's.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(columns)]
    df.select(*texts).coalesce(parts).write.mode("overwrite").option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path, header=True)


def json_export(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as the plan has tasks."""
    df.write.mode("overwrite").json(path)


def json_array_export(df: DataFrame, path: str) -> None:
    """One file that holds a JSON array of the rows; for exports of a size that one consumer reads whole.

    Rows stream through a single task, which adds the brackets and commas: nothing is collected.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that there is a task if there are no rows
    rows = rows.unionByName(end).coalesce(1)

    def bracketed(batches):
        import pyarrow as pa

        last = None  # held back, as the last row has no comma behind it
        opened = "["
        for batch in batches:
            values = ([] if last is None else [last]) + [v for v in batch.column(0).to_pylist() if v is not None]
            if not values:
                continue
            last = values.pop()
            if values:
                yield pa.RecordBatch.from_pydict({"value": [(opened if i == 0 else "") + v + "," for i, v in enumerate(values)]})
                opened = ""
        yield pa.RecordBatch.from_pydict({"value": [opened + (last or "") + "]"]})

    rows.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def _wanted() -> Column:
    return ~F.coalesce("is_rejected", F.lit(False)) & ~F.coalesce("is_duplicate", F.lit(False))


def _fits() -> Column:
    """Whether the salaries fit decimal(15,2)."""
    fits = lambda c: F.col(c).isNull() | F.col(c).try_cast("decimal(15,2)").isNotNull()
    return fits("salary_min") & fits("salary_max")


def loadable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rows whose salaries don't fit decimal(15,2)): casts that fail set a row aside, not the load."""
    wanted = df.where(_wanted())
    return wanted.where(_fits()).withColumns({c: F.col(c).try_cast("decimal(15,2)") for c in ("salary_min", "salary_max")}), wanted.where(~_fits())


def load(df: DataFrame, path: str) -> DataFrame:
    """Write the rows to load to ``path``, set those that fail aside in ``path``-failed, and report.

    The report has one row: expected, loaded, failed, stored (rows that the table holds now) and whether they
    agree. What is expected and what fails is counted by the write itself (observed metrics), and those that
    fail are written only if there are any; stored is counted in the files' footers.
    """
    spark = df.sparkSession
    seen = Observation()
    good, bad = loadable(df.observe(seen, F.count_if(_wanted()).alias("expected"), F.count_if(_wanted() & ~_fits()).alias("failed")))
    good.write.mode("overwrite").parquet(path)
    found = seen.get
    aside = loadable(df)[1] if found["failed"] else spark.createDataFrame([], bad.schema)
    aside.write.mode("overwrite").parquet(f"{path}-failed")
    stored = spark.read.schema(good.schema).parquet(path).count()
    loaded = found["expected"] - found["failed"]
    return spark.createDataFrame([(found["expected"], loaded, found["failed"], stored, loaded == stored)], "expected bigint, loaded bigint, failed bigint, stored bigint, agrees boolean")


def guarded_update(df: DataFrame, condition: Column, update, expected: int) -> DataFrame:
    """``update(df)``, unless ``condition`` holds for another number of rows than ``expected``: a dry run before, a check after.

    The dry run counts the rows and those that would change in one pass; the update is computed once, written
    and counted by that write, and what is returned reads what was written.
    """
    before = df.agg(F.count_if(condition).alias("found"), F.count("*").alias("rows")).first()
    if before["found"] != expected:
        raise ValueError(f"{before['found']} rows would change, {expected} were expected")
    seen = Observation()
    changed = stage(update(df).observe(seen, F.count("*").alias("rows")), "updated")
    if seen.get["rows"] != before["rows"]:
        raise ValueError("the update changes the number of rows")
    return changed


def smoke(spark: SparkSession, path: str) -> bool:
    """Write one row, find it by its key, delete it; whether the place can be written, read and changed."""
    spark.createDataFrame([("smoke", "x"), ("other", "y")], "id string, value string").write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path).where("id = 'smoke'").count()
    left = spark.read.parquet(path).where("id <> 'smoke'").collect()
    spark.createDataFrame(left, "id string, value string").write.mode("overwrite").parquet(path)
    return found == 1 and spark.read.parquet(path).where("id = 'smoke'").count() == 0


def create_tables(spark: SparkSession, database: str) -> None:
    """The tables of a database, Bronze partitioned as scans select: by run and source."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema, by in (("raw_jobs", RAW_JOBS, "run_id, source_name"), ("collection_runs", RUNS, None), ("processed_fingerprints", STATE, None)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet" + (f" PARTITIONED BY ({by})" if by else ""))


def drop_database(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def rename_database(spark: SparkSession, old: str, new: str) -> list[str]:
    """Move every table and view of a database to a new one, then drop the old; the names moved.

    Tables are copied with their partitions; views are made anew from their text, with the old database's
    name replaced by the new one's, those first that read no other. The old database is dropped only
    when every table has as many rows in the new one and every view can be read.
    """
    spark.sql(f"CREATE DATABASE {new}")
    found = [t for t in spark.catalog.listTables(old) if not t.isTemporary]
    tables, views = [t.name for t in found if t.tableType != "VIEW"], [t.name for t in found if t.tableType == "VIEW"]
    for name in tables:
        by = [c.name for c in spark.catalog.listColumns(f"{old}.{name}") if c.isPartition]
        spark.table(f"{old}.{name}").write.partitionBy(*by).saveAsTable(f"{new}.{name}")
    texts = {v: _view_text(spark, old, v) for v in views}
    waiting = dict(texts)
    while waiting:
        made = [v for v, text in waiting.items() if not any(_names(text, old, other) for other in waiting if other != v)]
        for v in made:
            spark.sql(f"CREATE VIEW {new}.{v} AS {_renamed(waiting.pop(v), old, new)}")
        if not made:
            raise ValueError(f"views that read each other: {sorted(waiting)}")
    for name in tables:
        if spark.table(f"{old}.{name}").count() != spark.table(f"{new}.{name}").count():
            raise ValueError(f"{name} isn't whole in {new}; {old} stays")
    for v in views:
        spark.table(f"{new}.{v}").schema  # noqa: B018  fails if it can't be resolved
    drop_database(spark, old)
    return tables + views


def _view_text(spark: SparkSession, database: str, view: str) -> str:
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{view}").collect()}
    return rows["View Text"]


def _names(text: str, database: str, table: str) -> bool:
    """Whether a view's text names a table, with its database or without."""
    return bool(re.search(rf"(?i)(?<![\w.`])(?:(?:`?spark_catalog`?\.)?`?{re.escape(database)}`?\.)?`?{re.escape(table)}`?(?![\w`])", text))


def _renamed(text: str, old: str, new: str) -> str:
    """A view's text with the database's name replaced, outside of string literals."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", text)
    return "".join(part if i % 2 else re.sub(rf"(?i)(?<![\w.`])(`?spark_catalog`?\.)?`?{re.escape(old)}`?(?=\s*\.)", f"{new}", part) for i, part in enumerate(parts))


def layer_table(layer: str | None, name: str, default: str = "default") -> str:
    """A table's full name: the layer's own schema if it has one, else the default one."""
    return f"{(layer or default).strip()}.{name}"
