"""Tables that are appended to in one step or not at all, by several writers, and changed by whole runs.

A table set is a folder: each append writes its files under an id of its own, then publishes them all by
renaming a small folder with one file to the next number in ``published``. A folder that isn't empty is
replaced by no rename, on HDFS and on local and shared disks (a file is, on disks: two writers could both
find its name free), so there is one winner for each number, and readers see all tables of an append or none. An append that fails before that has published nothing; it removes
its files, and files of a driver that died are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..session import stage
from .dedup import append_new


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _published(spark: SparkSession, root: str, after: int = 0) -> dict[int, dict[str, str]]:
    """The entries behind number ``after``: for each number the folder of each table."""
    files, folder = _hadoop(spark, f"{root}/published")
    if not files.exists(folder):
        return {}
    names = sorted(x.getPath().getName() for x in files.listStatus(folder))
    wanted = [n for n in names if n.isdigit() and int(n) > after]
    found = spark.read.text([f"{root}/published/{n}/{n}" for n in wanted], wholetext=True).select("_metadata.file_name", "value").collect() if wanted else []
    return {int(r["file_name"]): json.loads(r["value"]) for r in found}


def _publish(spark: SparkSession, root: str, number: int, entry: dict[str, str]) -> bool:
    """Claim ``number`` for an entry; False if another writer has it."""
    name, own = f"{number:012d}", uuid.uuid4().hex
    files, target = _hadoop(spark, f"{root}/published/{name}")
    whole = _hadoop(spark, f"{root}/parts/{own}")[1]
    out = files.create(_hadoop(spark, f"{root}/parts/{own}/{name}")[1])  # whole before it has its name: a reader never sees half an entry
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if files.exists(target):
            return False
        files.mkdirs(target.getParent())
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(context.makeQualified(whole), context.makeQualified(target), none)  # fails if the name is taken
        # a local disk's rename that comes second by an instant copies the folder into the winner's instead
        inside = _hadoop(spark, f"{root}/published/{name}/{own}")[1]
        if files.exists(inside):
            files.delete(inside, True)
        return _entry(spark, root, name) == entry
    except Py4JJavaError as e:
        if files.exists(target):  # whatever the file system says when the name is taken meanwhile
            return _entry(spark, root, name) == entry
        raise e
    finally:
        files.delete(whole, True)


def _entry(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    return json.loads(spark.read.text(f"{root}/published/{name}/{name}", wholetext=True).first()["value"])


def read_published(spark: SparkSession, root: str, table: str, schema: str, after: int = 0) -> DataFrame:
    """The rows of a table in all appends that were published (behind number ``after``)."""
    folders = [f"{root}/{entry[table]}" for _, entry in sorted(_published(spark, root, after).items()) if table in entry]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def publish_append(root: str, tables: dict[str, tuple[DataFrame, str]]) -> int:
    """Append to several tables, (rows, key) by name, in one step; the number it was published under.

    Rows whose key is there already are left out, whoever wrote them: a writer that finds its number
    taken takes out what the others have added since, and tries the next. Of rows with one key the
    first by all columns is taken. Keys that are null are never there already.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    number = max(_published(spark, root), default=0)
    entry, stale = {}, []
    try:
        rows = {name: append_new(read_published(spark, root, name, df.schema), df, key) for name, (df, key) in tables.items()}
        while True:
            for name, df in rows.items():
                stale.append(entry.get(name))
                entry[name] = f"{name}/{uuid.uuid4().hex}"
                df.write.parquet(f"{root}/{entry[name]}")
            if _publish(spark, root, number + 1, entry):
                return number + 1
            newer = {name: read_published(spark, root, name, df.schema, number) for name, (df, _) in tables.items()}
            number = max(_published(spark, root, number))
            rows = {name: spark.read.schema(df.schema).parquet(f"{root}/{entry[name]}").join(newer[name].select(key), key, "left_anti").select(*df.columns) for name, (df, key) in tables.items()}
    except BaseException:
        stale += entry.values()
        raise
    finally:
        for folder in filter(None, stale):
            files, target = _hadoop(spark, f"{root}/{folder}")
            files.delete(target, True)


def append_run(run: DataFrame, raw: DataFrame, root: str) -> int:
    """Append a run's row and its rows, both or neither."""
    return publish_append(root, {"collection_runs": (run, "run_id"), "raw_jobs": (raw, "raw_id")})


def change_partitions(spark: SparkSession, path: str, condition: Column, change: Callable[[DataFrame], DataFrame], by: str = "run_id") -> int:
    """Change the rows of a partitioned Parquet table for which ``condition`` holds; the number of partitions rewritten.

    ``change`` gets the rows that meet the condition and returns what stands in their place: changed rows,
    none (a delete), or more. Only partitions with such a row are read whole and written, each in one
    step; all others keep their files. Rows for which the condition is null stay as they are.
    """
    table = spark.read.parquet(path)
    touched = [r[0] for r in table.where(condition).select(by).distinct().collect()]  # names of partitions, not rows
    if not touched:
        return 0
    within = F.col(by).isin([t for t in touched if t is not None]) | (F.col(by).isNull() if None in touched else F.lit(False))
    old = spark.read.parquet(path).where(within)
    hit = F.coalesce(condition, F.lit(False))
    after = change(old.where(hit)).select(*old.columns).unionByName(old.where(~hit))
    after = stage(after, "changed")  # a table that is being read can't be overwritten
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    left = {r[0] for r in after.select(by).distinct().collect()}
    for gone in [t for t in touched if t not in left]:  # a partition without rows is no part of an overwrite
        name = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone
        files, target = _hadoop(spark, f"{path}/{by}={name}")
        files.delete(target, True)
    return len(touched)
