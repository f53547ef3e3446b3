"""What the corpus operators share: the shared folder, staged tables, text rules."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
import string
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the cluster names none (tests in local mode) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Most rows of an Arrow batch where a staged table is written through Python.
ARROW_ROWS, _ARROW_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths of the tables staged by the operators that are running, innermost last.
_scopes: list[list[str]] = []


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Few rows in an Arrow batch: whole texts and vectors are held by a worker's memory."""
    rows = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(rows), ARROW_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, rows)


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder.

    The files go when the operator that staged them has no more need of them (see :func:`releasing`),
    at the latest when the application ends.
    """
    path = f"{shared_dir(spark)}/postmill/{label}-{uuid.uuid4().hex}"
    files, target = _hadoop_path(spark, path)
    files.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new path in the shared folder and read it again.

    Cuts the lineage: later readers survive the loss of executors and see the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_file(spark: SparkSession, stem: str, data: bytes) -> str:
    """Put a file, named by its content, into the shared folder and hand it to every executor; its name.

    The same content is written once; the file goes when the application ends.
    """
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:32]}"
    files, target = _hadoop_path(spark, f"{shared_dir(spark)}/postmill/{name}")
    if not files.exists(target):
        part = target.suffix(f".{uuid.uuid4().hex}")
        out = files.create(part)
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
        out.close()
        files.rename(part, target)
    files.deleteOnExit(target)
    spark.sparkContext.addFile(target.toString())
    return name


def _roots_read(df: DataFrame) -> set[str]:
    """Last parts of the folders that the plan of ``df`` reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            found |= {x.rstrip("/").rpartition("/")[2] for x in leaf.relation().location().rootPaths().mkString("\n").split("\n")}
    return found


def releasing(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that deletes the tables it has staged, but for those that its lazy result still reads."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _scopes.append([])
        try:
            result = operator(*args, **kwargs)
        finally:
            staged = _scopes.pop()
        read = _roots_read(result)
        for path in staged:
            if path.rpartition("/")[2] not in read:
                files, target = _hadoop_path(result.sparkSession, path)
                files.delete(target, True)
            elif _scopes:
                _scopes[-1].append(path)
        return result

    return run


@releasing
def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written and read again; all that was staged on the way goes."""
    return stage_table(make(), label)


def drop_tables(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads; for tables whose rows have been written on."""
    for name in _roots_read(df):
        files, target = _hadoop_path(df.sparkSession, f"{shared_dir(df.sparkSession)}/postmill/{name}")
        files.delete(target, True)


#: Bits of the bitmaps of documents, at least and at most (1 MB to 8 MB).
MAP_BITS, MOST_MAP_BITS = 1 << 23, 1 << 26


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2, spot): id and a hash of the text as a key, and the place of the key in bitmaps."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(-(2**63))), "k2": F.xxhash64("text")})
    return rows.withColumn("spot", F.pmod(F.xxhash64("k1", "k2"), F.lit(MOST_MAP_BITS)))


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the (k1, k2) of ``keys``: sixteen for each key, within the fixed bounds."""
    bits = min(max(MAP_BITS, 1 << (16 * keys.count()).bit_length()), MOST_MAP_BITS)
    spot = F.pmod(F.xxhash64("k1", "k2"), F.lit(MOST_MAP_BITS)) % bits
    words = keys.select(F.floor(spot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def in_bitmap(spot: np.ndarray, bits: np.ndarray) -> np.ndarray:
    spot = spot % (64 * len(bits))
    return (bits[spot >> 6].view(np.uint64) >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
