"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition is one run: its (digest, identifier) pairs, sorted, with one entry for each
digest. Runs meet in rounds of ``FAN``: run r goes to group r // FAN, the group's runs are merged
by the sorter (a multiway merge that spills) and equal digests collapse to the retained
identifier, until one run is left. A round deals its rows by (group, digest), so that no task
holds a whole run of the upper levels, and a group of copies enters a round with one entry for
each run at most, whatever its size. Every round is staged: a lost executor costs its share of one
round, and the round below goes once it is merged. The result goes down again by (run, digest), not by digest
alone, so that a digest that a third of all rows share meets no single task either.

A digest counts as equal only if SHA-256, byte length and an independent 64-bit hash agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_tables, releasing, shuffle_width, stage_table, whole_text

#: Runs that one merge takes.
FAN = 8
_KEY = ["digest", "n_bytes", "check"]
_ENTRY = "run int, digest binary, n_bytes int, check bigint, doc_id bigint, rid bigint, n bigint, n_same bigint"


def with_digest(docs: DataFrame) -> DataFrame:
    """Add digest, n_bytes and check of the normalised text (null: empty; A-Z lower-cased)."""
    text = ascii_lower(whole_text())
    return docs.withColumns({"digest": F.unhex(F.sha2(text.cast("binary"), 256)), "n_bytes": F.octet_length(text), "check": F.xxhash64(text)})


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours with equal keys of a sorted stream; the first of them is retained."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_arrays(batch.columns, batch.schema.names)  # every column may be null: so all batches have one schema
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        if not table.num_rows:
            continue
        differs = np.zeros(table.num_rows, bool)
        differs[0] = True
        for name in ("run", "n_bytes", "check"):
            v = table.column(name).to_numpy()
            differs[1:] |= v[1:] != v[:-1]
        v = np.array(table.column("digest").to_pylist(), dtype="S32")
        differs[1:] |= v[1:] != v[:-1]
        ids = table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        at = np.flatnonzero(differs)
        group = np.cumsum(differs) - 1
        same = np.where(ids == ids[at][group], table.column("n_same").to_numpy(), 0)
        out = table.take(pa.array(at))
        out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(table.column("n").to_numpy(), at)))
        out = out.set_column(out.schema.get_field_index("n_same"), "n_same", pa.array(np.add.reduceat(same, at)))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merge_round(entries: DataFrame, fan: int, keep: str) -> DataFrame:
    """Send run r to group r // fan, merge the sorted runs and collapse equal digests."""
    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    return (
        entries.withColumn("run", (F.col("run") / fan).cast("int"))
        .repartition(shuffle_width(entries.sparkSession), "run", *_KEY)
        .sortWithinPartitions("run", *_KEY, order, "rid")
        .select([f.split()[0] for f in _ENTRY.split(", ")])
        .mapInArrow(_collapse, _ENTRY)
    )


def _merged(docs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their digests, and for each (run, digest) what the merge retains."""
    rows = stage_table(
        with_digest(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("run"), *_KEY),
        "digests",
    )
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    first = stage_table(_merge_round(rows.withColumns({"n": F.lit(1).cast("bigint"), "n_same": F.lit(1).cast("bigint")}), 1, keep), "runs")
    top = first
    while runs > 1:
        below, top, runs = top, stage_table(_merge_round(top, FAN, keep), "runs"), -(-runs // FAN)
        if below is not first:
            drop_tables(below)
    top = top.select(*_KEY, F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"), "n_same")
    return rows, first.select("run", *_KEY).join(top, _KEY)


@releasing
def assign_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), dropped ones too.

    Returns doc_id, keep_id (doc_id of the row that stays), group_size, kept and text_sha256.
    ``keep``: whether the largest ("max") or smallest ("min") doc_id of equal texts stays.

    * A null text is the empty text; all empty texts are copies of each other.
    * A null doc_id stays only if no copy has one; keep_id is then null.
    * Rows that repeat text and doc_id: one of them is kept, the first in the order of the input.
    * No rows in, no rows out. Other columns of ``docs`` are neither read nor returned.
    """
    rows, found = _merged(docs.select("doc_id", "text"), keep)
    return rows.join(found, ["run", *_KEY]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


@releasing
def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in :func:`assign_copies`.

    All columns are kept, whatever their names. Of rows that repeat text and doc_id one stays.
    """
    names = docs.columns
    _, found = _merged(docs.select("doc_id", "text"), keep)
    keepers = stage_table(found.select(*_KEY, "keep_id", "n_same").distinct(), "keepers").toDF("k_digest", "k_bytes", "k_check", "k_id", "k_same")
    own = with_digest(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")))
    kept = own.join(
        keepers,
        (F.col("digest") == F.col("k_digest")) & (F.col("n_bytes") == F.col("k_bytes")) & (F.col("check") == F.col("k_check")) & F.col("doc_id").eqNullSafe(F.col("k_id")),
    )
    out = kept.where("k_same = 1").select("row.*")
    if keepers.where("k_same > 1").limit(1).count():  # repeated rows: one of each is enough
        out = out.unionByName(kept.where("k_same > 1").dropDuplicates(_KEY).select("row.*"))
    return out
