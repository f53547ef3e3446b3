"""Hard negatives by distributed radix selection.

An anchor's positives are its best other rows of the same label; a positive's negatives are the
best rows of other labels whose score lies in a window below the positive's. Both are the same
question: of each window (anchor, least score, greatest score) the k best rows. It is answered
without sorting or gathering scores: every task scores its rows against a block of anchors and
counts, for each window, how many scores fall into each of 2^DIGIT buckets of the window; the
counts are added up, the bucket that holds the kth score is located, and the window narrows to
that bucket. After as many rounds as the window has digits the kth score is known exactly. Only
then are rows gathered: those above it, and of those that tie with it the least ids.

A task reports no bucket below that of its own kth score: the kth score of all rows can't be
lower. So a task sends k counts a window at most, and k rows a window at the end.

Anchors come in blocks bounded in rows and bytes; a block and the state of its windows are all
that the driver holds and broadcasts. Rows are staged once and read by every pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, releasing, small_batches, stage_table

#: Bits that one pass of the selection decides.
DIGIT = 8
#: Most anchors, and most bytes of their vectors, in one block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 24
#: Rows and anchors that are scored at once in a task.
TILE = 1024
#: Rows that a task gathers before it sorts out the best.
HELD = 1 << 17
#: Scores below this are exact in a double; scores from that on don't fit the result.
EXACT, MOST = 2.0**53, 2.0**62
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass
class Block:
    """Some anchors and their windows, ``slots`` for each anchor, flat: window w is slot w % slots of anchor w // slots."""

    rid: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    slots: int
    low: np.ndarray  # least and greatest score of the window as narrowed so far; low > high: no window
    high: np.ndarray
    need: np.ndarray  # rows still wanted from the narrowed window
    same: bool  # whether rows of the anchor's label are wanted, or of another


def _matrix(column: pa.Array, exact: bool) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    width, values = int(lengths.max(initial=0)), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out if exact else out.astype(np.int64)


def _scored(batch: pa.RecordBatch, block: Block, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the batch, anchor, score) of pairs whose labels fit and whose score is in some window of the anchor."""
    rows, anchors = _matrix(batch.column("vector"), exact), block.vectors
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, anchors))
    rid, label = batch.column("rid").to_numpy(), batch.column("label").to_numpy()
    low, high = block.low.reshape(-1, block.slots), block.high.reshape(-1, block.slots)
    used = low <= high
    least = np.where(used, low, np.iinfo(np.int64).max).min(1)
    most = np.where(used, high, np.iinfo(np.int64).min).max(1)
    for a in range(0, len(anchors), TILE):
        part = slice(a, a + TILE)
        if not used[part].any():
            continue
        for r in range(0, len(rows), TILE):
            scores = rows[r : r + TILE] @ anchors[part].T
            fits = (label[r : r + TILE, None] == block.label[None, part]) == block.same
            fits &= (scores >= least[part]) & (scores <= most[part])
            i, j = np.nonzero(fits)
            other = rid[i + r] != block.rid[j + a]
            i, j = i[other], j[other]
            yield i + r, j + a, scores[i, j].astype(np.int64)


def _in_windows(block: Block, anchor: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, their window) for each slot."""
    for slot in range(block.slots):
        w = anchor * block.slots + slot
        pairs = np.flatnonzero((block.low[w] <= score) & (score <= block.high[w]))
        yield pairs, w[pairs]


def _histograms(held: Broadcast, exact: bool, shift: int, buckets: int) -> Callable:
    """Counts of a task's scores: (window, bucket, n, need), no bucket below that of the window's own kth score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        counts = np.zeros((len(block.low), buckets), np.int64)
        for batch in batches:
            for _, anchor, score in _scored(batch, block, exact):
                for pairs, w in _in_windows(block, anchor, score):
                    np.add.at(counts.reshape(-1), w * buckets + ((score[pairs] - block.low[w]) >> shift), 1)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        w, b = np.nonzero((counts > 0) & (above < block.need[:, None]))
        yield pa.RecordBatch.from_pydict({"w": w.astype(np.int32), "b": b.astype(np.int32), "n": counts[w, b], "need": block.need[w]})

    return count


def _gather(held: Broadcast, exact: bool, k: int, most: int) -> Callable:
    """A task's k best rows of each window, by score and then by id (null last)."""

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["w", "score", "none", "vec_id", "rid"], ascending=[True, False, True, True, True], kind="stable")
        return found[found.groupby("w").cumcount() < k]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        kept, more = None, []
        for batch in batches:
            rid, ids = batch.column("rid").to_numpy(), batch.column("vec_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for row, anchor, score in _scored(batch, block, exact):
                for pairs, w in _in_windows(block, anchor, score):
                    i = row[pairs]
                    more.append(pd.DataFrame({"w": w.astype(np.int32), "score": score[pairs], "vec_id": ids[i], "none": none[i], "rid": rid[i]}))
                if sum(map(len, more)) > most:
                    kept, more = best(pd.concat([*more, *([] if kept is None else [kept])])), []
        if more:
            kept = best(pd.concat([*more, *([] if kept is None else [kept])]))
        if kept is not None and len(kept):
            ids = pa.array(kept["vec_id"].to_numpy(), mask=kept["none"].to_numpy(bool))
            yield pa.RecordBatch.from_arrays([pa.array(kept["w"].to_numpy(np.int32)), pa.array(kept["score"].to_numpy()), ids, pa.array(kept["rid"].to_numpy())], names=["w", "score", "vec_id", "rid"])

    return gather


def _select(rows: DataFrame, block: Block, k: int, exact: bool) -> tuple[DataFrame, Broadcast]:
    """The k best rows of each window, (w, rank, score, vec_id), and the broadcast that they need."""
    share = rows.sparkSession.sparkContext.broadcast
    low, high, need = block.low.copy(), block.high.copy(), np.full(len(block.low), k, np.int64)
    located = block.low <= block.high
    bits = int((high - low)[located].max(initial=0)).bit_length()
    for shift in reversed(range(0, bits, DIGIT)):
        held = share(replace(block, low=np.where(located, low, 1), high=np.where(located, high, 0), need=need))
        counts = rows.mapInArrow(_histograms(held, exact, shift, 1 << DIGIT), "w int, b int, n bigint, need bigint").groupBy("w", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0))
        kth = counts.withColumn("upto", upto).where("upto >= need and upto - n < need").select("w", "b", (F.col("upto") - F.col("n")).alias("above")).toPandas()
        held.destroy()
        w = kth["w"].to_numpy()
        located = np.zeros(len(low), bool)  # the others have fewer than k rows in all
        located[w] = True
        low[w] += kth["b"].to_numpy().astype(np.int64) << shift
        high[w] = np.minimum(high[w], low[w] + (1 << shift) - 1)
        need[w] -= kth["above"].to_numpy()
    held = share(replace(block, low=np.where(located, low, block.low)))
    found = rows.mapInArrow(_gather(held, exact, k, HELD), "w int, score bigint, vec_id bigint, rid bigint")
    order = Window.partitionBy("w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("w", "rank", "score", "vec_id"), held


def _blocks(anchors: DataFrame, size: int) -> Iterator[pa.Table]:
    """The anchors in order of rid, ``size`` at once."""
    last = -1
    while True:
        block = anchors.where(F.col("rid") > last).orderBy("rid").limit(size).toArrow()
        if not block.num_rows:
            return
        last = block.column("rid")[-1].as_py()
        yield block


def _scaled(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


@releasing
def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[Fraction, Fraction] = (Fraction(1, 2), Fraction(19, 20)),
    scale: int = 256,
) -> DataFrame:
    """Hard negatives of each anchor and positive, from ``rows`` (vec_id, embedding, label).

    Components count as floor(scale * x), scores are integer inner products, the higher the better,
    ties go to the smaller vec_id. An anchor's positives are the first ``n_positives`` other rows of
    its label; a positive's negatives are the first ``n_negatives`` rows of other labels whose score is
    within ``window`` times the positive's. ``is_anchor`` tells the anchors, by the columns of ``rows``.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    * Rows with a null label, a null vector, or a component that is null or not finite take no part.
    * Rows that repeat an id are rows of their own: each can be an anchor, a positive, a negative, of its
      copy too. A null id comes last among ties.
    * Of vectors of different lengths the shorter ends in zeros; an empty one has the score 0 with all.
    * A positive with a negative score has an empty window. Scores of 2^62 and more raise an ArithmeticError.
    * No rows or no anchors: no rows out. Other columns are neither read nor returned.
    """
    spark = rows.sparkSession
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = rows.where(sound).select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        _scaled("embedding", scale).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    taken = stage_table(taken, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    size = taken.agg(F.max(F.size("vector")).alias("width"), F.max(square).alias("all"), F.max(F.when(F.col("anchor"), square)).alias("anchors")).first()
    result = new_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(result)
    found = spark.read.schema(RESULT).parquet(result)
    if size["anchors"] is None:
        return found
    bound = math.sqrt(size["all"]) * math.sqrt(size["anchors"]) * (1 + 1e-9) + 1
    if not bound < MOST:
        raise ArithmeticError("scores don't fit a long")
    exact, bound = bound < EXACT, math.ceil(bound)
    vectors = taken.select("rid", "vec_id", "label", "vector")
    anchors = stage_table(taken.where("anchor").select("rid", "vec_id", "label", "vector"), "anchors")
    with small_batches(spark):
        for block in _blocks(anchors, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, size["width"]))))):
            _mine(vectors, block, bound, exact, n_positives, n_negatives, window).write.mode("append").parquet(result)
    return spark.read.schema(RESULT).parquet(result)


def _mine(vectors: DataFrame, anchors: pa.Table, bound: int, exact: bool, n_positives: int, n_negatives: int, window: tuple[Fraction, Fraction]) -> DataFrame:
    """The hard negatives of one block of anchors."""
    n = anchors.num_rows
    ids = anchors.column("vec_id").to_pylist()
    block = Block(
        anchors.column("rid").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector"), exact),
        1, np.full(n, -bound), np.full(n, bound), np.full(n, n_positives), True,
    )
    best, held = _select(vectors, block, n_positives, exact)
    positives = best.collect()
    held.destroy()
    low, high = np.ones(n * n_positives, np.int64), np.zeros(n * n_positives, np.int64)
    rows = []
    for p in positives:
        w = p["w"] * n_positives + p["rank"] - 1
        low[w], high[w] = math.ceil(p["score"] * window[0]), math.floor(p["score"] * window[1])
        rows.append((w, ids[p["w"]], p["vec_id"], p["score"]))
    windows = vectors.sparkSession.createDataFrame(rows, "w int, anchor_id bigint, positive_id bigint, positive_score bigint")
    best, _ = _select(vectors, replace(block, slots=n_positives, low=low, high=high, same=False), n_negatives, exact)
    return best.join(F.broadcast(windows), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
