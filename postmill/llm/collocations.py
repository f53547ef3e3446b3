"""Phrase collocations from vertical positional inverted lists.

The corpus is cut into shards, and each shard is held vertically: one row for each of its words
with the sorted positions at which the word stands. Positions leave a gap wherever a piece ends, so
that words follow each other exactly if their positions do. A phrase of k words is extended by a
merge join of its occurrences, moved by k, with the postings of the words: the joined list's
length is the longer phrase's frequency in the shard, and the sum over the shards its frequency.

Only phrases that are frequent in the whole corpus are extended, level by level: a level's counts
(one row for each phrase and shard) are summed, and the rows of the frequent ones go back to their
shards. Words and phrases are joined by what they are, never by a hash. No task holds more than
some shards, and no table of frequent phrases is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, small_batches, stage_table, whole_text

#: Bytes of text from which on a shard is closed.
SHARD_BYTES = 1 << 23
#: Lists that leave a task at once.
LISTS = 10_000
#: Bytes that end a piece, and bytes that separate words, beside those.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_POSTINGS = "shard bigint, lang string, word string, n bigint, positions binary"


def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its lower case (A-Z only), whether it ends a piece, whether it separates words."""
    lower, ends = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[ord("A") : ord("Z") + 1] += 32
    ends[list(PIECE_ENDS)] = True
    parts = ends.copy()
    parts[list(BLANKS)] = True
    return lower, ends, parts


LOWER, ENDS, PARTS = _byte_kinds()


def _postings(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, the ends of their lists, all positions by word) of some texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a piece ends where a text does
    part = PARTS[data]
    first = np.flatnonzero(~part & np.concatenate(([True], part[:-1])))
    last = np.flatnonzero(part[1:] & ~part[:-1]) + 1
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    piece = np.cumsum(ENDS[data], dtype=np.int32)[first]
    position = np.arange(len(first), dtype=np.int32) + np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])), dtype=np.int32)
    offsets = np.concatenate(([0], np.cumsum(last - first)))
    letters = LOWER[data[~part]]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
    slot = words.indices.to_numpy()
    order = np.argsort(slot, kind="stable")
    return words.dictionary.cast(pa.string()), np.cumsum(np.bincount(slot, minlength=len(words.dictionary))), position[order]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists as binary cells, little-endian 32-bit."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4"))]).cast(pa.binary())


def _shards(most: int):
    """The vertical lists of a task's texts; a shard is the texts of one language among some ``most`` bytes of text."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1]) + 1
                if size >= most:
                    yield from closed(held, shard)
                    shard, size, held = shard + len(held), 0, {}
        yield from closed(held, shard)

    def closed(held: dict[str, list[bytes]], shard: int) -> Iterator[pa.RecordBatch]:
        for at_shard, (lang, texts) in enumerate(held.items(), shard):
            words, ends, positions = _postings(texts)
            n, lists = np.diff(ends, prepend=0), _lists(positions, ends)
            for at in range(0, len(words), LISTS):
                part = words.slice(at, LISTS)
                columns = [pa.array(np.full(len(part), at_shard)), pa.array([lang] * len(part)), part, pa.array(n[at : at + LISTS]), lists.slice(at, LISTS)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "word", "n", "positions"])

    return shards


def _by_position(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all positions in a column of lists, in order of position; no position is in two lists."""
    cells = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    position = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4")
    row_at = np.full(int(position.max()) + 1, -1)
    row_at[position] = np.repeat(np.arange(len(cells)), np.diff(ends) // 4)
    position = np.flatnonzero(row_at >= 0)
    return row_at[position], position


def _adjacent(position: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of occurrences moved by ``k`` with postings, both sorted: (occurrence, posting) of those that meet."""
    found = np.searchsorted(at, position + k)
    met = np.flatnonzero(found < len(at))
    met = met[at[found[met]] == position[met] + k]
    return met, found[met]


def _extended(k: int):
    """Counts of phrases of k + 1 words in a shard, from its words' lists and its frequent phrases of k words."""
    names = [f"w{i}" for i in range(1, k + 2)]

    def extend(words: pa.Table, phrases: pa.Table) -> pa.Table:
        if not words.num_rows or k > 1 and not phrases.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ["shard", *names, "n"]})
        wid = words.column("wid").to_numpy()
        by_id = np.argsort(wid)
        index = lambda c: by_id[np.searchsorted(wid[by_id], phrases.column(c).to_numpy())]
        word, at = _by_position(words.column("positions"))
        head, position, known = word, at, wid[:, None]  # occurrences: the phrase's number, where it begins; the words of each phrase
        number = index("w1") if k > 1 else None  # of each frequent phrase's first words
        for j in range(1, k):
            met, posting = _adjacent(position, at, j)
            codes, row, number = np.unique(number * len(wid) + index(names[j]), return_index=True, return_inverse=True)
            code = head[met] * len(wid) + word[posting]
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            kept = codes[found] == code  # only what begins a frequent phrase goes on
            head, position = found[kept], position[met[kept]]
            known = np.stack([phrases.column(c).to_numpy()[row] for c in names[: j + 1]], 1)
        met, posting = _adjacent(position, at, k)
        if k > 1:  # the last k words are a frequent phrase too, else the longer one isn't
            follows, _ = _adjacent(position[met], position, 1)
            met, posting = met[follows], posting[follows]
        codes, n = np.unique(head[met] * len(wid) + word[posting], return_counts=True)
        named = [*known[codes // len(wid)].T, wid[codes % len(wid)]]
        shard = np.full(len(codes), words.column("shard")[0].as_py())
        return pa.table({"shard": shard, **dict(zip(names, named, strict=True)), "n": n.astype(np.int64)})

    return extend, ", ".join(f"{c} bigint" for c in ["shard", *names, "n"])


def _frequent(counts: DataFrame, names: list[str], least: int) -> DataFrame:
    """The rows (phrase, shard) of phrases with ``least`` occurrences in all shards, and that frequency."""
    total = F.sum("n").over(Window.partitionBy(*names))
    return counts.withColumn("f", total).where(F.col("f") >= least).drop("n")


def postings(docs: DataFrame) -> DataFrame:
    """Vertical lists of the texts: (shard, lang, word, n, positions)."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    return stage_table(rows.mapInArrow(_shards(SHARD_BYTES), _POSTINGS), "postings")


def _phrase_tables(lists: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The frequent words (wid, lang, word, f), and all frequent words and phrases (lang, ws: array of word ids, f)."""
    counted = lists.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = stage_table(counted.where(F.col("f") >= least).withColumn("wid", F.monotonically_increasing_id()), "words")
    known = stage_table(lists.join(words, ["lang", "word"]).select("shard", "wid", "positions"), "frequent-words")
    found = words.select("lang", F.array("wid").alias("ws"), "f")
    phrases = known.select("shard").limit(0)
    for k in range(1, longest):
        extend, schema = _extended(k)
        names = [c.split()[0] for c in schema.split(", ")][1:-1]
        counts = known.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(extend, schema)
        phrases = stage_table(_frequent(counts, names, least), f"phrases-{k + 1}")
        of = words.select(F.col("wid").alias("w1"), "lang")
        found = found.unionByName(phrases.drop("shard").distinct().join(of, "w1").select("lang", F.array(*names).alias("ws"), "f"))
    return words, stage_table(found, "phrases")


def _score(a: Column, parts: Column, scale: int) -> Column:
    """floor(scale * a / parts); the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(18,0)") * wide(a), wide(parts))


@releasing
def collocations(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, covered: int = 80, most: int = 2000) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language of ``docs`` (text, lang).

    Words are split at space, tab and the ends of pieces (``PIECE_ENDS``), A-Z lower-cased. A phrase
    with a >= ``least`` occurrences within pieces is a candidate; its score is the least of
    floor(scale * a / (l + r)) over its cuts into parts with l and r occurrences, at the smallest cut of
    equal ones. Candidates go if a longer one that holds them has at least ``covered`` hundredths of their
    occurrences. Returns the first ``most`` of each language (a report's limit): lang, rank, phrase, a, l, r,
    n (words of the language), score, by score, a (both descending) and phrase (bytes).

    * A null text is empty, a null lang is ``und`` (and one with a lang of that name).
    * Repeated rows count as often as they are there; ids are not read.
    * Texts of any length are read whole; one document is the least that a shard holds.
    * No rows, or no candidate in a language: no rows out. Other columns are neither read nor returned.
    """
    with small_batches(docs.sparkSession):
        lists = postings(docs)
        words, found = _phrase_tables(lists, longest, least)
    length = F.size("ws")
    candidates = found.where(length > 1)
    cuts = candidates.select("lang", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ws", 1, F.col("k")).alias("left"), F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")).alias("right"))
    part = lambda name, f: found.select(F.col("ws").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l") + F.col("r"), scale))
    scored = cuts.groupBy("lang", "ws").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), length - 1), lambda m: F.transform(F.sequence(F.lit(1), length - m + 1), lambda i: F.slice("ws", i, m))))
    longer = candidates.where(length > 2).select(F.explode(inner).alias("ws"), F.col("f").alias("cover")).groupBy("ws").agg(F.max("cover").alias("cover"))
    wide = lambda c, by: c.cast("decimal(19,0)") * F.lit(by).cast("decimal(9,0)")
    open_ = scored.join(longer, "ws", "left").where(F.col("cover").isNull() | (wide(F.col("cover"), 100) < wide(F.col("a"), covered)))

    spelled = open_.select("lang", "ws", "a", "cut", F.posexplode("ws").alias("i", "wid")).join(words.select("wid", "word"), "wid")
    spelled = spelled.groupBy("lang", "ws").agg(F.first("a").alias("a"), F.first("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
    spelled = spelled.select("lang", "a", "cut.*", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))).where(F.col("rank") <= most)
    sizes = lists.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
