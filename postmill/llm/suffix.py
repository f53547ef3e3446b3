"""Removal of repeated byte strings by refining buckets of suffixes.

Which strings of LENGTH bytes start at two places is a question about suffixes sorted by their
first LENGTH bytes. As in bucket-pointer refinement, suffixes first fall into buckets of a q-gram,
and a bucket is refined by what stands at later offsets, named by bucket identifiers instead of
compared byte by byte. Here an identifier is a 128-bit polynomial name of the bytes (modulo a prime), so that
tasks agree on it without a global sort.

1. Each window of LENGTH bytes belongs to the q-gram with the least hash in it (rightmost on a
   tie), which only its content decides: equal windows have it at the same offset. Neighbouring
   windows with the same q-gram form an interval; there are about 2 intervals for LENGTH bytes.
2. Buckets of one interval are done. In others the intervals are named as a whole (all bytes
   that their windows cover). A bucket whose names all agree is done: all its windows repeat.
3. The rest is refined over blocks of 64, 8 and then single offsets. A block's core (the bytes in
   all of its windows) and hull (the bytes in any) are named: a core that stands alone ends the
   block without repeats, a hull that occurs twice ends it with repeats for those that share it,
   others go on. Of rows that share a hull only one goes on, as a witness for the others' sake.

All grouping is by name with counts, so a passage that a third of all documents share costs a row
for each document, never a pair. Texts are moved only for documents that need it: fixed-size
bitmaps of those keys are sent to the tasks, and what they pass wrongly the joins drop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_bitmap, key_bitmap, keyed, releasing, stage_table

#: Bytes of a repeated string, of a q-gram, offsets of a block in each round, bytes that are hashed at once.
LENGTH, Q, BLOCK_SIZES, CHUNK = 400, 32, (64, 8, 1), 1 << 17
_MASK = np.uint64((1 << 20) - 1)


#: The prime that names are sums modulo of, and the bases of their polynomials.
_PRIME = (1 << 31) - 1
_BASES = (1_234_567_891, 1_987_654_321, 1_105_023_703, 1_772_938_409)


class Names:
    """128-bit names of all substrings of some bytes: polynomial prefix sums modulo a prime, two for each 64 bits.

    The prime matters: modulo a power of two, sequences such as Thue and Morse's collapse for every base.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def tables(cls, j: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of polynomial ``j`` the letters' values, the base's powers and their inverses, for ``n`` bytes at least."""
        if j not in cls._tables or len(cls._tables[j][1]) <= n:
            n = max(1 << 16, 1 << n.bit_length())
            letters = np.random.default_rng(20_240_607 + j).integers(1, _PRIME, 256, dtype=np.uint64)
            cls._tables[j] = letters, _powers(_BASES[j], n), _powers(pow(_BASES[j], -1, _PRIME), n)
        return cls._tables[j]

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, {}

    def _sums(self, j: int) -> np.ndarray:
        if j not in self.sums:
            letters, powers, _ = self.tables(j, len(self.raw))
            terms = letters[self.raw] * powers[: len(self.raw)] % np.uint64(_PRIME)
            self.sums[j] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])  # no overflow: 2**33 letters
        return self.sums[j]

    def __call__(self, start: np.ndarray, length, k: int = 0) -> np.ndarray:
        """Names number ``k`` (0 or 1) of the substrings."""
        part = []
        for j in (2 * k, 2 * k + 1):
            sums = self._sums(j)
            part.append((sums[start + length] - sums[start]) % np.uint64(_PRIME) * self._tables[j][2][start] % np.uint64(_PRIME))
        return mix(part[0] << np.uint64(32) | part[1])


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
    return out[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def blend(x: np.ndarray, *more) -> np.ndarray:
    """A name of a name and some small numbers or other names."""
    for y in more:
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + np.asarray(y).astype(np.uint64) + np.uint64(1))
    return x


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, in linear time."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def intervals(raw: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """Intervals of windows with the same q-gram: first and last window, q-gram, and their names.

    ``valid``: of each position whether a window starts there.
    """
    names = Names(raw)
    width = LENGTH - Q + 1
    at = np.arange(len(raw) - Q + 1)
    grams = names(at, Q)
    rank = (grams & ~_MASK) | (_MASK - at.astype(np.uint64))  # rightmost on a tie; positions are below 2**20
    least = _sliding_least(rank, width)
    i = np.flatnonzero(valid[: len(least)])
    gram_at = (_MASK - (least[i] & _MASK)).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (gram_at[1:] != gram_at[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    s, e, a = i[first], i[last], gram_at[first]
    hull = [blend(names(s, e - s + LENGTH, k), a - s, e - s) for k in (0, 1)]
    return {"s": s, "e": e, "a": a, "gram": grams[a], "hull1": hull[0], "hull2": hull[1]}


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to at most CHUNK bytes; longer ones in overlapping parts.

    Yields the bytes, where windows start, and of each part its text, its place in the bytes and in the text.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        raw = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
        place = np.cumsum([0, *[len(p) for *_, p in parts]])
        valid = np.zeros(len(raw), bool)
        for (_, _, p), at in zip(parts, place, strict=False):
            valid[at : at + len(p) - LENGTH + 1] = True
        return raw, valid, np.array([k for k, *_ in parts]), place[:-1], np.array([o for _, o, _ in parts])

    for k, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH + 1):
            part = text[offset : offset + CHUNK]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > CHUNK:
                yield joined()
                parts, size = [], 0
            parts.append((k, offset, part))
            size += len(part)
    if parts:
        yield joined()


_ANCHOR = "k1 bigint, k2 bigint, s int, e int, a int, gram bigint, hull1 bigint, hull2 bigint"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _ANCHOR.replace(",", "").split()[::2]
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
        for raw, valid, text, place, offset in _chunks([x.as_py().encode("utf-8", "replace") for x in batch.column(2)]):
            found = intervals(raw, valid)
            part = np.searchsorted(place, found["s"], "right") - 1
            shift = offset[part] - place[part]
            columns = [pa.array(k1[text[part]]), pa.array(k2[text[part]])]
            columns += [pa.array((found[n] + shift).astype(np.int32)) for n in "sea"]
            columns += [pa.array(found[n].view(np.int64)) for n in ("gram", "hull1", "hull2")]
            yield pa.RecordBatch.from_arrays(columns, names)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (k1, k2, s, e, ...) with ctx, the bytes that the windows s to e cover."""
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(), bits.value)))

    own = keyed(docs).select("spot", "k1", "k2", "text").mapInArrow(some, "spot bigint, k1 bigint, k2 bigint, text string").drop("spot")
    own = own.withColumn("raw", F.col("text").cast("binary")).drop("text").dropDuplicates(["k1", "k2"])
    span = F.substring("raw", F.col("s") + 1, F.col("e") - F.col("s") + LENGTH)
    return wanted.join(own, ["k1", "k2"]).withColumn("ctx", span).drop("raw")


_BLOCK = "cid bigint, lo int, low int, high int, core1 bigint, core2 bigint, hull1 bigint, hull2 bigint, need boolean"


def _blocks(size: int):
    """Names of the blocks of ``size`` offsets inside the wanted larger ones (null: all) of each interval."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = _BLOCK.replace(",", "").split()[::2]
        for batch in batches:
            cid, gram = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            d1, d2 = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            need, ctx, wanted = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5), batch.column(6).to_pylist()
            at = 0
            while at < batch.num_rows:
                begin, stop, total = at, at, 0
                while stop < batch.num_rows and (stop == begin or total + 2 * LENGTH < CHUNK):
                    total += len(ctx[stop].as_py())
                    stop += 1
                pieces = [ctx[i].as_py() for i in range(begin, stop)]
                names = Names(np.frombuffer(b"".join(pieces), np.uint8))
                base = np.cumsum([0, *map(len, pieces)])
                rows, los = [], []
                for i in range(begin, stop):
                    blocks = range(int(d1[i]) // size * size, int(d2[i]) + 1, size)
                    if wanted[i] is not None:
                        outer = BLOCK_SIZES[BLOCK_SIZES.index(size) - 1]
                        inside = set(wanted[i])
                        blocks = [b for b in blocks if b // outer * outer in inside]
                    los += blocks
                    rows += [i] * len(blocks)
                at, row, lo = stop, np.array(rows, np.int64), np.array(los, np.int64)
                if not len(row):
                    continue
                low, high = np.maximum(lo, d1[row]), np.minimum(lo + size - 1, d2[row])
                zero = base[row - begin] + d2[row]  # where the q-gram stands in the bytes
                core = [blend(names(zero - lo, LENGTH - size + 1, k), gram[row], lo) for k in (0, 1)]
                hull = [blend(names(zero - high, LENGTH + high - low, k), core[k], low - lo, high - lo) for k in (0, 1)]
                columns = [pa.array(cid[row]), *[pa.array(x.astype(np.int32)) for x in (lo, low, high)], *[pa.array(x.view(np.int64)) for x in (*core, *hull)], pa.array(need[row])]
                yield pa.RecordBatch.from_arrays(columns, names_of)

    return name


def _refine(contexts: DataFrame) -> DataFrame:
    """(k1, k2, s, e): windows of the intervals in ``contexts`` that repeat."""
    found = []
    pending: DataFrame | None = None
    core, hull = ["core1", "core2"], ["core1", "core2", "hull1", "hull2"]
    for size in BLOCK_SIZES:
        rows = contexts.withColumn("wanted", F.lit(None).cast("array<int>")) if pending is None else contexts.join(pending, "cid")
        named = stage_table(rows.select("cid", "gram", "d1", "d2", "need", "ctx", "wanted").mapInArrow(_blocks(size), _BLOCK), f"blocks{size}")
        hulls = stage_table(named.groupBy(*hull).agg(F.count("*").alias("n"), F.min("cid").alias("rep")), f"hulls{size}")
        cores = hulls.groupBy(*core).agg(F.sum("n").alias("n_core"), F.count("*").alias("n_hull"))
        judged = named.join(hulls.join(cores, core), hull)
        found.append(judged.where("need and n > 1").select("cid", "low", "high"))
        if size > 1:
            on = judged.where("n_hull > 1 and (n = 1 or cid = rep)").groupBy("cid").agg(F.collect_set("lo").alias("wanted"))
            pending = stage_table(on, f"pending{size}")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    spans = hits.join(contexts.select("cid", "k1", "k2", "a"), "cid")
    return spans.select("k1", "k2", (F.col("a") - F.col("high")).alias("s"), (F.col("a") - F.col("low")).alias("e"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(k1, k2, s, e): windows of LENGTH bytes starting at s to e occur elsewhere too."""
    own = keyed(docs).select("k1", "k2", "text")
    anchors = stage_table(own.mapInArrow(_anchors, _ANCHOR), "anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), (F.min("hull1") != F.max("hull1")).alias("contested"))
    grams = stage_table(grams.where("n > 1").drop("n"), "grams")  # buckets of two suffixes and more; a table of its own, so that the join can split a hot one
    shared = stage_table(anchors.join(grams, "gram"), "shared")
    done = shared.where("not contested").select("k1", "k2", "s", "e")
    key = ["gram", "hull1", "hull2"]
    member = F.struct("k1", "k2", "s", "e", "a")
    hulls = stage_table(shared.where("contested").groupBy(*key).agg(F.count("*").alias("n"), F.min(member).alias("m")), "hulls")
    equal = shared.where("contested").join(hulls.where("n > 1").select(*key), key).select("k1", "k2", "s", "e")
    reps = hulls.select("gram", "m.*", (F.col("n") == 1).alias("need"))
    reps = reps.withColumns({"d1": F.col("a") - F.col("e"), "d2": F.col("a") - F.col("s"), "cid": F.monotonically_increasing_id()})  # over a staged table, before any shuffle, and staged at once: a number of its own, the same in a task's rerun
    contexts = stage_table(_contexts(docs, reps), "contexts")
    return done.unionByName(equal).unionByName(_refine(contexts))


def removed_spans(n: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of the bytes that windows starting at starts to ends cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), (ends + LENGTH).tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_FULL = _RESULT + ", spans array<struct<begin:int,end:int>>, kept binary"


@releasing
def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte that a string of 400 bytes covers that also starts anywhere else, in the same
    document or another; matches never cross documents. ``with_kept`` adds spans and kept (binary).

    * A null or empty text has no bytes; texts under 400 bytes lose nothing.
    * Rows that repeat doc_id and text count as two places: both lose what they share.
    * Null ids are ids like others. Ties don't arise: all places of a string are removed.
    * Other columns of ``docs`` are ignored. No rows in, no rows out.
    """
    spans = stage_table(repeated_windows(docs).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("w")), "spans")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(spans))
    names = [f.split()[0] for f in (_FULL if with_kept else _RESULT).split(", ")]

    def result(ids: pa.Array, texts: list[bytes], windows: list) -> pa.RecordBatch:
        rows = []
        for text, w in zip(texts, windows, strict=True):
            runs = removed_spans(len(text), np.array([x["s"] for x in w], np.int64), np.array([x["e"] for x in w], np.int64)) if w else []
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"begin": a, "end": b} for a, b in runs], left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.binary())
        columns = [ids, *[pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - 1)]]
        return pa.RecordBatch.from_arrays(columns, names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~in_bitmap(batch.column(0).to_numpy(), bits.value)))
            yield result(batch.column(1), [x.as_py().encode("utf-8", "replace") for x in batch.column(2)], [None] * batch.num_rows)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(), bits.value)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch.column(0), [x.as_py().encode("utf-8", "replace") for x in batch.column(1)], batch.column(2).to_pylist())

    schema = _FULL if with_kept else _RESULT
    own = keyed(docs)
    without = own.select("spot", "doc_id", "text").mapInArrow(plain, schema)
    some = own.select("spot", "doc_id", "text", "k1", "k2").mapInArrow(marked, "spot bigint, doc_id bigint, text string, k1 bigint, k2 bigint")
    some = some.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "w").mapInArrow(cut, schema)
    return without.unionByName(some)
