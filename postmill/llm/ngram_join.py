"""Near duplicates: an exact Jaccard self-join of word shingles by grouped prefixes.

A document's set is its distinct shingles of WORDS words, as 64-bit names. Let a be the least overlap
that links a set of n tokens with any other, ceil(0.8 n), and p = n - a + 1. Of two sets that link, the
first p tokens of either share one, in any order of tokens that all agree on.

1. Sieve. Of the first SIEVE n tokens in the order of names (p at least), a set that links with another
   one shares a token for each beyond p. Tokens meet in buckets, packed as arrays; what several sets
   have that one task holds is combined there, so a token that a third of all documents have costs one
   entry a task. Each set gets back how many of those tokens another set has, and no pair arises.
2. Equal sets are one. For what the sieve leaves, tokens are counted exactly; the order is now rarest
   first. A set with fewer than a tokens that another has links with nothing and is out.
3. Sets with the same size, number of shared tokens and prefix are one group. A group's entry at a token
   says how many shared tokens stand from it on: the overlap of two groups whose first common token it
   is can't be larger, which decides on size and position before a pair exists.
4. Leaders. Of a token's groups the one with the fewest unshared tokens leads; the members of the others
   are verified against one member of it, and a group's members against one of their own. That is linear
   in entries, however large a group of near copies is. Links join to components.
5. Rest. A group is open at a token if its component isn't the token's commonest and the bound of 3
   leaves it any partner there. Open groups have leaders of their own for some rounds; then each is
   joined with all groups of other components that the bound allows, expanded to members and verified.

So every two sets that could link are verified, can't reach the overlap, or are in one component
already. Links, components and sets never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_bitmap, key_bitmap, keyed, releasing, shuffle_width, stage_table, whole_text
from .suffix import Names, blend

#: Words of a shingle; least similarity in percent; share of a set that the sieve looks at, in percent.
WORDS, PERCENT, SIEVE = 5, 80, 30
#: Rounds of leaders before the rest is joined. Changes the work, never the result.
ROUNDS = 2
#: Tokens that a task of the sieve holds at once, bytes of input for each bucket of the sieve, bytes that are hashed at once.
HELD, BUCKET_BYTES, CHUNK = 500_000, 1 << 23, 1 << 16


_SIMPLE = np.arange(256, dtype=np.uint8)  # A-Z lower-cased, the six separators as spaces
_SIMPLE[65:91] += 32
_SIMPLE[9:14] = 32


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Of each text its set of shingles, as sorted 64-bit names; texts are hashed together, CHUNK bytes at once."""
    out, group, size = [], [], 0
    for text in texts:
        raw = text.encode("utf-8", "replace")
        if group and size + len(raw) > CHUNK:
            out += _shingles(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    return out + (_shingles(group) if group else [])


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    """A shingle's name blends those of its words; under WORDS words all of them are the only shingle."""
    flat = _SIMPLE[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    edge = np.diff(np.r_[False, flat != 32, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK)))
        words[at:stop] = Names(flat[starts[at] : ends[stop - 1]])(starts[at:stop] - starts[at], ends[at:stop] - starts[at:stop])
        at = stop
    runs = [words[i : len(words) - WORDS + 1 + i] for i in range(WORDS)] if len(words) >= WORDS else []
    names = blend(np.full(len(runs[0]), WORDS, np.uint64), *runs) if runs else words[:0]
    first = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(names[a : b - WORDS + 1]))
        else:
            out.append(blend(np.full(min(1, b - a), b - a, np.uint64), *[words[i : i + 1] for i in range(a, b)]))
    return out


def least_overlap(n):
    """Tokens that a set of ``n`` shares at least with any set it is linked with."""
    return -(-PERCENT * n // 100)


def sieve_size(n: int) -> int:
    """How many tokens of a set of ``n`` the sieve looks at."""
    return max(n - least_overlap(n) + 1, -(-SIEVE * n // 100))


def must_share(n: int) -> int:
    """Of those tokens, how many a set that it's linked with has among its own: one is given up for rounding, the other set's size may differ."""
    return max(1, sieve_size(n) - (n - least_overlap(n)) - 1)


_PACKED = "bucket int, flush bigint, kind int, blob binary"
_DOCS = 8  # doc_id, whether it is null, k2, n, the set's two names, tokens that must be shared, those that the task knows to be shared


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = _PACKED.replace(",", "").split()[::2]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)


def _first_tokens(buckets: int, held_tokens: int):
    """Of the texts of a task, about ``held_tokens`` tokens at once: a row of the documents (kind 0), and one a bucket of their first tokens (kind 1)."""

    def flush(number: int, docs: list[tuple], sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        own = np.array(docs, np.int64).reshape(-1, _DOCS)
        flush_id = (TaskContext.get().partitionId() << 24) + number
        keys = np.fromiter(sets, np.int64, len(sets))
        held = list(sets.values())
        tokens, owner = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(np.arange(len(held)), [len(t) for t in held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
        begin = np.flatnonzero(new)
        many = np.diff(np.r_[begin, len(tokens)]) > 1  # several sets of this flush have it
        known = np.bincount(owner[many[np.cumsum(new) - 1]], minlength=len(held)) if len(tokens) else np.zeros(len(held), np.int64)
        by_key = dict(zip(keys.tolist(), known.tolist(), strict=True))
        own[:, -1] = [by_key.get(k, 0) for k in own[:, 4].tolist()]
        tokens, holder = tokens[begin], np.where(many, 0, keys[owner[begin]]) if len(begin) else keys[:0]
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens, holder, bucket = tokens[order], holder[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True][: len(bucket) + 1]) if len(bucket) else []
        rows = [(int(flush_id % buckets), flush_id, 0, own.tobytes())]
        rows += [(int(bucket[a]), flush_id, 1, tokens[a:b].tobytes() + holder[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _packed(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        sets: dict[int, np.ndarray] = {}
        size = number = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for doc_id, k2, tokens in zip(columns[0], columns[1], shingles(columns[2]), strict=True):
                n = len(tokens)
                name = xxhash.xxh3_128_intdigest(tokens.tobytes())
                d1, d2 = ((name >> 64) - (1 << 63)) or 1, (name & ((1 << 64) - 1)) - (1 << 63)  # 0 says: several sets
                docs.append((doc_id or 0, doc_id is None, k2, n, d1, d2, must_share(n), 0))
                if n and d1 not in sets:
                    sets[d1] = tokens[: sieve_size(n)].copy()
                    size += sieve_size(n)
                if size > held_tokens or len(docs) > held_tokens // 8:
                    yield flush(number, docs, sets)
                    docs, sets, size, number = [], {}, 0, number + 1
        if docs:
            yield flush(number, docs, sets)

    return emit


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: for each flush the sets of its tokens that another set has (kind 2); kind 0 passes."""

    def shared(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        half = [len(x) // 2 for _, x in parts]
        tokens = np.concatenate([x[:h] for (_, x), h in zip(parts, half, strict=True)])
        holder = np.concatenate([x[h:] for (_, x), h in zip(parts, half, strict=True)])
        flush = np.repeat(np.array([f for f, _ in parts]), half)
        order = np.argsort(tokens, kind="stable")
        tokens, holder, flush = tokens[order], holder[order], flush[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        other = np.logical_or.reduceat(holder != holder[begin][run], begin) | (holder[begin] == 0)
        found = other[run] & (holder != 0)
        holder, flush = holder[found], flush[found]
        order = np.argsort(flush, kind="stable")
        holder, flush = holder[order], flush[order]
        edges = np.flatnonzero(np.r_[True, flush[1:] != flush[:-1], True]) if len(flush) else np.zeros(1, np.int64)
        return _packed([(0, int(flush[a]), 2, holder[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    at, parts = None, []
    for batch in batches:
        for bucket, flush, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if kind == 0:
                yield _packed([(0, flush, 0, blob)])
                continue
            if bucket != at and parts:
                yield shared(parts)
                parts = []
            at = bucket
            parts.append((flush, np.frombuffer(blob, np.int64)))
    if parts:
        yield shared(parts)


_ROWS = "doc_id bigint, k2 bigint, n bigint, d1 bigint, d2 bigint, open boolean"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by flush: the documents, and whether their sets share enough to stay."""

    def rows(own: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
        holder = np.sort(np.concatenate([np.zeros(0, np.int64), *held]))
        found = np.searchsorted(holder, own[:, 4], "right") - np.searchsorted(holder, own[:, 4], "left") + own[:, 7]
        columns = [pa.array(own[:, 0], mask=own[:, 1] == 1), *[pa.array(own[:, i]) for i in (2, 3, 4, 5)], pa.array((own[:, 3] > 0) & (found >= own[:, 6]))]
        return pa.RecordBatch.from_arrays(columns, _ROWS.replace(",", "").split()[::2])

    at, own, held = None, np.zeros((0, _DOCS), np.int64), []
    for batch in batches:
        for flush, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if flush != at:
                if len(own):
                    yield rows(own, held)
                at, own, held = flush, np.zeros((0, _DOCS), np.int64), []
            if kind == 0:
                own = np.frombuffer(blob, np.int64).reshape(-1, _DOCS)
            else:
                held.append(np.frombuffer(blob, np.int64))
    if len(own):
        yield rows(own, held)


def _sieved(docs: DataFrame, held_tokens: int) -> DataFrame:
    """A row for each of ``docs`` (doc_id, k2, text): doc_id, k2, n, the set's names d1 and d2, and whether it may link with another set."""
    bytes_in = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(max(shuffle_width(docs.sparkSession), bytes_in // BUCKET_BYTES), 1 << 20)
    first = docs.select("doc_id", "k2", "text").mapInArrow(_first_tokens(buckets, held_tokens), _PACKED)
    met = first.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _PACKED)
    back = met.select("flush", "kind", "blob").repartition("flush").sortWithinPartitions("flush")
    return stage_table(back.mapInArrow(_decide, _ROWS), "sieved")


_SETS = "sid bigint, n bigint, tokens array<bigint>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = shingles(batch.column(1).to_pylist())
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        values = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
        columns = [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
        yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "tokens"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets ``wanted`` (sid, k1, k2), from the texts of ``docs``."""
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(), bits.value)))

    own = keyed(docs).select("spot", "k1", "k2", "text").mapInArrow(some, "spot bigint, k1 bigint, k2 bigint, text string")
    own = own.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["sid"])
    return stage_table(own.select("sid", "text").mapInArrow(_tokens, _SETS), "sets")


def enough(most: Column, n_a: Column, n_b: Column) -> Column:
    """Whether an overlap of ``most`` links sets of these sizes."""
    return most * (100 + PERCENT) >= (n_a + n_b) * PERCENT


def _candidates(sets: DataFrame) -> DataFrame:
    """Sets that share enough tokens: sid, n, c (shared tokens), tokens (the shared ones, rarest first), prefix, gid (the group's least sid)."""
    entries = sets.select("sid", "n", F.explode("tokens").alias("token"))
    often = stage_table(entries.groupBy("token").agg(F.count("*").alias("seen")).where("seen > 1"), "shared")
    kept = entries.join(often, "token").groupBy("sid", "n").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("t"))
    least = F.ceil(F.col("n") * PERCENT / 100)
    kept = kept.where(F.col("c") >= least).withColumn("tokens", F.col("t.token"))
    kept = kept.withColumn("prefix", F.slice("tokens", F.lit(1), (F.col("c") - least + 1).cast("int")))
    kept = stage_table(kept.select("sid", "n", "c", "tokens", "prefix", F.xxhash64("prefix").alias("h1"), F.xxhash64(F.lit(1), "prefix").alias("h2")), "candidates")
    key = ["n", "c", "h1", "h2"]
    groups = kept.groupBy(*key).agg(F.min("sid").alias("gid"))
    return stage_table(kept.join(groups, key).select("sid", "gid", "n", "c", "tokens", "prefix"), "grouped")


def _entries(grouped: DataFrame) -> DataFrame:
    """(token, gid, n, c, r): prefix tokens of groups that another group has too; r: shared tokens from that one on."""
    rows = grouped.where("sid = gid").select("gid", "n", "c", F.posexplode("prefix").alias("pos", "token"))
    often = rows.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    return stage_table(rows.join(often, "token").select("token", "gid", "n", "c", (F.col("c") - F.col("pos")).alias("r")), "entries")


def _linked(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, by their whole sets."""
    side = lambda s: grouped.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(enough(F.size(F.array_intersect("t_a", "t_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(sid, root) of linked sets: the least id of the component, by alternating large and small stars."""
    edges = stage_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage_table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stage_table(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        before = state


def _rooted(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """(sid, gid, n, root, whole): members with their components; whole: the group's only component, or null."""
    rows = grouped.select("sid", "gid", "n").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    whole = rows.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(whole.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("whole")), "gid")


def _open(entries: DataFrame, rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries with their groups' components, and those that may link outside their component at that token."""
    rows = stage_table(entries.join(rooted.where("sid = gid").select("gid", "whole"), "gid"), "rooted")
    most = rows.groupBy("token", "whole").agg(F.count("*").alias("many"), F.max("r").alias("r"), F.min("n").alias("n"))
    most = most.groupBy("token").agg(F.max(F.struct("many", "whole")).alias("m"), F.max("r").alias("most_r"), F.min("n").alias("least_n"))
    outside = F.col("whole").isNull() | ~F.col("whole").eqNullSafe(F.col("m.whole"))
    found = rows.join(most, "token").where(outside & enough(F.least("r", "most_r"), F.col("n"), F.col("least_n")))
    return rows, stage_table(found.select(*rows.columns), "open")


def _led(entries: DataFrame) -> DataFrame:
    """Pairs (gid, lead) of a token's groups with its leader, if their shared tokens suffice."""
    lead = entries.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("c")).alias("alone"), F.col("gid").alias("lead"), F.col("n").alias("n_l"), F.col("c").alias("c_l"))).alias("l"))
    met = entries.join(lead.select("token", "l.*"), "token").where((F.col("gid") != F.col("lead")) & enough(F.least("c", "c_l"), F.col("n"), F.col("n_l")))
    return met.select("gid", "lead").distinct()


def _led_inside(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) inside groups of several components: those outside the first member's component with the first of them."""
    mixed = rooted.where("whole is null")
    own = mixed.where("sid = gid").select("gid", F.col("root").alias("first"))
    other = mixed.join(own, "gid").where("root <> first").select("gid", "sid")
    return other.join(other.groupBy("gid").agg(F.min("sid").alias("b")), "gid").where("sid <> b").select(F.col("sid").alias("a"), "b")


def _rest(rows: DataFrame, open_rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components: of open groups with all that the bound allows, and inside mixed groups."""
    x = open_rows.select("token", *[F.col(c).alias(f"{c}_x") for c in ("gid", "n", "r", "whole")])
    fit = (F.col("gid") != F.col("gid_x")) & ~F.coalesce(F.col("whole") == F.col("whole_x"), F.lit(False)) & enough(F.least("r", "r_x"), F.col("n"), F.col("n_x"))
    met = x.join(rows, "token").where(fit).select(F.least("gid", "gid_x").alias("g"), F.greatest("gid", "gid_x").alias("h"))
    mixed = rooted.where("whole is null and sid = gid").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    met = met.distinct().unionByName(mixed)
    side = lambda g, s: rooted.select(F.col("gid").alias(g), F.col("sid").alias(s), F.col("root").alias(f"root_{s}"))
    return met.join(side("g", "a"), "g").join(side("h", "b"), "h").where("root_a <> root_b").select("a", "b").distinct()


def link_sets(docs: DataFrame, rounds: int = ROUNDS, held_tokens: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The sets of ``docs`` (doc_id, k2, n, d1, d2 for each row), and (d1, d2, r1, r2): the set that stands for a linked one's component."""
    rows = _sieved(keyed(docs), held_tokens)
    wanted = rows.where("open").groupBy("d1", "d2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), "k2")).alias("k"))
    wanted = stage_table(wanted.select(F.monotonically_increasing_id().alias("sid"), "d1", "d2", "k.*"), "wanted")
    grouped = _candidates(_sets(docs, wanted.select("sid", "k1", "k2")))
    entries = _entries(grouped)
    members = grouped.select("gid", F.col("sid").alias("a"))
    led = _led(entries).select("gid", F.col("lead").alias("b")).unionByName(grouped.where("sid = gid").select("gid", F.col("gid").alias("b")))
    links = stage_table(_linked(members.join(led, "gid").where("a <> b").select("a", "b"), grouped), "links")
    for turn in range(rounds + 1):
        rooted = stage_table(_rooted(grouped, components(links)), "members")
        all_rows, open_rows = _open(entries, rooted)
        if turn == rounds or open_rows.isEmpty():
            break
        more = members.join(_led(open_rows), "gid").select("a", F.col("lead").alias("b")).unionByName(_led_inside(rooted))
        links = stage_table(links.unionByName(_linked(more, grouped)), "links")
    rest = stage_table(_linked(_rest(all_rows, open_rows, rooted), grouped), "rest")
    roots = rooted.select("sid", "root")
    if not rest.isEmpty():
        roots = components(roots.select(F.col("sid").alias("a"), F.col("root").alias("b")).unionByName(rest))
    names = roots.where("sid <> root").join(wanted.select("sid", "d1", "d2"), "sid")
    return rows, names.join(wanted.select(F.col("sid").alias("root"), F.col("d1").alias("r1"), F.col("d2").alias("r2")), "root").select("d1", "d2", "r1", "r2")


@releasing
def near_duplicates(docs: DataFrame, rounds: int = ROUNDS, held_tokens: int = HELD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, k2 (a hash of the text).

    ``component_id`` is the least doc_id that links reach; ``kept`` marks one row of each component
    (the one with that id; of rows that repeat the id, one text's).

    ``rounds`` and ``held_tokens`` (of a task at once) change the work, never the result.

    * A null text is the empty text. Without words the set is empty, links with nothing, and the
      row is its own component; under five words the whole sequence is the only shingle.
    * A null doc_id gets the least other id that it reaches, or null; it is kept only if nothing else is.
    * Rows that repeat doc_id and text are kept or dropped together.
    * Other columns of ``docs`` are ignored. No rows in, no rows out.
    """
    rows, linked = link_sets(docs, rounds, held_tokens)
    rows = rows.join(stage_table(linked, "linked"), ["d1", "d2"], "left").withColumns({"r1": F.coalesce("r1", "d1"), "r2": F.coalesce("r2", "d2")})
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "k2")
    least = rows.where("n > 0").groupBy("r1", "r2").agg(F.min("doc_id").alias("least"), F.min(order).alias("first"))
    rows = rows.join(least, ["r1", "r2"], "left")
    alone = F.col("n") == 0
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (alone | ((F.col("first.o") == F.coalesce("doc_id", F.lit(2**63 - 1))) & (F.col("first.k2") == F.col("k2")))).alias("kept"),
        "k2",
    )


@releasing
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    names = docs.columns
    kept = stage_table(near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("k_id"), F.col("k2").alias("k_hash")).distinct(), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64(whole_text()).alias("k2"))
    return own.join(kept, F.col("k1").eqNullSafe(F.col("k_id")) & (F.col("k2") == F.col("k_hash")), "left_semi").select("row.*")
