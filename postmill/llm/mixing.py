"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes
token capacity from patterns to source quotas: the j-th copy of a pattern's tokens is an edge of
cost j, so repetition costs are convex and nothing is repeated before all is used once. Only
patterns, sources and their sums are on the driver.

A pattern then takes all its documents some number of times, and once more those first in seeded
order up to a cut. The cut is found by radix descent over the seeded hash (4096 buckets, then
4096 of one bucket, then rows), so that no task sorts a pattern that holds a third of all rows.
What is left below the first document that doesn't fit is filled by going on through the order:
every later document that fits is taken. The descent is repeated over the later documents no
longer than what is left, so that each round skips a document or ends; a pattern with few of them
is gone through in one task.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table, whole_text

#: Weights of the sources in order, repeating; share of all words that the mix takes; most copies of a document.
WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.5, 2, 20_240_601
#: Plans of up to so many patterns (some 100 bytes each) are broadcast; above, they are joined by shuffle.
BROADCAST_PATTERNS = 10_000
#: More membership patterns than this (a row of some 300 bytes each on the driver) are refused before any is collected; none is left out.
MOST_PATTERNS = 1_000_000
#: Salts of the join above that bound.
SALTS = 32
#: A pattern with up to so many documents that may still fit is gone through in one task; with more, the descent is repeated.
FILL_ROWS = 20_000
#: Before and after every row in (h, rid).
FIRST, LAST = (-1, -1), (2**63 - 1, 2**63 - 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets_for(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = MOST_COPIES) -> dict:
    """Words for each source: ``share`` of all, by weight, at most ``cap`` times the source's own.

    Sources go by code point, null last. What exceeds a cap is shared among the others by weight,
    again until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s: None for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def min_cost_flow(capacity: dict, quota: dict, copies: int) -> dict:
    """Flow {(pattern, source): words}; patterns are tuples of sources, ``capacity`` their words.

    Words go from the start over patterns and sources to the end. Only the edges out of the start
    cost anything, a pattern's copy j costs j a word, and a shortest path never comes back to the
    start: so successive shortest paths use up copy 0 of all patterns, then copy 1, and so on.
    Each copy is a largest flow by blocking flows over levels. Maximal flow, at least cost.
    """
    order = list(capacity)
    sources = [[s for s in p if quota.get(s, 0) > 0] for p in order]
    supply, need = [0] * len(order), dict(quota)
    sent: dict = {s: {} for s in quota}  # {source: {place of the pattern: words}}
    for _ in range(copies):
        for i, p in enumerate(order):
            supply[i] += capacity[p]
        while _blocking_flow(supply, need, sources, sent):
            pass
    return {(order[i], s): words for s, by in sent.items() for i, words in by.items() if words > 0}


def _levels(supply: list, need: dict, sources: list, sent: dict) -> tuple[dict, dict, bool]:
    """Levels of patterns and sources, breadth first from the patterns with words left, and whether a source with room is met."""
    frontier = [i for i, words in enumerate(supply) if words > 0]
    of_pattern, of_source, depth = dict.fromkeys(frontier, 0), {}, 0
    while frontier:
        met = []
        for i in frontier:
            for s in sources[i]:
                if s not in of_source:
                    of_source[s] = depth
                    met.append(s)
        if any(need[s] > 0 for s in met):
            return of_pattern, of_source, True
        depth += 1
        frontier = []
        for s in met:
            for i, words in sent[s].items():
                if words > 0 and i not in of_pattern:
                    of_pattern[i] = depth
                    frontier.append(i)
    return of_pattern, of_source, False


def _blocking_flow(supply: list, need: dict, sources: list, sent: dict) -> bool:
    """Send words along shortest paths until each is blocked; whether there was one.

    A path alternates between patterns and sources; from a source it goes back to a pattern that
    has sent words there, which then sends them elsewhere. An edge found useless is not tried again.
    """
    of_pattern, of_source, reached = _levels(supply, need, sources, sent)
    if not reached:
        return False
    givers = {s: [i for i, words in sent[s].items() if words > 0 and of_pattern.get(i) == level + 1] for s, level in of_source.items()}
    next_source, next_giver = dict.fromkeys(of_pattern, 0), dict.fromkeys(of_source, 0)
    for root in [i for i, level in of_pattern.items() if level == 0]:
        path = [root]  # pattern, source, pattern, ...
        while path and supply[root] > 0:
            at = path[-1]
            if len(path) % 2:
                k, ways, level = next_source[at], sources[at], of_pattern[at]
                while k < len(ways) and of_source.get(ways[k]) != level:
                    k += 1
                next_source[at] = k
                onward = k < len(ways)
                if onward:
                    path.append(ways[k])
            elif need[at] > 0:
                step = min(supply[root], need[at], *[sent[s][i] for s, i in zip(path[1:-1:2], path[2::2], strict=True)])
                supply[root] -= step
                need[at] -= step
                for i, s in zip(path[::2], path[1::2], strict=True):
                    sent[s][i] = sent[s].get(i, 0) + step
                for s, i in zip(path[1:-1:2], path[2::2], strict=True):
                    sent[s][i] -= step
                path = [root]
                continue
            else:
                k, ways = next_giver[at], givers[at]
                while k < len(ways) and sent[at][ways[k]] <= 0:
                    k += 1
                next_giver[at] = k
                onward = k < len(ways)
                if onward:
                    path.append(ways[k])
            if not onward:  # a dead end: the edge into it is done with
                path.pop()
                if path:
                    if len(path) % 2:
                        next_source[path[-1]] += 1
                    else:
                        next_giver[path[-1]] += 1
    return True


def seeded_hash(seed: int) -> Column:
    """The order of documents: 63 bits of a hash of doc_id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(whole_text())), 1)


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of the candidates in seeded order each that still fits."""
    left, chosen = int(group["left"].iloc[0]), []
    for rid, words in group.sort_values(["h", "rid"])[["rid", "size"]].itertuples(index=False):
        if words <= left:
            left -= words
            chosen.append(rid)
    return pd.DataFrame({"rid": pd.Series(chosen, dtype="int64")})


def _with_plan(rows: DataFrame, plan: DataFrame, patterns: int, how: str = "inner") -> DataFrame:
    """Join the plan of each pattern to its rows; a pattern may hold a third of them."""
    if patterns <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(plan), "pattern", how)
    salted = plan.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"], how).drop("salt")


def _cut(rows: DataFrame, plan: DataFrame, patterns: int) -> DataFrame:
    """(pattern, cut_h, cut_rid, used): the last row that fits into ``extra``, in seeded order."""

    def descend(part: DataFrame, bucket: Column, base: str) -> DataFrame:
        sums = part.groupBy("pattern", base, "extra", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        ordered = Window.partitionBy("pattern").orderBy("bucket")
        after = F.col(base) + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("after", after).withColumn("before", F.col("after") - F.col("size"))
        return found.where("before <= extra and after > extra").select("pattern", "bucket", "before")

    first = F.shiftright("h", 51)
    second = F.shiftright("h", 39).bitwiseAND(F.lit(4095))
    zero = F.lit(0).cast("bigint")
    wanted = _with_plan(rows, plan.select("pattern", "extra").where("extra > 0"), patterns)
    one = descend(wanted.withColumn("base", zero), first, "base").select("pattern", F.col("bucket").alias("b1"), F.col("before").alias("base"))
    inside = _with_plan(wanted, one, patterns).where(first == F.col("b1"))
    two = descend(inside, second, "base").select("pattern", F.col("bucket").alias("b2"), F.col("before").alias("base2"))
    last = _with_plan(inside.drop("base"), two, patterns).where(second == F.col("b2"))
    order = Window.partitionBy("pattern").orderBy("h", "rid")
    last = last.withColumn("after", F.col("base2") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return last.groupBy("pattern", "b1", "b2", "extra").agg(
        F.max(F.when(F.col("after") <= F.col("extra"), F.struct("h", "rid"))).alias("at"),
        F.coalesce(F.max(F.when(F.col("after") <= F.col("extra"), F.col("after"))), F.min("base2")).alias("used"),
    ).select(
        "pattern",
        F.coalesce("at.h", F.shiftleft(F.col("b1"), 51).bitwiseOR(F.shiftleft(F.col("b2").cast("bigint"), 39)) - 1).alias("cut_h"),
        F.coalesce("at.rid", F.lit(2**63 - 1)).alias("cut_rid"),
        (F.col("extra") - F.col("used")).alias("left"),
    )


def _take(rows: DataFrame, extra: dict) -> tuple[dict, DataFrame]:
    """Go through each pattern's rows in seeded order and take what fits into ``extra`` ({pattern: words}, below its sum).

    Returns the runs of each pattern (after, up to, longest: rows behind the first place, not behind
    the second, no longer than the third) and the rows (rid) taken beside them.
    """
    spark = rows.sparkSession
    runs: dict = defaultdict(list)
    few: dict = {}  # patterns for one task each
    at = {p: (FIRST, left) for p, left in extra.items() if left > 0}

    def later(patterns: dict) -> DataFrame:
        state = spark.createDataFrame([(list(p), *place, left) for p, (place, left) in patterns.items()], "pattern array<string>, after_h bigint, after_rid bigint, left bigint")
        behind = (F.col("h") > F.col("after_h")) | ((F.col("h") == F.col("after_h")) & (F.col("rid") > F.col("after_rid")))
        return _with_plan(rows, state, len(patterns)).where(behind & (F.col("size") > 0) & (F.col("size") <= F.col("left"))).select("pattern", "rid", "h", "size", "left")

    many = at
    found, longest = rows, {p: LAST[0] for p in at}
    while many:
        plan = spark.createDataFrame([(list(p), left) for p, (_, left) in many.items()], "pattern array<string>, extra bigint")
        cuts = {tuple(r["pattern"]): ((r["cut_h"], r["cut_rid"]), r["left"]) for r in _cut(found, plan, len(many)).collect()}
        for p, (place, _) in cuts.items():
            runs[p].append((many[p][0], place, longest[p]))
        at = {p: x for p, x in cuts.items() if x[1] > 0}
        many = {}
        if not at:
            break
        fit = later(at).groupBy("pattern").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).collect()
        for r in fit:  # patterns with nothing left that fits are missing
            p = tuple(r["pattern"])
            if r["words"] <= at[p][1]:
                runs[p].append((at[p][0], LAST, at[p][1]))
            elif r["rows"] <= FILL_ROWS:
                few[p] = at[p]
            else:
                many[p] = at[p]
        if many:
            found, longest = later(many).drop("left"), {p: left for p, (_, left) in many.items()}
    if not few:
        return runs, spark.createDataFrame([], "rid bigint")
    return runs, later(few).groupBy("pattern").applyInPandas(_fill, "rid bigint")


def mix(docs: DataFrame, members: Column, size: Column, targets=None, copies: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """Copies of each row of ``docs`` (doc_id, text, ...) that the mix takes.

    ``members``: array of the sources that a row belongs to (null elements are a source of their
    own; an empty or null array belongs to none and is not taken). ``size``: its words.
    ``targets``: {source: words}, or a function from {source: words there are} to that.
    Returns doc_id, rid (place in ``docs``), h (place in the seeded order), pattern, size and copies.

    * Rows of size 0 are never taken (0 copies beyond those that the whole pattern gets).
    * Ties: the order is that of a seeded hash of doc_id and text; rows that repeat both follow
      the order of the input. Reruns over the same input agree.
    * A null doc_id is a value like others. No rows in, no rows out.
    * More than ``MOST_PATTERNS`` patterns of membership raise a ValueError.
    """
    spark = docs.sparkSession
    mark = F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda x: F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), x)))
    rows = stage_table(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("rid"),
            F.array_sort(F.array_distinct(mark)).alias("pattern"),
            size.cast("bigint").alias("size"),
            seeded_hash(seed).alias("h"),
        ),
        "sizes",
    )
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns: their flow doesn't fit the driver")
    total = {tuple(r["pattern"]): r["words"] for r in sorted(totals, key=lambda r: r["pattern"])}
    name = lambda mark: None if mark == "n" else mark[1:]
    have: dict = defaultdict(int)
    for pattern, words in total.items():
        for s in pattern:
            have[name(s)] += words
    wanted = targets(dict(have)) if callable(targets) else dict(targets or {})
    quota = {s: max(0, round(t)) for s, t in wanted.items()}
    flow = min_cost_flow({tuple(map(name, p)): w for p, w in total.items()}, quota, copies)
    taken: dict = defaultdict(int)
    for (p, _), words in flow.items():
        taken[p] += words
    plan_rows = [(list(p), *(divmod(taken[tuple(map(name, p))], words) if words else (0, 0))) for p, words in total.items()]
    plan = spark.createDataFrame(plan_rows, "pattern array<string>, full bigint, extra bigint")
    patterns = len(plan_rows)
    runs, beside = _take(rows, {tuple(p): extra for p, _, extra in plan_rows})
    fill = beside.withColumn("filled", F.lit(True))
    taken_runs = [(list(p), [(*after, *upto, longest) for after, upto, longest in found]) for p, found in runs.items()]
    run_type = "struct<after_h: bigint, after_rid: bigint, upto_h: bigint, upto_rid: bigint, longest: bigint>"
    cuts = spark.createDataFrame(taken_runs, f"pattern array<string>, runs array<{run_type}>")
    planned = _with_plan(_with_plan(rows, plan.select("pattern", "full"), patterns, "left"), cuts, patterns, "left")
    place = F.struct("h", "rid")

    def in_run(run: Column) -> Column:
        behind = place > F.struct(run["after_h"].alias("h"), run["after_rid"].alias("rid"))
        counts = (F.col("size") > 0) | (run["after_h"] < 0)  # behind the first cut only rows with words are gone through
        return behind & (place <= F.struct(run["upto_h"].alias("h"), run["upto_rid"].alias("rid"))) & (F.col("size") <= run["longest"]) & counts

    planned = planned.join(fill, "rid", "left")
    once_more = F.coalesce(F.exists("runs", in_run), F.lit(False)) | F.coalesce(F.col("filled"), F.lit(False))
    return planned.select("doc_id", "rid", "h", "pattern", "size", (F.col("full") + once_more.cast("bigint")).alias("copies"))


def _plan_by_source(docs: DataFrame, seed: int) -> tuple[DataFrame, dict]:
    """The mix by the one source of each row, and {source: (words there are, target)}."""
    seen: dict = {}

    def targets(have):
        seen.update({s: (have[s], t) for s, t in targets_for(have).items()})
        return {s: t for s, (_, t) in seen.items()}

    return mix(docs, F.array(F.col("source").cast("string")), n_words(whole_text()), targets, MOST_COPIES, seed), seen


def mix_by_source(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Mix ``docs`` (doc_id, text, source) by their one source; the contract of op3.

    Returns doc_id, size, source_size, target and taken (words, repeats counted). A null text has
    size 0, a null source is a source, last in order.
    """
    mixed, seen = _plan_by_source(docs, seed)
    facts = mixed.sparkSession.createDataFrame(
        [(["n" if s is None else f"s{s}"], have, float(t)) for s, (have, t) in seen.items()], "pattern array<string>, source_size bigint, target double"
    )
    return _with_plan(mixed, facts, len(seen), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_by_source(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with all their columns, each row as often as :func:`mix_by_source` takes it.

    Rows that repeat doc_id, text and source are taken alike, as often as the first of them.
    """
    names = docs.columns
    mixed, _ = _plan_by_source(docs, seed)
    copies = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), F.col("pattern").alias("m_pattern")).agg(F.max("copies").alias("copies"))
    mark = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), seeded_hash(seed).alias("own_h"), F.array(mark).alias("own_pattern"))
    joined = own.join(copies, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("own_h") == F.col("m_h")) & (F.col("own_pattern") == F.col("m_pattern")))
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
