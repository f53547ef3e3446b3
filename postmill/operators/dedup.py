"""Duplicates of postings: globally by fingerprint, or in order within a batch and against state."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

log = logging.getLogger(__name__)

#: Rounds that decide rows by their keys' first rows, before what is left goes through in order.
KEY_ROUNDS = 4
#: A round by keys that decides less than this share of its rows is the last: rows that share their keys in turn have as many rounds as links.
LEAST_DECIDED = 0.1
#: Rows that one task goes through in order, about.
FOLD_ROWS = 100_000
_UNDECIDED = "_o bigint, raw_id string, _fp string, _url string"


def first_by_fingerprint(df: DataFrame, key: str = "job_fingerprint", order: str = "collected_at", row_id: str = "raw_id") -> DataFrame:
    """Add is_duplicate and duplicate_of_raw_id: the earliest row of a fingerprint is the original.

    The winner is a grouped minimum that is combined before the shuffle, joined back by key: a
    fingerprint that very many rows share meets no single sort, unlike in a window. Ties go to the
    smaller id. Null order values come first, as they sort.
    """
    joined = df.join(_winners(df, key, order, row_id), F.col(key).eqNullSafe(F.col("_key")))
    duplicate = ~F.col(row_id).eqNullSafe(F.col("_winner"))
    return joined.withColumns({"is_duplicate": duplicate, "duplicate_of_raw_id": F.when(duplicate, F.col("_winner"))}).drop("_key", "_winner")


def _winners(df: DataFrame, key: str, order: str, row_id: str) -> DataFrame:
    order_key = F.struct(F.col(order).alias("at"), F.col(row_id).alias("id"))
    return df.groupBy(F.col(key).alias("_key")).agg(F.min(order_key)["id"].alias("_winner"))


def originals(df: DataFrame, among: DataFrame | None = None, key: str = "job_fingerprint", order: str = "collected_at", row_id: str = "raw_id") -> DataFrame:
    """The rows of ``among`` (a part of ``df``; all of it if it is None) that :func:`first_by_fingerprint` of ``df`` finds no duplicates, with its columns.

    Rows meet their winner by fingerprint and id: one that very many rows share is spread over all tasks.
    """
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(row_id).eqNullSafe(F.col("_winner"))
    kept = (df if among is None else among).join(_winners(df, key, order, row_id), same, "left_semi")
    return kept.withColumns({"is_duplicate": F.lit(False), "duplicate_of_raw_id": F.lit(None).cast(df.schema[row_id].dataType)})


def with_native_id_seen(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Add native_seen: whether (source_name, source_job_id) occurs in the history."""
    known = history.where("source_job_id <> ''").select(F.col("source_name").alias("_s"), F.col("source_job_id").alias("_j")).distinct().withColumn("_seen", F.lit(True))
    out = batch.join(known, (F.col("source_name") == F.col("_s")) & (F.col("source_job_id") == F.col("_j")), "left")
    return out.withColumn("native_seen", F.coalesce("_seen", F.lit(False))).drop("_s", "_j", "_seen")


def with_prior_fingerprint(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Add prior_raw_id: who recorded the fingerprint first, unless it is a row of this batch."""
    known = state.groupBy(F.col("fingerprint").alias("_f")).agg(F.min("first_raw_id").alias("_first"))
    own = batch.select(F.col("raw_id").alias("_own")).distinct()
    out = batch.join(known, F.col("job_fingerprint") == F.col("_f"), "left").join(own, F.col("_first") == F.col("_own"), "left")
    return out.withColumn("prior_raw_id", F.when(F.col("_own").isNull(), F.col("_first"))).drop("_f", "_first", "_own")


def with_url_of_other_run(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Add url_raw_id: the smallest raw_id of another run with the same url.

    Of each url the smallest id and the smallest id of any other run are enough, so the group's
    state is of fixed size, however many runs there are.
    """
    by_run = history.where("source_url is not null").groupBy(F.col("source_url").alias("_u"), F.col("run_id").alias("_r")).agg(F.min("raw_id").alias("_id"))
    least = by_run.groupBy("_u").agg(F.min(F.struct("_id", "_r")).alias("_a"))
    both = by_run.join(least, "_u").groupBy("_u", "_a").agg(F.min(F.when(F.col("_r") != F.col("_a._r"), F.col("_id"))).alias("_next"))
    out = batch.join(both, F.col("source_url") == F.col("_u"), "left")
    other = F.when(F.col("_a._r").eqNullSafe(F.col("run_id")), F.col("_next")).otherwise(F.col("_a._id"))
    return out.withColumn("url_raw_id", other).drop("_u", "_a", "_next")


def _without(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows that share no key with the chosen ones."""
    behind = rows.join(chosen.select("_url"), "_url", "left_anti")
    return behind.join(chosen.where("_fp is not null").select("_fp"), "_fp", "left_anti").select(*rows.columns)


def _key_round(undecided: DataFrame) -> DataFrame:
    """The rows that come first for both their keys."""
    first_fp = undecided.where("_fp is not null").groupBy("_fp").agg(F.min("_o").alias("_fp_first"))
    first_url = undecided.groupBy("_url").agg(F.min("_o").alias("_url_first"))
    seen = undecided.join(first_fp, "_fp", "left").join(first_url, "_url")
    stays = (F.col("_o") == F.col("_url_first")) & F.coalesce(F.col("_o") == F.col("_fp_first"), F.lit(True))
    return seen.where(stays).select("_o", "raw_id", "_fp", "_url")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the least node that is reached from it.

    Stars are contracted in rounds: each node's larger neighbours, then its smaller ones, are linked to
    the least node it knows. That is grouped minima and joins, and halves paths as pointer doubling does,
    so that a chain takes as many rounds as its length has binary digits, about.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        log.debug("round of components")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch of edges (a, b) its nodes with the least node that the batch's edges link them to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": list(parent), "near": [root(x) for x in parent]})


def _near_components(edges: DataFrame, order: str) -> DataFrame:
    """:func:`components` where edges that belong together are mostly near each other in ``order``.

    Edges are dealt in that order and contracted batch by batch; only nodes of more than one batch link what is
    left of these, and only that goes through the rounds.
    """
    dealt = edges.repartitionByRange(order).sortWithinPartitions(order).select("a", "b")
    near = stage(dealt.mapInPandas(_contracted, "node bigint, near bigint"), "near")
    least = near.groupBy("node").agg(F.min("near").alias("least"), F.max("near").alias("_most")).where("least <> _most").drop("_most")
    links = near.join(least, "node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    roots = components(links).select(F.col("node").alias("near"), F.col("component").alias("far"))
    found = near.join(roots, "near", "left").select("node", F.coalesce("far", "near").alias("component"))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a group that share no key with an earlier one that stays."""
    urls, prints, stays = set(), set(), []
    rows = rows.sort_values("_o")
    for url, fp in zip(rows["_url"], rows["_fp"], strict=True):
        stays.append(url not in urls and (fp is None or fp not in prints))
        if stays[-1]:
            urls.add(url)
            if fp is not None:
                prints.add(fp)
    return rows.loc[stays, ["_o", "raw_id", "_fp", "_url"]]


def _grouped(undecided: DataFrame) -> DataFrame:
    """Rows with the group (``_g``) in which they can be visited in order, apart from all others.

    Up to FOLD_ROWS rows are one group. More are grouped by the components of their shared keys.
    """
    if undecided.count() <= FOLD_ROWS:
        return undecided.withColumn("_g", F.lit(0).cast("bigint"))
    # nodes are keys' hashes: where two keys have one hash, two components are visited as one, which changes nothing
    node = F.xxhash64(F.concat(F.lit("u"), "_url"))
    edges = undecided.where("_fp is not null").select("_o", node.alias("a"), F.xxhash64(F.concat(F.lit("f"), "_fp")).alias("b"))
    found = _near_components(edges, "_o").select(F.col("node").alias("_node"), F.col("component").alias("_g"))
    return stage(undecided.withColumn("_node", node).join(found, "_node", "left").withColumn("_g", F.coalesce("_g", "_node")).drop("_node"), "dedup-groups")


def _first_rows(grouped: DataFrame) -> DataFrame:
    """The first rows of each group, all of a group of up to 2 * FOLD_ROWS: borders are approximate quantiles, nothing is sorted."""
    parts = 64
    while True:
        sizes = grouped.groupBy("_g").agg(F.count("*").alias("_n"), F.percentile_approx("_o", [i / parts for i in range(1, parts + 1)]).alias("_marks"))
        part = F.greatest(F.lit(1), F.least(F.lit(parts), F.floor(F.lit(parts * FOLD_ROWS) / F.col("_n")).cast("int")))
        large = sizes.where(F.col("_n") > 2 * FOLD_ROWS).select(F.col("_g"), F.element_at("_marks", part).alias("_cut"))
        large = stage(large, "dedup-cuts")
        if large.isEmpty():
            return grouped
        before = grouped.count()
        grouped = stage(grouped.join(large, "_g", "left").where("_cut is null or _o <= _cut").drop("_cut"), "dedup-first")
        if grouped.count() == before:  # as short as rows with equal order values allow
            return grouped


def _first_comers(undecided: DataFrame) -> DataFrame:
    """Of rows (_o, raw_id, _fp, _url) in order of ``_o``: those that share neither url nor fingerprint with an earlier one that stays.

    Most rows are decided in parallel, in rounds: a row that comes first for both its keys stays, and rows
    that share a key with it go. Where rows share url and fingerprint in turn, such rounds would be as many
    as the chain has links; after KEY_ROUNDS of them what is left is visited in order, components of shared
    keys beside each other, no more than some FOLD_ROWS rows of one at a time.
    """
    undecided = stage(undecided, "dedup-undecided")
    out, left = undecided.limit(0), undecided.count()
    for _ in range(KEY_ROUNDS):
        if not left:
            return out
        log.debug("round by keys")
        kept = stage(_key_round(undecided), "dedup-kept")
        out, undecided = out.unionByName(kept), stage(_without(undecided, kept), "dedup-undecided")
        before, left = left, undecided.count()
        if before > FOLD_ROWS and left > (1 - LEAST_DECIDED) * before:
            break
    groups = _grouped(undecided)
    while not groups.isEmpty():
        log.debug("round in order")
        first = _first_rows(groups)
        kept = stage(first.groupBy("_g").applyInPandas(_fold, _UNDECIDED), "dedup-kept")
        out, groups = out.unionByName(kept), stage(_without(groups.join(first.select("_o"), "_o", "left_anti"), kept), "dedup-groups")
    return out


def save_lookups(history: DataFrame, state: DataFrame, database: str, buckets: int) -> None:
    """Write what batches are looked up in as tables bucketed by the keys that they are joined by.

    seen_ids (source_name, source_job_id), seen_urls (source_url, run_id, raw_id: the least of each) and
    seen_fingerprints (fingerprint, first_raw_id), one row for each key. The lookups :func:`with_native_id_seen`,
    :func:`with_url_of_other_run` and :func:`with_prior_fingerprint` read such tables bucket by bucket: only
    the batch is shuffled, however large history is.
    """
    ids = history.where("source_job_id <> ''").select("source_name", "source_job_id").distinct()
    urls = history.where("source_url is not null").groupBy("source_url", "run_id").agg(F.min("raw_id").alias("raw_id"))
    prints = state.groupBy("fingerprint").agg(F.min("first_raw_id").alias("first_raw_id"))
    for name, df, keys in (("seen_ids", ids, ["source_name", "source_job_id"]), ("seen_urls", urls, ["source_url"]), ("seen_fingerprints", prints, ["fingerprint"])):
        dealt = df.repartition(buckets, *keys)  # one file a bucket
        dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"{database}.{name}")


def sequential(batch: DataFrame, history: DataFrame, state: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Visit rows by ``ordinal``; only rows that aren't duplicates register their url and fingerprint.

    Adds is_duplicate and duplicate_of_job_id (a raw_id). Null urls match each other; a fingerprint
    counts only for rows without a native id. The order is that of :func:`_first_comers`.
    """
    rows = with_url_of_other_run(with_prior_fingerprint(with_native_id_seen(batch, history), state), history)
    has_id = F.coalesce(F.col("source_job_id") != "", F.lit(False))
    rows = rows.withColumns({
        "_fp": F.when(~has_id & (F.col("job_fingerprint") != ""), F.col("job_fingerprint")),
        "_url": F.coalesce(F.concat(F.lit("u"), F.col("source_url")), F.lit("none")),
        "_native": has_id & F.col("native_seen"),
        "_prior": F.when(~has_id, F.col("prior_raw_id")),
    })
    rows = stage(rows, "dedup-rows")
    blocked = F.col("_native") | F.col("_prior").isNotNull() | F.col("url_raw_id").isNotNull()
    undecided = rows.where(~blocked).select(F.col(ordinal).cast("bigint").alias("_o"), "raw_id", "_fp", "_url")
    registered = _first_comers(undecided)
    by_fp = registered.where("_fp is not null").select("_fp", F.col("raw_id").alias("_fp_id"), F.col("_o").alias("_fp_o"))
    by_url = registered.select("_url", F.col("raw_id").alias("_url_id"), F.col("_o").alias("_url_o"))
    told = rows.join(by_fp, "_fp", "left").join(by_url, "_url", "left")
    by = F.col(ordinal)
    reason = (
        F.when(F.col("_native"), F.struct(F.lit(True).alias("dup"), F.lit(None).cast("string").alias("of")))
        .when(F.col("_fp_o") < by, F.struct(F.lit(True).alias("dup"), F.col("_fp_id").alias("of")))
        .when(F.col("_prior").isNotNull(), F.struct(F.lit(True).alias("dup"), F.col("_prior").alias("of")))
        .when(F.col("_url_o") < by, F.struct(F.lit(True).alias("dup"), F.col("_url_id").alias("of")))
        .when(F.col("url_raw_id").isNotNull(), F.struct(F.lit(True).alias("dup"), F.col("url_raw_id").alias("of")))
        .otherwise(F.struct(F.lit(False).alias("dup"), F.lit(None).cast("string").alias("of")))
    )
    told = told.withColumn("_reason", reason).withColumns({"is_duplicate": F.col("_reason.dup"), "duplicate_of_job_id": F.col("_reason.of")})
    return told.select(*batch.columns, "is_duplicate", "duplicate_of_job_id")


def new_state(rows: DataFrame, state: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """State rows to append: fingerprints of rows that aren't duplicates, the first writer of each, unless recorded already."""
    firsts = rows.where("not is_duplicate and job_fingerprint <> ''").groupBy(F.col("job_fingerprint").alias("fingerprint")).agg(F.min(F.struct(F.col(ordinal), F.col("raw_id"), F.col("source_name"), F.col("collected_at"))).alias("w"))
    firsts = firsts.select("fingerprint", F.col("w.raw_id").alias("first_raw_id"), "w.source_name", F.col("w.collected_at").alias("recorded_at"))
    return firsts.join(state.select("fingerprint"), "fingerprint", "left_anti")


def append_new(existing: DataFrame, new: DataFrame, key: str = "raw_id") -> DataFrame:
    """Rows of ``new`` whose key isn't there yet, the first of each by all columns: what an append that ignores conflicts writes."""
    once = new.groupBy(key).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    return once.join(existing.select(key), key, "left_anti").select(*new.columns)
