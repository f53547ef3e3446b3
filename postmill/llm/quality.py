"""Quality by hierarchical empirical Bayes over a document classifier.

An additive logistic model over binned features of the whole text gives each document's evidence.
Its sums by host and by path of the host, over all documents, give posteriors of their rates of
bad documents: hosts shrink toward the global rate and paths toward their host, each by a Beta
prior whose strength is fitted by moments, so that sparse sites tell little. A document's
evidence is then moved by how much its path's posterior differs from the global rate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, stage_table, whole_text
from .mixing import BROADCAST_PATTERNS, SALTS
from .toxicity import logistic

#: Bound of the labelled sample (expected rows); bins of a feature; how far a site moves its documents; from which probability a document is bad.
TRAIN_ROWS, BINS, SITE_WEIGHT, REJECT = 24_000, 10, 0.5, 0.5
FEATURES = ("symbols", "upper", "digits", "marks", "pipes", "spaces", "words", "word_length", "distinct", "repeats", "line_words", "line_copies", "short_lines", "most_common", "worst_line")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@^~\\{}[]_")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:")] = True


def features_of(text: str) -> list[float]:
    """Of a whole text: shares of kinds of characters, repetition of words and lines, the worst line."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = len(raw)
    letters = counts[65:91].sum() + counts[97:123].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    count = Counter(words)
    distinct = len(count)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = (_SYMBOL | _MARK)[raw]
    marked[raw == 124] = True
    upper = (raw >= 65) & (raw <= 90)
    bad = np.add.reduceat(marked + 0.5 * upper, ends := np.r_[0, np.flatnonzero(raw == 10) + 1][: max(1, int(counts[10]) + 1)].clip(max=size - 1)) / np.maximum(1, np.diff(np.r_[ends, size]))
    return [
        counts[_SYMBOL].sum() / size,
        counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / size,
        counts[_MARK].sum() / size,
        counts[124] / n,
        (counts[32] + counts[9] + counts[10]) / size,
        math.log(n),
        sum(map(len, words)) / n,
        distinct / n * math.log(n + 2),
        repeats / n,
        math.log(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        max(count.values()) / n * math.log(n + 2),
        float(bad.max()),
    ]


class Model:
    """Bins of the features and their weights."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray):
        self.edges, self.weights = edges, weights

    @staticmethod
    def design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """A constant, and for each feature and edge whether the feature is above it."""
        return np.concatenate([np.ones((len(x), 1)), (x[:, :, None] > edges[None]).reshape(len(x), -1)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x, self.edges) @ self.weights, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Model:
        if not len(x) or y.min() == y.max():
            edges = np.full((len(FEATURES), BINS), np.inf)
            return Model(edges, np.r_[30.0 if len(y) and y.min() == 1 else -30.0, np.zeros(edges.size)])
        spread = np.quantile(x, np.linspace(0, 1, BINS // 2 + 2)[1:-1], axis=0).T
        worst = np.quantile(x[y == 1], np.linspace(0, 1, BINS - BINS // 2 + 2)[1:-1], axis=0).T
        edges = np.sort(np.concatenate([spread, worst], axis=1), axis=1)
        return Model(edges, logistic(Model.design(x, edges), y.astype(float), ridge=1.0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most about TRAIN_ROWS labelled documents, by hash of the id; label 0 is bad."""
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg((F.min("quality") == 0).cast("int").alias("y"))
    n = given.count()
    if n > TRAIN_ROWS:
        given = given.where(F.pmod(F.xxhash64(F.lit(7), "l_id"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(given), F.col("doc_id") == F.col("l_id"))  # bounded by TRAIN_ROWS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("text", "y").mapInArrow(measure, "y int, x array<double>").collect()
    rows = sorted((r["y"], tuple(r["x"])) for r in rows)
    return Model.fit(np.array([x for _, x in rows]).reshape(-1, len(FEATURES)), np.array([y for y, _ in rows]))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and p_doc, the classifier's probability that the document is bad.

    Only the text goes to the Python workers, the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights))  # a few hundred numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        pa.set_memory_pool(pa.system_memory_pool())  # the default one keeps what it has had
        x = np.array([features_of(t.as_py() or "") for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(Model(*shared.value).probability(x), pa.float64())

    return docs.withColumn("p_doc", score("text"))


def _beta(groups: DataFrame, keys: list[str], prior: Column, strength: Column) -> DataFrame:
    return groups.withColumn("rate", (F.col("bad") + strength * prior) / (F.col("n") + strength)).select(*keys, "rate")


def _strength(mean: Column, n: Column, bad: Column) -> Column:
    """Strength of the Beta prior by moments: the more that groups differ beyond chance, the weaker."""
    seen = F.sum(n * F.pow(bad / n - mean, F.lit(2))) / F.sum(n)
    chance = F.sum(mean * (1 - mean)) / F.sum(n)
    between = F.greatest(seen - chance, F.lit(1e-6))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e5), F.avg(mean * (1 - mean)) / between - 1))


def path_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) from (host, path, p_doc) of all documents, and the global rate."""
    paths = stage_table(scored.groupBy("host", "path").agg(F.sum("p_doc").alias("bad"), F.count("*").cast("double").alias("n")), "sites")
    whole = paths.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    rate = min(1 - 1e-4, max(1e-4, (whole["bad"] or 0.0) / (whole["n"] or 1.0)))
    hosts = paths.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    s1 = hosts.agg(_strength(F.lit(rate), F.col("n"), F.col("bad"))).first()[0] or 1.0
    host_rates = _beta(hosts, ["host"], F.lit(rate), F.lit(s1)).withColumnRenamed("rate", "host_rate").withColumnRenamed("host", "h_host")
    joined = paths.join(host_rates, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    s2 = joined.agg(_strength(F.col("host_rate"), F.col("n"), F.col("bad"))).first()[0] or 1.0
    return joined.withColumn("path_rate", (F.col("bad") + s2 * F.col("host_rate")) / (F.col("n") + s2)).select("host", "path", "host_rate", "path_rate"), rate


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with as many underscores behind it as it takes to differ from the columns that there are."""
    while wanted.lower() in {t.lower() for t in taken}:
        wanted += "_"
    return wanted


@releasing
def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``docs`` with p_doc, host_rate, path_rate, score (probability that it is good) and kept, in a struct as the last column.

    The struct's name is ``quality``, with underscores behind it if ``docs`` has such a column.
    ``host`` and ``path`` name a document's site (source and lang); nulls are a site of their own.
    ``labels`` (doc_id, quality) teach; 0 is bad, of several labels of an id the smallest counts.
    The texts are read once for their evidence; rows with it are staged in the shared folder.

    * A null or empty text has no words; it is judged by the features of an empty text.
    * Without labels of both kinds nothing is rejected (everything, if all labels are 0).
    * Rows are neither joined nor dropped by id: repeated rows and null ids stay, each judged alike.
    * All columns of ``docs`` are kept, whatever their names. No rows in, no rows out.
    """
    return _judged(docs, docs.columns, labels, host, path)


@releasing
def judge_without_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As :func:`judge`, without the text: so the staged rows are small."""
    return _judged(docs, [c for c in docs.columns if c.lower() != "text"], labels, None, None)


def _judged(docs: DataFrame, names: list[str], labels: DataFrame, host: Column | None, path: Column | None) -> DataFrame:
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    own = stage_table(evidence(packed, model).drop("text"), "evidence")
    rates, rate = path_posteriors(own.select("host", "path", "p_doc"))
    rates = stage_table(rates.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "host_rate", "path_rate"), "posteriors")
    on = F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))
    if rates.count() <= BROADCAST_PATTERNS:
        own = own.join(F.broadcast(rates), on, "left")
    else:
        salted = rates.withColumn("s_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "p_doc"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt") == F.col("s_salt")), "left")
    logit = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    z = logit(clip(F.col("p_doc"))) + SITE_WEIGHT * (logit(clip(F.col("path_rate"))) - math.log(rate / (1 - rate)))
    own = own.withColumn("bad", 1 / (1 + F.exp(-z)))
    told = F.struct("p_doc", "host_rate", "path_rate", (1 - F.col("bad")).alias("score"), (F.col("bad") < REJECT).alias("kept"))
    return own.select("row.*", told.alias(free_name("quality", names)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns, whatever their names."""
    judged = judge(docs, labels)
    kept = F.col(f"`{judged.columns[-1]}`.kept")
    return judged.where(kept).select(*[F.col(f"`{c}`") for c in judged.columns[:-1]])
