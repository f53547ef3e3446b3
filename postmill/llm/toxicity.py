"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean documents under an informative Dirichlet
prior (the pooled counts), less a multiple of its standard error; tokens are words and the stems
that they begin with. Tokens without a significant score pull down by a constant drift. A linear
scan finds all maximal scoring segments of a text (no segment can be extended, or lies in another,
with a higher score). Scores of segments become comparable between texts of different lengths by
extreme-value statistics: with lambda and K fitted on clean documents, S' = lambda S - ln(K m) is
Gumbel under the clean model. A logistic function of the best and the summed significance, fitted
on out-of-fold scores, gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, whole_text

#: Bound of the labelled sample that the model is fitted on (expected rows).
TRAIN_ROWS = 24_000
#: Strength of the prior; standard errors subtracted; least score and documents of a feature; drift of other tokens.
PRIOR, CAUTION, LEAST_SCORE, LEAST_DOCS, DRIFT = 50.0, 1.64, 0.5, 3, -0.3
#: Lengths of the stems, and from which score a document counts as toxic.
STEMS, THRESHOLD = (4, 5, 6, 7), 0.3
_WORD = re.compile(r"\w+")
WORDS_HELD = 1 << 18


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:n]}~" for n in STEMS if len(word) >= n]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature in how many documents it is: clean and toxic, of either fold."""
    seen = [Counter() for _ in range(4)]
    for batch in batches:
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen[2 * fold + toxic].update({f for w in set(words_of(text)) for f in features_of(w)})
    names = list(set().union(*seen))
    for at in range(0, len(names), 1 << 16):
        part = names[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[f] for f in part], pa.int64()) for c in seen]], ["feature", "c0", "t0", "c1", "t1"])


def token_scores(features: list[str], clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> dict[str, float]:
    """Features whose log-odds, less CAUTION standard errors, are at least LEAST_SCORE."""
    total = n_clean + n_toxic
    if not len(features) or not n_clean or not n_toxic:
        return {}
    prior = PRIOR * (clean + toxic) / total + 0.05
    odds = lambda y, n: (y + prior) / (n + PRIOR - y - prior + 0.1)
    delta = np.log(np.maximum(odds(toxic, n_toxic), 1e-9)) - np.log(np.maximum(odds(clean, n_clean), 1e-9))
    low = delta - CAUTION * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    take = np.flatnonzero((low >= LEAST_SCORE) & (toxic >= LEAST_DOCS))
    return {features[i]: float(low[i]) for i in take}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one linear pass."""
    up = np.diff(np.r_[0, (scores > 0).astype(np.int8), 0])
    starts, ends = np.flatnonzero(up == 1), np.flatnonzero(up == -1)  # runs of positive scores stay together
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple] = []  # start, end, sum before, sum after, nearest earlier one with a smaller sum before
    for start, end, left, right in zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist(), strict=True):
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
            j = len(out) - 1
        out.append((start, end, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in out]


class Scorer:
    """Scores of words, segments and their significance under one model."""

    def __init__(self, scores: dict[str, float], lam: float = 1.0, k: float = 0.1, weights=(0.0, 0.0, 0.0)):
        self.scores, self.lam, self.k, self.weights, self.memo = scores, lam, k, weights, {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > WORDS_HELD:
            self.memo.clear()
        get, memo = self.scores.get, self.memo
        for w in {w for w in words if w not in memo}:
            best = max(get(f, 0.0) for f in features_of(w))
            memo[w] = best if best > 0 else DRIFT
        return np.fromiter(map(memo.__getitem__, words), float, len(words))

    def passages(self, text: str, least: float = 0.0) -> list[tuple[int, int, float]]:
        """(first code point, end, significance) of every passage whose significance is above ``least``."""
        spans = [m.span() for m in _WORD.finditer(text)]
        scores = self.word_scores([text[a:b].lower() for a, b in spans])
        return [(spans[a][0], spans[b - 1][1], x) for a, b, s in segments(scores) if (x := self.significance(s, len(spans))) > least]

    def significance(self, score: float, m: int) -> float:
        return self.lam * score - math.log(self.k * max(1, m))

    def evidence(self, text: str) -> tuple[float, float, int]:
        """Score of the best segment, sum of all segments' scores, and the text's words."""
        words = words_of(text)
        found = [s for *_, s in segments(self.word_scores(words))] if words else []
        return (max(found, default=0.0), sum(found), len(words))

    def inputs(self, best: float, total: float, m: int) -> tuple[float, float]:
        tail = lambda s: min(40.0, max(-5.0, self.significance(s, m))) if s > 0 else -5.0
        return tail(best), tail(total)

    def score(self, text: str) -> float:
        a, b = self.inputs(*self.evidence(text))
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def extreme_values(scores: np.ndarray, shares: np.ndarray, best: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    """lambda, the positive root of sum p exp(lambda s) = 1 over clean tokens, and K from the clean best scores."""
    low, high = 1e-4, 20.0
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 50))).sum()) - 1
    if not len(scores) or scores.max(initial=0) <= 0 or f(low) >= 0:
        return 1.0, 0.1
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    lam, seen = low, best > 0
    k = math.exp(float(np.mean(lam * best[seen] - np.log(np.maximum(1, m[seen])))) - 0.5772) if seen.any() else 0.1
    return lam, max(k, 1e-6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant, not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, mod 4, is 2; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """(text, y, fold) of about ``rows`` labelled documents at most, by hash of the id; copies of a text once.

    Of an id with several labels the largest counts, and so it does of copies of a text. The sampled labels are bounded by ``rows``, so they are broadcast.
    """
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(usable).groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    n = given.count()
    share = F.pmod(F.xxhash64(F.lit(5), "l_id"), F.lit(1_000_000))
    if n > rows:
        given = given.where(share < int(1_000_000 * rows / n))
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(given), F.col("doc_id") == F.col("l_id"))
    once = found.groupBy("text").agg(F.max("y").alias("y"))
    return once.select("text", "y", F.pmod(F.xxhash64(F.lit(6), "text"), F.lit(2)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled rows that aren't held out; text is the only input."""
    train = stage_table(training_sample(docs, labels, "toxic", ~held_out(), TRAIN_ROWS), "toxic-train")
    size = {(r["fold"], r["y"]): r["n"] for r in train.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n = lambda fold, y: float(size.get((fold, y), 0))
    if not n(0, 1) + n(1, 1) or not n(0, 0) + n(1, 0):
        rate = 1.0 if n(0, 1) + n(1, 1) else 0.0
        return Scorer({}, weights=((30.0 if rate else -30.0), 0.0, 0.0))
    counts = train.mapInArrow(_counter, "feature string, c0 bigint, t0 bigint, c1 bigint, t1 bigint").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    kept = counts.where(F.expr("t0 + t1") >= LEAST_DOCS).where(F.expr(f"(t0 + t1) / {n(0, 1) + n(1, 1)} > 1.3 * (c0 + c1) / {n(0, 0) + n(1, 0)}"))
    table = kept.orderBy("feature").toPandas()  # of the sample's features those that toxic texts have more often
    features, of = table["feature"].tolist(), {c: table[c].to_numpy(float) for c in ("c0", "t0", "c1", "t1")}
    whole = token_scores(features, of["c0"] + of["c1"], of["t0"] + of["t1"], n(0, 0) + n(1, 0), n(0, 1) + n(1, 1))
    parts = [token_scores(features, of[f"c{f}"], of[f"t{f}"], n(f, 0), n(f, 1)) for f in (1, 0)]  # each fold by the other's
    session = docs.sparkSession.sparkContext
    models = session.broadcast(parts)  # features of TRAIN_ROWS texts at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(p) for p in models.value]
        for batch in batches:
            rows = []
            for text, y, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                s = scorers[fold].word_scores(words) if words else np.zeros(0)
                values, times = np.unique(np.round(s, 1), return_counts=True)
                rows.append((y, *scorers[fold].evidence(text), values.tolist(), times.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)],
                ["y", "best", "total", "m", "scores", "times"],
            ) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("y", pa.int32()), ("best", pa.float64()), ("total", pa.float64()), ("m", pa.int64()), ("scores", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))]))

    scored = stage_table(train.mapInArrow(score, "y int, best double, total double, m bigint, scores array<double>, times array<bigint>"), "toxic-scored")
    shares = scored.where("y = 0").select(F.explode(F.arrays_zip("scores", "times")).alias("x")).groupBy("x.scores").agg(F.sum("x.times").alias("n")).orderBy("scores").toPandas()
    seen = scored.select("y", "best", "total", "m").orderBy("y", "best", "total", "m").toPandas()
    y, best, m = seen["y"].to_numpy(), seen["best"].to_numpy(), seen["m"].to_numpy()
    p = shares["n"].to_numpy(float) / max(1.0, shares["n"].sum())
    lam, k = extreme_values(shares["scores"].to_numpy(float), p, best[y == 0], m[y == 0])
    scorer = Scorer(whole, lam, k)
    x = np.array([(1.0, *scorer.inputs(*r)) for r in zip(best, seen["total"], m, strict=True)])
    scorer.weights = tuple(float(w) for w in logistic(x, y.astype(float)))
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, with_passages: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) teach, held-out ids excepted; a copy of a held-out text under an id that
    isn't held out does teach. ``with_passages`` adds passages, an
    array of (begin, end, significance) in code points.

    * A null or empty text is scored as a text without any hit. Texts are scored whole.
    * Null labels and ids teach nothing; without labels of both kinds the score is 0 (or 1, if all are toxic).
    * A null doc_id isn't held out. Repeated rows are scored alike. No rows in, no rows out.
    """
    scorer = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    model = docs.sparkSession.sparkContext.broadcast((scorer.scores, scorer.lam, scorer.k, scorer.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*model.value)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            scores = [own.score(t) for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if with_passages:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("significance", pa.float64())]))
                columns.append(pa.array([[dict(zip(("begin", "end", "significance"), p, strict=True)) for p in own.passages(t)] for t in texts], kind))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, held_out boolean, score double, predicted int" + ", passages array<struct<begin:int,end:int,significance:double>>" * with_passages
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text")).mapInArrow(score, schema)
