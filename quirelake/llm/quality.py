"""Quality classifier: positive-unlabelled learning with non-negative risk.

Trusted positives are labelled documents of good quality that are not toxic;
every document of the corpus is unlabelled. A linear scorer over hashed
presence features (words, runs of marks, shape of the text) minimises

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))

with logistic loss (Kiryo et al., 2017). The class prior is estimated first, by
the best-bin bound over the upper tail of a naive log-ratio score (Garg et al.,
2021), on positives held out of that score.

Work is spread as follows. Feature counts, the score histogram and every round
of gradient updates read all documents, one task a split; tasks send sums per
feature, which Spark adds up. Only the trusted positives are a sample, of at
most ``max_positives`` rows, chosen by hashes of doc_id and text; their features
are broadcast. The driver sees arrays of at most ``BUCKETS`` entries.

Defined results. Null and empty texts have no evidence against them beyond
their shape features and are scored like any other text. Repeated rows get
equal scores and each counts in the corpus. A label of a null doc_id, and a
document that has none, can't be joined and serve as unlabelled only. When there
are no trusted positives, or no documents, nothing can be learnt and all
documents are kept (score 0). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm import _text

BUCKETS = 1 << 18
BINS = 2048
_SPAN = 40.0


@dataclass(frozen=True)
class Params:
    """max_positives bounds the sample of labelled rows.

    A feature counts if its log ratio of unlabelled to positive rates is
    least_ratio at least and its count is least_deviation standard deviations off.
    Training starts from these log ratios. A document is kept if its learned
    score is above that of all but a share ``sacrificed`` of the trusted positives
    that were held out of training.
    """

    max_positives: int = 8192
    smoothing: float = 0.0005
    least_ratio: float = 0.35
    least_deviation: float = 2.5
    rounds: int = 2
    batch: int = 32
    rate: float = 0.3
    pseudo: float = 4.0
    sacrificed: float = 0.01


@dataclass(frozen=True)
class Model:
    """Score = bias - sum of weights of the features present; kept if > cut."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    cut: float = 0.0

    def scores(self, indptr: np.ndarray, features: np.ndarray) -> np.ndarray:
        slot = self.slots[features]
        value = np.where(slot >= 0, self.weights[np.maximum(slot, 0)], 0.0) if len(self.weights) else np.zeros(len(slot))
        return self.bias - _sums(value, indptr)


def _sums(value: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1)
    np.cumsum(value, out=total[1:])
    return total[indptr[1:]] - total[indptr[:-1]]


def _shape(name: int, level: np.ndarray) -> np.ndarray:
    key = (level.astype(np.int64) + (name << 32)).astype(np.uint64)
    return (_text.mix(key) >> np.uint64(46)).astype(np.int64)


def features(piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, as (indptr, features)."""
    upper_data, upper_offsets = _text.raw(piece)
    t = _text.tokens_of(0, piece)
    n = len(t)
    m_starts, m_ends = _text.runs(t.data, t.offsets, _text.MARK)
    marks = _text.hashed(t.data, m_starts, m_ends) ^ np.uint64(0xABCDEF)
    m_bounds = np.searchsorted(m_starts, t.offsets)
    words = np.diff(t.bounds)
    length = np.maximum(1, np.diff(t.offsets))
    rows = np.concatenate([t.owner(), np.repeat(np.arange(n), np.diff(m_bounds))])
    keys = np.concatenate([t.hashes, _text.mix(marks)]) >> np.uint64(46)
    own = np.unique(rows * BUCKETS + keys.astype(np.int64))
    distinct = np.bincount(own // BUCKETS, minlength=n)
    capital = np.zeros(len(upper_data) + 1, np.int64)
    np.cumsum((upper_data >= 65) & (upper_data <= 90), out=capital[1:])
    shape = np.concatenate(
        [
            _shape(1, np.floor(10 * (capital[upper_offsets[1:]] - capital[upper_offsets[:-1]]) / length)),
            _shape(2, np.floor(10 * distinct / np.maximum(1, words + np.diff(m_bounds)))),
            _shape(3, np.floor(20 * np.diff(m_bounds) / np.maximum(1, words))),
            _shape(4, np.floor(np.log2(1.0 + words))),
        ]
    )
    own = np.unique(np.concatenate([own, np.tile(np.arange(n), 4) * BUCKETS + shape]))
    return np.searchsorted(own, np.arange(n + 1) * BUCKETS), own % BUCKETS


def featured(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, piece in _text.slices(_text.large(column)):
        yield (first, *features(piece))


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray, confidence: float = 0.1) -> float:
    """Class prior from counts of scores by bin, the bins being ordered from low to high scores."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return 0.5
    tail_u, tail_p = (np.cumsum(x[::-1]) / x.sum() for x in (unlabelled, positive))
    seen = tail_p >= 0.05
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    bound = tail_u[seen] / tail_p[seen] + slack / tail_p[seen]
    best = int(np.argmin(bound))
    return float(np.clip(tail_u[seen][best] / tail_p[seen][best], 0.05, 0.95))


def positives(documents: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """Texts of the sampled trusted positives: doc_id, text."""
    trusted = (
        labels.where("quality = 1 AND (toxic = 0 OR toxic IS NULL) AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("_id"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(p.max_positives)
    )
    known = documents.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left_semi")
    return known.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(p.max_positives)  # rows may repeat a doc_id


def _packed(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of a bounded table of texts, in the order of a hash of doc_id, which may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, indptr, own in featured(b.column("text")):
                parts = [own[i:j].astype(np.int32).tobytes() for i, j in zip(indptr[:-1], indptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(parts)], pa.int64()), pa.array(parts, pa.binary())], ["id", "own"])

    rows = sorted((r["id"], bytes(r["own"])) for r in df.select(F.xxhash64("doc_id").alias("doc_id"), "text").mapInArrow(run, "id long, own binary").collect())
    own = [np.frombuffer(x, np.int32) for _, x in rows]
    return np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int64)


def _counted(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each feature, over all of them; how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for _, indptr, own in featured(b.column("text")):
                count += np.bincount(own, minlength=BUCKETS)
                rows += len(indptr) - 1
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int32()), pa.array([rows, *count[there]], pa.int64())], ["f", "n"])

    found = texts.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = found["f"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def _binned(scores: np.ndarray) -> np.ndarray:
    return np.clip(((scores + _SPAN) * (BINS / (2 * _SPAN))).astype(np.int64), 0, BINS - 1)


def _histogram(texts: DataFrame, model: Model) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BINS, np.int64)
        for b in batches:
            for _, indptr, own in featured(b.column("text")):
                count += np.bincount(_binned(model.scores(indptr, own)), minlength=BINS)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there], pa.int64())], ["f", "n"])

    found = texts.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[found["f"].to_numpy()] = found["n"].to_numpy()
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Learner:
    """Minibatch descent on the non-negative risk, with steps scaled by past gradients.

    What is learned is the mean of the weights over the later half of the steps.
    """

    def __init__(self, model: Model, positive: tuple[np.ndarray, np.ndarray], p: Params, seed: int) -> None:
        self.slots, self.prior, self.p = model.slots, model.prior, p
        self.w = np.append(model.weights, model.bias).astype(np.float64)
        self.past = np.full(len(self.w), 1e-3)
        self.positive, self.random = positive, np.random.default_rng(seed)
        self.steps, self.sums = 0, [np.zeros(len(self.w))]  # of the weights, by ever longer runs of steps

    def _dense(self, indptr: np.ndarray, own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = indptr[rows + 1] - indptr[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) + np.repeat(indptr[rows] - (np.cumsum(size) - size), size)
        slot = self.slots[own[at]]
        return row[slot >= 0], slot[slot >= 0]

    def step(self, indptr: np.ndarray, own: np.ndarray, rows: np.ndarray) -> None:
        p, prior = self.p, self.prior
        some = self.random.integers(0, len(self.positive[0]) - 1, p.batch)
        sides = [self._dense(*self.positive, some), self._dense(indptr, own, rows)]
        z_p, z_u = (self.w[-1] - np.bincount(r, self.w[s], minlength=n) for (r, s), n in zip(sides, (len(some), len(rows)), strict=True))
        plus, minus = _sigmoid(z_p) - 1, _sigmoid(z_p)  # slopes of the losses for labels +1 and -1
        risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if risk >= 0:
            g_p, g_u = prior * (plus - minus), _sigmoid(z_u)
        else:  # the clipped part has no slope
            g_p, g_u = prior * plus, np.zeros(len(rows))
        grad = np.zeros(len(self.w))
        for (r, s), g in zip(sides, (g_p / len(some), g_u / len(rows)), strict=True):
            grad[:-1] -= np.bincount(s, g[r], minlength=len(grad) - 1)
            grad[-1] += g.sum()
        self.past += grad * grad
        self.w -= p.rate * grad / np.sqrt(self.past)
        self.steps += 1
        self.sums[-1] += self.w
        if self.steps & (self.steps + 1) == 0:  # a run ends before each power of two
            self.sums = [*self.sums[-1:], np.zeros(len(self.w))]

    def mean(self) -> np.ndarray:
        """Of the weights over the last run and the one before it, which are half of all steps or more."""
        if not self.steps:
            return self.w
        own = 1 << (self.steps + 1).bit_length() - 1  # steps from own on are in the last run
        return sum(self.sums) / (self.steps + 1 - own + (own // 2 if len(self.sums) > 1 else 0))

    def learn(self, indptr: np.ndarray, own: np.ndarray) -> None:
        order = self.random.permutation(len(indptr) - 1)
        for i in range(0, len(order), self.p.batch):
            self.step(indptr, own, order[i : i + self.p.batch])


def _round(texts: DataFrame, model: Model, positive: tuple[np.ndarray, np.ndarray], p: Params) -> Model:
    """One pass over all texts: each task descends from the model, and the ends are averaged by rows seen."""
    shared = texts.sparkSession.sparkContext.broadcast((model, positive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, positive = shared.value
        learner, rows, held = None, 0, []

        def flush() -> None:
            sizes = np.concatenate([np.diff(i) for i, _ in held])
            learner.learn(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([o for _, o in held]))
            held.clear()

        for b in batches:
            for _, indptr, own in featured(b.column("text")):
                learner = learner or Learner(model, positive, p, len(own))
                held.append((indptr, own))
                rows += len(indptr) - 1
                if sum(len(i) for i, _ in held) > 2048:
                    flush()
        if held:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(learner.w)), pa.int32()), pa.array(np.append([1.0], learner.mean()) * rows, pa.float64())], ["f", "v"])

    found = texts.mapInArrow(run, "f int, v double").groupBy("f").agg(F.sum("v").alias("v")).orderBy("f").toArrow()["v"].to_numpy()
    shared.unpersist()
    w = found[1:] / found[0]
    return replace(model, weights=w[:-1], bias=float(w[-1]))


def trained(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learn from all documents as unlabelled and a bounded sample of trusted positives."""
    nothing = Model(np.full(BUCKETS, -1, np.int64), np.zeros(0), 0.0, 0.5, -1.0)
    positive = _packed(positives(documents, labels, p))
    n_p = len(positive[0]) - 1
    if not n_p:
        return nothing
    texts = documents.select("text")
    count_u, n_u = _counted(texts)
    fitted, held = _split(*positive)
    n_f, n_h = len(fitted[0]) - 1, len(held[0]) - 1
    least = p.smoothing + p.pseudo / n_f
    count_f, expected = np.bincount(fitted[1], minlength=BUCKETS), count_u * (n_f / n_u)
    ratio = np.log((count_u / n_u + least) / (count_f / n_f + least))
    clear = np.abs(expected - count_f) >= p.least_deviation * np.sqrt(expected + 1)
    active = np.flatnonzero(clear & (np.abs(ratio) >= p.least_ratio))
    slots = np.full(BUCKETS, -1, np.int64)
    slots[active] = np.arange(len(active))
    naive = Model(slots, ratio[active], 0.0, 0.5)
    on_held = np.bincount(_binned(naive.scores(*held)), minlength=BINS)
    model = Model(slots, ratio[active], 2.0, estimated_prior(_histogram(texts, naive), on_held))
    for _ in range(p.rounds):
        model = _round(texts, model, fitted, p)
    lowest = np.sort(model.scores(*held))
    return replace(model, cut=float(np.nextafter(lowest[int(p.sacrificed * n_h)], -np.inf)))


def _split(indptr: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every fourth text is held out; of fewer than four, all serve for both."""
    n = len(indptr) - 1
    out = np.arange(n) % 4 == 3
    size = np.diff(indptr)
    return [(np.concatenate([[0], np.cumsum(size[x])]), own[np.repeat(x, size)]) for x in ([~out, out] if n >= 4 else [out | True] * 2)]


def score(text: Column, model: Model, spark) -> Column:
    """Score of a text; the model is broadcast, its size bounded by BUCKETS."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        out = [shared.value.scores(indptr, own) for _, indptr, own in featured(column)]
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, score and keep of every document."""
    model = trained(documents, labels, p)
    return documents.select("doc_id", score(F.col("text"), model, documents.sparkSession).alias("score")).withColumn("keep", F.col("score") > model.cut)


def keep_good(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents whose score exceeds the cut, with all their columns."""
    model = trained(documents, labels, p)
    return documents.where(score(F.col("text"), model, documents.sparkSession) > model.cut)
