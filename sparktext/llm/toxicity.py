"""Toxicity by nearest labelled examples.

Texts are vectors of TF-IDF weights over features that go with a label: words, and the first four and five letters of
words. Neighbours are found exactly, by cosine, in an inverted index whose examples lie in blocks: the largest weight of
each feature in each block bounds the block's cosines; blocks are scored, best bound first, until no bound reaches the
k-th best. Votes are weighted by likeness and calibrated on the examples themselves, each without its own vote.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, as_docs, batch_of, map_batches

_TO_SPACE = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 or b == 39 else 32 for b in range(256))
BLOCK = 64


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def features_of_word(word: bytes) -> tuple[bytes, ...]:
    """The word, and its first five and four bytes as stems, if it is longer."""
    return (word, *(b"^" + word[:n] for n in (5, 4) if len(word) > n))


@dataclass(eq=False)
class ToxicityModel:
    """Bounded by the parameters of fit(): features, and examples as sparse unit vectors."""

    features: dict[bytes, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    base: float
    k: int
    curve: list[tuple[float, float]] = field(default_factory=list)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    _kept = Kept()

    def __init__(self, model: ToxicityModel):
        self.m = model
        n, v = len(model.ids), len(model.features)
        self.blocks = -(-n // BLOCK)
        rows = np.repeat(np.arange(n), np.diff(model.starts))
        order = np.lexsort((rows, model.columns))
        self.post_rows, self.post_weights = rows[order], model.weights[order]
        columns = model.columns[order]
        #: Where the postings of a feature in a block begin; and the largest weight among them.
        self.at = np.searchsorted(columns * max(1, self.blocks) + self.post_rows // BLOCK, np.arange(v * max(1, self.blocks) + 1))
        self.most = np.zeros((v, max(1, self.blocks)), np.float64)
        np.maximum.at(self.most, (columns, self.post_rows // BLOCK), self.post_weights)
        self.word: dict[bytes, tuple[int, ...]] = {}
        self.seen: dict[tuple, tuple] = {}

    @classmethod
    def of(cls, model: ToxicityModel) -> Scorer:
        if model.key not in cls._kept:
            cls._kept.clear()
        return cls._kept.of(model.key, lambda: cls(model))

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(feature, times) of a text."""
        found: Counter = Counter()
        word, features = self.word, self.m.features
        for w in tokens(text):
            f = word.get(w)
            if f is None:
                if len(word) > 100_000:
                    word.clear()
                f = word[w] = tuple(features[x] for x in features_of_word(w) if x in features)
            if f:
                found.update(f)
        return tuple(sorted(found.items()))

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        f = np.array([x for x, _ in counts], np.int64)
        w = (1 + np.log(np.array([n for _, n in counts], np.float64))) * self.m.idf[f] if len(f) else np.zeros(0)
        return f, w / math.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, counts, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k examples nearest to a text; ties by row. Exact: a block is left out only if its bound is below the k-th cosine."""
        f, w = self.vector(counts)
        k = self.m.k
        if not len(f) or not len(self.m.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = w @ self.most[f]
        rows, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == k and bound[b] < least - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for x, wx in zip(f, w):
                lo, hi = self.at[x * self.blocks + b], self.at[x * self.blocks + b + 1]
                if hi > lo:
                    scores[self.post_rows[lo:hi] - b * BLOCK] += wx * self.post_weights[lo:hi]
            if b * BLOCK <= without < (b + 1) * BLOCK:
                scores[without - b * BLOCK] = 0
            hit = np.flatnonzero(scores > max(0.0, least - 1e-12))
            rows, cosines = np.concatenate([rows, hit + b * BLOCK]), np.concatenate([cosines, scores[hit]])
            if len(rows) > k:
                best = np.lexsort((rows, -np.round(cosines, 12)))[:k]
                rows, cosines = rows[best], cosines[best]
            if len(rows) == k:
                least = cosines.min()
        order = np.lexsort((rows, -np.round(cosines, 12)))
        return rows[order], cosines[order]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each with the weight 1 / (distance + 0.1), and one vote for the rate among texts without features."""
        w = 1 / (1.1 - np.minimum(cosines, 1.0))
        return float((w @ self.m.labels[rows] + self.m.base) / (w.sum() + 1))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Score, and the three nearest examples with their cosines: of the text alone, so that an example, too, meets itself."""
        counts = self.counts(text)
        if not counts:
            return self.m.base, [], []
        if counts not in self.seen:
            if len(self.seen) > 5_000:
                self.seen.clear()
            rows, cosines = self.nearest(counts)
            self.seen[counts] = (calibrated(self.m.curve, self.vote(rows, cosines)), self.m.ids[rows][:3].tolist(), cosines[:3].tolist())
        return self.seen[counts]


def isotonic(votes: np.ndarray, labels: np.ndarray) -> list[tuple[float, float]]:
    """Pools adjacent violators: (least vote, rate of label 1) of steps that rise; each step's rate is smoothed by one example of each label."""
    steps: list[list[float]] = []
    values, at = np.unique(votes, return_inverse=True)
    for v, ones, n in zip(values.tolist(), np.bincount(at, labels, len(values)).tolist(), np.bincount(at, minlength=len(values)).tolist()):
        steps.append([v, ones, n])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, ones, n = steps.pop()
            steps[-1][1] += ones
            steps[-1][2] += n
    out = []
    for v, ones, n in steps:
        p = (ones + 0.5) / (n + 1)
        out.append((float(v), max(p, out[-1][1] if out else 0.0)))
    return out


def calibrated(curve: list[tuple[float, float]], vote: float) -> float:
    if not curve:
        return vote
    i = np.searchsorted([v for v, _ in curve], vote, side="right") - 1
    # within a step, the vote itself still ranks: it moves the score by a hundredth at most
    return min(1.0, max(0.0, 0.99 * curve[max(0, i)][1] + 0.01 * vote))


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 20_000, most_features: int = 4_096, k: int = 15, least_z: float = 6.0) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; other values and nulls teach nothing), already without held-out rows.

    The examples are a sample of about most_examples labelled rows, those with the least hash of doc_id; this and
    most_features bound the model, the broadcast and what the driver holds. A feature is kept if its rate of label 1, or of
    label 0, is far from chance (normal deviate of at least least_z) and it is in three examples.
    Without labels, every text gets 0.5 less a hundredth.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    total = known.count()
    cut = (1 << 30) if total <= most_examples else int((1 << 30) * (most_examples / total))
    sample = known.where(F.col("h") < cut).select(F.col("doc_id").alias("id"), "toxic")
    train = as_docs(docs, "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")  # about most_examples rows of two numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels_, words, times = [], [], [], []
        for i, text, y in zip(*(c.to_pylist() for c in batch.columns)):
            found = Counter(x for w in tokens(text) for x in features_of_word(w))
            ids.append(i)
            labels_.append(y)
            words.append(list(found))
            times.append(list(found.values()))
        return batch_of(doc_id=pa.array(ids, pa.int64()), toxic=pa.array(labels_, pa.int32()), words=pa.array(words, pa.list_(pa.binary())), times=pa.array(times, pa.list_(pa.int32())))

    bags = map_batches(train, run, "doc_id long, toxic int, words array<binary>, times array<int>").persist()
    total, ones = bags.select(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = ones / total if total else 0.0
    if not total or ones in (0, total):
        bags.unpersist()
        none = np.zeros(0, np.int64)
        return ToxicityModel({}, np.zeros(0), none, none, np.zeros(1, np.int64), none, np.zeros(0), float(rate) if total else 0.49, k)
    n, a = F.col("n"), F.col("a")
    z = F.abs(a - n * rate) / F.sqrt(n * rate * (1 - rate))
    stats = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"))
    top = stats.where((n >= 3) & (z >= least_z) & (F.abs(a / n - rate) > 0.3)).orderBy(F.desc(z), "word").limit(most_features).collect()
    features = {bytes(r.word): i for i, r in enumerate(top)}
    idf = np.array([math.log((total + 1) / (r.n + 1)) + 1 for r in top])

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [[(features[w], n) for w, n in zip(ws, ns) if w in features] for ws, ns in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return batch_of(doc_id=batch.column(0), toxic=batch.column(1), f=pa.array([[x for x, _ in r] for r in keep], pa.list_(pa.int32())), n=pa.array([[x for _, x in r] for r in keep], pa.list_(pa.int32())))

    rows = sorted(map(tuple, map_batches(bags, pick, "doc_id long, toxic int, f array<int>, n array<int>").collect()), key=lambda r: (r[0], sorted(r[2])))
    bags.unpersist()
    bare = [y for _, y, f, _ in rows if not f]
    base = (sum(bare) + 0.5 * (not bare)) / max(1, len(bare))
    rows = [r for r in rows if r[2]]
    starts, columns, weights = [0], [], []
    for _, _, f, n in rows:
        w = [(1 + math.log(x)) * idf[c] for c, x in zip(f, n)]
        norm = math.sqrt(sum(x * x for x in w))
        columns += f
        weights += [x / norm for x in w]
        starts.append(len(columns))
    model = ToxicityModel(features, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), np.array(starts, np.int64), np.array(columns, np.int64), np.array(weights), float(base), k)
    if rows:
        # an example's counts, from which its own vote is kept, are votes of executors
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((model, [tuple(sorted(zip(f, n))) for _, _, f, n in rows]))  # bounded, as above

        def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
            scorer = Scorer.of(shared.value[0])
            return batch_of(row=batch.column(0), vote=pa.array([scorer.vote(*scorer.nearest(shared.value[1][i], i)) for i in batch.column(0).to_pylist()], pa.float64()))

        votes = np.zeros(len(rows))
        for r in map_batches(spark.range(len(rows)), vote, "row long, vote double").collect():
            votes[r.row] = r.vote
        model.curve = isotonic(votes, model.labels)
        model.key = uuid.uuid4().hex  # workers keep scorers by key; that one has no curve
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted (1 from 0.5 on), evidence (ids of the nearest examples), likeness (their cosines), for every whole text.

    Null, empty and featureless texts get the rate among such examples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_examples and most_features

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer.of(shared.value)
        found = [scorer.score(t) for t in batch.column(1).to_pylist()]
        values = [r[0] for r in found]
        return batch_of(
            doc_id=batch.column(0), score=pa.array(values, pa.float64()), predicted=pa.array([int(s >= 0.5) for s in values], pa.int32()),
            evidence=pa.array([r[1] for r in found], pa.list_(pa.int64())), likeness=pa.array([r[2] for r in found], pa.list_(pa.float64())),
        )

    return map_batches(as_docs(docs, "text"), run, "doc_id long, score double, predicted int, evidence array<long>, likeness array<double>")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Those rows of docs, all their columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer.of(shared.value)
        return batch.filter(pa.array([scorer.score(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
