"""Text classification and calibration (C1-C17). Labelled data: doc_id, category, terms (array of features)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktext.functions.similarity import dot, norm
from .vectors import mean_vectors


def softmax(scored: DataFrame, temperature: float = 1.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """probability from score, by document."""
    w = Window.partitionBy(*keys)
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return scored.withColumn("probability", e / F.sum(e).over(w))


# naive Bayes: the model is two small tables, of counts by category and by category and term


@dataclass
class NaiveBayes:
    """terms: category, term, c; classes: category, docs, total. alpha smooths; complement counts the other categories' terms."""

    terms: DataFrame
    classes: DataFrame
    alpha: float = 1.0
    skip_unknown: bool = False
    complement: bool = False
    temperature: float = 1.0

    @staticmethod
    def train(labelled: DataFrame, **options) -> NaiveBayes:
        """labelled: category, terms; an optional weight, of which -1 unlearns."""
        w = F.col("weight") if "weight" in labelled.columns else F.lit(1)
        rows = labelled.where(F.col("category").isNotNull()).select("category", "terms", w.alias("w"))
        terms = rows.select("category", "w", F.explode("terms").alias("term")).groupBy("category", "term").agg(F.sum("w").alias("c")).where("c > 0")
        classes = rows.groupBy("category").agg(F.sum("w").alias("docs"), F.sum(F.col("w") * F.size("terms")).alias("total"))
        return NaiveBayes(terms, classes, **options)

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs: doc_id, terms. doc_id, category, score, probability for every category.

        A term unknown to a category weighs what smoothing gives it: that is summed as terms of a document times the
        category's constant, and known terms add what they have beyond it. So only matches are joined, not documents by
        categories by vocabulary.
        """
        a = self.alpha
        # a row for each term, with its categories: documents' terms meet it once
        known = self.terms.groupBy("term").agg(F.collect_list(F.struct("category", "c")).alias("m"), F.sum("c").alias("g"))
        size = known.agg(F.count("*").alias("V"))
        overall = self.classes.agg(F.sum("docs").alias("D"), F.sum("total").alias("all"))
        # one row of totals; a row for each category
        classes = self.classes.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(overall))
        each = docs.select("doc_id", F.explode("terms").alias("term")).join(known, "term", "inner" if self.skip_unknown or self.complement else "left")
        if self.complement:
            classes = classes.withColumn("T", F.col("all") - F.col("total") + a * F.col("V"))
            base = F.col("n") * F.log("T")
            # minus the log of (everywhere - here + alpha): of the term in all, corrected where the category has it
            common, beyond = -F.log(F.col("g") + a), lambda x: F.log(F.col("g") + a) - F.log(F.col("g") - x["c"] + a)
        else:
            classes = classes.withColumn("T", F.col("total") + a * F.col("V"))
            base = F.log(F.col("docs") / F.col("D")) + F.col("n") * F.log(F.lit(a) / F.col("T"))
            common, beyond = F.lit(0.0), lambda x: F.log((x["c"] + a) / a)
        # without a category: what a term adds to all of them
        parts = F.concat(F.array(F.struct(F.lit(None).cast(self.terms.schema["category"].dataType).alias("category"), common.alias("v"))), F.coalesce(F.transform("m", lambda x: F.struct(x["category"].alias("category"), beyond(x).alias("v"))), F.array()))
        summed = each.select("doc_id", F.explode(parts).alias("p")).groupBy("doc_id", "p.category").agg(F.sum("p.v").alias("v"), F.count("*").alias("n"))
        by_document = summed.groupBy("doc_id").agg(F.sum(F.when(F.col("category").isNull(), F.col("n"))).alias("n"), F.sum(F.when(F.col("category").isNull(), F.col("v"))).alias("common"), F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "v")))).alias("beyond"))
        found = docs.select("doc_id").join(by_document, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(classes))
        scored = found.select("doc_id", "category", (base + F.coalesce("common", F.lit(0.0)) + F.coalesce(F.col("beyond")[F.col("category")], F.lit(0.0))).alias("score"))
        return softmax(scored, self.temperature)


def best(predicted: DataFrame, limit: int = 1) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("probability"), "category")
    return predicted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def telling_terms(labelled: DataFrame, least: float = 0.3) -> DataFrame:
    """category, term, inside, outside: terms whose smoothed share of a category's documents is far from that of the others', |ln(in / out)| >= least."""
    docs = labelled.groupBy("category").agg(F.count("*").alias("docs"))
    total = docs.agg(F.sum("docs").alias("all_docs"))
    df = labelled.select("category", F.explode(F.array_distinct("terms")).alias("term")).groupBy("category", "term").agg(F.count("*").alias("d"))
    all_ = df.groupBy("term").agg(F.sum("d").alias("g"))
    rows = df.join(all_, "term").join(docs, "category").crossJoin(F.broadcast(total))  # one row
    inside, outside = (F.col("d") + 1) / (F.col("docs") + 2), (F.col("g") - F.col("d") + 1) / (F.col("all_docs") - F.col("docs") + 2)
    return rows.select("category", "term", inside.alias("inside"), outside.alias("outside")).where(F.abs(F.log(F.col("inside") / F.col("outside"))) >= least)


def centroids(labelled: DataFrame) -> DataFrame:
    """category, v: mean vectors (C8). labelled: category, v."""
    return mean_vectors(labelled, "category").withColumnRenamed("v", "center")


def centroid_predict(vectors: DataFrame, centers: DataFrame, temperature: float = 0.1, most: int = 10_000) -> DataFrame:
    """doc_id, category, score (cosine), probability. Centers, a row for each category, are checked to be few."""
    if (n := centers.count()) > most:
        raise ValueError(f"{n} categories: at most {most}")
    a, b = F.col("v"), F.col("center")
    scored = vectors.withColumn("nv", norm(a)).crossJoin(F.broadcast(centers.withColumn("nc", norm(b))))
    cosine = F.when((F.col("nv") == 0) | (F.col("nc") == 0), 0.0).otherwise(dot(a, b) / (F.col("nv") * F.col("nc")))
    return softmax(scored.select("doc_id", "category", cosine.alias("score")), temperature)


def neighbour_votes(neighbours: DataFrame, k: int = 5, vote: str = "score", temperature: float = 1.0) -> DataFrame:
    """neighbours: doc_id, category, score. Votes of the k nearest by score, by 1 / (rank), or by softmax (C9); if they come to nothing, each counts 1."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "neighbour")
    near = neighbours.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    weight = {"score": F.col("score"), "rank": 1 / F.col("rank"), "temperature": F.exp((F.col("score") - F.max("score").over(Window.partitionBy("doc_id"))) / temperature)}[vote]
    near = near.withColumn("w", weight).withColumn("w", F.when(F.sum("w").over(Window.partitionBy("doc_id")) <= 0, 1.0).otherwise(F.col("w")))
    votes = near.groupBy("doc_id", "category").agg(F.sum("w").alias("w"))
    return votes.select("doc_id", "category", (F.col("w") / F.sum("w").over(Window.partitionBy("doc_id"))).alias("probability"))


def blend(lanes: list[tuple[DataFrame, float]], candidates: tuple[DataFrame, float] | None = None, priors: DataFrame | None = None) -> DataFrame:
    """Weighted probabilities of classifiers, evidence (doc_id, category, weight), and log-additive priors (category, bonus)."""
    parts = [p.select("doc_id", "category", (F.col("probability") * w).alias("p")) for p, w in lanes]
    if candidates is not None:
        share = F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id"))
        parts.append(candidates[0].select("doc_id", "category", (share * candidates[1]).alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("doc_id", "category").agg(F.sum("p").alias("p"))
    if priors is not None:
        out = out.join(priors, "category", "left").withColumn("p", F.col("p") * F.exp(F.coalesce("bonus", F.lit(0.0)))).drop("bonus")
    return out.select("doc_id", "category", (F.col("p") / F.sum("p").over(Window.partitionBy("doc_id"))).alias("probability"))


# calibration and confidence


def fit_temperature(scored: DataFrame) -> DataFrame:
    """scored: doc_id, category, score, actual. One row: temperature of the least mean log loss on a grid of 401 from 0.05 to 10, 1 among equals."""
    grid = F.explode(F.array_union(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: 0.05 + i.cast("double") * (9.95 / 400)), F.array(F.lit(1.0))))
    most = scored.withColumn("best", F.max("score").over(Window.partitionBy("doc_id")))
    each = most.select("doc_id", "category", "actual", (F.col("score") - F.col("best")).alias("s"), grid.alias("t"))
    per = each.groupBy("t", "doc_id").agg(F.log(F.sum(F.exp(F.col("s") / F.col("t")))).alias("z"), F.max(F.when(F.col("category") == F.col("actual"), F.col("s"))).alias("mine"))
    loss = per.where("mine IS NOT NULL").groupBy("t").agg(F.avg(F.col("z") - F.col("mine") / F.col("t")).alias("loss"))
    return loss.orderBy(F.round("loss", 9), F.abs(F.col("t") - 1)).limit(1).select(F.col("t").alias("temperature"), "loss")


def isotonic(scores: np.ndarray, hits: np.ndarray) -> list[tuple[float, float]]:
    """Steps (from score, rate) that never fall: adjacent violators pooled."""
    steps: list[list[float]] = []
    for s in np.unique(scores):
        at = scores == s
        steps.append([float(s), float(hits[at].sum()), float(at.sum())])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, h, n = steps.pop()
            steps[-1][1] += h
            steps[-1][2] += n
    return [(s, h / n) for s, h, n in steps]


def platt(scores: np.ndarray, hits: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a s + b))) by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * scores + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((hits - p) * scores).sum(), (hits - p).sum()])
        h = np.array([[(w * scores * scores).sum(), (w * scores).sum()], [(w * scores).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def youden(judged: DataFrame) -> DataFrame:
    """judged: score, hit (0 or 1). One row: the threshold of the largest sensitivity + specificity - 1, from counts by distinct score."""
    by = judged.groupBy("score").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct score
    total = judged.agg(F.sum("hit").alias("all_hits"), F.count("*").alias("all_rows"))
    j = F.sum("hits").over(w) / F.col("all_hits") - (F.sum("n").over(w) - F.sum("hits").over(w)) / (F.col("all_rows") - F.col("all_hits"))
    return by.crossJoin(F.broadcast(total)).withColumn("j", F.round(j, 9)).orderBy(F.desc("j"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "j")


def winner_margin(ranked: DataFrame) -> DataFrame:
    """1 - next / this score, 1 for the last (C14)."""
    following = F.lead("score").over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return ranked.withColumn("confidence", F.when(following.isNull() | (F.col("score") <= 0), F.lit(1.0)).otherwise(1 - following / F.col("score")))


def z_confidence(ranked: DataFrame) -> DataFrame:
    """Logistic of the score's distance from the list's mean, in standard deviations (C14)."""
    w = Window.partitionBy("query_id")
    spread = F.stddev_pop("score").over(w)
    z = F.when(spread > 0, (F.col("score") - F.avg("score").over(w)) / spread).otherwise(0.0)
    return ranked.withColumn("confidence", 1 / (1 + F.exp(-z)))


# trees, forests and linear models: trained by one task on a bounded sample, applied to all rows


@dataclass
class Node:
    counts: dict[str, float]
    question: tuple[str, float | None] | None = None
    yes: Node | None = None
    no: Node | None = None


def _impurity(w: np.ndarray, gini: bool) -> float:
    p = w / w.sum() if w.sum() else w
    p = p[p > 0]
    return float(1 - (p * p).sum()) if gini else float(-(p * np.log2(p)).sum())


@dataclass
class DecisionTree:
    """Questions: has a feature, or its value is at least a threshold (C5). criterion: gini, gain or gain_ratio."""

    depth: int = 8
    min_leaf: int = 2
    criterion: str = "gain"
    alpha: float = 1.0
    costs: dict[str, float] = field(default_factory=dict)
    most_thresholds: int = 32
    root: Node | None = None
    classes: list[str] = field(default_factory=list)

    def train(self, items: list[dict[str, float]], labels: list[str], weights: list[float] | None = None, numeric: frozenset = frozenset()) -> DecisionTree:
        self.classes = sorted(set(labels))
        place = {c: i for i, c in enumerate(self.classes)}
        y, w = np.array([place[x] for x in labels]), np.array(weights or [1.0] * len(labels))
        names = sorted({f for x in items for f in x})
        column = {f: i for i, f in enumerate(names)}
        # what each item has, as places of names; values are kept for numeric features alone
        has = [np.array(sorted(column[f] for f in item), np.int64) for item in items]
        starts = np.concatenate([[0], np.cumsum([len(h) for h in has])]).astype(np.int64)
        flat = np.concatenate(has) if has else np.zeros(0, np.int64)
        asked = np.array([f not in numeric for f in names], bool)
        price = np.array([self.costs.get(f, 1.0) for f in names])
        x = {f: np.array([item.get(f, np.nan) for item in items], np.float64) for f in names if f in numeric}
        k = len(self.classes)

        def impurities(have: np.ndarray) -> np.ndarray:
            total = have.sum(1, keepdims=True)
            p = np.divide(have, total, out=np.zeros_like(have), where=total > 0)
            if self.criterion == "gini":
                return np.where(total[:, 0] > 0, 1 - (p * p).sum(1), 1.0)
            return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)

        def best_presence(rows: np.ndarray, have: np.ndarray, before: float):
            """The best question whether a feature is there: all features of the rows at once, from what the rows have."""
            sizes = starts[rows + 1] - starts[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            places = flat[np.arange(sizes.sum()) + np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes)]
            found, at = np.unique(places, return_inverse=True)
            n = np.bincount(at, minlength=len(found))
            a = np.bincount(at * k + y[rows][owner], w[rows][owner], len(found) * k).reshape(-1, k)
            fit = np.flatnonzero((np.minimum(n, len(rows) - n) >= self.min_leaf) & asked[found])
            if not len(fit):
                return None
            a, b = a[fit], have - a[fit]
            gain = before - (a.sum(1) * impurities(a) + b.sum(1) * impurities(b)) / have.sum()
            if self.criterion == "gain_ratio":
                sides = np.stack([a.sum(1), b.sum(1)], 1)
                p = sides / sides.sum(1, keepdims=True)
                gain = gain / np.maximum(-(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1), 1e-12)
            gain = gain / price[found[fit]]
            i = int(np.argmax(np.round(gain, 12)))  # the first of equals, by name
            if gain[i] <= 1e-12:
                return None
            yes = np.zeros(len(rows), bool)
            yes[owner[at == fit[i]]] = True
            name = names[found[fit[i]]]
            return (-round(float(gain[i]), 12), name, False, 0.0), name, None, yes

        def grow(rows: np.ndarray, left: int) -> Node:
            have = np.bincount(y[rows], w[rows], k)
            node = Node({c: float(have[i]) for i, c in enumerate(self.classes)})
            if not left or len(rows) < 2 * self.min_leaf or (have > 0).sum() < 2:
                return node
            before = _impurity(have, self.criterion == "gini")
            choice = best_presence(rows, have, before)
            for name, column_ in x.items():
                v = column_[rows]
                values = np.unique(v[~np.isnan(v)])
                for cut in values[np.linspace(0, len(values) - 1, min(len(values), self.most_thresholds)).astype(int)] if len(values) else []:
                    yes = np.nan_to_num(v, nan=-np.inf) >= cut
                    if min(yes.sum(), (~yes).sum()) < self.min_leaf:
                        continue
                    a = np.bincount(y[rows[yes]], w[rows[yes]], k)
                    b = have - a
                    gain = before - (a.sum() * _impurity(a, self.criterion == "gini") + b.sum() * _impurity(b, self.criterion == "gini")) / have.sum()
                    if self.criterion == "gain_ratio":
                        gain /= max(_impurity(np.array([a.sum(), b.sum()]), False), 1e-12)
                    gain /= self.costs.get(name, 1.0)
                    order = (-round(gain, 12), name, True, cut)
                    if gain > 1e-12 and (choice is None or order < choice[0]):
                        choice = (order, name, cut, yes)
            if choice:
                _, name, cut, yes = choice
                node.question, node.yes, node.no = (name, cut), grow(rows[yes], left - 1), grow(rows[~yes], left - 1)
            return node

        self.root = grow(np.arange(len(items)), self.depth)
        return self

    def leaf(self, item: dict[str, float]) -> tuple[Node, list[str]]:
        node, path = self.root, []
        while node.question:
            f, cut = node.question
            yes = f in item if cut is None else item.get(f, -math.inf) >= cut
            path.append(f"{f}{'' if cut is None else f' >= {cut}'}: {'yes' if yes else 'no'}")
            node = node.yes if yes else node.no
        return node, path

    def predict(self, item: dict[str, float]) -> dict[str, float]:
        node, _ = self.leaf(item)
        total = sum(node.counts.values()) + self.alpha * len(self.classes)
        return {c: (node.counts[c] + self.alpha) / total for c in self.classes}

    def learn(self, item: dict[str, float], label: str, weight: float = 1.0) -> None:
        """Adds to the leaf that is reached; a weight of -1 takes it back."""
        counts = self.leaf(item)[0].counts
        counts[label] = counts.get(label, 0.0) + weight


@dataclass
class RandomForest:
    """Trees on bootstrap weights and a share of the features; mean distribution."""

    trees: int = 40
    depth: int = 20
    share: float = 0.3
    seed: int = 7
    grown: list[DecisionTree] = field(default_factory=list)

    def train(self, items: list[dict[str, float]], labels: list[str]) -> RandomForest:
        names = sorted({f for x in items for f in x})
        for t in range(self.trees):
            rng = np.random.default_rng(self.seed + t)
            w = np.bincount(rng.integers(0, len(items), len(items)), minlength=len(items)).astype(float)
            kept = {names[i] for i in rng.choice(len(names), math.ceil(self.share * len(names)), replace=False)} if names else set()
            rows = np.flatnonzero(w)
            self.grown.append(DecisionTree(self.depth, 1, "gini").train([{f: v for f, v in items[i].items() if f in kept} for i in rows], [labels[i] for i in rows], w[rows].tolist()))
        return self

    def predict(self, item: dict[str, float]) -> dict[str, float]:
        out: dict[str, float] = {}
        for tree in self.grown:
            for c, p in tree.predict(item).items():
                out[c] = out.get(c, 0.0) + p
        total = sum(out.values())
        return {c: p / total for c, p in out.items()}


@dataclass
class LinearModel:
    """Multinomial logistic regression by AdaGrad."""

    epochs: int = 20
    rate: float = 0.1
    l2: float = 1e-4
    min_df: int = 2
    seed: int = 7
    use_idf: bool = False
    classes: list[str] = field(default_factory=list)
    columns: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    idf: np.ndarray | None = None

    def train(self, items: list[dict[str, float]], labels: list[str]) -> LinearModel:
        df: dict[str, int] = {}
        for x in items:
            for f in x:
                df[f] = df.get(f, 0) + 1
        names = sorted(f for f, n in df.items() if n >= self.min_df)
        self.columns, self.classes = {f: i for i, f in enumerate(names)}, sorted(set(labels))
        self.idf = np.array([math.log(1 + len(items) / df[f]) if self.use_idf else 1.0 for f in names])
        k = len(self.classes)
        self.weights, self.bias = np.zeros((len(names), k)), np.zeros(k)
        g, gb = np.zeros_like(self.weights), np.zeros(k)
        rows = [self._row(x) for x in items]
        target = np.eye(k)[[self.classes.index(x) for x in labels]]
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            for i in rng.permutation(len(rows)):
                at, v = rows[i]
                err = self._softmax(v @ self.weights[at] + self.bias) - target[i]
                gb += err * err
                self.bias -= self.rate * err / np.sqrt(gb + 1e-8)
                grad = v[:, None] * err[None, :] + self.l2 * self.weights[at]
                g[at] += grad * grad
                self.weights[at] -= self.rate * grad / np.sqrt(g[at] + 1e-8)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def _row(self, x: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(self.columns[f] for f in x if f in self.columns), np.int64)
        back = {self.columns[f]: v for f, v in x.items() if f in self.columns}
        return at, np.array([back[i] for i in at]) * self.idf[at] if len(at) else np.zeros(0)

    def predict(self, item: dict[str, float]) -> dict[str, float]:
        at, v = self._row(item)
        return dict(zip(self.classes, self._softmax(v @ self.weights[at] + self.bias).tolist()))

    def top_features(self, category: str, n: int = 10) -> list[tuple[str, float]]:
        w = self.weights[:, self.classes.index(category)]
        names = list(self.columns)
        return [(names[i], float(w[i])) for i in np.argsort(-w, kind="stable")[:n]]


def sample(labelled: DataFrame, most: int = 2000) -> list:
    """A bounded sample of labelled rows, by a hash of doc_id: what the models above are trained on."""
    known = labelled.where(F.col("category").isNotNull())
    h = F.xxhash64("doc_id")
    # numbers first, and rows for the chosen ones alone: each task would send the driver its own best rows, with all their terms
    chosen = sorted({r.h for r in known.select(h.alias("h"), "doc_id").orderBy("h", "doc_id").limit(most).collect()})
    rows = known.where(h.isin(chosen)).withColumn("_h", h).collect() if chosen else []
    return sorted(rows, key=lambda r: (r["_h"], r["doc_id"] is not None, r["doc_id"] or 0))[:most]


def apply_model(docs: DataFrame, model: DecisionTree | RandomForest | LinearModel) -> DataFrame:
    """docs: doc_id, terms. doc_id, category, probability. The model, of a bounded sample, goes to every executor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, c, p) for d, ts in zip(frame["doc_id"], frame["terms"]) for c, p in shared.value.predict(term_counts(ts)).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "category", "probability"])

    return docs.select("doc_id", "terms").mapInPandas(run, "doc_id long, category string, probability double")


def term_counts(terms) -> dict[str, float]:
    out: dict[str, float] = {}
    for t in terms:
        out[t] = out.get(t, 0.0) + 1.0
    return out


# dividing a corpus without labels


def divide(docs: DataFrame, profile: int = 64, depth: int = 4, least: float = 0.01, min_leaf: int = 2) -> DataFrame:
    """docs: doc_id, terms. doc_id, cluster (the answers on the way, as 0 and 1).

    Each level splits every cluster by the profile term that tells most: p (1 - p) times the mean, over the other profile
    terms, of the squared difference of their rates with and without it. A level is one job; the driver sees counts of pairs
    of profile terms.
    """
    terms = docs.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    total = docs.count()
    chosen = [r.t for r in terms.where(F.col("n").between(max(min_leaf, 0.02 * total), 0.9 * total)).orderBy(F.abs(F.col("n") / total - 0.5), "t").limit(profile).collect()]
    held = docs.select("doc_id", F.array_intersect(F.array_distinct("terms"), F.array(*map(F.lit, chosen)).cast("array<string>")).alias("has"), F.lit("").alias("cluster"))
    for _ in range(depth):
        sizes = {r.cluster: r["count"] for r in held.groupBy("cluster").count().collect()}
        pair = held.select("cluster", F.explode("has").alias("a"), "has").select("cluster", "a", F.explode("has").alias("b")).groupBy("cluster", "a", "b").agg(F.count("*").alias("n")).collect()
        counts: dict[str, np.ndarray] = {c: np.zeros((len(chosen), len(chosen))) for c in sizes}
        place = {t: i for i, t in enumerate(chosen)}
        for r in pair:
            counts[r.cluster][place[r.a], place[r.b]] = r.n
        split: dict[str, str] = {}
        for c, n in counts.items():
            have, size = np.diag(n), sizes[c]
            ok = (have >= min_leaf) & (size - have >= min_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                apart = (n / have[:, None] - (have[None, :] - n) / (size - have)[:, None]) ** 2
            np.fill_diagonal(apart, 0)
            p = have / size
            value = np.where(ok, p * (1 - p) * np.nan_to_num(apart).sum(1) / max(1, len(chosen) - 1), -1)
            if len(value) and value.max() >= least:
                split[c] = chosen[int(np.argmax(value))]
        if not split:
            break
        answer = F.lit("")
        for c, t in split.items():
            answer = F.when(F.col("cluster") == c, F.array_contains("has", t).cast("int").cast("string")).otherwise(answer)
        held = held.withColumn("cluster", F.concat("cluster", answer))
    return held.select("doc_id", "cluster")


# features


def text_features(docs: DataFrame, text: Column, prefix: str = "n:") -> DataFrame:
    """docs with features: the terms of a text, named apart by a prefix."""
    return docs.withColumn("features", F.transform(text, lambda t: F.concat(F.lit(prefix), t)))


def composite_features(*parts: Column) -> Column:
    """Features of several sources, one after the other."""
    return F.concat(*parts)


def masked_features(features: Column, prefixes: tuple[str, ...]) -> Column:
    """Without those of some sources."""
    return F.filter(features, lambda x: ~F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(x, p)))


def unknown_features(features: Column, known: Column, name: str = "unknown") -> Column:
    """Features outside known become one indicator."""
    kept = F.array_intersect(features, known)
    return F.when(F.size(kept) < F.size(F.array_distinct(features)), F.concat(kept, F.array(F.lit(name)))).otherwise(kept)


def class_specific(labelled: DataFrame, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, category, score, probability by presence of each category's telling terms: the sum of ln(in / out) over those that the document has."""
    told = telling_terms(labelled.select("category", "terms"), least).select("category", "term", F.log(F.col("inside") / F.col("outside")).alias("w"))
    have = docs.select("doc_id", F.explode(F.array_distinct("terms")).alias("term"))
    found = have.join(told, "term").groupBy("doc_id", "category").agg(F.sum("w").alias("w"))
    categories = labelled.select("category").distinct()
    # a row for each category
    grid = docs.select("doc_id").crossJoin(F.broadcast(categories))
    return softmax(grid.join(found, ["doc_id", "category"], "left").select("doc_id", "category", F.coalesce("w", F.lit(0.0)).alias("score")))


def calibrated(scored: DataFrame, steps: list[tuple[float, float]]) -> DataFrame:
    """probability of score by steps (from score, rate) of isotonic()."""
    p = F.lit(steps[0][1] if steps else 0.5)
    for s, rate in steps:
        p = F.when(F.col("score") >= s, rate).otherwise(p)
    return scored.withColumn("probability", p)
