"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order. Each category's logistic model sees how dense words and word beginnings are, the
shape of the text, and the log-odds of all earlier categories. For training, those earlier probabilities are out-of-fold predictions,
so a later model doesn't learn from probabilities that are better than they will be on new documents: features that tell a
category apart are chosen, and weights fitted, without the fold that is predicted. Any number of categories can be given;
the tables' labels have two marks, low quality and toxic, and the chain goes from the first to the second.

The models are fitted on at most `sample` labelled ids (those with the smallest hashes); everything else runs over all
documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenta.llm.common import col, durable, fresh, slices, widened
from lumenta.llm.decontam import words

SAMPLE, FEATURES, FOLDS, PREFIXES = 8000, 256, 4, (4, 5, 6)
#: z of a feature's two rates from which it is used, and the strength of the L2 penalty.
LEAST_Z, PENALTY = 5.0, 0.1
#: Words for one of which a feature counts in full; in longer texts it counts by the square root of its density.
SPAN = 50
CATEGORIES: dict[str, str] = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def beginnings(word: bytes) -> list[bytes]:
    """A word's features: itself, and its beginnings if it is longer, marked *."""
    return [word, *(b"*" + word[:k] for k in PREFIXES if len(word) > k)]


def shapes(text: bytes, every: Counter, n: int) -> list[bytes]:
    """Features of the shape of a text of n words, marked #."""
    size = len(text)
    upper = size - len(text.translate(None, bytes(range(65, 91))))
    odd = size - len(text.translate(None, b"|!$%&*#<>{}[]=_~^\\"))
    shares = ((b"distinct", len(every) / n), (b"upper", upper / size), (b"odd", odd / size), (b"top", max(every.values()) / n))
    return [b"#" + name + b"%d" % min(9, int(share * 10)) for name, share in shares]


def features(text: bytes | None, known: Known | None = None) -> tuple[dict[bytes, int], int]:
    """How often each feature is there (a shape as often as there are words), and the number of words. With known: only such features."""
    every = Counter(words(text))
    n, out = every.total(), Counter()
    for word, count in every.items():
        for f in beginnings(word) if known is None else known[word]:
            out[f] += count
    if n:
        out.update(dict.fromkeys(shapes(text, every, n), n))
    return out, n


class Known(dict):
    """For each word, those of its features that are in a vocabulary; most words have none. Grows up to MOST words."""

    MOST = 1 << 17

    def __init__(self, vocabulary: set[bytes]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) >= self.MOST:
            self.clear()
        own = self[word] = [f for f in beginnings(word) if f in self.vocabulary]
        return own


def value(count: int, n: int) -> float:
    return min(1.0, SPAN * count / max(n, SPAN)) ** 0.5


@dataclass
class Chain:
    """names in order; for each its features' weights and bias, and the weights of the earlier categories' log-odds."""

    names: list[str] = field(default_factory=list)
    weights: list[dict[bytes, float]] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)
    links: list[list[float]] = field(default_factory=list)

    def known(self) -> Known:
        return Known({f for own in self.weights for f in own})

    def probabilities(self, text: bytes | None, known: Known | None = None) -> list[float]:
        (own, n), odds = features(text, known), []
        for weights, bias, links in zip(self.weights, self.biases, self.links, strict=True):
            z = bias + sum(weights[f] * value(own[f], n) for f in sorted(own.keys() & weights.keys())) + sum(a * b for a, b in zip(links, odds, strict=True))
            odds.append(max(-8.0, min(8.0, z)))
        return [float(1 / (1 + np.exp(-z))) for z in odds]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 25) -> np.ndarray:
    """Weights and bias (last) of a logistic model with an L2 penalty on the weights, by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -8, 8)


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int) -> DataFrame:
    """(id, text, y_0, y_1, ...) of at most sample labelled ids, one row each. Labels without an id or a category's value don't count; of repeated labels, and of repeated documents, the first by value does."""
    marks = [F.expr(e).cast("int").alias(f"y_{k}") for k, e in enumerate(categories.values())]
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), *marks).dropna()
    rows = rows.groupBy("id").agg(F.min(F.struct(*[f"y_{k}" for k in range(len(marks))])).alias("y")).select("id", "y.*")
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(rows), "id")  # at most sample rows of a few integers
    return joined.groupBy("id", *[f"y_{k}" for k in range(len(marks))]).agg(F.min("text").alias("text")).select("id", "text", *[f"y_{k}" for k in range(len(marks))])


def _chosen(rows: DataFrame, k: int, folds: int, most: int) -> dict[tuple[int, int], list[bytes]]:
    """For each category and fold (and -1, for none) the features that tell the category apart in the other folds, the best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: Counter = Counter()
            for text, *y, fold in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                for j in (-1, *(j for j in range(k) if y[j])):
                    seen.update((f, fold, j) for f in features(text)[0])
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.binary()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.int32()), pa.array([seen[x] for x in keys], pa.int64())], names=["f", "fold", "j", "n"])

    totals = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(f"y_{j}").alias(f"n_{j}") for j in range(k))).collect()}
    own = lambda j, g: F.sum(F.when((F.col("j") == j) & (F.col("fold") != g), F.col("n")).otherwise(0))
    counts = rows.mapInArrow(count, "f binary, fold int, j int, n long").groupBy("f").agg(*(own(j, g).alias(f"n_{j}_{g}") for j in range(-1, k) for g in range(-1, folds)))
    scores = []
    for j in range(k):
        for g in range(-1, folds):
            n, n1 = (sum(r[name] for fold, r in totals.items() if fold != g) for name in ("n", f"n_{j}"))
            if 0 < n1 < n:
                every, mine = F.col(f"n_-1_{g}"), F.col(f"n_{j}_{g}")
                rate = every / n
                z = F.abs(mine / n1 - (every - mine) / (n - n1)) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / (n - n1)) + 1e-12)
                scores.append(F.struct(F.lit(j).alias("j"), F.lit(g).alias("g"), F.when(every >= 3, z).alias("z")))
    out: dict[tuple[int, int], list[bytes]] = {(j, g): [] for j in range(k) for g in range(-1, folds)}
    if scores:
        best = counts.select("f", F.explode(F.array(*scores)).alias("s")).select("f", "s.*").where(F.col("z") >= LEAST_Z)
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("j", "g").orderBy(F.col("z").desc(), "f"))).where(F.col("place") <= most)
        for r in sorted(best.collect(), key=lambda r: r.place):  # at most most features for each category and fold
            out[r.j, r.g].append(bytes(r.f))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE, most: int = FEATURES, folds: int = FOLDS) -> Chain:
    """A chain for categories (name: SQL condition over labels), in their order. Without labelled documents every probability is that of no evidence, 0.5 or less."""
    k = len(categories)
    rows = durable(labelled(docs, labels, categories, sample).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")))
    chosen = _chosen(rows, k, folds, most)
    vocabulary = {f: i for i, f in enumerate(sorted({f for own in chosen.values() for f in own}))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, values = [], []
            for own, n in map(features, batch.column(1).to_pylist()):
                here = sorted(own.keys() & vocabulary.keys())
                places.append([vocabulary[f] for f in here])
                values.append([value(own[f], n) for f in here])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), *batch.columns[2:]], names=["id", "x", "v", *batch.schema.names[2:]])

    # at most sample rows of at most most * k * (folds + 1) small numbers
    table = rows.mapInArrow(vectors, "id long, x array<int>, v array<double>, " + ", ".join(f"y_{j} int" for j in range(k)) + ", fold int").toArrow().sort_by("id")
    at, values = (np.concatenate([np.asarray(x, kind) for x in table[c].to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("x", np.int64), ("v", np.float64)))
    row = np.repeat(np.arange(table.num_rows), [len(x) for x in table["x"].to_pylist()])

    def dense(own: list[bytes]) -> np.ndarray:
        place, x = np.full(len(vocabulary) + 1, -1), np.zeros((table.num_rows, len(own)))
        place[[vocabulary[f] for f in own]] = np.arange(len(own))
        use = place[at] >= 0
        x[row[use], place[at[use]]] = values[use]
        return x

    def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if len(set(y.tolist())) == 2:
            return fit(x, y)
        rate = y.mean() if len(y) else 0.0
        return np.array([0.0] * x.shape[1] + [float(np.clip(np.log((rate + 1e-3) / (1 - rate + 1e-3)), -8, 0))])

    fold = table["fold"].to_numpy()
    chain, earlier = Chain(), np.zeros((table.num_rows, 0))
    for j, name in enumerate(categories):
        y, own = table[f"y_{j}"].to_numpy().astype(float), chosen[j, -1]
        w, out = fitted(np.hstack((dense(own), earlier)), y), np.zeros(table.num_rows)
        for f in range(folds):
            x, held = np.hstack((dense(chosen[j, f]), earlier)), fold == f
            if held.any():
                out[held] = odds(x[held], fitted(x[~held], y[~held]))
        chain.names.append(name)
        chain.weights.append(dict(zip(own, w[: len(own)].tolist(), strict=True)))
        chain.links.append(w[len(own) : -1].tolist())
        chain.biases.append(float(w[-1]))
        earlier = np.hstack((earlier, out[:, None]))
    return chain


def score_names(docs: DataFrame, chain: Chain) -> list[str]:
    """The names of the columns that scored() adds: __p_<category>, made longer where docs has such a column."""
    return [fresh(f"__p_{n}", docs) for n in chain.names]


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with a probability for each category (see score_names), for each row; null and empty texts score as a text without features."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    known: list[Known] = []  # one for each task: filled by its first texts

    def score(texts: list[bytes | None]) -> list[list[float]]:
        if not known:
            known.append(held.value.known())
        return [list(x) for x in zip(*(held.value.probabilities(t, known[0]) for t in texts), strict=True)] if texts else [[] for _ in held.value.names]

    return widened(docs, score, ["text"], [(n, "double") for n in score_names(docs, chain)])


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, p_<category> (6 digits), toxic for each row of docs."""
    chain, rows = train(docs, labels, **options), docs.select("doc_id", "text")
    names = score_names(rows, chain)
    return scored(rows, chain).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.round(c, 6).alias(f"p_{n}") for c, n in zip(names, chain.names, strict=True)), (F.col(names[-1]) >= threshold).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Rows of docs, with all their columns, that the last category's model doesn't reject."""
    chain = train(docs, labels, **options)
    return scored(docs, chain).where(col(score_names(docs, chain)[-1]) < threshold).select(*[col(c) for c in docs.columns])
