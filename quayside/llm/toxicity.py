"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the
document's hashed features and the probabilities of the categories before it.
In training those earlier probabilities are out-of-fold predictions (the rows
are cut into ``folds`` by a hash of their text, so equal texts share a fold),
as a model's own training rows would make them look better than they are.

The chain's default order is insult, contempt, toxic.  Toxic is the given
label.  A toxic training row is an insult or contempt if it has one of that
category's seed words, or enough of the features that go with the rows that
have (``expanded``); the models learn from all words.  Features are a text's
lower-case words and their beginnings of 4 to 9 letters, so inflected forms
count too, each as found at least once, twice and three times.  A model reads
the features that speak for its category (support and log-odds on its own
training rows); their number is bounded by the sample alone.

Training reads a bounded sample, at most ``sample_rows`` distinct labelled
texts a class, by a hash of the text; everything else covers all rows.

Defined cases: null and empty texts have no features and get the models'
base rate; label rows with a null id or null label are not used, and of
repeated ones the largest label counts; without labelled rows of both classes
all probabilities are the observed rate (0 without rows); repeated rows get
equal scores.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .weakquality import fit_linear

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
TIMES = 3

# fixed values: seed words of the categories that the labels do not name
SEEDS = {
    "insult": ("idiot", "stupid", "moron", "clown", "loser", "fool", "dumb"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth"),
}
CHAIN = ("insult", "contempt", "toxic")


def word_buckets(word: str) -> list[int]:
    """The hashed word and its beginnings."""
    parts = [word, *(f"{word[:n]}~" for n in range(4, 10) if len(word) >= n)]
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


def words_of(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def features_of(words: Counter) -> np.ndarray:
    """A feature for each bucket and each number of times (up to TIMES) that
    it is found at least."""
    found: dict[int, int] = {}
    for w, n in words.items():
        for b in word_buckets(w):
            found[b] = found.get(b, 0) + n
    return np.array(sorted(b * TIMES + m for b, n in found.items() for m in range(min(n, TIMES))),
                    np.int32)


class Link(NamedTuple):
    """One model of the chain: weights by feature, of the logits of the
    categories before it, and an intercept."""
    weights: dict[int, float]
    earlier: np.ndarray
    intercept: float


def _informative(rows: list[np.ndarray], labels: np.ndarray, support: int,
                 log_odds: float) -> np.ndarray:
    """Features of enough positive rows that are far more common there."""
    def counted(chosen):
        got = [rows[i] for i in np.flatnonzero(chosen)]
        return np.unique(np.concatenate(got), return_counts=True) if got else (
            np.zeros(0, np.int64),) * 2
    feature, there = counted(labels == 1)
    feature, there = feature[there >= support], there[there >= support]
    other, count = counted(labels == 0)
    where = np.searchsorted(other, feature)
    found = (where < len(other)) & (other[np.minimum(where, max(0, len(other) - 1))] == feature
                                    if len(other) else np.zeros(len(feature), bool))
    elsewhere = np.where(found, count[np.minimum(where, max(0, len(other) - 1))], 0) \
        if len(other) else np.zeros(len(feature))
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    odds = np.log((there + 0.5) / n1) - np.log((elsewhere + 0.5) / n0)
    return feature[odds >= log_odds]


def expanded(rows: list[np.ndarray], hits: np.ndarray, toxic: np.ndarray,
             log_odds: float = 2.5) -> np.ndarray:
    """A category's labels, taken from rows with a seed word to the toxic rows
    like them: those with at least half as many features that go with the
    category (against rows that are not toxic) as its rows have at the median."""
    if not hits.any() or toxic.all():
        return hits
    near = (hits == 1) | (toxic == 0)
    chosen = _informative([rows[i] for i in np.flatnonzero(near)], hits[near],
                          max(3, int(hits.sum()) // 250), log_odds)
    found = np.array([np.isin(r, chosen, assume_unique=True).sum() for r in rows])
    enough = max(1.0, float(np.median(found[hits == 1])) / 2)
    return np.where((toxic == 1) & (found >= enough), 1, hits)


def _logit(p):
    return np.log(p / (1 - p))


def _clip(p):
    return np.clip(p, 1e-3, 1 - 1e-3)


def fit_link(rows: list[np.ndarray], labels: np.ndarray, earlier: np.ndarray,
             support: int | None = None, log_odds: float = 2.5) -> Link:
    """Fit one model; ``earlier`` has a column of probabilities per category
    before it.  ``support`` is the least number of positive rows a feature is
    found in: by default 3, or one in 250."""
    rate = float(_clip(labels.mean())) if len(labels) else 1e-3
    if len(labels) == 0 or labels.min() == labels.max():
        return Link({}, np.zeros(earlier.shape[1]), float(_logit(rate)))
    chosen = _informative(rows, labels, support or max(3, int(labels.sum()) // 250), log_odds)
    n = earlier.shape[1]
    logits = _logit(_clip(earlier)) / 4
    sparse = []
    for r, before in zip(rows, logits):
        at = np.flatnonzero(np.isin(chosen, r, assume_unique=True))
        sparse.append((np.concatenate([at, len(chosen) + np.arange(n)]),
                       np.concatenate([np.ones(len(at)), before])))
    w = fit_linear(sparse, labels.astype(float), len(chosen) + n, rounds=300, l2=2e-4)
    return Link(dict(zip(chosen.tolist(), w[:len(chosen)].tolist())),
                w[len(chosen):-1] / 4, float(w[-1]))


def link_probability(link: Link, features, earlier) -> float:
    z = link.intercept + sum(link.weights.get(f, 0.0) for f in features)
    if len(link.earlier):
        z += float(np.dot(link.earlier, _logit(_clip(np.asarray(earlier)))))
    return float(1 / (1 + np.exp(-min(500.0, max(-500.0, z)))))


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray,
              chain=CHAIN) -> list[Link]:
    """The chain's models, each trained on out-of-fold earlier probabilities."""
    models, earlier = [], np.zeros((len(rows), 0))
    for name in chain:
        y = labels[name]
        models.append(fit_link(rows, y, earlier))
        if name == chain[-1]:
            break
        unseen = np.zeros(len(rows))
        for f in np.unique(fold):
            inside = np.flatnonzero(fold != f)
            part = fit_link([rows[i] for i in inside], y[inside], earlier[inside])
            for i in np.flatnonzero(fold == f):
                unseen[i] = link_probability(part, rows[i].tolist(), earlier[i])
        earlier = np.column_stack([earlier, unseen])
    return models


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                  label_col: str, sample_rows: int, folds: int, seed: int):
    """Features, labels by category and folds of the sampled labelled texts."""
    known = (labels.select(F.col(id_col).cast("long").alias("i"),
                           F.col(label_col).cast("int").alias("y"))
             .where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"),
                        F.xxhash64(text_col).alias("h"))
    found = texts.select("i", "h").join(known, "i").select(
        F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), "h").distinct()
    spark = docs.sparkSession
    # at most sample_rows hashes a class: small enough to broadcast at any size
    drawn = [(y, r["h"]) for y in (0, 1) for r in found.where(F.col("y") == y).orderBy(
        F.xxhash64("h", F.lit(seed)), "h").limit(sample_rows).collect()]
    chosen = F.broadcast(spark.createDataFrame(drawn, "y int, h long"))
    names = [n for n in CHAIN if n in SEEDS]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats, hits, fold = [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                words = words_of(t)
                feats.append(features_of(words).tobytes())
                hits.append([int(not words.keys().isdisjoint(SEEDS[n])) for n in names])
                fold.append(xxhash.xxh32_intdigest(t) % folds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(feats, pa.binary()),
                 pa.array(hits, pa.list_(pa.int32())), pa.array(fold, pa.int32())],
                names=["y", "features", "hits", "fold"])

    # copies of a text are one training row
    got = (texts.join(chosen, "h").groupBy("y", "h").agg(F.first("t").alias("t")).select("y", "t")
           .mapInArrow(extract, "y int, features binary, hits array<int>, fold int").collect())
    # the order of rows does not matter then: what is equal in all is alike
    got.sort(key=lambda r: (r["features"], r["y"], r["fold"], r["hits"]))
    rows = [np.frombuffer(r["features"], np.int32) for r in got]
    y = np.array([r["y"] for r in got], dtype=np.int64)
    by_name = {n: expanded(rows, np.array([r["hits"][k] for r in got], dtype=np.int64) * y, y)
               for k, n in enumerate(names)}
    return rows, {**by_name, "toxic": y}, np.array([r["fold"] for r in got], dtype=np.int64)


class ChainScorer:
    """Applies a fitted chain; the buckets that a model reads are looked up
    once per word and worker."""

    def __init__(self, models: list[Link], cache_entries: int = 400_000):
        self.models, self.cache, self.cache_entries = models, {}, cache_entries
        self.used = {f // TIMES for m in models for f in m.weights}

    def score(self, text: str | None) -> list[float]:
        found: dict[int, int] = {}
        for w, n in words_of(text).items():
            got = self.cache.get(w)
            if got is None:
                got = tuple(b for b in word_buckets(w) if b in self.used)
                if len(self.cache) < self.cache_entries:
                    self.cache[w] = got
            for b in got:
                found[b] = found.get(b, 0) + n
        out: list[float] = []
        ordered = sorted(b * TIMES + m for b, n in found.items() for m in range(min(n, TIMES)))
        for m in self.models:
            out.append(link_probability(m, ordered, out))
        return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = 2000, folds: int = 5, seed: int = 5,
          threshold: float = 0.2) -> DataFrame:
    """Per row: doc_id, a probability ``p_<category>`` for each category of the
    chain, and toxic (the last one is over the threshold, which is low: toxic
    rows are few, and one missed costs more than one too many)."""
    rows, by_name, fold = training_rows(docs, labels, id_col, text_col, label_col,
                                        sample_rows, folds, seed)
    # a few thousand weights a model
    models = docs.sparkSession.sparkContext.broadcast(fit_chain(rows, by_name, fold))
    names = [f"p_{n}" for n in CHAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ChainScorer(models.value)
        for batch in batches:
            p = np.array([scorer.score(t.as_py()) for t in batch.column(1)],
                         dtype=float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in p.T)], names=["doc_id", *names])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("toxic", F.col(names[-1]) > threshold)
