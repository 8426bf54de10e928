"""Quality classifier from weak labels.

Heuristic labellers vote junk, good or nothing on each document.  The votes of
all documents are counted by pattern (at most 2^labellers rows), and
expectation-maximisation on the counts estimates each labeller's accuracy.
The posterior of a document's vote pattern is its training label.  A linear
scorer on hashed features of words, word shapes and whole-text ratios is
trained on a bounded sample of documents with those labels (``sample_rows`` a class, chosen by a hash of the id) and
scores every document.

Defined cases: null and empty texts have no words; they are junk; documents
of one or a few words are judged like others (shortness alone is no vote);
repeated rows get equal scores; if the corpus is empty, or all votes agree
and the sample has one class, the scorer falls back to a constant, the
majority's label.  Only the id and text columns are read; ``keep_good`` passes
all others through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .tokens import slices

BUCKETS, SHAPES = 1 << 16, 4096
#: Whole-text ratios: all by word but the last two, by character and letter.
RATIOS = ("symbols", "bars", "shouts", "plain", "echoes", "letters", "upper")
WIDTH = BUCKETS + SHAPES + len(RATIOS) + 2      # and distinct share, "no word"
SLICE = 3_000_000   # characters of text worked on at a time
SYMBOLS = frozenset("#*$%&<>")
MARKS = frozenset(".,;:?!")


# --- texts as word tables --------------------------------------------------

def shape(word: str) -> str:
    """Letters by case, digits and the marks themselves, runs collapsed."""
    out = []
    for c in word[:64]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def word_buckets(word: str) -> tuple[int, int]:
    return (xxhash.xxh32_intdigest(word.lower()) % BUCKETS,
            BUCKETS + xxhash.xxh32_intdigest(shape(word), 1) % SHAPES)


def word_counts(word: str) -> tuple[int, ...]:
    """1, characters, letters, capitals, symbols, bars, exclamation marks, and
    whether it is letters with at most one common mark after them."""
    if not word:
        return (0,) * 8
    if word.isalpha() and word.islower():
        return (1, len(word), len(word), 0, 0, 0, 0, 1)
    bare = word[:-1] if word[-1] in MARKS else word
    return (1, len(word), sum(map(str.isalpha, word)), sum(map(str.isupper, word)),
            sum(c in SYMBOLS for c in word), word.count("|"), word.count("!"),
            int(bare.isalpha()))


class WordTable:
    """Words of texts, numbered by distinct word: ``at[ends[i-1]:ends[i]]``
    are the numbers of text i's words.  What is known of a word is looked up
    once per distinct word of a slice, and kept in ``cache``."""

    def __init__(self, texts: pa.Array, cache: dict, make, cache_entries: int = 200_000):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(texts)    # the six ASCII characters
        numbered = lists.values.dictionary_encode()
        self.at = numbered.indices.to_numpy()
        self.cuts = lists.offsets.to_numpy()
        known = []
        for w in numbered.dictionary.to_pylist():
            got = cache.get(w)
            if got is None:
                got = np.array(make(w), dtype=float).tobytes()
                if len(cache) < cache_entries:
                    cache[w] = got
            known.append(got)
        self.known = np.frombuffer(b"".join(known)).reshape(len(known), -1)

    def sums(self) -> np.ndarray:
        """Per text, the sums of what is known over its words."""
        run = np.zeros((len(self.at) + 1, self.known.shape[1]))
        np.cumsum(self.known[self.at], axis=0, out=run[1:])
        return run[self.cuts[1:]] - run[self.cuts[:-1]]

    def echoes(self) -> np.ndarray:
        """Per text, how many words repeat the one before."""
        same = np.zeros(len(self.at) + 1, dtype=np.int64)
        same[2:] = self.at[1:] == self.at[:-1]
        inside = self.cuts[:-1][self.cuts[:-1] < self.cuts[1:]]
        same[inside + 1] = 0    # a text's first word repeats none
        run = np.cumsum(same)
        return run[self.cuts[1:]] - run[self.cuts[:-1]]

    def distinct(self) -> np.ndarray:
        """Per text, how many distinct words it has."""
        place, last = np.arange(len(self.at)), np.zeros(len(self.known), dtype=np.int64)
        words, cuts = self.known[:, 0] > 0, self.cuts.tolist()
        out = np.zeros(len(cuts) - 1, dtype=np.int64)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part, order = self.at[a:b], place[a:b]
            last[part] = order      # of a word's places one stays
            out[i] = np.count_nonzero((last[part] == order) & words[part])
        return out


def ratios(sums: np.ndarray, echoes: np.ndarray) -> np.ndarray:
    """A row of RATIOS per text (those that can be large are held at 3)."""
    words, chars, letters, upper, symbols, bars, shouts, plain = sums[:, :8].T
    some = np.maximum(words, 1)
    return np.stack([np.minimum(symbols / some, 3), np.minimum(bars / some, 3),
                     np.minimum(shouts / some, 3), plain / some, echoes / some,
                     letters / np.maximum(chars, 1), upper / np.maximum(letters, 1)], axis=1)


# --- labellers -------------------------------------------------------------

def votes(sums: np.ndarray, echoes: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Per text and labeller: -1 junk, 1 good, 0 no vote.  The labellers
    overlap on purpose: empty, symbols, bars, shouts, capitals, letters,
    echoes, loops, prose, few marks.

    Texts of over 20 words loop if under 30 % of their words are distinct;
    that share falls with the length of any text, about as its root, so over
    1111 words it takes under ten times the root of their number."""
    words = sums[:, 0]
    symbols, bars, shouts, plain, echo, letters, upper = ratios(sums, echoes).T
    loops = (words > 20) & (distinct < np.minimum(0.3 * words, 10 * np.sqrt(words)))
    quiet = (upper < 0.3) & (echo < 0.1) & ~loops
    junk = [words == 0, symbols > 0.3, bars > 0.15, shouts > 0.3, (upper > 0.5) & (words > 3),
            (letters < 0.7) & (words > 0), (echo > 0.2) & (words > 3),
            loops]
    good = [(plain > 0.8) & quiet, (symbols + bars + shouts < 0.1) & (letters > 0.8) & quiet]
    return np.stack([*(-j.astype(np.int64) for j in junk), *(g.astype(np.int64) for g in good)],
                    axis=1)


def pattern(row: np.ndarray) -> str:
    return ",".join(map(str, row.tolist()))


# --- the label model -------------------------------------------------------

def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200,
                start: float = 0.9, belief: float = 0.1):
    """Posterior probability of junk for each vote pattern, and each
    labeller's accuracy.

    A labeller that votes is right with its own accuracy, and a document
    without votes says nothing; neither class is favoured beforehand.
    Expectation: a document's odds are the product of its voters' odds.
    Maximisation: an accuracy is the share of a labeller's votes that agree
    with the posteriors, with ``belief`` times as many votes at ``start``
    added, which keeps a lone labeller from drifting.  Repeated until the
    posteriors stand still.
    """
    accuracy = np.full(patterns.shape[1], start)
    p = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = -patterns @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        agree = (patterns < 0) * new[:, None] + (patterns > 0) * (1 - new)[:, None]
        given = (patterns != 0) * 1.0
        n = counts @ given
        accuracy = (counts @ agree + belief * n * start + 0.9) / (n * (1 + belief) + 1)
        accuracy = np.clip(accuracy, 0.01, 0.999)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, accuracy


# --- the scorer ------------------------------------------------------------

def features(table: WordTable, words: list[tuple[int, int]], i: int, extra: np.ndarray):
    """Hashed feature indices and values of text ``i``; word features share a
    total of 1 each for identity and shape."""
    at = table.at[table.cuts[i]:table.cuts[i + 1]]
    found: dict[int, float] = {}
    numbers = [u for u in at.tolist() if words[u] is not None]
    real = [words[u] for u in numbers]
    for pair in real:
        for b in pair:
            found[b] = found.get(b, 0.0) + 1 / len(real)
    for k, v in enumerate([*extra.tolist(), len(set(numbers)) / max(1, len(real)),
                           float(not real)]):
        found[BUCKETS + SHAPES + k] = v
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), float, len(found))


def fit_linear(rows: list[tuple], labels: np.ndarray, width: int, rounds: int = 300,
               l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse rows by accelerated gradient steps;
    labels may be probabilities.  The last weight is the intercept."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    col = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    w, ahead, momentum = np.zeros(width + 1), np.zeros(width + 1), 1.0
    norms = np.bincount(row, val * val, n)
    step = 4.0 / (norms.max(initial=0) + 1 + l2)
    for _ in range(rounds):
        z = np.bincount(row, val * ahead[col], n) + ahead[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        grad = np.append(np.bincount(col, val * gap[row], width), gap.sum())
        grad[:-1] += l2 * ahead[:-1]
        new = ahead - step * grad
        after = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = 3000, seed: int = 11) -> np.ndarray:
    """Weights of the scorer (positive: junk).  All documents' votes are
    counted; at most about ``sample_rows`` documents a class are collected as
    hashed features."""
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    base = docs.select(draw.alias("draw"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            found: dict[str, int] = {}
            for a, b in slices(batch.column(0), size=SLICE):
                table = WordTable(batch.column(0).slice(a, b - a), cache, word_counts)
                rows, n = np.unique(votes(table.sums(), table.echoes(), table.distinct()),
                                    axis=0, return_counts=True)
                for row, k in zip(rows, n.tolist()):
                    found[pattern(row)] = found.get(pattern(row), 0) + k
            yield pa.RecordBatch.from_pydict(
                {"votes": pa.array(found, pa.string()),
                 "n": pa.array(found.values(), pa.int64())})

    counted = (base.select("text").mapInArrow(count, "votes string, n long").groupBy("votes")
               .agg(F.sum("n").alias("n")).collect())    # one row per vote pattern
    constant = np.zeros(WIDTH + 1)
    if not counted:
        constant[-1] = -1.0
        return constant
    counted.sort(key=lambda r: r["votes"])
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in counted])
    counts = np.array([r["n"] for r in counted], dtype=float)
    junk, _ = label_model(patterns, counts)
    known = {r["votes"]: p for r, p in zip(counted, junk) if p != 0.5}
    # a class's documents are sampled at a rate set by its size; those without
    # a vote are no training rows
    sizes = {c: counts[(junk > 0.5) == c].sum() for c in (True, False)}
    rates = {k: min(1.0, sample_rows / sizes[bool(p > 0.5)]) for k, p in known.items()}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            out = []
            drawn = batch.column(0).to_numpy()
            texts = batch.column(1)
            for a, b in slices(texts, size=SLICE):
                part = texts.slice(a, b - a)
                table = WordTable(part, cache, lambda w: (
                    *word_counts(w), *(word_buckets(w) if w else (-1, -1))))
                pairs = [(int(r[8]), int(r[9])) if r[8] >= 0 else None for r in table.known]
                sums, echoes = table.sums(), table.echoes()
                extra = ratios(sums, echoes)
                for i, row in enumerate(votes(sums, echoes, table.distinct())):
                    if drawn[a + i] < rates.get(pattern(row), 0.0):
                        out.append((pattern(row), *features(table, pairs, i, extra[i])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.list_(pa.int64())),
                 pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=["votes", "at", "value"])

    chosen = base.where(F.col("draw") < max(rates.values(), default=0.0)).mapInArrow(
        extract, "votes string, at array<long>, value array<double>").collect()
    chosen.sort(key=lambda r: (r["votes"], r["at"], r["value"]))  # the order does not matter then
    labels = np.array([known[r["votes"]] for r in chosen])
    if len(chosen) == 0 or (labels > 0.5).all() or (labels <= 0.5).all():
        constant[-1] = 1.0 if np.dot(junk, counts) > counts.sum() / 2 else -1.0
        return constant
    rows = [(np.array(r["at"]), np.array(r["value"])) for r in chosen]
    return fit_linear(rows, labels, WIDTH)


class Scorer:
    """Scores texts with the trained weights; a word's weights are looked up
    once per distinct word of a slice."""

    def __init__(self, weights: np.ndarray):
        self.w, self.cache = weights, {}

    def _word(self, word: str) -> tuple:
        weight = sum(self.w[b] for b in word_buckets(word)) if word else 0.0
        return (*word_counts(word), weight)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of junk of each text."""
        out = [np.zeros(0)]
        for a, b in slices(texts, size=SLICE):
            table = WordTable(texts.slice(a, b - a), self.cache, self._word)
            sums, echoes = table.sums(), table.echoes()
            z = sums[:, 8] / np.maximum(sums[:, 0], 1) + self.w[-1]
            z += ratios(sums, echoes) @ self.w[BUCKETS + SHAPES:WIDTH - 2]
            z += table.distinct() / np.maximum(sums[:, 0], 1) * self.w[WIDTH - 2]
            z += (sums[:, 0] == 0) * self.w[WIDTH - 1]
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = 3000, threshold: float = 0.6) -> DataFrame:
    """Per row: doc_id, p_junk, kept (p_junk is at most the threshold)."""
    weights = docs.sparkSession.sparkContext.broadcast(
        train(docs, id_col, text_col, sample_rows))    # WIDTH + 1 doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.score(batch.column(1)))],
                names=["doc_id", "p_junk"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, p_junk double").withColumn(
        "kept", F.col("p_junk") <= threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sample_rows: int = 3000, threshold: float = 0.6) -> DataFrame:
    """``docs`` without the rows that the scorer rejects."""
    weights = docs.sparkSession.sparkContext.broadcast(
        train(docs, id_col, text_col, sample_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(at)) <= threshold))

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
