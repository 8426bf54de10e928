import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import random

import numpy as np
import pytest

import helpers
from conftest import SF_MID
from quayside.llm import weakquality as wq

JUNK = ["BUY!! NOW!! CHEAP!! DEAL!! OFFER!! TODAY!!", "a### b*** c$$$ d&&& e%%% f###",
        "Home | About | News | Shop | Help | Terms", "go go go go go go go go stop stop stop"]


def corpus():
    rnd = random.Random(8)
    words = ["boat", "crate", "market", "light", "gull", "harbour", "wind", "rope", "sail"]
    rows = []
    for i in range(300):
        if i % 5 == 0:
            rows.append(helpers.row(1000 + i, " ".join(rnd.choice(JUNK) for _ in range(3))))
        else:
            rows.append(helpers.row(1000 + i, ". ".join(
                " ".join(rnd.choice(words) for _ in range(9)).capitalize() for _ in range(4)) + "."))
    return rows


def test_label_model_recovers_accuracies():
    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.4
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rnd.random((20_000, 4)) < right, np.where(truth, -1, 1)[:, None],
                     np.where(truth, 1, -1)[:, None])
    votes[rnd.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, accuracy = wq.label_model(patterns, counts.astype(float), belief=0.01)
    assert np.abs(accuracy - right).max() < 0.03
    where = {tuple(v): x for v, x in zip(patterns, p)}
    made = np.array([where[tuple(v)] for v in votes])
    assert ((made > 0.5) == truth)[made != 0.5].mean() > 0.93


def plain_ratios(text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, joined = max(1, len(words)), "".join(words)
    letters = sum(map(str.isalpha, joined))
    marked = [w[:-1] if w[-1] in ".,;:?!" else w for w in words]
    return [min(3, sum(c in "#*$%&<>" for c in joined) / n), min(3, joined.count("|") / n),
            min(3, joined.count("!") / n), sum(map(str.isalpha, marked)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            letters / max(1, len(joined)), sum(map(str.isupper, joined)) / max(1, letters)]


TEXTS = [helpers.PROSE, "", None, "a a", "a", " a a a\n\x0b", "B!! B!! É", *JUNK, "x y", "y x x"]


def test_word_tables_equal_plain_loops():
    import pyarrow as pa
    table = wq.WordTable(pa.array(TEXTS), {}, wq.word_counts)
    got = wq.ratios(table.sums(), table.echoes())
    assert np.allclose(got, [plain_ratios(t) for t in TEXTS])


def test_features_and_scorer_agree():
    import pyarrow as pa
    w = np.random.default_rng(0).normal(size=wq.WIDTH + 1)
    texts = pa.array(TEXTS)
    table = wq.WordTable(texts, {}, wq.word_counts)
    words = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, "")
                                              ).values.dictionary_encode().dictionary.to_pylist()
    pairs = [wq.word_buckets(x) if x else None for x in words]
    extra = wq.ratios(table.sums(), table.echoes())
    for i, p in enumerate(wq.Scorer(w).score(texts)):
        at, value = wq.features(table, pairs, i, extra[i])
        assert p == pytest.approx(1 / (1 + np.exp(-(w[at] * value).sum() - w[-1])))


def test_distinct_words_equal_plain_loops():
    import pyarrow as pa
    table = wq.WordTable(pa.array(TEXTS), {}, wq.word_counts)
    assert table.distinct().tolist() == [len(set((t or "").encode().split())) for t in TEXTS]


def loop(i):
    return " ".join([f"the quiet river{i} passes the old harbour"] * 12)


def test_loops_are_voted_junk_and_long_prose_is_not():
    import pyarrow as pa
    rnd = np.random.default_rng(4)
    # words by Zipf's law: many repeat, as in any long text
    long = " ".join("w" + "abcdefghij"[n % 10] * (1 + n // 10 % 9) + chr(97 + n % 26)
                    + "".join("abcdefghij"[int(d)] for d in str(n))
                    for n in np.minimum(rnd.zipf(1.3, 50_000), 10 ** 6).tolist())
    assert len(set(long.split())) < 0.3 * 50_000
    table = wq.WordTable(pa.array([helpers.PROSE, long, loop(1), "a b a b"]), {}, wq.word_counts)
    got = wq.votes(table.sums(), table.echoes(), table.distinct())
    assert got.min(axis=1).tolist() == [0, 0, -1, 0]
    assert got.max(axis=1).tolist() == [1, 1, 0, 1]


def test_loops_are_dropped(spark):
    rows = corpus() + [helpers.row(5000 + i, loop(i)) for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in wq.judge(helpers.docs(spark, rows)).collect()}
    assert not any(got[5000 + i] for i in range(30))
    assert all(got[1000 + i] for i in range(300) if i % 5)


def test_junk_goes_and_good_stays(spark):
    rows = corpus() + helpers.awkward()
    got = {r["doc_id"]: r["kept"] for r in wq.judge(helpers.docs(spark, rows)).collect()
           if r["doc_id"] is not None}
    assert not any(got[1000 + i] for i in range(0, 300, 5))
    assert all(got[1000 + i] for i in range(300) if i % 5)
    assert not got[4] and not got[5] and got[1]


def test_keep_good_keeps_the_columns_and_agrees(spark):
    docs = helpers.docs(spark, corpus() + helpers.awkward())
    out = wq.keep_good(docs)
    assert out.schema == docs.schema
    want = sorted(repr(r["doc_id"]) for r in wq.judge(docs).where("kept").collect())
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == want


def test_empty_and_uniform_tables(spark):
    assert wq.judge(helpers.empty(spark)).collect() == []
    assert wq.keep_good(helpers.empty(spark)).collect() == []
    same = wq.judge(helpers.docs(spark, [helpers.row(i, helpers.PROSE) for i in range(5)]))
    assert [r["kept"] for r in same.collect()] == [True] * 5


def test_accuracy_on_labelled_documents(spark):
    got = wq.judge(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    rows = got.join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
