import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import helpers
from conftest import SF_MID
from quayside.llm import toxicity as tx

LABELS = "doc_id long, toxic int, quality int, key string"


def test_each_model_sees_the_earlier_categories_out_of_fold():
    rnd = np.random.default_rng(2)
    n = 600
    first = rnd.random(n) < 0.4
    # the feature of the first category shows it, the last category is the
    # first one again and has no feature of its own
    rows = [np.array([1 if f else 2], np.int32) for f in first]
    labels = {"insult": first.astype(int), "contempt": np.zeros(n, int),
              "toxic": first.astype(int)}
    chain = tx.fit_chain(rows, labels, np.arange(n) % 5)
    assert [len(m.earlier) for m in chain] == [0, 1, 2]
    blind = tx.Link({}, chain[2].earlier, chain[2].intercept)
    assert tx.link_probability(blind, [], [0.99, 0.01]) > tx.link_probability(
        blind, [], [0.01, 0.01])


def test_constant_labels_give_the_rate():
    link = tx.fit_link([np.array([1], np.int32)] * 4, np.zeros(4, int), np.zeros((4, 0)))
    assert tx.link_probability(link, [1], []) == pytest.approx(1e-3)


def tables(spark, extra=()):
    docs, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        docs.append(helpers.row(i + 100, f"{helpers.PROSE} number {i % 7} "
                                + ("you pathetic idiot" if bad else "my friend")))
        labels.append((i + 100, int(bad), 1, "x"))
    return (helpers.docs(spark, docs + helpers.awkward()),
            spark.createDataFrame([*labels, *extra], LABELS))


def test_toxic_rows_are_found(spark):
    docs, labels = tables(spark, [(None, 1, 1, ""), (103, None, 0, ""), (104, 0, 1, "")])
    got = {r["doc_id"]: r for r in tx.judge(docs, labels).collect() if r["doc_id"] is not None}
    for i in range(200):
        assert got[i + 100]["toxic"] == (i % 4 == 0)
    assert not any(got[r[0]]["toxic"] for r in helpers.awkward() if r[0] is not None)
    assert got[100]["p_insult"] > 0.5 > got[101]["p_insult"]


def test_without_labels(spark):
    docs, labels = tables(spark)
    rows = tx.judge(docs, labels.limit(0)).collect()
    assert len(rows) == 200 + len(helpers.awkward()) and not any(r["toxic"] for r in rows)
    assert tx.judge(helpers.empty(spark), labels).collect() == []


def test_training_order_does_not_matter(spark):
    docs, labels = tables(spark)
    a, b = (sorted((repr(r["doc_id"]), r["p_toxic"]) for r in
                   tx.judge(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 4))
    assert a == b


def held_out(spark, folder, parity):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"),
                                                                  "doc_id", "left_semi")
    got = tx.judge(docs, labels.where(f"doc_id % 2 = {parity}"))
    rows = got.join(labels.where(f"doc_id % 2 <> {parity}").select(
        "doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    found, clean = ([r["toxic"] for r in rows if r["label"] == y] for y in (1, 0))
    return sum(found) / len(found), sum(clean) / len(clean)


def test_unseen_toxic_texts_are_found_in_all_languages(spark):
    for parity in (0, 1):
        recall, alarms = held_out(spark, "/root/testdata/sf0.1", parity)
        assert recall >= 0.9 and alarms <= 0.02


def test_few_labels_find_most(spark):
    recall, alarms = held_out(spark, SF_MID, 0)
    assert recall >= 0.6 and alarms <= 0.03


def test_sample_is_bounded_after_the_join(spark):
    """Thousands of rows of one labelled id bring no more than the sample."""
    docs = [helpers.row(1, f"{helpers.PROSE} {i}") for i in range(3000)]
    docs += [helpers.row(2, "you pathetic idiot") for _ in range(2000)]
    labels = spark.createDataFrame([(1, 0, 1, ""), (2, 1, 1, "")], LABELS)
    rows, by_name, fold = tx.training_rows(helpers.docs(spark, docs), labels, "doc_id", "text",
                                           "toxic", 10, 5, 5)
    assert len(rows) == len(fold) == 11 and by_name["toxic"].sum() == 1


def test_seeds_are_expanded_by_association():
    rnd = np.random.default_rng(3)
    kind = np.arange(90) % 3                     # 0 clean, 1 toxic with a seed, 2 without
    rows = [np.unique(np.concatenate([rnd.integers(100, 4000, 20),
                                      [1, 2, 3, 4] if k else []])).astype(np.int32) for k in kind]
    got = tx.expanded(rows, (kind == 1).astype(int), (kind > 0).astype(int))
    assert got.tolist() == (kind > 0).astype(int).tolist()
    lone = [r if k != 2 else np.array([9], np.int32) for r, k in zip(rows, kind)]
    assert tx.expanded(lone, (kind == 1).astype(int), (kind > 0).astype(int)).tolist() == (
        kind == 1).astype(int).tolist()


def slow_features(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    parts = [p for w in words for p in [w, *[f"{w[:n]}~" for n in range(4, 10) if len(w) >= n]]]
    buckets = [xxhash.xxh32(p.encode()).intdigest() % (1 << 22) for p in parts]
    return sorted({b * 3 + m for b in set(buckets) for m in range(min(3, buckets.count(b)))})


def test_chain_equals_brute_force(spark):
    """The whole verdict against dense sums over the same links."""
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in tx.judge(docs, labels).collect() if r["doc_id"] is not None}
    rows, by_name, fold = tx.training_rows(docs, labels, "doc_id", "text", "toxic", 2000, 5, 5)
    texts = {r["text"] for r in docs.where("doc_id BETWEEN 100 AND 299").collect()}
    assert sorted(r.tolist() for r in rows) == sorted(slow_features(t) for t in texts)
    earlier, chain = np.zeros((len(rows), 0)), []
    for name in tx.CHAIN:
        chain.append(tx.fit_link(rows, by_name[name], earlier))
        unseen = np.zeros(len(rows))
        for f in range(5):
            inside = np.flatnonzero(fold != f)
            part = tx.fit_link([rows[i] for i in inside], by_name[name][inside], earlier[inside])
            for i in np.flatnonzero(fold == f):
                z = part.intercept + sum(part.weights.get(int(x), 0.0) for x in rows[i])
                p = np.clip(earlier[i], 1e-3, 1 - 1e-3)
                unseen[i] = 1 / (1 + np.exp(-z - (part.earlier * np.log(p / (1 - p))).sum()))
        earlier = np.column_stack([earlier, unseen])
    for d in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        found, out = slow_features(d["text"]), []
        for link in chain:
            p = np.clip(np.array(out), 1e-3, 1 - 1e-3)
            z = link.intercept + sum(link.weights.get(x, 0.0) for x in found)
            out.append(float(1 / (1 + np.exp(-z - (link.earlier * np.log(p / (1 - p))).sum()))))
        mine = got[d["doc_id"]]
        assert np.allclose([mine[f"p_{n}"] for n in tx.CHAIN], out, atol=1e-9)
        assert mine["toxic"] == (out[-1] > 0.2)
