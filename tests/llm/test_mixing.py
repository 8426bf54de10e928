import sys, os
sys.path.insert(0, os.path.dirname(__file__))

from collections import Counter, defaultdict

import pytest

import helpers
from quayside.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Reshare the excess round by round until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s] - 1e-9]
        if not over:
            return {**fixed, **target}
        fixed.update({s: cap * sizes[s] for s in over})


def size(text):
    return len((text or "").encode().split())


def check(rows, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r[3]] += size(r[1])
    target = waterfill(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert n == int(target[s] + 1e-6)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(
        (r[0], size(r[1])) for r in docs)


def sample():
    return [helpers.row(i, " ".join(["w"] * (i % 17)), source=f"s{min(i % 7, 3)}")
            for i in range(400)] + helpers.awkward()


def test_shares_equal_brute_force(spark):
    docs = sample()
    rows = mixing.shares(helpers.docs(spark, docs)).collect()
    check(rows, docs)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = sample()
    a, b = (sorted(map(tuple, mixing.shares(helpers.docs(spark, docs).repartition(n)).collect()),
                   key=repr) for n in (2, 5))
    assert a == b


def test_slices_of_any_size_give_the_same_cut(spark):
    docs = sample()
    a, b = (sorted(map(tuple, mixing.shares(helpers.docs(spark, docs), slice_rows=n).collect()),
                   key=repr) for n in (1, 1000))
    assert a == b


def test_mix_takes_the_words_and_keeps_the_columns(spark):
    docs = helpers.docs(spark, sample())
    out = mixing.mix(docs, n_chars_col="n_chars")
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["source"]] += size(r["text"])
        assert r["text"] is not None and size(r["text"]) > 0
    want = defaultdict(int)
    for r in mixing.shares(docs).collect():
        want[r["source"]] += r["taken"]
    assert got == {s: n for s, n in want.items() if n}


def test_empty_table(spark):
    assert mixing.shares(helpers.empty(spark)).collect() == []
    assert mixing.mix(helpers.empty(spark)).collect() == []


def test_sources_without_words(spark):
    rows = mixing.shares(helpers.docs(spark, [helpers.row(1, ""), helpers.row(2, None)])).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0), (0.0, 0)]


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(helpers.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
