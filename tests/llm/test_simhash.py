import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import itertools
import random

import numpy as np
import pytest
import xxhash

import helpers
from quayside.llm import simhash


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in (None, "", "one", "One TWO", "a b c", "A b C d É É É É É", helpers.PROSE, "x " * 50):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_long_texts_are_counted_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius, bits=12, deal=1)
    assert len(masks) == 2 ** (radius + 1) - 1
    for r in range(radius + 1):
        for bits in itertools.combinations(range(12), r):
            differ = sum(1 << b for b in bits)
            assert any(m & differ == 0 for m in masks)
    for b in range(12):     # and every position counts in some table
        assert any(m >> b & 1 for m in masks)


def slow_components(values, radius):
    label = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
            old = label[j]
            label = [label[i] if x == old else x for x in label]
    groups = {}
    for v, x in zip(values, label):
        groups.setdefault(x, set()).add(v)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("limit,levels", [(1024, 4), (4, 4), (4, 1)])
def test_links_join_what_brute_force_joins(spark, limit, levels):
    rnd = random.Random(7)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values)[:12]:     # chains and dense clusters
        for _ in range(12):
            v ^= 1 << rnd.randrange(64)
            values.add(v)
    values |= {rnd.getrandbits(7) for _ in range(60)} | {0, 2 ** 64 - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.covering_links(fps, 3, limit, levels)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    groups = {}
    for v in signed:
        groups.setdefault(root.get(v, v), set()).add(v % (1 << 64))
    assert sorted(sorted(g) for g in groups.values()) == slow_components(sorted(values), 3)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)],
                                  "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_awkward_rows(spark):
    rows = simhash.near_copies(helpers.docs(spark)).collect()
    assert len(rows) == len(helpers.awkward())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["component_id"] == by_id[2][0]["component_id"] == 1
    assert {r["component_id"] for r in by_id[None]} == {1, 4}
    for i in (4, 5, 6):     # no words: fingerprint zero
        assert by_id[i][0]["fp"] == 0 and by_id[i][0]["component_id"] == 4
    assert by_id[13][0]["component_id"] == 12
    assert [r["component_id"] for r in by_id[8]] == [8, 8]


def test_one_row_of_each_component_stays(spark):
    docs = helpers.docs(spark)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in simhash.near_copies(docs).collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    assert simhash.near_copies(helpers.empty(spark)).collect() == []
    assert simhash.drop_near_copies(helpers.empty(spark)).collect() == []
