import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import helpers
from conftest import SF_SMALL
from quayside.llm import queries, slack
from quayside.llm.tokens import default_tokenizer


def brute_fullest(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=14), st.integers(0, 100))
def test_fullest_combination_equals_all_subsets(lengths, room):
    counts = [0] * 101
    for n in lengths:
        counts[n] += 1
    chosen = slack.fullest(sorted(set(lengths)), counts, room)
    assert sum(chosen) == brute_fullest(lengths, room)
    assert not Counter(chosen) - Counter(lengths)


def slow_pack(lengths, capacity):
    """Fill of each window: the longest piece and the best subset beside it."""
    left, fills = sorted(lengths), []
    while left:
        first = left.pop()
        best = brute_fullest(left, capacity - first)
        counts = Counter(left)
        used = slack.fullest(sorted(counts), [counts[n] for n in range(capacity + 1)],
                             capacity - first)
        assert sum(used) == best
        for n in used:
            left.remove(n)
        fills.append(first + best)
    return fills


def test_windows_are_filled_as_by_brute_force():
    rnd = random.Random(2)
    for _ in range(40):
        lengths = [rnd.randint(1, 100) for _ in range(rnd.randint(0, 60))]
        window, offset, room = slack.minimum_slack(lengths, 100)
        per = defaultdict(list)
        for w, o, n in zip(window.tolist(), offset.tolist(), lengths):
            per[w].append((o, n))
        for w, parts in per.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert room[w] == 100 - at
        assert [100 - r for r in room] == slow_pack(lengths, 100)


def expected(docs, window, end):
    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for d, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, tuple(ids[a:b])] += 1
    return want


def check(rows, docs, window, end=0):
    got, per = Counter(), defaultdict(list)
    for r in rows:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] <= window
        got[r["doc_id"], r["piece"], r["start"], ids] += 1
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected(docs, window, end)
    for parts in per.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    return len(per)


@pytest.mark.parametrize("window,group_rows", [(64, 8), (2048, 4096), (7, 3)])
def test_every_id_is_packed_once(spark, window, group_rows):
    rows = slack.pack(helpers.docs(spark), window=window, group_rows=group_rows).collect()
    check(rows, [(r[0], r[1]) for r in helpers.awkward()], window)


def test_few_windows_whatever_the_groups(spark):
    """Small groups over several tasks waste less than one window in a
    hundred: their open windows are packed again together."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = slack.pack(docs.repartition(5), window=512, group_rows=16).collect()
    used = check(rows, pairs, 512)
    least = -(-sum(r["length"] for r in rows) // 512)
    assert used <= 1.01 * least + 1


def test_a_third_of_rows_alike(spark):
    rows = [helpers.row(None, "same text here") for _ in range(300)]
    rows += [helpers.row(i, "word " * (i % 50)) for i in range(600)]
    got = slack.pack(helpers.docs(spark, rows).repartition(6), window=100, group_rows=32).collect()
    used = check(got, [(r[0], r[1]) for r in rows], 100)
    assert used <= 1.01 * -(-sum(r["length"] for r in got) // 100) + 1


def test_rounds_end_when_lengths_leave_room(spark):
    """Pieces over half a window never share one; the rounds still end."""
    rows = [helpers.row(i, "word " * 60) for i in range(100)]
    got = slack.pack(helpers.docs(spark, rows), window=100, group_rows=8).collect()
    assert len({r["sequence_id"] for r in got}) == 100


def test_empty_table(spark):
    assert slack.pack(helpers.empty(spark)).collect() == []


def test_query_equals_the_operator(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = queries.op13_minimum_slack(spark, SF_SMALL).collect()
    want = Counter((d, k, a, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                   for (d, k, a, ids), n in expected(
                       [(r["doc_id"], r["text"]) for r in docs.collect()], 2048, 0).items()
                   for _ in range(n))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in got) == want
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 2048) + 1
