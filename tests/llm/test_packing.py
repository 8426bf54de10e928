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
from quayside.llm import packing
from quayside.llm.tokens import Encoder, default_tokenizer


def reference_ids(texts):
    tok = Tokenizer.from_file(default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer(), cache_entries=500)


def test_cached_encoding_equals_the_library(encoder):
    rnd = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "é", ".", "!!", "'s", "12", " ",
             "　", "\0", "<|endoftext|>", "\x1c", "²", "漢", "́", "\r\n", "\x85"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    got = encoder.encode([*texts, None, helpers.LONG])
    for t, a, b in zip([*texts, None, helpers.LONG], got,
                       reference_ids([*texts, None, helpers.LONG])):
        assert np.frombuffer(a, "<u4").tolist() == b, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_cached_encoding_of_any_text(texts):
    enc = _shared()
    assert [np.frombuffer(a, "<u4").tolist() for a in enc.encode(texts)] == reference_ids(texts)


_ENC = []


def _shared():
    if not _ENC:
        _ENC.append(Encoder(default_tokenizer()))
    return _ENC[0]


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            best = min(fits, key=lambda i: rooms[i])
            rooms[best] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_decreasing_equals_a_linear_search():
    rnd = random.Random(4)
    for _ in range(40):
        lengths = [rnd.randint(1, 99) for _ in range(rnd.randint(0, 120))]
        window, offset = packing.best_fit_decreasing(lengths, 100)
        rooms = Counter()
        for w, n in zip(window.tolist(), lengths):
            rooms[w] += n
        assert sorted(100 - v for v in rooms.values()) == slow_best_fit(lengths, 100)
        for w in rooms:
            at = 0
            for o, n in sorted((o, n) for x, o, n in zip(window, offset, lengths) if x == w):
                assert o == at
                at += n
            assert at <= 100


def check_pack(rows, docs, window):
    ids = {}
    per = defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    want = Counter()
    for d, text in docs:
        full = reference_ids([text])[0] + [1]
        for s in range(0, len(full), window):
            want[d, s, tuple(full[s:s + window]), len(full)] += 1
    got = Counter((r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()),
                   r["doc_tokens"]) for r in rows)
    assert got == want
    return ids


def test_pack_places_every_id_once(spark):
    rows = packing.pack(helpers.docs(spark), window=64, group_rows=8).collect()
    check_pack(rows, [(r[0], r[1]) for r in helpers.awkward()], 64)


def test_pack_carries_a_digest(spark):
    rows = packing.pack(helpers.docs(spark), carry=zlib.crc32, carried="long",
                        name="crc").collect()
    one = next(r for r in rows if r["doc_id"] == 7)
    ids = reference_ids(["word"])[0] + [1]
    assert one["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_digests_the_packed_ids(spark, monkeypatch):
    """The query packs the ids themselves and digests its result."""
    from conftest import SF_SMALL
    from quayside.llm import queries
    made = []

    def pack(*args, **kwargs):
        made.append(packing_pack(*args, **kwargs))
        return made[-1]
    packing_pack = packing.pack
    monkeypatch.setattr(packing, "pack", pack)
    got = queries.op1_packing(spark, SF_SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                           "offset"]
    assert dict(made[0].dtypes)["ids"] == "binary" and dict(got.dtypes)["ids_crc32"] == "bigint"
    want = Counter((r["sequence_id"], r["offset"], zlib.crc32(r["ids"]))
                   for r in made[0].collect())
    assert Counter((r["sequence_id"], r["offset"], r["ids_crc32"]) for r in got.collect()) == want


def test_pack_empty_table(spark):
    assert packing.pack(helpers.empty(spark)).collect() == []
