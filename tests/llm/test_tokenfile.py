import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pytest
import xxhash
import zstandard

import helpers
from test_packing import reference_ids
from quayside.llm import tokenfile
from quayside.llm.common import scratch


def expected(rows):
    def text_hash(t):       # as Spark's xxhash64
        h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    out, at = [], 0
    for r, ids in zip(rows, reference_ids([r[1] for r in rows])):
        ids = ids + [0]
        out.append((r[0], at, len(ids), tuple(ids)))
        at += len(ids)
    return out


def test_round_trip_in_id_order(spark):
    path = scratch(spark, "test")
    tokenfile.write_token_files(helpers.docs(spark), path, file_bytes=2000)
    got = [(r["doc_id"], r["start"], r["n_tokens"], tuple(np.frombuffer(r["ids"], "<u4").tolist()))
           for r in tokenfile.read_token_files(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(helpers.awkward())


def test_only_requested_documents(spark):
    path = scratch(spark, "test")
    tokenfile.write_token_files(helpers.docs(spark), path)
    want = [r for r in expected(helpers.awkward()) if r[0] in (3, 9)]
    got = tokenfile.read_token_files(spark, path, doc_ids=[3, 9]).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in got) == [r[:3] for r in want]


def test_empty_table(spark):
    path = scratch(spark, "test")
    tokenfile.write_token_files(helpers.empty(spark), path)
    assert tokenfile.read_token_files(spark, path).collect() == []


def one_file():
    b = tokenfile.FileBuilder(2, 3)
    for k, ids in ((1, [1, 2, 3]), (2, []), (None, [50_256] * 9)):
        b.add(k, np.array(ids, "<u4").tobytes())
    return b.finish(0, 0) + tokenfile.ENDING.encode()


def test_any_zstandard_reader_streams_a_file():
    raw = zstandard.ZstdDecompressor().stream_reader(one_file(), read_across_frames=True).read()
    assert np.frombuffer(raw, "<u2").tolist() == [1, 2, 3] + [50_256] * 9


def test_damage_is_noticed():
    good = one_file()
    assert np.frombuffer(tokenfile.FileReader(good).ids(2), "<u4").tolist() == [50_256] * 9
    with pytest.raises(ValueError):
        tokenfile.FileReader(good[:-1])
    table = bytearray(good)
    table[-len(tokenfile.ENDING) - tokenfile.FOOTER.size - 1] ^= 1   # a crc in the seek table
    with pytest.raises(ValueError):
        tokenfile.FileReader(bytes(table)).ids(2)
    frame = bytearray(good)
    frame[6] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r = tokenfile.FileReader(bytes(frame))
        [r.ids(i) for i in range(3)]


def test_ids_take_the_width_they_need(spark, tmp_path):
    for ids, end in (([65_535], 0), ([65_536], 0), ([70_000, 1], 3), ([5], 90_000)):
        b = tokenfile.FileBuilder(tokenfile.id_width(*ids, end), 1)
        b.add(1, np.array(ids + [end], "<u4").tobytes())
        r = tokenfile.FileReader(b.finish(0, 0) + tokenfile.ENDING.encode())
        assert np.frombuffer(r.ids(0), "<u4").tolist() == ids + [end]
    with pytest.raises(ValueError, match="70000"):
        tokenfile.FileBuilder(2, 1).add(1, np.array([70_000], "<u4").tobytes())


def test_a_tokenizer_with_more_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    words = {"[UNK]": 0, **{f"w{i}": i for i in range(1, 70_001)}}
    made = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(str(tmp_path / "large.json"))
    path = scratch(spark, "test")
    tokenfile.write_token_files(helpers.docs(spark, [helpers.row(1, "w70000 w3 w65536")]), path,
                                tokenizer=str(tmp_path / "large.json"))
    got = tokenfile.read_token_files(spark, path).first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == [70_000, 3, 65_536, 0]


def test_rows_equal_in_id_and_text_go_to_several_files(spark):
    rows = [helpers.row(None, helpers.PROSE)] * 400 + [helpers.row(i, f"text {i}") for i in range(800)]
    path = scratch(spark, "test")
    # so few rows would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_token_files(helpers.docs(spark, rows).repartition(8), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = tokenfile.read_blobs(spark, path).collect()
    held = [sum(k is None for k, *_ in tokenfile.FileReader(bytes(f["content"])).entries) for f in files]
    assert sum(held) == 400 and max(held) < 400
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in
           tokenfile.read_token_files(spark, path).orderBy("start").collect()]
    assert got == [r[:3] for r in expected(rows)]
