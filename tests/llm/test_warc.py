import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import gzip
import random

import pytest
from hypothesis import given, strategies as st

from quayside.llm import warc
from quayside.llm.blobs import read_blobs
from quayside.llm.common import scratch

PAGES = "page_id long, url string, html string, record_type string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], PAGES)


ROWS = [(5, "http://a/", "same"), (2, "http://b/ \r\nX", "same"), (9, None, "same"),
        (3, "u", "ünï" * 3000), (4, "u", ""), (6, "u", None), (7, "u", "alone"),
        (8, "u", "twice"), (8, "u", "twice"), (None, "u", "same"), (None, None, "nobody")]


def brute(rows, least=0):
    out = []
    for i, url, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        first = min(same, default=None)
        ref = first if len(payload) >= least and first != i else None
        out.append((i, warc.base32_sha1(payload), len(payload),
                    "response" if ref is None else "revisit", ref,
                    payload if ref is None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("segment", [200, 10 ** 6])
def test_round_trip(spark, least, segment):
    path = scratch(spark, "test")
    warc.write_archives(pages(spark, ROWS), path, min_bytes=least, segment_bytes=segment,
                        file_bytes=1500)
    got = [(r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"],
            r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
           for r in warc.read_archives(spark, path).collect()]
    assert sorted(got, key=repr) == brute(ROWS, least)


def test_empty_table(spark):
    path = scratch(spark, "test")
    warc.write_archives(pages(spark, []), path)
    assert warc.read_archives(spark, path).collect() == []


def test_files_are_plain_gzip_warc(spark):
    path = scratch(spark, "test")
    warc.write_archives(pages(spark, ROWS), path, segment_bytes=500)
    for f in read_blobs(spark, path).collect():
        raw = gzip.decompress(bytes(f["content"]))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert b"WARC-Segment-Number" in raw or b"WARC-Type: re" in raw


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_chunk_extensions_and_damage():
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments_in_any_order():
    block = bytes(range(256)) * 4
    parts = [(n + 1, None, block[i:i + 100]) for n, i in enumerate(range(0, 1024, 100))]
    parts[-1] = (*parts[-1][:1], 1024, parts[-1][2])
    random.Random(1).shuffle(parts)
    assert warc.reassemble(parts) == block
    with pytest.raises(ValueError):
        warc.reassemble(parts[1:])
    with pytest.raises(ValueError):
        warc.reassemble([(n, 1000 if t else None, b) for n, t, b in parts])


def test_cut_archives_are_noticed():
    whole = warc.record([("WARC-Type", "response")], b"x" * 1000)
    with pytest.raises(ValueError):
        list(warc.parse_archive(whole[:-3]))
