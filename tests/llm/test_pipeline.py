import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
from pyspark.sql import functions as F

import helpers
from conftest import SF_SMALL

import __spark_entry__ as E
import corpus_pipeline
from quayside.llm import packing, pii, simhash, weakquality
from quayside.llm.queries import QUERIES


def test_stages_in_order_and_their_effects(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_copies", "pii", "mix", "pack"]
    frames = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "pack":
            assert out.columns == frames["start"].columns
        out.write.parquet(str(tmp_path / name))
        docs = frames[name] = spark.read.parquet(str(tmp_path / name))
    kept = {r["doc_id"] for r in weakquality.judge(frames["start"]).where("kept").collect()}
    assert {r["doc_id"] for r in frames["quality"].collect()} == kept
    ids = {r["component_id"] for r in simhash.near_copies(frames["quality"]).collect()}
    assert sorted(r["doc_id"] for r in frames["near_copies"].collect()) == sorted(ids)
    for r in frames["pii"].collect():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    assert frames["mix"].count() > 0
    total = sum(r["length"] for r in frames["pack"].collect())
    encoder = packing.encoder()
    texts = [r["text"] for r in frames["mix"].select("text").collect()]
    assert total == sum(len(i) // 4 + 1 for i in encoder.encode(texts))


def test_every_stage_survives_awkward_and_empty_tables(spark, tmp_path):
    for k, docs in enumerate((helpers.docs(spark), helpers.empty(spark))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))


def test_columns_of_any_name_and_type_survive(spark, tmp_path):
    """Names with dots and back quotes, and a map column, beside repeated rows."""
    rows = [r[:5] for r in helpers.awkward()] + [helpers.row(1, helpers.PROSE)[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 "n_chars long").withColumns(
        {"a.b": F.lit("x"), "c`d": F.lit(1), "m": F.create_map(F.lit("k"), F.lit("v"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r["a.b"] for r in docs.collect()} == {"x"}
    corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()


def test_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(QUERIES) <= set(names)
