"""The registered corpus queries: thin wrappers that apply an operator to its
whole table and derive the digest columns of its result."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, dialogue, linerules, mixing, packing, pii, simhash, slack, tokenfile, topk,
               toxicity, warc, weakquality)
from .common import scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(table(spark, sf_dir, "documents")).drop("lost_chars", "clean_text")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.shares(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, end_id=0)
    return tokenfile.read_token_files(spark, path, carry=zlib.crc32, carried="long",
                                      name="ids_crc32")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakquality.judge(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogue.digests(dialogue.repair(dialogue.damaged(turns), ids=turns))


def op12_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64,
                             scale=1024, salt=3)


def op13_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = slack.pack(table(spark, sf_dir, "documents"), window=2048, end_id=0)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_line_rules, op3_pii, op4_mixing, op5_topk, op6_token_files, op7_quality,
    op8_warc, op9_toxicity, op10_simhash, op11_dialogue,
    op12_ns_bounds, op13_minimum_slack)}
