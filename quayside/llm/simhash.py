"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: the text with A-Z lower-cased is cut into words, words into
shingles of ``shingle`` words joined by spaces (repeats included; a shorter
text is one shingle); a bit of the 64-bit fingerprint is set if it is set in
over half of the shingles' XXH64 hashes.  A text without words has
fingerprint zero, which links like any other.

Candidates: each bit position i gets a vector m(i) of radius + 1 bits.  For
each of the 2^(radius+1) - 1 non-zero vectors v there is a table keyed by the
fingerprint's bits with <m(i), v> odd.  The m(i) of at most ``radius``
differing bits span fewer than radius + 1 dimensions, so some v is orthogonal
to all of them, and in that table the two fingerprints share a key: every
pair within the radius meets in some table.

Equal fingerprints are collapsed first.  A table's bucket of more than
``limit`` fingerprints is covered again by masks dealt in another order, which
fix further bits; pairs within the radius still meet.  What is over the limit
after ``levels`` rounds is compared exactly, block by block.  Inside a bucket
all distances are checked and only links to the smallest reachable member are
emitted, so a bucket of n gives fewer than n links, not all its pairs.

Components come from iterated minimum hooking and pointer jumping on the
links, each round written to the shared folder.

Defined cases: null text counts as empty; rows with a null id take part, but
a component's id is its smallest non-null id (null if it has none); repeated
rows are rows of the same component; an empty table gives no rows.  Only the
id and text columns are read; ``drop_near_copies`` passes all others through.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, written


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()   # bytes: A-Z and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    ones, one = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 32_768):   # bounded memory for very long texts
        hashes = [one(line[a:b], seed) for a, b in
                  zip(starts[i:min(n, i + 32_768)].tolist(), last[i:i + 32_768].tolist())]
        bits = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def covering_masks(radius: int, bits: int = 64, deal: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 masks; ``deal`` numbers different dealings of the
    vectors m(i) to the bit positions."""
    count = (1 << radius + 1) - 1
    vectors = [i % count + 1 for i in range(bits)]
    random.Random(deal).shuffle(vectors)
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() & 1)
            for v in range(1, count + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def nearest_smallest(x: np.ndarray, radius: int) -> np.ndarray:
    """For sorted distinct uint64 values, the index of the smallest value in
    each one's component under links of at most ``radius`` bits."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for i in range(0, len(x), 512):
            near = np.bitwise_count(x[i:i + 512, None] ^ x[None, :]) <= radius
            new[i:i + 512] = np.where(near, label[None, :], len(x)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bucket_links(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the arrays in column ``fps``: a to its smallest."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                x = np.sort(group.values.to_numpy().view(np.uint64))
                label = nearest_smallest(x, radius)
                linked = np.flatnonzero(label != np.arange(len(x)))
                a.append(x[linked].view(np.int64))
                b.append(x[label[linked]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (a, b)],
                names=["a", "b"])

    return groups.select("fps").mapInArrow(link, "a long, b long")


def covering_links(fps: DataFrame, radius: int = 3, limit: int = 1024,
                   levels: int = 4) -> DataFrame:
    """Links between distinct fingerprints (column fp) that join every pair
    within ``radius`` bits, directly or through others; written."""
    members = fps.select(F.lit(0).cast("long").alias("key"), "fp")
    out = None

    def add(groups):
        nonlocal out
        links = _bucket_links(groups, radius)
        out = links if out is None else out.unionByName(links)

    def collected(rows):
        return (rows.groupBy("key").agg(F.collect_set("fp").alias("fps"))
                .where(F.size("fps") > 1))

    for level in range(levels):
        # the key is a hash of all masked bits so far; should two keys agree,
        # their buckets only share the exact comparison
        keys = F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m))))
                         for i, m in enumerate(covering_masks(radius, deal=level))])
        members = members.select(F.explode(keys).alias("key"), "fp")
        large = written(members.groupBy("key").count().where(F.col("count") > limit)
                        .select("key"), "large")
        if large.isEmpty():
            add(collected(members))
            break
        add(collected(members.join(large, "key", "left_anti")))
        members = written(members.join(large, "key", "left_semi"), "members")
    else:
        sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit)).alias("blocks"))
        block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
        rows = members.join(sizes, "key").withColumn("block", block).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        add(collected(rows.select(pair.alias("key"), "fp")))
    return written(out.distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest
    node reachable.  Rounds grow with the logarithm of the longest chain."""
    edges = written(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    parent = written(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("root")), "parents")
    while True:
        upper = parent.select(F.col("node").alias("up"), F.col("root").alias("grand"))
        known = written(parent.join(upper, F.col("root") == F.col("up")).drop("up"), "known")
        near = (edges.join(known.select(F.col("node").alias("b"), "grand"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least")))
        hook = written(known.join(near, "node").select(
            "node", "root", F.least("least", "grand").alias("to")), "hooks")
        # a node hooks itself and its parent to the smallest grandparent near it
        offers = hook.select("node", "to").unionByName(
            hook.select(F.col("root").alias("node"), "to")).unionByName(
            hook.select("node", F.col("root").alias("to")))
        after = written(offers.groupBy("node").agg(F.min("to").alias("root")), "parents")
        moved = after.join(parent.withColumnRenamed("root", "was"), "node").where("root <> was")
        if moved.isEmpty():
            return parent
        parent = after


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, radius: int = 3, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, text_hash, fp, component_id, keeper (the smallest
    (doc_id, text_hash) of the component as a struct)."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    texts = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "texts")
    roots = components(covering_links(texts, radius, limit))
    joined = texts.join(roots, F.col("fp") == F.col("node"))
    best = joined.groupBy("root").agg(F.min("first").alias("keeper"))
    linked = joined.join(best, "root").select(F.col("fp").alias("f"), "keeper")
    texts = written(texts.join(linked, F.col("fp") == F.col("f"), "left").select(
        F.col("fp"), F.coalesce("keeper", "first").alias("keeper")), "keepers")
    return rows.join(texts, "fp").select(
        "doc_id", "text_hash", "fp", F.col("keeper")["doc_id"].alias("component_id"), "keeper")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3, radius: int = 3, limit: int = 1024) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id
    (then text hash; among rows repeated in both, the smallest row hash)."""
    found = near_copies(docs, id_col, text_col, shingle, radius, limit)
    h, i, t, n = (fresh(docs, c) for c in ("__hash", "__id", "__text", "__row"))
    keep = found.select(F.col("keeper")["doc_id"].alias(i),
                        F.col("keeper")["text_hash"].alias(t)).distinct()
    rows = docs.withColumn(h, F.xxhash64(F.col(text_col)))
    kept = rows.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(i))
                     & (F.col(h) == F.col(t)), "left_semi")
    # maps have no hash of their own
    values = [F.to_json(quoted(f.name)) if "map<" in f.dataType.simpleString() else quoted(f.name)
              for f in docs.schema]
    once = Window.partitionBy(F.col(id_col).cast("long"), h).orderBy(F.xxhash64(*values))
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(
        *map(quoted, docs.columns))
