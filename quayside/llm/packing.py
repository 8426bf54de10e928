"""Packing documents into fixed windows by best-fit decreasing.

A document's ids are its text's ids and one end id.  A document longer than
the window is first cut into full windows; what is left of every document
(1 to window ids) is placed, longest first, into the open window with the
least room that still holds it.  A segment tree over the remaining capacities
finds that window.

Tails are dealt by a hash into groups of about ``group_rows`` and each group
is packed by itself, so no task sees more than its group and the windows left
open are a few per group.

Defined cases: a null text packs as an empty one (the end id alone); a null
id is kept as null; repeated rows are packed each by itself; equal lengths
are taken in piece order, and among windows with equal room the last opened
is filled; an empty table gives no rows.  Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, written
from .tokens import encoder, slices

FIELDS = ("piece_id", "doc_id", "start", "length", "carried", "doc_tokens")
CARRIED = {"binary": pa.binary(), "long": pa.int64()}


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree whose nodes
    say whether any window below them is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the least room >= need."""
        node = need + self.leaves
        if not self.any[node]:
            # climb until a right sibling has an open window, then descend left
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            self.any[node] = 0
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
                if self.any[node]:
                    break
                node >>= 1
        return room, window


def best_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, taken in descending order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    window = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    opened, tree = 0, OpenWindows(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take_tightest(need)
        if found is None:
            found = (capacity, opened)
            opened += 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > need:
            tree.add(room - need, int(window[i]))
    return window, offset


def pieces(docs: DataFrame, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", tokenizer: str | None = None,
           carry: Callable[[bytes], object] = bytes, carried: str = "binary") -> DataFrame:
    """Token pieces of at most ``window`` ids: every full window of a document
    and its tail.  ``carried`` is what ``carry`` makes of the piece's ids
    (little-endian uint32), as a binary or long column; by default the ids."""
    end = np.array([end_id], dtype="<u4").tobytes()
    types = [CARRIED[carried] if f == "carried" else pa.int64() for f in FIELDS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, n = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in slices(batch.column(1)):
                keys, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                cols: list[list] = [[] for _ in FIELDS]
                for key, ids in zip(keys, enc.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    for s in range(0, total, window):
                        part = ids[4 * s:4 * (s + window)]
                        for col, v in zip(cols, (n, key, s, len(part) // 4, carry(part), total)):
                            col.append(v)
                        n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], names=list(FIELDS))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut, ", ".join(
        f"{f} {carried if f == 'carried' else 'long'}" for f in FIELDS))


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", tokenizer: str | None = None, group_rows: int = 4096,
         carry: Callable[[bytes], object] = bytes, carried: str = "binary",
         name: str = "ids") -> DataFrame:
    """Pack ``docs``: one row per piece with doc_id, start, length, ``name``,
    doc_tokens, sequence_id and offset.

    ``name`` holds the piece's ids (binary, little-endian uint32), or what
    ``carry`` makes of them where only a digest has to travel through the
    shuffle (of type ``carried``: binary or long).
    """
    made = pieces(docs, window, end_id, id_col, text_col, tokenizer, carry, carried)
    made = written(made.withColumnRenamed("carried", name), "pieces")
    full = made.where(F.col("length") == window)
    tails = made.where(F.col("length") < window)
    groups = parts_for(tails.count(), group_rows)
    tails = tails.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    order = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"]

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece_id")
        where, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        # full windows have even sequence ids, shared windows odd ones
        sequence = ((key[0].as_py() << 32) + where) * 2 + 1
        return (rows.select(order[:-2]).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)))

    fields = {f.name: f for f in made.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString() if c in fields else 'bigint'}"
                       for c in order)
    packed = tails.groupBy("group").applyInArrow(place, schema)
    whole = full.select("doc_id", "start", "length", name, "doc_tokens",
                        (F.col("piece_id") * 2).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
