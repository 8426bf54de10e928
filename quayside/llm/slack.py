"""Packing documents into as few windows as possible by minimum bin slack.

A document's ids are its text's ids and one end id.  A document longer than
the window is cut into full windows from its end, so only its first piece may
be shorter; other documents stay whole.  Full pieces have a window each.  The
rest are packed window by window: the longest piece left opens a window, and a
subset-sum program over the lengths left, with a bitset of the sums that can
be reached, finds the fullest combination that fits beside it.  The
combination is then removed (the form of the heuristic that fixes the longest
piece: a long piece left for later finds fewer partners).

Pieces are packed in the task that tokenises them, about ``group_rows`` at a
time, so ids are not shuffled.  Pieces of windows that are not full go, by id
and length alone, into another round with other pieces, in groups that double
for five rounds, until one group holds what is left or a round closes fewer
than a tenth of its pieces (then the lengths, not the groups, leave the room).

Defined cases: a null text packs as an empty one (the end id alone); a null id
is kept as null; repeated rows are packed each by itself; among equally full
combinations the one whose shortest piece is longest is taken, and equal
lengths are taken in piece order; an empty table gives no rows.  Only the id
and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, written
from .tokens import encoder, slices

PIECE = ("piece_id", "doc_id", "piece", "start", "length")


def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """The lengths (with repeats, longest first) of the fullest combination
    of at most ``room``.

    ``lengths`` are the distinct lengths in ascending order, ``counts[n]`` is
    how many pieces of length n there are.  Bit s of ``reach`` is set if some
    combination of the pieces seen so far adds up to s; each piece that adds
    a sum is a stage, and walking the stages back gives the combination."""
    reach, mask, stages = 1, (1 << (room + 1)) - 1, []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[at]
        for _ in range(min(counts[n], room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            stages.append((n, reach))
            reach = more
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, []
    for n, before in reversed(stages):
        if not before >> left & 1:
            chosen.append(n)
            left -= n
    return chosen[::-1]


def minimum_slack(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each length (1 to ``capacity``), and each window's
    unused room."""
    lengths = np.asarray(lengths, dtype=np.int64)
    window, offset = np.zeros((2, len(lengths)), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        waiting[lengths[i]].append(i)      # the smallest index is taken first
    counts = [len(w) for w in waiting]
    left = [n for n in range(1, capacity + 1) if counts[n]]
    slack = []
    while left:
        first = left[-1]
        counts[first] -= 1
        used = [first, *fullest(left, counts, capacity - first)]
        for n in used[1:]:
            counts[n] -= 1
        at = 0
        for n in used:
            i = waiting[n].pop()
            window[i], offset[i] = len(slack), at
            at += n
        slack.append(capacity - at)
        for n in set(used):
            if not counts[n]:
                left.pop(bisect_right(left, n) - 1)
    return window, offset, np.array(slack, dtype=np.int64)


def _placed(rows: pa.Table, window: int, sequence: int) -> pa.Table:
    """The rows with sequence_id, offset and open (their window has room),
    windows numbered from ``sequence``; full pieces have one of their own."""
    sizes = rows["length"].to_numpy()
    part = np.flatnonzero(sizes < window)
    sequence_id, offset = np.zeros((2, len(sizes)), dtype=np.int64)
    is_open = np.zeros(len(sizes), dtype=bool)
    at, offset[part], slack = minimum_slack(sizes[part], window)
    sequence_id[part] = at
    is_open[part] = slack[at] > 0
    whole = np.flatnonzero(sizes == window)
    sequence_id[whole] = len(slack) + np.arange(len(whole))
    return (rows.append_column("sequence_id", pa.array(sequence + sequence_id))
            .append_column("offset", pa.array(offset)).append_column("open", pa.array(is_open)))


def pieces(docs: DataFrame, window: int, end_id: int, id_col: str, text_col: str,
           tokenizer: str | None, group_rows: int) -> DataFrame:
    """Token pieces packed within their task: PIECE, ids, sequence_id, offset,
    open."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [*PIECE, "ids"]
    types = [*[pa.int64()] * len(PIECE), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        n = first = task << 33
        cols: list[list] = [[] for _ in names]
        short = size = 0

        def flush() -> pa.RecordBatch:
            rows = pa.table([pa.array(c, t) for c, t in zip(cols, types)], names)
            for c in cols:
                c.clear()
            # a group has no more windows than pieces, so numbers do not meet
            return _placed(rows, window, first).combine_chunks().to_batches()[0]

        for batch in batches:
            for a, b in slices(batch.column(1)):
                keys, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                for key, ids in zip(keys, enc.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    cuts = [0, *range(total % window or window, total + 1, window)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        for col, v in zip(cols, (n, key, k, s, e - s, ids[4 * s:4 * e])):
                            col.append(v)
                        n += 1
                        short += e - s < window
                    size += total
                    # what is held is bounded in pieces and in ids
                    if short >= group_rows or size >= group_rows * window:
                        yield flush()
                        first, short, size = n, 0, 0
        if cols[0]:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut, ", ".join(f"{f} long" for f in PIECE) + ", ids binary, "
                             "sequence_id long, offset long, open boolean")


def _placer(window: int, turn: int):
    def place(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("piece_id").select(["piece_id", "length"])
        # below zero, apart from the numbers of the first round
        return _placed(part, window, -((turn << 56) + ((key[0].as_py() + 1) << 24)))
    return place


def repack(rows: DataFrame, window: int, group_rows: int) -> DataFrame:
    """piece_id, sequence_id, offset of the pieces (piece_id, length), packed
    in rounds of ever fewer pieces."""
    done, turn = None, 0
    while True:
        turn += 1
        count, most = rows.count(), group_rows << min(turn, 5)
        groups = parts_for(count, most)
        dealt = rows.select("piece_id", "length", F.pmod(
            F.xxhash64("piece_id", F.lit(turn)), F.lit(groups)).alias("group"))

        packed = written(dealt.groupBy("group").applyInArrow(
            _placer(window, turn), "piece_id long, length long, sequence_id long, offset long, open boolean"),
            "repacked")
        still = packed.where("open")
        last = groups == 1 or (turn > 5 and still.count() > 0.9 * count)
        closed = packed if last else packed.where("NOT open")
        closed = closed.select("piece_id", "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rows = still.select("piece_id", "length")


def pack(docs: DataFrame, window: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", tokenizer: str | None = None,
         group_rows: int = 4096) -> DataFrame:
    """Pack ``docs``: one row per piece with doc_id, piece, start, length, ids
    (binary, little-endian uint32), sequence_id and offset."""
    made = written(pieces(docs, window, end_id, id_col, text_col, tokenizer, group_rows),
                   "pieces")
    out = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rest = made.where("open")
    again = repack(rest.select("piece_id", "length"), window, group_rows)
    moved = rest.drop("sequence_id", "offset").join(again, "piece_id")
    return made.where("NOT open").select(*out).unionByName(moved.select(*out))
