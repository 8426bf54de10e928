"""Token-id files: one zstandard frame per document and a trailing seek table.

A file is a sequence of independent zstandard frames, each with its content
checksum and holding one document's ids (little-endian, 2 or 4 bytes an id),
then one skippable frame with the seek table, so any zstandard reader can
also stream the whole file.  The seek table has, for each document in order,
its id, its number of ids, its frame's size and the crc32 of its ids; a
footer says how many entries there are and which file of the whole this is.
A reader finds the table from the end of the file and decompresses the
requested documents' frames alone.

Files come in ascending document id order: documents are range-partitioned
by id, text hash and place in the input, so that many rows equal in id and text
go to several tasks; then they are sorted, and each partition writes files of
about ``file_bytes``.  The place is that in the input's partitions: give a table
that reads in the same order again (files or a checkpoint), not the outcome of a
shuffle, or a retried task could deal such equal rows differently.

Ids take 2 bytes if the tokenizer's largest id and the end id fit, else 4; an id
that does not fit its file's width is refused.

Defined cases: a null text is stored as the end id alone; null ids come
first; repeated ids are ordered by their text's hash and kept each; an empty table gives
no file and reads back as no rows; only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs
from .common import scratch
from .packing import CARRIED
from .tokens import encoder, largest_id, slices

# fixed values of the format
SKIPPABLE = 0x184D2A5E          # a zstandard skippable frame
ENDING = "TOKSEEK1"             # last bytes of a file, ASCII
ENTRY = struct.Struct("<qBQQI")     # id, id is null, ids, frame bytes, crc32 of the raw ids
FOOTER = struct.Struct("<QBIIQ")    # entries, bytes an id, partition, file in it, table bytes


class FileBuilder:
    """Collects documents into the bytes of one file, without its ending."""

    def __init__(self, width: int, level: int):
        self.width = width
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.table, self.size = [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        raw = ids
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if len(wide) and int(wide.max()) > 0xFFFF:
                raise ValueError(f"id {int(wide.max())} needs more than 2 bytes")
            raw = wide.astype("<u2").tobytes()
        frame = self.zip.compress(raw)
        self.table.append(ENTRY.pack(key or 0, key is None, len(ids) // 4, len(frame),
                                     zlib.crc32(raw)))
        self.frames.append(frame)
        self.size += len(frame) + ENTRY.size

    def finish(self, partition: int, number: int) -> bytes:
        table = b"".join(self.table)
        tail = table + FOOTER.pack(len(self.table), self.width, partition, number, len(table))
        head = struct.pack("<II", SKIPPABLE, len(tail) + len(ENDING))
        out = b"".join([*self.frames, head, tail])
        self.frames, self.table, self.size = [], [], 0
        return out


class FileReader:
    """Random access to one file's documents."""

    def __init__(self, content: bytes):
        if content[-len(ENDING):] != ENDING.encode():
            raise ValueError("not a token file, or cut short")
        end = len(content) - len(ENDING)
        count, self.width, self.partition, self.number, size = FOOTER.unpack_from(
            content, end - FOOTER.size)
        begin = end - FOOTER.size - size
        if size != count * ENTRY.size or begin < 8:
            raise ValueError("damaged seek table")
        self.content, self.entries, at = content, [], 0
        for key, null, n, frame, crc in ENTRY.iter_unpack(content[begin:begin + size]):
            self.entries.append((None if null else key, n, at, frame, crc))
            at += frame
        if at != begin - 8:
            raise ValueError("frames and seek table disagree")
        self.unzip = zstandard.ZstdDecompressor()

    def ids(self, index: int) -> bytes:
        """Ids of one document as little-endian uint32, checked."""
        _, n, at, frame, crc = self.entries[index]
        raw = self.unzip.decompress(self.content[at:at + frame], max_output_size=n * self.width)
        if len(raw) != n * self.width or zlib.crc32(raw) != crc:
            raise ValueError(f"checksum of document {index} fails")
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def id_width(*ids: int) -> int:
    return 2 if max(ids) < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", tokenizer: str | None = None,
                      file_bytes: int = 4_000_000, level: int = 1) -> None:
    """Encode every document and write the files to a new folder."""
    width = id_width(largest_id(tokenizer), end_id)
    end = np.array([end_id], dtype="<u4").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        enc, file = encoder(tokenizer), FileBuilder(width, level)
        for batch in batches:
            for a, b in slices(batch.column(1), size=8_000_000):
                keys, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                for key, ids in zip(keys, enc.encode(texts)):
                    file.add(key, ids + end)
                    if file.size >= file_bytes:
                        yield pa.RecordBatch.from_pydict({"file": [file.finish(part, number)]})
                        number += 1
        if file.size:
            yield pa.RecordBatch.from_pydict({"file": [file.finish(part, number)]})

    # the text's hash lets a repeated (or null) id be dealt to several partitions
    ordered = (docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
               .withColumn("h", F.xxhash64("t"))
               .withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange("k", "h", "place")
               .sortWithinPartitions("k", "h", "t").drop("h", "place"))
    write_blobs(ordered.mapInArrow(build, "file binary"), "file", path, ENDING)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None,
                     carry: Callable[[bytes], object] = bytes, carried: str = "binary",
                     name: str = "ids") -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files),
    n_tokens and ``name``: the ids, or what ``carry`` makes of them (of type
    ``carried``: binary or long).

    ``doc_ids``, a short list, limits the read to those documents; the other
    frames are not decompressed.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def totals(batches):
        for batch in batches:
            for content in batch.column(0):
                r = FileReader(content.as_py())
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([r.partition], pa.int32()),
                     "number": pa.array([r.number], pa.int32()),
                     "total": pa.array([sum(e[1] for e in r.entries)], pa.int64())})

    def documents(batches):
        names = ["part", "number", "position", "doc_id", "before", "n_tokens", "carried"]
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, CARRIED[carried]]
        for batch in batches:
            for content in batch.column(0):
                r = FileReader(content.as_py())
                rows, size, before = [], 0, 0
                for i, (key, n, *_) in enumerate(r.entries):
                    if wanted is None or key in wanted:
                        rows.append((r.partition, r.number, i, key, before, n, carry(r.ids(i))))
                        size += n * 4
                    before += n
                    if rows and (size >= 8_000_000 or i + 1 == len(r.entries)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0

    files = read_blobs(spark, path).select("content")
    # one row per file, a few megabytes of ids each
    # (written, as it is read twice and the files need not be)
    path = scratch(spark, "token-sums")
    files.mapInArrow(totals, "part int, number int, total long").write.parquet(path)
    sums = spark.read.schema("part int, number int, total long").parquet(path)
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("part").orderBy("number").rowsBetween(*before)
    # only one row a partition goes through the window over all of them
    parts = sums.groupBy("part").agg(F.sum("total").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(*before)),
                           F.lit(0)).alias("part_start"))
    starts = sums.withColumn("inner", F.coalesce(F.sum("total").over(inner), F.lit(0))).join(
        parts, "part").select("part", "number",
                              (F.col("part_start") + F.col("inner")).alias("file_start"))
    docs = files.mapInArrow(documents, "part int, number int, position long, doc_id long, "
                                       f"before long, n_tokens long, carried {carried}")
    return (docs.join(starts, ["part", "number"])
            .select("doc_id", (F.col("file_start") + F.col("before")).alias("start"),
                    "n_tokens", F.col("carried").alias(name)))
