"""Mixing sources to target weights, in DataFrame operations alone.

Sizes are word counts.  All sources share ``share`` times all words by their
weights; a target stops at ``max_epochs`` times its source, and what that
leaves is shared again among the others by weight until none is above.

Within a source, documents are ordered by a hash of their id and text.  The
hash range is cut into slices of about ``slice_rows`` documents; a window
inside a slice, one over the slices of a block and one over the blocks of a
source add up to each document's prefix sum, so no task holds a source.
Whole epochs are taken of every document, and the last, partial epoch ends at
the word where the source's budget is spent.

Defined cases: a null text has no words and takes none; a null source is a
source of its own, ordered last; a null id is hashed as an empty string;
repeated rows are each a document (which of two equal rows is cut cannot be
told apart); sources without words get target 0; an empty table gives no
rows.  Extra columns of any name pass through ``mix`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, word_count, written

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """Per source: source, n_docs, source_size, target.

    ``sizes`` has columns source and size.  Sources in code point order, null
    last, get the weights in turn.  A source is capped when its cap is at
    most its weighted share of what is left after all sources that cap
    earlier (in order of cap by weight); the rest share what remains.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"),
                                      F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    cap = (F.col("source_size") * max_epochs).alias("cap")
    per = per.select("*", cap)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    per = per.withColumn("level", left / F.sum("weight").over(after))
    per = per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that is not capped holds for all after it
    common = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped") | common.isNull(), F.col("cap").cast("double")).otherwise(
        common * F.col("weight"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def hash_key(id_col: Column, text_col: Column, seed: int) -> Column:
    """A uniform 60-bit key of a document (md5, so SQL can repeat it)."""
    text = F.md5(F.coalesce(text_col, F.lit("")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")),
                            text))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", seed: int = 7, weights=WEIGHTS, share: float = 1.5,
           max_epochs: int = 2, slice_rows: int = 64, whole_rows: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken; with
    ``whole_rows`` also ``row``, a struct of all columns of ``docs``."""
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            hash_key(F.col(id_col), F.col(text_col), seed).alias("key"),
            word_count(F.col(text_col)).alias("size")]
    sizes = written(docs.select(*cols), "sizes")
    targets = source_targets(sizes, weights, share, max_epochs)
    # a slice is the range of keys that share their highest bits
    bits = F.greatest(F.lit(0), F.least(F.lit(59), F.ceil(F.log2(
        F.col("n_docs") / F.lit(float(slice_rows)))).cast("int")))
    targets = written(targets.withColumn("bits", bits)
                      .withColumnRenamed("source", "s"), "targets")

    def sliced(rows):
        return (rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
                .withColumn("slice", F.expr("shiftright(key, 60 - bits)"))
                .withColumn("block", F.expr("shiftright(slice, 10)")))

    totals = written(sliced(sizes).groupBy("source", "block", "slice").agg(
        F.sum("size").alias("words")), "slices")
    blocks = totals.groupBy("source", "block").agg(F.sum("words").alias("words"))

    def earlier(*order):
        return Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(
            Window.unboundedPreceding, -1)

    def prefix(column, over):
        return F.coalesce(F.sum(column).over(over), F.lit(0))

    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"),
                           prefix("words", earlier("source", "block")).alias("in_source"))
    starts = totals.select("source", "block", "slice", prefix(
        "words", earlier("source", "block", "slice")).alias("in_block"))
    starts = starts.join(blocks, F.col("source").eqNullSafe(F.col("s"))
                         & (F.col("block") == F.col("b")))
    starts = starts.select("s", F.col("slice").alias("l"),
                           (F.col("in_source") + F.col("in_block")).alias("slice_start"))
    rows = sliced(docs.select(*cols, F.struct("*").alias("row")) if whole_rows else sizes)
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", prefix("size", inside))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s"))
                     & (F.col("slice") == F.col("l")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(
        F.col("size"), rest - F.col("slice_start") - F.col("inside")))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       taken.cast("long").alias("taken"), *(["row"] if whole_rows else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", n_chars_col: str | None = None, seed: int = 7,
        **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document as often
    as it is taken whole, and once more, cut, where a budget ends inside it.

    A cut document holds its first words joined by single spaces; with
    ``n_chars_col`` that column follows the cut text.  Documents without
    words are not taken.
    """
    got = shares(docs, id_col, text_col, source_col, seed, whole_rows=True, **options)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    got = got.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    here = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    got = got.withColumn("here", here.cast("int"))
    text = F.col("row")[text_col]
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                                 F.lit(1), F.col("here")), " ")
    got = got.withColumn("text_", F.when(F.col("here") < F.col("size"), first).otherwise(text))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("text_").alias(c))
        elif c == n_chars_col:
            out.append(F.when(F.col("here") < F.col("size"), F.length("text_").cast("long"))
                       .otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return got.select(*out)
