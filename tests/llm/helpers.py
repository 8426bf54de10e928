"""Small tables with the awkward rows that every operator must survive."""

from pyspark.sql import types as T

# extra columns whose names clash with result and internal columns
CLASH = ["start", "kept", "key", "size", "fp", "spans", "group", "row", "copy", "__hash", "words"]

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASH])

PROSE = ("The old harbour wakes slowly, and the first boats come in before light. "
         "Men carry the crates ashore while gulls turn above them. "
         "By noon the market is full and nobody speaks of the weather.")
LONG = " ".join(f"word{i} follows word{i + 1}," for i in range(30_000)) + " and it ends."


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text) if text is not None else None,
            *["x" for _ in CLASH])


def awkward():
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows and texts of one word."""
    return [
        row(1, PROSE), row(2, PROSE), row(3, PROSE + " One more line."), row(4, ""),
        row(5, None), row(6, "  \n\t "), row(7, "word"), row(8, LONG), row(8, LONG),
        row(9, "é ñ ☂ 漢字 ends here."), row(None, PROSE), row(None, None),
        (10, "Null source and language here.", None, None, None, *[None] * len(CLASH)),
        row(11, "a b c d e a b c d e a b c d e f"), row(12, "tie tie"), row(13, "tie tie"),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
