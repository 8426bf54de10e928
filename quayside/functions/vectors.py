"""Column expressions shared by the classifiers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_label(scores: dict) -> Column:
    """Label with the largest score; a tie goes to the lower label.

    ``scores`` maps a numeric label to a score Column.  ``greatest`` over
    structs compares the score first and then the negated label.
    """
    items = [F.struct(s.alias("s"), F.lit(-float(k)).alias("k")) for k, s in scores.items()]
    best = F.greatest(*items) if len(items) > 1 else items[0]
    return -best["k"]
