"""Model tables shipped into expressions as one folded array literal.

A tree level's split table (feature and threshold per node) is a small,
model-sized array.  ``from_json`` of a literal string is constant-folded by
Catalyst into a single array literal, so the per-row lookup is an O(1)
``element_at`` inside whole-stage codegen, with no join and no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_literal(values, element_type: str = "double") -> Column:
    vals = [None if v is None else (float(v) if element_type == "double" else int(v))
            for v in values]
    return F.from_json(F.lit(json.dumps(vals)), f"array<{element_type}>")
