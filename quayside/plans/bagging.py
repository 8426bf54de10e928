"""SQL-checked rows of the random forest with repeatable bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bagged_forest import bagged_forest_fit
from ..operators.metrics import confusion, poisson_cuts
from ..operators.split import split
from ..sources.tables import order_lines
from .queries import confusion_sql, register, with_ol

FEATURES = ["order_day", "l_quantity", "p_size", "l_discount"]
EDGES = [[float(v) for v in range(240, 2400, 240)], [float(v) for v in range(6, 51, 5)],
         [10.0, 20.0, 30.0, 40.0], [0.015, 0.035, 0.055, 0.075]]
TREES, DEPTH, K, SEED = 3, 2, 2, 7


def _u32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT"


def _bagged_sql() -> str:
    d = range(len(FEATURES))
    bins = ", ".join("(" + " + ".join(f"CASE WHEN {c} >= {e}::DOUBLE THEN 1 ELSE 0 END" for e in es)
                     + f") AS f{i}" for i, (c, es) in enumerate(zip(FEATURES, EDGES)))
    copies = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in poisson_cuts())
    gini = lambda n, p: f"(1 - (({n} - {p}) / {n}) * (({n} - {p}) / {n}) - ({p} / {n}) * ({p} / {n}))"
    ctes = [f"""tr0 AS (SELECT tree, 0::BIGINT AS node, y, f0, f1, f2, f3, {copies} AS w FROM
  (SELECT range AS tree, late AS y, {bins}, {_u32(f"'{SEED}'", 'order_key', 'range')} AS u
   FROM tr, range({TREES})))""",
            f"""te0 AS (SELECT line, range AS tree, 0::BIGINT AS node, late AS y, {bins}
  FROM (SELECT *, row_number() OVER () AS line FROM te) te, range({TREES}))"""]
    value = "CASE b.f " + " ".join(f"WHEN {i} THEN x.f{i}" for i in d) + " END"
    for i in range(DEPTH):
        ctes.append(f"""dr{i} AS (SELECT tree, node, f FROM (SELECT *, row_number() OVER (PARTITION BY tree, node
  ORDER BY {_u32(f"'{SEED}'", 'tree', 'node', 'f', "'pick'")}, f) AS r
  FROM (SELECT DISTINCT tree, node FROM tr{i} WHERE w > 0 AND node >= {2 ** i - 1}),
       (SELECT range AS f FROM range({len(FEATURES)}))) WHERE r <= {K})""")
        long = " UNION ALL ".join(f"SELECT tree, node, {j}::BIGINT AS f, f{j} AS v, y, w FROM tr{i}" for j in d)
        ctes.append(f"""hg{i} AS (SELECT tree, node, f, v, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS p
  FROM ({long}) JOIN dr{i} USING (tree, node, f) WHERE w > 0 GROUP BY tree, node, f, v)""")
        ctes.append(f"""rs{i} AS (SELECT tree, node, f, v,
  sum(n) OVER (PARTITION BY tree, node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS nl,
  sum(p) OVER (PARTITION BY tree, node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS pl,
  sum(n) OVER (PARTITION BY tree, node, f) AS nt,
  sum(p) OVER (PARTITION BY tree, node, f) AS pt FROM hg{i})""")
        ctes.append(f"""bs{i} AS (SELECT tree, node, f, v FROM (SELECT *, row_number() OVER
  (PARTITION BY tree, node ORDER BY gain DESC, f, v) AS r FROM (SELECT *, round({gini('nt', 'pt')}
  - nl / nt * {gini('nl', 'pl')} - (nt - nl) / nt * {gini('(nt - nl)', '(pt - pl)')}, 12) AS gain
  FROM rs{i} WHERE nl < nt) WHERE gain > 0) WHERE r = 1)""")
        for s in ("tr", "te"):
            ctes.append(f"""{s}{i + 1} AS (SELECT x.* REPLACE (CASE WHEN b.f IS NULL THEN x.node
  WHEN {value} <= b.v THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node)
  FROM {s}{i} x LEFT JOIN bs{i} b ON b.tree = x.tree AND b.node = x.node)""")
    ctes.append(f"leaf AS (SELECT tree, node, sum(w * y) / sum(w) AS s FROM tr{DEPTH} WHERE w > 0 "
                "GROUP BY tree, node)")
    ctes.append(f"""sc AS (SELECT any_value(x.y) AS y, CASE WHEN round(avg(leaf.s), 9) > 0.5 THEN 1 ELSE 0 END AS p
  FROM te{DEPTH} x JOIN leaf ON x.tree = leaf.tree AND x.node = leaf.node GROUP BY line)""")
    return with_ol(", " + ",\n".join(ctes) + f"""
SELECT CAST(l.tree AS INTEGER) AS tree, l.node, round(l.s, 9) AS share, k.n, k.tp, k.fp, k.fn, k.tn
FROM leaf l, ({confusion_sql('sc')}) k""")


@register("random_forest_bagged", _bagged_sql())
def q_random_forest_bagged(spark, sf_dir):
    """Three bagged trees of depth two for late delivery, orders drawn and two
    of four features tried at each node by hash: leaves and held-out counts."""
    train, test = split(order_lines(spark, sf_dir))
    m = bagged_forest_fit(train, FEATURES, ["order_key"], "late", num_trees=TREES,
                          max_depth=DEPTH, k_features=K, seed=SEED, edges=EDGES)
    counts = confusion(m.transform_columns(test, FEATURES, "prediction"), label="late")
    leaves = spark.createDataFrame([(t, n, round(s[1], 9)) for t, n, s in m.leaves],
                                   "tree int, node long, share double")
    return leaves.join(F.broadcast(counts.select("n", "tp", "fp", "fn", "tn")), F.lit(True))
