"""SQL-checked rows of class weights, missing values, weighted quantiles and
intervals, through the library's own fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..operators.boosting import boosted_trees_fit
from ..operators.discriminant import discriminant
from ..operators.metrics import bootstrap, compare, confusion, poisson_cuts
from ..operators.naive_bayes import SqlNaiveBayes
from ..operators.sketch import weighted_quantiles
from ..operators.split import split
from ..operators.tasks import balanced, detect_fraud, held_lines, predict_late
from ..session import checkpoint
from ..sources.tables import order_lines
from .checked import closed_form_parts
from .queries import (BOOST_EDGES, BOOST_FEATURES, BOOST_LAMBDA, NB_FEATURES, confusion_sql,
                      register, with_ol)


# ---------------------------------------------------- T1: weighted C2 and C3
def _fraud_sql() -> str:
    ctes, parts = closed_form_parts(["fraud"], weighted=True)
    # the pooled covariance divides by the weight less the classes
    return with_ol(", " + ",".join(ctes) + f", sc AS ({' UNION ALL '.join(parts)})\n"
                   + confusion_sql("sc", "task, model"))


MODELS = {"naive_bayes": SqlNaiveBayes, "discriminant": lambda: discriminant(ridge=0.0)}


@register("fraud_weighted", _fraud_sql())
def q_fraud_weighted(spark, sf_dir):
    """Fraud with both classes weighing the same, by naive Bayes and the
    discriminant, through ``detect_fraud``."""
    lines = order_lines(spark, sf_dir)
    return compare({("fraud", name): detect_fraud(lines, make(), numeric=NB_FEATURES,
                                                  categorical=[], scale=False)
                    for name, make in MODELS.items()})


# ------------------------------------- T1, C8: weights; C8: default directions
ETA, ROUNDS = 0.3, 2
#: The share of lines (tenths) whose order day is hidden, if late and if not.
HIDDEN = {1: 6, 0: 2}


def _boost_sql(label: str, weighted: bool, hidden: bool, depth: int = 2) -> str:
    """Second-order boosting on fixed bins.  The bin of a missing value is NULL;
    ``l`` says that a split sends it left."""
    bucket = lambda c, e: "(" + " + ".join(f"CASE WHEN {c} >= {v} THEN 1 ELSE 0 END" for v in e) + ")"
    key = "concat_ws('|', order_key, line_number)"
    gone = (f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT % 10) < "
            f"CASE WHEN late = 1 THEN {HIDDEN[1]} ELSE {HIDDEN[0]} END") if hidden else "FALSE"
    cols = [bucket(c, e) for c, e in zip(BOOST_FEATURES, BOOST_EDGES)]
    cols[0] = f"CASE WHEN {gone} THEN NULL ELSE {cols[0]} END"
    cols = ", ".join(f"{c} AS f{i}" for i, c in enumerate(cols))
    ctes = [f"{s}_0 AS (SELECT {label} AS y, {cols}, 0.0::DOUBLE AS m FROM {s})" for s in ("tr", "te")]
    ctes.append("cw AS (SELECT y AS cy, " + ("(SELECT count(*) FROM tr) / (2.0::DOUBLE * count(*))"
                                             if weighted else "1.0::DOUBLE") + " AS cw FROM tr_0 GROUP BY y)")
    lam, leaves = BOOST_LAMBDA, []
    gain = lambda gl, hl: (f"0.5 * ({gl} * {gl} / ({hl} + {lam}) + (gt - {gl}) ^ 2 / (ht - {hl} + {lam}) "  # noqa: E731
                           f"- gt * gt / (ht + {lam}))")
    for k in range(ROUNDS):
        ctes.append(f"tr_{k}_0 AS (SELECT y, f0, f1, m, 0 AS node, cw * (q - y) AS g, cw * q * (1 - q) AS h "
                    f"FROM (SELECT *, 1 / (1 + exp(-m)) AS q FROM tr_{k}) JOIN cw ON cy = y)")
        ctes.append(f"te_{k}_0 AS (SELECT *, 0 AS node FROM te_{k})")
        for i in range(depth):
            ctes.append(f"""hg_{k}_{i} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM (
  SELECT node, 0 AS f, f0 AS v, g, h FROM tr_{k}_{i} UNION ALL SELECT node, 1, f1, g, h FROM tr_{k}_{i})
  WHERE node >= {2 ** i - 1} GROUP BY node, f, v)""")
            ctes.append(f"""rs_{k}_{i} AS (SELECT node, f, v,
  sum(g) OVER (PARTITION BY node, f ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING) AS gl,
  sum(h) OVER (PARTITION BY node, f ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING) AS hl,
  sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht,
  coalesce(sum(CASE WHEN v IS NULL THEN g END) OVER (PARTITION BY node, f), 0) AS gm,
  coalesce(sum(CASE WHEN v IS NULL THEN h END) OVER (PARTITION BY node, f), 0) AS hm FROM hg_{k}_{i})""")
            ctes.append(f"""bs_{k}_{i} AS (SELECT node, f, v, l FROM (SELECT *, row_number() OVER (PARTITION BY node
  ORDER BY gain DESC, f, v, l) AS r FROM (
    SELECT node, f, v, 0 AS l, round({gain('gl', 'hl')}, 7) AS gain FROM rs_{k}_{i}
    WHERE v IS NOT NULL AND hl >= 1 AND ht - hl >= 1
    UNION ALL
    SELECT node, f, v, 1, round({gain('(gl + gm)', '(hl + hm)')}, 7) FROM rs_{k}_{i}
    WHERE v IS NOT NULL AND hm > 0 AND hl + hm >= 1 AND ht - hl - hm >= 1)
  WHERE gain > 0) WHERE r = 1)""")
            for s in ("tr", "te"):
                ctes.append(f"""{s}_{k}_{i + 1} AS (SELECT x.* REPLACE (CASE WHEN b.f IS NULL THEN x.node
  WHEN coalesce(CASE WHEN b.f = 0 THEN f0 ELSE f1 END <= b.v, b.l = 1) THEN 2 * x.node + 1
  ELSE 2 * x.node + 2 END AS node)
  FROM {s}_{k}_{i} x LEFT JOIN bs_{k}_{i} b ON x.node = b.node)""")
        ctes.append(f"lf_{k} AS (SELECT node, -{ETA} * sum(g) / (sum(h) + {lam}) AS w "
                    f"FROM tr_{k}_{depth} GROUP BY node)")
        for s in ("tr", "te"):
            ctes.append(f"{s}_{k + 1} AS (SELECT y, f0, f1, m + coalesce(w, 0) AS m FROM {s}_{k}_{depth} x "
                        f"LEFT JOIN lf_{k} l ON x.node = l.node)")
        leaves.append(f"SELECT {k} AS round, node, w FROM lf_{k}")
    ctes.append(f"sc AS (SELECT y, CASE WHEN m > 0 THEN 1 ELSE 0 END AS p FROM te_{ROUNDS})")
    return with_ol(", " + ",\n".join(ctes) + f"""
SELECT CAST(l.round AS INTEGER) AS round, CAST(l.node AS INTEGER) AS node, round(l.w, 6) AS weight,
       k.n, k.tp, k.fp, k.fn, k.tn
FROM ({' UNION ALL '.join(leaves)}) l, ({confusion_sql('sc')}) k""")


def _boosted(spark, lines, label: str, weight: str | None):
    train, test = split(lines.withColumn("label", F.col(label).cast("double")))
    if weight:
        train = balanced(train, weight)
    m = boosted_trees_fit(train, BOOST_FEATURES, "label", rounds=ROUNDS, max_depth=2, eta=ETA,
                          lam=BOOST_LAMBDA, edges=BOOST_EDGES, weight=weight)
    counts = confusion(m.transform_columns(test, BOOST_FEATURES, "prediction"))
    rows = []
    for k, (levels, leaf) in enumerate(m.trees):
        inner = {2 ** lv.depth - 1 + i for lv in levels for i, f in enumerate(lv.feature) if f >= 0}
        reached = {0} | {c for n in inner for c in (2 * n + 1, 2 * n + 2)}
        rows += [(k, n, round(leaf[n], 6)) for n in sorted(reached - inner)]
    leaves = spark.createDataFrame(rows, "round int, node int, weight double")
    return leaves.join(F.broadcast(counts.select("n", "tp", "fp", "fn", "tn")), F.lit(True))


@register("fraud_weighted_boosting", _boost_sql("fraud", True, False))
def q_fraud_weighted_boosting(spark, sf_dir):
    """Two weighted boosting rounds of depth two for fraud: leaves and counts."""
    return _boosted(spark, order_lines(spark, sf_dir), "fraud", "weight")


@register("boosted_trees_missing", _boost_sql("late", False, True))
def q_boosted_trees_missing(spark, sf_dir):
    """Two boosting rounds of depth two for late delivery where many order days
    are missing, more of them on late lines: default directions, leaves, counts."""
    lines = order_lines(spark, sf_dir)
    hide = md5_bucket(F.concat_ws("|", "order_key", "line_number"), 10) < F.when(
        F.col("late") == 1, HIDDEN[1]).otherwise(HIDDEN[0])
    lines = lines.withColumn("order_day", F.when(~hide, F.col("order_day")))
    return _boosted(spark, lines, "late", None)


# -------------------------------------------------- C8: weighted quantiles
EIGHTHS = [i / 8 for i in range(1, 8)]
SKETCHED = ["order_day", "l_quantity"]


def _quantiles_sql() -> str:
    parts = [f"""
SELECT '{c}' AS feature, share, min(v) AS value
  FROM (SELECT *, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER () AS total
        FROM (SELECT CAST({c} AS DOUBLE) AS v, sum(round(l_tax * 100) + 1)::DOUBLE AS w FROM tr GROUP BY 1)),
       (SELECT range / 8.0::DOUBLE AS share FROM range(1, 8))
  WHERE upto >= share * total GROUP BY share""" for c in SKETCHED]
    return with_ol(" UNION ALL ".join(parts))


@register("weighted_quantiles", _quantiles_sql())
def q_weighted_quantiles(spark, sf_dir):
    """Eighths of the weight of the training lines by order day and quantity,
    from merged summaries (exact, as both have fewer distinct values than those
    have entries); a line weighs one more than its tax in per cent."""
    train, _ = split(order_lines(spark, sf_dir))
    train = train.withColumn("w", F.round(F.col("l_tax") * 100) + 1)
    found = weighted_quantiles(train, SKETCHED, "w", EIGHTHS, size=4096)
    return spark.createDataFrame([(c, s, v) for c, vs in found.items() for s, v in zip(EIGHTHS, vs)],
                                 "feature string, share double, value double")


# ------------------------------------------------------------ E1: intervals
REPLICATES, BOOT_SEED = 100, 11


def _intervals_sql() -> str:
    ctes, parts = closed_form_parts(["late"], "te.order_key, ")
    models = list(MODELS)
    cell = {"tp": "y = 1 AND p = 1", "fp": "y <> 1 AND p = 1", "fn": "y = 1 AND p <> 1",
            "tn": "y <> 1 AND p <> 1"}
    counts = ", ".join(f"sum(CASE WHEN model = '{m}' AND {c} THEN 1 ELSE 0 END) AS {n}{i}"
                       for i, m in enumerate(models) for n, c in cell.items())
    u = f"('0x' || substr(md5(concat_ws('|', {BOOT_SEED}, order_key, r)), 1, 8))::UBIGINT"
    copies = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in poisson_cuts())
    sums = ", ".join(f"sum(w * {n}{i})::DOUBLE AS {n}{i}" for i in range(len(models)) for n in cell)
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    value = {}
    for i, m in enumerate(models):
        value[m, "", "accuracy"] = ratio(f"tp{i} + tn{i}", f"tp{i} + fp{i} + fn{i} + tn{i}")
        value[m, "", "recall"] = ratio(f"tp{i}", f"tp{i} + fn{i}")
        value[m, "", "f1"] = ratio(f"2 * tp{i}", f"2 * tp{i} + fp{i} + fn{i}")
    a, b = models
    for metric in ("accuracy", "recall", "f1"):
        value[a, b, metric] = f"{value[a, '', metric]} - {value[b, '', metric]}"
    long = " UNION ALL ".join(f"SELECT r, '{m}' AS model, '{o}' AS against, '{n}' AS metric, {v} AS v FROM s"
                              for (m, o, n), v in value.items())
    return with_ol(", " + ",".join(ctes) + f""", sc AS ({' UNION ALL '.join(parts)}),
k AS (SELECT order_key, {counts} FROM sc GROUP BY order_key),
d AS (SELECT *, CASE WHEN r < 0 THEN 1 ELSE {copies} END AS w FROM
      (SELECT k.*, range AS r, {u.replace(', r)', ', range)')} AS u FROM k, range(-1, {REPLICATES}))),
s AS (SELECT r, {sums} FROM d GROUP BY r),
g AS ({long})
SELECT 'late' AS task, model, against, metric, round(max(CASE WHEN r < 0 THEN v END), 6) AS estimate,
       round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.025), 6) AS low,
       round(quantile_cont(CASE WHEN r >= 0 THEN v END, 0.975), 6) AS high
FROM g GROUP BY model, against, metric""")


@register("compare_intervals", _intervals_sql())
def q_compare_intervals(spark, sf_dir):
    """Late delivery by naive Bayes and the discriminant: 95 % intervals of the
    metrics and of their differences, orders drawn 100 times."""
    lines = held_lines(order_lines(spark, sf_dir), "late", NB_FEATURES, [])
    preds = {}
    for name, make in MODELS.items():
        pred = predict_late(lines, make(), numeric=NB_FEATURES, categorical=[], scale=False)
        preds["late", name] = pred
    out = checkpoint(bootstrap(preds, "order_key", replicates=REPLICATES, seed=BOOT_SEED))
    lines.unpersist()
    return out
