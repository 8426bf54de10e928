"""Model fits small enough to be unrolled in SQL, through the real fit paths.

Each query trains with the library's own estimator on the training lines and
reports held-out counts (and, where short, the model); its SQL does the same
steps with aggregates and windows.  They check split choice, leaf values,
weights and scoring at small depth; the full-size runs are in ``models``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import classifiers as C
from ..operators.boosting import boosted_trees_fit
from ..operators.discriminant import discriminant
from ..operators.extra_trees import extra_trees_fit
from ..operators.metrics import compare, confusion
from ..operators.naive_bayes import SqlNaiveBayes
from ..operators.regression import linear_regression, regression_metrics
from ..operators.split import split
from ..operators.tasks import (detect_fraud, fit_predict, labelled, predict_late,
                               predict_quantity, predict_revenue)
from ..session import scratch_folder
from ..sources.tables import order_lines
from .queries import (BOOST_EDGES, BOOST_FEATURES, BOOST_LAMBDA, ET_FEATURES, ET_K, ET_SEED,
                      ET_TREES, NB_FEATURES, confusion_sql, register, with_ol)

# ------------------------------------------------------- T1, T2, E1: C2 and C3
GOALS = {"fraud": detect_fraud, "late": predict_late}


def closed_form_parts(goals, extra: str = "", weighted: bool = False) -> tuple[list, list]:
    """CTEs that fit both models for each goal, and selects (task, model, y, p
    and ``extra`` columns) that score the held-out lines.  ``weighted`` gives
    both classes the same total weight."""
    a, b = NB_FEATURES
    ctes, parts = [], []
    for y in goals:
        size = ("(SELECT count(*) FROM tr) / 2.0::DOUBLE" if weighted else "count(*)")
        stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in NB_FEATURES)
        over = ", ".join(f"sum(n * (v_{c} + (m_{c} - (SELECT avg({c}) FROM tr)) ^ 2)) / sum(n) AS o_{c}"
                         for c in NB_FEATURES)
        dens = lambda k: " + ".join(
            f"(-0.5 * ln(2 * pi() * (m{k}.v_{c} + m{k}.eps)) - (te.{c} - m{k}.m_{c}) ^ 2 "
            f"/ (2 * (m{k}.v_{c} + m{k}.eps)))" for c in NB_FEATURES)
        ctes.append(f"""
{y}_st AS (SELECT {y} AS y, {size} AS n, {stats}, covar_pop({a}, {b}) AS vab FROM tr GROUP BY {y}),
{y}_ov AS (SELECT {over} FROM {y}_st),
{y}_nb AS (SELECT {y}_st.*, ln(n / (SELECT sum(n) FROM {y}_st)) AS lp,
                  1e-9 * greatest(o_{a}, o_{b}) AS eps FROM {y}_st, {y}_ov),
{y}_pool AS (SELECT sum(n * v_{a}) / (sum(n) - count(*)) AS saa, sum(n * v_{b}) / (sum(n) - count(*)) AS sbb,
                    sum(n * vab) / (sum(n) - count(*)) AS sab, sum(n) AS nt FROM {y}_st),
{y}_inv AS (SELECT sbb / (saa * sbb - sab * sab) AS iaa, saa / (saa * sbb - sab * sab) AS ibb,
                   -sab / (saa * sbb - sab * sab) AS iab, nt FROM {y}_pool),
{y}_ld AS (SELECT y, iaa * m_{a} + iab * m_{b} AS wa, iab * m_{a} + ibb * m_{b} AS wb,
                  -0.5 * (m_{a} * (iaa * m_{a} + iab * m_{b}) + m_{b} * (iab * m_{a} + ibb * m_{b}))
                  + ln(n / nt) AS w0 FROM {y}_st, {y}_inv)""")
        parts.append(f"""
SELECT '{y}' AS task, 'naive_bayes' AS model, {extra}te.{y} AS y,
       CASE WHEN m1.lp + {dens(1)} > m0.lp + {dens(0)} THEN 1 ELSE 0 END AS p
FROM te, (SELECT * FROM {y}_nb WHERE y = 0) m0, (SELECT * FROM {y}_nb WHERE y = 1) m1
UNION ALL
SELECT '{y}', 'discriminant', {extra}te.{y},
       CASE WHEN m1.w0 + m1.wa * te.{a} + m1.wb * te.{b} > m0.w0 + m0.wa * te.{a} + m0.wb * te.{b}
            THEN 1 ELSE 0 END
FROM te, (SELECT * FROM {y}_ld WHERE y = 0) m0, (SELECT * FROM {y}_ld WHERE y = 1) m1""")
    return ctes, parts


def _closed_form_sql() -> str:
    ctes, parts = closed_form_parts(GOALS)
    return with_ol(", " + ",".join(ctes) + f", sc AS ({' UNION ALL '.join(parts)})\n"
                   + confusion_sql("sc", "task, model"))


@register("compare_closed_form", _closed_form_sql())
def q_compare_closed_form(spark, sf_dir):
    """Both classification goals by naive Bayes (SQL form) and discriminant,
    through ``detect_fraud``, ``predict_late`` and ``compare``."""
    lines = order_lines(spark, sf_dir)
    made = {"naive_bayes": SqlNaiveBayes, "discriminant": lambda: discriminant(ridge=0.0)}
    return compare({(task, name): run(lines, make(), numeric=NB_FEATURES, categorical=[],
                                      scale=False, balance=False)
                    for task, run in GOALS.items() for name, make in made.items()})


@register("compare_reloaded", _closed_form_sql())
def q_compare_reloaded(spark, sf_dir):
    """The same comparison by models that were saved and loaded again: the
    held-out lines are scored by what the folder holds."""
    lines = order_lines(spark, sf_dir)
    made = {"naive_bayes": SqlNaiveBayes, "discriminant": lambda: discriminant(ridge=0.0)}
    preds = {}
    for task in GOALS:
        rows = labelled(lines, task)
        for name, make in made.items():
            _, model = fit_predict(rows, make(), NB_FEATURES, [], scale=False, task=task)
            path = scratch_folder(spark, f"model-{task}-{name}")
            model.save(path)
            preds[task, name] = PipelineModel.load(path).transform(split(rows)[1])
    return compare(preds)


# ------------------------------------------------------------- T3, T4: OLS
def _plane(goal: str, run, features: list[str]):
    a, b = features

    def q(spark, sf_dir):
        pred = run(order_lines(spark, sf_dir), linear_regression(), numeric=features,
                   categorical=[], scale=False)
        m = regression_metrics(pred, digits=None)
        return m.select("n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"),
                        F.round("r2", 6).alias("r2"))
    q.__doc__ = f"Held-out error of least squares for {goal} on {a} and {b}."
    return q, with_ol(f"""
, m AS (SELECT avg({a}) AS ma, avg({b}) AS mb, avg({goal}) AS mt, var_pop({a}) AS aa,
               var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {goal}) AS ca,
               covar_pop({b}, {goal}) AS cb FROM tr),
w AS (SELECT *, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS wa,
             (cb * aa - ca * ab) / (aa * bb - ab * ab) AS wb FROM m),
e AS (SELECT te.{goal} AS t, te.{goal} - (mt + wa * (te.{a} - ma) + wb * (te.{b} - mb)) AS e FROM te, w)
SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae,
       round(1 - sum(e * e) / (var_pop(t) * count(*)), 6) AS r2 FROM e""")


for _goal, _run, _features in (("revenue", predict_revenue, ["l_discount", "l_quantity"]),
                               ("quantity", predict_quantity, ["order_day", "l_discount"])):
    _q, _s = _plane(_goal, _run, _features)
    register(f"{_goal}_plane", _s)(_q)


# --------------------------------------------------------------------- C1
def _newton_sql(steps: int = 12) -> str:
    ctes = ["h AS (SELECT order_day / 1000.0::DOUBLE AS x, count(*)::DOUBLE AS n, sum(late)::DOUBLE AS p "
            "FROM tr GROUP BY order_day)", "b0 AS (SELECT 0.0::DOUBLE AS c, 0.0::DOUBLE AS w)"]
    for i in range(steps):
        ctes.append(f"""s{i} AS (SELECT any_value(c) AS c, any_value(w) AS w, sum(p - n * q) AS g0,
  sum(x * (p - n * q)) AS g1, sum(n * q * (1 - q)) AS h00, sum(x * n * q * (1 - q)) AS h01,
  sum(x * x * n * q * (1 - q)) AS h11 FROM (SELECT *, 1 / (1 + exp(-(c + w * x))) AS q FROM h, b{i}))""")
        ctes.append(f"""b{i + 1} AS (SELECT c + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS c,
  w + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w FROM s{i})""")
    return with_ol(", " + ",\n".join(ctes) + f""",
sc AS (SELECT te.late AS y, CASE WHEN c + w * (order_day / 1000.0::DOUBLE) > 0 THEN 1 ELSE 0 END AS p
       FROM te, b{steps})
SELECT round(b{steps}.w, 4) AS weight, round(b{steps}.c, 4) AS intercept, k.*
FROM b{steps}, ({confusion_sql('sc')}) k""")


@register("logistic_newton", _newton_sql())
def q_logistic_newton(spark, sf_dir):
    """Logistic regression of late on the order day: weights and held-out
    counts, against Newton steps on the histogram of days."""
    lines = order_lines(spark, sf_dir).withColumn("day", F.col("order_day") / 1000.0)
    from ..operators.tasks import fit_predict, labelled
    pred, model = fit_predict(labelled(lines, "late"), C.logistic(tol=1e-12, maxIter=200),
                              ["day"], [], scale=False)
    fitted = model.stages[-1]
    return confusion(pred).select(
        F.lit(round(float(fitted.coefficients[0]), 4)).alias("weight"),
        F.lit(round(float(fitted.intercept), 4)).alias("intercept"), "*")


# --------------------------------------------------------------------- C4
SVM_REG = 0.01


def _svm_sql(levels: int = 7) -> str:
    """The least regularised hinge loss by a grid that narrows around its best
    point (the objective is convex)."""
    ctes = ["h AS (SELECT order_day / 1000.0::DOUBLE AS x, late, count(*)::DOUBLE AS n FROM tr "
            "GROUP BY order_day, late)", "g0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS c, 0.0::DOUBLE AS f)"]
    step = 1.0
    for i in range(levels):
        ctes.append(f"""g{i + 1} AS (SELECT w, c, sum(n * greatest(0, 1 - (2 * late - 1) * (c + w * x))) / sum(n)
  + {SVM_REG} / 2.0::DOUBLE * w * w AS f FROM h, (SELECT g.w + a.range * {step}::DOUBLE AS w,
  g.c + b.range * {step}::DOUBLE AS c FROM g{i} g, range(-10, 11) a, range(-10, 11) b)
  GROUP BY w, c ORDER BY f, w, c LIMIT 1)""")
        step /= 4
    return with_ol(", " + ",\n".join(ctes) + f"\nSELECT round(f, 3) AS objective FROM g{levels}")


@register("svm_objective", _svm_sql())
def q_svm_objective(spark, sf_dir):
    """Regularised hinge loss reached by the linear SVM of late on the order
    day, against the least one found on a grid."""
    from ..operators.tasks import fit_predict, labelled
    lines = order_lines(spark, sf_dir).withColumn("day", F.col("order_day") / 1000.0)
    _, model = fit_predict(labelled(lines, "late"), C.linear_svm(
        maxIter=300, regParam=SVM_REG, tol=1e-10, standardization=False), ["day"], [], scale=False)
    w, c = float(model.stages[-1].coefficients[0]), float(model.stages[-1].intercept)
    train, _ = split(lines)
    hinge = F.greatest(F.lit(0.0), 1 - (2 * F.col("late") - 1) * (c + w * F.col("day")))
    return train.agg(F.round(F.avg(hinge) + SVM_REG / 2 * w * w, 3).alias("objective"))


# ----------------------------------------------------------------- C6, C9
DAY_STEP, QUANTITY_STEP = 240, 5


def _cart_sql(depth: int = 2) -> str:
    """CART on two binned features, level by level; node ids are heap-style."""
    gini = lambda n, p: f"(CASE WHEN {n} > 0 THEN {n} * (1 - ({p} / {n}) ^ 2 - (1 - {p} / {n}) ^ 2) ELSE 0 END)"
    sel = (f"late AS y, floor(order_day / {DAY_STEP}.0) AS f0, "
           f"floor(l_quantity / {QUANTITY_STEP}.0) AS f1, 0 AS node")
    ctes = [f"tr0 AS (SELECT {sel} FROM tr)", f"te0 AS (SELECT {sel} FROM te)"]
    for i in range(depth):
        ctes.append(f"""hg{i} AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM (
  SELECT node, 0 AS f, f0 AS v, y FROM tr{i} UNION ALL SELECT node, 1, f1, y FROM tr{i})
  GROUP BY node, f, v)""")
        ctes.append(f"""rs{i} AS (SELECT node, f, v,
  sum(n) OVER (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS nl,
  sum(p) OVER (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS pl,
  sum(n) OVER (PARTITION BY node, f) AS nt, sum(p) OVER (PARTITION BY node, f) AS pt FROM hg{i})""")
        ctes.append(f"""bs{i} AS (SELECT node, f, v FROM (
  SELECT node, f, v, row_number() OVER (PARTITION BY node ORDER BY imp, f, v) AS r FROM (
    SELECT *, {gini('nl', 'pl')} + {gini('(nt - nl)', '(pt - pl)')} AS imp FROM rs{i}
    WHERE nl < nt AND pt > 0 AND pt < nt)
  WHERE imp < {gini('nt', 'pt')}) WHERE r = 1)""")
        for t in ("tr", "te"):
            ctes.append(f"""{t}{i + 1} AS (SELECT y, f0, f1, CASE WHEN b.f IS NULL THEN x.node
  WHEN CASE WHEN b.f = 0 THEN f0 ELSE f1 END <= b.v THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node
  FROM {t}{i} x LEFT JOIN bs{i} b ON x.node = b.node)""")
    ctes.append(f"leaf AS (SELECT node, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS p "
                f"FROM tr{depth} GROUP BY node)")
    ctes.append(f"sc AS (SELECT x.y, leaf.p FROM te{depth} x JOIN leaf ON x.node = leaf.node)")
    return with_ol(", " + ",\n".join(ctes) + confusion_sql("sc"))


def _cart_query(make):
    def q(spark, sf_dir):
        lines = order_lines(spark, sf_dir).withColumn(
            "day_bin", F.floor(F.col("order_day") / DAY_STEP)).withColumn(
            "quantity_bin", F.floor(F.col("l_quantity") / QUANTITY_STEP))
        return confusion(predict_late(lines, make(), numeric=["day_bin", "quantity_bin"],
                                      categorical=[], scale=False))
    return q


register("decision_tree_depth2", _cart_sql())(_cart_query(
    lambda: C.decision_tree(maxDepth=2, maxBins=64)))
register("random_forest_one_tree", _cart_sql())(_cart_query(
    lambda: C.random_forest(numTrees=1, maxDepth=2, maxBins=64, bootstrap=False,
                            featureSubsetStrategy="all")))


# --------------------------------------------------------------------- C7
def _forest_sql(depth: int = 2) -> str:
    f = ET_FEATURES
    u = lambda *p: ("('0x' || substr(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 8))::UBIGINT")
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(f))
    value = "CASE c.feature " + " ".join(f"WHEN {i} THEN x.f{i}" for i in range(len(f))) + " END"
    ctes = [f"t AS (SELECT range AS tree FROM range({ET_TREES}))"]
    for s in ("tr", "te"):
        ctes.append(f"{s}0 AS (SELECT row_number() OVER () AS id, tree, 0::BIGINT AS node, late AS y, {cols} "
                    f"FROM {s}, t)")
    for i in range(depth):
        long = " UNION ALL ".join(f"SELECT tree, node, {j} AS feature, f{j} AS v, y FROM tr{i}"
                                  for j in range(len(f)))
        ctes.append(f"st{i} AS (SELECT tree, node, feature, min(v) AS lo, max(v) AS hi, count(*) AS n, "
                    f"sum(y) AS c1 FROM ({long}) GROUP BY tree, node, feature)")
        ctes.append(f"""ca{i} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY
  {u(f"'{ET_SEED}'", 'tree', 'node', 'feature', "'pick'")}, feature) AS r FROM st{i}
  WHERE hi > lo AND n >= 2 AND c1 > 0 AND c1 < n)""")
        ctes.append(f"""cu{i} AS (SELECT *, lo + {u(f"'{ET_SEED}'", 'tree', 'node', 'feature')}
  / 4294967296.0::DOUBLE * (hi - lo) AS cut FROM ca{i} WHERE r <= {ET_K})""")
        ctes.append(f"""le{i} AS (SELECT c.tree, c.node, c.feature, any_value(c.cut) AS cut,
  any_value(c.n)::DOUBLE AS n, any_value(c.c1)::DOUBLE AS p,
  sum(CASE WHEN {value} <= c.cut THEN 1.0 ELSE 0.0 END)::DOUBLE AS nl,
  sum(CASE WHEN {value} <= c.cut THEN y ELSE 0 END)::DOUBLE AS pl
  FROM cu{i} c JOIN tr{i} x ON c.tree = x.tree AND c.node = x.node GROUP BY c.tree, c.node, c.feature)""")
        g = lambda n, p: f"(CASE WHEN {n} > 0 THEN 1 - ({p} / {n}) * ({p} / {n}) - (({n} - {p}) / {n}) * (({n} - {p}) / {n}) ELSE 0 END)"
        ctes.append(f"""bs{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY
  round({g('n', 'p')} - nl / n * {g('nl', 'pl')} - (n - nl) / n * {g('(n - nl)', '(p - pl)')}, 12) DESC,
  feature) AS r FROM le{i}) WHERE r = 1)""")
        for s in ("tr", "te"):
            ctes.append(f"""{s}{i + 1} AS (SELECT x.* REPLACE (CASE WHEN c.feature IS NULL THEN x.node
  WHEN {value} <= c.cut THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node)
  FROM {s}{i} x LEFT JOIN bs{i} c ON c.tree = x.tree AND c.node = x.node)""")
    # test rows are numbered per (line, tree): lines are told apart by a number of their own
    ctes[2] = ctes[2].replace("FROM te, t)", "FROM (SELECT *, row_number() OVER () AS line FROM te) te, t)"
                              ).replace("late AS y", "late AS y, line")
    ctes.append(f"leaf AS (SELECT tree, node, sum(y) / count(*) AS s FROM tr{depth} GROUP BY tree, node)")
    ctes.append(f"""sc AS (SELECT any_value(x.y) AS y, CASE WHEN round(avg(leaf.s), 9) > 0.5 THEN 1 ELSE 0 END AS p
  FROM te{depth} x JOIN leaf ON x.tree = leaf.tree AND x.node = leaf.node GROUP BY line)""")
    return with_ol(", " + ",\n".join(ctes) + confusion_sql("sc"))


@register("extra_trees_depth2", _forest_sql())
def q_extra_trees_depth2(spark, sf_dir):
    """Held-out counts of an extra-trees forest of depth two, as fitted."""
    train, test = split(order_lines(spark, sf_dir))
    m = extra_trees_fit(train, ET_FEATURES, "late", num_trees=ET_TREES, max_depth=2,
                        k_features=ET_K, seed=ET_SEED)
    return confusion(m.transform_columns(test, ET_FEATURES, "prediction"), label="late")


# --------------------------------------------------------------------- C8
ETA, ROUNDS = 0.3, 2


def _boost_sql(depth: int = 2) -> str:
    bucket = lambda c, e: "(" + " + ".join(f"CASE WHEN {c} >= {v} THEN 1 ELSE 0 END" for v in e) + ")"
    cols = ", ".join(f"{bucket(c, e)} AS f{i}" for i, (c, e) in enumerate(zip(BOOST_FEATURES, BOOST_EDGES)))
    ctes = [f"{s}_0 AS (SELECT late AS y, {cols}, 0.0::DOUBLE AS m FROM {s})" for s in ("tr", "te")]
    lam, leaves = BOOST_LAMBDA, []
    for k in range(ROUNDS):
        ctes.append(f"tr_{k}_0 AS (SELECT *, 0 AS node, q - y AS g, q * (1 - q) AS h FROM "
                    f"(SELECT *, 1 / (1 + exp(-m)) AS q FROM tr_{k}))")
        ctes.append(f"te_{k}_0 AS (SELECT *, 0 AS node FROM te_{k})")
        for i in range(depth):
            ctes.append(f"""hg_{k}_{i} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM (
  SELECT node, 0 AS f, f0 AS v, g, h FROM tr_{k}_{i} UNION ALL SELECT node, 1, f1, g, h FROM tr_{k}_{i})
  WHERE node >= {2 ** i - 1} GROUP BY node, f, v)""")
            ctes.append(f"""rs_{k}_{i} AS (SELECT node, f, v,
  sum(g) OVER (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS gl,
  sum(h) OVER (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS hl,
  sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht FROM hg_{k}_{i})""")
            ctes.append(f"""bs_{k}_{i} AS (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node
  ORDER BY gain DESC, f, v) AS r FROM (SELECT *, round(0.5 * (gl * gl / (hl + {lam}) + (gt - gl) ^ 2
  / (ht - hl + {lam}) - gt * gt / (ht + {lam})), 7) AS gain FROM rs_{k}_{i} WHERE hl >= 1 AND ht - hl >= 1)
  WHERE gain > 0) WHERE r = 1)""")
            for s in ("tr", "te"):
                ctes.append(f"""{s}_{k}_{i + 1} AS (SELECT x.* REPLACE (CASE WHEN b.f IS NULL THEN x.node
  WHEN CASE WHEN b.f = 0 THEN f0 ELSE f1 END <= b.v THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node)
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


@register("boosted_trees_two_rounds", _boost_sql())
def q_boosted_trees_two_rounds(spark, sf_dir):
    """Two boosting rounds of depth two on fixed bins: the leaves' weights, and
    the model's held-out counts beside each."""
    train, test = split(order_lines(spark, sf_dir))
    m = boosted_trees_fit(train, BOOST_FEATURES, "late", rounds=ROUNDS, max_depth=2, eta=ETA,
                          lam=BOOST_LAMBDA, edges=BOOST_EDGES)
    counts = confusion(m.transform_columns(test, BOOST_FEATURES, "prediction"), label="late")
    rows = []
    for k, (levels, leaf) in enumerate(m.trees):
        inner = {2 ** lv.depth - 1 + i for lv in levels for i, f in enumerate(lv.feature) if f >= 0}
        reached = {0} | {c for n in inner for c in (2 * n + 1, 2 * n + 2)}
        rows += [(k, n, round(leaf[n], 6)) for n in sorted(reached - inner)]
    leaves = spark.createDataFrame(rows, "round int, node int, weight double")
    return leaves.join(F.broadcast(counts.select("n", "tp", "fp", "fn", "tn")), F.lit(True))
