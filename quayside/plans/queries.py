"""Registered queries: each reads the driver's tables at ``sf_dir`` whole.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE_SQL[name]``
is the same computation in plain SQL for DuckDB (views named after the
tables).  Reals are rounded on both sides; counts are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.base import as_array
from ..operators.metrics import confusion
from ..operators.naive_bayes import gaussian_nb
from ..operators.profile import profile
from ..operators.split import split, split_sides
from ..sources.tables import order_lines

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL parts
# The order_lines view in SQL, shared by the oracle strings below.
ORDER_LINES_SQL = """
SELECT l.l_orderkey AS order_key,
       l.l_linenumber AS line_number,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS INTEGER) AS order_day,
       CAST(CASE WHEN date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) > 30
                 THEN 1 ELSE 0 END AS INTEGER) AS late,
       CAST(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS fraud,
       l.l_extendedprice * (1 - l.l_discount) AS revenue,
       l.l_quantity AS quantity,
       l.l_quantity, l.l_discount, l.l_tax, p.p_size, p.p_retailprice,
       c.c_acctbal, o.o_orderpriority, c.c_mktsegment, p.p_type
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

# md5 bucket of the order key, as in functions.hashing.md5_bucket
SPLIT_BUCKET_SQL = "(('0x' || substr(md5(CAST(order_key AS VARCHAR)), 1, 8))::UBIGINT % 10)"


def with_ol(body: str) -> str:
    return (f"WITH ol AS ({ORDER_LINES_SQL}),\n"
            f"tr AS (SELECT * FROM ol WHERE {SPLIT_BUCKET_SQL} < 8),\n"
            f"te AS (SELECT * FROM ol WHERE {SPLIT_BUCKET_SQL} >= 8)\n{body}")


def confusion_sql(src: str, by: str = "") -> str:
    """Confusion counts and ratios over ``src`` with columns y, p (0/1)."""
    sel_by = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel_by}n, tp, fp, fn, tn,
  round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
  round(CASE WHEN n > 0 THEN ((tp + fn) * (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END)
        + (tn + fp) * (CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END)) / n
        ELSE 0.0 END, 6) AS f1_weighted
FROM (SELECT {sel_by}CAST(count(*) AS BIGINT) AS n,
        CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN y <> 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN y = 1 AND p <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN y <> 1 AND p <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
      FROM {src} {grp}) c
"""


# ------------------------------------------------------------------ D1
@register("order_lines", ORDER_LINES_SQL)
def q_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir)


# ------------------------------------------------------------------ D2
PROFILE_COLS = ["order_day", "l_quantity", "l_discount"]


def _profile_sql() -> str:
    cols = PROFILE_COLS
    parts = ["CAST(count(*) AS BIGINT) AS n"]
    for c in cols:
        parts += [f"round(avg({c}), 6) AS mean_{c}", f"round(var_pop({c}), 4) AS var_{c}",
                  f"CAST(min({c}) AS DOUBLE) AS min_{c}", f"CAST(max({c}) AS DOUBLE) AS max_{c}"]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"round(covar_pop({a}, {b}), 4) AS cov_{a}_{b}")
    return (f"WITH ol AS ({ORDER_LINES_SQL}) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, "
            f"* EXCLUDE (label, n) FROM (SELECT late AS label, {', '.join(parts)} FROM ol GROUP BY late) g")


@register("profile_late", _profile_sql())
def q_profile_late(spark, sf_dir):
    p = profile(order_lines(spark, sf_dir), "late", PROFILE_COLS)
    out = [F.col("label"), F.col("n"), F.round("share", 6).alias("share")]
    for c in PROFILE_COLS:
        out += [F.round(f"mean_{c}", 6).alias(f"mean_{c}"),
                F.round(f"var_{c}", 4).alias(f"var_{c}"),
                F.col(f"min_{c}").cast("double").alias(f"min_{c}"),
                F.col(f"max_{c}").cast("double").alias(f"max_{c}")]
    for i, a in enumerate(PROFILE_COLS):
        for b in PROFILE_COLS[i + 1:]:
            out.append(F.round(f"cov_{a}_{b}", 4).alias(f"cov_{a}_{b}"))
    return p.select(*out)


# ------------------------------------------------------------------ E2
@register("split_counts", f"""WITH ol AS ({ORDER_LINES_SQL})
SELECT CASE WHEN {SPLIT_BUCKET_SQL} < 8 THEN 'train' ELSE 'test' END AS side,
       CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(DISTINCT order_key) AS BIGINT) AS n_orders,
       CAST(sum(late) AS BIGINT) AS n_late
FROM ol GROUP BY 1""")
def q_split_counts(spark, sf_dir):
    s = split_sides(order_lines(spark, sf_dir))
    return s.groupBy("side").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.countDistinct("order_key").cast("bigint").alias("n_orders"),
        F.sum("late").cast("bigint").alias("n_late"))


# ------------------------------------------------------------------ M1-M3
RULE_DAY = 1200


@register("metrics_rule", with_ol(confusion_sql(
    f"(SELECT late AS y, CASE WHEN order_day < {RULE_DAY} THEN 1 ELSE 0 END AS p FROM te)")))
def q_metrics_rule(spark, sf_dir):
    """The rule ``order_day < 1200`` as a late-delivery prediction on the
    held-out lines, judged by accuracy, recall and F1."""
    _, test = split(order_lines(spark, sf_dir))
    pred = test.select(F.col("late").alias("label"),
                       F.when(F.col("order_day") < RULE_DAY, 1).otherwise(0).alias("prediction"))
    return confusion(pred)


# ------------------------------------------------------------------ C3
NB_FEATURES = ["order_day", "l_quantity"]


def _gnb_sql() -> str:
    f = NB_FEATURES
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in f)
    # overall variance from the class moments, for the smoothing term
    over = ", ".join(
        f"sum(n * (v_{c} + (m_{c} - (SELECT avg({c}) FROM tr)) ^ 2)) / sum(n) AS o_{c}" for c in f)
    greatest = f"greatest({', '.join('o_' + c for c in f)})" if len(f) > 1 else f"o_{f[0]}"

    def dens(k):
        return " + ".join(
            f"(-0.5 * ln(2 * pi() * (m{k}.v_{c} + m{k}.eps)) - (te.{c} - m{k}.m_{c}) ^ 2 / (2 * (m{k}.v_{c} + m{k}.eps)))"
            for c in f)
    return with_ol(f"""
, st AS (SELECT late AS y, count(*) AS n, {stats} FROM tr GROUP BY late),
ov AS (SELECT {over} FROM st),
mdl AS (SELECT st.*, ln(n / (SELECT sum(n) FROM st)) AS lp, 1e-9 * {greatest} AS eps FROM st, ov),
sc AS (SELECT te.late AS y,
              CASE WHEN m1.lp + {dens(1)} > m0.lp + {dens(0)} THEN 1 ELSE 0 END AS p
       FROM te, (SELECT * FROM mdl WHERE y = 0) m0, (SELECT * FROM mdl WHERE y = 1) m1)
{confusion_sql('sc')}""")


@register("gaussian_nb_confusion", _gnb_sql())
def q_gaussian_nb_confusion(spark, sf_dir):
    """Late delivery by Gaussian naive Bayes on order day and quantity."""
    train, test = split(order_lines(spark, sf_dir))
    model = gaussian_nb(train, NB_FEATURES, label="late")
    pred = model.transform(test).select(F.col("late").alias("label"), "prediction")
    return confusion(pred)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_gaussian_nb_confusion(spark, sf_dir)


# ------------------------------------------------------------------ C2
def _lda2_sql() -> str:
    a, b = NB_FEATURES
    return with_ol(f"""
, st AS (SELECT late AS y, count(*) AS n, avg({a}) AS ma, avg({b}) AS mb,
                var_pop({a}) AS vaa, var_pop({b}) AS vbb, covar_pop({a}, {b}) AS vab
         FROM tr GROUP BY late),
pool AS (SELECT sum(n * vaa) / (sum(n) - count(*)) AS saa, sum(n * vbb) / (sum(n) - count(*)) AS sbb,
                sum(n * vab) / (sum(n) - count(*)) AS sab, sum(n) AS nt FROM st),
inv AS (SELECT sbb / (saa * sbb - sab * sab) AS iaa, saa / (saa * sbb - sab * sab) AS ibb,
               -sab / (saa * sbb - sab * sab) AS iab, nt FROM pool),
mdl AS (SELECT y, iaa * ma + iab * mb AS wa, iab * ma + ibb * mb AS wb,
               -0.5 * (ma * (iaa * ma + iab * mb) + mb * (iab * ma + ibb * mb)) + ln(n / nt) AS w0
        FROM st, inv),
sc AS (SELECT te.late AS y,
              CASE WHEN m1.w0 + m1.wa * te.{a} + m1.wb * te.{b} > m0.w0 + m0.wa * te.{a} + m0.wb * te.{b}
                   THEN 1 ELSE 0 END AS p
       FROM te, (SELECT * FROM mdl WHERE y = 0) m0, (SELECT * FROM mdl WHERE y = 1) m1)
{confusion_sql('sc')}""")


@register("discriminant_2d_confusion", _lda2_sql())
def q_discriminant_2d(spark, sf_dir):
    """Late delivery by linear discriminant analysis on order day and quantity."""
    from ..operators.discriminant import discriminant_fit
    train, test = split(order_lines(spark, sf_dir))
    model = discriminant_fit(train, NB_FEATURES, "late", ridge=0.0)
    return confusion(model.transform(test).select(F.col("late").alias("label"), "prediction"))


# ------------------------------------------------------------------ T3/T4
def _ols1(target: str, feature: str, slope_digits: int, intercept_digits: int):
    """One-feature OLS; both sides round to about nine significant digits
    (the engines sum in different orders and agree to about twelve)."""
    def q(spark, sf_dir):
        from ..operators.regression import ols_fit
        train, _ = split(order_lines(spark, sf_dir))
        m = ols_fit(train, [feature], target)
        return spark.createDataFrame(
            [(feature, round(float(m.coef[0]), slope_digits),
              round(float(m.intercept), intercept_digits))],
            "feature string, slope double, intercept double")
    sql = with_ol(f"""SELECT '{feature}' AS feature,
        round(regr_slope({target}, {feature}), {slope_digits}) AS slope,
        round(regr_intercept({target}, {feature}), {intercept_digits}) AS intercept FROM tr""")
    return q, sql


_q, _s = _ols1("revenue", "l_discount", 4, 4)
register("revenue_linear", _s)(_q)
_q, _s = _ols1("quantity", "order_day", 10, 6)
register("quantity_linear", _s)(_q)


# ------------------------------------------------------------------ C5
KNN_K = 5


@register("knn_exact", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS lab, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT q, t, lab, row_number() OVER (PARTITION BY q ORDER BY dist, lab, t) AS rk FROM d),
top AS (SELECT * FROM r WHERE rk <= {KNN_K}),
vote AS (SELECT q, lab, count(*) AS c, sum(rk) AS rs FROM top GROUP BY q, lab),
best AS (SELECT q, lab, row_number() OVER (PARTITION BY q ORDER BY c DESC, rs, lab) AS b FROM vote),
nb AS (SELECT q, string_agg(CAST(t AS VARCHAR), ',' ORDER BY rk) AS neighbors FROM top GROUP BY q)
SELECT e.vec_id, e.label, CAST(best.lab AS DOUBLE) AS prediction, nb.neighbors
FROM e JOIN best ON e.vec_id = best.q AND best.b = 1 JOIN nb ON nb.q = e.vec_id""")
def q_knn_exact(spark, sf_dir):
    """Leave-one-out 5-NN vote over every embedding (neighbours listed)."""
    from ..operators.knn import knn_neighbors, knn_vote
    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "embeddings")
    nb = knn_neighbors(e, e, "embedding", KNN_K, label="label", train_id="vec_id",
                       query_id="vec_id", exclude_self=True, method="codes")
    pred = knn_vote(nb, ["vec_id"])
    lists = nb.groupBy("vec_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank0", "tid"))),
                                 lambda s: s["tid"].cast("string")), ",").alias("neighbors"))
    return (e.select("vec_id", "label").join(pred, "vec_id").join(lists, "vec_id")
            .select("vec_id", "label", F.col("prediction").cast("double").alias("prediction"),
                    "neighbors"))


# ------------------------------------------------------------------ C7 step
ET_FEATURES = ["order_day", "l_quantity", "l_discount", "l_tax"]
ET_TREES, ET_K, ET_SEED = 4, 2, 7


def _et_sql() -> str:
    f = ET_FEATURES
    unp = " UNION ALL ".join(f"SELECT {i} AS feature, CAST({c} AS DOUBLE) AS v, late AS y FROM tr"
                             for i, c in enumerate(f))
    return with_ol(f"""
, t AS (SELECT range AS tree FROM range({ET_TREES})),
x AS ({unp}),
st AS (SELECT tree, feature, min(v) AS lo, max(v) AS hi, count(*) AS n,
              sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS c1
       FROM x, t GROUP BY tree, feature),
ca AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY
              ('0x' || substr(md5(concat_ws('|', '{ET_SEED}', tree, 0, feature, 'pick')), 1, 8))::UBIGINT, feature) AS r
       FROM st WHERE hi > lo),
cu AS (SELECT *, lo + ('0x' || substr(md5(concat_ws('|', '{ET_SEED}', tree, 0, feature)), 1, 8))::UBIGINT
                  / 4294967296.0 * (hi - lo) AS cut FROM ca WHERE r <= {ET_K}),
le AS (SELECT cu.tree, cu.feature, count(x.v) AS n_left,
              sum(CASE WHEN x.y = 1 THEN 1 ELSE 0 END) AS l1
       FROM cu LEFT JOIN x ON x.feature = cu.feature AND x.v <= cu.cut GROUP BY cu.tree, cu.feature),
g AS (SELECT cu.*, le.n_left, le.n_left - le.l1 AS l0, le.l1 FROM cu JOIN le USING (tree, feature)),
gg AS (SELECT *, (1 - (c0 / n) ^ 2 - (c1 / n) ^ 2)
            - n_left / n * (1 - (l0 / n_left) ^ 2 - (l1 / n_left) ^ 2)
            - (n - n_left) / n * (1 - ((c0 - l0) / (n - n_left)) ^ 2 - ((c1 - l1) / (n - n_left)) ^ 2) AS gain FROM g)
SELECT CAST(tree AS INTEGER) AS tree, CAST(feature AS INTEGER) AS feature, round(cut, 6) AS cut,
       CAST(n AS BIGINT) AS n, CAST(c1 AS BIGINT) AS n_late, CAST(n_left AS BIGINT) AS n_left,
       CAST(l1 AS BIGINT) AS n_left_late, round(gain, 8) AS gain,
       row_number() OVER (PARTITION BY tree ORDER BY gain DESC, feature) = 1 AS chosen
FROM gg""")


@register("extra_trees_level1", _et_sql())
def q_extra_trees_level1(spark, sf_dir):
    """Root level of an extra-trees forest on the training lines: drawn
    features, random cuts, class counts left of the cut, Gini gain and the
    chosen split per tree."""
    from ..operators.extra_trees import level_candidates
    train, _ = split(order_lines(spark, sf_dir))
    data = train.select(as_array(ET_FEATURES).alias("x"), F.col("late").cast("double").alias("y"))
    c = level_candidates(data, [], 0, [0.0, 1.0], ET_TREES, ET_K, ET_SEED)
    w = Window.partitionBy("tree").orderBy(
        F.desc("gain"), "feature")
    return c.select(F.col("tree").cast("int").alias("tree"), F.col("feature").cast("int").alias("feature"),
                    F.round("cut", 6).alias("cut"), F.col("n").cast("bigint").alias("n"),
                    F.col("c1").cast("bigint").alias("n_late"),
                    F.col("n_left").cast("bigint").alias("n_left"),
                    F.col("l1").cast("bigint").alias("n_left_late"),
                    F.round("gain", 8).alias("gain"),
                    (F.row_number().over(w) == 1).alias("chosen"))


# ------------------------------------------------------------------ C8 step
BOOST_FEATURES = ["order_day", "l_quantity"]
BOOST_EDGES = [[240.0 * i for i in range(1, 10)], [5.0 * i for i in range(1, 10)]]
BOOST_LAMBDA = 1.0


def _boost_sql() -> str:
    def bucket(c, edges):
        return "(" + " + ".join(f"CASE WHEN {c} >= {e} THEN 1 ELSE 0 END" for e in edges) + ")"
    unp = " UNION ALL ".join(
        f"SELECT {i} AS feature, {bucket(c, e)} AS bin, CAST(0.5 - late AS DOUBLE) AS g, "
        f"CAST(0.25 AS DOUBLE) AS h FROM tr"
        for i, (c, e) in enumerate(zip(BOOST_FEATURES, BOOST_EDGES)))
    lam = BOOST_LAMBDA
    return with_ol(f"""
, x AS ({unp}),
hg AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h FROM x GROUP BY feature, bin),
rs AS (SELECT feature, bin,
              sum(g) OVER (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING) AS gl,
              sum(h) OVER (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING) AS hl,
              sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM hg)
SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin,
       round(gl, 6) AS g_left, round(hl, 6) AS h_left,
       round(0.5 * (gl * gl / (hl + {lam}) + (gt - gl) ^ 2 / (ht - hl + {lam}) - gt * gt / (ht + {lam})), 6) AS gain
FROM rs""")


@register("boost_round1_gain", _boost_sql())
def q_boost_round1_gain(spark, sf_dir):
    """First boosting round at the root: g and h at margin 0, histogram over
    fixed bins, running sums and the second-order gain of every cut."""
    from ..operators.boosting import bin_columns, histogram_gains
    train, _ = split(order_lines(spark, sf_dir))
    b, bcols = bin_columns(train.select(*BOOST_FEATURES, "late"), BOOST_FEATURES, BOOST_EDGES)
    hist = (b.select(F.lit(0).alias("node"), (0.5 - F.col("late")).alias("g"), F.lit(0.25).alias("h"),
                     F.posexplode(F.array(*bcols)).alias("feature", "bin"))
            .groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
    gg = histogram_gains(hist, BOOST_LAMBDA, 0.0)
    return gg.select(F.col("feature").cast("int").alias("feature"), F.col("bin").cast("int").alias("bin"),
                     F.round("GL", 6).alias("g_left"), F.round("HL", 6).alias("h_left"),
                     F.round("gain", 6).alias("gain"))


# ------------------------------------------------------------------ C9 step
TREE_EDGES = [240.0 * i for i in range(1, 10)]


@register("tree_split_gain", with_ol(f"""
, hg AS (SELECT order_day, count(*) AS n, sum(late) AS p FROM tr GROUP BY order_day),
cuts AS (SELECT CAST(unnest({TREE_EDGES}) AS DOUBLE) AS cut),
s AS (SELECT cut, sum(CASE WHEN order_day < cut THEN n ELSE 0 END) AS nl,
             sum(CASE WHEN order_day < cut THEN p ELSE 0 END) AS pl, sum(n) AS nt, sum(p) AS pt
      FROM cuts, hg GROUP BY cut)
SELECT cut, CAST(nl AS BIGINT) AS n_left, CAST(pl AS BIGINT) AS late_left,
       round(CASE WHEN nt > 0 THEN
            (CASE WHEN nl > 0 THEN nl * (1 - (pl / nl) ^ 2 - (1 - pl / nl) ^ 2) ELSE 0 END
            + CASE WHEN nt > nl THEN (nt - nl) * (1 - ((pt - pl) / (nt - nl)) ^ 2
                - (1 - (pt - pl) / (nt - nl)) ^ 2) ELSE 0 END) / nt END, 8) AS impurity
FROM s"""))
def q_tree_split_gain(spark, sf_dir):
    """Decision-tree split criterion: weighted Gini impurity of the cuts
    'order_day < c' on the training lines, from a binned class histogram."""
    from ..operators.boosting import bin_columns
    train, _ = split(order_lines(spark, sf_dir))
    b, (bc,) = bin_columns(train.select("order_day", "late"), ["order_day"], [TREE_EDGES])
    hist = b.groupBy(F.col(bc).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("p"))
    # every cut has its row, whether or not a line lies in the bin below it
    cuts = spark.range(len(TREE_EDGES) + 1).select(F.col("id").cast("int").alias("bin"))
    hist = cuts.join(hist, "bin", "left").na.fill(0, ["n", "p"])
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    s = (hist.withColumn("nl", F.sum("n").over(run)).withColumn("pl", F.sum("p").over(run))
         .withColumn("nt", F.sum("n").over(tot)).withColumn("pt", F.sum("p").over(tot))
         .where(F.col("bin") < len(TREE_EDGES)))
    nl, pl, nt, pt = (F.col(c).cast("double") for c in ("nl", "pl", "nt", "pt"))
    part = lambda n, p: F.when(n > 0, n * (1 - (p / n) * (p / n) - (1 - p / n) * (1 - p / n))).otherwise(0.0)
    edges = F.element_at(F.array(*[F.lit(e) for e in TREE_EDGES]), (F.col("bin") + 1).cast("int"))
    return s.select(edges.alias("cut"), F.col("nl").cast("bigint").alias("n_left"),
                    F.col("pl").cast("bigint").alias("late_left"),
                    F.round(F.when(nt > 0, (part(nl, pl) + part(nt - nl, pt - pl)) / nt), 8).alias("impurity"))
