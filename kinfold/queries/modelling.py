"""Models (M), evaluation protocols (E12-E25) and audit (AU)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from kinfold.operators import audit
from kinfold.operators import benchmark as bench
from kinfold.operators import evaluation as ev
from kinfold.operators import metrics as met
from kinfold.operators import models as mod
from kinfold.operators import splits
from kinfold.operators.models import ModelSpec
from kinfold.operators.neighbours import knn_class, knn_join, knn_vote, probes_for, recall
from kinfold.plans.session import cut_lineage, table
from kinfold.queries.base import LINES, frame, query, r, rounded, sql_hash
from kinfold.queries.profiling import sql_spearman

# Labelled documents: quality flag, text counts, source as the cluster.
DOCS = """SELECT d.doc_id AS row_id, d.source AS group_id, quality AS y, CAST(n_chars AS DOUBLE) AS n_chars,
 CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces, CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS n_dots,
 CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) / length(text) END AS e_share, lang
 FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id"""
# Orders as a regression problem: price from date parts and priority, customer nation as cluster.
PRICES = """SELECT o_orderkey AS row_id, c_nationkey AS group_id, o_totalprice / 1000 AS y, CAST(month(o_orderdate) AS DOUBLE) AS m,
 CAST(year(o_orderdate) AS DOUBLE) AS yr, c_acctbal AS bal, o_orderpriority AS prio FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""
NUMERIC = ("n_chars", "n_spaces", "n_dots", "e_share")
SPEC = ModelSpec("tree", NUMERIC, ("lang",), params={"maxDepth": 4})
REG = ModelSpec("tree_reg", ("m", "yr", "bal"), ("prio",), params={"maxDepth": 4})


def doc_rows(spark, sf):
    return cut_lineage(frame(spark, sf, DOCS))


def within(low, high, *cols):
    """Whether all these are between the limits (and none is NaN), where they are known."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.col(c).between(low, high), F.lit(True))
    return F.bool_and(ok)


def score_summary(df, spec):
    """One row: every score must be present and lie in [0, 1], and so must what they rank to."""
    m = met.ranking_metrics(df, spec.label, "score")
    return df.agg(
        F.count("*").alias("n"), F.count("score").alias("n_scored"), within(0, 1, "score").alias("in_range"),
        (F.count_distinct("score") > 1).alias("several")
    ).withColumn("auc_in_range", m.agg(within(0, 1, "roc_auc", "pr_auc")).scalar())


def finite():
    """Regression metrics that must hold of any fit: finite, and an absolute error no greater than the root of the squared one."""
    return [F.greatest(*[F.abs(c) for c in ("r2", "rmse", "mae", "mbe", "nrmse")]).between(0, 1e12).alias("finite"),
            (F.col("mae") <= F.col("rmse") + 1e-9).alias("ordered")]


# What SQL knows of a model scored on a stratified fifth of the rows: how many there are.
HOLDOUT_ROWS = "(SELECT CAST(sum(k) AS BIGINT) AS n FROM (SELECT floor(count(*) * 0.2) AS k FROM c GROUP BY y))"
FITTED = f"WITH c AS ({DOCS}) SELECT n, n AS n_scored, true AS in_range, true AS several, true AS auc_in_range FROM {HOLDOUT_ROWS}"


def fitted_summary(spark, sf, spec):
    df = doc_rows(spark, sf)
    split = splits.stratified_holdout(df, "y", ["row_id"]).select("row_id", "is_test")
    data = cut_lineage(df.join(split, "row_id"))
    return score_summary(mod.fit(data.where(~F.col("is_test")), spec)(data.where("is_test")), spec)


@query("m1_passthrough_features", f"""WITH c AS ({DOCS}) SELECT row_id, CAST(4 + (SELECT count(DISTINCT coalesce(lang, 'Unknown')) FROM c) AS INT) AS width,
 {r(f'coalesce(e_share, {mod.MISSING!r})')} AS e_share, 1.0::DOUBLE AS one_hot_sum FROM c""")
def m1(spark, sf):
    df = doc_rows(spark, sf)
    out = mod.preprocessor(SPEC).fit(df).transform(df)
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    return rounded(out.select("row_id", F.size(v).alias("width"), v[3].alias("e_share"), F.aggregate(F.slice(v, F.lit(5), F.size(v)), F.lit(0.0), lambda a, x: a + x).alias("one_hot_sum")))


SC = "(v - avg(v) OVER ()) / stddev_samp(v) OVER ()"


@query("m2_scaled_features", f"""WITH c AS ({DOCS}), w AS (SELECT row_id, n_chars AS v FROM c) SELECT row_id, {r(SC, 5)} AS n_chars FROM w""")
def m2(spark, sf):
    df = doc_rows(spark, sf)
    from pyspark.ml.functions import vector_to_array
    out = mod.preprocessor(SPEC.but(scale=True)).fit(df).transform(df)
    return rounded(out.select("row_id", vector_to_array("features")[0].alias("n_chars")), 5)


@query("m3_decision_tree", FITTED)
def m3(spark, sf):
    return fitted_summary(spark, sf, SPEC)


@query("m3_decision_tree_regression", f"""WITH c AS ({PRICES}), g AS (SELECT group_id, row_number() OVER (ORDER BY {sql_hash(42, 'group_id')}, group_id)
 <= ceil(0.2 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT group_id FROM c)) SELECT count(*) AS n, true AS finite, true AS ordered FROM c JOIN g USING (group_id) WHERE is_test""")
def m3b(spark, sf):
    df = cut_lineage(frame(spark, sf, PRICES))
    h = splits.group_holdout(df, "group_id")
    data = splits.attach_groups(df, h, "group_id")
    out = mod.fit(data.where(~F.col("is_test")), REG)(data.where("is_test"))
    return met.regression_battery(out, "y", "score").select("n", *finite())


@query("m4_boosted_trees", FITTED)
def m4(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="boosted", params={"maxIter": 8, "maxDepth": 3}))


EMB = "SELECT vec_id, embedding, label FROM {embeddings}"


@query("m5_nearest_neighbours", f"""WITH p AS (SELECT a.vec_id, b.vec_id AS ref_id, b.label AS ref_label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
 lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id <> b.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ref_id) AS rank FROM p)
 SELECT vec_id, ref_id, ref_label, {r('dist', 5)} AS dist, CAST(rank AS INT) AS rank FROM t WHERE rank <= 5""")
def m5(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    ref = e.select(F.col("vec_id").alias("ref_id"), "v", F.col("label").alias("ref_label"))
    return rounded(knn_join(e.select("vec_id", "v"), ref, "vec_id", "v", 5, exclude_self=True), 5)


@query("m5_neighbour_class", f"""WITH p AS (SELECT a.vec_id, a.label, b.vec_id AS ref_id, b.label AS ref_label, list_sum(list_transform(list_zip(a.embedding, b.embedding),
 lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS dist FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id <> b.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ref_id) AS k FROM p), v AS (SELECT vec_id, label, ref_label, count(*) AS n FROM t WHERE k <= 7 GROUP BY ALL)
 SELECT vec_id, label, arg_min(ref_label, struct_pack(a := -n, b := ref_label)) AS predicted FROM v GROUP BY 1, 2""")
def m5b(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    ref = e.select(F.col("vec_id").alias("ref_id"), "v", F.col("label").alias("ref_label"))
    near = knn_join(e.select("vec_id", "v"), ref, "vec_id", "v", 7, "l1", exclude_self=True)
    return e.select("vec_id", "label").join(knn_class(near, "vec_id"), "vec_id")


@query("m5_neighbour_index", "SELECT count(*) AS queries, true AS found_enough, true AS none_nearer FROM {embeddings}")
def m5d(spark, sf):
    """The index form on every row, its probes set for 0.93 on a sample, measured against the exact answer."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    ref = e.select(F.col("vec_id").alias("ref_id"), "v", F.col("label").alias("ref_label"))
    rows = e.select("vec_id", "v")
    probes = probes_for(rows, ref, "vec_id", "v", 5, exclude_self=True, target=0.93)
    found = cut_lineage(knn_join(rows, ref, "vec_id", "v", 5, exclude_self=True, probes=probes))
    exact = cut_lineage(knn_join(rows, ref, "vec_id", "v", 5, exclude_self=True))
    pair = found.select("vec_id", "rank", "dist").join(exact.select("vec_id", "rank", F.col("dist").alias("best")), ["vec_id", "rank"])
    nearer = pair.agg(F.coalesce(F.min("dist") >= 0, F.lit(True)) & F.coalesce(F.min(F.col("dist") - F.col("best")) >= -1e-9, F.lit(True))).scalar()
    return recall(found, exact, "vec_id").select(
        "queries", (F.col("recall") >= 0.9).alias("found_enough"), nearer.alias("none_nearer"))


@query("m5_knn_classifier", FITTED)
def m5c(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="knn", params={"k": 9, "weights": "distance"}))


@query("m6_mlp", FITTED)
def m6(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="mlp", params={"hidden": [8], "maxIter": 40}))


@query("m7_svm_rbf", FITTED)
def m7(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="svm", params={"n_features": 32, "maxIter": 15}))


@query("m8_random_forest", FITTED)
def m8(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="forest", params={"numTrees": 20, "maxDepth": 5}))


def sql_focal(gamma: float) -> str:
    q = "greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-9)"
    g = f"{gamma}::DOUBLE"
    return f"""q AS (SELECT *, {q} AS q, greatest(1 - {q}, 1e-12) AS u, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM c),
 d AS (SELECT *, sg * ({g} * pow(u, {g}) * q * ln(q) - pow(u, {g}) * u) AS grad, greatest(q * u * ({g} * pow(u, {g}) * (1 + ln(q)) - {g} * {g} * pow(u, {g} - 1) * q * ln(q)
  + ({g} + 1) * pow(u, {g})), 1e-16) AS hess FROM q)"""


FOCAL_SRC = "SELECT y, l_suppkey, 1.0::DOUBLE / (1.0 + exp(-(p * 6 - 3))) AS p FROM (" + LINES + ")"


@query("m9_focal_gradient", f"WITH c AS ({FOCAL_SRC}), {sql_focal(2.0)} SELECT l_suppkey, {r('sum(grad)', 4)} AS grad, {r('sum(hess)', 4)} AS hess FROM d GROUP BY 1")
def m9(spark, sf):
    g, h = mod.focal_gradient(F.col("y"), F.col("p") * 6 - 3, 2.0)
    df = frame(spark, sf, LINES).select("l_suppkey", g.alias("g"), h.alias("h"))
    return rounded(df.groupBy("l_suppkey").agg(F.sum("g").alias("grad"), F.sum("h").alias("hess")), 4)


@query("m9_focal_boosting", FITTED)
def m9b(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="focal", params={"gamma": 1.0, "rounds": 3}))


SPLIT_SRC = f"SELECT l_suppkey AS group_id, y, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_suppkey % 7 AS DOUBLE) AS seven, CAST(l_suppkey % 4 AS DOUBLE) AS four FROM ({LINES})"


# In the first round all margins are 0, so the best split is the one that parts the classes best.
@query("m9_focal_first_split", f"""WITH c AS ({SPLIT_SRC}), l AS (SELECT * FROM (SELECT y, unnest([0, 1, 2]) AS feature, unnest([line, seven, four]) AS x FROM c)),
 v AS (SELECT feature, x, count(*)::DOUBLE AS w, sum(2 * y - 1)::DOUBLE AS s FROM l GROUP BY ALL),
 k AS (SELECT feature, x, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(w) OVER p AS wa, sum(s) OVER p AS sa, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx
 FROM v WINDOW o AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature))
 SELECT CAST(arg_max(feature, sl * sl / wl + pow(sa - sl, 2) / (wa - wl)) AS INT) AS feature,
 arg_max((x + nx) / 2, sl * sl / wl + pow(sa - sl, 2) / (wa - wl)) AS threshold FROM k WHERE nx IS NOT NULL""")
def m9c(spark, sf):
    spec = mod.ModelSpec("focal", ("line", "seven", "four"), (), params={"gamma": 1.0, "rounds": 1, "depth": 1})
    root = mod.fit_focal(frame(spark, sf, SPLIT_SRC), spec).trees[0]._java_obj.rootNode()
    return spark.createDataFrame([(root.split().featureIndex(), float(root.split().threshold()))], "feature int, threshold double")


@query("m10_bagged_groups", FITTED)
def m10(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(kind="bagged", params={"n_models": 2, "base": "tree", "maxDepth": 4}))


# A fit with an intercept has the mean score that the labels have.
@query("m11_sigmoid_calibration", f"WITH c AS ({LINES}) SELECT {r('avg(y)', 4)} AS mean_score, {r('avg(y)', 4)} AS rate, count(*) AS n FROM c")
def m11(spark, sf):
    df = frame(spark, sf, LINES).select("l_suppkey", "y", (F.col("p") * 4 - 2).alias("margin"))
    out = mod.fit_sigmoid(df, "margin", "y")(df)
    return rounded(out.agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"), F.count("*").alias("n")), 4)


@query("m12_weighted_fit", FITTED)
def m12(spark, sf):
    return fitted_summary(spark, sf, SPEC.but(group_weight="sqrt", class_weight=True))


# The fit at a value is the greatest over starts up to it of the least mean over ends from it.
@query("m13_monotone_feature", f"""WITH c AS ({LINES}), v AS (SELECT l_quantity AS x, sum(q) AS s, count(*) AS w FROM c GROUP BY 1),
 a AS (SELECT i.x AS i, j.x AS j, sum(m.s) / sum(m.w) AS mean FROM v i JOIN v j ON i.x <= j.x JOIN v m ON m.x BETWEEN i.x AND j.x GROUP BY ALL),
 b AS (SELECT v.x, a.i, min(a.mean) AS least FROM v JOIN a ON a.i <= v.x AND a.j >= v.x GROUP BY ALL)
 SELECT x, {r('max(least)')} AS monotone_score FROM b GROUP BY 1""")
def m13(spark, sf):
    df = frame(spark, sf, LINES).select("l_suppkey", F.col("l_quantity").alias("x"), F.col("q").alias("s"))
    out = mod.fit_monotone(df, "x", "s")(df).select("x", F.round("monotone_score", 6).alias("monotone_score"))
    return out.distinct()


@query("m14_tree_importance", "SELECT 5 AS features, true AS in_range, true AS adds_to_one")
def m14(spark, sf):
    df = doc_rows(spark, sf)
    imp = mod.tree_importance(mod.fit(df, SPEC), df)
    return mod.parent_importance(imp).agg(
        F.count("*").cast("int").alias("features"), within(0, 1, "importance").alias("in_range"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("adds_to_one"))


@query("m15_four_conditions", "SELECT * FROM (VALUES ('random', false), ('random', true), ('group', false), ('group', true)) t(strategy, augmented), (SELECT true AS finite, true AS ordered)")
def m15(spark, sf):
    df = frame(spark, sf, PRICES)
    pair = splits.holdout_pair(df, "group_id", "y", ["row_id"], 1)
    data = cut_lineage(df.join(pair.select("row_id", "random_test", "group_test"), "row_id"))
    pred = mod.four_conditions(data, REG, "random_test", "group_test", 500)
    return met.regression_battery(pred, "y_true", "y_pred", ["strategy", "augmented"]).select("strategy", "augmented", *finite())


# ---- protocols -------------------------------------------------------------------------

@query("e12_grouped_oof", f"WITH c AS ({DOCS}) SELECT count(*) AS n, count(*) AS n_scored, true AS in_range FROM c")
def e12(spark, sf):
    oof = bench.grouped_oof(doc_rows(spark, sf), SPEC, 3)
    return oof.agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


@query("e13_inner_thresholds", "SELECT 1 AS n, true AS in_range")
def e13(spark, sf):
    t = bench.inner_thresholds(doc_rows(spark, sf), SPEC, 3)
    return t.agg(F.count("*").cast("int").alias("n"), within(0, 1, *t.columns).alias("in_range"))


SCORES = ("roc_auc", "pr_auc", "f1", "balanced_accuracy", "thr_mcc", "thr_f1", "thr_balanced_accuracy", "thr_youden_j")


# Each row is tested once for every method and seed, and no group in two folds.
@query("e14_grouped_benchmark", f"""WITH c AS ({DOCS}) SELECT method, seed, 2 AS folds, count(*) AS n_test, count(DISTINCT group_id) AS n_test_groups, true AS in_range
 FROM c, (VALUES ('tree'), ('weighted tree')) m(method), (VALUES (42)) s(seed) GROUP BY method, seed""")
def e14(spark, sf):
    specs = {"tree": SPEC, "weighted tree": SPEC.but(group_weight="sqrt", class_weight=True)}
    return bench.grouped_benchmark(doc_rows(spark, sf), specs, (42,), 2, 2).groupBy("method", "seed").agg(
        F.count("*").cast("int").alias("folds"), F.sum("n_test").alias("n_test"), F.sum("n_test_groups").alias("n_test_groups"),
        within(0, 1, *SCORES).alias("in_range"))


@query("e15_row_benchmark", f"WITH c AS ({DOCS}) SELECT 'tree' AS method, 42 AS seed, n AS n_test, true AS in_range FROM {HOLDOUT_ROWS}")
def e15(spark, sf):
    return bench.row_benchmark(doc_rows(spark, sf), {"tree": SPEC}, "holdout", inner=2).groupBy("method", "seed").agg(
        F.sum("n_test").alias("n_test"), within(0, 1, *SCORES).alias("in_range"))


@query("e16_protocol_ladder", f"""WITH c AS ({DOCS}) SELECT protocol, n_fits, true AS in_range FROM (VALUES ('holdout', 1::BIGINT), ('stratified', 2), ('group', 2), ('stratified_group', 2), ('leave_one_group_out', 1)) t(protocol, n_fits)""")
def e16(spark, sf):
    t = bench.protocol_ladder(doc_rows(spark, sf), SPEC, 2)
    return t.groupBy("protocol").agg(F.sum("n_fits").alias("n_fits"), within(0, 1, "mean", "std").alias("in_range"))


@query("e17_leave_one_group_out", f"""WITH c AS ({DOCS}) SELECT method, group_id, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, true AS in_range
 FROM c, (VALUES ('tree'), ('stump')) m(method) GROUP BY method, group_id""")
def e17(spark, sf):
    df = doc_rows(spark, sf)
    out = bench.leave_one_group_out_table(df, {"tree": SPEC, "stump": SPEC.but(params={"maxDepth": 1})})
    m = met.ranking_metrics(out, "y", "score", ["method", "group_id"])
    return m.groupBy("method", "group_id").agg(
        F.sum("n_pos").cast("long").alias("n_pos"), F.sum("n_neg").cast("long").alias("n_neg"), within(0, 1, "roc_auc", "pr_auc").alias("in_range"))


@query("e19_random_search", "SELECT CAST(i AS INT) AS candidate, true AS in_range FROM range(3) t(i)")
def e19(spark, sf):
    c = bench.draw_candidates({"maxDepth": [2, 3, 5], "minInstancesPerNode": [1, 5]}, 3)
    return bench.grouped_search(doc_rows(spark, sf), SPEC, c, 2).groupBy("candidate").agg(within(0, 1, "roc_auc", "std").alias("in_range"))


@query("e20_grid_search", "SELECT CAST(i AS INT) AS candidate, true AS in_range FROM range(2) t(i)")
def e20(spark, sf):
    c = bench.sample_grid({"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}, 2)
    return bench.grouped_search(doc_rows(spark, sf), SPEC, c, 2).groupBy("candidate").agg(within(0, 1, "roc_auc", "std").alias("in_range"))


@query("e21_regression_search", "SELECT CAST(i AS INT) AS candidate, true AS in_range FROM range(3) t(i)")
def e21(spark, sf):
    c = bench.draw_candidates({"maxDepth": [2, 3, 4, 5], "minInstancesPerNode": [1, 5]}, 3)
    found = bench.grouped_search(cut_lineage(frame(spark, sf, PRICES)), REG, c, 2, metric="rmse")
    return found.groupBy("candidate").agg(within(0, 1e6, "rmse", "std").alias("in_range"))


@query("e22_cv_summary", "SELECT 'tree' AS kind, true AS in_range, true AS spread")
def e22(spark, sf):
    df = doc_rows(spark, sf)
    folds = splits.stratified_kfold(df, "y", ["row_id"], 3).select("row_id", "fold")
    t = bench.cv_summary(cut_lineage(df.join(folds, "row_id")), SPEC)
    kinds = ("roc_auc", "pr_auc", "f1", "balanced_accuracy")
    return t.groupBy("kind").agg(within(0, 1, *[f"{k}_mean" for k in kinds]).alias("in_range"), within(0, 0.71, *[f"{k}_std" for k in kinds]).alias("spread"))


@query("e25_repeated_regression", "SELECT * FROM (VALUES ('random', false), ('random', true), ('group', false), ('group', true)) t(strategy, augmented), (SELECT true AS finite, true AS ordered)")
def e25(spark, sf):
    out = bench.repeated_regression(cut_lineage(frame(spark, sf, PRICES)), {"tree": REG}, 1, 500)
    return out.select("strategy", "augmented", *finite())


@query("e24_augmentation_delta", "SELECT 'tree' AS model, true AS in_range, true AS is_difference")
def e24b(spark, sf):
    out = bench.repeated_regression(cut_lineage(frame(spark, sf, PRICES)), {"tree": REG}, 1, 500)
    long = out.withColumn("condition", F.when(F.col("augmented"), "augmented").otherwise("plain"))
    t = ev.augmentation_delta(long, "model", "condition", "rmse", "plain", "augmented")
    return t.groupBy("model").agg(within(0, 1e6, "plain", "augmented").alias("in_range"),
                                  F.bool_and(F.abs(F.col("augmented") - F.col("plain") - F.col("delta")) < 1e-9).alias("is_difference"))


# ---- audit -------------------------------------------------------------------------------

NOV = """SELECT l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS a, l_extendedprice AS b, l_tax AS c FROM {lineitem}"""


def sql_rest(col: str) -> str:
    return f"""(SELECT g.l_suppkey, '{col}' AS feature, quantile_cont({col}, 0.25) AS q0, quantile_cont({col}, 0.5) AS q1, quantile_cont({col}, 0.75) AS q2
 FROM g JOIN c ON c.l_suppkey <> g.l_suppkey GROUP BY ALL)"""


@query("au1_leave_out_quantiles", f"WITH c AS ({NOV}), g AS (SELECT DISTINCT l_suppkey FROM c), u AS ({' UNION ALL '.join('SELECT * FROM ' + sql_rest(x) for x in 'abc')}) SELECT feature, l_suppkey, {r('q0')} AS q0, {r('q1')} AS q1, {r('q2')} AS q2 FROM u")
def au1(spark, sf):
    return rounded(audit.leave_out_quantiles(frame(spark, sf, NOV), "l_suppkey", ["a", "b", "c"]))


@query("au1_group_novelty", f"""WITH c AS ({NOV}), g AS (SELECT DISTINCT l_suppkey FROM c), u AS ({' UNION ALL '.join('SELECT * FROM ' + sql_rest(x) for x in 'abc')}),
 w AS (SELECT l_suppkey, max(q1) FILTER (feature = 'a') AS ma, max(nullif(q2 - q0, 0)) FILTER (feature = 'a') AS ia, max(q1) FILTER (feature = 'b') AS mb, max(nullif(q2 - q0, 0)) FILTER (feature = 'b') AS ib,
 max(q1) FILTER (feature = 'c') AS mc, max(nullif(q2 - q0, 0)) FILTER (feature = 'c') AS ic FROM u GROUP BY 1),
 z AS (SELECT l_suppkey, list_median([x FOR x IN [abs(a - ma) / ia, abs(b - mb) / ib, abs(c - mc) / ic] IF x IS NOT NULL]) AS z FROM c JOIN w USING (l_suppkey))
 SELECT l_suppkey, {r('median(z)')} AS median_robust_z FROM z GROUP BY 1""")
def au1b(spark, sf):
    return rounded(audit.group_novelty(frame(spark, sf, NOV), "l_suppkey", ["a", "b", "c"]))


@query("au2_chance_level", f"""WITH g AS (SELECT o_custkey, count(*) AS n FROM {{orders}} GROUP BY 1) SELECT {r('sum(pow(n / (SELECT sum(n) FROM g), 2))')} AS chance, count(*) AS n_groups FROM g""")
def au2(spark, sf):
    return rounded(audit.chance_level(table(spark, sf, "orders"), "o_custkey"))


@query("au2_identifiability_probe", f"""WITH c AS ({DOCS}), g AS (SELECT group_id, count(*) AS n FROM c GROUP BY 1)
 SELECT {r('sum(pow(n / (SELECT sum(n) FROM g), 2))')} AS chance, count(*) AS n_groups, true AS in_range FROM g""")
def au2b(spark, sf):
    t = audit.identifiability_probe(doc_rows(spark, sf), SPEC, 2, 10, 5)
    return rounded(t.groupBy("chance", "n_groups").agg(within(0, 1, "accuracy", "std").alias("in_range")))


MI_SRC = "SELECT l_suppkey, l_returnflag, l_linestatus, CAST(l_linenumber AS STRING) AS ln, CAST(l_discount AS STRING) AS disc FROM {lineitem}"


def sql_mi(col: str, target: str) -> str:
    return f"""(SELECT '{col}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY z) AS ny, sum(n) OVER () AS t
 FROM (SELECT {col} AS x, {target} AS z, count(*)::DOUBLE AS n FROM c GROUP BY ALL)))"""


@query("au3_discrete_information", f"WITH c AS ({MI_SRC}), u AS ({' UNION ALL '.join('SELECT * FROM ' + sql_mi(x, 'l_returnflag') for x in ('l_linestatus', 'ln', 'disc'))}) SELECT feature, {r('mi', 8)} AS mi FROM u")
def au3(spark, sf):
    return rounded(audit.discrete_information(frame(spark, sf, MI_SRC), ["l_linestatus", "ln", "disc"], "l_returnflag").select("feature", "mi"), 8)


@query("au4_binned_information", f"""WITH c0 AS ({LINES}), e AS (SELECT [quantile_cont(l_quantity, i / 8.0) FOR i IN [1]] AS unused, quantile_cont(l_quantity, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS ed FROM c0),
 c AS (SELECT len(list_filter(list_distinct(ed), lambda x: x < l_quantity AND x > 1 AND x < 50)) AS b, y FROM c0, e) SELECT 'l_quantity' AS feature, {r('mi', 8)} AS mi FROM {sql_mi('b', 'y')}""".replace("[quantile_cont(l_quantity, i / 8.0) FOR i IN [1]] AS unused, ", ""))
def au4(spark, sf):
    return rounded(audit.binned_information(frame(spark, sf, LINES), ["l_quantity"], "y", 8).select("feature", "mi"), 8)


@query("au4_neighbour_information", "SELECT 2 AS features, true AS in_range, true AS y_leads")
def au4b(spark, sf):
    df = frame(spark, sf, PRICES).withColumn("cheap", F.col("y") + F.col("bal") / 100 < 200)
    t = audit.neighbour_information(df, ["y", "bal"], "cheap", "row_id")
    return t.agg(F.count("*").cast("int").alias("features"), within(0, 1, "mi").alias("in_range"), (F.max_by("feature", "mi") == "y").alias("y_leads"))


@query("au5_information_table", f"""WITH c AS ({MI_SRC}), a AS ({' UNION ALL '.join('SELECT * FROM ' + sql_mi(x, 'l_returnflag') for x in ('ln', 'disc'))}), b AS ({' UNION ALL '.join('SELECT * FROM ' + sql_mi(x, 'l_suppkey') for x in ('ln', 'disc'))}),
 h AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM c)::DOUBLE AS t FROM c GROUP BY l_suppkey))
 SELECT feature, {r('a.mi', 8)} AS mi_target, {r('b.mi', 8)} AS mi_group, {r('b.mi / h', 8)} AS identifiability, {r('b.mi / greatest(a.mi, 1e-6)', 4)} AS group_to_target FROM a JOIN b USING (feature), h""")
def au5(spark, sf):
    t = audit.information_table(frame(spark, sf, MI_SRC), ["ln", "disc"], "l_returnflag", "l_suppkey")
    return t.select("feature", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("mi_target", 8), ("mi_group", 8), ("identifiability", 8), ("group_to_target", 4))])


@query("au6_grouped_permutation_importance", """SELECT *, true AS in_range, feature = 'flat' AS nothing
 FROM (VALUES ('n_chars'), ('n_spaces'), ('n_dots'), ('e_share'), ('lang'), ('flat')) t(feature)""")
def au6(spark, sf):
    df = cut_lineage(doc_rows(spark, sf).withColumn("flat", F.lit(1.0)))
    t = audit.grouped_permutation_importance(df, SPEC.but(numeric=(*NUMERIC, "flat")), [*NUMERIC, "lang", "flat"])
    return t.groupBy("feature").agg(
        within(-1, 1, "mean").alias("in_range"), F.bool_and((F.col("feature") == "flat") & (F.col("mean") == 0) & (F.col("std") == 0)).alias("nothing"))


@query("au7_attribution", "SELECT 5 AS features, true AS in_range")
def au7(spark, sf):
    df = doc_rows(spark, sf)
    s = mod.fit(df, SPEC)
    c = audit.shapley_attribution(df, s, ["n_chars", "n_spaces", "n_dots", "e_share", "lang"], "row_id", 5, 2)
    t = audit.parent_attribution(audit.mean_abs_attribution(c))
    return t.agg(F.count_distinct("feature").cast("int").alias("features"), within(0, 1, "mean_abs").alias("in_range"))


@query("au7_path_attribution", f"""WITH c AS ({DOCS}) SELECT kind, count(*) AS rows, (SELECT CAST(4 + count(DISTINCT coalesce(lang, 'Unknown')) AS INT) FROM c) AS features, 5 AS parents,
 CASE kind WHEN 'tree' THEN {r('avg(y)')} END AS base, true AS adds_up FROM c, (VALUES ('tree'), ('forest')) k(kind) GROUP BY kind""")
def au7c(spark, sf):
    """Contributions per encoded feature add up to score less base; an unweighted tree's base is the mean label."""
    df, out = doc_rows(spark, sf), None
    for spec in (SPEC, SPEC.but(kind="forest", params={"numTrees": 10, "maxDepth": 4})):
        s = mod.fit(df, spec)
        c, base = audit.path_attribution(df, s, "row_id")
        c = cut_lineage(c)
        total = c.groupBy("row_id").agg(F.sum("contribution").alias("c"), F.count("*").cast("int").alias("k"))
        rolled = audit.parent_attribution(audit.mean_abs_attribution(c)).agg(F.count("*").cast("int").alias("n")).scalar()
        one = s(df).select("row_id", "score").join(total, "row_id").agg(
            F.count("*").alias("rows"), F.max("k").alias("features"),
            (F.max(F.abs(F.col("score") - F.lit(base) - F.col("c"))) < 1e-6).alias("adds_up"))
        one = one.select(F.lit(spec.kind).alias("kind"), "rows", "features", rolled.alias("parents"),
                         F.lit(base if spec.kind == "tree" else None).cast("double").alias("base"), "adds_up")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("au7_parent_attribution", f"SELECT split_part(l_returnflag || '=' || l_linestatus, '=', 1) AS feature, {r('sum(m)', 5)} AS mean_abs FROM (SELECT l_returnflag, l_linestatus, avg(abs(l_tax - 0.04)) AS m FROM {{lineitem}} GROUP BY 1, 2) GROUP BY 1")
def au7b(spark, sf):
    df = table(spark, sf, "lineitem").select(F.concat_ws("=", "l_returnflag", "l_linestatus").alias("feature"), (F.col("l_tax") - 0.04).alias("contribution"))
    return rounded(audit.parent_attribution(audit.mean_abs_attribution(df)), 5)


@query("au8_redundancy_groups")
def au8(spark, sf):
    return audit.redundancy_groups(frame(spark, sf, DOCS), NUMERIC, categorical=["lang"])


@query("au8_encoded_correlations", f"""WITH d AS ({DOCS}), k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)),
 c AS (SELECT n_chars, n_spaces, n_dots, coalesce(e_share, (SELECT median(e_share) FROM d)) AS e_share, coalesce(code, -1) AS lang FROM d LEFT JOIN k USING (lang)) """
 + " UNION ALL ".join(sql_spearman("c", a, b) for a, b in combinations(("n_chars", "n_spaces", "n_dots", "e_share", "lang"), 2)))
def au8b(spark, sf):
    from kinfold.operators.profiling import encoded_features, rank_correlation_matrix
    rows = encoded_features(frame(spark, sf, DOCS), NUMERIC, ["lang"])
    return rounded(rank_correlation_matrix(rows, [*NUMERIC, "lang"]))


@query("au9_grouping_report", f"""WITH c AS (SELECT o_orderkey, o_custkey, o_custkey % 700 AS ent, CAST(o_custkey % 5 AS INT) AS fold FROM {{orders}}), e AS (SELECT ent, count(*) AS n, count(DISTINCT fold) AS k FROM c GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(COALESCE(sum(n) FILTER (k > 1), 0) AS BIGINT) AS n_contaminated, count(*) AS n_entities, count(*) FILTER (k > 1) AS n_split_entities,
 (SELECT count(DISTINCT o_custkey) FROM c) AS old_groups, (SELECT count(DISTINCT ent) FROM c) AS new_groups, {r('100.0 * COALESCE(sum(n) FILTER (k > 1), 0) / sum(n)')} AS contaminated_pct FROM e""")
def au9(spark, sf):
    from kinfold.operators.identity import grouping_report
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 700).alias("ent"), (F.col("o_custkey") % 5).cast("int").alias("fold"))
    return rounded(grouping_report(df, "o_custkey", "ent", "fold"))


@query("au9_contamination_scores", "SELECT *, 2::BIGINT AS n_fits, true AS in_range FROM (VALUES ('old'), ('canonical')) t(key)")
def au9b(spark, sf):
    df = doc_rows(spark, sf).withColumn("old_key", F.concat_ws("/", "group_id", "lang"))
    t = audit.contamination_scores(df, SPEC, "old_key", "group_id", 2)
    return t.groupBy("key").agg(F.sum("n_fits").alias("n_fits"), within(0, 1, "mean", "std").alias("in_range"))


@query("au10_duplicate_inflation", f"""WITH c AS ({DOCS}), k AS (SELECT count(*) AS n FROM c GROUP BY group_id, n_chars, n_spaces, n_dots, lang, y)
 SELECT data, (SELECT sum(n) FROM k)::BIGINT AS n_rows, (SELECT sum(n - 1) FROM k)::BIGINT AS n_removed, true AS in_range FROM (VALUES ('with duplicates'), ('deduplicated')) t(data)""")
def au10(spark, sf):
    t = audit.duplicate_inflation(doc_rows(spark, sf), SPEC, ["group_id", "n_chars", "n_spaces", "n_dots", "lang", "y"], 2)
    return t.groupBy("data", "n_rows", "n_removed").agg(within(0, 1, "mean", "std").alias("in_range"))


@query("au11_baseline_bundle", "SELECT *, true AS in_range FROM (VALUES ('holdout', 1::BIGINT), ('stratified', 2), ('group', 2)) t(protocol, n_fits)")
def au11(spark, sf):
    return audit.baseline_bundle(doc_rows(spark, sf), SPEC, 2).groupBy("protocol").agg(
        F.sum("n_fits").alias("n_fits"), within(0, 1, "mean", "std").alias("in_range"))


@query("au12_leakage_signature", "SELECT 5 AS features, 15 AS ranks, true AS in_order, true AS as_ruled")
def au12(spark, sf):
    df = doc_rows(spark, sf)
    s = mod.fit(df, SPEC)
    cols = ["n_chars", "n_spaces", "n_dots", "e_share", "lang"]
    c = audit.shapley_attribution(df, s, cols, "row_id", 4, 1)
    imp = audit.grouped_permutation_importance(df, SPEC, cols, 2, 1)
    t = audit.leakage_signature(audit.mean_abs_attribution(c), imp, 2)
    ruled = F.col("suspect") == ((F.col("rank") <= 2) & (F.col("importance") < 0.005))
    order = F.expr("transform(array_sort(collect_list(struct(rank, mean_abs))), x -> -x.mean_abs)")
    return t.agg(F.count("*").cast("int").alias("features"), F.sum("rank").cast("int").alias("ranks"),
                 (order == F.array_sort(order)).alias("in_order"), F.bool_and(ruled).alias("as_ruled"))
