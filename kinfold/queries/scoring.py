"""Metrics, curves, thresholds (E1-E11, E24-E28) and paired tests (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import numeric as num
from kinfold.operators import identity as ids
from kinfold.operators import metrics as met
from kinfold.operators import profiling as prof
from kinfold.operators import stattests as stat
from kinfold.plans.session import cut_lineage, spread, table
from kinfold.queries.base import LINES, frame, query, r, rounded
from kinfold.queries.profiling import FOLDS


def sql_curve(src: str, by: str = "", score: str = "p", w: str = "1") -> str:
    """CTEs s, k: cumulative counts of every distinct score."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""s AS (SELECT {keys}{score} AS th, sum(y * {w}) AS pos, sum((1 - y) * {w}) AS neg FROM {src} GROUP BY ALL),
 k AS (SELECT *, sum(neg) OVER ({part} ORDER BY th ROWS UNBOUNDED PRECEDING) - neg AS nb,
 sum(pos) OVER ({part} ORDER BY th DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER ({part} ORDER BY th DESC ROWS UNBOUNDED PRECEDING) AS fp,
 sum(pos) OVER ({part}) AS pp, sum(neg) OVER ({part}) AS nn FROM s)"""


AUC = "sum(pos * (nb + neg / 2.0)) / (max(pp) * max(nn))"
AP = "sum(pos / pp * tp / (tp + fp))"


@query("e1_roc_auc", f"WITH c AS ({LINES}), {sql_curve('c', '', 'q')} SELECT {r(AUC)} AS roc_auc FROM k")
def e1(spark, sf):
    return rounded(met.ranking_metrics(frame(spark, sf, LINES), "y", "q").select("roc_auc"))


@query("e1_roc_auc_by_group", f"""WITH c AS ({LINES}), {sql_curve('c', 'l_suppkey')} SELECT l_suppkey, CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg,
 {r(AUC)} AS roc_auc FROM k GROUP BY 1""")
def e1b(spark, sf):
    return rounded(met.ranking_metrics(frame(spark, sf, LINES), "y", "p", ["l_suppkey"]).drop("pr_auc"))


@query("e1_roc_auc_weighted", f"WITH c AS ({LINES}), {sql_curve('c', 'l_linestatus', 'p', 'l_quantity')} SELECT l_linestatus, {r(AUC)} AS roc_auc, {r(AP)} AS pr_auc FROM k GROUP BY 1")
def e1c(spark, sf):
    m = met.ranking_metrics(frame(spark, sf, LINES), "y", "p", ["l_linestatus"], "l_quantity")
    return rounded(m.select("l_linestatus", "roc_auc", "pr_auc"))


@query("e2_average_precision", f"WITH c AS ({LINES}), {sql_curve('c', 'l_linenumber')} SELECT l_linenumber, {r(AP)} AS pr_auc FROM k GROUP BY 1")
def e2(spark, sf):
    return rounded(met.ranking_metrics(frame(spark, sf, LINES), "y", "p", ["l_linenumber"]).select("l_linenumber", "pr_auc"))


CONF = """count(*) FILTER (y = 1 AND p >= 0.35) AS tp, count(*) FILTER (y = 0 AND p >= 0.35) AS fp,
 count(*) FILTER (y = 1 AND p < 0.35) AS fn, count(*) FILTER (y = 0 AND p < 0.35) AS tn"""


@query("e3_confusion", f"WITH c AS ({LINES}) SELECT l_suppkey, {CONF} FROM c GROUP BY 1")
def e3(spark, sf):
    return met.confusion(frame(spark, sf, LINES), "y", (F.col("p") >= 0.35).cast("int"), ["l_suppkey"])


def sql_battery(by: str) -> str:
    return f"""b AS (SELECT {by}, {CONF} FROM c GROUP BY 1), m AS (SELECT *, tp + fp + fn + tn AS n, tp + fn AS n_positive, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
 COALESCE((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) AS balanced_accuracy,
 COALESCE(tp / nullif(tp + fp, 0), 0) AS precision, COALESCE(tp / nullif(tp + fn, 0), 0) AS recall, COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
 CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN COALESCE((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END AS mcc FROM b)"""


@query("e4_classification_battery", f"""WITH c AS ({LINES}), {sql_battery('l_linenumber')}, {sql_curve('c', 'l_linenumber')},
 a AS (SELECT l_linenumber, {AUC} AS roc_auc, {AP} AS pr_auc FROM k GROUP BY 1) SELECT l_linenumber, tp, fp, fn, tn, n, n_positive,
 {', '.join(f'{r(x)} AS {x}' for x in ('accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1', 'mcc', 'roc_auc', 'pr_auc'))} FROM m JOIN a USING (l_linenumber)""")
def e4(spark, sf):
    df = frame(spark, sf, LINES)
    return rounded(met.classification_battery(df, "y", (F.col("p") >= 0.35).cast("int"), "p", ["l_linenumber"]))


REGRESSION = "SELECT l_suppkey, l_extendedprice / 1000 AS yt, l_quantity * 1.5 + l_tax * 10 AS yp FROM {lineitem}"
REG_COLS = f"""CASE WHEN count(*) >= 2 AND var_pop(yt) > 0 THEN {r('1 - avg((yp - yt) * (yp - yt)) / var_pop(yt)')} END AS r2,
 {r('sqrt(avg((yp - yt) * (yp - yt)))')} AS rmse, {r('avg(abs(yp - yt))')} AS mae, {r('100 * avg(CASE WHEN abs(yt) > 1e-6 THEN abs((yp - yt) / yt) END)')} AS mape,
 {r('avg(yp - yt)')} AS mbe, {r('sqrt(avg((yp - yt) * (yp - yt))) / avg(yt)')} AS nrmse, count(*) AS n"""


@query("e5_regression_battery", f"WITH c AS ({REGRESSION}) SELECT {REG_COLS} FROM c")
def e5(spark, sf):
    return rounded(met.regression_battery(frame(spark, sf, REGRESSION), "yt", "yp"))


@query("e6_regression_by_group", f"WITH c AS ({REGRESSION}) SELECT l_suppkey, {REG_COLS} FROM c GROUP BY 1 ORDER BY rmse DESC")
def e6(spark, sf):
    m = met.regression_battery(frame(spark, sf, REGRESSION), "yt", "yp", ["l_suppkey"])
    return rounded(m.orderBy(F.desc("rmse"), "l_suppkey"))


# flagship: parse a unit-laden text, keep labelled rows, drop copies, then per-cluster statistics and AUC
FLAG_SRC = """SELECT l_suppkey, l_orderkey, l_quantity, CAST(l_quantity AS STRING) || ' cm/s' AS flow,
 CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN 'no' ELSE CASE WHEN l_linestatus = 'O' THEN 'n/a' ELSE 'No ' END END AS outcome,
 floor(l_extendedprice * (1 - l_discount) / 100) / 1100 AS p FROM {lineitem}"""


@query("e6_scored_groups", f"""WITH c AS ({FLAG_SRC}), d AS (SELECT DISTINCT l_suppkey, CAST(regexp_extract(flow, '[0-9.]+') AS DOUBLE) * 10 AS v, p,
 CASE lower(trim(outcome)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS y FROM c WHERE lower(trim(outcome)) IN ('yes', 'no')), {sql_curve('d', 'l_suppkey')},
 a AS (SELECT l_suppkey, {AUC} AS auc, {AP} AS ap FROM k GROUP BY 1)
 SELECT l_suppkey, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, {r('avg(y)')} AS positive_rate, avg(y) IN (0, 1) AS single_class,
 {r('100.0 * count(*) / (SELECT count(*) FROM d)')} AS share_pct, {r('avg(v)')} AS mean_flow, {r('any_value(auc)')} AS roc_auc, {r('any_value(ap)')} AS pr_auc
 FROM d JOIN a USING (l_suppkey) GROUP BY 1""")
def scored_groups(spark, sf):
    df = spread(frame(spark, sf, FLAG_SRC)).select(
        "l_suppkey", num.flow_mm_s(F.col("flow")).alias("v"), "p", num.yes_no(F.col("outcome")).alias("y"))
    # parsed and de-duplicated once: statistics and curve both read the stored rows
    df = cut_lineage(ids.drop_exact_duplicates(ids.keep_labelled(df, "y"), ["l_suppkey", "v", "p", "y"]))
    stats = prof.group_stats(df, "l_suppkey", "y", "l_suppkey", "v", ["v"], [F.avg("v").alias("mean_flow")])
    auc = met.ranking_metrics(df, "y", "p", ["l_suppkey"]).drop("n_pos", "n_neg")
    out = stats.join(auc, "l_suppkey", "left")
    return rounded(out.select("l_suppkey", "n_rows", "n_positive", "positive_rate", "single_class", "share_pct",
                              "mean_flow", "roc_auc", "pr_auc").orderBy("roc_auc"))


@query("e7_operating_points", f"""WITH c AS ({LINES}), {sql_curve('c', 'l_linestatus')} SELECT l_linestatus, {r('th')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
 CAST(pp AS BIGINT) AS "P", CAST(nn AS BIGINT) AS "N", {r('fp / nn')} AS fpr, {r('tp / pp')} AS tpr, {r('tp / (tp + fp)')} AS precision FROM k""")
def e7(spark, sf):
    return rounded(met.operating_points(frame(spark, sf, LINES), "y", "p", ["l_linestatus"]))


def sql_thresholds(by: str) -> str:
    m = """SELECT *, pp - tp AS fn, nn - fp AS tn FROM k"""
    pick = lambda e, n: (
        f"{r(f'greatest(0, least(1, max_by(th, struct_pack(a := round({e}, 12), b := th))))')} AS thr_{n}")
    mcc = "COALESCE((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
    return (f"o AS ({m}) SELECT {by}, {pick(mcc, 'mcc')}, {pick('2 * tp / (2 * tp + fp + fn)', 'f1')}, "
            f"{pick('0.5 * (tp / pp + (1 - fp / nn))', 'balanced_accuracy')}, {pick('tp / pp - fp / nn', 'youden_j')} FROM o GROUP BY 1")


@query("e8_optimal_thresholds", f"WITH c AS ({LINES}), {sql_curve('c', 'l_linenumber')}, {sql_thresholds('l_linenumber')}")
def e8(spark, sf):
    return rounded(met.optimal_thresholds(frame(spark, sf, LINES), "y", "p", ["l_linenumber"]))


@query("e9_weighted_thresholds", f"WITH c AS ({LINES}), {sql_curve('c', 'l_linenumber', 'p', 'l_quantity')}, {sql_thresholds('l_linenumber')}")
def e9(spark, sf):
    return rounded(met.optimal_thresholds(frame(spark, sf, LINES), "y", "p", ["l_linenumber"], "l_quantity"))


@query("e10_best_f1_threshold", f"""WITH c AS ({LINES}), {sql_curve('c', 'l_suppkey')}, o AS (SELECT *, round(2 * (tp / (tp + fp)) * (tp / pp) / greatest(tp / (tp + fp) + tp / pp, 1e-12), 12) AS f1 FROM k)
 SELECT l_suppkey, {r('max_by(th, struct_pack(a := f1, b := -th))')} AS threshold, {r('max(f1)')} AS f1 FROM o GROUP BY 1""")
def e10(spark, sf):
    return rounded(met.best_f1_threshold(frame(spark, sf, LINES), "y", "p", ["l_suppkey"]))


@query("e11_threshold_list", f"WITH c AS ({LINES}), {sql_curve('c')} SELECT {r('th')} AS threshold, {r('tp / pp')} AS tpr, {r('fp / nn')} AS fpr FROM k ORDER BY th DESC")
def e11(spark, sf):
    o = met.operating_points(frame(spark, sf, LINES), "y", "p").select("threshold", "tpr", "fpr")
    return rounded(o.orderBy(F.desc("threshold")))


@query("e18_ranking_decomposition", f"""WITH c AS ({LINES}), {sql_curve('c', 'l_suppkey')}, a AS (SELECT l_suppkey, {AUC} AS auc FROM k GROUP BY 1),
 n AS (SELECT l_suppkey, count(*) AS n FROM c GROUP BY 1), w AS (SELECT avg(auc) AS m, median(auc) AS md, sum(auc * n) / sum(n) AS wm,
 count(*) FILTER (auc < 0.5) AS b5, count(*) FILTER (auc < 0.6) AS b6, count(auc) AS nt FROM a JOIN n USING (l_suppkey) WHERE auc IS NOT NULL),
 pool AS (SELECT y, p AS sc, 'pooled' AS kind FROM c UNION ALL SELECT y, round(avg(p) OVER (PARTITION BY l_suppkey), 12), 'between' FROM c),
 ps AS (SELECT kind, sc, sum(y) AS pos, sum(1 - y) AS neg FROM pool GROUP BY ALL), pk AS (SELECT *, sum(neg) OVER (PARTITION BY kind ORDER BY sc ROWS UNBOUNDED PRECEDING) - neg AS nb FROM ps),
 pa AS (SELECT kind, sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM pk GROUP BY 1)
 SELECT {r("(SELECT auc FROM pa WHERE kind = 'pooled')")} AS pooled_auc, {r("(SELECT auc FROM pa WHERE kind = 'between')")} AS between_auc, {r('m')} AS within_auc_mean,
 {r('md')} AS within_auc_median, {r('wm')} AS within_auc_weighted, b5 AS groups_below_05, b6 AS groups_below_06, nt AS n_two_class_groups FROM w""")
def e18(spark, sf):
    df = frame(spark, sf, LINES).select("l_suppkey", "y", "p")
    return rounded(met.ranking_decomposition(df, "l_suppkey", "y", "p")[0])


STRATEGY = """SELECT CAST(l_linenumber AS INT) AS model, CASE WHEN l_linestatus = 'O' THEN 'random' ELSE 'group' END AS strategy,
 avg(l_extendedprice) AS rmse FROM {lineitem} GROUP BY 1, 2"""


@query("e24_generalisation_gap", f"""WITH c AS ({STRATEGY}) SELECT model, {r('max(rmse) FILTER (strategy = $$random$$)', 4)} AS random, {r('max(rmse) FILTER (strategy = $$group$$)', 4)} AS "group",
 {r('max(rmse) FILTER (strategy = $$random$$) - max(rmse) FILTER (strategy = $$group$$)', 4)} AS gap FROM c GROUP BY 1""")
def e24(spark, sf):
    from kinfold.operators.evaluation import generalisation_gap

    return rounded(generalisation_gap(frame(spark, sf, STRATEGY), "model", "strategy", "rmse", "random", "group"), 4)


@query("e26_best_model", f"""WITH c AS ({STRATEGY}) SELECT strategy, arg_min(model, rmse) AS best_model FROM c GROUP BY 1""")
def e26(spark, sf):
    from kinfold.operators.evaluation import best_model

    return best_model(frame(spark, sf, STRATEGY), "model", "rmse", ["strategy"], largest=False)


@query("e27_group_wins", f"""WITH c AS ({LINES}), a AS (SELECT l_suppkey, avg(p) FILTER (l_linestatus = 'O') AS va, CASE WHEN l_suppkey % 9 > 0 THEN avg(p) FILTER (l_linestatus = 'F') END AS vb FROM c GROUP BY 1)
 SELECT count(*) AS n_scorable, CAST(count(*) FILTER (vb > va) AS BIGINT) AS n_improved, {r('avg(va)')} AS mean_a, {r('avg(vb)')} AS mean_b FROM a WHERE vb IS NOT NULL""")
def e27(spark, sf):
    g = frame(spark, sf, LINES).groupBy("l_suppkey").agg(
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("p"))).alias("va"),
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("p"))).alias("vb"),
    ).withColumn("vb", F.when(F.col("l_suppkey") % 9 > 0, F.col("vb")))
    return rounded(met.group_win_count(g, "l_suppkey", "va", "vb"))


@query("e28_threshold_spread", f"WITH f AS ({FOLDS}) SELECT method, {r('min(roc_auc)')} AS roc_auc_min, {r('max(roc_auc)')} AS roc_auc_max, {r('max(roc_auc) - min(roc_auc)')} AS roc_auc_spread FROM f GROUP BY 1")
def e28(spark, sf):
    from kinfold.operators.evaluation import threshold_spread

    return rounded(threshold_spread(frame(spark, sf, FOLDS), "method", ["roc_auc"]))


# ---- paired tests ----------------------------------------------------------------

def sql_wilcoxon(pairs: str) -> str:
    """Ranks, W and the exact two-sided p by counting subset sums of 1..n (15 folds, no ties)."""
    return f"""d AS ({pairs}), x AS (SELECT *, round(abs(d), 12) AS m FROM d), k AS (SELECT *, rank() OVER (PARTITION BY a, b, metric ORDER BY m)
 + (count(*) OVER (PARTITION BY a, b, metric, m) - 1) / 2.0 AS rk FROM x WHERE m > 0),
 w AS (SELECT a, b, metric, CAST(count(*) AS INT) AS n_used, CAST(least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS DOUBLE) AS w, avg(d) AS delta FROM k GROUP BY ALL),
 dp AS (SELECT 0 AS n, [CASE WHEN s = 0 THEN 1.0 ELSE 0.0 END FOR s IN range(0, 121)]::DOUBLE[] AS c UNION ALL
 SELECT n + 1, list_transform(range(0, 121), lambda s: c[s + 1] + CASE WHEN s >= n + 1 THEN c[s - n] ELSE 0 END) FROM dp WHERE n < 15)
 SELECT a, b, metric, CAST(n_used AS BIGINT) AS n_folds, {r('delta')} AS delta, n_used, w, {r('least(1.0, 2 * list_sum(c[1:CAST(floor(w) AS INT) + 1]) / pow(2, n_used))')} AS p_value
 FROM w JOIN dp ON dp.n = w.n_used"""


PAIR = "SELECT a.method AS a, b.method AS b, '{m}' AS metric, a.{m} - b.{m} AS d FROM f a JOIN f b USING (seed, fold) WHERE {cond}"


@query("t1_paired_vs_baseline", f"WITH RECURSIVE f AS ({FOLDS}), {sql_wilcoxon(PAIR.format(m='roc_auc', cond='a.method <> 1 AND b.method = 1') + ' UNION ALL ' + PAIR.format(m='balanced_accuracy', cond='a.method <> 1 AND b.method = 1'))}")
def t1(spark, sf):
    return rounded(stat.paired_analysis(frame(spark, sf, FOLDS), "method", ["seed", "fold"], ["roc_auc", "balanced_accuracy"], 1))


@query("t2_pairwise_tests", f"WITH RECURSIVE f AS ({FOLDS}), {sql_wilcoxon(PAIR.format(m='roc_auc', cond='a.method < b.method'))}")
def t2(spark, sf):
    return rounded(stat.pairwise_analysis(frame(spark, sf, FOLDS), "method", ["seed", "fold"], ["roc_auc"]))
