"""Weights and resampling (R), splitters (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import resampling as res
from kinfold.operators import splits
from kinfold.operators import weights as wt
from kinfold.plans.session import table
from kinfold.queries.base import LINES, ORDERS, frame, query, r, rounded, sql_hash

RAW = {
    "none": "1.0::DOUBLE", "inverse": "1.0::DOUBLE / n", "sqrt": "1.0::DOUBLE / sqrt(n)",
    "effective": "(1.0::DOUBLE - 0.999::DOUBLE) / (1.0::DOUBLE - pow(0.999::DOUBLE, n))",
    "log": "1.0::DOUBLE / (1.0 + ln(n))",
}


@query("r1_group_weights", "WITH s AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1), " + ", ".join(
    f"{k} AS (SELECT '{k}' AS strategy, o_custkey, n, {e} AS w FROM s)" for k, e in RAW.items())
    + f", u AS ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in RAW)}) "
    f"SELECT strategy, o_custkey, n, {r('w / (sum(n * w) OVER (PARTITION BY strategy) / sum(n) OVER (PARTITION BY strategy))')} AS weight FROM u")
def r1(spark, sf):
    df = table(spark, sf, "orders")
    out = None
    for s in wt.STRATEGIES:
        t = wt.group_weight_table(df, "o_custkey", s).withColumn("strategy", F.lit(s))
        out = t if out is None else out.unionByName(t)
    return rounded(out)


@query("r2_class_weights", f"""WITH c AS ({LINES}), k AS (SELECT y, count(*) AS n FROM c GROUP BY 1)
 SELECT y, n, {r('(SELECT sum(n) FROM k) / (2.0 * n)')} AS weight FROM k""")
def r2(spark, sf):
    return rounded(wt.class_weight_table(frame(spark, sf, LINES), "y"))


@query("r3_combined_weights", f"""WITH c AS ({ORDERS}), g AS (SELECT o_custkey, count(*) AS gn FROM c GROUP BY 1),
 k AS (SELECT y, (SELECT count(*) FROM c) / (2.0 * count(*)) AS cw FROM c GROUP BY 1),
 w AS (SELECT o_orderkey, cw / sqrt(gn) AS w FROM c JOIN g USING (o_custkey) JOIN k USING (y))
 SELECT o_orderkey, {r('w / (avg(w) OVER ())')} AS weight FROM w""")
def r3(spark, sf):
    df = frame(spark, sf, ORDERS).select("o_orderkey", "o_custkey", "y")
    return rounded(wt.combined_weights(df, "y", "o_custkey").select("o_orderkey", "weight"))


@query("r4_bootstrap_augment", f"""WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS pos,
 count(*) OVER () AS n FROM {{orders}}), d AS (SELECT {sql_hash(42, 'i')} % (SELECT max(n) FROM p) AS pos FROM range(1000) t(i))
 SELECT o_orderkey, o_totalprice, true AS is_extra FROM p JOIN d USING (pos) UNION ALL SELECT o_orderkey, o_totalprice, false FROM p""")
def r4(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return res.bootstrap_augment(df, ["o_orderkey"], 1000)


@query("r5_cluster_resample", f"""WITH g AS (SELECT DISTINCT o_custkey FROM {{orders}}), p AS (SELECT o_custkey,
 row_number() OVER (ORDER BY {sql_hash(42, 'o_custkey')}, o_custkey) - 1 AS pos, count(*) OVER () AS n FROM g),
 d AS (SELECT {sql_hash(43, '0', 'pos')} % n AS pos FROM p), m AS (SELECT pos, count(*) AS times FROM d GROUP BY 1)
 SELECT o_orderkey, times FROM {{orders}} JOIN p USING (o_custkey) JOIN m USING (pos)""")
def r5(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return res.cluster_resample(df, "o_custkey").select("o_orderkey", "times")


FOLD_ROWS = """SELECT CAST(l_linenumber AS INT) AS method, CAST(l_suppkey AS INT) AS fold_key, avg(l_tax) * 10 AS roc_auc,
 avg(l_discount) * 10 AS mcc FROM {lineitem} GROUP BY 1, 2"""


def sql_interval(value: str, src: str, reps: int, by: str, seed: int = 42) -> str:
    return f"""p AS (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {sql_hash(0, 'fold_key')}, fold_key) - 1 AS pos,
 count(*) OVER (PARTITION BY {by}) AS n FROM {src}), d AS (SELECT {by}, rep, {sql_hash(seed, *by.split(', '), 'rep', 'pos')} % n AS pos
 FROM p, range({reps}) t(rep)), m AS (SELECT {by}, rep, avg(v) AS m FROM d JOIN p USING ({by}, pos) GROUP BY ALL),
 q AS (SELECT {by}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY ALL),
 b AS (SELECT {by}, avg(v) AS mean, count(*) AS n FROM p GROUP BY ALL)"""


@query("r6_mean_interval", f"""WITH f AS ({FOLD_ROWS}), {sql_interval('roc_auc', 'f', 200, 'method')}
 SELECT method, {r('mean')} AS mean, {r('ci_low')} AS ci_low, {r('ci_high')} AS ci_high, n FROM b JOIN q USING (method)""")
def r6(spark, sf):
    return rounded(res.mean_interval(frame(spark, sf, FOLD_ROWS), "roc_auc", "fold_key", ["method"], 200))


@query("r7_fold_intervals", f"""WITH f AS ({FOLD_ROWS}), l AS (SELECT method, fold_key, 'roc_auc' AS metric, roc_auc AS value FROM f UNION ALL
 SELECT method, fold_key, 'mcc', mcc FROM f), {sql_interval('value', 'l', 100, 'method, metric')}
 SELECT method, metric, {r('mean')} AS mean, {r('ci_low')} AS ci_low, {r('ci_high')} AS ci_high, n, 100 AS bootstrap_iterations
 FROM b JOIN q USING (method, metric)""")
def r7(spark, sf):
    return rounded(res.fold_intervals(frame(spark, sf, FOLD_ROWS), ["roc_auc", "mcc"], ["method"], replicates=100))


@query("r8_pooled_ranking_intervals", f"""WITH c AS ({LINES}), g AS (SELECT DISTINCT l_suppkey FROM c), p AS (SELECT l_suppkey,
 row_number() OVER (ORDER BY {sql_hash(42, 'l_suppkey')}, l_suppkey) - 1 AS pos, count(*) OVER () AS n FROM g),
 d AS (SELECT rep, {sql_hash(43, 'rep', 'pos')} % n AS pos FROM p, range(1000) t(rep)), m AS (SELECT rep, l_suppkey, count(*) AS times
 FROM d JOIN p USING (pos) GROUP BY ALL), s AS (SELECT rep, p AS score, CAST(sum(y * times) AS BIGINT) AS pos, CAST(sum((1 - y) * times) AS BIGINT) AS neg
 FROM c JOIN m USING (l_suppkey) GROUP BY ALL), k AS (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS nb,
 sum(pos) OVER (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
 sum(pos) OVER (PARTITION BY rep) AS pp, sum(neg) OVER (PARTITION BY rep) AS nn FROM s),
 a AS (SELECT rep, sum(pos * (nb + neg / 2.0)) / (max(pp) * max(nn)) AS auc, sum(pos / pp * tp / (tp + fp)) AS ap FROM k GROUP BY 1),
 l AS (SELECT 'pooled_roc_auc' AS metric, auc AS v FROM a UNION ALL SELECT 'pooled_pr_auc', ap FROM a)
 SELECT metric, {r('avg(v)')} AS mean, {r('quantile_cont(v, 0.025)')} AS ci_low, {r('quantile_cont(v, 0.975)')} AS ci_high,
 (SELECT count(*) FROM g) AS n, 1000 AS bootstrap_iterations, count(v) AS valid_iterations FROM l GROUP BY 1""")
def r8(spark, sf):
    df = frame(spark, sf, LINES).select("l_suppkey", "y", "p")
    return rounded(res.pooled_ranking_intervals(df, "l_suppkey", "y", "p", replicates=1000))


# ---- splitters ----------------------------------------------------------------

@query("k1_stratified_holdout", f"""WITH c AS ({ORDERS}), k AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY
 {sql_hash(42, 'o_orderkey')}, o_orderkey) AS i, count(*) OVER (PARTITION BY y) AS n FROM c) SELECT o_orderkey, y, i <= floor(n * 0.2) AS is_test FROM k""")
def k1(spark, sf):
    return splits.stratified_holdout(frame(spark, sf, ORDERS), "y", ["o_orderkey"])


@query("k2_stratified_kfold", f"""WITH c AS ({ORDERS}) SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY
 {sql_hash(42, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM c""")
def k2(spark, sf):
    return splits.stratified_kfold(frame(spark, sf, ORDERS), "y", ["o_orderkey"])


@query("k3_group_kfold", """WITH RECURSIVE s AS (SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY 1),
 o AS (SELECT l_suppkey, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS i FROM s),
 p AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::BIGINT AS l_suppkey, NULL::BIGINT AS n, NULL::BIGINT AS f UNION ALL
 SELECT o.i, list_transform(range(1, 6), lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END),
 o.l_suppkey, o.n, list_position(loads, list_min(loads)) FROM p JOIN o ON o.i = p.i + 1)
 SELECT l_suppkey, n, CAST(f - 1 AS INT) AS fold FROM p WHERE i > 0""")
def k3(spark, sf):
    return splits.group_kfold(table(spark, sf, "lineitem"), "l_suppkey")


@query("k3_group_kfold_snake", f"""WITH s AS (SELECT o_custkey, count(*) AS n FROM {{orders}} GROUP BY 1), o AS (SELECT *, row_number() OVER
 (ORDER BY n DESC, {sql_hash(42, 'o_custkey')}, o_custkey) - 1 AS i FROM s)
 SELECT o_custkey, n, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INT) AS fold FROM o""")
def k3b(spark, sf):
    return splits.group_kfold_snake(table(spark, sf, "orders"), "o_custkey")


@query("k4_stratified_group_kfold", f"""WITH RECURSIVE c AS ({LINES}), s AS (SELECT l_suppkey, CAST(sum(1 - y) AS BIGINT) AS a, CAST(sum(y) AS BIGINT) AS b FROM c GROUP BY 1),
 t AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM s),
 o AS (SELECT l_suppkey, a, b, row_number() OVER (ORDER BY abs(a - b) DESC, {sql_hash(42, 'l_suppkey')}, l_suppkey) AS i FROM s),
 p AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::DOUBLE[] AS la, [0, 0, 0, 0, 0]::DOUBLE[] AS lb, NULL::BIGINT AS l_suppkey, NULL::BIGINT AS n_neg,
   NULL::BIGINT AS n_pos, NULL::BIGINT AS f UNION ALL
 SELECT i, list_transform(range(1, 6), lambda k: la[k] + CASE WHEN k = best THEN a ELSE 0 END),
   list_transform(range(1, 6), lambda k: lb[k] + CASE WHEN k = best THEN b ELSE 0 END), l_suppkey, a, b, best FROM (
  SELECT x.*, list_min(list_transform(range(1, 6), lambda k: {{'e': round((list_stddev_pop(list_transform(range(1, 6), lambda j: (la[j] + CASE WHEN j = k THEN a ELSE 0 END) / ta))
   + list_stddev_pop(list_transform(range(1, 6), lambda j: (lb[j] + CASE WHEN j = k THEN b ELSE 0 END) / tb))) / 2, 12), 'h': la[k] + lb[k], 'k': k}}))['k'] AS best
  FROM (SELECT o.i, o.l_suppkey, o.a, o.b, p.la, p.lb, t.ta, t.tb FROM p JOIN o ON o.i = p.i + 1, t) x))
 SELECT 42 AS seed, l_suppkey, n_neg, n_pos, CAST(f - 1 AS INT) AS fold FROM p WHERE i > 0""")
def k4(spark, sf):
    return splits.stratified_group_kfold(frame(spark, sf, LINES), "l_suppkey", "y")


@query("k5_leave_one_group_out", f"""WITH s AS (SELECT l_suppkey, count(*) AS n FROM {{lineitem}} GROUP BY 1) SELECT l_suppkey, n AS n_test,
 CAST((SELECT sum(n) FROM s) - n AS BIGINT) AS n_train, row_number() OVER (ORDER BY {sql_hash(0, 'l_suppkey')}, l_suppkey) - 1 AS fold FROM s""")
def k5(spark, sf):
    return splits.leave_one_group_out(table(spark, sf, "lineitem"), "l_suppkey")


@query("k6_group_holdout", f"""WITH g AS (SELECT DISTINCT o_custkey FROM {{orders}}) SELECT o_custkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_custkey')},
 o_custkey) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM g""")
def k6(spark, sf):
    return splits.group_holdout(table(spark, sf, "orders"), "o_custkey")


K7_SQL = f"""g AS (SELECT o_custkey, avg(o_totalprice) AS gm FROM {{orders}} GROUP BY 1),
 e AS (SELECT [quantile_cont(gm, 1/6.0), quantile_cont(gm, 2/6.0), quantile_cont(gm, 0.5), quantile_cont(gm, 4/6.0), quantile_cont(gm, 5/6.0)] AS ed FROM g),
 b AS (SELECT o_custkey, len(list_filter(ed, lambda x: x < gm)) AS bin FROM g, e),
 s AS (SELECT c AS candidate, o_custkey, bin, row_number() OVER (PARTITION BY c ORDER BY {sql_hash('42 + 1000 * c', 'o_custkey')}, o_custkey)
   <= ceil(0.2 * count(*) OVER (PARTITION BY c)) AS is_test FROM b, range(50) t(c)),
 m AS (SELECT candidate, is_test, count(*) AS n, avg(o_totalprice) AS a, median(o_totalprice) AS d, stddev_pop(o_totalprice) AS v,
   count(DISTINCT o_custkey) AS k FROM s JOIN {{orders}} USING (o_custkey) GROUP BY ALL),
 h AS (SELECT candidate, bin, count(*) FILTER (is_test) AS te, count(*) FILTER (NOT is_test) AS tr FROM s GROUP BY ALL),
 hd AS (SELECT candidate, 0.5 * sum(abs(te / te_n - tr / tr_n)) AS dist FROM (SELECT *, sum(te) OVER (PARTITION BY candidate) AS te_n,
   sum(tr) OVER (PARTITION BY candidate) AS tr_n FROM h) GROUP BY 1),
 w AS (SELECT x.candidate, x.n AS n_rows_test, y.n AS n_rows_train, x.k AS n_groups_test, dist, abs(x.a - y.a) / sd + 0.5 * abs(x.d - y.d) / sd
   + 0.25 * abs(x.v - y.v) / sd + 2.0 * abs(x.n / (x.n + y.n) - 0.2) + 2.5 * dist AS score
   FROM m x JOIN m y ON x.candidate = y.candidate AND x.is_test AND NOT y.is_test JOIN hd ON hd.candidate = x.candidate,
   (SELECT stddev_pop(o_totalprice) AS sd FROM {{orders}}))"""


@query("k7_balanced_candidates", f"""WITH {K7_SQL} SELECT CAST(candidate AS INT) AS candidate, n_rows_test, n_rows_train, n_groups_test,
 {r('dist')} AS bin_distance, {r('score')} AS balance_score FROM w""")
def k7(spark, sf):
    scores, _ = splits.balanced_group_candidates(table(spark, sf, "orders"), "o_custkey", "o_totalprice", candidates=50)
    return rounded(scores.select("candidate", "n_rows_test", "n_rows_train", "n_groups_test", "bin_distance", "balance_score"))


@query("k7_balanced_holdout", f"""WITH {K7_SQL} SELECT o_custkey, is_test FROM s WHERE candidate = (SELECT arg_min(candidate, score) FROM w)""")
def k7b(spark, sf):
    return splits.balanced_group_holdout(table(spark, sf, "orders"), "o_custkey", "o_totalprice", candidates=50)


K8_SQL = f"""e AS (SELECT [quantile_cont(o_totalprice, 1/6.0), quantile_cont(o_totalprice, 2/6.0), quantile_cont(o_totalprice, 0.5),
 quantile_cont(o_totalprice, 4/6.0), quantile_cont(o_totalprice, 5/6.0)] AS ed FROM {{orders}}),
 b AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(len(list_filter(ed, lambda x: x < o_totalprice)) AS INT) AS stratum FROM {{orders}}, e)"""


@query("k8_quantile_holdout", f"""WITH {K8_SQL} SELECT o_orderkey, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {sql_hash(42, 'o_orderkey')},
 o_orderkey) <= floor(0.2 * count(*) OVER (PARTITION BY stratum)) AS is_test FROM b""")
def k8(spark, sf):
    return splits.quantile_stratified_holdout(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"])


@query("k9_split_diagnostics", f"""WITH {K7_SQL}, t AS (SELECT o_custkey, is_test FROM s WHERE candidate = (SELECT arg_min(candidate, score) FROM w))
 SELECT 1 AS repeat, 42 AS seed, CASE WHEN is_test THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups,
 {r('avg(o_totalprice)', 4)} AS y_mean, {r('stddev_pop(o_totalprice)', 4)} AS y_std FROM {{orders}} JOIN t USING (o_custkey) GROUP BY ALL""")
def k9(spark, sf):
    s = splits.holdout_pair(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 1, candidates=50)
    return rounded(splits.split_diagnostics(s, "o_custkey", "o_totalprice"), 4)
