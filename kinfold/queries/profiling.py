"""Profiling aggregates (A), windows (W), joins and set operations (J, U)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from kinfold.operators import combining as comb
from kinfold.operators import profiling as prof
from kinfold.operators import ranking as rank
from kinfold.operators import splits
from kinfold.plans.session import table
from kinfold.queries.base import LINES, ORDERS, frame, query, r, rounded, sql_hash

SPARSE = """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_linestatus, l_returnflag, l_quantity, l_extendedprice,
 CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS d, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END AS t,
 CASE WHEN l_suppkey % 7 = 0 THEN 1 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM {lineitem}"""


@query("a1_group_stats", f"""WITH c AS ({SPARSE}), n AS (SELECT count(*) AS total FROM c)
 SELECT l_suppkey, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, {r('avg(y)')} AS positive_rate,
 {r('avg(((d IS NOT NULL)::INT + (t IS NOT NULL)::INT + 1) / 3)')} AS numeric_coverage, s_name AS label,
 CAST(count(*) - sum(y) AS BIGINT) AS n_negative, avg(y) IN (0, 1) AS single_class, {r('100.0 * count(*) / any_value(total)')} AS share_pct
 FROM c JOIN {{supplier}} ON s_suppkey = l_suppkey, n GROUP BY l_suppkey, s_name""")
def a1(spark, sf):
    df = frame(spark, sf, SPARSE)
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    named = df.join(names, "l_suppkey")
    return rounded(prof.group_stats(named, "l_suppkey", "y", "s_name", "l_orderkey", ["d", "t", "l_quantity"]))


@query("a2_gini", f"""WITH s AS (SELECT o_custkey, count(*) AS x FROM {{orders}} GROUP BY 1),
 k AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS t FROM s)
 SELECT max(n) AS n_groups, {r('sum((2.0 * i - n - 1) * x) / (max(n) * max(t))')} AS gini FROM k""")
def a2(spark, sf):
    return rounded(prof.gini(table(spark, sf, "orders"), "o_custkey"))


@query("a3_size_summary", f"""WITH s AS (SELECT o_custkey, count(*) AS n FROM {{orders}} GROUP BY 1)
 SELECT count(*) AS count, {r('avg(n)')} AS mean, {r('stddev_samp(n)')} AS std, min(n) AS min, {r('quantile_cont(n, 0.25)')} AS q25,
 {r('quantile_cont(n, 0.5)')} AS median, {r('quantile_cont(n, 0.75)')} AS q75, max(n) AS max FROM s""")
def a3(spark, sf):
    return rounded(prof.size_summary(table(spark, sf, "orders"), "o_custkey"))


# fold records: one per (method, seed, fold) from the three numeric columns of a line item
FOLDS = """SELECT CAST(l_linenumber AS INT) AS method, CAST(l_suppkey % 3 AS INT) AS seed, CAST(l_suppkey % 5 AS INT) AS fold,
 avg(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE l_tax END) * 10 AS roc_auc, avg(l_tax) * 10 AS pr_auc, avg(l_discount) AS mcc,
 avg(l_quantity) / 50 AS balanced_accuracy FROM {lineitem} GROUP BY 1, 2, 3"""


@query("a4_fold_summary", f"""WITH f AS ({FOLDS}) SELECT method, {', '.join(
    f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_std" for m in ('roc_auc', 'pr_auc', 'mcc'))}
 FROM f GROUP BY method ORDER BY roc_auc_mean DESC""")
def a4(spark, sf):
    out = prof.summarise(frame(spark, sf, FOLDS), ["method"], ["roc_auc", "pr_auc", "mcc"])
    return rounded(out.orderBy(F.desc("roc_auc_mean")))


@query("a5_metric_summary", f"""SELECT l_suppkey, l_returnflag, {', '.join(
    f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_std" for m in ('l_tax', 'l_discount'))}
 FROM {{lineitem}} GROUP BY 1, 2""")
def a5(spark, sf):
    return rounded(prof.summarise(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_tax", "l_discount"]))


@query("a6_stability", f"""SELECT l_suppkey, l_linestatus, {r('avg(l_extendedprice)', 4)} AS mean, {r('stddev_samp(l_extendedprice)', 4)} AS std,
 {r('median(l_extendedprice)', 4)} AS median, {r('min(l_extendedprice)', 4)} AS min, {r('max(l_extendedprice)', 4)} AS max FROM {{lineitem}} GROUP BY 1, 2""")
def a6(spark, sf):
    return rounded(prof.stability(table(spark, sf, "lineitem"), ["l_suppkey", "l_linestatus"], "l_extendedprice"), 4)


@query("a7_overview", f"""WITH c AS ({SPARSE}), s AS (SELECT l_suppkey, count(*) AS n FROM c GROUP BY 1)
 SELECT count(*) AS n_rows, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_yes, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_no,
 min(d) AS d_min, max(d) AS d_max, count(d) AS d_n, {r('100.0 * avg(y)')} AS yes_pct, {r('100.0 * (1 - avg(y))')} AS no_pct,
 (SELECT count(*) FROM s) AS n_groups, {r('(SELECT median(n) FROM s)')} AS median_group_size FROM c""")
def a7(spark, sf):
    return rounded(prof.overview(frame(spark, sf, SPARSE), "l_suppkey", "y", ["d"]))


UNKNOWNS = "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS kind, value, user_id FROM {events}"


@query("a8_value_counts", f"WITH c AS ({UNKNOWNS}) SELECT COALESCE(kind, 'Unknown') AS kind, count(*) AS count FROM c GROUP BY 1")
def a8(spark, sf):
    return prof.value_counts(frame(spark, sf, UNKNOWNS), "kind")


@query("a9_crosstab", """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS "R", count(*) FILTER (l_returnflag = 'A') AS "A",
 count(*) FILTER (l_returnflag = 'N') AS "N" FROM {lineitem} GROUP BY 1""")
def a9(spark, sf):
    return prof.crosstab(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["R", "A", "N"])


@query("a10_crosstab_pct", f"""SELECT l_suppkey, {r('''100.0 * count(*) FILTER (l_returnflag = 'R') / count(*)''')} AS "R",
 {r('''100.0 * count(*) FILTER (l_returnflag = 'A') / count(*)''')} AS "A",
 {r('''100.0 * count(*) FILTER (l_returnflag = 'N') / count(*)''')} AS "N" FROM {{lineitem}} GROUP BY 1""")
def a10(spark, sf):
    return rounded(prof.crosstab_pct(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["R", "A", "N"]))


@query("a11_group_fraction", f"""WITH c AS ({UNKNOWNS}) SELECT user_id, {r('''avg(CASE WHEN kind = 'purchase' THEN 1.0 ELSE 0.0 END)''')} AS fraction FROM c GROUP BY 1""")
def a11(spark, sf):
    return rounded(prof.group_fraction(frame(spark, sf, UNKNOWNS), "user_id", F.col("kind") == "purchase"))


@query("a12_group_span", f"""SELECT user_id, min(value) AS min, max(value) AS max, count(value) AS count, {r('max(value) - min(value)')} AS span
 FROM {{events}} GROUP BY 1""")
def a12(spark, sf):
    return rounded(prof.group_span(table(spark, sf, "events"), "user_id", "value"))


@query("a13_group_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM {lineitem} GROUP BY 1")
def a13(spark, sf):
    return prof.group_distinct(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("a14_completeness", f"""WITH c AS ({SPARSE}) SELECT 'd' AS "column", {r('100.0 * count(d) / count(*)')} AS pct FROM c
 UNION ALL SELECT 't', {r('100.0 * count(t) / count(*)')} FROM c UNION ALL SELECT 'y', {r('100.0 * count(y) / count(*)')} FROM c""")
def a14(spark, sf):
    return rounded(prof.completeness(frame(spark, sf, SPARSE), ["d", "t", "y"]))


@query("a15_histogram", """WITH v AS (SELECT 'linear' AS scale, l_extendedprice AS x, 40 AS n FROM {lineitem} UNION ALL
 SELECT 'log', log10(l_extendedprice), 39 FROM {lineitem}), e AS (SELECT scale, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1)
 SELECT v.scale, CAST(least(floor((x - lo) * n / (hi - lo)), n - 1) AS INT) AS bin, count(*) AS count FROM v JOIN e ON v.scale = e.scale GROUP BY ALL""")
def a15(spark, sf):
    df = table(spark, sf, "lineitem")
    lin = prof.histogram(df, "l_extendedprice", 40).withColumn("scale", F.lit("linear"))
    log = prof.histogram(df, "l_extendedprice", 39, log=True).withColumn("scale", F.lit("log"))
    return lin.unionByName(log)


@query("a16_density_grid", """WITH v AS (SELECT l_quantity AS x, log10(l_extendedprice) AS y FROM {lineitem}),
 e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
 SELECT CAST(least(floor((x - x0) * 20 / (x1 - x0)), 19) AS INT) AS x_bin, CAST(least(floor((y - y0) * 15 / (y1 - y0)), 14) AS INT) AS y_bin,
 count(*) AS count FROM v, e GROUP BY ALL""")
def a16(spark, sf):
    return prof.density_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20, 15)


@query("a17_quartile_summary", f"""SELECT p_brand, count(*) AS n, min(p_retailprice) AS min, max(p_retailprice) AS max,
 {r('quantile_cont(p_retailprice, 0.25)')} AS q25, {r('median(p_retailprice)')} AS median, {r('quantile_cont(p_retailprice, 0.75)')} AS q75
 FROM {{part}} GROUP BY 1 HAVING count(*) >= 75""")
def a17(spark, sf):
    return rounded(prof.quartile_summary(table(spark, sf, "part"), "p_brand", "p_retailprice", 75))


def sql_spearman(src: str, a: str, b: str) -> str:
    avg_rank = lambda c: (
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0")
    return (f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r('corr(ra, rb)')} AS rho FROM (SELECT {avg_rank(a)} AS ra, "
            f"{avg_rank(b)} AS rb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


NUMBERS = ("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "d", "t", "y")


@query("a18_rank_correlation_matrix", f"WITH c AS ({SPARSE}) " + " UNION ALL ".join(sql_spearman("c", a, b) for a, b in combinations(NUMBERS, 2)))
def a18(spark, sf):
    return rounded(prof.rank_correlation_matrix(frame(spark, sf, SPARSE), NUMBERS))


# Prices are whole cents: a sum of integers gives equal means to groups of equal orders, whatever the order of adding.
PER_GROUP = """SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100 * count(o_totalprice)) AS mean_price,
 count(*) AS n_orders FROM {orders} GROUP BY 1"""


@query("a19_rank_correlation", f"WITH g AS ({PER_GROUP}) SELECT n, rho FROM ({sql_spearman('g', 'mean_price', 'n_orders')})")
def a19(spark, sf):
    return rounded(prof.rank_correlation(frame(spark, sf, PER_GROUP), "mean_price", "n_orders"))


# Twice the tail of the t distribution, as one less the area of its density around zero (Simpson's rule).
@query("a19_rank_correlation_p", f"""WITH g AS ({PER_GROUP}), s AS ({sql_spearman('g', 'mean_price', 'n_orders').replace(r('corr(ra, rb)'), 'corr(ra, rb)')}),
 t AS (SELECT n, rho, (n - 2)::DOUBLE AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM s),
 f AS (SELECT n, rho, t, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(t * i / 2000.0, 2) / v, -(v + 1) / 2)
   * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS y FROM t, range(2001) k(i))
 SELECT n, {r('rho')} AS rho, {r('greatest(0.0::DOUBLE, 1 - 2 * sum(y) * t / 6000.0)')} AS p_value FROM f GROUP BY n, rho, t""")
def a19p(spark, sf):
    rho = prof.rank_correlation(frame(spark, sf, PER_GROUP), "mean_price", "n_orders")
    return rounded(prof.correlation_p_value(rho))


# Taxes are whole hundredths: their integer sum tells a mean of exactly the limit from one below it.
SCORED_GROUPS = "SELECT l_suppkey, CAST(12 * sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (100 * count(l_tax)) AS v, " \
    "count(*) AS w FROM {lineitem} WHERE l_suppkey % 4 <> 0 GROUP BY 1 " \
    "UNION ALL SELECT l_suppkey, NULL, count(*) FROM {lineitem} WHERE l_suppkey % 4 = 0 GROUP BY 1"


@query("a20_weighted_summary", f"""WITH g AS ({SCORED_GROUPS}) SELECT count(*) AS n, {r('avg(v)')} AS mean, {r('sum(v * w) / sum(w)')} AS weighted_mean,
 CAST(count(*) FILTER (v < 0.48) AS BIGINT) AS below_0_48, {r('median(v)')} AS median FROM g WHERE v IS NOT NULL""")
def a20(spark, sf):
    return rounded(prof.weighted_summary(frame(spark, sf, SCORED_GROUPS), "v", "w", [0.48]))


@query("a21_class_balance", f"""WITH c AS ({LINES}) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
 {r('avg(y)')} AS rate, {r('sum(1 - y) / greatest(sum(y), 1)')} AS neg_pos_ratio FROM c""")
def a21(spark, sf):
    return rounded(prof.class_balance(frame(spark, sf, LINES), "y"))


@query("a22_duplicate_counts", f"""WITH k AS (SELECT count(*) AS c FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag)
 SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_removed, {r('100.0 * sum(c - 1) / sum(c)')} AS removed_pct FROM k""")
def a22(spark, sf):
    from kinfold.operators.identity import duplicate_counts

    return rounded(duplicate_counts(table(spark, sf, "lineitem"),
                                    ["l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag"]))


SPLIT_ROWS = "SELECT o_orderkey, o_custkey, CAST(o_orderkey % 40 AS INT) AS fold FROM {orders}"


@query("a23_split_contamination", f"""WITH c AS ({SPLIT_ROWS}), e AS (SELECT o_custkey % 700 AS ent, count(*) AS n, count(DISTINCT fold) AS k FROM c GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(COALESCE(sum(n) FILTER (k > 1), 0) AS BIGINT) AS n_contaminated, count(*) AS n_entities,
 count(*) FILTER (k > 1) AS n_split_entities FROM e""")
def a23(spark, sf):
    from kinfold.operators.identity import split_contamination

    return split_contamination(frame(spark, sf, SPLIT_ROWS).withColumn("ent", F.col("o_custkey") % 700), "ent", "fold")


@query("a24_group_target_summary", f"""SELECT o_custkey, {r('avg(o_totalprice)')} AS y_mean, {r('median(o_totalprice)')} AS y_median, count(*) AS y_count
 FROM {{orders}} GROUP BY 1""")
def a24(spark, sf):
    return rounded(prof.group_target_summary(table(spark, sf, "orders"), "o_custkey", "o_totalprice"))


# ---- windows ---------------------------------------------------------------

@query("w1_group_mean", f"""SELECT o_orderkey, {r('avg(o_totalprice) OVER (PARTITION BY o_custkey)')} AS mean_price FROM {{orders}}""")
def w1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(rank.attach_group_mean(df, "o_custkey", "o_totalprice", "mean_price").select("o_orderkey", "mean_price"))


PARETO_SQL = f"""WITH s AS (SELECT o_custkey, count(*) AS n FROM {{orders}} GROUP BY 1), c AS (SELECT o_custkey, n,
 row_number() OVER w AS position, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_rows, sum(n) OVER () AS total
 FROM s WINDOW w AS (ORDER BY n DESC, {sql_hash(42, 'o_custkey')}, o_custkey))"""


@query("w2_pareto", f"{PARETO_SQL} SELECT o_custkey, n, position, cum_rows, {r('100.0 * cum_rows / total')} AS cum_pct FROM c")
def w2(spark, sf):
    return rounded(rank.pareto(table(spark, sf, "orders"), "o_custkey"))


@query("w2_groups_to_reach", f"{PARETO_SQL} SELECT count(*) AS n_groups, count(*) FILTER (100.0 * cum_rows / total < 80) + 1 AS n_needed FROM c")
def w2b(spark, sf):
    return rank.groups_to_reach(table(spark, sf, "orders"), "o_custkey")


GAPS_SQL = """WITH v AS (SELECT DISTINCT 'l_extendedprice' AS variable, l_extendedprice AS hi FROM {lineitem} UNION ALL
 SELECT DISTINCT 'l_quantity', l_quantity FROM {lineitem} UNION ALL SELECT DISTINCT 'l_discount', l_discount FROM {lineitem}),
 g AS (SELECT variable, lag(hi) OVER (PARTITION BY variable ORDER BY hi) AS lo, hi FROM v), k AS (SELECT variable, lo, hi,
 CASE WHEN variable = 'l_extendedprice' THEN log10(hi) - log10(lo) ELSE hi - lo END AS gap FROM g WHERE lo IS NOT NULL)"""


@query("w3_coverage_gaps", f"{GAPS_SQL} SELECT variable, lo, hi, {r('gap')} AS gap FROM k")
def w3(spark, sf):
    return rounded(rank.coverage_gaps(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], ["l_extendedprice"]))


@query("w4_top_gaps", f"""{GAPS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY gap DESC, lo) AS rank FROM k)
 SELECT variable, CAST(rank AS INT) AS rank, lo, hi, {r('gap')} AS gap FROM t WHERE rank <= 8""")
def w4(spark, sf):
    return rounded(rank.top_gaps(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], 8, ["l_extendedprice"]))


@query("w5_first_seen_codes", """SELECT user_id, min(event_id) AS first_row, row_number() OVER (ORDER BY min(event_id)) - 1 AS code
 FROM {events} GROUP BY 1""")
def w5(spark, sf):
    return rank.first_seen_codes(table(spark, sf, "events"), "user_id", "event_id")


@query("w6_largest_groups", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def w6(spark, sf):
    return rank.largest_groups(table(spark, sf, "orders"), "o_custkey", 25)


@query("w7_top_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def w7(spark, sf):
    return rank.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", 30)


REPEATS = "SELECT CAST(l_linenumber AS INT) AS model, l_suppkey AS repeat, avg(l_extendedprice) AS rmse FROM {lineitem} GROUP BY 1, 2"


@query("w8_representative_repeat", f"""WITH c AS ({REPEATS}), m AS (SELECT *, avg(rmse) OVER (PARTITION BY model) AS mm FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(rmse - mm), repeat) AS i FROM m)
 SELECT model, repeat, {r('mm', 4)} AS mean_metric FROM k WHERE i = 1""")
def w8(spark, sf):
    return rounded(rank.representative_repeat(frame(spark, sf, REPEATS), "model", "repeat", "rmse"), 4)


@query("w9_order_by_metric", f"""WITH c AS ({REPEATS}), m AS (SELECT model, avg(rmse) AS a FROM c GROUP BY 1) SELECT model, count(*) AS n,
 CAST(row_number() OVER (ORDER BY min(a), model) AS INT) AS place FROM c JOIN m USING (model) GROUP BY model""")
def w9(spark, sf):
    c = frame(spark, sf, REPEATS)
    per = c.groupBy("model").agg(F.count("*").alias("n"))
    ordered = rank.order_by_metric(per, "model", c, "rmse")
    # the place of each model (a handful of rows) makes the order visible in the result
    return ordered.agg(F.collect_list(F.struct("model", "n")).alias("l")).select(F.posexplode("l").alias("i", "m")).select(
        "m.model", "m.n", (F.col("i") + 1).alias("place"))


QBINS_SQL = """e AS (SELECT list_distinct([quantile_cont(v, 1/6.0), quantile_cont(v, 2/6.0), quantile_cont(v, 3/6.0), quantile_cont(v, 4/6.0),
 quantile_cont(v, 5/6.0)]) AS edges, min(v) AS lo, max(v) AS hi FROM c)"""


@query("w10_quantile_bins", f"""WITH c AS (SELECT l_suppkey, l_discount AS v FROM {{lineitem}}), {QBINS_SQL}
 SELECT CAST(len(list_filter(edges, lambda x: x < v AND x > lo AND x < hi)) AS INT) AS bin, count(*) AS n, min(v) AS lo, max(v) AS hi FROM c, e GROUP BY 1""")
def w10(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_discount").alias("v"))
    b = rank.quantile_bins(df, "v", 6)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("w11_first_per_document", """SELECT user_id, event_id, CAST(i AS INT) AS excerpt FROM (SELECT user_id, event_id,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {events}) WHERE i <= 5""")
def w11(spark, sf):
    return rank.first_per_document(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


# ---- joins and set operations -------------------------------------------------

@query("j1_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_n FROM {orders}")
def j1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return comb.attach_group_size(df, "o_custkey").select("o_orderkey", "group_n")


@query("j2_left_by_group", f"""SELECT c_custkey, n, {r('m')} AS m FROM (SELECT c_custkey FROM {{customer}}) LEFT JOIN
 (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM {{orders}} WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def j2(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey")
    right = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return rounded(comb.left_by_group(left, right, "c_custkey"))


@query("j3_aligned_results", f"""WITH f AS ({FOLDS}) SELECT a.seed, a.fold, {r('a.roc_auc')} AS roc_auc_a, {r('b.roc_auc')} AS roc_auc_b
 FROM f a JOIN f b USING (seed, fold) WHERE a.method = 1 AND b.method = 2""")
def j3(spark, sf):
    f = frame(spark, sf, FOLDS)
    return rounded(comb.aligned(f.where("method = 1"), f.where("method = 2"), ["seed", "fold"], ["roc_auc"]))


@query("j3_common_keys", """SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'R' AND l_tax = 0.08 INTERSECT
 SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'A' AND l_discount = 0.1""")
def j3b(spark, sf):
    df = table(spark, sf, "lineitem")
    return comb.common_keys(df.where("l_returnflag = 'R' AND l_tax = 0.08"), df.where("l_returnflag = 'A' AND l_discount = 0.1"),
                            ["l_suppkey", "l_linenumber"])


@query("j4_rows_in_groups", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
def j4(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    g = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return comb.rows_in_groups(df, g, "o_custkey").select("o_orderkey")


@query("j5_rows_outside_groups", "SELECT o_orderkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
def j5(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    g = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return comb.rows_outside_groups(df, g, "o_custkey").select("o_orderkey")


@query("j5_leave_out_aggregate", f"""WITH g AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS s FROM {{lineitem}} GROUP BY 1)
 SELECT a.l_suppkey, CAST(sum(b.n) AS BIGINT) AS n, {r('sum(b.s)')} AS s FROM g a JOIN g b ON a.l_suppkey <> b.l_suppkey GROUP BY 1""")
def j5b(spark, sf):
    return rounded(comb.leave_out_aggregate(table(spark, sf, "lineitem"), "l_suppkey",
                                            {"n": F.lit(1).cast("bigint"), "s": F.col("l_quantity")}))


@query("j6_method_pairs", f"""WITH f AS ({FOLDS}) SELECT a.method AS a, b.method AS b, count(*) AS n, {r('avg(a.roc_auc - b.roc_auc)')} AS delta
 FROM f a JOIN f b ON a.seed = b.seed AND a.fold = b.fold AND a.method < b.method GROUP BY 1, 2""")
def j6(spark, sf):
    from kinfold.operators.stattests import paired_deltas

    d = paired_deltas(frame(spark, sf, FOLDS), "method", ["seed", "fold"], ["roc_auc"])
    return rounded(d.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("delta")))


@query("j7_candidate_runs", """SELECT seed, fold, candidate, depth, rate FROM (SELECT DISTINCT CAST(l_suppkey % 3 AS INT) AS seed,
 CAST(l_suppkey % 5 AS INT) AS fold FROM {lineitem}), (VALUES (0, 3.0::DOUBLE, 0.1::DOUBLE), (1, 5.0, 0.1), (2, 5.0, NULL)) c(candidate, depth, rate)""")
def j7(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("seed"),
                                            (F.col("l_suppkey") % 5).cast("int").alias("fold")).distinct()
    return comb.candidate_runs([{"depth": 3, "rate": 0.1}, {"depth": 5, "rate": 0.1}, {"depth": 5}], s)


@query("u1_stack_results", """SELECT 'orders' AS src, o_orderkey AS k, o_totalprice AS v, NULL AS extra FROM {orders} UNION ALL
 SELECT 'events', event_id, value, event_type FROM {events}""")
def u1(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("k"), F.col("value").alias("v"),
                                          F.col("event_type").alias("extra"))
    return comb.stack_results([a, b])


@query("u2_shared_groups", """SELECT o_custkey FROM {orders} WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderkey % 2 = 1""")
def u2(spark, sf):
    df = table(spark, sf, "orders").withColumn("side", F.col("o_orderkey") % 2)
    return splits.shared_groups(df, "o_custkey", "side")


@query("u3_distinct_values", "SELECT DISTINCT p_brand FROM {part}")
def u3(spark, sf):
    return comb.distinct_values(table(spark, sf, "part"), "p_brand")
