"""Ordered plans, metrics, splits and resampling against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import audit, metrics, neighbours, profiling, ranking, resampling, splits, stattests, weights
from kinfold.operators import identity as ids
from kinfold.plans import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, few distinct values, missing values, a NULL group."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 2 else f"g{rng.randint(0, 20)}"
        v = None if i % 17 == 0 else float(rng.randint(0, 40)) * (1 if i % 3 else 0.5)
        rows.append((i, None if i % 101 == 0 else g, v, rng.randint(0, 1), rng.choice([0.1, 0.25, 0.5, 0.75])))
    pdf = pd.DataFrame(rows, columns=["id", "g", "v", "y", "p"])
    return pdf, spark.createDataFrame(rows, "id long, g string, v double, y int, p double").cache()


def test_prefix_sums(skewed):
    pdf, df = skewed
    got = ordered.prefix_sums(df, "v", {"n": F.lit(1).cast("bigint")}, ["g"]).toPandas()
    for g, part in pdf.dropna(subset=["g", "v"]).groupby("g"):
        rows = got[got["g"] == g]
        assert rows["n"].sum() == len(part)
        for r in rows.itertuples():
            assert r.n_before == (part["v"] < r.v).sum() and r.n_total == len(part)


def test_quantiles_and_ranks(skewed):
    pdf, df = skewed
    got = ordered.quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.93}, ["g"]).toPandas().set_index("g")
    for g, part in pdf.dropna(subset=["g", "v"]).groupby("g"):
        for name, q in (("a", 0.1), ("m", 0.5), ("z", 0.93)):
            assert got.loc[g, name] == pytest.approx(part["v"].quantile(q))
    ranks = ordered.average_ranks(df, "v").toPandas().set_index("v")["rank"]
    want = pdf["v"].dropna().rank()
    for i, v in pdf["v"].dropna().items():
        assert ranks[v] == want[i]


def test_previous_value(skewed):
    pdf, df = skewed
    got = ordered.with_previous(df, "v").toPandas().sort_values("v")
    assert got["previous"].tolist()[1:] == sorted(pdf["v"].dropna().unique())[:-1]


def test_lookup_keeps_every_row_once(skewed):
    pdf, df = skewed
    t = df.groupBy("g").agg(F.count("*").alias("n"))
    out = ordered.lookup(df, t, ["g"]).toPandas()
    assert sorted(out["id"]) == sorted(pdf["id"])
    size = pdf["g"].value_counts(dropna=False)
    assert all(r.n == size[r.g] if r.g is not None else r.n == pdf["g"].isna().sum() for r in out.itertuples())


def test_group_rare_counts_null(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 3, "c string")
    got = sorted((r[0] or "", r[1]) for r in ids.group_rare(df, "c", 3).groupBy("c").count().collect())
    assert got == [("", 3), ("Other / Rare", 1), ("a", 3)]


def brute_auc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    d = p[pos][:, None] - p[neg][None, :]
    ww = w[pos][:, None] * w[neg][None, :]
    return ((d > 0) * ww + 0.5 * (d == 0) * ww).sum() / ww.sum()


def test_auc_with_ties_and_weights(skewed):
    pdf, df = skewed
    got = metrics.ranking_metrics(df, "y", "p", ["g"]).toPandas().set_index("g")
    for g, part in pdf.dropna(subset=["g"]).groupby("g"):
        if part["y"].nunique() == 2:
            assert got.loc[g, "roc_auc"] == pytest.approx(brute_auc(part["y"].values, part["p"].values))
    w = metrics.ranking_metrics(df.withColumn("w", F.col("id") % 5 + 1), "y", "p", (), "w").first()
    assert w["roc_auc"] == pytest.approx(brute_auc(pdf["y"].values, pdf["p"].values, pdf["id"].values % 5 + 1))


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.9)], "g string, y int, p double")
    r = metrics.ranking_metrics(df, "y", "p", ["g"]).first()
    assert r["roc_auc"] is None and r["pr_auc"] is None
    one = metrics.regression_battery(df.withColumn("q", F.lit(1.0)), "y", "q").first()
    assert one["r2"] is None and one["n"] == 2


def test_threshold_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 1.7), (0, 0.1)], "y int, p double")
    t = metrics.optimal_thresholds(df, "y", "p").first()
    assert t["thr_mcc"] == 0.8 and t["thr_youden_j"] == 0.8
    high = metrics.optimal_thresholds(df.where("p > 1 or y = 0"), "y", "p").first()
    assert high["thr_f1"] == 1.0  # 1.7 clipped


def test_splits_are_partitions(skewed):
    pdf, df = skewed
    k = splits.stratified_kfold(df, "y", ["id"], 5).toPandas()
    assert sorted(k["id"]) == sorted(pdf["id"])
    sizes = k.groupby(["y", "fold"]).size()
    assert sizes.groupby("y").max().sub(sizes.groupby("y").min()).max() <= 1
    g = splits.stratified_group_kfold(df, "g", "y", 4, [1, 2]).toPandas()
    assert (g.groupby(["seed", "g"]).size() == 1).all()
    assert set(g["g"]) == set(pdf["g"].dropna())
    h = splits.attach_groups(df, splits.group_holdout(df, "g"), "g").where("g is not null")
    splits.assert_disjoint(h, "g", "is_test")
    assert 0 < splits.shared_groups(df.withColumn("s", F.col("id") % 4), "g", "s").count()


def test_stratified_group_folds_are_one_pass_at_every_size(spark):
    n, k = 200_100, 5  # one group size after 200,000 used to change the rule
    df = spark.range(n).select(F.col("id").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = splits.stratified_group_kfold(df, "g", "y", k)
    order = got.withColumn("h", ordered.hash_key(F.col("seed"), "g")).orderBy("h", "g").toPandas()  # all gaps are 1
    y = order[["n_neg", "n_pos"]].to_numpy(dtype=float)
    held, total, want = np.zeros((k, 2)), y.sum(axis=0), []
    for row in y:
        trial = np.repeat(held[None, :, :], k, axis=0)
        trial[np.arange(k), np.arange(k)] += row
        spread = np.round((trial / total).std(axis=1).mean(axis=1), 12)
        best = min(range(k), key=lambda f: (spread[f], held[f].sum(), f))
        held[best] += row
        want.append(best)
    assert len(order) == n and order["fold"].tolist() == want


def test_weights_have_mean_one(skewed):
    _, df = skewed
    for s in weights.STRATEGIES:
        m = weights.combined_weights(df, "y", "g", s).where("g is not null").agg(F.avg("weight")).first()[0]
        assert m == pytest.approx(1.0, abs=0.05)
        t = weights.group_weight_table(df, "g", s)
        assert t.agg(F.sum(F.col("n") * F.col("weight")) / F.sum("n")).first()[0] == pytest.approx(1.0)


def test_bootstrap(skewed):
    pdf, df = skewed
    a = resampling.bootstrap_augment(df, ["id"], 500)
    assert a.count() == len(pdf) + 500 and a.where("is_extra").count() == 500
    m = resampling.group_multiplicities(df, "g", 5).groupBy("replicate").agg(F.sum("times").alias("s")).collect()
    assert {r["s"] for r in m} == {pdf["g"].nunique()}
    ci = resampling.pooled_ranking_intervals(df, "g", "y", "p", replicates=10).toPandas()
    assert (ci["ci_low"] <= ci["mean"]).all() and (ci["mean"] <= ci["ci_high"]).all()
    assert (ci["valid_iterations"] <= ci["bootstrap_iterations"]).all()
    one = resampling.mean_interval(df.where("id = 1"), "p", "id", (), 50).first()
    assert one["ci_low"] == one["mean"] == one["ci_high"]


def test_wilcoxon_exact_and_zero(spark):
    # 15 positive differences with ranks 1..15 and W = 10 on the negative side (ranks 1, 2, 3, 4)
    rows = [("a", i, -float(i) if i <= 4 else float(i)) for i in range(1, 16)] + [("z", i, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "m string, k int, d double")
    got = {r["m"]: r for r in stattests.signed_rank(df, ["m"]).collect()}
    count = sum(1 for s in range(1 << 15) if sum(j + 1 for j in range(15) if s >> j & 1) <= 10)
    assert got["a"]["w"] == 10 and got["a"]["p_value"] == pytest.approx(2 * count / 2**15)
    assert got["z"]["p_value"] == 1.0 and got["z"]["n_used"] == 0


def test_knn_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 4))
    base[100:200] = base[0]  # a third of the rows are copies
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "ref_id long, v array<double>, ref_label int")
    q = df.select(F.col("ref_id").alias("qid"), "v")
    old = neighbours.BLOCK_ROWS
    neighbours.BLOCK_ROWS = 40  # force several blocks per cell
    try:
        got = neighbours.knn_join(q, df, "qid", "v", 4).toPandas()
    finally:
        neighbours.BLOCK_ROWS = old
    d = np.sqrt(((base[:, None] - base[None]) ** 2).sum(axis=2))
    for i in range(300):
        want = sorted(range(300), key=lambda j: (d[i, j], j))[:4]
        assert got[got["qid"] == i].sort_values("rank")["ref_id"].tolist() == want


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_knn_prunes_clustered_rows(spark, metric):
    """Exact over several regions and blocks, with far fewer comparisons than pairs."""
    rng = np.random.default_rng(8)
    base = np.concatenate([c + 0.01 * rng.normal(size=(75, 3)) for c in rng.normal(size=(40, 3)) * 10])
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    rows += [(-1, None, 0)]
    df = spark.createDataFrame(rows, "ref_id long, v array<double>, ref_label int")
    q = df.select(F.col("ref_id").alias("qid"), "v")
    old, neighbours.BLOCK_ROWS = neighbours.BLOCK_ROWS, 100
    pairs, probed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    try:
        got = neighbours.knn_join(q, df, "qid", "v", 3, metric, exclude_self=True, counter=pairs).toPandas()
        probes = neighbours.probes_for(q, df, "qid", "v", 3, metric, exclude_self=True, target=0.95, sample=64)
        near = neighbours.knn_join(q, df, "qid", "v", 3, metric, exclude_self=True, probes=probes, counter=probed)
        found = neighbours.recall(near, spark.createDataFrame(got), "qid").first()
    finally:
        neighbours.BLOCK_ROWS = old
    n = len(base)
    assert len(got) == 3 * n and set(got["qid"]) == set(range(n))
    for i in range(0, n, 7):
        diff = np.abs(base[i] - base)
        d = diff.sum(axis=1) if metric == "l1" else np.sqrt((diff ** 2).sum(axis=1))
        want = sorted((j for j in range(n) if j != i), key=lambda j: (d[j], j))[:3]
        assert got[got["qid"] == i].sort_values("rank")["ref_id"].tolist() == want
    assert pairs.value < n * n / 20 and probed.value < n * n / 10
    assert found["recall"] >= 0.9 and found["queries"] == n


def test_leave_out_quantiles(skewed):
    pdf, df = skewed
    got = audit.leave_out_quantiles(df, "g", ["v", "p"]).toPandas()
    known = pdf.dropna(subset=["g"])
    for r in got.itertuples():
        rest = known[known["g"] != r.g][r.feature].dropna()
        assert (r.q0, r.q1, r.q2) == pytest.approx(tuple(rest.quantile([0.25, 0.5, 0.75])))


def test_neighbour_information(spark):
    """Same estimator by brute force on a small sample without ties."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 200)
    v = rng.normal(size=200) + 1.5 * y
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, y))], "id long, v double, y int")
    got = audit.neighbour_information(df, ["v"], "y", "id", 5).first()["mi"]
    euler = 0.5772156649015329

    def psi(n):
        return -euler + sum(1 / i for i in range(1, int(n)))

    total = 0.0
    for i in range(200):
        own = np.sort(np.abs(v[y == y[i]] - v[i]))[1:]
        r = own[4]
        m = (np.abs(v - v[i]) < r).sum()
        total += psi(5) - psi((y == y[i]).sum()) - psi(max(m, 1))
    assert got == pytest.approx(psi(200) + total / 200, abs=1e-6)


def test_identity_information(skewed):
    _, df = skewed
    r = audit.discrete_information(df, ["y"], "y").first()
    assert r["mi"] == pytest.approx(r["h_target"])  # MI(x, x) = H(x)


def test_shapley_sums_to_difference(spark):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    score = lambda d: d.withColumn("score", 2 * F.col("a") + F.col("a") * F.col("b"))
    c = audit.shapley_attribution(df, score, ["a", "b"], "id", 40, 2).groupBy("id").agg(
        F.sum("contribution").alias("s")).toPandas().set_index("id")["s"]
    own = {i: 2 * a + a * b for i, a, b in rows}
    mean = sum(own.values()) / len(own)
    for i in own:
        assert c[i] == pytest.approx(own[i] - mean)


def test_permutation_keeps_values_and_constant_is_zero(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, i % 2) for i in range(50)], "row_id long, a double, c double, y int")
    p = audit.permuted(df, "a", "row_id", 7).toPandas()
    assert sorted(p["a"]) == sorted(float(i) for i in range(50)) and p["a"].tolist() != sorted(p["a"])
    from kinfold.operators.models import ModelSpec

    spec = ModelSpec("tree", ("a", "c"))
    imp = audit.permutation_importance(df, lambda d: d.withColumn("score", F.col("c") * 0.3), spec, ["c"], 2)
    assert all(r["importance"] == 0 for r in imp.collect())


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert audit.average_linkage(["a", "b", "c"], d, 0.3) == {"a": 0, "b": 0, "c": 1}


def test_top_gaps_and_pareto(skewed):
    pdf, df = skewed
    top = ranking.top_gaps(df, ["v"], 2).toPandas()
    u = np.sort(pdf["v"].dropna().unique())
    assert top["gap"].max() == np.diff(u).max()
    par = ranking.pareto(df, "g").toPandas().sort_values("position")
    assert par["position"].tolist() == list(range(1, len(par) + 1))
    assert par["cum_rows"].tolist() == par["n"].cumsum().tolist() and par["n"].is_monotonic_decreasing


def test_group_kfold_equals_the_plain_greedy(spark):
    import random

    from kinfold.operators import splits

    rng = random.Random(3)
    for trial in range(300):
        k = rng.randint(1, 6)
        groups = [rng.choice([1, 1, 2, 3, rng.randint(1, 40)]) for _ in range(rng.randint(1, 60))]
        loads, want = [0] * k, []
        for n in sorted(groups, reverse=True):
            f = min(range(k), key=lambda f: (loads[f], f))
            loads[f] += n
            want.append(f)
        got = []
        for n, starts, orders in splits.deal([(n, groups.count(n)) for n in set(groups)], k):
            for pos in range(groups.count(n)):
                i = sum(s <= pos for s in starts) - 1
                got.append(orders[i][(pos - starts[i]) % len(orders[i])])
        assert got == want, (k, groups)
    names = {f"g{i}": rng.randint(1, 4) for i in range(60)}
    df = spark.createDataFrame([(g,) for g, n in names.items() for _ in range(n)], "g string")
    loads, want = [0] * 3, {}
    for g, n in sorted(names.items(), key=lambda x: (-x[1], x[0])):
        want[g] = min(range(3), key=lambda f: (loads[f], f))
        loads[want[g]] += n
    assert {r.g: r.fold for r in splits.group_kfold(df, "g", 3).collect()} == want


def test_lookup_lets_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(100).selectExpr("id", "id % 3 AS g", "id * 2 AS q", "id AS a", "id AS b").write.parquet(path)
    df = spark.read.parquet(path)
    out = ordered.lookup(df, df.groupBy("g").agg(F.count("*").alias("n")), ["g"], salt_by=["id"]).where("q > 5").select("id", "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(q,5)" in plan
    assert "b#" not in plan and out.count() == 97


def test_rank_matrix_with_nulls(spark):
    """Pairwise-complete Spearman over columns with different, equal and no nulls, against pandas."""
    rng = np.random.default_rng(11)
    n = 400
    base = pd.DataFrame({c: rng.integers(0, 12, n).astype(float) for c in "abcd"})
    base["c"] += base["a"]
    base["e"] = base["b"] * 2 + rng.normal(size=n)
    base.loc[base.index % 3 == 0, "a"] = np.nan
    base.loc[base.index % 3 == 0, "b"] = np.nan
    base.loc[base.index % 5 == 0, "d"] = np.nan
    base["f"] = 1.0
    df = spark.createDataFrame(base.astype(object).where(base.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in base))
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in profiling.rank_correlation_matrix(df, list(base.columns)).collect()}
    assert len(got) == 15
    for (a, b), (m, rho) in got.items():
        both = base[[a, b]].dropna()
        assert m == len(both)
        if "f" in (a, b):
            assert rho is None
        else:
            assert rho == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-9)


def test_encoded_features_have_no_nulls(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (5.0, None), (9.0, "b")], "x double, c string")
    got = sorted(tuple(r) for r in profiling.encoded_features(df, ["x"], ["c"]).collect())
    assert got == [(1.0, 1.0), (5.0, -1.0), (5.0, 0.0), (9.0, 1.0)]


def test_side_medians(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g in range(60) for v in rng.integers(0, 500, rng.integers(1, 40))]
    df = spark.createDataFrame(rows, "g long, y double")
    scores, sides = splits.balanced_group_candidates(df, "g", "y", candidates=7, test_fraction=0.25)
    side = {}
    for r in sides.collect():
        side.setdefault(r["candidate"], {})[r["g"]] = r["is_test"]
    got = {r["candidate"]: r for r in scores.collect()}
    assert len(got) == 7
    for c, of in side.items():
        assert sum(of.values()) == 15
        for flag, name in ((True, "test"), (False, "train")):
            own = [v for g, v in rows if of[g] == flag]
            assert got[c][f"median_{name}"] == pytest.approx(np.median(own)) and got[c][f"n_rows_{name}"] == len(own)
            assert got[c][f"mean_{name}"] == pytest.approx(np.mean(own)) and got[c][f"std_{name}"] == pytest.approx(np.std(own))


def test_pooled_intervals_match_plain_resampling(spark):
    """Vector prefix sums over cells against one metric computation per replicate."""
    rng = np.random.default_rng(6)
    rows = [(int(g), int(rng.random() < 0.2 + 0.05 * (g % 8)), round(float(rng.random()), 1)) for g in range(12) for _ in range(30)]
    df = spark.createDataFrame(rows, "g long, y int, p double")
    got = {r["metric"]: r for r in resampling.pooled_ranking_intervals(df, "g", "y", "p", replicates=40).collect()}
    times = {}
    for r in resampling.group_multiplicities(df, "g", 40).collect():
        times.setdefault(r["replicate"], {})[r["g"]] = r["times"]
    auc, ap = [], []
    for t in times.values():
        flat = [(p, y) for g, y, p in rows for _ in range(t.get(g, 0))]
        pos, neg = [p for p, y in flat if y], [p for p, y in flat if not y]
        auc.append(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        tp = fp = area = 0
        for s in sorted({p for p, _ in flat}, reverse=True):
            k = sum(p == s for p in pos)
            tp, fp = tp + k, fp + sum(p == s for p in neg)
            area += k / len(pos) * tp / (tp + fp)
        ap.append(area)
    for name, v in (("pooled_roc_auc", auc), ("pooled_pr_auc", ap)):
        r = got[name]
        assert r["valid_iterations"] == 40 and r["mean"] == pytest.approx(np.mean(v))
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
