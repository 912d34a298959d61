"""Paired comparison of methods over identical folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.special import normal_two_sided
from kinfold.plans.ordered import average_ranks

EXACT_UP_TO = 50


def paired_deltas(
    folds: DataFrame, method: str, keys: Sequence[str], metrics: Sequence[str],
    baseline: str | None = None,
) -> DataFrame:
    """Long table (a, b, keys, metric, d = a - b) over the folds both methods have.

    With ``baseline`` b is the baseline; otherwise every pair a < b once.
    """
    left = folds.select(F.col(method).alias("a"), *keys, *[F.col(m).alias(f"a_{m}") for m in metrics])
    right = folds.select(F.col(method).alias("b"), *keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    if baseline is None:
        j = left.join(right, list(keys)).where(F.col("a") < F.col("b"))
    else:
        j = left.where(F.col("a") != baseline).join(
            right.where(F.col("b") == baseline), list(keys)
        )
    return j.select("a", "b", *keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 (F.col(f"a_{m}") - F.col(f"b_{m}")).cast("double").alias("d"))
        for m in metrics
    ])))


def _exact_p(n: Column, w: Column) -> Column:
    """Two-sided exact p of W = min rank sum without ties, by counting subset sums.

    ``aggregate`` folds the ranks 1..n into an array c[s] = number of rank
    subsets with sum s, so the null distribution is built inside the expression.
    """
    top = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: (s == 0).cast("double"))
    counts = F.aggregate(
        F.sequence(F.lit(1), n), start,
        lambda acc, r: F.transform(
            acc, lambda x, s: x + F.when(s >= r, F.element_at(acc, F.greatest(s - r + 1, F.lit(1))))
            .otherwise(0.0),
        ),
    )
    low = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0),
                      lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), n))


def signed_rank(deltas: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """Wilcoxon signed-rank test per group: n_used, mean delta, W, p.

    Zero differences are dropped (all zero gives p = 1).  Exact null up to 50
    differences without ties, else the tie-corrected normal approximation.
    """
    by = list(by)
    x = deltas.withColumn("__m", F.round(F.abs(d), 12)).where(F.col(d).isNotNull())
    used = x.where(F.col("__m") > 0)
    ranks = average_ranks(used, "__m", by).drop("n")
    cells = used.groupBy(*by, "__m").agg(
        F.sum(F.when(F.col(d) > 0, 1).otherwise(0)).alias("k_pos"), F.count("*").alias("k")
    )
    r = cells.join(ranks, [*by, "__m"]).groupBy(*by).agg(
        F.sum("k").cast("int").alias("n_used"),
        F.sum(F.col("rank") * F.col("k_pos")).alias("w_pos"),
        F.sum(F.col("rank") * (F.col("k") - F.col("k_pos"))).alias("w_neg"),
        F.sum(F.pow(F.col("k"), 3) - F.col("k")).alias("ties"),
    )
    base = x.groupBy(*by).agg(F.count("*").alias("n_folds"), F.avg(d).alias("delta"))
    t = base.join(r, by, "left").withColumn("w", F.least("w_pos", "w_neg"))
    n = F.col("n_used")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w") - mean, F.sqrt(var))
    approx = F.pandas_udf(normal_two_sided, "double")
    exact = (n <= EXACT_UP_TO) & (F.col("ties") == 0)
    # the array for the exact null is only built where it applies
    safe_n = F.when(exact, n).otherwise(F.lit(1))
    safe_w = F.when(exact, F.col("w")).otherwise(F.lit(0.0))
    t = t.withColumn("__pe", _exact_p(safe_n, safe_w)).withColumn("__pa", approx(z))
    p = F.when(n.isNull(), F.lit(1.0)).when(exact, F.col("__pe")).otherwise(F.col("__pa"))
    return t.select(*by, "n_folds", "delta", F.coalesce(n, F.lit(0)).alias("n_used"), "w",
                    p.alias("p_value"))


def paired_analysis(
    folds: DataFrame, method: str, keys: Sequence[str], metrics: Sequence[str], baseline: str
) -> DataFrame:
    """Every method against the baseline: mean delta (method - baseline) and p per metric."""
    d = paired_deltas(folds, method, keys, metrics, baseline)
    return signed_rank(d, ["a", "b", "metric"])


def pairwise_analysis(
    folds: DataFrame, method: str, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Every pair of methods, delta = a - b."""
    return signed_rank(paired_deltas(folds, method, keys, metrics), ["a", "b", "metric"])
