"""Exact, tie-corrected scoring of predictions, overall or per group.

Everything that needs the score order is computed from ``score_curve``: one row
per distinct (group, score) with cumulative counts from a bucketed sort.
Undefined metrics are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.plans.ordered import prefix_sums
from kinfold.plans.session import cut_lineage

MAPE_FLOOR = 1e-6


def score_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per distinct score: pos, neg at it; tp, fp at ``score >= threshold``; totals P, N."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("double")
    zero = F.lit(0).cast("bigint") if weight is None else F.lit(0.0)
    p = prefix_sums(
        df.where(F.col(label).isNotNull()), score,
        {"pos": F.when(F.col(label) == 1, w).otherwise(zero),
         "neg": F.when(F.col(label) == 0, w).otherwise(zero)}, by,
    )
    return p.select(
        *by, F.col(score).alias("threshold"), "pos", "neg", "pos_before", "neg_before",
        (F.col("pos_total") - F.col("pos_before")).alias("tp"),
        (F.col("neg_total") - F.col("neg_before")).alias("fp"),
        F.col("pos_total").alias("P"), F.col("neg_total").alias("N"),
    )


def _auc() -> Column:
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    both = (F.max("P") > 0) & (F.max("N") > 0)
    return F.when(both, area / (F.max("P") * F.max("N")))


def _average_precision() -> Column:
    step = F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return F.when(F.max("P") > 0, F.sum(F.when(F.col("pos") > 0, step).otherwise(0.0)))


def ranking_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """ROC-AUC and average precision with class totals.  AP needs both classes too."""
    c = score_curve(df, label, score, by, weight)
    return c.groupBy(*by).agg(
        F.max("P").alias("n_pos"), F.max("N").alias("n_neg"), _auc().alias("roc_auc"),
        F.when((F.max("P") > 0) & (F.max("N") > 0), _average_precision()).alias("pr_auc"),
    )


def confusion(df: DataFrame, label: str, predicted: str | Column, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label)
    q = F.col(predicted) if isinstance(predicted, str) else predicted
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*by).agg(
        n((y == 1) & (q == 1)).alias("tp"), n((y == 0) & (q == 1)).alias("fp"),
        n((y == 1) & (q == 0)).alias("fn"), n((y == 0) & (q == 0)).alias("tn"),
    )


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The battery as expressions over (weighted) counts."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    rate = lambda a, b: F.try_divide(a, b)
    rec_pos, rec_neg = rate(tp, tp + fn), rate(tn, tn + fp)
    recalls = F.coalesce((rec_pos + rec_neg) / 2, rec_pos, rec_neg)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    two_class = (tp + fn > 0) & (tn + fp > 0)
    return {
        "accuracy": rate(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": recalls,
        "precision": F.coalesce(rate(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(rec_pos, F.lit(0.0)),
        "f1": F.coalesce(rate(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "mcc": F.when(two_class, F.coalesce(rate(tp * tn - fp * fn, den), F.lit(0.0))),
    }


def classification_battery(
    df: DataFrame, label: str, predicted: str | Column, score: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    c = confusion(df, label, predicted, by)
    m = confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    out = c.select(
        *by, "tp", "fp", "fn", "tn", *[e.alias(k) for k, e in m.items()],
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("n_positive"),
    )
    if score is None:
        return out
    r = ranking_metrics(df, label, score, by).drop("n_pos", "n_neg")
    if by:
        return out.join(r, list(by), "left")
    return out.withColumn("roc_auc", r.select("roc_auc").scalar()).withColumn(
        "pr_auc", r.select("pr_auc").scalar()
    )


def regression_battery(
    df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """R2, RMSE, MAE, MAPE, MBE, NRMSE and n in one aggregate."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    e = p - y
    n = F.count("*")
    mse, var = F.avg(e * e), F.var_pop(y)
    rmse = F.sqrt(mse)
    ape = F.when(F.abs(y) > MAPE_FLOOR, F.abs(e / y))
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.when((n >= 2) & (var > 0), 1 - mse / var).alias("r2"),
        rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(ape) * 100).alias("mape"),
        F.avg(e).alias("mbe"),
        F.when(F.abs(F.avg(y)) > 1e-12, rmse / F.avg(y)).alias("nrmse"), n.alias("n"),
    )


def operating_points(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """ROC and PR point of every distinct score (no collinear point is dropped)."""
    c = score_curve(df, label, score, by, weight)
    return c.select(
        *by, "threshold", "tp", "fp", "P", "N",
        F.try_divide(F.col("fp"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("P")).alias("tpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def optimal_thresholds(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Thresholds that maximise MCC, F1, balanced accuracy and Youden's J.

    Among equal maxima the highest threshold wins; the result is clipped to [0, 1].
    """
    o = operating_points(df, label, score, by, weight)
    fn, tn = F.col("P") - F.col("tp"), F.col("N") - F.col("fp")
    m = confusion_metrics(F.col("tp"), F.col("fp"), fn, tn)
    scored = o.select(
        *by, "threshold", F.coalesce(m["mcc"], F.lit(0.0)).alias("mcc"), m["f1"].alias("f1"),
        (0.5 * (F.col("tpr") + (1 - F.col("fpr")))).alias("balanced_accuracy"),
        (F.col("tpr") - F.col("fpr")).alias("youden_j"),
    )
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    # rounding keeps equal-by-definition metric values equal before ties are broken
    pick = lambda k: clip(
        F.max_by("threshold", F.struct(F.round(k, 12), F.col("threshold")))
    ).alias(f"thr_{k}")
    names = ("mcc", "f1", "balanced_accuracy", "youden_j")
    return scored.groupBy(*by).agg(*[pick(k) for k in names])


def best_f1_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Best-F1 point of the PR curve; among equal maxima the lowest threshold wins."""
    o = operating_points(df, label, score, by)
    f1 = F.round(
        2 * F.col("precision") * F.col("tpr")
        / F.greatest(F.col("precision") + F.col("tpr"), F.lit(1e-12)), 12,
    )
    return o.withColumn("f1", f1).groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )


def group_win_count(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """How many scorable groups model ``b`` improves over ``a``, with both mean scores."""
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ok.agg(
        F.count("*").alias("n_scorable"),
        F.sum((F.col(b) > F.col(a)).cast("long")).alias("n_improved"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
    )


def ranking_decomposition(df: DataFrame, group: str, label: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Pooled vs between-group vs within-group AUC, and the per-group table behind it.

    Every part is made of counts of equal (group, label, score), so the rows are read and shuffled
    once; a group's rows share its mean, so its classes are counted and no row looks it up.
    """
    from kinfold.operators.profiling import weighted_summary

    cells = cut_lineage(df.groupBy(group, label, score).agg(F.count("*").alias("__w")))
    w, y, q = F.col("__w"), F.col(label), F.col(score)
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    mean = lambda v, c: F.try_divide(F.sum(F.when(c, v * w)), n(c & v.isNotNull()))
    hit = q >= 0.5
    per = cells.groupBy(group).agg(
        F.sum(w).alias("n_rows"), mean(y, F.lit(True)).alias("positive_rate"),
        mean(q, y == 1).alias("mean_pred_pos"), mean(q, y == 0).alias("mean_pred_neg"),
        F.round(mean(q, F.lit(True)), 12).alias("__mean"), n(y == 1).alias("__pos"), n(y == 0).alias("__neg"),
        *[n(c).alias(f"__{k}") for k, c in (
            ("tp", (y == 1) & hit), ("fp", (y == 0) & hit), ("fn", (y == 1) & ~hit), ("tn", (y == 0) & ~hit))],
    )
    per = cut_lineage(per)
    bal = confusion_metrics(*[F.col(f"__{k}") for k in ("tp", "fp", "fn", "tn")])["balanced_accuracy"]
    auc = ranking_metrics(cells, label, score, [group], "__w").select(
        group, F.col("roc_auc").alias("within_auc")
    )
    table = per.join(auc, group, "left").select(
        group, "n_rows", "positive_rate", "mean_pred_pos", "mean_pred_neg", "within_auc",
        F.when(F.col("within_auc").isNotNull(), bal).alias("balanced_acc_05"))
    within = weighted_summary(table, "within_auc", "n_rows", [0.5, 0.6])
    pooled = ranking_metrics(cells, label, score, weight="__w").select("roc_auc").scalar()
    sides = per.select("__mean", F.inline(F.array(*[
        F.struct(F.lit(k).alias("y"), F.col(c).alias("w")) for k, c in ((1, "__pos"), (0, "__neg"))])))
    between = ranking_metrics(sides, "y", "__mean", weight="w").select("roc_auc").scalar()
    summary = within.select(
        pooled.alias("pooled_auc"), between.alias("between_auc"),
        F.col("mean").alias("within_auc_mean"), F.col("median").alias("within_auc_median"),
        F.col("weighted_mean").alias("within_auc_weighted"),
        F.col("below_0_5").alias("groups_below_05"), F.col("below_0_6").alias("groups_below_06"),
        F.col("n").alias("n_two_class_groups"),
    )
    return summary, table
