"""Result-table summaries: gaps, best model, threshold spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def generalisation_gap(
    df: DataFrame, model: str, strategy: str, metric: str, first: str, second: str
) -> DataFrame:
    """Mean metric per model under two strategies side by side, and first - second."""
    wide = df.groupBy(model).pivot(strategy, [first, second]).agg(F.avg(metric))
    return wide.withColumn("gap", F.col(f"`{first}`") - F.col(f"`{second}`"))


def augmentation_delta(
    df: DataFrame, model: str, condition: str, metric: str, plain: str, augmented: str
) -> DataFrame:
    """Same for augmented - plain training."""
    wide = generalisation_gap(df, model, condition, metric, augmented, plain)
    return wide.withColumnRenamed("gap", "delta")


def best_model(
    df: DataFrame, model: str, metric: str, by: Sequence[str] = (), largest: bool = True
) -> DataFrame:
    """Model with the best mean metric (by name on a tie)."""
    mean = df.groupBy(*by, model).agg(F.avg(metric).alias("__m"))
    key = -F.col("__m") if largest else F.col("__m")
    return mean.groupBy(*by).agg(F.min_by(model, F.struct(key, F.col(model))).alias("best_model"))


def threshold_spread(df: DataFrame, method: str, thresholds: Sequence[str]) -> DataFrame:
    """Smallest, largest and range of every tuned threshold over the folds."""
    aggs = []
    for t in thresholds:
        aggs += [F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"),
                 (F.max(t) - F.min(t)).alias(f"{t}_spread")]
    return df.groupBy(method).agg(*aggs)
