"""Joins and set operations between result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.plans.ordered import lookup


def attach_group_size(df: DataFrame, group: str, out: str = "group_n") -> DataFrame:
    """Size of the row's group next to every row."""
    return lookup(df, df.groupBy(group).agg(F.count("*").alias(out)), [group])


def left_by_group(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    return left.join(right, group, "left")


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows of two result sets that share their keys, columns suffixed ``_a`` and ``_b``."""
    side = lambda d, s: d.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(a, "a").join(side(b, "b"), list(keys))


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def rows_in_groups(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows whose group is listed (each kept once; hot groups stay split)."""
    return lookup(df, groups.select(group).distinct(), [group], "inner").select(*df.columns)


def rows_outside_groups(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Complement of ``rows_in_groups``; rows without a group stay."""
    marked = lookup(
        df, groups.select(group).distinct().withColumn("__in", F.lit(True)), [group]
    )
    return marked.where(F.col("__in").isNull()).select(*df.columns)


def leave_out_aggregate(
    df: DataFrame, group: str, sums: Mapping[str, Column]
) -> DataFrame:
    """For every group the sums over all *other* rows: total minus own, one pass."""
    per = df.groupBy(group).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    total = per.agg(F.struct(*[F.sum(k).alias(k) for k in sums]).alias("t")).scalar()
    return per.withColumn("__t", total).select(
        group, *[(F.col(f"__t.{k}") - F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums]
    )


def candidate_runs(candidates: Sequence[Mapping[str, float]], splits: DataFrame) -> DataFrame:
    """Every candidate setting on every (seed, fold): the candidate list is unrolled per split row."""
    keys = sorted({k for c in candidates for k in c})
    rows = F.array(*[
        F.struct(F.lit(i).alias("candidate"),
                 *[F.lit(c.get(k)).cast("double").alias(k) for k in keys])
        for i, c in enumerate(candidates)
    ])
    return splits.select("*", F.inline(rows))


def stack_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()
