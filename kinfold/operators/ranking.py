"""Window, sort and top-k operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.profiling import group_sizes
from kinfold.plans.ordered import (
    hash_bucket, hash_key, lookup, prefix_sums, with_previous, with_value_bucket,
)


def attach_group_mean(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Group mean next to every row: aggregate, then salted lookup (hot groups stay split)."""
    return lookup(df, df.groupBy(group).agg(F.avg(value).alias(out)), [group])


def pareto(df: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Groups by falling size with running and cumulative share.

    Groups of equal size follow a seeded hash order.  Sizes are collapsed first,
    then ties are numbered, so the tail of one-row groups never meets in one task.
    """
    sizes = group_sizes(df, group).withColumn("neg", -F.col("n"))
    blocks = prefix_sums(sizes, "neg", {"rows": F.col("n"), "groups": F.lit(1)})
    ties = prefix_sums(
        sizes.withColumn("__h", hash_key(seed, group)), ["__h", group], {"__one": F.lit(1)},
        ["neg"], hash_bucket("__h"),
    )
    j = lookup(ties, blocks.select("neg", "rows_before", "rows_total", "groups_before"), ["neg"])
    n = -F.col("neg")
    cum = F.col("rows_before") + n * (F.col("__one_before") + 1)
    return j.select(
        group, n.alias("n"), (F.col("groups_before") + F.col("__one_before") + 1).alias("position"),
        cum.alias("cum_rows"), (100 * cum / F.col("rows_total")).alias("cum_pct"),
    )


def groups_to_reach(df: DataFrame, group: str, pct: float = 80.0) -> DataFrame:
    """How many of the largest groups hold ``pct`` percent of the rows."""
    p = pareto(df, group)
    return p.agg(
        F.count("*").alias("n_groups"),
        (F.sum((F.col("cum_pct") < pct).cast("long")) + 1).alias("n_needed"),
    )


def coverage_gaps(df: DataFrame, cols: Sequence[str], log: Sequence[str] = ()) -> DataFrame:
    """Differences of consecutive distinct values per variable (of log10 for ``log`` ones)."""
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("variable"),
            (F.when(F.col(c) > 0, F.col(c)) if c in log else F.col(c)).cast("double").alias("hi"),
        )
        for c in cols
    ])
    v = df.select(F.inline(pairs))
    gap = with_previous(v, "hi", ["variable"]).where(F.col("previous").isNotNull())
    size = F.when(
        F.col("variable").isin(list(log)), F.log10("hi") - F.log10("previous")
    ).otherwise(F.col("hi") - F.col("previous"))
    return gap.select("variable", F.col("previous").alias("lo"), "hi", size.alias("gap"))


def top_gaps(df: DataFrame, cols: Sequence[str], k: int, log: Sequence[str] = ()) -> DataFrame:
    """The k widest gaps per variable, numbered; equal gaps by rising position.

    Each hash bucket keeps its own best k first, so the final sort sees at most
    k rows per bucket and variable.
    """
    g = coverage_gaps(df, cols, log).withColumn("__b", F.pmod(F.xxhash64("lo"), F.lit(64)))
    order = [F.desc("gap"), F.asc("lo")]
    local = Window.partitionBy("variable", "__b").orderBy(*order)
    final = Window.partitionBy("variable").orderBy(*order)
    best = g.withColumn("r", F.row_number().over(local)).where(F.col("r") <= k)
    return (
        best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("variable", "rank", "lo", "hi", "gap")
    )


def first_seen_codes(df: DataFrame, group: str, row_id: str) -> DataFrame:
    """0-based code of each group in order of first appearance."""
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(row_id).alias("first_row"))
    p = prefix_sums(first, ["first_row", group], {"__one": F.lit(1)})
    return p.select(group, "first_row", F.col("__one_before").alias("code"))


def largest_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    return group_sizes(df, group).orderBy(F.desc("n"), F.asc(group)).limit(n)


def top_n(df: DataFrame, by: Column, tie: str, n: int) -> DataFrame:
    return df.orderBy(by, F.asc(tie)).limit(n)


def representative_repeat(df: DataFrame, model: str, repeat: str, metric: str) -> DataFrame:
    """Per model the repeat whose metric is closest to the model's mean."""
    mean = df.groupBy(model).agg(F.avg(metric).alias("mean_metric"))
    off = F.abs(F.col(metric) - F.col("mean_metric"))
    return df.join(mean, model).groupBy(model).agg(
        F.min_by(repeat, F.struct(off, F.col(repeat))).alias(repeat),
        F.first("mean_metric").alias("mean_metric"),
    )


def order_by_metric(df: DataFrame, key: str, metric_table: DataFrame, metric: str) -> DataFrame:
    """Rows of ``df`` ordered by another table's metric of their key."""
    best = metric_table.groupBy(key).agg(F.avg(metric).alias("__m"))
    return df.join(best, key).orderBy("__m", key).drop("__m")


def quantile_bins(df: DataFrame, value: str, max_bins: int = 6, out: str = "bin") -> DataFrame:
    """Quantile bin of every row, equal edges merged, right-closed; NULL below 8 values.

    Size, distinct count, range and the edges for every possible number of bins
    come from one bucketed sort, as one small row.
    """
    n = F.col("__n_total")
    p = prefix_sums(
        df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")),
        "__v", {"__n": F.lit(1).cast("bigint")},
    )
    hit = "max(CASE WHEN __n_before <= {k} AND {k} < __n_before + __n THEN __v END)"

    def edge(q: float) -> str:
        at = f"({q!r}D * (__n_total - 1))"
        low, high = hit.format(k=f"floor({at})"), hit.format(k=f"ceil({at})")
        return f"{low} + ({high} - {low}) * max({at} - floor({at}))"

    # one parsed expression: building 15 edges Column by Column costs more than running them
    choices = F.expr("array(" + ", ".join(
        "array(" + ", ".join(edge(i / k) for i in range(1, k)) + ")" for k in range(2, max_bins + 1)
    ) + ")")
    facts = p.agg(F.struct(
        F.max(n).alias("n"), F.count("*").alias("d"), F.min("__v").alias("lo"),
        F.max("__v").alias("hi"), choices.alias("edges"),
    ).alias("f")).scalar()
    k = F.least(F.lit(max_bins), F.greatest(F.lit(2), F.col("__f.d"))).cast("int")
    inner = F.filter(
        F.array_distinct(F.element_at(F.col("__f.edges"), k - 1)),
        lambda e: (e > F.col("__f.lo")) & (e < F.col("__f.hi")) & (e < F.col(value)),
    )
    binned = F.when(F.col(value).isNotNull() & (F.col("__f.n") >= 8), F.size(inner))
    return df.withColumn("__f", facts).withColumn(out, binned).drop("__f")


def first_per_document(df: DataFrame, doc: str, order: str, k: int) -> DataFrame:
    """The first k rows of each document.

    A document may be huge, so buckets of the order column are cut to k first.
    """
    keyed = with_value_bucket(df, order)
    local = Window.partitionBy(doc, "__bucket").orderBy(order)
    final = Window.partitionBy(doc).orderBy(order)
    return (
        keyed.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= k)
        .withColumn("excerpt", F.row_number().over(final)).where(F.col("excerpt") <= k)
        .drop("__r", "__bucket")
    )
