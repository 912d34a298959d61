"""Cluster and class weights, each with mean 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.plans.ordered import lookup

STRATEGIES = ("none", "inverse", "sqrt", "effective", "log")


def raw_group_weight(n: Column, strategy: str, beta: float = 0.999) -> Column:
    n = n.cast("double")
    if strategy == "none":
        return F.lit(1.0)
    if strategy == "inverse":
        return 1.0 / n
    if strategy == "sqrt":
        return 1.0 / F.sqrt(n)
    if strategy == "effective":
        return F.lit(1.0 - beta) / (1.0 - F.pow(F.lit(beta), n))
    if strategy == "log":
        return 1.0 / (1.0 + F.log(n))
    raise ValueError(f"unknown weighting strategy {strategy!r}")


def group_weight_table(
    df: DataFrame, group: str, strategy: str, beta: float = 0.999, out: str = "weight"
) -> DataFrame:
    """(group, n, weight): the mean over rows is 1.  Normalised on the group table."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    raw = sizes.withColumn("__w", raw_group_weight(F.col("n"), strategy, beta))
    mean = raw.agg((F.sum(F.col("n") * F.col("__w")) / F.sum("n")).alias("m")).scalar()
    return raw.select(group, "n", (F.col("__w") / mean).alias(out))


def group_weights(
    df: DataFrame, group: str, strategy: str, beta: float = 0.999, out: str = "weight"
) -> DataFrame:
    return lookup(df, group_weight_table(df, group, strategy, beta, out).drop("n"), [group])


def _class_weight(label: Column, pos: Column, neg: Column, n: Column) -> Column:
    safe = lambda c: F.greatest(c, F.lit(1))
    return F.when(label == 1, n / (2.0 * safe(pos))).otherwise(n / (2.0 * safe(neg)))


def class_weight_table(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """(label, n, weight) balanced per class, mean 1 (two rows)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    tot = c.agg(F.struct(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)).alias("neg"),
    ).alias("t")).scalar()
    raw = c.withColumn("__t", tot).withColumn(
        "__w", _class_weight(F.col(label), F.col("__t.pos"), F.col("__t.neg"), F.col("__t.n"))
    )
    mean = raw.agg((F.sum(F.col("n") * F.col("__w")) / F.sum("n")).alias("m")).scalar()
    return raw.select(label, "n", (F.col("__w") / mean).alias(out))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight on every row; the table has one row per class, so broadcast."""
    return df.join(F.broadcast(class_weight_table(df, label, out).drop("n")), label, "left")


def combined_weight_table(
    df: DataFrame, label: str, group: str, strategy: str = "sqrt", use_class: bool = True,
    beta: float = 0.999, out: str = "weight",
) -> DataFrame:
    """(group, label, n, weight) = group weight x class weight, mean 1."""
    cells = df.groupBy(group, label).agg(F.count("*").alias("n"))
    g = group_weight_table(df, group, strategy, beta, "__g").drop("n")
    t = cells.join(g, group)
    if use_class:
        c = F.broadcast(class_weight_table(df, label, "__c").drop("n"))
        t = t.join(c, label).withColumn("__g", F.col("__g") * F.col("__c"))
    mean = t.agg((F.sum(F.col("n") * F.col("__g")) / F.sum("n")).alias("m")).scalar()
    return t.select(group, label, "n", (F.col("__g") / mean).alias(out))


def combined_weights(
    df: DataFrame, label: str, group: str, strategy: str = "sqrt", use_class: bool = True,
    beta: float = 0.999, out: str = "weight",
) -> DataFrame:
    t = combined_weight_table(df, label, group, strategy, use_class, beta, out).drop("n")
    return lookup(df, t, [group, label])
