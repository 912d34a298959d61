"""Costly readings of text cells, done once per distinct text where a column has few."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.plans.session import cut_lineage

#: A column's distinct texts that are read by themselves and sent to every task: their number and bytes.
FEW_TEXTS = 4096
FEW_BYTES = 1 << 22


def few_texts(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns whose distinct texts fit a table of fixed size."""
    facts = df.agg(*[F.struct(
        F.approx_count_distinct(c).alias("n"), F.coalesce(F.max(F.octet_length(c)), F.lit(0)).alias("b")
    ).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for c, f in zip(cols, facts) if f["n"] <= FEW_TEXTS and f["n"] * f["b"] <= FEW_BYTES]


def distinct_texts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c, t): every distinct text of each column and NULL, stored.  Meant for columns of few: a task gathers its own first."""
    sets = df.select(F.spark_partition_id().alias("__part"), *cols).groupBy("__part").agg(
        *[F.collect_set(c).alias(f"c{i}") for i, c in enumerate(cols)])
    null = F.array(F.lit(None).cast("string"))
    named = F.concat(*[F.arrays_zip(
        F.array_repeat(F.lit(i), F.size(f"c{i}") + 1).alias("c"), F.concat(F.col(f"c{i}"), null).alias("t")) for i in range(len(cols))])
    return cut_lineage(sets.select(F.inline(named)).distinct())


def read_once(df: DataFrame, readers: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with each column of ``readers`` replaced by what its reader makes of the text.

    Columns of few distinct texts are read once a text, and rows look their text up in a table of
    fixed size; the others are read row by row.  Readers see nothing but the text, so the results
    are the same.
    """
    few = few_texts(df, list(readers))
    if few:
        texts = distinct_texts(df, few)
    out = df
    for i, c in enumerate(few):
        known = texts.where(F.col("c") == i).select(F.col("t").alias("__t"), readers[c](F.col("t")).alias("__read"))
        out = out.join(F.broadcast(known), F.col(c).eqNullSafe(F.col("__t")), "left").drop("__t", c).withColumnRenamed("__read", c)
    return out.select(*[readers[c](F.col(c)).alias(c) if c in readers and c not in few else c for c in df.columns])
