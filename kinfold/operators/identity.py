"""Cluster identity, de-duplication and contamination of a wrong cluster key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.identity import canonical_citation, canonical_doi
from kinfold.plans.ordered import lookup
from kinfold.plans.session import cut_lineage

UNKNOWN_GROUP = "UNKNOWN_PAPER"
#: Keys that are sent to every task as one table; more are joined by a shuffle.
FEW_KEYS = 20_000


def fill_group(df: DataFrame, group: str, label: str = UNKNOWN_GROUP) -> DataFrame:
    return df.withColumn(group, F.coalesce(F.col(group), F.lit(label)))


def keep_labelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def drop_exact_duplicates(
    df: DataFrame, keys: Sequence[str], first_by: Column | None = None
) -> DataFrame:
    """One row per distinct key (NULLs equal); conflicting labels stay if the label is a key.

    ``first_by`` picks the kept row.  It is a min over a struct, so copies of a
    hot row are combined before the shuffle and never gathered.  Spark sorts for that by all
    keys; their hash comes first, so few comparisons go further.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    if first_by is None:
        return df.dropDuplicates(keys)
    kept = df.groupBy(F.xxhash64(*keys).alias("__h"), *keys).agg(F.min_by(F.struct(*rest), first_by).alias("__r"))
    return kept.select(*[F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, duplicates removed and their share in percent."""
    g = df.groupBy(*keys).count()
    return g.agg(
        F.sum("count").alias("n_rows"),
        F.sum(F.col("count") - 1).alias("n_removed"),
        (100 * F.sum(F.col("count") - 1) / F.sum("count")).alias("removed_pct"),
    )


def group_rare(
    df: DataFrame, col: str, min_count: int = 10, label: str = "Other / Rare", among: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Categories seen fewer than ``min_count`` times (in ``among``, else in ``df``) get one label; NULL counts as a category.

    ``weight`` names the rows that a row of ``among`` stands for.  Rows are only shuffled if many categories stay.
    """
    seen = F.count("*") if weight is None else F.sum(weight)
    kept = cut_lineage(
        (df if among is None else among).groupBy(col).agg(seen.alias("__n")).where(F.col("__n") >= min_count)
        .select(col, F.lit(True).alias("__kept")))
    if kept.count() <= FEW_KEYS:
        small = F.broadcast(kept.withColumnRenamed(col, "__k"))
        out = df.join(small, F.col(col).eqNullSafe(F.col("__k")), "left").drop("__k")
    else:
        out = lookup(df, kept, [col], grows=True)
    return out.withColumn(
        col, F.when(F.col("__kept"), F.col(col)).otherwise(F.lit(label))
    ).drop("__kept").select(*df.columns)


def resolve_aliases(
    df: DataFrame, key: str, doi: str, citation: str, row_id: str, out: str = "entity"
) -> DataFrame:
    """Map every old key to one entity: through a shared DOI, else its first citation.

    Texts are read once per distinct (DOI, citation) and per distinct key, not once per row; rows only look up their key.
    """
    art = df.groupBy(F.col(doi).alias("__doi"), F.col(citation).alias("__cit")).agg(F.min(row_id).alias("__r")).select(
        F.coalesce("__doi", "__cit").alias("__k"),
        F.coalesce(canonical_citation(F.col("__cit")), F.lit("none")).alias("__a"),
        "__r",
    )
    art = cut_lineage(art.withColumn("__d", canonical_doi(F.col("__k"))))
    by_key = art.groupBy("__k").agg(F.min_by("__a", "__r").alias("__key_article"))
    by_doi = (
        art.where(F.col("__d").isNotNull()).groupBy("__d")
        .agg(F.min_by("__a", "__r").alias("__doi_article"))
    )
    keys = df.select(F.col(key).alias("__k")).distinct().withColumn("__d", canonical_doi(F.col("__k")))
    named = cut_lineage(lookup(lookup(keys, by_doi, ["__d"]), by_key, ["__k"]).select(
        "__k", F.coalesce("__doi_article", "__key_article", "__k").alias(out)))
    if named.count() <= FEW_KEYS:
        return df.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    return lookup(df, named.withColumnRenamed("__k", key), [key], grows=True)


def split_contamination(df: DataFrame, entity: str, fold: str) -> DataFrame:
    """Rows of entities whose rows fall in more than one fold."""
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.count_distinct(fold).alias("k"))
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("n_contaminated"),
        F.count("*").alias("n_entities"),
        F.sum((F.col("k") > 1).cast("long")).alias("n_split_entities"),
    )


def grouping_report(df: DataFrame, old_key: str, entity: str, fold: str) -> DataFrame:
    """Old and canonical cardinality next to the contamination of the old folds."""
    cards = df.agg(
        F.count_distinct(old_key).alias("old_groups"), F.count_distinct(entity).alias("new_groups")
    )
    hit = split_contamination(df, entity, fold)
    return hit.select(
        "*",
        cards.select("old_groups").scalar().alias("old_groups"),
        cards.select("new_groups").scalar().alias("new_groups"),
        (100 * F.col("n_contaminated") / F.col("n_rows")).alias("contaminated_pct"),
    )
