"""Splitters.  Each returns a table of (row or group, fold / side), never index arrays.

Randomness is a seeded hash order, so a split does not depend on partitioning
and survives a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.operators.candidates import balanced_group_candidates
from kinfold.operators.ranking import pareto, quantile_bins
from kinfold.plans.ordered import (
    dense_positions, hash_key, hashed_positions, lookup, prefix_sums, quantiles,
)
from kinfold.plans.session import cut_lineage


def stratified_holdout(
    df: DataFrame, label: str, ids: Sequence[str], seed: int = 42, test_fraction: float = 0.2
) -> DataFrame:
    """Exactly floor(n_class * fraction) test rows in every class."""
    p = hashed_positions(df, seed, ids, [label])
    return p.select(
        *ids, label, (F.col("pos") < F.floor(F.col("n") * test_fraction)).alias("is_test")
    )


def stratified_kfold(
    df: DataFrame, label: str, ids: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    p = hashed_positions(df, seed, ids, [label])
    return p.select(*ids, label, (F.col("pos") % k).cast("int").alias("fold"))


def deal(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """How ``m`` groups of each size ``n`` go, one by one, onto the lightest of ``k`` folds.

    For every (n, m), largest size first: (n, starts, orders).  From the group at ``starts[i]`` on,
    the folds of ``orders[i]`` take turns; a fold joins when the others have reached its load.
    """
    loads, out = [0] * k, []
    for n, m in sorted(sizes, reverse=True):
        waiting = sorted((load, f) for f, load in enumerate(loads))
        active, at, starts, orders = [], 0, [], []
        while at < m:
            active = sorted((loads[f], f) for f in [*(f for _, f in active), waiting.pop(0)[1]])
            turns, left = [f for _, f in active], m - at
            if waiting:
                load, g = waiting[0]
                left = min(left, sum(
                    max(0, -(-(load - x) // n) + (load >= x and (load - x) % n == 0 and f < g)) for x, f in active))
            if left:
                starts.append(at)
                orders.append(turns)
                for i, f in enumerate(turns):
                    loads[f] += n * (left // len(turns) + (i < left % len(turns)))
            at += left
            active = [(loads[f], f) for f in turns]
        out.append((n, starts, orders))
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): largest group first onto the lightest fold, groups of one size by key.

    One rule at every size.  Only the distinct group sizes (at most the square root of twice the
    rows) are dealt in sequence; each group finds its fold from its position among its equals.
    """
    import pandas as pd

    ok = df.where(F.col(group).isNotNull())
    sizes = ok.groupBy(group).agg(F.count("*").alias("__size"))
    classes = sizes.groupBy("__size").agg(F.count("*").alias("__m")).withColumn("__all", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = deal(list(zip(pdf["__size"].tolist(), pdf["__m"].tolist())), k)
        return pd.DataFrame(rows, columns=["__size", "__starts", "__orders"])

    dealt = classes.groupBy("__all").applyInPandas(
        run, "__size long, __starts array<long>, __orders array<array<int>>")
    order = [group]
    if isinstance(df.schema[group].dataType, T.StringType):  # its first bytes as a number, for the buckets
        head = F.rpad(F.hex(F.substring(F.encode(group, "UTF-8"), 1, 7)), 14, "0")
        sizes, order = sizes.withColumn("__head", F.conv(head, 16, 10).cast("bigint")), ["__head", group]
    placed = lookup(dense_positions(sizes, order, ["__size"]), dealt, ["__size"], "inner", [group])
    segment = F.size(F.filter("__starts", lambda s: s <= F.col("pos")))
    turns = F.element_at("__orders", segment)
    turn = (F.col("pos") - F.element_at("__starts", segment)) % F.size(turns)
    return placed.select(
        group, F.col("__size").alias("n"), F.element_at(turns, (turn + 1).cast("int")).alias("fold"))


def group_kfold_snake(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Declarative variant: groups by falling size dealt 0..k-1, k-1..0, and so on."""
    p = pareto(df, group)
    lap, step = F.floor((F.col("position") - 1) / k), (F.col("position") - 1) % k
    fold = F.when(lap % 2 == 0, step).otherwise(k - 1 - step)
    return p.select(group, "n", fold.cast("int").alias("fold"))


def stratified_group_kfold(
    df: DataFrame, group: str, label: str, k: int = 5, seeds: Sequence[int] = (42,)
) -> DataFrame:
    """(seed, group, n_neg, n_pos, fold): groups stay whole and folds keep the class mix.

    Groups are taken in seeded order, most class-unbalanced first; each goes to
    the fold that leaves the class shares most even (fewest rows on a tie).
    The packing is sequential over the *group* table, by one rule at every size: Spark sorts the
    groups of a seed, and one task reads them as a stream and holds only the loads of the folds.
    """
    import numpy as np
    import pandas as pd

    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.sum((F.col(label) == 0).cast("long")).alias("n_neg"),
        F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
    )
    totals = counts.agg(F.struct(F.sum("n_neg").alias("neg"), F.sum("n_pos").alias("pos")).alias("t")).scalar()
    runs = counts.withColumn("__t", totals).select(
        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"), group, "n_neg", "n_pos",
        F.col("__t.neg").alias("__neg"), F.col("__t.pos").alias("__pos"),
    ).withColumn("__gap", F.abs(F.col("n_neg") - F.col("n_pos"))).withColumn("__h", hash_key(F.col("seed"), group))
    ordered = runs.repartition(len(seeds), "seed").sortWithinPartitions("seed", F.desc("__gap"), "__h", group)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, held = None, np.zeros((k, 2))
        for pdf in batches:
            total, folds = np.ones(2), []
            if len(pdf):
                total = np.maximum(pdf[["__neg", "__pos"]].iloc[0].to_numpy(dtype=float), 1.0)
            for s, row in zip(pdf["seed"].tolist(), pdf[["n_neg", "n_pos"]].to_numpy(dtype=float)):
                if s != seed:
                    seed, held = s, np.zeros((k, 2))
                trial = np.repeat(held[None, :, :], k, axis=0)
                trial[np.arange(k), np.arange(k)] += row
                spread = np.round((trial / total).std(axis=1).mean(axis=1), 12)
                best = min(range(k), key=lambda f: (spread[f], held[f].sum(), f))
                held[best] += row
                folds.append(best)
            yield pdf.assign(fold=folds)[["seed", group, "n_neg", "n_pos", "fold"]]

    schema = T.StructType([
        T.StructField("seed", T.IntegerType()), counts.schema[group],
        T.StructField("n_neg", T.LongType()), T.StructField("n_pos", T.LongType()),
        T.StructField("fold", T.IntegerType()),
    ])
    return ordered.mapInPandas(pack, schema)


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """(group, n_test, n_train, fold): the fold is the dense code of the group."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_test"))
    total = sizes.agg(F.sum("n_test").alias("t")).scalar()
    coded = prefix_sums(sizes.withColumn("__h", hash_key(0, group)), ["__h", group],
                        {"n_test": F.col("n_test"), "__one": F.lit(1)})
    return coded.select(
        group, "n_test", (total - F.col("n_test")).alias("n_train"),
        F.col("__one_before").alias("fold"),
    )


def group_holdout(df: DataFrame, group: str, seed: int = 42, test_fraction: float = 0.2) -> DataFrame:
    """(group, is_test): the first ceil(fraction * groups) groups in seeded order."""
    g = df.where(F.col(group).isNotNull()).select(group).distinct()
    p = hashed_positions(g, seed, [group])
    return p.select(group, (F.col("pos") < F.ceil(F.col("n") * test_fraction)).alias("is_test"))


def attach_groups(df: DataFrame, table: DataFrame, group: str, how: str = "left") -> DataFrame:
    """Bring a per-group split column to the rows (salted lookup)."""
    return lookup(df, table, [group], how)


def balanced_group_holdout(df: DataFrame, group: str, y: str, seed: int = 42, **kw) -> DataFrame:
    """(group, is_test) of the best-balanced candidate (first on a tie)."""
    scores, sides = balanced_group_candidates(df, group, y, seed, **kw)
    best = scores.agg(
        F.min_by("candidate", F.struct(F.round("balance_score", 10), F.col("candidate"))).alias("c")
    ).scalar()
    return sides.where(F.col("candidate") == best).select(group, "is_test")


def quantile_stratified_holdout(
    df: DataFrame, y: str, ids: Sequence[str], seed: int = 42, test_fraction: float = 0.2,
    bins: int = 6,
) -> DataFrame:
    """Random hold-out stratified by target quantile bin; unstratified if a bin has one row."""
    b = quantile_bins(df.select(*ids, y), y, bins, "__bin")
    smallest = b.where(F.col("__bin").isNotNull()).groupBy("__bin").count().agg(
        F.struct(F.min("count").alias("least"), F.count("*").alias("bins")).alias("m")
    ).scalar()
    keyed = b.withColumn("__m", smallest).withColumn(
        "stratum", F.when((F.col("__m.least") >= 2) & (F.col("__m.bins") >= 2), F.col("__bin"))
    ).withColumn("stratum", F.coalesce("stratum", F.lit(-1))).drop("__m", "__bin")
    p = hashed_positions(keyed, seed, ids, ["stratum"])
    return p.select(
        *ids, "stratum", (F.col("pos") < F.floor(F.col("n") * test_fraction)).alias("is_test")
    )


def holdout_pair(
    df: DataFrame, group: str, y: str, ids: Sequence[str], repeats: int, base_seed: int = 42, **kw
) -> DataFrame:
    """For every repeat a random and a balanced group hold-out: (repeat, seed, ids, test flags)."""
    out = None
    for r in range(repeats):
        seed = base_seed + r
        rnd = quantile_stratified_holdout(df, y, ids, seed).select(
            *ids, F.col("is_test").alias("random_test")
        )
        grp = balanced_group_holdout(df, group, y, seed, **kw).select(
            group, F.col("is_test").alias("group_test")
        )
        one = lookup(df.select(*ids, group, y), grp, [group], grows=True).join(rnd, list(ids)).select(
            F.lit(r + 1).alias("repeat"), F.lit(seed).alias("seed"), *ids, group, y,
            "random_test", "group_test",
        )
        out = one if out is None else out.unionByName(one)
    return out


def split_diagnostics(splits: DataFrame, group: str, y: str) -> DataFrame:
    """Groups, rows, mean and population deviation of each side of the group split."""
    side = F.when(F.col("group_test"), "test").otherwise("train")
    return splits.groupBy("repeat", "seed", side.alias("side")).agg(
        F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"),
    )


def shared_groups(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups present on both sides of a split (must be empty)."""
    both = df.groupBy(group).agg(F.count_distinct(side).alias("k")).where(F.col("k") > 1)
    return both.select(group)


def assert_disjoint(df: DataFrame, group: str, side: str) -> None:
    if not shared_groups(df, group, side).isEmpty():
        raise AssertionError("a group is on both sides of the split")
