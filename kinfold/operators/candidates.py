"""Many candidate group hold-outs scored in the passes of one.

A candidate is the first share of the groups in its own seeded order.  A group row holds its key in
every candidate's order as one array; a candidate's cut is an order statistic of those keys, found from
counts per bucket and one opened bucket.  The sides of a group are then one byte per candidate, rows
carry them as one value, and the medians of all sides come from one sort of the values, in buckets of
which only those that hold a median are opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.operators.ranking import quantile_bins
from kinfold.plans.ordered import hash_bucket, hash_key, lookup, with_value_bucket
from kinfold.plans.session import cut_lineage

#: Bytes of the count matrix that a task works on at a time.
MATRIX_BYTES = 1 << 24


def group_sides(groups: DataFrame, group: str, seed: int, candidates: int, share: float) -> DataFrame:
    """``groups`` (one row per group) with ``sides``: for each candidate, whether the group is in the test part.

    The keys are stored: else the planner's test that there are any to explode is pushed below the
    grouping, and works them all out for every row of the table behind ``groups``.
    """
    keys = F.array(*[hash_key(seed + 1000 * c, group) for c in range(candidates)])
    keyed = cut_lineage(groups.withColumn("__keys", keys))
    each = keyed.select(group, F.posexplode("__keys").alias("candidate", "__h")).withColumn("__b", hash_bucket("__h"))
    # (candidate, bucket) counts combine before the shuffle
    counts = each.groupBy("candidate", "__b").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("candidate")
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "cut", F.ceil(F.sum("n").over(whole) * share))
    opened = counts.where("below < cut and cut <= below + n").select("candidate", "__b", "below", "cut")
    inside = each.join(F.broadcast(opened), ["candidate", "__b"])  # a row per candidate
    place = F.row_number().over(Window.partitionBy("candidate").orderBy("__h", group))
    last = inside.withColumn("__i", F.col("below") + place).where(F.col("__i") == F.col("cut"))
    cuts = {r["candidate"]: (r["__h"], r[group]) for r in last.select("candidate", "__h", group).collect()}

    def side(c: int):
        if c not in cuts:  # share of none
            return F.lit(False)
        h, g = cuts[c]
        key = F.col("__keys")[c]
        return (key < h) | ((key == h) & (F.col(group) <= F.lit(g)))

    return keyed.withColumn("sides", F.array(*[side(c) for c in range(candidates)])).drop("__keys")


def _bits(sides: pa.Array, n: int) -> np.ndarray:
    """(rows, sides): test sides of all candidates, then train sides, as 0 or 1."""
    flat = sides.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.int64)
    return np.concatenate([flat, 1 - flat], axis=1)


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int]]:
    step = max(1, MATRIX_BYTES // (16 * n))
    for lo in range(0, batch.num_rows, step):
        yield lo, min(step, batch.num_rows - lo)


def _counted(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows on every side) of the task's rows (bucket, w, sides)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for lo, m in _parts(batch, n):
            part = batch.slice(lo, m)
            b, w, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _bits(part.column(2), n)
            for k in np.unique(b).tolist():
                at = b == k
                held[k] = held.get(k, 0) + w[at] @ x[at]
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], names=["__bucket", "c"])


def _picked(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, place, value) at the wanted places; rows (bucket, kind, value, w, sides, start, places) by bucket, kind
    and value, where kind 0 holds the counts before the bucket and the places that are wanted."""
    start = places = None
    for batch in batches:
        kind = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        heads = np.flatnonzero(kind == 0)
        cuts = np.unique(np.concatenate([cuts, heads, heads + 1]))
        cuts = cuts[cuts < len(kind)]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kind)]):
            if kind[lo] == 0:
                start = np.array(batch.column(5)[lo].as_py(), np.int64)
                places = np.array(batch.column(6)[lo].as_py(), np.int64).reshape(2, -1)  # lower and upper middle
                continue
            for at, m in _parts(batch.slice(lo, hi - lo), n):
                part = batch.slice(lo + at, m)
                value = part.column(2).to_numpy()
                upto = start + np.cumsum(part.column(3).to_numpy()[:, None] * _bits(part.column(4), n), axis=0)
                out = []
                for i, want in enumerate(places):
                    for s in np.flatnonzero((want >= start) & (want < upto[-1])).tolist():
                        out.append((s, i, float(value[np.searchsorted(upto[:, s], want[s], "right")])))
                start = upto[-1]
                if out:
                    s, i, v = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(i, pa.int32()), pa.array(v)], names=["s", "i", "v"])


def side_medians(cells: DataFrame, value: str, candidates: int) -> DataFrame:
    """(candidate, is_test, median) of ``cells`` (value, w, sides), each value ``w`` times."""
    rows = cut_lineage(with_value_bucket(
        cells.select(F.col(value).cast("double").alias("__v"), F.col("w").cast("long").alias("w"), "sides"), "__v"
    ).withColumn("__bucket", F.col("__bucket").cast("int")))
    counts = rows.select("__bucket", "w", "sides").mapInArrow(partial(_counted, candidates), "__bucket int, c array<long>")
    # one row per bucket and task; summed on the driver into buckets x sides numbers
    n = 2 * candidates
    summed = counts.select("__bucket", F.posexplode("c").alias("s", "c")).groupBy("__bucket", "s").agg(F.sum("c").alias("c"))
    held = summed.collect()
    buckets = sorted({r["__bucket"] for r in held})
    if not buckets:
        return cells.sparkSession.createDataFrame([], "candidate int, is_test boolean, median double")
    at = {b: i for i, b in enumerate(buckets)}
    table = np.zeros((len(buckets), n), np.int64)
    for r in held:
        table[at[r["__bucket"]], r["s"]] = r["c"]
    before, total = np.cumsum(table, axis=0) - table, table.sum(axis=0)
    places = np.stack([(total - 1) // 2, total // 2])
    places[:, total == 0] = -1
    wanted = ((places[:, None] >= before) & (places[:, None] < before + table)).any(axis=(0, 2))
    spark = cells.sparkSession
    heads = spark.createDataFrame(
        [(int(buckets[i]), 0, before[i].tolist(), places.ravel().tolist()) for i in np.flatnonzero(wanted)],
        "__bucket int, kind int, start array<long>, places array<long>")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    columns = ["__bucket", "kind", "__v", "w", "sides", "start", "places"]
    heads = heads.select("__bucket", "kind", none("double", "__v"), none("long", "w"), none("array<boolean>", "sides"), "start", "places")
    inside = rows.where(F.col("__bucket").isin([int(buckets[i]) for i in np.flatnonzero(wanted)])).select(
        "__bucket", F.lit(1).alias("kind"), "__v", "w", "sides", none("array<long>", "start"), none("array<long>", "places"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = heads.unionByName(inside).select(*columns).repartition(tasks, "__bucket").sortWithinPartitions(
        "__bucket", "kind", "__v").mapInArrow(partial(_picked, candidates), "s int, i int, v double")
    return found.groupBy("s").agg(F.avg("v").alias("median")).select(
        (F.col("s") % candidates).cast("int").alias("candidate"), (F.col("s") < candidates).alias("is_test"), "median")


def balanced_group_candidates(
    df: DataFrame, group: str, y: str, seed: int = 42, candidates: int = 50,
    test_fraction: float = 0.2, bins: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Score many seeded group hold-outs at once.

    Returns (scores per candidate, group sides per candidate).  The score adds
    the differences of mean, median and deviation between the sides (in units of
    the overall deviation), the miss of the test share, and 2.5 x the L1
    distance of the group-mean bins; lower is better.
    """
    ok = df.where(F.col(group).isNotNull() & F.col(y).isNotNull())
    cells = ok.groupBy(group, y).agg(F.count("*").alias("w"))
    v, w = F.col(y).cast("double"), F.col("w")
    per = cells.groupBy(group).agg(
        (F.sum(v * w) / F.sum(w)).alias("g_mean"), F.sum(w).alias("g_n"), F.sum(v * w).alias("g_sum"), F.sum(v * v * w).alias("g_sq"))
    full_std = ok.agg(F.stddev_pop(y).alias("s")).scalar()
    groups = cut_lineage(group_sides(quantile_bins(per, "g_mean", bins, "g_bin"), group, seed, candidates, test_fraction))
    long = groups.select("*", F.posexplode("sides").alias("candidate", "is_test"))
    # candidates x 2 x bins rows, combined before the shuffle
    sums = cut_lineage(long.groupBy("candidate", "is_test", "g_bin").agg(
        F.sum("g_n").alias("n_rows"), F.sum("g_sum").alias("s"), F.sum("g_sq").alias("sq"), F.count("*").alias("n_groups")))
    moments = sums.groupBy("candidate", "is_test").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_groups", "s", "sq")]).select(
        "candidate", "is_test", "n_rows", "n_groups", (F.col("s") / F.col("n_rows")).alias("mean"),
        F.sqrt(F.greatest(
            F.lit(0.0), F.col("sq") / F.col("n_rows") - F.pow(F.col("s") / F.col("n_rows"), 2)
        )).alias("std"),
    )
    med = side_medians(lookup(cells, groups.select(group, "sides"), [group], grows=True), y, candidates)
    stats = moments.join(med, ["candidate", "is_test"])
    side = lambda c, t: F.max(F.when(F.col("is_test") == F.lit(t), F.col(c)))
    wide = stats.groupBy("candidate").agg(*[
        side(c, t).alias(f"{c}_{'test' if t else 'train'}")
        for c in ("n_rows", "n_groups", "mean", "median", "std") for t in (True, False)
    ])
    part = lambda t: F.sum(F.when(F.col("is_test") == F.lit(t), F.col("n_groups")).otherwise(0))
    hist = sums.where(F.col("g_bin").isNotNull()).groupBy("candidate", "g_bin").agg(part(True).alias("te"), part(False).alias("tr"))
    hist_tot = hist.groupBy("candidate").agg(
        F.greatest(F.sum("te"), F.lit(1e-12)).alias("te_n"),
        F.greatest(F.sum("tr"), F.lit(1e-12)).alias("tr_n"),
    )
    dist = hist.join(hist_tot, "candidate").groupBy("candidate").agg(
        (0.5 * F.sum(F.abs(F.col("tr") / F.col("tr_n") - F.col("te") / F.col("te_n")))).alias(
            "bin_distance")
    )
    out = wide.join(dist, "candidate", "left").withColumn("__s", full_std).withColumn(
        "__s", F.when(F.col("__s") > 1e-12, F.col("__s")).otherwise(F.lit(1.0))
    )
    diff = lambda c: F.abs(F.col(f"{c}_train") - F.col(f"{c}_test")) / F.col("__s")
    share = F.col("n_rows_test") / (F.col("n_rows_test") + F.col("n_rows_train"))
    bin_part = F.coalesce(F.col("bin_distance"), F.lit(0.0))
    score = (
        diff("mean") + 0.5 * diff("median") + 0.25 * diff("std")
        + 2.0 * F.abs(share - test_fraction) + 2.5 * bin_part
    )
    return (
        out.withColumn("bin_distance", bin_part).withColumn("balance_score", score).drop("__s"),
        long.select("candidate", group, "is_test"),
    )
