"""Bootstrap augmentation and (cluster) bootstrap intervals.

Draws come from the seeded hash, so a replicate is a key column and a resample
is a multiplicity: rows are never copied once per replicate unless the
statistic needs their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.plans.ordered import hash_bucket, hash_key, hashed_positions, lookup, prefix_sums, with_value_bucket
from kinfold.plans.session import cut_lineage


def bootstrap_augment(
    df: DataFrame, ids: Sequence[str], n_extra: int, seed: int = 42
) -> DataFrame:
    """``df`` plus ``n_extra`` rows drawn with replacement, all marked in ``is_extra``.

    Rows are numbered in hash order; draw j hits row number hash(seed, j) mod n.
    """
    base = df.withColumn("is_extra", F.lit(False))
    if n_extra <= 0:
        return base
    pos = hashed_positions(df.select(*ids), seed, ids).select(*ids, "pos")
    n = df.agg(F.count("*").alias("n")).scalar()
    draws = df.sparkSession.range(n_extra).select(
        F.pmod(hash_key(seed, F.col("id")), n).alias("pos")
    ).groupBy("pos").agg(F.count("*").cast("int").alias("times"))
    hit = pos.join(draws, "pos").select(*ids, "times")
    extra = df.join(hit, list(ids)).withColumn(
        "__i", F.explode(F.sequence(F.lit(1), F.col("times")))
    ).drop("__i", "times").withColumn("is_extra", F.lit(True))
    return base.unionByName(extra)


def group_multiplicities(
    df: DataFrame, group: str, replicates: int, seed: int = 42
) -> DataFrame:
    """(replicate, group, times): G draws with replacement from the G groups, per replicate."""
    coded, draws = _drawn(df, group, replicates, seed)
    return draws.join(coded, "pos").select("replicate", group, "times")


def _drawn(df: DataFrame, group: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(group, pos) and (replicate, pos, times); the draws are shuffled once, by the position they hit."""
    g = df.where(F.col(group).isNotNull()).select(group).distinct()
    coded = hashed_positions(g, seed, [group]).select(group, "pos", "n")
    draws = coded.select(F.col("pos").alias("j"), "n").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    ).select(
        "replicate", F.pmod(hash_key(seed + 1, F.col("replicate"), F.col("j")), F.col("n")).alias("pos")
    ).repartition("pos").groupBy("replicate", "pos").agg(F.count("*").alias("times"))
    return coded.select(group, "pos"), draws


def cluster_resample(df: DataFrame, group: str, seed: int = 42, weight: str = "times") -> DataFrame:
    """One cluster bootstrap of the rows as an integer weight (absent groups drop out)."""
    m = group_multiplicities(df, group, 1, seed).select(group, F.col("times").alias(weight))
    return lookup(df, m, [group], "inner")


def mean_interval(
    df: DataFrame, value: str, order: str, by: Sequence[str] = (), replicates: int = 2000,
    seed: int = 42, level: float = 0.95,
) -> DataFrame:
    """Percentile interval of a mean per group: (mean, ci_low, ci_high, n).

    Non-finite values are dropped; one value gives a point interval.  The group's
    values are numbered in hash order of ``order`` (unique inside a group) and every
    (replicate, draw) picks one by hash.
    """
    by = list(by)
    fin = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    ok = df.where(fin).select(*by, order, F.col(value).cast("double").alias("__v"))
    keyed = ok.withColumn("__h", hash_key(0, order))
    pos = prefix_sums(
        keyed, ["__h", order, "__v"], {"__one": F.lit(1).cast("bigint")}, by, hash_bucket("__h")
    ).select(*by, "__v", F.col("__one_before").alias("pos"), F.col("__one_total").alias("n"))
    # dealt to a set number of tasks: small inputs are joined into few tasks, where each row becomes many draws
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    draws = pos.select(*by, F.col("pos").alias("j"), "n").repartition(tasks, *by, "j").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(max(1, replicates) - 1)))
    ).select(
        *by, "replicate",
        F.pmod(hash_key(seed, *by, F.col("replicate"), F.col("j")), F.col("n")).alias("pos"),
    ).groupBy(*by, "replicate", "pos").agg(F.count("*").alias("times"))
    picked = draws.join(pos.drop("n"), [*by, "pos"])
    means = picked.groupBy(*by, "replicate").agg(
        (F.sum(F.col("__v") * F.col("times")) / F.sum("times")).alias("m")
    )
    lo = (1 - level) / 2
    # one row per replicate: a fixed number of values per group
    ci = means.groupBy(*by).agg(F.percentile("m", [lo, 1 - lo]).alias("__q"))
    base = ok.groupBy(*by).agg(F.avg("__v").alias("mean"), F.count("*").alias("n"))
    j = base.join(ci, by) if by else base.withColumn("__q", ci.scalar())
    point = (F.col("n") == 1) | F.lit(replicates <= 0)
    return j.select(
        *by, "mean",
        F.when(point, F.col("mean")).otherwise(F.col("__q")[0]).alias("ci_low"),
        F.when(point, F.col("mean")).otherwise(F.col("__q")[1]).alias("ci_high"), "n",
    )


def fold_intervals(
    folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("strategy", "method"),
    fold_id: str = "fold_key", replicates: int = 2000, seed: int = 42,
) -> DataFrame:
    """``mean_interval`` of every metric column of a fold table, in long form."""
    long = folds.select(
        *by, fold_id,
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ])),
    )
    return mean_interval(long, "value", fold_id, [*by, "metric"], replicates, seed).withColumn(
        "bootstrap_iterations", F.lit(replicates)
    )


#: Bytes of the weight matrix that a task works on at a time.
MATRIX_BYTES = 1 << 24
#: Bytes of the sums that a task holds for all distinct scores, if they are that few.
HELD_BYTES = 1 << 26
#: Groups whose counts are multiplied at a time.
GROUPS_AT_ONCE = 256
_PICKS = "__group string, __m binary"
_SUMS = "__k long, __a binary, __b binary"


def _dense(replicates: int, batches):
    """(group, 16-bit counts of every replicate) from (group, replicate numbers, counts)."""
    for batch in batches:
        out = []
        for reps, times in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
            row = np.zeros(replicates, np.int16)
            row[reps] = times
            out.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["__group", "__m"])


def _chunks(batch: pa.RecordBatch, column: int, replicates: int):
    """(first row, counts of rows x replicates) in parts of bounded size."""
    step = max(1, MATRIX_BYTES // (8 * replicates))
    for lo in range(0, batch.num_rows, step):
        part = batch.column(column).slice(lo, step).to_pylist()
        yield lo, np.frombuffer(b"".join(part), np.int16).reshape(len(part), replicates).astype(np.int64)


def _sums(held: dict) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), *[pa.array([held[k][i].tobytes() for k in keys], pa.binary()) for i in (0, 1)]],
        names=["__k", "__a", "__b"])


def _weighted(replicates: int, batches):
    """(bucket, positives, negatives of every replicate) of the task's rows (k, p, n, m)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        k, p, n = (batch.column(i).to_numpy() for i in range(3))
        for lo, w in _chunks(batch, 3, replicates):
            own = k[lo:lo + len(w)]
            for key in np.unique(own).tolist():
                at = np.flatnonzero(own == key)
                v = np.stack([p[lo + at] @ w[at], n[lo + at] @ w[at]])
                held[key] = held[key] + v if key in held else v
        if len(held) * replicates * 16 > MATRIX_BYTES:
            yield _sums(held)
            held.clear()
    if held:
        yield _sums(held)


def _by_score(replicates, batches):
    """(score key, positives, negatives of every replicate) of the task's groups: rows (score keys, p, n, m)."""
    slots: dict[int, int] = {}
    held = np.zeros((2, 0, replicates), np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUPS_AT_ONCE):
            part = batch.slice(lo, GROUPS_AT_ONCE)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(0)).to_numpy(zero_copy_only=False))
            key, p, n = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            w = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int16).reshape(part.num_rows, replicates).astype(float)
            names, at = np.unique(key, return_inverse=True)
            slot = np.array([slots.setdefault(k, len(slots)) for k in names.tolist()], np.int64)
            if len(slots) > held.shape[1]:
                held = np.concatenate([held, np.zeros((2, max(len(slots), held.shape[1]) - held.shape[1] + 64, replicates), np.int64)], axis=1)
            for i, c in enumerate((p, n)):
                counts = np.zeros((len(names), part.num_rows))
                np.add.at(counts, (at, row), c)
                held[i, slot] += (counts @ w).astype(np.int64)  # whole numbers below 2**53
    keys = list(slots)
    for lo in range(0, len(keys), 256):
        yield _sums({k: held[:, lo + i] for i, k in enumerate(keys[lo:lo + 256])})


def _added(batches):
    """Sums of equal keys (rows sorted by key)."""
    key, total = None, None
    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            v = np.stack([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)])
            if k != key and key is not None:
                yield _sums({key: total})
                total = None
            key, total = k, v if total is None else total + v
    if key is not None:
        yield _sums({key: total})


def _areas(replicates: int, batches):
    """(bucket, ROC area, precision sum of every replicate); rows (k, kind, score, p, n, m, a, b) sorted by
    k, kind and falling score, where kind 0 holds what lies above the bucket; the others are cells with their group's
    counts m, or (m is null) a score's sums a, b of every replicate."""
    key, last, open_ = None, None, None
    above = areas = None

    def weighted(batch, lo: int, hi: int, score, p, n):
        """(scores, positives, negatives of every replicate) of the rows, in parts of bounded size."""
        if batch.column(5)[lo].is_valid:
            for at, w in _chunks(batch.slice(lo, hi - lo), 5, replicates):
                rows = slice(lo + at, lo + at + len(w))
                yield score[rows], *(w * c[rows, None].astype(np.int64) for c in (p, n))
            return
        step = max(1, MATRIX_BYTES // (8 * replicates))
        for i in range(lo, hi, step):
            part = batch.slice(i, min(step, hi - i))
            yield score[i:i + part.num_rows], *(
                np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64).reshape(-1, replicates) for c in (6, 7))

    def take(wp: np.ndarray, wn: np.ndarray) -> None:
        """Add distinct scores, one a row."""
        tp, fp = above[0] + np.cumsum(wp, axis=0), above[1] + np.cumsum(wn, axis=0)
        areas[0] += (wn * (tp - wp / 2)).sum(axis=0)
        areas[1] += (wp * tp / np.maximum(tp + fp, 1)).sum(axis=0)
        above[0], above[1] = tp[-1], fp[-1]

    def close():
        if open_ is not None:
            take(*(x[None] for x in open_))
        if key is not None:
            yield _sums({key: areas})

    for batch in batches:
        k, kind, score, p, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        cuts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (kind[1:] != kind[:-1])))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)]):
            if k[lo] != key:
                yield from close()
                key, last, open_ = int(k[lo]), None, None
                above, areas = np.zeros((2, replicates), np.int64), np.zeros((2, replicates))
            if kind[lo] == 0:
                above = np.stack([np.frombuffer(batch.column(i)[lo].as_py(), np.int64) for i in (6, 7)])
                continue
            for x, wp, wn in weighted(batch, lo, hi, score, p, n):
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                wp, wn = (np.add.reduceat(v, first, axis=0) for v in (wp, wn))
                if open_ is not None and x[0] == last:
                    wp[0] += open_[0]
                    wn[0] += open_[1]
                elif open_ is not None:
                    take(*(v[None] for v in open_))
                if len(first) > 1:
                    take(wp[:-1], wn[:-1])
                last, open_ = x[-1], (wp[-1], wn[-1])
    yield from close()


def pooled_ranking_intervals(
    df: DataFrame, group: str, label: str, score: str, by: Sequence[str] = (),
    replicates: int = 2000, seed: int = 42,
) -> DataFrame:
    """Cluster-bootstrap interval of pooled ROC-AUC and average precision.

    Rows collapse to (group, score) counts, and each carries its group's multiplicities as one array.
    Cells are sorted once, in buckets of score; running sums are vectors over the replicates, and start
    from what the higher buckets hold.  So no row is repeated for a replicate.  If the distinct scores are
    few (their sums fit ``HELD_BYTES``), groups are first added up to them, and a group's array travels
    once and not with each cell.  One-class replicates are skipped and counted.
    """
    by = list(by)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = lambda sums: sums.repartition(tasks, "__k").sortWithinPartitions("__k").mapInArrow(_added, _SUMS)
    cells = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(*by, group, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("__p"),
        F.sum((F.col(label) == 0).cast("long")).alias("__n"),
    )
    cells = cut_lineage(cells.withColumn("__group", F.col(group).cast("string")))
    coded, draws = _drawn(df, group, replicates, seed)
    m = draws.groupBy("pos").agg(F.collect_list(F.struct("replicate", "times")).alias("__l")).join(coded, "pos")  # at most one per replicate
    picks = cut_lineage(m.select(F.col(group).cast("string").alias("__group"), "__l.replicate", "__l.times").mapInArrow(
        partial(_dense, replicates), _PICKS))
    scores = cut_lineage(cells.select(*by, score).distinct())
    n_scores = scores.count()
    few = 16 * n_scores * replicates <= HELD_BYTES and 8 * n_scores * tasks <= cells.count()
    keyed = with_value_bucket(scores if few else cells, score).withColumn("__k", F.xxhash64(*by, "__bucket"))
    keyed = cut_lineage(keyed)
    names = keyed.select(*by, "__bucket", "__k").distinct()
    # totals of each bucket, then what lies above it
    if few:
        key = F.xxhash64(*by, score)
        packed = cells.groupBy("__group").agg(  # at most one cell per distinct score
            F.collect_list(F.struct(key.alias("k"), F.col("__p").alias("p"), F.col("__n").alias("n"))).alias("__l"))
        held = packed.join(picks.hint("merge"), "__group").select("__l.k", "__l.p", "__l.n", "__m").mapInArrow(
            partial(_by_score, replicates), _SUMS)
        ready = cut_lineage(added(held).withColumnRenamed("__k", "__c").join(keyed.withColumn("__c", key), "__c").select(
            "__k", F.col(score).cast("double").alias("__s"), "__a", "__b"))
        sums = added(ready.select("__k", "__a", "__b"))
        zero = F.lit(0).cast("long")
        rows = ready.select("__k", F.lit(1).alias("__kind"), "__s", zero.alias("__p"), zero.alias("__n"), none("binary", "__m"), "__a", "__b")
    else:
        parts = keyed.groupBy("__k", "__group").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
        sums = added(lookup(parts, picks, ["__group"], "inner").select("__k", "__p", "__n", "__m").mapInArrow(
            partial(_weighted, replicates), _SUMS))
        rows = lookup(keyed.select("__k", "__group", F.col(score).cast("double").alias("__s"), "__p", "__n"), picks, ["__group"], "inner").select(
            "__k", F.lit(1).alias("__kind"), "__s", "__p", "__n", "__m", none("binary", "__a"), none("binary", "__b"))
    sums = cut_lineage(sums.join(names, "__k"))

    def stacked(pdf: pd.DataFrame, column: str, kind=np.int64) -> np.ndarray:
        return np.stack([np.frombuffer(x, kind) for x in pdf[column]])

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:  # a row per bucket
        pdf = pdf.sort_values("__bucket", ascending=False)
        return pd.DataFrame({"__k": pdf["__k"], **{c: [x.tobytes() for x in np.cumsum(v, axis=0) - v]
                                                   for c in ("__a", "__b") for v in [stacked(pdf, c)]}})

    key = by or [F.lit(0).alias("__all")]
    above = sums.groupBy(*key).applyInPandas(offsets, _SUMS)
    rows = rows.unionByName(above.select(
        "__k", F.lit(0).alias("__kind"), none("double", "__s"), F.lit(0).cast("long").alias("__p"), F.lit(0).cast("long").alias("__n"),
        none("binary", "__m"), "__a", "__b"))
    areas = rows.repartition(tasks, "__k").sortWithinPartitions("__k", "__kind", F.desc("__s")).mapInArrow(
        partial(_areas, replicates), _SUMS).withColumnsRenamed({"__a": "__roc", "__b": "__pr"})

    def intervals(pdf: pd.DataFrame) -> pd.DataFrame:  # a row per bucket
        p, n = stacked(pdf, "__a").sum(axis=0), stacked(pdf, "__b").sum(axis=0)
        good = (p > 0) & (n > 0)
        p, n = p[good], n[good]
        out = []
        for metric, column, scale in (("pooled_roc_auc", "__roc", p * n), ("pooled_pr_auc", "__pr", p)):
            v = stacked(pdf, column, np.float64).sum(axis=0)[good] / scale
            out.append((metric, v.mean(), *np.quantile(v, [0.025, 0.975]), len(v)) if len(v) else (metric, None, None, None, 0))
        found = pd.DataFrame(out, columns=["metric", "mean", "ci_low", "ci_high", "valid_iterations"])
        return found.assign(**{c: [pdf[c].iloc[0]] * 2 for c in by})

    schema = T.StructType([
        T.StructField("metric", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("mean", "ci_low", "ci_high")],
        T.StructField("valid_iterations", T.LongType()), *[keyed.schema[c] for c in by]])
    found = sums.join(areas, "__k").groupBy(*key).applyInPandas(intervals, schema)
    groups = df.agg(F.count_distinct(group).alias("g")).scalar()
    return found.select(
        *by, "metric", "mean", "ci_low", "ci_high", groups.alias("n"), F.lit(replicates).alias("bootstrap_iterations"), "valid_iterations")
