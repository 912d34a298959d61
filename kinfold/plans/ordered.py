"""Ordered accumulation over a whole table without a one-task window.

A global ``OVER (ORDER BY v)`` pulls every row into one task, and a
``PARTITION BY g ORDER BY v`` does the same to a hot group.  Here every ordered
operator is two-level instead:

1. equal values are pre-aggregated (one hot value is one row);
2. the ordering column is cut into buckets (quantile edges from one small
   sketch, or a fixed cut of a hash key);
3. running sums *inside* a (group, bucket) come from a window, and the sums of
   *earlier* buckets come from a table with at most one row per (group, bucket).

Groups with a NULL key are left out, as a pandas ``groupby`` does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

_BUCKET = "__bucket"
HASH_BITS = 32


def hash_key(seed, *cols: Column | str) -> Column:
    """Uniform integer in [0, 2**32): the seeded random order used everywhere.

    Both Spark and other SQL engines can compute it, so a "random" split is
    reproducible and checkable.
    """
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bucket(key: Column | str, bits: int | None = None) -> Column:
    """The leading bits of a hash key: 256 buckets, or about 2 per shuffle task if that is more."""
    if bits is None:
        bits = min(HASH_BITS, max(8, (2 * _tasks(SparkSession.active()) - 1).bit_length()))
    return F.shiftright(F.col(key) if isinstance(key, str) else key, HASH_BITS - bits)


def _grid(df: DataFrame) -> int:
    """Side of the bucket grid; there are side**2 buckets, about 2 per shuffle task."""
    side = 4
    while side * side < 2 * _tasks(df.sparkSession):
        side += 2
    return side


def with_value_bucket(df: DataFrame, value: str, like: DataFrame | None = None) -> DataFrame:
    """Add an order-preserving bucket number for ``value`` (numeric or time).

    The edges are one lazy scalar subquery: a quantile sketch of fixed size.  It
    reads every column of ``df``, so its exchange is the very one the main plan
    uses and the input is scanned and shuffled once, not once more for the edges.
    ``like`` (a stored table with a column ``value``) gives the edges instead, if its values lie alike.
    """
    side = _grid(df)
    cuts = [i / (side * side) for i in range(1, side * side)]
    # parsed as one expression: thousands of separate literals would cost driver time
    cut_list = ", ".join(f"{c!r}D" for c in cuts)
    hashable = [] if like is not None else [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    sketch = (df if like is None else like).agg(F.expr(
        f"percentile_approx(`{value}`, array({cut_list}), {max(1000, 4 * side * side)})"
    ).alias("e"), *[F.max(F.xxhash64(c)).alias(f"__x{i}") for i, c in enumerate(hashable)])
    edges = sketch.select(
        F.struct(
            *[f"__x{i}" for i in range(len(hashable))],
            F.col("e").alias("fine"),
            F.filter(F.col("e"), lambda _, i: i % side == side - 1).alias("coarse"),
        )
    ).scalar()
    below = lambda arr: F.size(F.filter(arr, lambda e: e < F.col(value)))
    fine = F.slice(F.col("__edges")["fine"], F.col("__block") * side + 1, F.lit(side))
    return (
        df.withColumn("__edges", edges)
        .withColumn("__block", F.coalesce(below(F.col("__edges")["coarse"]), F.lit(0)))
        .withColumn(_BUCKET, _known(F.col("__block") * side + below(fine)))
        .drop("__edges", "__block")
    )


def _known(bucket: Column) -> Column:
    """Non-null by type.  Else a join on the bucket adds a NOT NULL test that is pushed through
    the aggregate down to every scanned row, and the branches no longer share an exchange."""
    return F.coalesce(bucket, F.lit(0))


def prefix_sums(
    df: DataFrame,
    order: str | Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """One row per distinct (by, order) with each measure ``m`` summed, plus
    ``m_before`` (sum over all smaller keys of the group) and ``m_total``.

    ``bucket`` must rise with the first ordering column; the default cuts that
    column at its quantiles.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    # all NULL tests come before the aggregate, so that the sketch, the bucket totals and the
    # main branch plan the very same exchange and it runs once
    for c in [*by, order[0]]:
        df = df.where(F.col(c).isNotNull())
    g = df.groupBy(*by, *order).agg(*[F.sum(c).alias(m) for m, c in sums.items()])
    keyed = with_value_bucket(g, order[0]) if bucket is None else g.withColumn(_BUCKET, _known(bucket))
    cells = keyed.groupBy(*by, _BUCKET).agg(*[F.sum(m).alias(m) for m in sums])
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *by,
        _BUCKET,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}__off") for m in sums],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in sums],
    )
    inside = (
        Window.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = keyed.join(offsets, [*by, _BUCKET])
    return joined.select(
        *by,
        *order,
        *sums,
        *[
            (F.col(f"{m}__off") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before")
            for m in sums
        ],
        *[f"{m}_total" for m in sums],
    )


def dense_positions(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), bucket: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """0-based position ``pos`` of every distinct (by, order, keep) row and the group size ``n``."""
    order = [*order, *[k for k in keep if k not in order]]
    p = prefix_sums(df, order, {"__one": F.lit(1).cast("bigint")}, by, bucket)
    return p.select(
        *by, *order, F.col("__one_before").alias("pos"), F.col("__one_total").alias("n")
    )


def hashed_positions(
    df: DataFrame, seed, ids: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Seeded random order of the rows inside each group (ids must be unique)."""
    keyed = df.withColumn("__h", hash_key(seed, *ids))
    order = ["__h", *ids]
    return dense_positions(keyed, order, by, hash_bucket("__h"), keep)


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; no group is buffered whole."""
    w = F.lit(1) if weight is None else weight
    p = prefix_sums(
        df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double")),
        value, {"__n": w.cast("bigint")}, by,
    )
    n, lo_rank = F.col("__n_total"), F.col("__n_before")
    hit = lambda k: (lo_rank <= k) & (k < lo_rank + F.col("__n"))
    aggs = []
    for name, q in probs.items():
        at = F.lit(float(q)) * (n - 1)
        aggs += [
            F.max(F.when(hit(F.floor(at)), F.col(value))).alias(f"{name}__lo"),
            F.max(F.when(hit(F.ceil(at)), F.col(value))).alias(f"{name}__hi"),
            F.max(at - F.floor(at)).alias(f"{name}__f"),
        ]
    out = p.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (
                F.col(f"{name}__lo")
                + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * F.col(f"{name}__f")
            ).alias(name)
            for name in probs
        ],
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank ``rank`` (ties share their mean) of every distinct (by, value)."""
    p = prefix_sums(df.where(F.col(value).isNotNull()), value, {"__n": F.lit(1).cast("bigint")}, by)
    return p.select(
        *by, value, (F.col("__n_before") + (F.col("__n") + 1) / 2).alias("rank"),
        F.col("__n").alias("n_ties"), F.col("__n_total").alias("n"),
    )


def with_previous(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, value) with the next smaller value of the group as ``previous``."""
    keyed = with_value_bucket(
        df.where(F.col(value).isNotNull()).select(*by, value).distinct(), value
    )
    cells = keyed.groupBy(*by, _BUCKET).agg(F.max(value).alias("__top"))
    earlier = (
        Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = cells.select(*by, _BUCKET, F.max("__top").over(earlier).alias("__carry"))
    inside = Window.partitionBy(*by, _BUCKET).orderBy(value)
    return keyed.join(carry, [*by, _BUCKET]).select(
        *by, value, F.coalesce(F.lag(value).over(inside), F.col("__carry")).alias("previous")
    )


def value_at_position(
    requests: DataFrame, positions: DataFrame, key: Sequence[str], at: str, start: str,
    value: str, size: str,
) -> DataFrame:
    """As-of lookup: the ``value`` of ``positions`` whose [start, start+count) holds ``at``.

    Both sides are stacked, cut into equal position buckets per key and swept by
    one bucketed window, so neither a range join nor a cross join is needed.
    ``size`` names the column with the key's total, present on both sides.
    """
    key = list(key)
    extra = [c for c in requests.columns if c not in (*key, at, size)]
    table = positions.select(
        *key, F.col(start).alias("__p"), F.col(size).alias("__n"), F.lit(0).alias("__kind"),
        F.col(value).alias("__v"),
        *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra],
    )
    asks = requests.select(
        *key, F.col(at).alias("__p"), F.col(size).alias("__n"), F.lit(1).alias("__kind"),
        F.lit(None).cast(positions.schema[value].dataType).alias("__v"), *extra,
    )
    side = _grid(requests)
    cut = F.floor(F.col("__p") * (side * side) / F.greatest(F.col("__n"), F.lit(1)))
    both = table.unionByName(asks).withColumn(_BUCKET, _known(cut))
    cells = both.groupBy(*key, _BUCKET).agg(
        F.max(F.when(F.col("__kind") == 0, F.struct("__p", "__v"))).alias("__last")
    )
    earlier = (
        Window.partitionBy(*key).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = cells.select(
        *key, _BUCKET, F.last("__last", ignorenulls=True).over(earlier)["__v"].alias("__carry")
    )
    inside = (
        Window.partitionBy(*key, _BUCKET).orderBy("__p", "__kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    swept = both.join(carry, [*key, _BUCKET]).withColumn(
        value, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__carry"))
    )
    return swept.where(F.col("__kind") == 1).select(*key, F.col("__p").alias(at), *extra, value)


def lookup(
    df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
    salt_by: Sequence[str] | None = None, salts: int | None = None, grows: bool = False,
) -> DataFrame:
    """Equi-join of a fact table to a one-row-per-key table that may grow with the data.

    A hot key would land in one task, so the key is salted: the fact side
    spreads every key over ``salts`` tasks (the square root of the shuffle tasks, at least 8) and
    the table side is repeated.  The repeat also gives the join fresh exchanges on both sides,
    which lets adaptive execution split what is still skewed, or broadcast a small table.
    Keys match null-safely.

    The planner takes the repeated table for as large as its packed file, without the repeats: ``grows`` says that the
    table (a stored one with a row per group, say) outgrows what the driver may broadcast.

    The salt is a hash of ``salt_by`` alone (best a row id; else the first two plain columns that
    aren't keys), so filters and projections above the join reach the scan.
    """
    on = list(on)
    if salts is None:
        salts = max(8, round(_tasks(df.sparkSession) ** 0.5))
    if salt_by is None:
        plain = (f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType))
        salt_by = [c for c in plain if c not in on][:2]
    mix = F.xxhash64(*[F.col(f"`{c}`") for c in salt_by or on])
    spread = df.withColumn("__salt", F.pmod(mix, F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    renamed = repeated.select(
        *[F.col(k).alias(f"__k_{k}") for k in on],
        F.col("__salt").alias("__salt_r"),
        *[c for c in small.columns if c not in on],
    )
    if grows:
        renamed = renamed.hint("merge")
    cond = F.col("__salt") == F.col("__salt_r")
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return spread.join(renamed, cond, how).drop("__salt", "__salt_r", *[f"__k_{k}" for k in on])
