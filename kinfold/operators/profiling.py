"""Group statistics, coverage, histograms and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.special import student_t_two_sided
from kinfold.plans.ordered import lookup, prefix_sums, quantiles
from kinfold.plans.session import cut_lineage, free, shuffles_removed, written

#: Distinct values of a column whose ranks are sent to every task as one table; more are joined by a shuffle.
FEW_VALUES = 50_000
#: Rows that look their ranks up in one query.
ROWS_AT_ONCE = 16_000_000
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows of the named numeric columns."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])
    return df.select(*keep, F.inline(pairs))


def group_stats(
    df: DataFrame, group: str, label: str, name: str, name_order: str, numeric: Sequence[str],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Size, positives, rate, single-class flag, share and numeric coverage of each group."""
    filled = F.lit(0.0)
    for c in numeric:
        filled = filled + F.col(c).isNotNull().cast("double")
    per = df.groupBy(group).agg(
        F.min_by(name, name_order).alias("label"),
        F.count("*").alias("n_rows"),
        F.sum(label).cast("long").alias("n_positive"),
        F.avg(label).alias("positive_rate"),
        F.avg(filled / len(numeric)).alias("numeric_coverage"),
        *extra,
    )
    total = per.agg(F.sum("n_rows").alias("n")).scalar()  # shares the aggregate's exchange
    return per.select(
        "*",
        (F.col("n_rows") - F.col("n_positive")).alias("n_negative"),
        F.col("positive_rate").isin(0.0, 1.0).alias("single_class"),
        (100 * F.col("n_rows") / total).alias("share_pct"),
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))


def _size_counts(df: DataFrame, group: str) -> DataFrame:
    """(size, number of groups of that size): at most sqrt(2 * rows) rows."""
    return group_sizes(df, group).groupBy("n").agg(F.count("*").alias("k"))


def gini(df: DataFrame, group: str) -> DataFrame:
    """Gini coefficient of the group sizes, over the collapsed size table."""
    w = Window.partitionBy().orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    s = _size_counts(df, group).select(
        "n", "k",
        F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"),
        F.sum("k").over(Window.partitionBy()).alias("groups"),
    )
    block = F.col("n") * F.col("k") * (2 * F.col("before") + F.col("k") - F.col("groups"))
    return s.agg(
        F.max("groups").alias("n_groups"),
        (F.sum(block) / (F.max("groups") * F.sum(F.col("n") * F.col("k")))).alias("gini"),
    )


def size_summary(df: DataFrame, group: str) -> DataFrame:
    """describe() of the group sizes plus the median."""
    s = _size_counts(df, group)
    mean = F.sum(F.col("n") * F.col("k")) / F.sum("k")
    square = F.sum(F.col("n") * F.col("n") * F.col("k"))
    quart = F.percentile("n", [0.25, 0.5, 0.75], F.col("k"))
    return s.agg(
        F.sum("k").alias("count"), mean.alias("mean"),
        F.sqrt((square - F.sum("k") * mean * mean) / F.nullif(F.sum("k") - 1, F.lit(0))).alias("std"),
        F.min("n").alias("min"), quart.alias("__q"), F.max("n").alias("max"),
    ).select(
        "count", "mean", "std", "min", F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("median"),
        F.col("__q")[2].alias("q75"), "max",
    )


def summarise(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every metric under flat names."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs)


def stability(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Mean, deviation, median, min, max per group."""
    base = df.groupBy(*by).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"),
    )
    return base.join(quantiles(df, metric, {"median": 0.5}, by), list(by))


def overview(df: DataFrame, group: str, label: str, numeric: Sequence[str]) -> DataFrame:
    """One-row card: rows, groups, median group size, label counts and numeric ranges."""
    sizes = size_summary(df, group)
    ranges = []
    for c in numeric:
        ranges += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                   F.count(c).alias(f"{c}_n")]
    card = df.agg(
        F.count("*").alias("n_rows"),
        F.sum((F.col(label) == 1).cast("long")).alias("n_yes"),
        F.sum((F.col(label) == 0).cast("long")).alias("n_no"), *ranges,
    )
    return card.select(
        "*",
        (100 * F.col("n_yes") / F.col("n_rows")).alias("yes_pct"),
        (100 * F.col("n_no") / F.col("n_rows")).alias("no_pct"),
        sizes.select("count").scalar().alias("n_groups"),
        sizes.select("median").scalar().alias("median_group_size"),
    )


def value_counts(df: DataFrame, col: str, missing: str = "Unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit(missing)).alias(col)).count()


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` x the named values of ``col`` (missing cells are 0)."""
    t = df.where(F.col(row).isNotNull()).groupBy(row).pivot(col, list(values)).count()
    return t.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values])


def crosstab_pct(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Row-normalised crosstab in percent; rows without any of the values drop out."""
    t = crosstab(df, row, col, values)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return t.where(total > 0).select(
        row, *[(100 * F.col(f"`{v}`") / total).alias(str(v)) for v in values]
    )


def group_fraction(df: DataFrame, group: str, condition: Column, name: str = "fraction") -> DataFrame:
    """Share of rows of each group that meet the condition; NULL is "no"."""
    return df.groupBy(group).agg(
        F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias(name)
    )


def group_span(df: DataFrame, group: str, col: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("count"),
        (F.max(col) - F.min(col)).alias("span"),
    )


def group_distinct(df: DataFrame, group: str, col: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(col).alias("n_distinct"))


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percent of non-null values, one row per column, from one pass."""
    one = df.agg(*[(100 * F.count(c) / F.count("*")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("pct")) for c in cols])
    return one.select(F.inline(pairs))


def histogram(df: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """Equal-width counts between min and max (of log10 when ``log``); the top edge is inside."""
    x = F.log10(value) if log else F.col(value).cast("double")
    v = df.where(F.col(value) > 0 if log else F.col(value).isNotNull()).select(x.alias("x"))
    edge = v.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    b = v.withColumn("e", edge).select(
        F.least(
            F.floor((F.col("x") - F.col("e.lo")) * bins / (F.col("e.hi") - F.col("e.lo"))),
            F.lit(bins - 1),
        ).cast("int").alias("bin")
    )
    return b.groupBy("bin").count()


def density_grid(df: DataFrame, x: str, y: str, nx: int, ny: int, log_y: bool = True) -> DataFrame:
    """Counts on a square grid of two variables (non-empty cells only)."""
    yy = F.log10(y) if log_y else F.col(y).cast("double")
    v = df.where(F.col(x).isNotNull() & (F.col(y) > 0 if log_y else F.col(y).isNotNull())).select(
        F.col(x).cast("double").alias("x"), yy.alias("y")
    )
    edge = v.agg(F.struct(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).alias("e")).scalar()
    cell = lambda c, n: F.least(
        F.floor((F.col(c) - F.col(f"e.{c}0")) * n / (F.col(f"e.{c}1") - F.col(f"e.{c}0"))),
        F.lit(n - 1),
    ).cast("int")
    return v.withColumn("e", edge).groupBy(
        cell("x", nx).alias("x_bin"), cell("y", ny).alias("y_bin")
    ).count()


def quartile_summary(df: DataFrame, category: str, value: str, min_count: int = 10) -> DataFrame:
    """Quartiles, min and max per category with at least ``min_count`` values."""
    ok = df.where(F.col(value).isNotNull() & F.col(category).isNotNull())
    base = ok.groupBy(category).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")
    ).where(F.col("n") >= min_count)
    return base.join(quantiles(ok, value, QUARTILES, [category]), category)


def rank_correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation over rows where both are present.

    Equal (a, b) pairs are collapsed first and the ranks come from two bucketed
    sorts, so no task sees a whole column.  The pairs are stored: ranks find their
    rows by value, and a mean worked out again may differ in its last bit.
    """
    by = list(by)
    pairs = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("w")))

    def ranked(c: str, name: str) -> DataFrame:
        sums = prefix_sums(pairs, c, {"__n": F.col("w")}, by)
        return sums.select(*by, c, (F.col("__n_before") + (F.col("__n") + 1) / 2).alias(name))

    ra, rb = ranked(a, "ra"), ranked(b, "rb")
    j = pairs.join(ra, [*by, a]).join(rb, [*by, b])
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    mid = (F.sum(w) + 1) / 2  # mean rank
    cov = F.sum(w * x * y) - F.sum(w) * mid * mid
    var = lambda c: F.sum(w * c * c) - F.sum(w) * mid * mid
    return j.groupBy(*by).agg(
        F.sum(w).alias("n"), F.try_divide(cov, F.sqrt(var(x) * var(y))).alias("rho")
    )


def _null_classes(df: DataFrame, cols: Sequence[str], row: str) -> tuple[list[int], list[str]]:
    """Class of every column, where columns of one class are null in the same rows, and one column of each."""
    facts = df.agg(*[
        F.struct(F.count(F.when(F.col(c).isNull(), 1)), F.bit_xor(F.when(F.col(c).isNull(), F.xxhash64(row))).alias("x")).alias(f"c{i}")
        for i, c in enumerate(cols)]).first()
    seen: dict[tuple, int] = {}
    of = [seen.setdefault(tuple(f), len(seen)) for f in facts]
    return of, [cols[of.index(c)] for c in range(len(seen))]


def _with_ranks(rows: DataFrame, ranks: DataFrame, of: list[int], stats: dict, total: int) -> DataFrame:
    """``rows`` with the array of ranks ``r0``, ``r1``.. of each column's value (NULL for none)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = lambda i: i not in stats or stats[i]["d"] <= FEW_VALUES
    for i in sorted(range(len(of)), key=few):  # small tables last: their ranks aren't shuffled
        table = ranks.where(F.col("i") == i).select(F.col("v").alias(f"v{i}"), F.col("r").alias(f"r{i}"))
        if few(i):
            rows = rows.join(F.broadcast(table), f"v{i}", "left").drop(f"v{i}")
        else:
            hot = max(stats[i]["hot"], total - stats[i]["n"])  # the most frequent value, or NULL
            salts = max(1, min(tasks, -(-hot * tasks // total)))
            rows = lookup(rows, table, [f"v{i}"], "left", ["row"], salts, grows=True).drop(f"v{i}")
    return rows


def _pair_sums(rows: DataFrame, of: list[int]) -> DataFrame:
    """One row with the sum ``p{i}_{j}`` of rank products of every two columns."""
    at = lambda i, c: F.col(f"r{i}")[of[c]]
    return rows.agg(*[F.sum(at(i, j) * at(j, i)).alias(f"p{i}_{j}") for i, j in combinations(range(len(of)), 2)])


def _sums_of_parts(held: DataFrame, path: str, ranks: DataFrame, of: list[int], stats: dict, total: int, parts: int) -> dict:
    """``_pair_sums`` of the stored rows at ``path`` (deleted), added up over ``parts`` whose shuffle files go one by one.

    Rows are parted by their value in the column of most values, so each part needs only its share of the largest
    table of ranks; by row where a value is so frequent that its part would be large.
    """
    spark = held.sparkSession
    by = max(stats, key=lambda i: stats[i]["d"])
    even = stats[by]["hot"] * parts <= 2 * total
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    part = F.when(F.col(f"v{by}").isNotNull(), place(f"v{by}")).otherwise(place("row")) if even else place("row")
    parted, folder = written(held.withColumn("part", part), ["part"])
    free(spark, path)
    sums: dict = {}
    for p in range(parts):
        rows = parted.where(F.col("part") == p).drop("part")
        table = ranks.where((F.col("i") != by) | (place("v") == p)) if even else ranks
        for name, s in _pair_sums(_with_ranks(rows, table, of, stats, total), of).first().asDict().items():
            sums[name] = sums.get(name) if s is None else s + (sums.get(name) or 0.0)
    free(spark, folder)
    return sums


def rank_correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman matrix (upper triangle, long form).

    Every column is ranked once, by its distinct values, for each distinct pattern of nulls that
    other columns have.  Rows stay whole and look up a column's ranks at a time: from a table sent to every
    task if its values are few, else by a join that is salted only as far as its most frequent
    value needs.  All pair sums are one aggregate; beyond ``ROWS_AT_ONCE`` rows it is one per part, so that
    the rows shuffled at a time, once for each such column, stay bounded.
    """
    cols, spark = list(cols), df.sparkSession
    numbers = list(combinations(range(len(cols)), 2))
    with shuffles_removed(spark):
        held, path = written(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).withColumn(
            "row", F.monotonically_increasing_id()))
        names = [f"v{i}" for i in range(len(cols))]
        of, firsts = _null_classes(held, names, "row")
        present = F.array(*[F.col(c).isNotNull().cast("long") for c in firsts])
        long = held.select(F.posexplode(F.array(*names)).alias("i", "v"), present.alias("in_")).where("v is not null")
        counts = {f"n{c}": F.col(f"n{c}") for c in range(len(firsts))}
        values = long.groupBy("i", "v").agg(*[F.sum(F.col("in_")[c]).alias(f"n{c}") for c in range(len(firsts))])
        sums = prefix_sums(values, "v", counts, ["i"])
        centred = lambda c: F.col(f"n{c}_before") + (F.col(f"n{c}") + 1) / 2 - (F.col(f"n{c}_total") + 1) / 2
        ranks = cut_lineage(sums.select(
            "i", "v", F.array(*[centred(c).cast("double") for c in range(len(firsts))]).alias("r"),
            F.array(*[F.col(f"n{c}") for c in range(len(firsts))]).alias("n")))
        # a row per column; a value's rows are those of the column's own class, which has most of them
        stats = {r["i"]: r for r in ranks.select("i", F.array_max("n").alias("n")).groupBy("i").agg(
            F.count("*").alias("d"), F.max("n").alias("hot"), F.sum("n").alias("n")).collect()}
        total = held.count()
        parts = -(-total // ROWS_AT_ONCE) if stats else 1
        if parts > 1:
            found = _sums_of_parts(held, path, ranks, of, stats, total, parts)
            gram = spark.createDataFrame([(i, j, found[f"p{i}_{j}"]) for i, j in numbers], "i int, j int, cov double")
        else:
            gram = _pair_sums(_with_ranks(held, ranks, of, stats, total), of).select(F.inline(F.array(*[
                F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("cov")) for i, j in numbers])))
    # a column's own sums among the rows where a class is present: columns x classes numbers
    own = ranks.select("i", F.posexplode(F.zip_with("r", "n", lambda x, m: F.struct((x * x * m).alias("s"), m.alias("m")))).alias("c", "t")).groupBy(
        "i", "c").agg(F.sum("t.s").alias("s"), F.sum("t.m").alias("n"))
    pairs = spark.createDataFrame(
        [(i, j, a, b, of[i], of[j]) for (i, a), (j, b) in combinations(enumerate(cols), 2)],
        "i int, j int, a string, b string, ci int, cj int")
    side = lambda i, c, s, n: own.select(F.col("i").alias(i), F.col("c").alias(c), F.col("s").alias(s), F.col("n").alias(n))
    full = pairs.join(gram, ["i", "j"], "left").join(side("i", "cj", "sa", "n"), ["i", "cj"], "left").join(
        side("j", "ci", "sb", "m"), ["j", "ci"], "left")
    return full.where("n > 0").select("a", "b", "n", F.try_divide("cov", F.sqrt(F.col("sa") * F.col("sb"))).alias("rho"))


def encoded_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Every feature as a number without nulls: categories as codes in their order (-1 for null), missing numbers at the median.

    The features are stored first, because codes and medians read them again; a column without missing numbers needs no median.
    """
    held = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *categorical))
    missing = held.agg(F.count("*"), *[F.count_if(F.col(c).isNull()) for c in numeric]).first()[1:]
    out = held
    for c in categorical:
        codes = prefix_sums(held.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("__v")).distinct(), "__v",
                            {"__one": F.lit(1).cast("long")}, bucket=F.ascii("__v")).select("__v", F.col("__one_before").alias("__code"))
        out = lookup(out.withColumn("__v", F.col(c).cast("string")), codes, ["__v"]).drop("__v", c).withColumn(
            c, F.coalesce("__code", F.lit(-1)).cast("double")).drop("__code")
    for c, gaps in zip(numeric, missing, strict=True):
        if gaps:
            out = out.withColumn(c, F.coalesce(c, quantiles(held.select(c), c, {"m": 0.5}).select("m").scalar()))
    return out.select(*numeric, *categorical)


def correlation_p_value(df: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Two-sided p of a correlation from the t distribution (n-2 degrees), vectorised."""
    @F.pandas_udf("double")
    def p_value(r: pd.Series, m: pd.Series) -> pd.Series:
        return student_t_two_sided(r, m)

    return df.withColumn("p_value", p_value(rho, F.col(n).cast("double")))


def weighted_summary(df: DataFrame, value: str, weight: str, limits: Sequence[float]) -> DataFrame:
    """Mean, median, weighted mean and counts below the limits over non-null values."""
    ok = df.where(F.col(value).isNotNull())
    med = quantiles(ok, value, {"median": 0.5})
    return ok.agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"),
        *[
            F.sum((F.col(value) < lim).cast("long")).alias(f"below_{str(lim).replace('.', '_')}")
            for lim in limits
        ],
    ).withColumn("median", med.scalar())


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts, rate and negative/positive ratio (positives at least 1)."""
    return df.agg(
        F.count(label).alias("n"),
        F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("n_neg"),
        F.avg(label).alias("rate"),
        (F.sum((F.col(label) == 0).cast("long"))
         / F.greatest(F.sum((F.col(label) == 1).cast("long")), F.lit(1))).alias("neg_pos_ratio"),
    )


def group_target_summary(df: DataFrame, group: str, target: str) -> DataFrame:
    base = df.groupBy(group).agg(F.avg(target).alias("y_mean"), F.count("*").alias("y_count"))
    return base.join(quantiles(df, target, {"y_median": 0.5}, [group]), group)
