"""Leakage and shift audit: novelty, mutual information, importance, attribution, redundancy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators import metrics as met
from kinfold.operators.models import ModelSpec, fit
from kinfold.operators.profiling import _long, encoded_features, rank_correlation_matrix
from kinfold.operators.splits import stratified_kfold
from kinfold.plans.ordered import (
    hash_key, hashed_positions, lookup, prefix_sums, quantiles, value_at_position,
    with_value_bucket,
)
from kinfold.plans.session import cut_lineage


# ---- novelty of a group against all others ----------------------------------------------

def leave_out_quantiles(
    df: DataFrame, group: str, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """(feature, group, q): exact quantiles of every feature over all rows *outside* each group.

    The rest is total minus group.  For the k-th smallest value of the rest, the
    group's own values that lie below are those with at most k rest values under
    them; adding their count to k gives the position in the full order, which one
    as-of sweep turns into the value.  No group is ever scanned against the rest.

    A quantile of the rest lies between the k-th value of all rows and the (k + group size)-th.  Own values before the
    least of these places over all groups count, those after the greatest don't; only the rows between them, about twice the
    largest group and its ties, are sorted by group.
    """
    long = _long(df.where(F.col(group).isNotNull()), cols, [group]).where(F.col("value").isNotNull())
    one = F.lit(1).cast("bigint")
    # each is read several times below: sorted once, kept in the shared folder
    total = cut_lineage(prefix_sums(long, "value", {"__t": one}, ["feature"]))
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    sizes = total.groupBy("feature").agg(F.max("__t_total").alias("__t_total"))
    names = F.array(*[F.lit(c) for c in cols])
    # one row per (feature, group), also for groups without values of the feature
    shell = groups.select(group, F.explode(names).alias("feature")).join(
        F.broadcast(sizes), "feature"  # one row per feature
    ).join(
        long.groupBy("feature", group).agg(F.count("*").alias("g_n")), ["feature", group], "left"
    ).withColumn("rest", F.col("__t_total") - F.coalesce("g_n", F.lit(0))).where(F.col("rest") > 0)
    at = lambda q: F.lit(float(q)) * (F.col("rest") - 1)
    wanted = [(f"q{i}", side, f, q) for i, q in enumerate(probs) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    shell = cut_lineage(shell.withColumn("__k", F.array(*[f(at(q)).cast("bigint") for _, _, f, q in wanted])))
    # the first and last value in question, one row per feature
    ends = shell.groupBy("feature").agg(*[
        F.struct(F.min(F.col("__k")[2 * i]).alias("lo"), F.max(F.col("__k")[2 * i + 1] + F.coalesce("g_n", F.lit(0))).alias("hi")).alias(f"e{i}")
        for i in range(len(probs))])
    ends = cut_lineage(total.join(F.broadcast(ends), "feature").groupBy("feature").agg(F.array(*[
        F.struct(*[F.max(F.when(F.col("__t_before") <= F.col(f"e{i}.{x}"), F.col("value"))).alias(x) for x in ("lo", "hi")])
        for i in range(len(probs))]).alias("__e")))
    marked = long.join(F.broadcast(ends), "feature")
    sure = marked.groupBy("feature", group).agg(F.array(*[
        F.sum((F.col("value") < F.col("__e")[i]["lo"]).cast("long")) for i in range(len(probs))]).alias("__sure"))
    shell = shell.join(sure, ["feature", group], "left")
    between = marked.select("feature", group, "value", F.posexplode("__e").alias("__q", "e")).where(
        "value >= e.lo and value <= e.hi").select("feature", group, "value", "__q")
    own = cut_lineage(prefix_sums(between, "value", {"__g": one}, ["feature", group, "__q"]))
    below = own.join(total.select("feature", "value", "__t_before"), ["feature", "value"])
    # own values under each wanted rank of the rest: one conditional sum a rank, combined before the shuffle
    rest_below = F.col("__t_before") - F.col("__g_before") - F.col("__sure")[F.col("__q")]
    ranked = lookup(below.select("feature", group, "value", "__q", "__g", "__t_before", "__g_before"),
                    shell.select("feature", group, "__k", "__sure"), ["feature", group], "inner", ["value"])
    counts = ranked.withColumn("__r", rest_below).groupBy("feature", group).agg(F.array(*[
        F.coalesce(F.sum(F.when((F.col("__q") == i // 2) & (F.col("__r") <= F.col("__k")[i]), F.col("__g"))), F.lit(0))
        for i in range(len(wanted))]).alias("__c"))
    placed = shell.join(counts, ["feature", group], "left")
    place = lambda i: F.col("__k")[i] + F.coalesce(F.col("__sure")[i // 2], F.lit(0)) + F.coalesce(F.col("__c")[i], F.lit(0))
    shift = placed.select("feature", group, "__t_total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), (at(q) - F.floor(at(q))).alias("part"), place(i).alias("pos"))
        for i, (name, side, _, q) in enumerate(wanted)])))
    found = value_at_position(shift, total, ["feature"], "pos", "__t_before", "value", "__t_total")
    wide = found.groupBy("feature", group, "q").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("hi"), F.max("part").alias("part"),
    ).withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return wide.groupBy("feature", group).pivot("q", [f"q{i}" for i in range(len(probs))]).agg(F.first("v"))


def group_novelty(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per group the median over rows of the row's median robust z against all other groups."""
    q = cut_lineage(leave_out_quantiles(df, group, cols))  # groups x features rows
    stats = q.groupBy(group).pivot("feature", list(cols)).agg(
        F.first(F.struct(F.col("q1").alias("med"), F.nullif(F.col("q2") - F.col("q0"), F.lit(0.0)).alias("iqr")))
    ).withColumnsRenamed({c: f"__s_{c}" for c in cols})
    rows = lookup(df.select(group, *cols), stats, [group])
    z = F.array_compact(F.array(*[
        F.abs(F.col(c) - F.col(f"__s_{c}")["med"]) / F.col(f"__s_{c}")["iqr"] for c in cols
    ]))
    s, n = F.array_sort("__z"), F.size("__z")
    mid = (F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
           + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    row_z = rows.withColumn("__z", z).withColumn("__row", F.when(n > 0, mid))
    return quantiles(row_z, "__row", {"median_robust_z": 0.5}, [group])


# ---- mutual information -------------------------------------------------------------------

def discrete_information(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(feature, mi, h_target): mutual information in nats of discrete columns with a target.

    NULL is a value of its own.  Joint counts first, then everything is small sums.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in cols
    ])
    joint = df.select(F.col(target).cast("string").alias("t"), F.inline(pairs)).groupBy(
        "feature", "x", "t").agg(F.count("*").alias("n"))
    n = joint.groupBy("feature").agg(F.sum("n").alias("nn"))
    # sum n log n of the joint and of both margins: no joint-to-margin join is needed
    s = lambda d: F.sum(F.col(d) * F.log(F.col(d)))
    hj = joint.groupBy("feature").agg(s("n").alias("sj"))
    hx = joint.groupBy("feature", "x").agg(F.sum("n").alias("n")).groupBy("feature").agg(s("n").alias("sx"))
    ht = joint.groupBy("feature", "t").agg(F.sum("n").alias("n")).groupBy("feature").agg(s("n").alias("st"))
    j = n.join(hj, "feature").join(hx, "feature").join(ht, "feature")
    return j.select(
        "feature",
        F.greatest(F.lit(0.0), (F.col("sj") - F.col("sx") - F.col("st")) / F.col("nn") + F.log("nn")).alias("mi"),
        (F.log("nn") - F.col("st") / F.col("nn")).alias("h_target"),
    )


def binned_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 16) -> DataFrame:
    """The same for numeric columns cut at their quantiles (the scalable default)."""
    from kinfold.operators.ranking import quantile_bins

    out = df
    for c in cols:
        out = quantile_bins(out, c, bins, f"__b_{c}")
    got = discrete_information(out, [f"__b_{c}" for c in cols], target)
    return got.withColumn("feature", F.substr("feature", F.lit(5)))


def digamma(x: Column) -> Column:
    """Digamma of a positive count: recurrence up to x + 6, then the asymptotic series."""
    shift = F.lit(0.0)
    for i in range(6):
        shift = shift - 1 / (x + i)
    y = x + 6
    i2 = 1 / (y * y)
    series = F.log(y) - 0.5 / y - i2 * (1 / 12.0 - i2 * (1 / 120.0 - i2 * (1 / 252.0 - i2 / 240.0)))
    return series + shift


def _counts_inside(points: DataFrame, row_id: str) -> DataFrame:
    """(feature, row, inside): how many ``v`` of the feature lie in the closed interval ``v - near`` to ``v + near`` of each row.

    Points and both ends of all intervals are one table and one sweep; a lower end comes before its
    equals, an upper one after them.
    """
    v, near = F.col("v"), F.col("near")
    entry = lambda at, kind, w: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(w).cast("bigint").alias("w"))
    all_ = points.select("feature", row_id, F.inline(F.array(entry(v - near, -1, 0), entry(v, 0, 1), entry(v + near, 1, 0))))
    all_ = with_value_bucket(all_, "at", points.select(v.alias("at")))
    cells = all_.groupBy("feature", "__bucket").agg(F.sum("w").alias("s"))
    earlier = Window.partitionBy("feature").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = cells.select("feature", "__bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("off"))
    inside = Window.partitionBy("feature", "__bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = all_.join(off, ["feature", "__bucket"]).withColumn("below", F.col("off") + F.sum("w").over(inside))
    ends = swept.where("kind <> 0")
    return ends.groupBy("feature", row_id).agg(F.sum(F.col("kind") * F.col("below")).alias("inside"))


def neighbour_information(
    df: DataFrame, cols: Sequence[str], target: str, row_id: str, k: int = 5
) -> DataFrame:
    """(feature, mi): k-nearest-neighbour estimate of numeric columns against a discrete target.

    Missing values take the column median, which is only worked out where there are some.  Per row
    the distance to its k-th neighbour in the own class comes from an index window of 2k rows over
    the class order; the number of all rows nearer than that comes from one sweep over all points
    and both ends of these intervals.  Classes of one row are left out.
    """
    x = cut_lineage(_long(df, cols, [row_id, target]).select(
        "feature", row_id, F.col(target).cast("string").alias("t"), F.col("value").cast("double").alias("v")))
    counts = x.groupBy("feature").agg(F.count("v").alias("n"), F.count("*").alias("m")).collect()  # a row per feature
    holes = [c["feature"] for c in counts if c["n"] < c["m"]]
    if holes:
        med = quantiles(x.where(F.col("feature").isin(holes)), "v", {"med": 0.5}, ["feature"])
        x = cut_lineage(x.join(F.broadcast(med), "feature", "left").withColumn("v", F.coalesce("v", "med")).drop("med").where(
            F.col("v").isNotNull()))  # a feature of nothing but nulls has no median
    # position in the (feature, class) order, then a k-wide halo by equi-join on blocks
    pos = prefix_sums(x, ["v", row_id], {"one": F.lit(1).cast("bigint")}, ["feature", "t"]).select(
        "feature", "t", "v", row_id, F.col("one_before").alias("p"), F.col("one_total").alias("n"))
    size = max(64, 4 * k)
    block = F.floor(F.col("p") / size)
    halo = F.array_distinct(F.array(
        F.floor((F.col("p") - k) / size), block, F.floor((F.col("p") + k) / size)))
    w = Window.partitionBy("feature", "t", "b").orderBy("p")
    near = [F.abs(F.col("v") - F.lag("v", i).over(w)) for i in range(1, k + 1)]
    near += [F.abs(F.col("v") - F.lead("v", i).over(w)) for i in range(1, k + 1)]
    kk = F.least(F.lit(k), F.col("n") - 1).cast("int")
    r = pos.where(F.col("n") > 1).withColumn("b", F.explode(halo)).withColumn(
        "d", F.array_sort(F.array_compact(F.array(*near)))
    ).where(F.col("b") == block).select(
        "feature", row_id, "v", "n", kk.alias("kk"), F.element_at("d", kk).alias("r"))
    r = cut_lineage(r)
    # just inside the radius: the k-th neighbour itself never counts, equal values always do
    found = _counts_inside(r.select("feature", row_id, "v", (F.col("r") * (1 - 1e-10)).alias("near")), row_id)
    dg = lambda c: digamma(c.cast("double"))
    inside = found.groupBy("feature").agg(F.avg(dg(F.greatest(F.lit(1), F.col("inside")))).alias("inside"))
    # class sizes are few
    sizes = r.groupBy("feature", "n", "kk").agg(F.count("*").alias("w")).groupBy("feature").agg(
        F.sum("w").alias("all"), (F.sum(F.col("w") * (dg(F.col("kk")) - dg(F.col("n")))) / F.sum("w")).alias("own"))
    return sizes.join(inside, "feature").select(
        "feature", F.greatest(F.lit(0.0), dg(F.col("all")) + F.col("own") - F.col("inside")).alias("mi"))


def information_table(
    df: DataFrame, cols: Sequence[str], label: str, group: str
) -> DataFrame:
    """MI with label and with group, the share of the group's entropy, and their ratio."""
    y = discrete_information(df, cols, label).select("feature", F.col("mi").alias("mi_target"))
    g = discrete_information(df, cols, group).select("feature", F.col("mi").alias("mi_group"), "h_target")
    return g.join(y, "feature").select(
        "feature", "mi_target", "mi_group",
        (F.col("mi_group") / F.col("h_target")).alias("identifiability"),
        (F.col("mi_group") / F.greatest("mi_target", F.lit(1e-6))).alias("group_to_target"),
    )


def chance_level(df: DataFrame, group: str) -> DataFrame:
    """Accuracy of guessing the group by its share: sum of squared shares."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    return g.agg((F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("chance"), F.count("*").alias("n_groups"))


def identifiability_probe(
    df: DataFrame, spec: ModelSpec, k: int = 5, trees: int = 30, depth: int = 10
) -> DataFrame:
    """Cross-validated accuracy of a forest that predicts the *group* from the features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    from kinfold.operators.benchmark import run_parallel
    from kinfold.operators.combining import stack_results
    from kinfold.operators.models import preprocessor

    folds = stratified_kfold(df, spec.group, [spec.row_id], k).select(spec.row_id, "fold")
    data = cut_lineage(df.join(folds, spec.row_id).withColumn("__g", F.col(spec.group).cast("string")))
    codes = StringIndexer(inputCol="__g", outputCol="__code").fit(data)

    def one(f: int) -> DataFrame:
        rf = RandomForestClassifier(featuresCol="features", labelCol="__code", numTrees=trees,
                                    maxDepth=depth, seed=42)
        pipe = Pipeline(stages=[*preprocessor(spec).getStages(), rf])
        coded = codes.transform(data)
        m = pipe.fit(coded.where(F.col("fold") != f))
        return m.transform(coded.where(F.col("fold") == f)).agg(
            F.avg((F.col("prediction") == F.col("__code")).cast("double")).alias("acc"))

    acc = stack_results(run_parallel(df, [lambda f=f: one(f) for f in range(k)]))
    ch = chance_level(df, spec.group)
    return acc.agg(F.avg("acc").alias("accuracy"), F.stddev_pop("acc").alias("std")).select(
        "*", ch.select("chance").scalar().alias("chance"), ch.select("n_groups").scalar().alias("n_groups"))


# ---- importance and attribution -----------------------------------------------------------

def permuted_rows(df: DataFrame, cols: Sequence[str], row_id: str, repeats: int, seed: int = 42) -> DataFrame:
    """Every row as it is (feature "", repeat 0), and for each repeat and column with that value of another row.

    A repeat has one donor for each row, by two hash orders joined on position, whose values serve all columns.
    """
    rows = df.select(row_id)
    own = hashed_positions(rows, 0, [row_id]).select(row_id, "pos")
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    donor = hashed_positions(each, F.lit(seed).cast("long") + F.col("repeat"), [row_id], ["repeat"]).select(
        "repeat", "pos", F.col(row_id).alias("__donor"))
    values = df.select(F.col(row_id).alias("__donor"), F.struct(*cols).alias("__v"))
    swap = own.join(donor, "pos").join(values, "__donor").select(row_id, "repeat", "__v")
    rest = [c for c in df.columns if c not in cols]
    variants = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[(F.col("__v")[x] if x == c else F.col(x)).alias(x) for x in cols]) for c in cols])
    swapped = df.join(swap, row_id).select(*rest, "repeat", F.inline(variants))
    return df.select("*", F.lit(0).alias("repeat"), F.lit("").alias("feature")).unionByName(swapped)


def permuted(df: DataFrame, col: str, row_id: str, seed: int) -> DataFrame:
    """``df`` with one column shuffled."""
    return permuted_rows(df, [col], row_id, 1, seed).where(F.col("feature") == col).select(*df.columns)


def permutation_importance(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], spec: ModelSpec, cols: Sequence[str],
    repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """(feature, repeat, importance): AUC lost when a column of the held-out rows is shuffled.

    All columns and repeats are scored in one plan; only counts per score go on from there.
    """
    rows = permuted_rows(df, cols, spec.row_id, repeats, seed)
    kind = df.schema[spec.row_id].dataType
    rows = rows.withColumn(spec.row_id, F.xxhash64(spec.row_id, "feature", "repeat").cast(kind))  # one name for each variant
    auc = cut_lineage(met.ranking_metrics(score(rows), spec.label, "score", ["feature", "repeat"]))
    base = auc.where(F.col("feature") == "").select("roc_auc").scalar()
    return auc.where(F.col("feature") != "").select(
        "feature", "repeat", (base - F.col("roc_auc")).alias("importance"))


def grouped_permutation_importance(
    df: DataFrame, spec: ModelSpec, cols: Sequence[str], k: int = 5, repeats: int = 10
) -> DataFrame:
    """Mean and deviation over held-out group folds of the permutation importance."""
    from kinfold.operators.combining import stack_results
    from kinfold.operators.splits import group_kfold

    folds = group_kfold(df, spec.group, k).select(spec.group, "fold")
    data = cut_lineage(lookup(df, folds, [spec.group]))
    parts = []
    for f in range(k):
        s = fit(data.where(F.col("fold") != f), spec)
        test = cut_lineage(data.where(F.col("fold") == f))
        parts.append(permutation_importance(test, s, spec, cols, repeats).withColumn("fold", F.lit(f)))
    per = stack_results(parts).groupBy("fold", "feature").agg(F.avg("importance").alias("importance"))
    return per.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))


def shapley_attribution(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], cols: Sequence[str], row_id: str,
    n_background: int = 8, orders: int = 2, seed: int = 42,
) -> DataFrame:
    """(row, feature, contribution) of every row of ``df`` by sampled permutations.

    For each row, order and background row (``n_background`` of them, drawn by hash) the features
    switch one by one from background to row values; consecutive score differences are the
    contributions, so they sum to score - mean background score.
    """
    import random

    rows = df.select(row_id, F.struct(*cols).alias("x"))
    back = df.orderBy(hash_key(seed + 1, row_id), row_id).limit(n_background).select(F.struct(*cols).alias("z"))
    ground = back.agg(F.collect_list("z").alias("zs")).scalar()  # n_background rows
    rng = random.Random(seed)
    plans = [rng.sample(list(cols), len(cols)) for _ in range(orders)]
    steps = F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(i).alias("step"),
                 F.array(*[F.lit(c) for c in plan[:i]]).alias("on") if i else F.array().cast("array<string>").alias("on"),
                 (F.lit(plan[i - 1]) if i else F.lit(None).cast("string")).alias("feature"))
        for o, plan in enumerate(plans) for i in range(len(cols) + 1)
    ])
    grid = rows.withColumn("zs", ground).select(row_id, "x", F.posexplode("zs").alias("bg", "z")).select(
        row_id, "x", "z", "bg", F.inline(steps))
    mixed = grid.select(row_id, "bg", "ord", "step", "feature", *[
        F.when(F.array_contains("on", c), F.col("x")[c]).otherwise(F.col("z")[c]).alias(c) for c in cols])
    scored = score(mixed)
    w = Window.partitionBy(row_id, "bg", "ord").orderBy("step")  # one row's steps: #features + 1
    delta = scored.withColumn("d", F.col("score") - F.lag("score").over(w)).where(F.col("step") > 0)
    return delta.groupBy(row_id, "feature").agg(F.avg("d").alias("contribution"))


def leaf_paths(fitted) -> tuple[list[tuple[int, int, int, float]], float]:
    """(tree, leaf, slot, contribution) of a fitted tree or forest, and the score of its roots.

    On the way to a leaf, each step changes the node's value; the change belongs to the slot the step asked for.
    A forest's trees count with their share, and boosted trees with their weight (on the margin, not the score).  As many
    rows as the model has leaves, times their depth at most.
    """
    java = fitted.model._java_obj
    trees = list(java.trees()) if hasattr(fitted.model, "trees") else [java]
    weights = [float(w) for w in java.treeWeights()] if hasattr(fitted.model, "trees") else [1.0]
    if not hasattr(fitted.model, "trees") or "boosted" not in fitted.spec.kind:
        weights = [w / sum(weights) for w in weights]
    probable = not fitted.spec.kind.endswith("_reg") and "boosted" not in fitted.spec.kind
    rows, base = [], 0.0

    def value(node) -> float:
        if not probable:
            return float(node.prediction())
        stats = [float(x) for x in node.impurityStats().stats()]
        return stats[1] / sum(stats) if sum(stats) else 0.0

    for t, (tree, weight) in enumerate(zip(trees, weights)):
        leaf, todo = 0, [(tree.rootNode(), {})]
        base += weight * value(tree.rootNode())
        while todo:
            node, path = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                rows += [(t, leaf, slot, v) for slot, v in path.items()]
                leaf += 1
                continue
            slot, here = int(node.split().featureIndex()), value(node)
            for child in (node.rightChild(), node.leftChild()):  # the left one is taken first, as leaves are numbered
                step = weight * (value(child) - here)
                todo.append((child, {**path, slot: path.get(slot, 0.0) + step}))
    return rows, base


def path_attribution(df: DataFrame, fitted, row_id: str) -> tuple[DataFrame, float]:
    """(row, feature, contribution) for every row and *encoded* feature, and the base score.

    A row's contributions add up to its score (boosted: margin) less the base.  Spark says in which leaf
    of each tree a row ends; the paths are a small table that is joined to these.
    """
    from pyspark.ml.functions import vector_to_array

    from kinfold.operators.models import encoded_names

    paths, base = leaf_paths(fitted)
    names = encoded_names(fitted.pre, fitted.spec)
    spark = df.sparkSession
    model = fitted.model.copy()
    model.setLeafCol("__leaf")
    at = model.transform(fitted.pre.transform(df))
    leaves = vector_to_array("__leaf") if hasattr(fitted.model, "trees") else F.array("__leaf")
    at = at.select(row_id, F.posexplode(leaves).alias("__t", "__l"))
    table = spark.createDataFrame(paths, "__t int, __l int, __slot int, v double")
    slots = spark.createDataFrame(list(enumerate(names)), "__slot int, feature string")
    hit = at.join(F.broadcast(table), (at["__t"] == table["__t"]) & (at["__l"].cast("int") == table["__l"])).select(
        row_id, "__slot", "v")
    none = df.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("__slot"), F.lit(0.0).alias("v"))
    out = hit.unionByName(none).groupBy(row_id, "__slot").agg(F.sum("v").alias("contribution"))
    return out.join(F.broadcast(slots), "__slot").select(row_id, "feature", "contribution"), base


def mean_abs_attribution(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def parent_attribution(df: DataFrame, feature: str = "feature", value: str = "mean_abs") -> DataFrame:
    """Sum of ``name=value`` features per ``name``."""
    return df.groupBy(F.element_at(F.split(feature, "="), 1).alias("feature")).agg(F.sum(value).alias(value))


def leakage_signature(
    attribution: DataFrame, importance: DataFrame, top: int = 5, floor: float = 0.005
) -> DataFrame:
    """Features the model leans on that do not help on unseen groups."""
    w = Window.partitionBy().orderBy(F.desc("mean_abs"), "feature")  # one row per feature
    ranked = attribution.withColumn("rank", F.row_number().over(w))
    return ranked.join(importance.select("feature", F.col("mean").alias("importance")), "feature").select(
        "feature", "rank", "mean_abs", "importance",
        ((F.col("rank") <= top) & (F.col("importance") < floor)).alias("suspect"))


# ---- redundancy ------------------------------------------------------------------------------

def average_linkage(names: Sequence[str], dist: np.ndarray, cut: float) -> dict[str, int]:
    """Average-linkage clusters of a (features x features) distance matrix below ``cut``."""
    clusters = [[i] for i in range(len(names))]
    while len(clusters) > 1:
        pairs = [
            (float(np.mean([dist[i, j] for i in a for j in b])), x, y)
            for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y
        ]
        best, x, y = min(pairs)
        if best > cut:
            break
        clusters[x] = clusters[x] + clusters[y]
        del clusters[y]
    order = sorted(range(len(clusters)), key=lambda c: min(clusters[c]))
    return {names[i]: n for n, c in enumerate(order) for i in clusters[c]}


def redundancy_groups(df: DataFrame, cols: Sequence[str], cut: float = 0.3, categorical: Sequence[str] = ()) -> DataFrame:
    """(feature, cluster): features linked by 1 - |rank correlation| below ``cut``.

    Categories count as codes and missing numbers as the median.  The correlations are a Spark
    job; only the features x features matrix is local.
    """
    df, cols = encoded_features(df, cols, categorical), [*cols, *categorical]
    index = {c: i for i, c in enumerate(cols)}
    dist = np.ones((len(cols), len(cols)))
    np.fill_diagonal(dist, 0.0)
    for r in rank_correlation_matrix(df, cols).collect():  # k (k - 1) / 2 rows
        d = max(0.0, 1.0 - abs(r["rho"] or 0.0))
        dist[index[r["a"]], index[r["b"]]] = dist[index[r["b"]], index[r["a"]]] = d
    found = average_linkage(list(cols), dist, cut)
    return df.sparkSession.createDataFrame(list(found.items()), "feature string, cluster int")


# ---- reports that combine a count with a cross-validated score ----------------------------------

def baseline_bundle(df: DataFrame, spec: ModelSpec, k: int = 5) -> DataFrame:
    """AUC of the stratified hold-out, stratified k-fold and group k-fold."""
    from kinfold.operators.benchmark import protocol_scores

    return protocol_scores(df, spec, ("holdout", "stratified", "group"), k)


def duplicate_inflation(df: DataFrame, spec: ModelSpec, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Stratified CV AUC with and without in-group duplicates, next to the counts."""
    from kinfold.operators.benchmark import protocol_scores
    from kinfold.operators.combining import stack_results
    from kinfold.operators.identity import drop_exact_duplicates, duplicate_counts

    clean = drop_exact_duplicates(df, keys, F.col(spec.row_id))
    both = stack_results([
        protocol_scores(d, spec, ("stratified",), k).withColumn("data", F.lit(name))
        for name, d in (("with duplicates", df), ("deduplicated", clean))
    ])
    c = duplicate_counts(df, keys)
    return both.select("data", "mean", "std", c.select("n_rows").scalar().alias("n_rows"),
                       c.select("n_removed").scalar().alias("n_removed"))


def contamination_scores(df: DataFrame, spec: ModelSpec, old_key: str, entity: str, k: int = 5) -> DataFrame:
    """Group CV AUC under the old and the canonical key."""
    from kinfold.operators.benchmark import protocol_scores
    from kinfold.operators.combining import stack_results

    return stack_results([
        protocol_scores(df, spec.but(group=g), ("group",), k).withColumn("key", F.lit(name))
        for name, g in (("old", old_key), ("canonical", entity))
    ])
