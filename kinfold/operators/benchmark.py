"""Out-of-fold scoring, nested thresholds, protocols, search and leave-one-group-out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from kinfold.operators import metrics as met
from kinfold.operators import splits
from kinfold.operators.combining import stack_results
from kinfold.operators.models import ModelSpec, fit
from kinfold.operators.profiling import summarise
from kinfold.operators.weights import combined_weights
from kinfold.plans.ordered import lookup
from kinfold.plans.session import cut_lineage

Hook = Callable[[DataFrame], DataFrame]
FOLD_METRICS = ("roc_auc", "pr_auc", "mcc", "f1", "balanced_accuracy")


def run_parallel(df: DataFrame, jobs: Sequence[Callable[[], object]], threads: int = 4) -> list:
    """Independent fits from a few driver threads; Spark schedules their tasks together."""
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return list(pool.map(lambda j: inheritable_thread_target(df.sparkSession)(j)(), jobs))


def oof_scores(
    df: DataFrame, spec: ModelSpec, fold: str = "fold", folds: Sequence[int] | None = None,
    threads: int = 4,
) -> DataFrame:
    """Score of every row from a model that never saw its fold.

    ``fold`` is a column; a few folds, so the list of values is bounded by design.
    """
    values = folds or [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]

    def one(k):
        return fit(df.where(F.col(fold) != k), spec)(df.where(F.col(fold) == k))

    parts = run_parallel(df, [lambda k=k: one(k) for k in values], threads)
    return reduce(lambda a, b: a.unionByName(b), parts)


def grouped_oof(df: DataFrame, spec: ModelSpec, k: int = 4, seed: int = 42) -> DataFrame:
    """Out-of-fold scores over class-balanced folds of whole groups."""
    table = splits.stratified_group_kfold(df, spec.group, spec.label, k, [seed])
    data = cut_lineage(lookup(df.drop("fold"), table.select(spec.group, "fold"), [spec.group]))
    return oof_scores(data, spec, "fold", list(range(k)))


def threshold_weights(spec: ModelSpec) -> Hook | None:
    """Weights for the threshold stage: only for learners that ignore weights in fitting."""
    if spec.kind not in ("mlp", "knn"):
        return None
    return lambda d: combined_weights(d, spec.label, spec.group, spec.group_weight,
                                      spec.class_weight, out="__tw")


def inner_thresholds(
    train: DataFrame, spec: ModelSpec, k: int = 3, seed: int = 42, weigh: Hook | None = None
) -> DataFrame:
    """One row of thresholds tuned on held-out groups inside the training rows."""
    oof = grouped_oof(train, spec, k, seed)
    if weigh is not None:
        return met.optimal_thresholds(weigh(oof), spec.label, "score", (), "__tw")
    return met.optimal_thresholds(oof, spec.label, "score")


def fold_record(
    test: DataFrame, thresholds: DataFrame, spec: ModelSpec, method: str, seed: int, fold: int
) -> DataFrame:
    """One record: ranking metrics and each metric at its own tuned threshold."""
    t = thresholds.first()  # four numbers
    cut = lambda name: met.classification_battery(
        test, spec.label, (F.col("score") >= float(t[f"thr_{name}"])).cast("int"))
    rank = met.ranking_metrics(test, spec.label, "score").select("roc_auc", "pr_auc")
    size = test.agg(F.count("*").alias("n_test"), F.count_distinct(spec.group).alias("n_test_groups"))
    return size.select(
        F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.lit(fold).alias("fold"),
        "n_test", "n_test_groups",
        rank.select("roc_auc").scalar().alias("roc_auc"), rank.select("pr_auc").scalar().alias("pr_auc"),
        cut("mcc").select("mcc").scalar().alias("mcc"), cut("f1").select("f1").scalar().alias("f1"),
        cut("balanced_accuracy").select("balanced_accuracy").scalar().alias("balanced_accuracy"),
        cut("youden_j").select("balanced_accuracy").scalar().alias("youden_j_balacc"),
        *[F.lit(float(t[f"thr_{n}"])).alias(f"thr_{n}")
          for n in ("mcc", "f1", "balanced_accuracy", "youden_j")],
    )


def _nested(df: DataFrame, spec: ModelSpec, method: str, seed: int, fold: int, inner: int,
            test_flag) -> DataFrame:
    train, test = df.where(~test_flag).drop("fold"), df.where(test_flag).drop("fold")
    thr = inner_thresholds(train, spec, inner, seed, threshold_weights(spec))
    scored = cut_lineage(fit(train, spec)(test).select(spec.row_id, spec.group, spec.label, "score"))
    return fold_record(scored, thr, spec, method, seed, fold)


def grouped_benchmark(
    df: DataFrame, specs: Mapping[str, ModelSpec], seeds: Sequence[int] = (42, 43, 44), k: int = 5,
    inner: int = 3, threads: int = 2,
) -> DataFrame:
    """Fold records of every method on identical repeated group folds."""
    any_spec = next(iter(specs.values()))
    table = splits.stratified_group_kfold(df, any_spec.group, any_spec.label, k, seeds)
    jobs = []
    for seed in seeds:
        one = table.where(F.col("seed") == seed).select(any_spec.group, "fold")
        data = cut_lineage(lookup(df, one, [any_spec.group]))
        for method, spec in specs.items():
            for f in range(k):
                jobs.append(lambda m=method, s=spec, d=data, f=f, sd=seed: _nested(
                    d, s, m, sd, f, inner, F.col("fold") == f))
    return stack_results(run_parallel(df, jobs, threads))


def row_benchmark(
    df: DataFrame, specs: Mapping[str, ModelSpec], protocol: str = "kfold", k: int = 5,
    seeds: Sequence[int] = (42,), inner: int = 3, threads: int = 2,
) -> DataFrame:
    """Row-level protocols: ``holdout`` (80/20 stratified) or ``kfold`` (stratified)."""
    any_spec = next(iter(specs.values()))
    jobs = []
    for seed in seeds:
        if protocol == "holdout":
            t = splits.stratified_holdout(df, any_spec.label, [any_spec.row_id], seed)
            t = t.select(any_spec.row_id, F.when(F.col("is_test"), 0).otherwise(1).alias("fold"))
            tests = [0]
        else:
            t = splits.stratified_kfold(df, any_spec.label, [any_spec.row_id], k, seed)
            t, tests = t.select(any_spec.row_id, "fold"), list(range(k))
        data = cut_lineage(df.join(t, any_spec.row_id))
        for method, spec in specs.items():
            for f in tests:
                jobs.append(lambda m=method, s=spec, d=data, f=f, sd=seed: _nested(
                    d, s, m, sd, f, inner, F.col("fold") == f))
    return stack_results(run_parallel(df, jobs, threads))


def leave_one_group_out(
    df: DataFrame, spec: ModelSpec, threads: int = 4, groups: Sequence | None = None
) -> DataFrame:
    """Out-of-group score of every row, one fit per group (the number of groups is the cost).

    The group keys are listed once, never the rows; scores are stored as they come.
    """
    keys = groups or [r[0] for r in df.select(spec.group).distinct().orderBy(spec.group).collect()]

    def one(g):
        s = fit(df.where(F.col(spec.group) != g), spec)
        return cut_lineage(s(df.where(F.col(spec.group) == g)).select(
            spec.row_id, spec.group, spec.label, "score"))

    parts = run_parallel(df, [lambda g=g: one(g) for g in keys], threads)
    return reduce(lambda a, b: a.unionByName(b), parts)


def leave_one_group_out_table(df: DataFrame, specs: Mapping[str, ModelSpec], threads: int = 4) -> DataFrame:
    """(method, row, score) of several models on the same held-out groups."""
    return stack_results([
        leave_one_group_out(df, s, threads).withColumn("method", F.lit(m)) for m, s in specs.items()
    ])


def _protocol_folds(df: DataFrame, spec: ModelSpec, protocol: str, k: int, seed: int):
    """(split table, join column, folds to test) of one protocol."""
    if protocol == "holdout":
        t = splits.stratified_holdout(df, spec.label, [spec.row_id], seed)
        return t.withColumn("fold", F.when(F.col("is_test"), 0).otherwise(1)), spec.row_id, [0]
    if protocol == "stratified":
        return splits.stratified_kfold(df, spec.label, [spec.row_id], k, seed), spec.row_id, list(range(k))
    if protocol == "group":
        return splits.group_kfold(df, spec.group, k), spec.group, list(range(k))
    table = splits.stratified_group_kfold(df, spec.group, spec.label, k, [seed])
    return table, spec.group, list(range(k))


def protocol_scores(
    df: DataFrame, spec: ModelSpec, protocols: Sequence[str], k: int = 5, seeds: Sequence[int] = (42,)
) -> DataFrame:
    """(protocol, mean, std, n_fits): AUC over folds; the deviation is the population one."""
    parts = []
    for protocol in protocols:
        for seed in seeds if protocol == "stratified_group" else seeds[:1]:
            table, on, tests = _protocol_folds(df, spec, protocol, k, seed)
            folds = table.select(on, "fold")
            data = cut_lineage(lookup(df, folds, [on]) if on == spec.group else df.join(folds, on))
            oof = oof_scores(data, spec, "fold", tests)
            auc = met.ranking_metrics(oof, spec.label, "score", ["fold"])
            parts.append(auc.select(F.lit(protocol).alias("protocol"), "roc_auc"))
    return stack_results(parts).groupBy("protocol").agg(
        F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std"), F.count("*").alias("n_fits"))


def protocol_ladder(df: DataFrame, spec: ModelSpec, k: int = 5, seeds: Sequence[int] = (42,)) -> DataFrame:
    """The four fold protocols and pooled leave-one-group-out, from most to least optimistic."""
    rows = protocol_scores(df, spec, ("holdout", "stratified", "group", "stratified_group"), k, seeds)
    lopo = met.ranking_metrics(leave_one_group_out(df, spec), spec.label, "score")
    return rows.unionByName(lopo.select(
        F.lit("leave_one_group_out").alias("protocol"), F.col("roc_auc").alias("mean"),
        F.lit(0.0).alias("std"), F.lit(1).cast("bigint").alias("n_fits")))


def grouped_search(
    df: DataFrame, spec: ModelSpec, candidates: Sequence[Mapping], k: int = 3, seed: int = 42,
    metric: str = "roc_auc", threads: int = 4,
) -> DataFrame:
    """History of a search: every candidate on the same group folds, best first.

    ``candidates`` is the drawn or sampled list of parameter settings.
    """
    table = splits.stratified_group_kfold(df, spec.group, spec.label, k, [seed]) if metric == "roc_auc" \
        else splits.group_kfold(df, spec.group, k)
    data = cut_lineage(lookup(df, table.select(spec.group, "fold"), [spec.group]))

    def one(i: int, f: int) -> DataFrame:
        s = spec.but(params={**spec.params, **candidates[i]})
        out = fit(data.where(F.col("fold") != f), s)(data.where(F.col("fold") == f))
        m = met.ranking_metrics(out, spec.label, "score") if metric == "roc_auc" \
            else met.regression_battery(out, spec.label, "score")
        return m.select(F.lit(i).alias("candidate"), F.lit(f).alias("fold"), F.col(metric).alias("value"))

    jobs = [lambda i=i, f=f: one(i, f) for i in range(len(candidates)) for f in range(k)]
    history = stack_results(run_parallel(df, jobs, threads)).groupBy("candidate").agg(
        F.avg("value").alias(metric), F.stddev_pop("value").alias("std"))
    text = F.element_at(F.array(*[F.lit(str(dict(sorted(c.items())))) for c in candidates]), F.col("candidate") + 1)
    order = F.desc(metric) if metric == "roc_auc" else F.asc(metric)
    return history.withColumn("params", text).orderBy(order, "candidate")


def draw_candidates(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n seeded independent draws from a parameter space (repeats dropped)."""
    import random

    rng, out = random.Random(seed), []
    for _ in range(n):
        c = {key: rng.choice(list(vals)) for key, vals in space.items()}
        if c not in out:
            out.append(c)
    return out


def sample_grid(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n points of the full grid without replacement (all of them if n is larger)."""
    import random
    from itertools import product

    grid = [dict(zip(space, v)) for v in product(*space.values())]
    return grid if n >= len(grid) else random.Random(seed).sample(grid, n)


def cv_summary(df: DataFrame, spec: ModelSpec, fold: str = "fold", threads: int = 4) -> DataFrame:
    """Mean and deviation over folds of AUC, AP and the battery at 0.5."""
    oof = oof_scores(df, spec, fold, threads=threads)
    per = met.classification_battery(oof, spec.label, (F.col("score") >= 0.5).cast("int"), "score", [fold])
    return summarise(per.withColumn("kind", F.lit(spec.kind)), ["kind"], list(FOLD_METRICS))


def repeated_regression(
    df: DataFrame, specs: Mapping[str, ModelSpec], repeats: int = 10, n_extra: int = 1000, **kw
) -> DataFrame:
    """Metrics of every (repeat, model, strategy, plain/augmented) regression run."""
    from kinfold.operators.models import four_conditions

    s0 = next(iter(specs.values()))
    pairs = splits.holdout_pair(df, s0.group, s0.label, [s0.row_id], repeats, **kw)
    out = []
    for r in range(1, repeats + 1):
        flags = pairs.where(F.col("repeat") == r).select(s0.row_id, "random_test", "group_test")
        data = cut_lineage(df.join(flags, s0.row_id))
        for name, spec in specs.items():
            pred = four_conditions(data, spec, "random_test", "group_test", n_extra)
            m = met.regression_battery(pred, "y_true", "y_pred", ["strategy", "augmented"])
            out.append(m.select(F.lit(r).alias("repeat"), F.lit(name).alias("model"), "*"))
    return stack_results(out)
