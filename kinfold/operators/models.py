"""Estimators: Spark ML pipelines plus the few learners Spark ML lacks.

A model is a ``ModelSpec``; ``fit(train, spec)`` returns a scorer, a function
``DataFrame -> DataFrame`` that adds ``score`` in [0, 1] (or the predicted
value).  Weights are always recomputed on the rows the model is fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression,
)
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.operators.resampling import cluster_resample
from kinfold.operators.splits import stratified_kfold
from kinfold.operators.weights import combined_weights
from kinfold.plans.ordered import hash_key, lookup
from kinfold.plans.session import cut_lineage, free, written

MISSING = -1.0e9  # below every real value, so one split isolates missing rows
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: learner, features, columns, weighting and learner parameters."""

    kind: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    label: str = "y"
    group: str = "group_id"
    row_id: str = "row_id"
    group_weight: str = "none"
    class_weight: bool = False
    scale: bool | None = None  # None: scaled for distance and gradient learners
    params: dict = field(default_factory=dict)

    def but(self, **changes) -> "ModelSpec":
        return replace(self, **changes)


SCALED_KINDS = ("mlp", "svm", "knn", "logistic", "linear")


def passthrough_stages(spec: ModelSpec) -> list:
    """Numeric as they are (missing = sentinel), categories one-hot with "Unknown"."""
    fills = [f"coalesce(CAST(`{c}` AS DOUBLE), {MISSING!r}D) AS `{c}__n`" for c in spec.numeric]
    return _assemble(spec, [SQLTransformer(statement=_select(spec, fills))],
                     [f"{c}__n" for c in spec.numeric])


def scaled_stages(spec: ModelSpec, missing_indicator: bool = True) -> list:
    """Median imputation, standardisation, optional 0/1 missing flags, one-hot categories."""
    raw = [f"CAST(`{c}` AS DOUBLE) AS `{c}__r`" for c in spec.numeric]
    flags = [f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}__m`" for c in spec.numeric] if missing_indicator else []
    filled = [f"{c}__n" for c in spec.numeric]
    stages = [
        SQLTransformer(statement=_select(spec, raw + flags)),
        Imputer(strategy="median", inputCols=[f"{c}__r" for c in spec.numeric], outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__num"),
        StandardScaler(inputCol="__num", outputCol="__std", withMean=True, withStd=True),
    ]
    return _assemble(spec, stages, ["__std", *[f"{c}__m" for c in spec.numeric if missing_indicator]])


def _select(spec: ModelSpec, extra: Sequence[str]) -> str:
    cats = [f"coalesce(CAST(`{c}` AS STRING), 'Unknown') AS `{c}__c`" for c in spec.categorical]
    return "SELECT *, " + ", ".join([*extra, *cats]) + " FROM __THIS__"


def _assemble(spec: ModelSpec, stages: list, inputs: list[str]) -> list:
    if spec.categorical:
        cats = list(spec.categorical)
        stages += [
            StringIndexer(inputCols=[f"{c}__c" for c in cats], outputCols=[f"{c}__i" for c in cats],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}__i" for c in cats], outputCols=[f"{c}__h" for c in cats],
                          dropLast=True),
        ]
        inputs = [*inputs, *[f"{c}__h" for c in cats]]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def preprocessor(spec: ModelSpec) -> Pipeline:
    scaled = spec.kind in SCALED_KINDS if spec.scale is None else spec.scale
    return Pipeline(stages=scaled_stages(spec) if scaled else passthrough_stages(spec))


def encoded_names(pre: PipelineModel, spec: ModelSpec) -> list[str]:
    """``name`` or ``name=value`` of every slot of the feature vector."""
    scaled = spec.kind in SCALED_KINDS if spec.scale is None else spec.scale
    names = list(spec.numeric) + ([f"{c}=missing" for c in spec.numeric] if scaled else [])
    labels = {
        col[:-3]: list(vals)
        for st in pre.stages if st.__class__.__name__ == "StringIndexerModel"
        for col, vals in zip(st.getInputCols(), st.labelsArray)
    }
    for c in spec.categorical:
        names += [f"{c}={v}" for v in labels[c]]  # the "invalid" slot is the dropped last one
    return names


def with_weight(df: DataFrame, spec: ModelSpec) -> DataFrame:
    if spec.group_weight == "none" and not spec.class_weight:
        return df.withColumn("__weight", F.lit(1.0))
    return combined_weights(df, spec.label, spec.group, spec.group_weight, spec.class_weight,
                            out="__weight")


def _probability(df: DataFrame) -> Column:
    return vector_to_array("probability")[1]


def _classifier(spec: ModelSpec, width: int):
    p, cols = dict(spec.params), dict(featuresCol="features", labelCol=spec.label)
    weighted = dict(cols, weightCol="__weight")
    if spec.kind == "tree":
        return DecisionTreeClassifier(**weighted, **{"maxDepth": 5, **p})
    if spec.kind == "boosted":
        return GBTClassifier(**weighted, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **p})
    if spec.kind == "forest":
        return RandomForestClassifier(**weighted, **{"numTrees": 50, "maxDepth": 8, "seed": 42, **p})
    if spec.kind == "logistic":
        return LogisticRegression(**weighted, **{"regParam": 0.01, **p})
    if spec.kind == "mlp":
        hidden = p.pop("hidden", [16])
        return MultilayerPerceptronClassifier(
            **cols, layers=[width, *hidden, 2], **{"maxIter": 60, "seed": 42, **p})
    raise ValueError(f"unknown classifier {spec.kind!r}")


def _regressor(spec: ModelSpec):
    cols = dict(featuresCol="features", labelCol=spec.label, weightCol="__weight")
    p = dict(spec.params)
    if spec.kind == "tree_reg":
        return DecisionTreeRegressor(**cols, **{"maxDepth": 5, **p})
    if spec.kind == "boosted_reg":
        return GBTRegressor(**cols, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **p})
    if spec.kind == "linear":
        return LinearRegression(**cols, **{"regParam": 0.01, **p})
    raise ValueError(f"unknown regressor {spec.kind!r}")


def _drop_working(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, "score")


@dataclass
class Fitted:
    """Fitted preprocessing and model with its scorer."""

    spec: ModelSpec
    pre: PipelineModel
    model: object
    score_column: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        scored = self.score_column(self.pre.transform(df))
        return _drop_working(scored, df.columns)


def fit(train: DataFrame, spec: ModelSpec) -> Scorer:
    """Fit one spec; KNN, SVM, focal and bagged learners have their own routines."""
    special = {"knn": fit_knn, "knn_reg": fit_knn, "svm": fit_svm, "focal": fit_focal,
               "bagged": fit_bagged}
    if spec.kind in special:
        return special[spec.kind](train, spec)
    pre = preprocessor(spec).fit(train)
    data = with_weight(pre.transform(train), spec)
    width = len(encoded_names(pre, spec))
    if spec.kind.endswith("_reg") or spec.kind == "linear":
        model = _regressor(spec).fit(data)
        return Fitted(spec, pre, model,
                      lambda d: model.transform(d).withColumn("score", F.col("prediction")))
    model = _classifier(spec, width).fit(data)
    return Fitted(spec, pre, model,
                  lambda d: (t := model.transform(d)).withColumn("score", _probability(t)))


# ---- support vectors on random Fourier features, calibrated -------------------------

def fourier_features(width: int, n: int, gamma: float, seed: int) -> tuple[list, list]:
    """Frequencies and phases approximating an RBF kernel (parameters, not data)."""
    rng = np.random.default_rng(seed)
    return (rng.normal(0.0, math.sqrt(2 * gamma), (n, width)).tolist(),
            rng.uniform(0, 2 * math.pi, n).tolist())


def fit_svm(train: DataFrame, spec: ModelSpec) -> Scorer:
    """Linear or RBF support vectors; out-of-fold margins calibrate a sigmoid (3 folds)."""
    p = {"n_features": 64, "gamma": None, "kernel": "rbf", "maxIter": 30, "regParam": 0.01,
         "calibration_folds": 3, **spec.params}
    pre = preprocessor(spec).fit(train)
    width = len(encoded_names(pre, spec))
    gamma = p["gamma"] or 1.0 / width
    freq, phase = fourier_features(width, p["n_features"], gamma, 42)
    w, b = np.array(freq), np.array(phase)

    @F.pandas_udf("array<double>")
    def rff(x: pd.Series) -> pd.Series:
        m = np.sqrt(2.0 / len(b)) * np.cos(np.stack(x.to_list()) @ w.T + b)
        return pd.Series(list(m))

    def mapped(df: DataFrame) -> DataFrame:
        d = pre.transform(df)
        if p["kernel"] == "linear":
            return d.withColumn("__x", F.col("features"))
        return d.withColumn("__x", array_to_vector(rff(vector_to_array("features"))))

    svc = LinearSVC(featuresCol="__x", labelCol=spec.label, weightCol="__weight",
                    maxIter=p["maxIter"], regParam=p["regParam"])
    margin = lambda m, d: m.transform(d).withColumn(
        "__margin", vector_to_array("rawPrediction")[1])
    data = mapped(with_weight(train, spec))
    folds = stratified_kfold(train, spec.label, [spec.row_id], p["calibration_folds"], 7)
    data_f = cut_lineage(data.join(folds.select(spec.row_id, "fold"), spec.row_id))
    oof = None
    for k in range(p["calibration_folds"]):
        part = margin(svc.fit(data_f.where(F.col("fold") != k)), data_f.where(F.col("fold") == k))
        part = part.select(spec.label, "__weight", "__margin")
        oof = part if oof is None else oof.unionByName(part)
    sigmoid = fit_sigmoid(oof, "__margin", spec.label, "__weight")
    final = svc.fit(data_f)

    def score(df: DataFrame) -> DataFrame:
        return _drop_working(sigmoid(margin(final, mapped(df))), df.columns)

    return score


def fit_sigmoid(df: DataFrame, margin: str, label: str, weight: str | None = None) -> Scorer:
    """Platt scaling: logistic curve of one margin column."""
    va = VectorAssembler(inputCols=[margin], outputCol="__mv")
    lr = LogisticRegression(featuresCol="__mv", labelCol=label, **({"weightCol": weight} if weight else {}))
    m = lr.fit(va.transform(df))
    a, c = float(m.coefficients[0]), float(m.intercept)
    return lambda d: d.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * F.col(margin) + F.lit(c)))))


def fit_monotone(df: DataFrame, feature: str, score: str, increasing: bool = True) -> Scorer:
    """Monotone substitute: isotonic fit of a score along one feature."""
    iso = IsotonicRegression(featuresCol=feature, labelCol=score, isotonic=increasing)
    model = iso.fit(df.where(F.col(feature).isNotNull() & F.col(score).isNotNull()))
    return lambda d: model.transform(d).withColumnRenamed("prediction", "monotone_score")


# ---- focal loss -----------------------------------------------------------------------

def focal_gradient(y: Column, margin: Column, gamma: float) -> tuple[Column, Column]:
    """First and second derivative of the binary focal loss w.r.t. the margin.

    With q the probability of the row's true class, the loss is
    -(1-q)^gamma log q; both derivatives are written in q and the sign of the
    class.  gamma = 0 gives p - y and p (1 - p).
    """
    p = 1 / (1 + F.exp(-margin))
    q = F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-9))
    u, sign, g = 1 - q, F.when(y == 1, 1.0).otherwise(-1.0), float(gamma)
    safe = F.greatest(u, F.lit(1e-12))
    ug, log_q = F.pow(safe, F.lit(g)), F.log(q)
    # d/dq of the loss times dq/dmargin = q (1 - q) sign
    slope = g * ug * q * log_q - ug * safe
    curve = q * safe * (
        g * ug * (1 + log_q) - g * g * F.pow(safe, F.lit(g - 1)) * q * log_q + (g + 1) * ug
    )
    return sign * slope, F.greatest(curve, F.lit(1e-16))


#: Rounds of boosting after which margins are written down anew.
MARGIN_ROUNDS = 10


def fit_focal(train: DataFrame, spec: ModelSpec) -> Scorer:
    """Newton boosting of the focal loss with weighted regression trees.

    Features are written once, with each row's margin beside them.  A round adds the last few trees
    to that margin as it reads; every ``MARGIN_ROUNDS`` rounds the table is renewed and the old one
    freed, so one copy stands at a time and no plan has more trees than that.
    """
    p = {"gamma": 1.0, "rounds": 10, "depth": 3, "rate": 0.3, **spec.params}
    spark = train.sparkSession
    pre = preprocessor(spec).fit(train)
    data, path = written(with_weight(pre.transform(train), spec).select(
        spec.label, "features", "__weight").withColumn("__margin", F.lit(0.0)))
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="__t", weightCol="__h",
                                 maxDepth=p["depth"], predictionCol="__step")

    def added(df: DataFrame, models: list) -> DataFrame:
        for m in models:
            df = m.transform(df).withColumn("__margin", F.col("__margin") + p["rate"] * F.col("__step")).drop("__step")
        return df

    trees, since = [], []
    for _ in range(p["rounds"]):
        if len(since) == MARGIN_ROUNDS:
            old, (data, path), since = path, written(added(data, since)), []
            free(spark, old)
        grad, hess = focal_gradient(F.col(spec.label), F.col("__margin"), p["gamma"])
        target = added(data, since).withColumn("__h", hess * F.col("__weight")).withColumn("__t", -grad / hess)
        target = target.withColumn("__t", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("__t"))))
        since.append(tree.fit(target))
        trees.append(since[-1])
    free(spark, path)

    def score(df: DataFrame) -> DataFrame:
        out = added(pre.transform(df).withColumn("__margin", F.lit(0.0)), trees)
        return out.withColumn("score", 1 / (1 + F.exp(-F.col("__margin")))).select(*df.columns, "score")

    score.trees = trees
    return score


def fit_bagged(train: DataFrame, spec: ModelSpec) -> Scorer:
    """Mean score of boosted models, each fitted on a cluster bootstrap of the groups."""
    p = dict(spec.params)
    n, base = p.pop("n_models", 3), spec.but(kind=p.pop("base", "boosted"), params=p)
    models = []
    for i in range(n):
        pre = preprocessor(base).fit(train)
        sample = cluster_resample(train, spec.group, 42 + i, "__times")
        data = with_weight(pre.transform(sample), base).withColumn(
            "__weight", F.col("__weight") * F.col("__times"))
        models.append((pre, _classifier(base, len(encoded_names(pre, base))).fit(data)))

    def score(df: DataFrame) -> DataFrame:
        out, names = df, []
        for i, (pre, m) in enumerate(models):
            t = m.transform(pre.transform(out))
            names.append(f"__s{i}")
            out = t.withColumn(f"__s{i}", _probability(t)).select(*df.columns, *names)
        mean = sum((F.col(c) for c in names), F.lit(0.0)) / len(names)
        return out.withColumn("score", mean).select(*df.columns, "score")

    return score


def fit_knn(train: DataFrame, spec: ModelSpec) -> Scorer:
    """Exact k nearest neighbours (uniform or distance vote) through the pivot join."""
    from kinfold.operators.neighbours import knn_join, knn_vote

    p = {"k": 5, "weights": "uniform", "metric": "l2", **spec.params}
    pre = preprocessor(spec.but(scale=True)).fit(train)
    vec = lambda d: pre.transform(d).withColumn("__v", vector_to_array("features"))
    ref = vec(train).select(F.col(spec.row_id).alias("ref_id"), "__v", F.col(spec.label).alias("ref_label"))

    def score(df: DataFrame) -> DataFrame:
        q = vec(df).select(spec.row_id, "__v")
        near = knn_join(q, ref, spec.row_id, "__v", p["k"], p["metric"])
        return df.join(knn_vote(near, spec.row_id, p["weights"]), spec.row_id, "left")

    return score


# ---- importance and conditions ----------------------------------------------------------

def tree_importance(fitted: Fitted, df: DataFrame) -> DataFrame:
    """(feature, parent, importance) of a fitted tree model; one row per vector slot."""
    names = encoded_names(fitted.pre, fitted.spec)
    values = fitted.model.featureImportances.toArray()
    rows = [(n, n.split("=")[0], float(v)) for n, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, parent string, importance double")


def parent_importance(imp: DataFrame, value: str = "importance") -> DataFrame:
    return imp.groupBy("parent").agg(F.sum(value).alias(value))


def four_conditions(
    df: DataFrame, spec: ModelSpec, random_test: str, group_test: str, n_extra: int
) -> DataFrame:
    """Predictions of one tuned spec under random / group split x plain / augmented training."""
    from kinfold.operators.resampling import bootstrap_augment

    out = None
    for strategy, flag in (("random", random_test), ("group", group_test)):
        train, test = df.where(~F.col(flag)), df.where(F.col(flag))
        for augmented in (False, True):
            data = bootstrap_augment(train, [spec.row_id], n_extra).drop("is_extra") if augmented else train
            part = fit(data, spec)(test).select(
                spec.row_id, spec.group, F.col(spec.label).cast("double").alias("y_true"),
                F.col("score").alias("y_pred"), F.lit(strategy).alias("strategy"),
                F.lit(augmented).alias("augmented"),
            )
            out = part if out is None else out.unionByName(part)
    return out
