"""Learners and protocols: invariants on a small separable table."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import benchmark as bench
from kinfold.operators import metrics, models
from kinfold.operators.models import ModelSpec


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        y = rng.randint(0, 1)
        x = rng.gauss(2.0 * y, 1.0)
        rows.append((i, f"g{i % 8}", y, None if i % 13 == 0 else x, rng.random(), "a" if (y + i % 3) % 2 else "b"))
    return spark.createDataFrame(rows, "row_id long, group_id string, y int, x double, z double, c string").cache()


SPEC = ModelSpec("tree", ("x", "z"), ("c",), params={"maxDepth": 3})


@pytest.mark.parametrize("kind,params", [
    ("tree", {"maxDepth": 3}), ("svm", {"n_features": 16, "maxIter": 8}), ("focal", {"rounds": 2}),
    ("knn", {"k": 7}), ("bagged", {"n_models": 2, "base": "tree", "maxDepth": 3}),
])
def test_scores_separate(data, kind, params):
    out = models.fit(data, SPEC.but(kind=kind, params=params))(data)
    r = out.agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] == 240 and r["lo"] >= 0 and r["hi"] <= 1
    assert metrics.ranking_metrics(out, "y", "score").first()["roc_auc"] > 0.75


def test_oof_scores_each_row_once(data):
    oof = bench.grouped_oof(data, SPEC, 3)
    assert oof.count() == 240 and oof.select("row_id").distinct().count() == 240


def test_encoded_names(data):
    pre = models.preprocessor(SPEC).fit(data)
    assert models.encoded_names(pre, SPEC) == ["x", "z", "c=a", "c=b"]
    from pyspark.ml.functions import vector_to_array

    width = pre.transform(data).select(F.size(vector_to_array("features"))).first()[0]
    assert width == 4


def test_search_and_draws(data):
    assert len(bench.sample_grid({"a": [1, 2], "b": [1, 2, 3]}, 4)) == 4
    h = bench.grouped_search(data, SPEC, [{"maxDepth": 1}, {"maxDepth": 3}], 2).collect()
    assert {r["candidate"] for r in h} == {0, 1} and h[0]["roc_auc"] >= h[1]["roc_auc"]
