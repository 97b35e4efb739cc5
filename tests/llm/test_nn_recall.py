"""Recall of the graph search where its parts matter: more rows than a leaf, small leaves, outliers, norms of all sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import nn_descent


def recall(spark, vectors, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0, **options).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    scores = vectors[::20] @ vectors.T
    hits = 0
    for place, q in enumerate(range(0, len(vectors), 20)):
        scores[place, q] = -np.inf
        best = set(np.argsort(-scores[place], kind="stable")[:20].tolist())
        hits += len(best & found.get(q, set()))
    return hits / (20 * len(scores))


def unit(rng, n, d=32):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("outliers", [0, 1, 40])
def test_outliers_of_large_norm(spark, outliers):
    v = unit(np.random.default_rng(3), 4000)
    v[7:7 + outliers] *= 300
    assert recall(spark, v) > 0.9


def test_small_leaves_leave_the_work_to_the_rounds(spark):
    assert recall(spark, unit(np.random.default_rng(4), 2500, 24), leaf=64) > 0.9


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    assert recall(spark, unit(rng, 2500, 24) * np.exp(rng.normal(size=(2500, 1))), leaf=256, giants=64) > 0.9
