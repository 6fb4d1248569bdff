"""Boosted trees grown in one stage against MLlib's learner and by hand."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowmill.operators import boosting, models

SETTINGS = dict(depth=3, step=0.3, row_share=1.0, column_share=1.0)


@pytest.fixture(scope="module")
def windows(spark):
    def row(i):
        a, b, c = i * 7 % 9, i * 11 % 30, i % 2
        return ("train" if i % 5 else "test", i, int((a * b + 7 * c + i * 31 % 40) % 50 > 20), [float(a), b / 3, float(c), 4.0])

    rows = [row(i) for i in range(1500)]
    return models.to_vectors(spark.createDataFrame(rows, "split string, end_idx long, y int, flat array<double>").repartition(3))


def probabilities(model, windows):
    scored = model.transform(windows).select("end_idx", F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "prediction")
    return {r.end_idx: (r.p, r.prediction) for r in scored.collect()}


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_tree_costs_no_job(spark, windows):
    few = jobs(spark, "few", lambda: models.train_gbt(windows, trees=2, **SETTINGS))
    many = jobs(spark, "many", lambda: models.train_gbt(windows, trees=25, **SETTINGS))
    assert 0 < few == many


@pytest.mark.parametrize("tasks, shared", [(1, True), (3, True), (3, False), (8, True)])
def test_same_trees_as_mllib(windows, monkeypatch, tasks, shared):
    trees = 6 if shared else 2  # allGather takes a second a call
    monkeypatch.setattr(boosting, "_tasks", lambda spark, n: tasks)
    monkeypatch.setattr(boosting, "_PIECE", 1000 if tasks == 8 else 64)  # six pieces: some tasks have no row
    if not shared:
        monkeypatch.setattr(boosting, "local_folder", lambda spark, path: None)
    model = models.train_gbt(windows, trees=trees, **SETTINGS)
    old = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.3, seed=0).fit(windows)
    assert [t.toDebugString.split("\n")[1:] for t in old.trees][0][0] == [t.toDebugString.split("\n")[1:] for t in model.trees][0][0]
    want, got = probabilities(old, windows), probabilities(model, windows)
    assert want.keys() == got.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-12), want[k][1]) for k in want)
    assert (model.getNumTrees, model.totalNumNodes, model.treeWeights) == (old.getNumTrees, old.totalNumNodes, old.treeWeights)
    assert model.featureImportances.toArray() == pytest.approx(old.featureImportances.toArray(), abs=1e-9)


def test_shares_of_rows_and_columns(windows):
    model = models.train_gbt(windows, trees=12, depth=4, step=0.3, row_share=0.5, column_share=0.5)
    n = windows.count()
    roots = [t._call_java("rootNode") for t in model.trees]
    rows = [r.impurityStats().count() for r in roots]
    assert all(0.4 * n < x < 0.6 * n for x in rows) and len(set(rows)) > 1
    assert len({r.split().featureIndex() for r in roots}) > 1
    again = models.train_gbt(windows, trees=12, depth=4, step=0.3, row_share=0.5, column_share=0.5)
    assert probabilities(model, windows) == probabilities(again, windows)


def test_constant_features_and_one_class(spark):
    rows = spark.createDataFrame([(1.0, [2.0, 3.0])] * 50, "y double, flat array<double>")
    model = models.train_gbt(models.to_vectors(rows.withColumn("end_idx", F.monotonically_increasing_id())), trees=3, **SETTINGS)
    assert (model.getNumTrees, model.totalNumNodes) == (3, 3)
    first = model.trees[0]._call_java("rootNode").prediction()
    second = model.trees[1]._call_java("rootNode").prediction()
    assert first == 1.0 and second == pytest.approx(4 / (1 + math.exp(2.0)), abs=1e-12)


@pytest.mark.parametrize("label, value", [(2, 1.0), (None, 1.0), (1, float("nan")), (1, float("inf"))])
def test_labels_and_values_that_are_none(spark, label, value):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (label, [value])], "y int, flat array<double>")
    with pytest.raises(Exception, match="labels must be|features must not be"):
        models.train_gbt(models.to_vectors(rows), trees=1, **SETTINGS)


def test_no_row_is_an_error(windows):
    with pytest.raises(ValueError, match="no row"):
        models.train_gbt(windows.where("split = 'none'"), trees=1, **SETTINGS)


def test_cuts_of_all_rows(spark, monkeypatch):
    """Many values are cut into equal numbers of rows, by several merged summaries; few values one by one."""
    monkeypatch.setattr(boosting, "_SUMMARY_ROWS", 2000)
    n = 40_000
    rows = spark.range(n, numPartitions=3).select(
        F.lit(1.0).alias("y"),
        F.array(
            (F.col("id") * 7919 % n).cast("double"),
            F.pow(F.col("id") * 104729 % n, F.lit(3)).cast("double"),
            F.when(F.col("id") == 17, 5.0).otherwise(F.col("id") % 3),  # one row of its own value
        ).alias("x"),
    )
    found, cuts = boosting.find_cuts(rows, 32)
    assert found == n and [len(c) for c in cuts] == [31, 31, 3]
    for c, true in ((cuts[0], np.arange(1, 32) * n / 32), (np.cbrt(cuts[1]), np.arange(1, 32) * n / 32)):
        assert np.abs(c - true).max() < n * 0.006
    assert cuts[2].tolist() == [0.5, 1.5, 3.5]
    assert boosting.thresholds(np.array([1.0, 2.0, 4.0, 8.0]), np.array([1, 1, 1, 97]), 2).tolist() == [6.0]
    assert boosting.thresholds(np.array([1.0, 2.0, 4.0, 8.0]), np.array([97, 1, 1, 1]), 2).tolist() == [1.5]
