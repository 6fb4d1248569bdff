"""Values that a DOUBLE would blur, repeated keys, missing truths and records of mixed types."""

import json

import pytest
from pyspark.sql import functions as F

from flowmill.operators.evaluation import roc_auc, threshold_metrics
from flowmill.operators.refinement import alignment_report
from flowmill.operators.splits import split_stratified
from flowmill.operators.statistics import paired_signed_rank
from flowmill.sources.flows import infer_types
from flowmill.sources.metrics import read_run_metrics


def test_wide_integers_keep_their_digits(spark):
    rows = [("1234567890123456789", "99999999999999999999", "1"), ("1234567890123456788", "2", "1.5")]
    got = infer_types(spark.createDataFrame(rows, "a string, b string, c string"))
    assert [t for _, t in got.dtypes] == ["bigint", "string", "double"]
    assert {r.a for r in got.collect()} == {1234567890123456789, 1234567890123456788}


def test_stratified_split_with_large_keys(spark):
    rows = spark.range(100).select((F.col("id") + 2**60).alias("id"), F.lit(1).alias("y"))
    got = split_stratified(rows, "y", 0.15, F.lit(0), "id").where("split = 'val'")
    assert sorted(r.id - 2**60 for r in got.collect()) == list(range(15))


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.5), (2, 1, 0.5)], "row_id long, y_true int, y_prob double")
    with pytest.raises(ValueError, match="repeats the key 1"):
        alignment_report(rows, rows, strict=True)
    assert tuple(alignment_report(rows, rows).first()) == (2, 0, 0, 0, 1)


def test_missing_truths_count_nowhere(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (1, None)], "y_true int, y_prob double")
    assert roc_auc(rows).first().auc == 1.0
    assert threshold_metrics(rows).first().auc == 1.0


def test_exact_table_size_is_not_cut_silently(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0)], "g string, value_a double, value_b double")
    with pytest.raises(ValueError, match="25 pairs"):
        paired_signed_rank(rows, ["g"], exact_max=26)


def test_records_of_mixed_types_survive(spark, tmp_path):
    for name, text in (("a", json.dumps({"seed": "2", "accuracy": 0.5})), ("b", json.dumps({"seed": 3, "accuracy": "x"})), ("c", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(text)
    got = {r.family: (r.seed, r.accuracy) for r in read_run_metrics(spark, f"file://{tmp_path}", schema="seed int, accuracy double").collect()}
    assert got == {"a": (2, 0.5), "b": (3, None)}
