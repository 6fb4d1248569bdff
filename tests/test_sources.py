import json
import os

import pytest
from pyspark.sql import functions as F

from flowmill.operators.ordering import row_index
from flowmill.sources import flows, metrics, predictions


def test_custom_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_text(" a ,b,c\n1,1.5,u\n2,NA,v\n3,inf,w\n4,2.5,\n5,3.5,z\n")
    df = flows.read_custom(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert sorted(r.a for r in df.collect()) == [1, 5]


def test_multi_file_order_encoding_and_extra_columns(spark, tmp_path):
    (tmp_path / "b.csv").write_text("n,t\n3,x\n4,y\n")
    (tmp_path / "a.csv").write_bytes("n,t\n1,caf\xe9\n2,z\n".encode("latin-1"))
    paths = [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]
    df = flows.read_multi_file(spark, paths, None)
    rows = sorted(row_index(df, flows.ORDER_COLUMNS).df.collect(), key=lambda r: r.row_idx)
    assert [r.n for r in rows] == [1, 2, 3, 4] and rows[0].t == "café"
    (tmp_path / "c.csv").write_text("n,t,u\n5,x,9\n")
    paths.append(str(tmp_path / "c.csv"))
    # cleaning after the union drops files that lack the extra column; per-file cleaning keeps them
    assert flows.read_multi_file(spark, paths).count() == 1
    assert flows.read_multi_file(spark, paths, per_file_clean=True).count() == 5


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,u,7\n2,v,8\n")
    (tmp_path / "b.csv").write_text("y,x\nw,3\nq,oops\nr,inf\n,5\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    want = [("q", None), ("u", 1.0), ("v", 2.0), ("w", 3.0)]
    for df in (
        flows.read_multi_file(spark, paths, "y STRING, x DOUBLE"),
        flows.read_multi_file(spark, paths, "y STRING, x DOUBLE", encoding="UTF-8"),
        flows.read_custom(spark, str(tmp_path), "y STRING, x DOUBLE"),
    ):
        assert sorted((r.y, r.x) for r in df.collect()) == want
    pair = flows.read_train_test(spark, *paths, "y STRING, x DOUBLE")
    assert sorted((r.part, r.y, r.x) for r in pair.collect()) == [("test", "q", None), ("test", "w", 3.0), ("train", "u", 1.0), ("train", "v", 2.0)]
    with pytest.raises(ValueError, match="z"):
        flows.read_multi_file(spark, paths, "x DOUBLE, z INT")


def test_record_order_survives_split_files(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.option("header", True).csv(str(tmp_path / "f"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16000")
    try:
        files = spark.read.text(str(tmp_path / "f")).inputFiles()
        df = flows.read_multi_file(spark, files, "id BIGINT", encoding="UTF-8")
        assert df.rdd.getNumPartitions() > 1
        ix = row_index(df, flows.ORDER_COLUMNS)
        assert ix.rows == 20_000 and ix.df.where("id <> row_idx").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")


def test_many_headers_are_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,u\n2,é\n,w\n")
    (tmp_path / "b.csv").write_bytes("y,x,z\nq\xe9,3,7\nr,4,\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("z,y,x\n\"8,8\",s,5\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("x,y\n")
    read = flows.read_multi_file(spark, [str(tmp_path / f"{f}.csv") for f in "abcde"], per_file_clean=True)
    assert _scans(read) == 1
    got = [(r.x, r.y, r.z) for r in flows.number_records(read).df.orderBy("row_idx").collect()]
    assert got == [(1, "u", None), (2, "é", None), (3, "qé", "7"), (5, "s", "8,8")]
    typed = flows.read_multi_file(spark, [str(tmp_path / f"{f}.csv") for f in "abce"], "y STRING, x DOUBLE")
    assert _scans(typed) == 1 and sorted((r.x, r.y) for r in typed.collect()) == [(1, "u"), (2, "é"), (3, "qé"), (4, "r"), (5, "s")]


def test_records_are_numbered_without_an_exchange_of_rows(spark, tmp_path):
    for i in range(3):
        spark.range(5000 * i, 5000 * i + 5000).selectExpr("id", "IF(id % 7 = 0, NULL, 1) AS v").coalesce(1).write.option("header", True).csv(str(tmp_path / f"f{i}"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        files = spark.read.text([str(tmp_path / f"f{i}") for i in range(3)]).inputFiles()
        read = flows.read_multi_file(spark, files, "id BIGINT, v INT", encoding="UTF-8", same_header=True)
        got = flows.number_records(read)
        kept = [i for i in range(15_000) if i % 7]
        assert got.rows == len(kept)
        assert [r.id for r in got.df.orderBy("row_idx").collect()] == kept
        assert "RangePartitioning" not in got.df._jdf.queryExecution().executedPlan().toString()
        shuffled = flows.number_records(read.repartition(3))
        assert [r.id for r in shuffled.df.orderBy("row_idx").collect()] == kept
        assert flows.number_records(read.where("id < 0")).rows == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fixed_schema_has_43_columns():
    schema = flows.nsl_schema()
    assert len(schema) == 43 and schema.fieldNames()[0] == "duration" and schema.fieldNames()[-2:] == ["label", "difficulty"]


def test_chronological_rank(spark):
    names = ["Friday-Afternoon", "friday-morning", "MONDAY", "other"]
    df = flows.chronological_rank(spark.createDataFrame([(n,) for n in names], "_file string"))
    assert [r._file for r in df.orderBy("day_rank", "half_day", "_file").collect()] == ["MONDAY", "friday-morning", "Friday-Afternoon", "other"]


@pytest.mark.parametrize("rows,valid", [
    ([("0", "0.1"), ("1", "0.9")], True), ([("0", "0.1"), ("0", "0.9")], False),
    ([("0", "0.1"), ("1", "1.9")], False), ([("0", "0.1"), ("1", "oops")], False),
])
def test_prediction_checks(spark, rows, valid):
    df = spark.createDataFrame(rows, "y_true string, y_prob string")
    assert predictions.validate_predictions(df).first().valid is valid
    if not valid:
        with pytest.raises(ValueError):
            predictions.validate_predictions(df, strict=True)


def test_prediction_columns_required(spark):
    with pytest.raises(ValueError):
        predictions.validate_predictions(spark.range(1))


def test_prediction_key_from_place(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(500).selectExpr("CAST(id % 2 AS INT) AS y_true", "id / 500D AS y_prob", "0 AS y_pred", "id")
    predictions.write_predictions(rows.repartitionByRange(4, "id").sortWithinPartitions("id").drop("id"), path)
    got = predictions.read_predictions(spark, path).collect()
    assert {(r.row_id, r.y_prob) for r in got} == {(i, i / 500) for i in range(500)}
    assert predictions.read_predictions(spark, path, key=None).columns == ["y_true", "y_prob", "y_pred"]


def test_run_metrics_skip_unreadable(spark, tmp_path):
    for rel, text in {
        "main/d/mlp/seed_1/metrics.json": json.dumps({"accuracy": 0.5, "seed": 1}, indent=2),
        "hyper/dropout/0p1/seed_2/metrics.json": json.dumps({"accuracy": 0.6, "seed": 2}),
        "main/d/mlp/seed_3/metrics.json": "{not json",
        "main/d/mlp/seed_1/other.json": json.dumps({"accuracy": 0.9}),
    }.items():
        os.makedirs(tmp_path / os.path.dirname(rel), exist_ok=True)
        (tmp_path / rel).write_text(text)
    got = {r.relative_path: r for r in metrics.read_run_metrics(spark, str(tmp_path)).collect()}
    assert set(got) == {"main/d/mlp/seed_1/metrics.json", "hyper/dropout/0p1/seed_2/metrics.json"}
    assert got["hyper/dropout/0p1/seed_2/metrics.json"].family == "hyper"


def test_efficiency_keeps_records_with_odd_fields(spark, tmp_path):
    texts = {
        "a": {"macs": "n/a", "params": 3, "inference": {"batch_1": {"ms": 1.5}, "dev": "cpu"}}, "b": {"macs": 7, "inference": {"batch_1": {"ms": 2}}},
        "c": {"inference": "none", "it's": 1}, "d": [1], "e": 5,
    }
    for name, value in texts.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "efficiency.json").write_text(json.dumps(value, indent=1))
    os.makedirs(tmp_path / "f")
    (tmp_path / "f" / "efficiency.json").write_text('{"macs": NaN, "params": -Infinity, "note": "x: NaN"}')
    os.makedirs(tmp_path / "g")
    (tmp_path / "g" / "efficiency.json").write_text('{"macs": 1')
    schema = "macs BIGINT, params INT, inference STRUCT<batch_1: STRUCT<ms: DOUBLE>, dev: STRING>"
    got = {r.family: r for r in metrics.read_efficiency(spark, str(tmp_path), schema=schema).collect()}
    assert sorted(got) == ["a", "b", "c", "f"]
    assert [tuple(got[k])[:4] for k in "abcf"] == [(None, 3, 1.5, "cpu"), (7, None, 2.0, None), (None, None, None, None), (None, None, None, None)]
    free = metrics.read_efficiency(spark, str(tmp_path))
    assert {"macs", "params", "it's", "inference"} <= set(free.columns)
    assert {r.family: r.macs for r in free.collect()} == {"a": "n/a", "b": "7", "c": None, "f": None}


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b1', named_struct('ms', 2.0), 'macs', 3) AS inference")
    assert metrics.flatten_struct(df, "inference").columns == ["a", "inference_b1_ms", "inference_macs"]


def test_resolve_records(spark):
    listing = spark.createDataFrame(
        [("r", "cnn/metrics.json"), ("r", "cnn_fixed/metrics.json"), ("r", "x/gru_final/metrics.json"),
         ("r", "x/lstm_a/metrics.json"), ("r", "tmp/lstm_b/metrics.json"), ("r", "x/mlp1/metrics.json"), ("r", "x/mlp2/metrics.json")],
        "base string, path string",
    )
    names = ["cnn", "gru", "lstm", "mlp", "tcn"]
    wanted = spark.createDataFrame([("r", n) for n in names], "base string, name string")
    got = {r.name: (r.path, r.status) for r in metrics.resolve_records(listing, wanted).collect()}
    assert got == {
        "cnn": ("cnn/metrics.json", "found"), "gru": ("x/gru_final/metrics.json", "found"),
        "lstm": ("x/lstm_a/metrics.json", "found"), "mlp": (None, "ambiguous"), "tcn": (None, "missing"),
    }


def test_write_table_formats(spark, tmp_path):
    df = spark.range(3).withColumn("v", F.col("id") * 0.5)
    for fmt in ("parquet", "csv", "json"):
        metrics.write_table(df, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).schema(df.schema).option("header", True).load(str(tmp_path / fmt))
        assert sorted(back.collect()) == sorted(df.collect())
