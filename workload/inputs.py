"""Round-trip queries of the readers and writers: the view is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.session import scratch_path
from flowmill.sources import flows as flow_files
from flowmill.sources import metrics as records
from flowmill.sources import predictions as prediction_files
from workload.fixtures import FLOWS_CTE, PREDS_CTE, RUNS_CTE, flows, preds, r6, runs, table
from workload.registry import registry

QUERIES, ORACLES, query = registry()

_CSV_COLUMNS = ["id", "srcip", "attack_cat", "label", "value", "value_bucket", "k", "value_txt"]


@query(
    "source_csv_custom",
    f"""WITH {FLOWS_CTE} SELECT id, CAST(srcip AS BIGINT) AS srcip, attack_cat, label, value, value_bucket, CAST(k AS BIGINT) AS k, CAST(value_txt AS DOUBLE) AS value_txt
    FROM flows WHERE value IS NOT NULL AND value_txt NOT IN ('n/a','Infinity')""",
)
def source_csv_custom(spark, sf):
    path = scratch_path(spark, "csv")
    flows(spark, sf).select(*_CSV_COLUMNS).write.option("header", True).csv(path)
    return flow_files.read_custom(spark, path)


def _nsl_rows(spark, sf, service: str):
    """Event rows laid out in the 43 headerless columns; the 36 rate columns share k."""
    rows = flows(spark, sf)
    texts = {"protocol_type": F.col("attack_cat"), "service": F.lit(service), "flag": F.col("srcip"), "label": F.col("label")}
    first = {"duration": F.col("value"), "difficulty": F.col("k"), "src_bytes": F.col("id")}
    schema = flow_files.nsl_schema()
    return rows.select(
        *[
            texts.get(f.name, first.get(f.name, F.col("k"))).alias(f.name) for f in schema.fields
        ]
    )


@query(
    "source_csv_fixed_schema",
    f"""WITH {FLOWS_CTE} SELECT part, id AS src_bytes, value AS duration, attack_cat AS protocol_type, part || '_svc' AS service, srcip AS flag, label, k AS difficulty, CAST(k*36 AS DOUBLE) AS rate_sum
    FROM flows, (SELECT unnest(['train','test']) AS part) WHERE value IS NOT NULL""",
)
def source_csv_fixed_schema(spark, sf):
    paths = {}
    for part in ("train", "test"):
        paths[part] = scratch_path(spark, "fixed")
        _nsl_rows(spark, sf, f"{part}_svc").write.csv(paths[part])
    read = flow_files.read_fixed_schema(spark, paths["train"], paths["test"])
    named = {"duration", "src_bytes", "difficulty", "protocol_type", "service", "flag", "label"}
    rates = [f.name for f in flow_files.nsl_schema().fields if f.name not in named]
    total = sum((F.col(c) for c in rates), F.lit(0.0))
    return read.select(
        "part", F.col("src_bytes").cast("bigint").alias("src_bytes"), "duration", "protocol_type", "service", "flag",
        "label", "difficulty", total.alias("rate_sum"),
    )


@query(
    "source_train_test_pair",
    f"""WITH {FLOWS_CTE} SELECT CASE WHEN attack_cat='purchase' THEN 'test' ELSE 'train' END AS part, id, label, value, k FROM flows WHERE value IS NOT NULL""",
)
def source_train_test_pair(spark, sf):
    rows = flows(spark, sf).select("id", "label", "value", "k", "attack_cat")
    train, test = scratch_path(spark, "train"), scratch_path(spark, "test")
    rows.where("attack_cat <> 'purchase'").drop("attack_cat").write.option("header", True).csv(train)
    rows.where("attack_cat = 'purchase'").drop("attack_cat").write.option("header", True).csv(test)
    read = flow_files.read_train_test(spark, train, test, "id BIGINT, label STRING, value DOUBLE, k INT")
    return read.select("part", "id", "label", "value", "k")


_DAYS = {"view": "Friday", "click": "Monday", "purchase": "Thursday", "error": "Tuesday", "signup": "Wednesday"}
_DAY_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DAYS.items())


@query(
    "source_multi_file",
    f"""WITH {FLOWS_CTE}, d AS (SELECT id, value, k, CASE attack_cat {_DAY_SQL} ELSE 'Extra' END AS day FROM flows WHERE value IS NOT NULL)
    SELECT id, value, k, row_number() OVER (ORDER BY day, id) - 1 AS row_idx FROM d""",
)
def source_multi_file(spark, sf):
    """One folder of files per day, read in alphabetical order with record order restored."""
    rows = flows(spark, sf).selectExpr(
        "id", "value", "k", f"CASE attack_cat {_DAY_SQL} ELSE 'Extra' END AS day"
    )
    base = scratch_path(spark, "days")
    days = [*_DAYS.values(), "Extra"]
    for day in days:
        rows.where(F.col("day") == day).drop("day").orderBy("id").write.option("header", True).csv(f"{base}/{day}")
    files = spark.read.text([f"{base}/{day}" for day in days]).inputFiles()
    read = flow_files.read_multi_file(spark, files, "id BIGINT, value DOUBLE, k INT")
    return flow_files.number_records(read).df.select("id", "value", "k", "row_idx")


@query(
    "source_multi_file_per_file",
    f"""WITH {FLOWS_CTE}, d AS (SELECT id, value, k, CASE attack_cat {_DAY_SQL} ELSE 'Extra' END AS day FROM flows WHERE value IS NOT NULL)
    SELECT id, value, k, CASE WHEN day IN ('Wednesday', 'Extra') THEN 'caf' || chr(233) || ' ' || CAST(id AS VARCHAR) END AS note, row_number() OVER (ORDER BY day, id) - 1 AS row_idx FROM d""",
)
def source_multi_file_per_file(spark, sf):
    """Day files with three headers, one of them in Latin-1, each cleaned on its own columns."""
    rows = flows(spark, sf).selectExpr(
        "id", "value", "k", f"CASE attack_cat {_DAY_SQL} ELSE 'Extra' END AS day", "concat('café ', CAST(id AS STRING)) AS note"
    )
    headers = {"Thursday": ["k", "id", "value"], "Tuesday": ["k", "id", "value"], "Wednesday": ["note", "id", "value", "k"], "Extra": ["note", "id", "value", "k"]}
    base = scratch_path(spark, "days")
    days = [*_DAYS.values(), "Extra"]
    for day in days:
        part = rows.where(F.col("day") == day).orderBy("id").select(*headers.get(day, ["id", "value", "k"]))
        part.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/{day}")
    files = spark.read.text([f"{base}/{day}" for day in days]).inputFiles()
    read = flow_files.read_multi_file(spark, files, per_file_clean=True)
    return flow_files.number_records(read).df.select("id", "value", F.col("k").cast("int").alias("k"), "note", "row_idx")


@query(
    "source_run_metrics",
    f"""WITH {RUNS_CTE} SELECT f AS family, dataset, model, seed, accuracy, f1_macro, auc FROM runs, (SELECT unnest(['main','window']) AS f)""",
)
def source_run_metrics(spark, sf):
    root = scratch_path(spark, "records")
    for family in ("main", "window"):
        runs(spark, sf).write.json(f"{root}/{family}/batch")
    read = records.read_run_metrics(spark, root, "*.json", multi_line=False)
    return read.select("family", "dataset", "model", "seed", "accuracy", "f1_macro", "auc")


@query(
    "source_json_flatten",
    """SELECT event_id AS id, CAST(json_extract(props,'$.k') AS INT) AS inference_batch_1_k, event_type AS inference_batch_1_device,
    CAST(event_id*2 AS BIGINT) AS inference_macs FROM events""",
)
def source_json_flatten(spark, sf):
    documents = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(
            F.lit('{"inference":{"batch_1":{"k":'), F.get_json_object("props", "$.k"),
            F.lit(',"device":"'), F.col("event_type"), F.lit('"},"macs":'), F.col("event_id") * 2, F.lit("}}"),
        ).alias("document"),
    )
    parsed = documents.select(
        "id",
        F.from_json(
            "document", "inference STRUCT<batch_1: STRUCT<k: INT, device: STRING>, macs: BIGINT>"
        ).alias("record"),
    ).select("id", "record.inference")
    return records.flatten_struct(parsed, "inference")


@query("source_efficiency", ORACLES["source_json_flatten"])
def source_efficiency(spark, sf):
    """Records written as files, nested and flat ones and broken lines, read back by their reader."""
    root = scratch_path(spark, "efficiency")
    events = table(spark, sf, "events")
    document = F.concat(
        F.lit('{"id":'), "event_id", F.lit(',"inference":{"batch_1":{"k":'), F.get_json_object("props", "$.k"),
        F.lit(',"device":"'), "event_type", F.lit('"},"macs":'), F.col("event_id") * 2, F.lit("}}"),
    )
    broken = F.lit('{"id": 1, "inference"')
    lines = events.select(F.explode(F.when(F.col("event_id") % 10 == 0, F.array(document, broken)).otherwise(F.array(document))).alias("value"))
    lines.write.text(f"{root}/main/batch")
    schema = "id BIGINT, inference STRUCT<batch_1: STRUCT<k: INT, device: STRING>, macs: BIGINT>"
    read = records.read_efficiency(spark, root, "*.txt", schema, multi_line=False)
    return read.select("id", "inference_batch_1_k", "inference_batch_1_device", "inference_macs")


@query(
    "source_efficiency_files",
    """SELECT user_id AS id, CASE WHEN user_id % 7 <> 3 THEN CAST(count(*) AS BIGINT) END AS parameters, CAST(sum(event_id) AS BIGINT) AS inference_macs, CAST(user_id % 5 AS BIGINT) AS inference_batch_1_k,
    min(event_type) AS inference_batch_1_device, CAST(CASE WHEN user_id % 5 <> 2 THEN max(event_id) END AS BIGINT) AS inference_batch_default_rows FROM events GROUP BY user_id""",
)
def source_efficiency_files(spark, sf):
    """One multi-line file per run, some with an odd field, some broken; fields found from the files."""
    root = scratch_path(spark, "efficiency")
    runs_ = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("macs"), F.min("event_type").alias("device"), F.max("event_id").alias("most")
    )
    odd = F.when(F.col("user_id") % 7 == 3, F.lit('"n/a"')).otherwise(F.col("n").cast("string"))
    rows = F.when(F.col("user_id") % 5 == 2, F.lit("NaN")).otherwise(F.col("most").cast("string"))
    text = F.concat(
        F.lit('{\n  "id": '), "user_id", F.lit(',\n  "parameters": '), odd, F.lit(',\n  "inference": {\n    "batch_1": {"k": '), F.col("user_id") % 5,
        F.lit(', "device": "'), "device", F.lit('"},\n    "batch_default": {"rows": '), rows, F.lit('},\n    "macs": '), "macs", F.lit("\n  }\n}"),
    )
    files = runs_.select(F.concat(F.lit("run"), "user_id").alias("run"), text.alias("value"))
    broken = runs_.where("user_id % 10 = 0").select(F.concat(F.lit("broken"), "user_id").alias("run"), F.substring(text, 1, 40).alias("value"))
    files.unionByName(broken).repartition("run").write.partitionBy("run").text(f"{root}/main")
    read = records.read_efficiency(spark, root, "*.txt")
    names = ["inference_macs", "inference_batch_1_k", "inference_batch_1_device", "inference_batch_default_rows"]
    return read.select("id", F.col("parameters").try_cast("bigint").alias("parameters"), *names)


def _prediction_rows(spark, sf):
    return preds(spark, sf).selectExpr("row_id", "y_true", "p_a AS y_prob", "CAST(p_a >= 0.5D AS INT) AS y_pred")


_PREDICTIONS = f"WITH {PREDS_CTE} SELECT row_id, y_true, p_a AS y_prob, CAST(p_a >= 0.5 AS INT) AS y_pred FROM preds"


@query("sink_predictions", _PREDICTIONS)
def sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    prediction_files.write_predictions(_prediction_rows(spark, sf), path)
    return prediction_files.read_predictions(spark, path)


@query("sink_predictions_parquet", _PREDICTIONS)
def sink_predictions_parquet(spark, sf):
    path = scratch_path(spark, "predictions")
    prediction_files.write_predictions(_prediction_rows(spark, sf), path, "parquet")
    return prediction_files.read_predictions(spark, path, fmt="parquet")


@query(
    "sink_summary_tables",
    f"""WITH {RUNS_CTE} SELECT f AS format, dataset, model, count(*) AS n_runs, round(avg(accuracy),6) AS accuracy_mean FROM runs, (SELECT unnest(['parquet','csv','json']) AS f) GROUP BY ALL""",
)
def sink_summary_tables(spark, sf):
    summary = runs(spark, sf).groupBy("dataset", "model").agg(
        F.count(F.lit(1)).alias("n_runs"), r6(F.avg("accuracy")).alias("accuracy_mean")
    )
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"summary-{fmt}")
        records.write_table(summary, path, fmt)
        part = spark.read.format(fmt).schema(summary.schema).option("header", True).load(path)
        part = part.select(F.lit(fmt).alias("format"), "dataset", "model", "n_runs", "accuracy_mean")
        out = part if out is None else out.unionByName(part)
    return out


# Names n0..n6 exercise every rule: layouts by preference, one loose match, side results, none.
_PATHS = """CASE l_linenumber WHEN 1 THEN CASE l_suppkey % 2 WHEN 0 THEN 'n1_fixed/metrics.json' ELSE 'baselines/n1/metrics.json' END
 WHEN 2 THEN 'ablations/n2_fixed/metrics.json' WHEN 3 THEN 'extra/run_n3_v2/metrics.json'
 WHEN 4 THEN CASE l_suppkey % 2 WHEN 0 THEN 'x/n4_final/metrics.json' ELSE 'tmp/n4_final/metrics.json' END
 WHEN 5 THEN CASE l_suppkey % 2 WHEN 0 THEN 'x/n5_a/metrics.json' ELSE 'x/n5_b/metrics.json' END
 WHEN 6 THEN 'n6/other.json' ELSE 'n7/metrics.json' END"""
_WANTED = [f"n{i}" for i in range(1, 8)]


@query(
    "source_best_metrics_path",
    f"""WITH l AS (SELECT DISTINCT l_returnflag AS base, {_PATHS} AS path FROM lineitem), w AS (SELECT DISTINCT base, n.name FROM l, (SELECT unnest(['n1','n2','n3','n4','n5','n6','n7']) AS name) n),
    c AS (SELECT base, name, row_number() OVER () AS x, unnest([name||'/metrics.json', name||'_fixed/metrics.json', 'baselines/'||name||'/metrics.json', 'baseline/'||name||'/metrics.json',
      'ablation/'||name||'/metrics.json','ablations/'||name||'/metrics.json','ablation/'||name||'_fixed/metrics.json','ablations/'||name||'_fixed/metrics.json']) AS path, unnest([0,1,2,3,4,5,6,7]) AS pr FROM w),
    d AS (SELECT c.base, c.name, arg_min(c.path, c.pr) AS path FROM c JOIN l ON l.base=c.base AND l.path=c.path GROUP BY ALL),
    f AS (SELECT w.base, w.name, count(*) AS m, min(path) AS any_path, count(*) FILTER (lower(concat(l.base,'/',path)) NOT LIKE '%dr%' AND lower(path) NOT LIKE '%decision%' AND lower(path) NOT LIKE '%tmp%') AS plain,
      min(path) FILTER (lower(concat(l.base,'/',path)) NOT LIKE '%dr%' AND lower(path) NOT LIKE '%decision%' AND lower(path) NOT LIKE '%tmp%') AS plain_path
      FROM w JOIN l ON l.base=w.base AND path LIKE '%/metrics.json' AND contains(list_extract(string_split(path,'/'),-2), w.name) GROUP BY ALL)
    SELECT w.base, w.name, coalesce(d.path, CASE WHEN m=1 THEN any_path END, CASE WHEN plain=1 THEN plain_path END) AS path,
    CASE WHEN d.path IS NOT NULL OR m=1 OR plain=1 THEN 'found' WHEN m>1 THEN 'ambiguous' ELSE 'missing' END AS status
    FROM w LEFT JOIN d ON d.base=w.base AND d.name=w.name LEFT JOIN f ON f.base=w.base AND f.name=w.name""",
)
def source_best_metrics_path(spark, sf):
    listing = table(spark, sf, "lineitem").selectExpr("l_returnflag AS base", f"{_PATHS} AS path").distinct()
    wanted = listing.select("base").distinct().select("base", F.explode(F.lit(_WANTED)).alias("name"))
    return records.resolve_records(listing, wanted)
