"""Flow-record, prediction, run and history views over the test tables.

The view texts are valid in Spark SQL and in DuckDB, so a query and its SQL counterpart
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.operators.ordering import row_index
from flowmill.operators.splits import split_sequential

VAL_RATIO = 0.15
SEQ_LEN = 16

FLOWS = """
SELECT event_id AS id, ts, CAST(user_id AS {TEXT}) AS srcip, event_type AS attack_cat,
 CASE WHEN event_type='error' THEN 'attack' ELSE 'normal' END AS label,
 CAST(CASE WHEN event_type='error' THEN 1 ELSE 0 END AS INT) AS y,
 CASE WHEN event_id % 50 = 7 THEN NULL ELSE value END AS value,
 CAST(floor(value/10) AS BIGINT) AS value_bucket,
 CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k,
 CASE WHEN event_id % 97 = 3 THEN 'Infinity' WHEN event_id % 89 = 5 THEN 'n/a'
      ELSE CAST(CAST(floor(value) AS BIGINT) AS {TEXT}) END AS value_txt
FROM events
"""

PREDS = """
SELECT event_id AS row_id, CASE WHEN event_id % 10 < 5 THEN 'val' ELSE 'test' END AS split,
 CAST(CASE WHEN event_type='error' THEN 1 ELSE 0 END AS INT) AS y_true,
 CAST((event_id*7919) % 1000 AS DOUBLE)/1000 AS p_a,
 least(CAST(1 AS DOUBLE), CAST((event_id*104729) % 997 AS DOUBLE)/997*CAST(7 AS DOUBLE)/10
   + CASE WHEN event_type='error' THEN CAST(3 AS DOUBLE)/10 ELSE CAST(0 AS DOUBLE) END) AS p_b
FROM events
"""

RUNS = """
SELECT l_returnflag AS dataset, concat('m', CAST(l_suppkey % 4 AS {TEXT})) AS model, l_linenumber AS seed,
 round(avg(l_discount)*10,6) AS accuracy, round(avg(l_extendedprice)/100000,6) AS f1_macro, round(avg(l_quantity)/50,6) AS auc
FROM lineitem GROUP BY l_returnflag, l_suppkey % 4, l_linenumber
"""

# The same runs as families. Ablation, leakage and order runs are other models' runs under another
# name; explicit reference settings exist for some seeds only, the rest is to be back-filled.
_FAMILY = """SELECT '{family}' AS family, {dataset} AS dataset, {model} AS model, {variant} AS variant, seed, {seq_len} AS seq_len,
 {protocol} AS leakage_protocol, {order} AS record_order, {path} AS relative_path, accuracy, f1_macro, auc FROM runs WHERE {where}"""
_NONE = dict(
    dataset="dataset", model="model", variant="'full'", seq_len="CAST(NULL AS INT)", protocol="CAST(NULL AS {TEXT})",
    order="CAST(NULL AS {TEXT})", path="CAST(NULL AS {TEXT})", where="TRUE",
)
_HYPER_PATH = "concat('hyper/dropout/', CASE WHEN model = 'm0' THEN '0p1' ELSE '0p3' END, '/seed_', CAST(seed AS {TEXT}), '/metrics.json')"
_FAMILIES = [
    dict(family="main"),
    dict(family="ablation", model="'m0'", where="model <> 'm0'", variant="CASE model WHEN 'm1' THEN 'no_multiscale' WHEN 'm2' THEN 'no_attention' ELSE 'no_focal_loss' END"),
    dict(family="leakage", dataset="'R'", protocol="CASE dataset WHEN 'A' THEN 'attack_cat' WHEN 'N' THEN 'id' ELSE 'clean' END", where="model IN ('m0', 'm3') AND (dataset <> 'R' OR seed <= 3)"),
    dict(family="window", seq_len="CASE WHEN seed <= 3 THEN 16 ELSE 32 END", where="model = 'm0'"),
    dict(family="order_sanity", model="'m0'", order="CASE model WHEN 'm0' THEN 'original' ELSE 'shuffled' END", where="model = 'm1' OR (model = 'm0' AND seed <= 2)"),
    dict(family="hyper", model="'m0'", path=_HYPER_PATH, where="dataset = 'R' AND (model = 'm1' OR (model = 'm0' AND seed <= 2))"),
    dict(family="temporal", where="dataset = 'A' AND model IN ('m0', 'm1')"),
]
FAMILY_RUNS = f"WITH runs AS ({RUNS}) " + " UNION ALL ".join(
    _FAMILY.format(**{**_NONE, **family}) for family in _FAMILIES
)

# Label spellings assigned to the event rows in turn.
LABEL_TEXTS = [
    " BENIGN ", "Benign", "normal.", "normal", "attack", "1", "1.0", "0", " ATTACK", "malicious",
    "Anomaly", "neptune", "smurf.", "satan", "guess_passwd", "rootkit", "mystery",
    "Web Attack - XSS", "SQL Injection", "FTP-Patator", "SSH-Patator", "DoS Hulk", "DDoS",
    "PortScan", "Bot", "Infiltration", "Heartbleed", "", "nan",
]
# File names assigned to the event rows in turn.
FILE_NAMES = [
    "Monday-WorkingHours.csv", "Tuesday-WorkingHours.csv", "Wednesday-workingHours.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.csv", "Thursday-WorkingHours-Afternoon-Infilteration.csv",
    "Friday-WorkingHours-Morning.csv", "Friday-WorkingHours-Afternoon-DDos.csv", "extra-records.csv",
]


def texts_sql(values: list[str], at: str) -> str:
    """CASE expression that picks the text number ``at`` modulo the list; same in both engines."""
    arms = " ".join(
        f"WHEN {at} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)
    )
    return f"CASE {arms} END"


LABELLED = f"SELECT event_id AS id, {texts_sql(LABEL_TEXTS, 'event_id')} AS text FROM events"
FILES = f"SELECT event_id AS id, {texts_sql(FILE_NAMES, 'event_id')} AS file_name FROM events"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, source: str = "events") -> DataFrame:
    text = sql.replace("{TEXT}", "STRING").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf, source))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, FLOWS)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, PREDS)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, RUNS, "lineitem")


def family_runs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, FAMILY_RUNS, "lineitem")


def split_flows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Flow rows in the order of ``id`` with their sequential split and position in it."""
    rows = flows(spark, sf)
    rows = rows.select("id", *[c for c in columns if c != "id"]) if columns else rows
    return split_sequential(row_index(rows, ["id"], unique=True), VAL_RATIO)


def duck(sql: str) -> str:
    return sql.replace("{TEXT}", "VARCHAR")


FLOWS_CTE = f"flows AS ({duck(FLOWS)})"
PREDS_CTE = f"preds AS ({duck(PREDS)})"
RUNS_CTE = f"runs AS ({duck(RUNS)})"
FAMILY_CTE = f"family_runs AS ({duck(FAMILY_RUNS)})"
SPLIT_CTE = f"""{FLOWS_CTE},
numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_idx, count(*) OVER () AS n_rows FROM flows),
cuts AS (SELECT *, CAST(floor(n_rows*(1.0::DOUBLE-2.0::DOUBLE*0.15::DOUBLE)) AS BIGINT) AS n_train,
 CAST(floor(n_rows*0.15::DOUBLE) AS BIGINT) AS n_val FROM numbered),
prep AS (SELECT *, CASE WHEN row_idx < n_train THEN 'train' WHEN row_idx < n_train+n_val THEN 'val' ELSE 'test' END AS split,
 row_idx - CASE WHEN row_idx < n_train THEN 0 WHEN row_idx < n_train+n_val THEN n_train ELSE n_train+n_val END AS split_idx
 FROM cuts)"""


def r6(column) -> F.Column:
    return F.round(column, 6)
