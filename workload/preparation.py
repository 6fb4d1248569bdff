"""Cleaning, label, split, fitted-preprocessing and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions import labels
from flowmill.functions.hashing import row_hash
from flowmill.functions.paths import value_token, path_part, macro_f1
from flowmill.operators import cleaning, features, quantiles, sequence, splits
from flowmill.operators.ordering import row_index, row_index_within
from workload.fixtures import (
    FILES, FLOWS_CTE, LABELLED, SEQ_LEN, SPLIT_CTE, VAL_RATIO, flows, r6, split_flows, view,
)
from workload.registry import registry

QUERIES, ORACLES, query = registry()


def _text(spark, sf):
    return view(spark, sf, LABELLED)


_LAB = f"WITH t AS ({LABELLED})"
_NORM = "replace(trim(text), '.', '')"

# --- cleaning -----------------------------------------------------------------


@query(
    "clean_column_names",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def clean_column_names(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    messy = raw.toDF("﻿event_id", " user_id", "event_type  ", " value ")
    return cleaning.clean_column_names(messy)


@query(
    "clean_drop_invalid",
    f"""WITH {FLOWS_CTE} SELECT id, label, value, value_txt, shifted FROM (
    SELECT id, label, value, value_txt, CASE WHEN id % 101 = 4 THEN NULL ELSE value_bucket::DOUBLE END AS shifted FROM flows)
    WHERE value IS NOT NULL AND value_txt NOT IN ('Infinity','-Infinity','inf','-inf') AND shifted IS NOT NULL""",
)
def clean_drop_invalid(spark, sf):
    rows = flows(spark, sf).select(
        "id", "label", "value", "value_txt",
        F.expr("CASE WHEN id % 101 = 4 THEN double('-Infinity') ELSE double(value_bucket) END").alias("shifted"),
    )
    return cleaning.clean_drop_invalid(rows)


@query("label_normalize", f"{_LAB} SELECT id, {_NORM} AS label FROM t")
def label_normalize(spark, sf):
    return _text(spark, sf).select("id", labels.normalize(F.col("text")).alias("label"))


@query(
    "label_binary_remap",
    f"""{_LAB} SELECT id,
    CASE WHEN {_NORM} IN ('1','attack') THEN 'attack' ELSE 'normal' END AS unsw,
    CASE WHEN upper({_NORM}) = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS cic,
    CASE WHEN {_NORM} = 'normal' THEN 'normal' ELSE 'attack' END AS nsl FROM t""",
)
def label_binary_remap(spark, sf):
    return _text(spark, sf).select(
        "id", *[labels.binary_text(F.col("text"), f).alias(f) for f in labels.FAMILIES]
    )


@query(
    "label_binary_raw",
    f"""{_LAB} SELECT id,
    CAST(lower(trim(text)) IN ('1','1.0','attack','malicious','anomaly') AS INT) AS unsw,
    CAST(upper(trim(text)) <> 'BENIGN' AS INT) AS cic,
    CAST(lower({_NORM}) <> 'normal' AS INT) AS nsl FROM t""",
)
def label_binary_raw(spark, sf):
    return _text(spark, sf).select(
        "id", *[labels.binary_flag(F.col("text"), f).alias(f) for f in labels.FAMILIES]
    )


_FAMILY_ROWS = ", ".join(
    f"('{name}','{family}')" for family, names in labels.ATTACK_FAMILIES.items() for name in names.split()
)


@query(
    "label_family_map",
    f"""WITH t AS ({LABELLED}), m(name, family) AS (VALUES {_FAMILY_ROWS})
    SELECT id, CASE WHEN {_NORM} = 'normal' THEN 'normal' ELSE coalesce(m.family, 'other') END AS family
    FROM t LEFT JOIN m ON m.name = {_NORM}""",
)
def label_family_map(spark, sf):
    return _text(spark, sf).select("id", labels.attack_family(F.col("text")).alias("family"))


@query(
    "label_collapse_multiclass",
    f"""{_LAB}, n AS (SELECT id, {_NORM} AS s, lower({_NORM}) AS l FROM t)
    SELECT id, CASE WHEN upper(s)='BENIGN' THEN 'BENIGN'
    WHEN l LIKE '%web attack%' OR l LIKE '%brute force%' OR l LIKE '%xss%' OR l LIKE '%sql injection%' THEN 'WebAttack'
    WHEN l LIKE '%ftp-patator%' THEN 'FTP-Patator' WHEN l LIKE '%ssh-patator%' THEN 'SSH-Patator'
    WHEN l LIKE '%dos%' AND l NOT LIKE '%ddos%' THEN s WHEN l LIKE '%ddos%' THEN 'DDoS'
    WHEN l LIKE '%portscan%' THEN 'PortScan' WHEN l LIKE '%bot%' THEN 'Bot'
    WHEN l LIKE '%infiltration%' THEN 'Infiltration' WHEN l LIKE '%heartbleed%' THEN 'Heartbleed'
    ELSE s END AS label FROM n""",
)
def label_collapse_multiclass(spark, sf):
    return _text(spark, sf).select("id", labels.collapse_multiclass(F.col("text")).alias("label"))


@query(
    "label_drop_missing",
    f"{_LAB} SELECT id, {_NORM} AS label FROM t WHERE {_NORM} NOT IN ('','nan','NaN')",
)
def label_drop_missing(spark, sf):
    return _text(spark, sf).where(labels.present(F.col("text"))).select(
        "id", labels.normalize(F.col("text")).alias("label")
    )


@query(
    "encode_label_binary",
    f"""{_LAB} SELECT id, CAST(CASE WHEN lower(trim(text)) IN ('benign','normal','0') THEN 0
    WHEN lower(trim(text)) IN ('attack','attacks','malicious','anomaly','intrusion','1') THEN 1 END AS INT) AS y FROM t""",
)
def encode_label_binary(spark, sf):
    return _text(spark, sf).select("id", labels.encode_binary(F.col("text")).alias("y"))


@query(
    "encode_label_multiclass",
    f"""WITH t AS ({LABELLED}), c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
    FROM (SELECT DISTINCT {_NORM} AS label FROM t))
    SELECT t.id, c.code FROM t JOIN c ON c.label = {_NORM}""",
)
def encode_label_multiclass(spark, sf):
    named = _text(spark, sf).select("id", labels.normalize(F.col("text")).alias("label"))
    codes = features.label_codes(named, "label")
    return named.join(codes, "label").select("id", "code")


@query(
    "find_attack_label",
    f"""WITH t AS ({LABELLED}), c AS (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS code
    FROM (SELECT {_NORM} AS label, count(*) AS n FROM t GROUP BY 1))
    SELECT code AS attack_code, label AS attack_label, n AS rows FROM c
    WHERE lower(trim(label)) IN ('attack','attacks','malicious','anomaly','intrusion','1') OR lower(label) LIKE '%attack%'
    ORDER BY code LIMIT 1""",
)
def find_attack_label(spark, sf):
    named = _text(spark, sf).select(labels.normalize(F.col("text")).alias("label"))
    mapping = features.label_codes(named, "label")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    hits = mapping.join(sizes, "label").where(labels.names_attack(F.col("label")))
    first = hits.agg(F.min_by(F.struct("code", "label", "n"), "code").alias("m")).where("m IS NOT NULL")
    return first.select(
        F.col("m.code").alias("attack_code"), F.col("m.label").alias("attack_label"), F.col("m.n").alias("rows")
    )


_PROTOCOL_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS protocol, '{c}' AS feature, count({c}) AS filled FROM flows"
    for p, drops in {"clean": ["attack_cat", "id"], "attack_cat": ["id"], "id": ["attack_cat"], "both": []}.items()
    for c in ["id", "srcip", "attack_cat", "value", "value_bucket", "k", "value_txt"]
    if c not in drops
)


@query("feature_select_protocol", f"WITH {FLOWS_CTE} {_PROTOCOL_SQL}")
def feature_select_protocol(spark, sf):
    rows = flows(spark, sf).drop("ts", "y")
    out = None
    for protocol in ("clean", "attack_cat", "id", "both"):
        kept = cleaning.features_for_protocol(rows, "unsw", protocol)
        counts = kept.agg(*[F.count(c).alias(c) for c in kept.columns])
        part = counts.select(
            F.lit(protocol).alias("protocol"),
            F.inline(
                F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled")) for c in kept.columns])
            ),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "feature_select_task",
    f"""WITH {FLOWS_CTE}
    SELECT 'binary' AS task, srcip, value_bucket, k, value_txt FROM flows
    UNION ALL SELECT 'multiclass', srcip, value_bucket, k, value_txt FROM flows""",
)
def feature_select_task(spark, sf):
    rows = flows(spark, sf).select("id", "attack_cat", "label", "srcip", "value_bucket", "k", "value_txt")
    binary = cleaning.features_for_task(rows, "unsw", "label", "binary")
    multi = cleaning.features_for_task(rows, "unsw", "attack_cat", "multiclass")
    return binary.withColumn("task", F.lit("binary")).unionByName(multi.withColumn("task", F.lit("multiclass")))


_NUM = "CASE WHEN isfinite(try_cast(value_txt AS DOUBLE)) THEN try_cast(value_txt AS DOUBLE) END"


@query("numeric_coerce", f"WITH {FLOWS_CTE} SELECT id, {_NUM} AS value_txt FROM flows")
def numeric_coerce(spark, sf):
    return cleaning.coerce_numeric(flows(spark, sf).select("id", "value_txt"), ["value_txt"])


@query(
    "schema_align",
    f"WITH {FLOWS_CTE} SELECT id, k, 0.0::DOUBLE AS absent_v1, NULL::DOUBLE AS absent_v2, value_bucket FROM flows",
)
def schema_align(spark, sf):
    rows = flows(spark, sf)
    filled = cleaning.align_schema(rows, ["id", "k", "absent_v1", "value_bucket", "value"], 0.0)
    return cleaning.align_schema(filled, ["id", "k", "absent_v1", "absent_v2", "value_bucket"], None)


@query(
    "drop_all_null_columns",
    f"WITH {SPLIT_CTE} SELECT id, split, value, k FROM prep",
)
def drop_all_null_columns(spark, sf):
    rows = split_flows(spark, sf, "value", "k").withColumn(
        "late", F.when(F.col("split") != "train", F.col("k"))
    )
    gone = features.all_null_columns(rows.where("split = 'train'"), ["value", "k", "late"])
    return rows.drop(*gone).select("id", "split", "value", "k")


# --- fitted preprocessing -----------------------------------------------------


@query(
    "agg_train_median",
    f"""WITH {SPLIT_CTE}, tr AS (SELECT value, value_bucket, k, {_NUM} AS value_num FROM prep WHERE split='train')
    SELECT 'value' AS feature, median(value)::DOUBLE AS median FROM tr UNION ALL
    SELECT 'value_bucket', median(value_bucket::DOUBLE) FROM tr UNION ALL
    SELECT 'k', median(k::DOUBLE) FROM tr UNION ALL SELECT 'value_num', median(value_num) FROM tr""",
)
def agg_train_median(spark, sf):
    rows = split_flows(spark, sf, "value", "value_bucket", "k", "value_txt")
    train = cleaning.coerce_numeric(rows.where("split = 'train'"), ["value_txt"]).withColumnRenamed("value_txt", "value_num")
    return quantiles.medians(train, ["value", "value_bucket", "k", "value_num"])


_MED = f"""{SPLIT_CTE}, num AS (SELECT id, split, value, {_NUM} AS value_num FROM prep),
med AS (SELECT median(value) AS m1, median(value_num) AS m2 FROM num WHERE split='train'),
imp AS (SELECT id, split, coalesce(value, m1, 0.0) AS value, coalesce(value_num, m2, 0.0) AS value_num FROM num, med)"""


def _numeric_rows(spark, sf):
    rows = split_flows(spark, sf, "value", "value_txt")
    return cleaning.coerce_numeric(rows, ["value_txt"]).select(
        "id", "split", "value", F.col("value_txt").alias("value_num")
    )


def _fitted(spark, sf, scaling):
    rows = _numeric_rows(spark, sf)
    fit = features.fit_numeric(rows.where("split = 'train'"), ["value", "value_num"], scaling)
    out = fit.transform(rows)
    return out.select("id", "split", r6(F.col("value")).alias("value"), r6(F.col("value_num")).alias("value_num"))


@query(
    "impute_median",
    f"WITH {_MED} SELECT id, split, round(value,6) AS value, round(value_num,6) AS value_num FROM imp",
)
def impute_median(spark, sf):
    return _fitted(spark, sf, "none")


@query(
    "scale_standard",
    f"""WITH {_MED}, s AS (SELECT avg(value) a1, coalesce(nullif(stddev_pop(value),0),1) d1,
    avg(value_num) a2, coalesce(nullif(stddev_pop(value_num),0),1) d2 FROM imp WHERE split='train')
    SELECT id, split, round((value-a1)/d1,6) AS value, round((value_num-a2)/d2,6) AS value_num FROM imp, s""",
)
def scale_standard(spark, sf):
    return _fitted(spark, sf, "standard")


@query(
    "scale_minmax",
    f"""WITH {_MED}, s AS (SELECT min(value) a1, coalesce(nullif(max(value)-min(value),0),1) d1,
    min(value_num) a2, coalesce(nullif(max(value_num)-min(value_num),0),1) d2 FROM imp WHERE split='train')
    SELECT id, split, round((value-a1)/d1,6) AS value, round((value_num-a2)/d2,6) AS value_num FROM imp, s""",
)
def scale_minmax(spark, sf):
    return _fitted(spark, sf, "minmax")


def _stats_sql(cols: str, a: str) -> str:
    return f"""WITH {SPLIT_CTE}, tr AS (SELECT value, value_bucket::DOUBLE AS value_bucket, 1.0::DOUBLE AS flat FROM prep WHERE split='train')
    """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, {a.replace('#', c)} FROM tr" for c in cols.split())


@query(
    "agg_standard_stats",
    _stats_sql(
        "value value_bucket flat",
        "round(avg(#),6) AS mean, round(stddev_pop(#),6) AS std, round(coalesce(nullif(stddev_pop(#),0),1),6) AS divisor",
    ),
)
def agg_standard_stats(spark, sf):
    train = split_flows(spark, sf, "value", "value_bucket").where("split = 'train'").withColumn("flat", F.lit(1.0))
    out = features.standard_stats(train, ["value", "value_bucket", "flat"])
    return out.select("feature", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "divisor")])


@query(
    "agg_minmax_stats",
    _stats_sql(
        "value value_bucket flat",
        'round(min(#),6) AS "min", round(max(#),6) AS "max", round(coalesce(nullif(max(#)-min(#),0),1),6) AS divisor',
    ),
)
def agg_minmax_stats(spark, sf):
    train = split_flows(spark, sf, "value", "value_bucket").where("split = 'train'").withColumn("flat", F.lit(1.0))
    out = features.minmax_stats(train, ["value", "value_bucket", "flat"])
    return out.select("feature", *[r6(F.col(c)).alias(c) for c in ("min", "max", "divisor")])


_CATS = f"""{SPLIT_CTE}, cats AS (SELECT id, split, split_idx, attack_cat, srcip,
 CASE WHEN id % 13 = 5 THEN NULL ELSE value_txt END AS txt FROM prep),
d1 AS (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT attack_cat AS v, min(split_idx) AS f FROM cats WHERE split='train' GROUP BY 1)),
d2 AS (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT srcip AS v, min(split_idx) AS f FROM cats WHERE split='train' GROUP BY 1)),
d3 AS (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT coalesce(txt,'<MISSING>') AS v, min(split_idx) AS f FROM cats WHERE split='train' GROUP BY 1))"""


def _cat_rows(spark, sf):
    rows = split_flows(spark, sf, "attack_cat", "srcip", "value_txt")
    return rows.select(
        "id", "split", "split_idx", "attack_cat", "srcip",
        F.expr("CASE WHEN id % 13 = 5 THEN NULL ELSE value_txt END").alias("txt"),
    )


@query(
    "encode_category",
    f"""WITH {_CATS} SELECT id, split, coalesce(d1.code,-1) AS attack_cat, coalesce(d2.code,-1) AS srcip, coalesce(d3.code,-1) AS txt
    FROM cats LEFT JOIN d1 ON d1.v=attack_cat LEFT JOIN d2 ON d2.v=srcip LEFT JOIN d3 ON d3.v=coalesce(txt,'<MISSING>')""",
)
def encode_category(spark, sf):
    rows = _cat_rows(spark, sf)
    columns = ["attack_cat", "srcip", "txt"]
    codes = features.category_codes(rows.where("split = 'train'"), columns, "split_idx")
    return features.encode_categories(rows, codes, columns).select("id", "split", *columns)


@query(
    "join_category_lookup",
    f"""WITH {_CATS} SELECT 'attack_cat' AS feature, v AS value, code FROM d1 UNION ALL
    SELECT 'srcip', v, code FROM d2 UNION ALL SELECT 'txt', v, code FROM d3""",
)
def join_category_lookup(spark, sf):
    train = _cat_rows(spark, sf).where("split = 'train'")
    return features.category_codes(train, ["attack_cat", "srcip", "txt"], "split_idx")


@query(
    "audit_category_cardinality",
    f"""WITH {_CATS} SELECT 'attack_cat' AS feature, count(*) AS categories FROM d1 UNION ALL
    SELECT 'srcip', count(*) FROM d2 UNION ALL SELECT 'txt', count(*) FROM d3""",
)
def audit_category_cardinality(spark, sf):
    train = _cat_rows(spark, sf).where("split = 'train'")
    return features.category_cardinality(train, ["attack_cat", "srcip", "txt"])


# --- splits -------------------------------------------------------------------


@query("split_sequential", f"WITH {SPLIT_CTE} SELECT id, split, split_idx FROM prep")
def split_sequential(spark, sf):
    return split_flows(spark, sf).select("id", "split", "split_idx")


@query(
    "split_ordered_tail",
    f"""WITH {FLOWS_CTE}, tr AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM flows WHERE attack_cat <> 'error'),
    te AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM flows WHERE attack_cat = 'error'),
    c AS (SELECT *, n - greatest(1, CAST(floor(n*0.15::DOUBLE) AS BIGINT)) AS n_train FROM tr)
    SELECT id, CASE WHEN i < n_train THEN 'train' ELSE 'val' END AS split, i - CASE WHEN i < n_train THEN 0 ELSE n_train END AS split_idx FROM c
    UNION ALL SELECT id, 'test', i FROM te""",
)
def split_ordered_tail(spark, sf):
    rows = flows(spark, sf).select("id", "attack_cat")
    official = row_index(rows.where("attack_cat <> 'error'"), ["id"])
    held = row_index(rows.where("attack_cat = 'error'"), ["id"])
    return splits.split_ordered_tail(official, held, VAL_RATIO).select("id", "split", "split_idx")


@query(
    "split_day_holdout",
    f"""WITH {FLOWS_CTE}, d AS (SELECT id, CASE WHEN isodow(ts) <= 3 THEN 'train' WHEN isodow(ts)=4 THEN 'val' WHEN isodow(ts)=5 THEN 'test' END AS split FROM flows)
    SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS split_idx FROM d WHERE split IS NOT NULL""",
)
def split_day_holdout(spark, sf):
    rows = flows(spark, sf).select("id", F.weekday("ts").alias("day"))
    held = splits.split_day_holdout(rows, F.col("day"), require_all=False)
    return row_index_within(held, ["split"], ["id"], "split_idx").select("id", "split", "split_idx")


@query(
    "split_stratified",
    f"""WITH {FLOWS_CTE}, o AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY (id*7919+13) % 1000003, id) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM flows)
    SELECT id, y, CASE WHEN r < floor(n*0.15::DOUBLE+0.5::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM o""",
)
def split_stratified(spark, sf):
    rows = flows(spark, sf).select("id", "y")
    return splits.split_stratified(rows, "y", VAL_RATIO, F.expr("(id*7919+13) % 1000003"), "id")


@query(
    "shuffle_within_split",
    f"""WITH {SPLIT_CTE} SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY (row_idx*104729+2026) % 1000003, row_idx) - 1 AS split_idx FROM prep""",
)
def shuffle_within_split(spark, sf):
    rows = split_flows(spark, sf)
    rows = rows.select("id", "split", "split_idx", "row_idx")
    return splits.shuffle_within_split(rows, F.expr("(row_idx*104729+2026) % 1000003")).select(
        "id", "split", "split_idx"
    )


@query(
    "sample_weighted_replacement",
    f"""WITH {SPLIT_CTE}, tr AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS pos FROM prep WHERE split='train'),
    c AS (SELECT count(*) AS n, count(*) FILTER (y=0) AS n0, count(*) FILTER (y=1) AS n1 FROM tr),
    w AS (SELECT *, (n::DOUBLE/greatest(n0,1)) AS r0, (n::DOUBLE/greatest(n1,1)) AS r1 FROM c),
    m AS (SELECT *, r0*n0/(r0*n0+r1*n1) AS share0 FROM w),
    d AS (SELECT range AS draw FROM range((SELECT count(*) FROM tr))),
    u AS (SELECT ((draw*7919+17) % 10007)::DOUBLE/10007.0::DOUBLE AS u, ((draw*104729+31) % 1000003)::DOUBLE/1000003.0::DOUBLE AS v FROM d),
    p AS (SELECT CASE WHEN u < share0 THEN 0 ELSE 1 END AS y,
      CASE WHEN u < share0 THEN least(CAST(floor(v*n0) AS BIGINT), n0-1) ELSE least(CAST(floor(v*n1) AS BIGINT), n1-1) END AS pos FROM u, m)
    SELECT tr.id, tr.y, count(*) AS copies FROM p JOIN tr ON tr.y=p.y AND tr.pos=p.pos GROUP BY tr.id, tr.y""",
)
def sample_weighted_replacement(spark, sf):
    train = split_flows(spark, sf, "y").where("split = 'train'").select("id", "y", "split", "split_idx")
    weights = {r["y"]: r["weight"] for r in sequence.class_weights(train, "y", [0, 1]).collect()}
    pick = {0: "(draw*7919+17) % 10007 / 10007.0D", 1: "(draw*104729+31) % 1000003 / 1000003.0D"}
    drawn = splits.sample_with_replacement(
        train, "y", "split_idx", weights, uniform=lambda s: F.expr(pick[s])
    )
    return drawn.groupBy("id", "y").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "split_guard",
    f"""WITH {SPLIT_CTE}, s AS (SELECT split, count(*) AS n FROM prep GROUP BY split), w(split, required) AS (VALUES ('train',1200::BIGINT),('val',1200::BIGINT),('test',1200::BIGINT),('holdout',1200::BIGINT))
    SELECT w.split, coalesce(n,0) AS rows, required, coalesce(n,0) < required AS violated FROM w LEFT JOIN s ON s.split=w.split""",
)
def split_guard(spark, sf):
    return splits.split_guard(split_flows(spark, sf), 1200, ("train", "val", "test", "holdout"))


# --- windows ------------------------------------------------------------------


def _window_sql(length: int, stride: int) -> str:
    return f"""win AS (SELECT split, split_idx AS end_idx, y, count(*) OVER w AS n,
     first_value(value_bucket) OVER w AS v0, first_value(k) OVER w AS k0,
     sum(split_idx*value_bucket) OVER w - (split_idx-{length})*sum(value_bucket) OVER w AS vsum,
     sum(split_idx*k) OVER w - (split_idx-{length})*sum(k) OVER w AS ksum
     FROM prep WINDOW w AS (PARTITION BY split ORDER BY split_idx ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)),
    wins AS (SELECT * FROM win WHERE n = {length} AND (end_idx-{length - 1}) % {stride} = 0)"""


def _position_sum(i: int):
    """Sum over the window of (position + 1) * feature i."""
    return F.aggregate(
        F.transform("x", lambda row, t: F.get(row, F.lit(i)) * (t + 1)), F.lit(0.0), lambda a, v: a + v
    )


def _window_digest(windows):
    return windows.select(
        "split", "end_idx", "y",
        F.element_at("x", 1)[0].cast("bigint").alias("v0"),
        F.element_at("x", 1)[1].cast("bigint").alias("k0"),
        _position_sum(0).cast("bigint").alias("vsum"),
        _position_sum(1).cast("bigint").alias("ksum"),
    )


_DIGEST = "SELECT split, end_idx, y, v0, k0::BIGINT AS k0, CAST(vsum AS BIGINT) AS vsum, CAST(ksum AS BIGINT) AS ksum FROM wins"


@query("seq_window", f"WITH {SPLIT_CTE}, {_window_sql(SEQ_LEN, 1)} {_DIGEST}")
def seq_window(spark, sf):
    rows = split_flows(spark, sf, "value_bucket", "k", "y")
    return _window_digest(sequence.sequence_windows(rows, ["value_bucket", "k"], "y", SEQ_LEN))


@query("seq_window_stride", f"WITH {SPLIT_CTE}, {_window_sql(SEQ_LEN, 5)} {_DIGEST}")
def seq_window_stride(spark, sf):
    rows = split_flows(spark, sf, "value_bucket", "k", "y")
    return _window_digest(sequence.sequence_windows(rows, ["value_bucket", "k"], "y", SEQ_LEN, 5))


@query("seq_window_disjoint", f"WITH {SPLIT_CTE}, {_window_sql(8, 10)} {_DIGEST}")
def seq_window_disjoint(spark, sf):
    rows = split_flows(spark, sf, "value_bucket", "k", "y")
    return _window_digest(sequence.sequence_windows(rows, ["value_bucket", "k"], "y", 8, 10))


@query(
    "window_flatten",
    f"""WITH {SPLIT_CTE}, {_window_sql(SEQ_LEN, 1)}, tail AS (SELECT split, split_idx, value_bucket, k,
     sum(k) OVER (PARTITION BY split ORDER BY split_idx ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS kk FROM prep)
    SELECT wins.split, end_idx, y, {2 * SEQ_LEN} AS width, v0 AS at_0, k0::BIGINT AS at_len,
     CAST(vsum + ksum + {SEQ_LEN}*kk AS BIGINT) AS checksum FROM wins JOIN tail ON tail.split=wins.split AND tail.split_idx=end_idx""",
)
def window_flatten(spark, sf):
    rows = split_flows(spark, sf, "value_bucket", "k", "y")
    flat = sequence.flatten_windows(
        sequence.sequence_windows(rows, ["value_bucket", "k"], "y", SEQ_LEN), 2
    )
    checksum = F.aggregate(F.transform("flat", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return flat.select(
        "split", "end_idx", "y", F.size("flat").alias("width"),
        F.get("flat", F.lit(0)).cast("bigint").alias("at_0"),
        F.get("flat", F.lit(SEQ_LEN)).cast("bigint").alias("at_len"),
        checksum.cast("bigint").alias("checksum"),
    )


_END = f"split_idx >= {SEQ_LEN - 1}"


@query(
    "agg_class_weights",
    f"""WITH {SPLIT_CTE}, c AS (SELECT y, count(*) AS n FROM prep WHERE split='train' AND {_END} GROUP BY y),
    g AS (SELECT k.y, coalesce(n,0) AS windows FROM (VALUES (0),(1),(2)) k(y) LEFT JOIN c ON c.y=k.y),
    r AS (SELECT *, CAST(sum(windows) OVER () AS DOUBLE)/greatest(windows,1) AS raw FROM g)
    SELECT y, windows, round(raw/avg(raw) OVER (),6) AS weight FROM r""",
)
def agg_class_weights(spark, sf):
    rows = split_flows(spark, sf, "y")
    out = sequence.class_weights(rows, "y", [0, 1, 2], SEQ_LEN)
    return out.select("y", "windows", r6(F.col("weight")).alias("weight"))


@query(
    "data_info",
    f"""WITH {SPLIT_CTE} SELECT split, count(*) AS rows, count(*) FILTER ({_END}) AS windows,
    count(*) FILTER ({_END} AND y=0) AS benign_windows, count(*) FILTER ({_END} AND y=1) AS attack_windows FROM prep GROUP BY split""",
)
def data_info(spark, sf):
    return sequence.data_info(split_flows(spark, sf, "y"), "y", SEQ_LEN)


def _dependence_sql(scope: str, stride: int) -> str:
    """Windows inside splits, or over all rows: those that start in another split than they end are mixed."""
    end, idx = (_END, "split_idx") if scope == "split" else (f"row_idx >= {SEQ_LEN - 1}", "row_idx")
    mixed = "0::BIGINT" if scope == "split" else f"count(*) FILTER (split <> (SELECT split FROM prep q WHERE q.row_idx = prep.row_idx - {SEQ_LEN - 1}))"
    return f"""SELECT '{scope}' AS scope, CAST({stride} AS BIGINT) AS stride, count(*) AS windows, {mixed} AS cross_split_windows,
    {max(SEQ_LEN - stride, 0)}::BIGINT AS shared_rows, {max(SEQ_LEN - stride, 0)}/{SEQ_LEN}::DOUBLE AS shared_fraction
    FROM prep WHERE {end} AND ({idx}-{SEQ_LEN - 1}) % {stride} = 0"""


@query(
    "audit_window_dependence",
    f"WITH {SPLIT_CTE} " + " UNION ALL ".join(_dependence_sql(scope, s) for scope in ("split", "whole") for s in (1, 4, 20)),
)
def audit_window_dependence(spark, sf):
    """Windows of each split mix none; windows over the unsplit row order mix at every boundary."""
    rows = split_flows(spark, sf)
    whole = rows.withColumn("origin", F.col("split")).withColumn("split", F.lit("all"))
    out = None
    for stride in (1, 4, 20):
        for scope, found in (
            ("split", sequence.window_dependence(rows, SEQ_LEN, stride)),
            ("whole", sequence.window_dependence(whole, SEQ_LEN, stride, "origin", "row_idx")),
        ):
            part = found.select(F.lit(scope).alias("scope"), F.lit(stride).cast("bigint").alias("stride"), "*")
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "row_hash",
    f"""WITH {FLOWS_CTE} SELECT attack_cat, count(*) AS rows, count(DISTINCT (coalesce(srcip,'<MISSING>'), value, k)) AS distinct_rows FROM flows GROUP BY attack_cat""",
)
def hashed_rows(spark, sf):
    rows = flows(spark, sf).select("attack_cat", "srcip", "value", "k")
    hashed = rows.select("attack_cat", row_hash(rows, ["srcip", "value", "k"]).alias("h"))
    # distinct hashes first, so a frequent row is combined before anything is counted
    per_hash = hashed.groupBy("attack_cat", "h").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy("attack_cat").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )


# --- paths and documents ------------------------------------------------------


@query(
    "source_chrono_rank",
    f"""WITH t AS ({FILES}), l AS (SELECT id, lower(file_name) AS f FROM t)
    SELECT id, CAST(CASE WHEN f LIKE '%monday%' THEN 0 WHEN f LIKE '%tuesday%' THEN 1 WHEN f LIKE '%wednesday%' THEN 2
    WHEN f LIKE '%thursday%' THEN 3 WHEN f LIKE '%friday%' THEN 4 ELSE 99 END AS INT) AS day_rank,
    CAST(f LIKE '%afternoon%' AND f NOT LIKE '%morning%' AS INT) AS half_day FROM l""",
)
def source_chrono_rank(spark, sf):
    from flowmill.sources.flows import chronological_rank

    return chronological_rank(view(spark, sf, FILES), "file_name").select("id", "day_rank", "half_day")


@query(
    "path_sensitivity_key",
    """SELECT l_orderkey, l_linenumber, 'dropout' AS parameter, replace(CAST(l_discount AS VARCHAR),'.','p') AS value, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def path_sensitivity_key(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber",
        F.concat_ws(
            "/", F.lit("hyper"), F.lit("dropout"), value_token(F.col("l_discount")),
            F.concat(F.lit("seed_"), F.col("l_linenumber")), F.lit("metrics.json"),
        ).alias("relative_path"),
    )
    keyed = items.select(
        "l_orderkey", "l_linenumber",
        path_part(F.col("relative_path"), 1).alias("parameter"),
        path_part(F.col("relative_path"), 2).alias("value"),
    )
    return keyed.groupBy("l_orderkey", "l_linenumber", "parameter", "value").agg(F.count(F.lit(1)).alias("n"))


_DOC_VALUE = "CAST(event_id % 1000 AS DOUBLE)/1000"


@query(
    "macro_f1_coalesce",
    f"SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE {_DOC_VALUE} END AS macro_f1 FROM events",
)
def macro_f1_coalesce(spark, sf):
    documents = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("id"),
        F.expr(
            f"""CASE event_id % 4
            WHEN 0 THEN concat('{{"f1_macro":', {_DOC_VALUE}, ',"macro_f1":9}}')
            WHEN 1 THEN concat('{{"macro avg/f1-score":', {_DOC_VALUE}, '}}')
            WHEN 2 THEN concat('{{"macro avg":{{"f1-score":', {_DOC_VALUE}, '}}}}')
            ELSE '{{"accuracy":1}}' END"""
        ).alias("document"),
    )
    return documents.select("id", macro_f1(F.col("document")).alias("macro_f1"))
