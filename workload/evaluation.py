"""Prediction, metric, loss, refinement and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions import probability
from flowmill.operators import audit, evaluation, refinement
from flowmill.plans.refine import refine
from flowmill.session import scratch_path
from flowmill.sources import predictions as prediction_files
from workload.fixtures import FLOWS_CTE, PREDS_CTE, SPLIT_CTE, flows, preds, r6, split_flows, table
from workload.registry import registry

QUERIES, ORACLES, query = registry()

# --- predicted classes and probabilities --------------------------------------


@query("predict_threshold", f"WITH {PREDS_CTE} SELECT row_id, split, CAST(p_a >= 0.5 AS INT) AS y_pred FROM preds")
def predict_threshold(spark, sf):
    return preds(spark, sf).select("row_id", "split", probability.at_threshold(F.col("p_a")).alias("y_pred"))


# Three integer-valued logits per row, with ties, so both engines see the same numbers.
_LOGITS = "CAST(event_id % 7 AS DOUBLE) AS z0, CAST((event_id*3) % 5 AS DOUBLE) AS z1, CAST((event_id*5) % 4 AS DOUBLE) AS z2"


@query(
    "predict_argmax",
    f"""WITH l AS (SELECT event_id AS row_id, {_LOGITS} FROM events), m AS (SELECT *, greatest(z0,z1,z2) AS t FROM l),
    e AS (SELECT *, exp(z0-t) AS e0, exp(z1-t) AS e1, exp(z2-t) AS e2 FROM m)
    SELECT row_id, CAST(CASE WHEN z0=t THEN 0 WHEN z1=t THEN 1 ELSE 2 END AS INT) AS y_pred,
    round(greatest(e0,e1,e2)/(e0+e1+e2),6) AS top FROM e""",
)
def predict_argmax(spark, sf):
    logits = table(spark, sf, "events").selectExpr(
        "event_id AS row_id",
        "array(CAST(event_id % 7 AS DOUBLE), CAST((event_id*3) % 5 AS DOUBLE), CAST((event_id*5) % 4 AS DOUBLE)) AS z",
    )
    scored = logits.withColumn("p", probability.softmax(F.col("z")))
    return scored.select(
        "row_id", probability.argmax(F.col("p")).alias("y_pred"), r6(F.array_max("p")).alias("top")
    )


@query(
    "attack_probability",
    f"""WITH {PREDS_CTE} SELECT row_id, p_a AS single, p_a AS pair, p_a AS reversed,
    round(1/(1+exp(-(p_a*8-4))),6) AS logit FROM preds""",
)
def attack_probability(spark, sf):
    p = F.col("p_a")
    return preds(spark, sf).select(
        "row_id",
        probability.attack_probability(F.array(p)).alias("single"),
        probability.attack_probability(F.array(1 - p, p)).alias("pair"),
        probability.attack_probability(F.array(p, 1 - p), classes=[1, 0]).alias("reversed"),
        r6(probability.sigmoid(p * 8 - 4)).alias("logit"),
    )


@query(
    "source_predictions_validate",
    f"""WITH {PREDS_CTE} SELECT split, count(*) AS rows, count(DISTINCT y_true) AS classes, 0::BIGINT AS unreadable,
    min(p_a) AS min_prob, max(p_a) AS max_prob, count(DISTINCT y_true) >= 2 AND min(p_a) >= 0 AND max(p_a) <= 1 AS valid FROM preds GROUP BY split""",
)
def source_predictions_validate(spark, sf):
    from flowmill.sources.predictions import validate_predictions

    rows = preds(spark, sf).withColumnRenamed("p_a", "y_prob")
    out = None
    for split in ("val", "test"):
        part = validate_predictions(rows.where(F.col("split") == split)).select(F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# --- confusion and metrics ----------------------------------------------------

_EMB_PRED = """emb AS (SELECT vec_id, CAST(label AS INT) AS y_true, CAST((label + CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE 0 END) % 10 AS INT) AS y_pred FROM embeddings)"""


def _multiclass(spark, sf):
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", "CAST(label AS INT) AS y_true",
        "CAST((label + CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE 0 END) % 10 AS INT) AS y_pred",
    )


def _binary(spark, sf):
    return preds(spark, sf).where("split = 'test'").select(
        "row_id", "y_true", F.col("p_a").alias("y_prob"), probability.at_threshold(F.col("p_a")).alias("y_pred")
    )


_BIN = f"{PREDS_CTE}, bin AS (SELECT row_id, y_true, p_a AS y_prob, CAST(p_a >= 0.5 AS INT) AS y_pred FROM preds WHERE split='test')"


@query(
    "agg_confusion_matrix",
    f"""WITH {_EMB_PRED}, g AS (SELECT a.i AS y_true, b.i AS y_pred FROM (SELECT CAST(range AS INT) AS i FROM range(11)) a, (SELECT CAST(range AS INT) AS i FROM range(11)) b),
    c AS (SELECT y_true, y_pred, count(*) AS n FROM emb GROUP BY ALL)
    SELECT g.y_true, g.y_pred, coalesce(n,0) AS n FROM g LEFT JOIN c ON c.y_true=g.y_true AND c.y_pred=g.y_pred""",
)
def agg_confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_multiclass(spark, sf), range(11))


@query(
    "agg_confusion_pivot",
    f"""WITH {_BIN} SELECT y_true, count(*) FILTER (y_pred=0) AS pred_0, count(*) FILTER (y_pred=1) AS pred_1 FROM bin GROUP BY y_true""",
)
def agg_confusion_pivot(spark, sf):
    long = evaluation.confusion_matrix(_binary(spark, sf), [0, 1])
    return evaluation.confusion_pivot(long, [0, 1])


_PER_CLASS = """u AS (SELECT DISTINCT l FROM (SELECT y_true AS l FROM emb UNION ALL SELECT y_pred FROM emb)),
 pc AS (SELECT l, (SELECT count(*) FROM emb WHERE y_true=l AND y_pred=l) AS tp, (SELECT count(*) FROM emb WHERE y_true=l) AS sup,
  (SELECT count(*) FROM emb WHERE y_pred=l) AS prd, (SELECT count(*) FROM emb) AS n FROM u),
 sc AS (SELECT *, CASE WHEN prd=0 THEN 0 ELSE tp/prd::DOUBLE END AS p, CASE WHEN sup=0 THEN 0 ELSE tp/sup::DOUBLE END AS r,
  CASE WHEN sup+prd=0 THEN 0 ELSE 2*tp/(sup+prd)::DOUBLE END AS f, (prd-tp)/((prd-tp)+(n-sup-prd+tp)+1e-12) AS fpr FROM pc)"""


@query(
    "agg_class_report",
    f"""WITH {_EMB_PRED}, {_PER_CLASS}, w AS (SELECT CAST(range AS INT) AS l FROM range(11)),
    d AS (SELECT w.l, coalesce(p,0) AS p, coalesce(r,0) AS r, coalesce(f,0) AS f, coalesce(sup,0) AS sup, coalesce(tp,0) AS tp FROM w LEFT JOIN sc ON sc.l=w.l)
    SELECT CAST(l AS VARCHAR) AS row, round(p,6) AS "precision", round(r,6) AS recall, round(f,6) AS f1, sup AS support FROM d
    UNION ALL SELECT 'accuracy', round(sum(tp)/sum(sup),6), round(sum(tp)/sum(sup),6), round(sum(tp)/sum(sup),6), CAST(sum(sup) AS BIGINT) FROM d
    UNION ALL SELECT 'macro avg', round(avg(p),6), round(avg(r),6), round(avg(f),6), CAST(sum(sup) AS BIGINT) FROM d
    UNION ALL SELECT 'weighted avg', round(sum(p*sup)/sum(sup),6), round(sum(r*sup)/sum(sup),6), round(sum(f*sup)/sum(sup),6), CAST(sum(sup) AS BIGINT) FROM d""",
)
def agg_class_report(spark, sf):
    counts = evaluation.confusion_counts(_multiclass(spark, sf))
    out = evaluation.class_report(counts, range(11))
    return out.select("row", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "fpr_macro"]


@query(
    "agg_classification_metrics",
    f"""WITH {_EMB_PRED}, {_PER_CLASS} SELECT round(sum(tp)/max(n),6) AS accuracy, round(avg(p),6) AS precision_macro, round(avg(r),6) AS recall_macro,
    round(avg(f),6) AS f1_macro, round(sum(p*sup)/max(n),6) AS precision_weighted, round(sum(r*sup)/max(n),6) AS recall_weighted,
    round(sum(f*sup)/max(n),6) AS f1_weighted, round(avg(fpr),6) AS fpr_macro FROM sc""",
)
def agg_classification_metrics(spark, sf):
    counts = evaluation.confusion_counts(_multiclass(spark, sf))
    out = evaluation.classification_metrics(counts)
    return out.select(*[r6(F.col(c)).alias(c) for c in _METRICS])


@query(
    "agg_fpr",
    f"""WITH {_BIN}, emb AS (SELECT y_true, y_pred FROM bin), {_PER_CLASS}
    SELECT round(avg(fpr),6) AS fpr_macro, round(CASE WHEN count(*)=2 THEN max(fpr) FILTER (l=1) END,6) AS fpr_attack_positive FROM sc""",
)
def agg_fpr(spark, sf):
    out = evaluation.false_positive_rates(evaluation.confusion_counts(_binary(spark, sf)))
    return out.select(*[r6(F.col(c)).alias(c) for c in ("fpr_macro", "fpr_attack_positive")])


def _auc_sql(rows: str, score: str, hit: str, by: str = "") -> str:
    """AUC per group from a grouping by score and a running count of negatives."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}sum(pos*(below+neg/2.0::DOUBLE))/nullif(sum(pos)::DOUBLE*sum(neg)::DOUBLE,0) AS auc FROM (
     SELECT {key}pos, neg, coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::DOUBLE AS below FROM (
      SELECT {key}{score} AS s, count(*) FILTER ({hit}) AS pos, count(*) FILTER (NOT ({hit})) AS neg FROM {rows} GROUP BY {key}{score})) {group}"""


@query("agg_auc", f"WITH {PREDS_CTE} SELECT split, round(auc,6) AS auc FROM ({_auc_sql('preds', 'p_b', 'y_true=1', 'split')})")
def agg_auc(spark, sf):
    out = evaluation.roc_auc(preds(spark, sf), "p_b", by=["split"])
    return out.select("split", r6(F.col("auc")).alias("auc"))


@query(
    "agg_auc_ovr",
    f"""WITH e AS (SELECT vec_id, label, unnest([0,1,2,3,4,5,6,7,8,9]) AS c FROM embeddings),
    s AS (SELECT c, label = c AS hit, CAST((vec_id*31 + c*17) % 101 AS DOUBLE)/101 + CASE WHEN label = c THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score FROM e)
    SELECT round(avg(auc),6) AS auc_ovr_macro FROM ({_auc_sql('s', 'score', 'hit', 'c')})""",
)
def agg_auc_ovr(spark, sf):
    rows = table(spark, sf, "embeddings").selectExpr(
        "label",
        """transform(sequence(0, 9), c -> CAST((vec_id*31 + c*17) % 101 AS DOUBLE)/101
           + CASE WHEN label = c THEN 0.25D ELSE 0.0D END) AS p""",
    )
    out = evaluation.roc_auc_ovr(rows, range(10), "label")
    return out.select(r6(F.col("auc_ovr_macro")).alias("auc_ovr_macro"))


_SET = ["accuracy", "precision_macro", "recall_macro", "f1_weighted", "f1_macro", "fpr", "fnr", "auc"]


def _threshold_sql(rows: str, by: str, score: str = "y_prob") -> str:
    """Binary metric set per group; both classes occur among truths or predictions."""
    return f"""SELECT *, (tp+tn)/n AS accuracy, (p0+p1)/2 AS precision_macro, (r0+r1)/2 AS recall_macro, (f0*(tn+fp)+f1*(tp+fn))/n AS f1_weighted,
    (f0+f1)/2 AS f1_macro, CASE WHEN fp+tn=0 THEN 0 ELSE fp/(fp+tn) END AS fpr, CASE WHEN fn+tp=0 THEN 0 ELSE fn/(fn+tp) END AS fnr FROM (
    SELECT *, tn+fp+fn+tp AS n, CASE WHEN tn+fn=0 THEN 0 ELSE tn/(tn+fn) END AS p0, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END AS p1,
    CASE WHEN tn+fp=0 THEN 0 ELSE tn/(tn+fp) END AS r0, CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END AS r1,
    CASE WHEN 2*tn+fp+fn=0 THEN 0 ELSE 2*tn/(2*tn+fp+fn) END AS f0, CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS f1 FROM (
    SELECT {by}, count(*) FILTER (y_true=0 AND {score}<0.5)::DOUBLE AS tn, count(*) FILTER (y_true=0 AND {score}>=0.5)::DOUBLE AS fp,
    count(*) FILTER (y_true=1 AND {score}<0.5)::DOUBLE AS fn, count(*) FILTER (y_true=1 AND {score}>=0.5)::DOUBLE AS tp FROM {rows} GROUP BY {by}))"""


_ROUNDED = ", ".join(f"round({c},6) AS {c}" for c in _SET) + ", " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tn", "fp", "fn", "tp"))


def _rounded(df, *keys):
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in _SET], "tn", "fp", "fn", "tp")


@query(
    "agg_threshold_metrics",
    f"""WITH {PREDS_CTE}, m AS ({_threshold_sql('preds', 'split', 'p_b')}), a AS ({_auc_sql('preds', 'p_b', 'y_true=1', 'split')})
    SELECT m.split, {_ROUNDED} FROM m JOIN a ON a.split=m.split""",
)
def agg_threshold_metrics(spark, sf):
    return _rounded(evaluation.threshold_metrics(preds(spark, sf), score="p_b", by=["split"]), "split")


@query(
    "agg_label_distribution",
    f"""WITH {SPLIT_CTE} SELECT split, CASE WHEN id % 50 = 7 THEN NULL ELSE attack_cat END AS label, count(*) AS rows FROM prep GROUP BY ALL""",
)
def agg_label_distribution(spark, sf):
    rows = split_flows(spark, sf, "attack_cat", "value")
    return evaluation.label_distribution(
        rows.withColumn("label", F.expr("CASE WHEN id % 50 = 7 THEN NULL ELSE attack_cat END")), "label"
    )


# --- losses -------------------------------------------------------------------

_PT = "CASE WHEN y_true=1 THEN p_b ELSE 1.0::DOUBLE-p_b END"
_W = "CASE WHEN y_true=1 THEN 1.6::DOUBLE ELSE 0.4::DOUBLE END"


def _loss_columns():
    y = F.col("y_true")
    pt = F.when(y == 1, F.col("p_b")).otherwise(1.0 - F.col("p_b"))
    weight = F.when(y == 1, 1.6).otherwise(0.4)
    return pt, weight


@query(
    "loss_cross_entropy",
    f"""WITH {PREDS_CTE}, l AS (SELECT split, -ln(greatest({_PT}, 1e-12::DOUBLE)) AS ce, {_W} AS w FROM preds)
    SELECT round(avg(ce),6) AS plain, round(sum(w*ce)/sum(w),6) AS weighted FROM l""",
)
def loss_cross_entropy(spark, sf):
    pt, weight = _loss_columns()
    rows = preds(spark, sf).select(probability.cross_entropy(pt).alias("ce"), weight.alias("w"))
    plain = evaluation.mean_loss(rows, F.col("ce")).select(r6(F.col("loss_mean")).alias("plain"))
    weighted = evaluation.mean_loss(rows, F.col("ce"), F.col("w")).select("loss_mean").scalar()
    return plain.withColumn("weighted", r6(weighted))


@query(
    "loss_focal",
    f"""WITH {PREDS_CTE}, l AS (SELECT greatest({_PT}, 0.0::DOUBLE) AS pt, -ln(greatest({_PT}, 1e-12::DOUBLE)) AS ce, {_W} AS w FROM preds)
    SELECT round(avg(w*pow(1-pt,2.0)*ce),6) AS weighted_outside, round(avg(pow(1-exp(-w*ce),2.0)*w*ce),6) AS weighted_inside, round(avg(pow(1-pt,2.0)*ce),6) AS plain FROM l""",
)
def loss_focal(spark, sf):
    pt, weight = _loss_columns()
    return preds(spark, sf).agg(
        r6(F.avg(probability.focal(pt, 2.0, weight))).alias("weighted_outside"),
        r6(F.avg(probability.focal_weight_inside(pt, 2.0, weight))).alias("weighted_inside"),
        r6(F.avg(probability.focal(pt, 2.0))).alias("plain"),
    )


# --- refinement ---------------------------------------------------------------


def _sides(spark, sf, split):
    rows = preds(spark, sf).where(F.col("split") == split)
    return (
        rows.select("row_id", "y_true", F.col("p_a").alias("y_prob")),
        rows.select("row_id", "y_true", F.col("p_b").alias("y_prob")),
    )


# Some keys and truths are altered on purpose, so that every kind of mismatch is counted.
_SIDE_A = "SELECT CASE WHEN row_id % 211 = 1 THEN -row_id ELSE row_id END AS row_id, y_true FROM preds"
_SIDE_B = """SELECT CASE WHEN row_id % 173 = 1 THEN -row_id ELSE row_id END AS row_id,
 CASE WHEN row_id % 307 = 2 THEN 1-y_true ELSE y_true END AS y_true FROM preds"""


@query(
    "join_prediction_align",
    f"""WITH {PREDS_CTE}, a AS ({_SIDE_A}), b AS ({_SIDE_B})
    SELECT count(*) FILTER (a.row_id IS NOT NULL AND b.row_id IS NOT NULL) AS matched, count(*) FILTER (b.row_id IS NULL) AS only_first,
    count(*) FILTER (a.row_id IS NULL) AS only_second, count(*) FILTER (a.y_true <> b.y_true) AS y_true_mismatch,
    (SELECT count(DISTINCT row_id) FROM (SELECT row_id, count(*) AS n FROM a GROUP BY row_id UNION ALL SELECT row_id, count(*) FROM b GROUP BY row_id) WHERE n > 1) AS duplicate_keys FROM a FULL JOIN b ON a.row_id=b.row_id""",
)
def join_prediction_align(spark, sf):
    rows = preds(spark, sf)
    sides = [
        spark.sql(side.replace("FROM preds", "FROM {preds}"), preds=rows) for side in (_SIDE_A, _SIDE_B)
    ]
    return refinement.alignment_report(*sides)


_GRID = f"""{PREDS_CTE}, grid AS (SELECT i, i/10.0::DOUBLE AS alpha, y_true, (i/10.0::DOUBLE)*p_a + (1.0::DOUBLE-(i/10.0::DOUBLE))*p_b AS y_prob
 FROM preds, (SELECT CAST(range AS INT) AS i FROM range(11)) WHERE split='val')"""


@query(
    "crossjoin_alpha_grid",
    f"""WITH {_GRID} SELECT round(alpha,1) AS alpha, count(*) AS rows, round(avg(y_prob),6) AS mean_prob, round(max(y_prob),6) AS max_prob FROM grid GROUP BY alpha""",
)
def crossjoin_alpha_grid(spark, sf):
    val = refinement.align_predictions(*_sides(spark, sf, "val"))
    grid = refinement.alpha_grid(val)
    return grid.groupBy(F.round("alpha", 1).alias("alpha")).agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("y_prob")).alias("mean_prob"), r6(F.max("y_prob")).alias("max_prob")
    )


_SEARCH = f"""{_GRID}, m AS ({_threshold_sql('grid', 'alpha')}), a AS ({_auc_sql('grid', 'y_prob', 'y_true=1', 'alpha')}),
 search AS (SELECT m.*, a.auc FROM m JOIN a ON a.alpha=m.alpha)"""


@query("refine_alpha_search", f"WITH {_SEARCH} SELECT round(alpha,1) AS alpha, {_ROUNDED} FROM search")
def refine_alpha_search(spark, sf):
    val = refinement.align_predictions(*_sides(spark, sf, "val"))
    return _rounded(refinement.alpha_search(val), F.round("alpha", 1).alias("alpha"))


@query(
    "refine_select_alpha",
    f"""WITH {_SEARCH} SELECT * FROM (
    SELECT 'f1_macro' AS metric, round(alpha,1) AS alpha, round(f1_macro,6) AS value FROM search ORDER BY f1_macro DESC, alpha LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'fpr', round(alpha,1), round(fpr,6) FROM search ORDER BY fpr, alpha LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'auc', round(alpha,1), round(auc,6) FROM search ORDER BY auc DESC, alpha LIMIT 1)""",
)
def refine_select_alpha(spark, sf):
    from flowmill.session import stage

    val = refinement.align_predictions(*_sides(spark, sf, "val"))
    search = stage(refinement.alpha_search(val), "search")  # three selections read it
    out = None
    for metric in ("f1_macro", "fpr", "auc"):
        part = refinement.select_alpha(search, metric).select(
            F.lit(metric).alias("metric"), F.round("alpha", 1).alias("alpha"), r6(F.col(metric)).alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


_BEST = f"""{_SEARCH}, best AS (SELECT alpha FROM search ORDER BY f1_macro DESC, alpha LIMIT 1),
 tested AS (SELECT 0 AS one, row_id, y_true, best.alpha*p_a + (1.0::DOUBLE-best.alpha)*p_b AS y_prob FROM preds, best WHERE split='test')"""


@query(
    "refine_apply_test",
    f"WITH {_BEST} SELECT row_id, y_true, round(y_prob,6) AS y_prob, CAST(y_prob >= 0.5 AS INT) AS y_pred FROM tested",
)
def refine_apply_test(spark, sf):
    out = refine(*_sides(spark, sf, "val"), *_sides(spark, sf, "test"), check=False)["predictions"]
    return out.select("row_id", "y_true", r6(F.col("y_prob")).alias("y_prob"), "y_pred")


@query(
    "refine_test_metrics",
    f"""WITH {_BEST}, tm AS ({_threshold_sql('tested', 'one')}), ta AS ({_auc_sql('tested', 'y_prob', 'y_true=1', 'one')})
    SELECT {_ROUNDED} FROM tm JOIN ta ON ta.one=tm.one""",
)
def refine_test_metrics(spark, sf):
    return _rounded(refine(*_sides(spark, sf, "val"), *_sides(spark, sf, "test"))["metrics"])


@query("refine_from_files", ORACLES["refine_test_metrics"])
def refine_from_files(spark, sf):
    """Both models' three-column files, written in row order and matched by their places."""
    sides = []
    for split in ("val", "test"):
        for side in _sides(spark, sf, split):
            path = scratch_path(spark, "side")
            placed = side.orderBy("row_id").withColumn("y_pred", probability.at_threshold(F.col("y_prob"), 0.5))
            prediction_files.write_predictions(placed.select("y_true", "y_prob", "y_pred"), path)
            sides.append(prediction_files.read_predictions(spark, path))
    return _rounded(refine(*sides)["metrics"])


# --- leakage audits -----------------------------------------------------------

_KEYS = "coalesce(srcip,'<MISSING>') AS srcip, value_bucket, k"
_GROUPS = f"""{SPLIT_CTE}, grp AS (SELECT value_bucket, k, count(*) FILTER (split='train') AS n_train_rows, count(*) FILTER (split='val') AS n_val_rows,
 count(*) FILTER (split='test') AS n_test_rows, min(y) AS lo, max(y) AS hi, count(*) AS n FROM prep GROUP BY value_bucket, k)"""


def _audited(spark, sf):
    return split_flows(spark, sf, "srcip", "attack_cat", "value_bucket", "k", "y")


@query(
    "audit_duplicates",
    f"WITH {_GROUPS} "
    + " UNION ALL ".join(
        f"""SELECT '{s}' AS split, CAST(sum(n_{s}_rows) AS BIGINT) AS rows, count(*) FILTER (n_{s}_rows>0) AS unique_feature_rows,
        CAST(sum(n_{s}_rows) - count(*) FILTER (n_{s}_rows>0) AS BIGINT) AS duplicate_rows_beyond_first,
        round((sum(n_{s}_rows) - count(*) FILTER (n_{s}_rows>0))/greatest(sum(n_{s}_rows),1)::DOUBLE,6) AS duplicate_fraction FROM grp"""
        for s in ("train", "val", "test")
    ),
)
def audit_duplicates(spark, sf):
    groups = audit.feature_groups(_audited(spark, sf), ["value_bucket", "k"])
    out = audit.duplicate_summary(groups)
    return out.withColumn("duplicate_fraction", r6(F.col("duplicate_fraction")))


def _overlap_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS first_split, '{b}' AS second_split, count(*) FILTER (n_{a}_rows>0 AND n_{b}_rows>0) AS common_unique,
        CAST(coalesce(sum(n_{a}_rows) FILTER (n_{b}_rows>0),0) AS BIGINT) AS rows_first, CAST(coalesce(sum(n_{b}_rows) FILTER (n_{a}_rows>0),0) AS BIGINT) AS rows_second,
        round(coalesce(sum(n_{a}_rows) FILTER (n_{b}_rows>0),0)/greatest(sum(n_{a}_rows),1)::DOUBLE,6) AS fraction_first,
        round(coalesce(sum(n_{b}_rows) FILTER (n_{a}_rows>0),0)/greatest(sum(n_{b}_rows),1)::DOUBLE,6) AS fraction_second FROM {table}"""
        for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
    )


def _rounded_overlap(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("fraction_first", "fraction_second")})


@query("audit_cross_overlap", f"WITH {_GROUPS} {_overlap_sql('grp')}")
def audit_cross_overlap(spark, sf):
    return _rounded_overlap(audit.overlap_summary(audit.feature_groups(_audited(spark, sf), ["value_bucket", "k"])))


@query(
    "audit_label_conflicts",
    f"""WITH {_GROUPS} SELECT count(*) FILTER (n>1 AND lo<>hi) AS conflicting_feature_rows,
    CAST(coalesce(sum(n) FILTER (n>1 AND lo<>hi),0) AS BIGINT) AS rows_in_conflict FROM grp""",
)
def audit_label_conflicts(spark, sf):
    return audit.label_conflicts(audit.feature_groups(_audited(spark, sf), ["value_bucket", "k"], "y"))


@query(
    "semijoin_overlap",
    f"""WITH {SPLIT_CTE} SELECT id FROM prep WHERE split='train' AND (value_bucket, k) IN (SELECT (value_bucket, k) FROM prep WHERE split='test')""",
)
def semijoin_overlap(spark, sf):
    rows = _audited(spark, sf)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    return audit.overlapping_rows(train, test, ["value_bucket", "k"]).select("id")


_SESSION = ["srcip AS srcip", "attack_cat AS dst_ip", "k AS sport", "CAST(value_bucket AS STRING) AS proto"]


@query(
    "audit_session_overlap",
    f"""WITH {SPLIT_CTE}, ses AS (SELECT srcip, attack_cat, k, value_bucket, count(*) FILTER (split='train') AS n_train_rows, count(*) FILTER (split='val') AS n_val_rows,
    count(*) FILTER (split='test') AS n_test_rows FROM prep GROUP BY ALL) {_overlap_sql('ses')}""",
)
def audit_session_overlap(spark, sf):
    rows = _audited(spark, sf).selectExpr("split", *_SESSION)
    return _rounded_overlap(audit.session_overlap(rows))


@query(
    "session_columns",
    f"""WITH {FLOWS_CTE} SELECT 'srcip' AS "column", true AS in_key, count(srcip) AS filled_rows, count(DISTINCT srcip) AS distinct_values FROM flows
    UNION ALL SELECT 'dst_ip', true, count(attack_cat), count(DISTINCT attack_cat) FROM flows
    UNION ALL SELECT 'sport', true, count(k), count(DISTINCT k) FROM flows
    UNION ALL SELECT 'proto', true, count(value_bucket), count(DISTINCT value_bucket) FROM flows
    UNION ALL SELECT 'Time', false, count(value), count(DISTINCT value) FROM flows""",
)
def session_columns(spark, sf):
    rows = flows(spark, sf).selectExpr("id", *_SESSION, "value AS Time", "y")
    return audit.session_inventory(rows)


@query(
    "audit_category_purity",
    f"""WITH {FLOWS_CTE}, c AS (SELECT coalesce(CASE WHEN id % 31 = 2 THEN NULL ELSE value_txt END,'<MISSING>') AS category, count(*) FILTER (y=0) AS benign, count(*) FILTER (y=1) AS attack FROM flows GROUP BY 1)
    SELECT category, benign, attack, round((SELECT sum(greatest(benign,attack))/sum(benign+attack)::DOUBLE FROM c),6) AS majority_accuracy, (SELECT count(*) FROM c) AS categories FROM c""",
)
def audit_category_purity(spark, sf):
    rows = flows(spark, sf).withColumn("cat", F.expr("CASE WHEN id % 31 = 2 THEN NULL ELSE value_txt END"))
    by_category, purity = audit.category_purity(rows, "cat", "y")
    one = purity.select(F.struct(r6(F.col("majority_accuracy")).alias("a"), F.col("categories").alias("c"))).scalar()
    return by_category.withColumn("__p", one).select(
        "category", "benign", "attack",
        F.col("__p.a").alias("majority_accuracy"), F.col("__p.c").alias("categories"),
    )


@query(
    "audit_adjacent_dependence",
    f"""WITH {SPLIT_CTE}, p AS (SELECT split, y::DOUBLE AS y, lag(y::DOUBLE) OVER (PARTITION BY split ORDER BY split_idx) AS x FROM prep)
    SELECT split, round(avg(CAST(x=y AS INT)),6) AS adjacent_label_agreement, round(corr(x,y),6) AS lag1_label_correlation FROM p WHERE x IS NOT NULL GROUP BY split""",
)
def audit_adjacent_dependence(spark, sf):
    rows = split_flows(spark, sf, "y")
    out = audit.dependence_of(rows.selectExpr("split", "CAST(y AS DOUBLE) AS y", "split_idx"), "split_idx")
    return out.select("split", *[r6(F.col(c)).alias(c) for c in ("adjacent_label_agreement", "lag1_label_correlation")])
