"""Exact classification metrics over prediction tables.

Every metric starts from counts that combine on the map side; the tables that leave
the first aggregation have one row per (class, class) or per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.numeric import ratio
from flowmill.functions.probability import at_threshold
from flowmill.operators.ordering import join_on, rank_totals

_EPS = 1e-12


def label_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per split and label; a missing label is counted as its own group."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))


# --- confusion counts ---------------------------------------------------------


def confusion_counts(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, labels: Sequence[int], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Dense (y_true, y_pred, n) over the given labels, zeros kept."""
    listed = F.lit([int(x) for x in labels])
    grid = (
        df.sparkSession.range(0, 1, 1, 1)
        .select(F.explode(listed).alias("y_true"))
        .select("y_true", F.explode(listed).alias("y_pred"))
    )
    return grid.join(confusion_counts(df, y_true, y_pred), ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_pivot(long: DataFrame, labels: Sequence[int]) -> DataFrame:
    """One row per true class, one ``pred_<label>`` column per predicted class."""
    return long.groupBy("y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == x, F.col("n")).otherwise(0)).alias(f"pred_{x}") for x in labels]
    )


def class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, support, predicted, total) from confusion counts.

    A label that occurs only among the predictions has support 0, and the reverse.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"), hit.alias("tp"),
            F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
        ),
    )
    per_class = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    # a table of (group, class) counts: K rows per group
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return per_class.withColumn("total", F.sum("support").over(everything))


def _with_scores(per_class: DataFrame) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    fp = F.col("predicted") - F.col("tp")
    tn = F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")
    return (
        per_class.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            ratio(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted")),
        )
        .withColumn("fpr", fp / (fp + tn + F.lit(_EPS)))
    )


def classification_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted precision / recall / F1 and macro FPR, one row per group.

    Averages run over the labels that occur among the truths or the predictions.
    """
    scored = _with_scores(class_counts(counts, by))
    weight = F.col("support") / F.col("total")
    return scored.groupBy(*by).agg(
        (F.sum("tp") / F.max("total")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.sum(F.col("precision") * weight).alias("precision_weighted"),
        F.sum(F.col("recall") * weight).alias("recall_weighted"),
        F.sum(F.col("f1") * weight).alias("f1_weighted"),
        F.avg("fpr").alias("fpr_macro"),
    )


def false_positive_rates(
    counts: DataFrame, attack: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    """(fpr_macro, fpr_attack_positive); the latter only when exactly two labels occur."""
    scored = _with_scores(class_counts(counts, by))
    return scored.groupBy(*by).agg(
        F.avg("fpr").alias("fpr_macro"),
        F.when(
            F.count(F.lit(1)) == 2, F.max(F.when(F.col("label") == attack, F.col("fpr")))
        ).alias("fpr_attack_positive"),
    )


def class_report(counts: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted rows."""
    present = _with_scores(class_counts(counts))
    wanted = counts.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.lit([int(x) for x in labels])).alias("label")
    )
    cols = ["precision", "recall", "f1", "support"]
    per_class = wanted.join(present, "label", "left").select(
        F.col("label").cast("string").alias("row"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in cols],
        F.coalesce("tp", F.lit(0)).alias("tp"),
    )
    share = ratio(F.col("support"), F.lit(1))
    total = F.sum("support")
    summary = per_class.agg(
        ratio(F.sum("tp"), total).alias("acc"),
        total.alias("n"),
        *[F.avg(c).alias(f"macro_{c}") for c in cols[:3]],
        *[ratio(F.sum(F.col(c) * share), total).alias(f"weighted_{c}") for c in cols[:3]],
    )
    lines = F.array(
        F.struct(
            F.lit("accuracy").alias("row"),
            *[F.col("acc").alias(c) for c in cols[:3]], F.col("n").alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("row"),
            *[F.col(f"macro_{c}").alias(c) for c in cols[:3]], F.col("n").alias("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("row"),
            *[F.col(f"weighted_{c}").alias(c) for c in cols[:3]], F.col("n").alias("support"),
        ),
    )
    return per_class.select("row", *cols).unionByName(summary.select(F.inline(lines)))


# --- ranking ------------------------------------------------------------------


def roc_auc(
    df: DataFrame,
    score: str = "y_prob",
    positive: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact ROC AUC, ties at half; null when only one class occurs.

    Rows without a truth or a score are left out, here as in :func:`threshold_metrics`.
    """
    hit = F.col("y_true") == 1 if positive is None else positive
    totals = rank_totals(
        df.where(hit.isNotNull() & F.col(score).isNotNull()), by, score, hits=hit.cast("int"), mass=F.when(hit, 0).otherwise(1)
    )
    return _auc_of(totals, by)


def _auc_of(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    return totals.select(
        *by, F.try_divide(F.col("below"), F.col("hits") * F.col("mass")).alias("auc")
    )


def roc_auc_ovr(
    df: DataFrame, classes: Sequence[int], y_true: str = "y_true", p: str = "p"
) -> DataFrame:
    """Unweighted mean of the one-vs-rest AUC of each class; null if any is undefined."""
    cells = F.array(
        *[
            F.struct(
                F.lit(int(c)).alias("class"),
                F.get(F.col(p), F.lit(i)).alias("score"),
                (F.col(y_true) == c).alias("hit"),
            )
            for i, c in enumerate(classes)
        ]
    )
    long = df.select(F.inline(cells))
    per_class = roc_auc(long, "score", F.col("hit"), ["class"])
    return per_class.agg(
        F.when(F.count("auc") == len(list(classes)), F.avg("auc")).alias("auc_ovr_macro")
    )


# --- threshold metrics --------------------------------------------------------


def threshold_metrics(
    df: DataFrame,
    threshold: float = 0.5,
    score: str = "y_prob",
    y_true: str = "y_true",
    by: Sequence[str] = (),
    with_auc: bool = True,
) -> DataFrame:
    """The binary metric set at a threshold, one row per group.

    ``fpr`` is FP / (FP + TN). ``fnr`` is FN / (FN + TP), which some reports label
    "attack-as-positive FPR".
    """
    truth = F.col(y_true) == 1
    df = df.where(truth.isNotNull() & F.col(score).isNotNull())
    if with_auc:
        # one grouping by score serves both the counts and the ranking
        scores = df.groupBy(*by, F.col(score).alias("__score")).agg(
            F.count_if(truth).alias("__pos"), F.count_if(~truth).alias("__neg")
        )
    else:
        scores = df.select(
            *by, F.col(score).alias("__score"),
            truth.cast("bigint").alias("__pos"), (~truth).cast("bigint").alias("__neg"),
        )
    above = at_threshold(F.col("__score"), threshold) == 1

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    cells = scores.groupBy(*by).agg(
        total("__neg", ~above).alias("tn"),
        total("__neg", above).alias("fp"),
        total("__pos", ~above).alias("fn"),
        total("__pos", above).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    seen0, seen1 = (tn + fp + fn > 0).cast("int"), (tp + fp + fn > 0).cast("int")
    f1_0, f1_1 = ratio(F.lit(2) * tn, F.lit(2) * tn + fp + fn), ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)

    def macro(zero: Column, one: Column) -> Column:
        return ratio(zero + one, seen0 + seen1)

    out = cells.select(
        *by,
        ratio(tp + tn, n).alias("accuracy"),
        macro(ratio(tn, tn + fn), ratio(tp, tp + fp)).alias("precision_macro"),
        macro(ratio(tn, tn + fp), ratio(tp, tp + fn)).alias("recall_macro"),
        ratio(f1_0 * (tn + fp) + f1_1 * (tp + fn), n).alias("f1_weighted"),
        macro(f1_0, f1_1).alias("f1_macro"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, fn + tp).alias("fnr"),
        F.lit(float(threshold)).alias("threshold"),
        "tn", "fp", "fn", "tp",
    )
    if not with_auc:
        return out
    auc = _auc_of(rank_totals(scores, by, "__score", F.col("__pos"), F.col("__neg")), by)
    if by:
        return join_on(out, auc, list(by), "left")
    return out.withColumn("auc", auc.select("auc").scalar())


# --- losses -------------------------------------------------------------------


def mean_loss(df: DataFrame, loss: Column, weight: Column | None = None) -> DataFrame:
    """(loss_mean, loss_sum); with a weight the mean is sum(w * loss) / sum(w)."""
    if weight is None:
        return df.agg(F.avg(loss).alias("loss_mean"), F.sum(loss).alias("loss_sum"))
    return df.agg(
        F.try_divide(F.sum(weight * loss), F.sum(weight)).alias("loss_mean"),
        F.sum(weight * loss).alias("loss_sum"),
    )
