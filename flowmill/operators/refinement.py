"""Blending two models' probabilities with a weight chosen on validation only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.probability import at_threshold
from flowmill.operators.evaluation import threshold_metrics

DEFAULT_GRID = [i / 10 for i in range(11)]
# Metrics for which a smaller value is better.
LOWER_IS_BETTER = ("fpr", "fnr")
SELECTABLE = (
    "accuracy", "precision_macro", "recall_macro", "f1_weighted", "f1_macro", "fpr", "fnr", "auc",
)


def align_predictions(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Both models' rows side by side, matched by key: (key, y_true, p_a, p_b)."""
    right = b.select(
        F.col(key).alias("__key"), F.col("y_true").alias("__y"), F.col("y_prob").alias("p_b")
    )
    return a.select(key, "y_true", F.col("y_prob").alias("p_a")).join(
        right, (F.col(key) == F.col("__key")) & (F.col("y_true") == F.col("__y"))
    ).drop("__key", "__y")


def alignment_report(
    a: DataFrame, b: DataFrame, key: str = "row_id", strict: bool = False
) -> DataFrame:
    """Counts of keys on both sides or on one only, with differing truths, and repeated keys.

    Each side is reduced to one row per key before they meet, so repeated keys do not multiply;
    ``align_predictions`` needs unique ones, and ``strict`` refuses repeated keys as well as any
    misalignment.
    """
    if strict:
        for name, side in (("first", a), ("second", b)):
            repeated = side.groupBy(key).count().where("count > 1").limit(1).collect()
            if repeated:
                raise ValueError(f"the {name} prediction table repeats the key {repeated[0][0]!r}")

    def per_key(side: DataFrame, tag: str) -> DataFrame:
        rows = side.groupBy(F.col(key).alias(f"__k{tag}"))
        return rows.agg(
            F.count(F.lit(1)).alias(f"__n{tag}"), F.min("y_true").alias(f"__lo{tag}"), F.max("y_true").alias(f"__hi{tag}")
        )

    both = F.col("__na").isNotNull() & F.col("__nb").isNotNull()
    same = F.col("__loa").eqNullSafe(F.col("__lob")) & F.col("__hia").eqNullSafe(F.col("__hib"))
    report = per_key(a, "a").join(per_key(b, "b"), F.col("__ka") == F.col("__kb"), "full_outer").agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("__nb").isNull()).alias("only_first"),
        F.count_if(F.col("__na").isNull()).alias("only_second"),
        F.count_if(both & ~same).alias("y_true_mismatch"),
        F.count_if((F.coalesce("__na", F.lit(0)) > 1) | (F.coalesce("__nb", F.lit(0)) > 1)).alias("duplicate_keys"),
    )
    if strict:
        r = report.first()
        if r["only_first"] or r["only_second"] or r["y_true_mismatch"]:
            raise ValueError(f"prediction tables are not aligned: {r.asDict()}")
    return report


def blend(df: DataFrame, alpha, p_a: str = "p_a", p_b: str = "p_b", out: str = "y_prob") -> DataFrame:
    """alpha * p_a + (1 - alpha) * p_b."""
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return df.withColumn(out, a * F.col(p_a) + (F.lit(1.0) - a) * F.col(p_b))


def alpha_grid(
    df: DataFrame, alphas: Sequence[float] = tuple(DEFAULT_GRID), p_a: str = "p_a", p_b: str = "p_b"
) -> DataFrame:
    """Every row under every candidate weight: (alpha, grid_pos, y_true, y_prob).

    The candidates are a literal list, so this is a narrow projection; whatever
    aggregates it by weight combines on the map side.
    """
    rows = df.select(
        "y_true", p_a, p_b, F.posexplode(F.lit([float(x) for x in alphas])).alias("grid_pos", "alpha")
    )
    return blend(rows, F.col("alpha"), p_a, p_b).select("alpha", "grid_pos", "y_true", "y_prob")


def alpha_search(
    validation: DataFrame,
    alphas: Sequence[float] = tuple(DEFAULT_GRID),
    threshold: float = 0.5,
    with_auc: bool = True,
) -> DataFrame:
    """The metric set of every candidate weight on validation rows."""
    grid = alpha_grid(validation, alphas)
    return threshold_metrics(
        grid, threshold, by=["grid_pos", "alpha"], with_auc=with_auc
    ).withColumn("alpha_other", F.lit(1.0) - F.col("alpha"))


def select_alpha(search: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """The best weight; the first one listed wins a tie, undefined values are skipped."""
    if metric not in SELECTABLE:
        raise ValueError(f"cannot select by {metric}")
    direction = F.asc(metric) if metric in LOWER_IS_BETTER else F.desc(metric)
    # one row per candidate weight
    best_first = Window.partitionBy(F.lit(0)).orderBy(direction, "grid_pos")
    return (
        search.where(F.col(metric).isNotNull())
        .withColumn("__rank", F.row_number().over(best_first))
        .where("__rank = 1")
        .drop("__rank")
    )


def apply_alpha(
    test: DataFrame, best: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """Test rows with the chosen weight's probability and prediction."""
    alpha = best.select("alpha").scalar()
    return blend(test.withColumn("alpha", alpha), F.col("alpha")).withColumn(
        "y_pred", at_threshold(F.col("y_prob"), threshold)
    )
