"""Choose a blending weight on validation, apply it once to test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowmill.operators.evaluation import threshold_metrics
from flowmill.operators.refinement import (
    DEFAULT_GRID, align_predictions, alignment_report, alpha_search, apply_alpha, select_alpha,
)
from flowmill.session import stage


def refine(
    val_a: DataFrame, val_b: DataFrame, test_a: DataFrame, test_b: DataFrame,
    alphas: Sequence[float] = tuple(DEFAULT_GRID), metric: str = "f1_macro",
    threshold: float = 0.5, key: str = "row_id", check: bool = True, search_auc: bool = False,
) -> dict[str, DataFrame]:
    """Tables ``search``, ``best``, ``predictions`` and ``metrics`` of the refinement.

    The AUC of every candidate weight takes a sort of all scores under every weight, so ``search``
    has it only if it is the metric or ``search_auc`` asks for it.
    """
    if check:
        alignment_report(val_a, val_b, key, strict=True)
        alignment_report(test_a, test_b, key, strict=True)
    rows = align_predictions(val_a, val_b, key)
    search = stage(alpha_search(rows, alphas, threshold, search_auc or metric == "auc"), "search")
    best = select_alpha(search, metric)
    predictions = apply_alpha(align_predictions(test_a, test_b, key), best, threshold)
    return {
        "search": search,
        "best": best,
        "predictions": predictions,
        "metrics": threshold_metrics(predictions, threshold),
    }
