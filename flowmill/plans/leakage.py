"""The whole leakage audit of a split table as a set of tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowmill.operators.audit import (
    category_purity, dependence_of, duplicate_summary, feature_groups, label_conflicts,
    overlap_summary, session_overlap,
)
from flowmill.operators.sequence import window_dependence
from flowmill.session import stage


def audit(
    df: DataFrame, features: Sequence[str], label: str = "y", category: str | None = None,
    seq_len: int = 16, stride: int = 1, idx: str = "split_idx",
) -> dict[str, DataFrame]:
    """Audit tables by name for rows with ``split`` and a dense position ``idx``.

    Duplicates, overlap and conflicts share one grouping by the feature row, staged because
    three summaries read it.
    """
    groups = stage(feature_groups(df, features, label), "feature-groups")
    ordered = df.selectExpr("split", f"CAST(`{label}` AS DOUBLE) AS y", f"`{idx}` AS __i")
    tables = {
        "duplicates": duplicate_summary(groups),
        "overlap": overlap_summary(groups),
        "conflicts": label_conflicts(groups),
        "order": dependence_of(ordered, "__i"),
        "windows": window_dependence(df, seq_len, stride, idx=idx),
    }
    sessions = session_overlap(df)
    if sessions is not None:
        tables["sessions"] = sessions
    if category is not None:
        tables["category"], tables["purity"] = category_purity(df, category, label)
    return tables
