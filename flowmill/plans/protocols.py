"""From the files of a flow-record family to a split table and its prepared windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.labels import binary_flag
from flowmill.functions.paths import weekday_rank
from flowmill.operators.cleaning import features_for_protocol, label_column
from flowmill.operators.ordering import row_index_within
from flowmill.operators.splits import split_day_holdout, split_ordered_tail, split_sequential
from flowmill.plans.prepare import Prepared, prepare
from flowmill.sources.flows import (
    ORDER_COLUMNS, chronological_rank, number_records, read_fixed_schema, read_multi_file, read_train_test,
)

POLICIES = ("default", "ordered", "day_holdout")


def load_splits(
    spark: SparkSession,
    family: str,
    paths: Sequence[str],
    val_ratio: float = 0.15,
    policy: str = "default",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Clean rows with ``split`` and the position ``split_idx`` inside it.

    ``unsw`` and ``nsl`` take (train file, test file): validation is the tail of the official
    training file. ``cic`` takes its day files: by default one sequential split over the files
    in alphabetical order, or a holdout by weekday in chronological order. ``ordered`` is
    accepted as another name of the default.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown split policy: {policy}")
    if family == "cic":
        holdout = policy == "day_holdout"
        rows = read_multi_file(spark, paths, schema, per_file_clean=holdout)
        if not holdout:
            return split_sequential(number_records(rows), val_ratio).drop(*ORDER_COLUMNS)
        ranked = chronological_rank(
            rows.withColumn("__name", F.lower(F.element_at(F.split("_file", "/"), -1))), "__name"
        )
        held = split_day_holdout(ranked, weekday_rank(F.col("__name")))
        order = ["day_rank", "half_day", "__name", *ORDER_COLUMNS]
        return row_index_within(held, ["split"], order, "split_idx", unique=True).drop(*order)
    if policy == "day_holdout":
        raise ValueError("the day holdout needs day files")
    train, test = paths
    read = {"unsw": read_train_test, "nsl": read_fixed_schema}[family]
    rows = read(spark, train, test, schema)
    parts = [
        number_records(rows.where(F.col("part") == part).drop("part"))
        for part in ("train", "test")
    ]
    return split_ordered_tail(parts[0], parts[1], val_ratio).drop(*ORDER_COLUMNS)


def prepare_family(
    split_rows: DataFrame, family: str, protocol: str = "clean", **options
) -> Prepared:
    """Label, feature choice by leakage protocol and train-only preparation of a split table."""
    keep = ("split", "split_idx", "row_idx", "y")
    labelled = split_rows.withColumn("y", binary_flag(F.col(label_column(family)), family))
    chosen = features_for_protocol(labelled, family, protocol)
    return prepare(labelled, [c for c in chosen.columns if c not in keep], **options)
