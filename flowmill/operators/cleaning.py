"""Column and row cleaning before any fitted step."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.numeric import INFINITY_TEXTS, finite, to_number

# Columns that reveal the label, per family and protocol.
_LABEL = {"unsw": "label", "cic": "Label", "nsl": "label"}
_PROTOCOL_DROPS = {
    "clean": ["attack_cat", "id"],
    "attack_cat": ["id"],
    "id": ["attack_cat"],
    "both": [],
}


def label_column(family: str) -> str:
    return _LABEL[family]


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim header names and remove a byte-order mark."""
    return df.toDF(*[c.strip().replace("﻿", "") for c in df.columns])


def null_invalid(df: DataFrame) -> DataFrame:
    """NaN, infinities and the infinity texts become null."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        elif isinstance(field.dataType, T.StringType):
            c = F.when(c.isin(INFINITY_TEXTS), None).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def clean_drop_invalid(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop every row with a null, NaN or infinite value; ``keep`` columns are not tested."""
    tested = [c for c in df.columns if c not in set(keep)]
    return null_invalid(df).dropna("any", subset=tested)


def features_for_protocol(df: DataFrame, family: str, protocol: str = "clean") -> DataFrame:
    """Drop the label and whatever the leakage protocol forbids as a feature."""
    drops = [_LABEL[family]]
    if family == "nsl":
        drops.append("difficulty")
    elif family == "unsw":
        if protocol not in _PROTOCOL_DROPS:
            raise ValueError(f"unknown leakage protocol: {protocol}")
        drops += _PROTOCOL_DROPS[protocol]
    return df.drop(*drops)


def features_for_task(df: DataFrame, family: str, label: str, task: str) -> DataFrame:
    """Drop the label, the row id and the other label column for a binary or multiclass task."""
    drops = [label]
    if family == "unsw":
        drops += ["id", {"binary": "attack_cat", "multiclass": "label"}[task]]
    elif family == "nsl":
        drops.append("difficulty")
    return df.drop(*drops)


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def align_schema(df: DataFrame, columns: Sequence[str], fill: float | None = None) -> DataFrame:
    """Project to the training columns; a missing one is filled, extras are dropped."""
    have = set(df.columns)
    filler = F.lit(fill).cast("double")
    return df.select(*[F.col(f"`{c}`") if c in have else filler.alias(c) for c in columns])
