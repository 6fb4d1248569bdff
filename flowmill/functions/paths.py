"""Expressions over run paths, file names and metric documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday tokens in file names, in rank order.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
UNKNOWN_DAY = 99
# Keys under which a metrics document may hold macro F1, first match wins.
MACRO_F1_KEYS = [
    "f1_macro",
    "macro_f1",
    "macro_f1_score",
    "macro avg/f1-score",
    "macro_avg_f1",
    "macro_f1_test",
]


def weekday_rank(file_name: Column) -> Column:
    low = F.lower(file_name)
    out = F.when(low.contains(WEEKDAYS[0]), 0)
    for rank, token in enumerate(WEEKDAYS[1:], start=1):
        out = out.when(low.contains(token), rank)
    return out.otherwise(UNKNOWN_DAY)


def half_day_rank(file_name: Column) -> Column:
    """0 for morning or no token, 1 for afternoon."""
    low = F.lower(file_name)
    return (low.contains("afternoon") & ~low.contains("morning")).cast("int")


def path_part(path: Column, index: int) -> Column:
    """0-based part of a relative path, null when absent."""
    return F.get(F.split(path, "/"), F.lit(index))


def value_token(value: Column) -> Column:
    """A parameter value as it is spelled in a path: 0.5 -> 0p5."""
    return F.replace(value.cast("string"), F.lit("."), F.lit("p"))


def macro_f1(document: Column, strict: bool = False) -> Column:
    """Macro F1 of a JSON metrics document: the first key present, else the nested average."""
    found = [F.get_json_object(document, f"$['{key}']") for key in MACRO_F1_KEYS]
    nested = F.get_json_object(document, "$['macro avg']['f1-score']")
    value = F.coalesce(*found, nested).try_cast("double")
    if not strict:
        return value
    return F.coalesce(value, F.raise_error(F.lit("no macro F1 in document")).cast("double"))
