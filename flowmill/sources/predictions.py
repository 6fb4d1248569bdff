"""Prediction tables: (row key), y_true, y_prob, y_pred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.operators.ordering import row_index
from flowmill.sources.flows import ORDER_COLUMNS, order_columns

REQUIRED = ("y_true", "y_prob")


def validate_predictions(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row of checks: rows, classes, probability range, unparsable cells and ``valid``."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"prediction table lacks {missing}")
    typed = df.select(
        F.col("y_true").try_cast("int").alias("y_true"),
        F.col("y_prob").try_cast("double").alias("y_prob"),
    )
    report = typed.agg(
        F.count(F.lit(1)).alias("rows"),
        # distinct labels combine per task; their number is what a label column has, not rows
        F.count_distinct("y_true").alias("classes"),
        F.count_if(F.col("y_true").isNull() | F.col("y_prob").isNull()).alias("unreadable"),
        F.min("y_prob").alias("min_prob"),
        F.max("y_prob").alias("max_prob"),
    )
    report = report.withColumn(
        "valid",
        (F.col("classes") >= 2)
        & (F.col("unreadable") == 0)
        & F.coalesce((F.col("min_prob") >= 0) & (F.col("max_prob") <= 1), F.lit(False)),
    )
    if strict:
        found = report.first()
        if not found["valid"]:
            raise ValueError(f"invalid prediction table: {found.asDict()}")
    return report


def read_predictions(
    spark: SparkSession, path: str, key: str | None = "row_id", fmt: str = "csv", strict: bool = True
) -> DataFrame:
    """Read, check and type a prediction table.

    A table without the key column gets it from the place of its rows: 0, 1, ... in order of file
    name and place in the file, so tables of equal length match row by row. ``key=None`` adds none.
    """
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    names = [c.replace("\ufeff", "") for c in raw.columns]
    if key and key not in names:
        placed = raw.select("*", *order_columns()).toDF(*names, *ORDER_COLUMNS)
        raw = row_index(placed, ORDER_COLUMNS, key, unique=True).df
    else:
        raw = raw.toDF(*names)
    if strict:
        validate_predictions(raw, strict=True)
    keys = [F.col(key).cast("bigint").alias(key)] if key else []
    rest = [F.col("y_pred").cast("int")] if "y_pred" in raw.columns else []
    return raw.select(
        *keys, F.col("y_true").cast("int"), F.col("y_prob").cast("double"), *rest
    )


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write the table as CSV with a header, or as compressed Parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)
