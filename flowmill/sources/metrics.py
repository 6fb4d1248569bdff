"""Run-metric records, efficiency records and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.paths import path_part

# Fields of a run-metric record.
METRIC_SCHEMA = """
accuracy DOUBLE, precision_macro DOUBLE, recall_macro DOUBLE, f1_macro DOUBLE,
precision_weighted DOUBLE, recall_weighted DOUBLE, f1_weighted DOUBLE, fpr_macro DOUBLE,
fpr_attack_positive DOUBLE, auc DOUBLE, auc_attack_positive DOUBLE, loss DOUBLE, seed INT,
seq_len INT, model STRING, variant STRING, dataset STRING, leakage_protocol STRING,
split_policy STRING, record_order STRING, training_seconds DOUBLE, hidden_channels INT,
focal_gamma DOUBLE, dropout DOUBLE, learning_rate DOUBLE
"""

# Layouts in which a run's record may lie below its base, best first.
RECORD_LAYOUTS = [
    "{name}", "{name}_fixed", "baselines/{name}", "baseline/{name}", "ablation/{name}",
    "ablations/{name}", "ablation/{name}_fixed", "ablations/{name}_fixed",
]
# Path fragments that mark a derived or temporary result.
SIDE_RESULTS = ["dr", "decision", "tmp"]


def _with_location(df: DataFrame, root: str, path: Column) -> DataFrame:
    marker = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    relative = F.regexp_replace(
        F.url_decode(F.element_at(F.split(path, F.concat(F.lit(r"\Q"), F.lit(marker), F.lit(r"\E/")), 2), -1)),
        "^/+", "",
    )
    return df.withColumn("relative_path", relative).withColumn(
        "family", path_part(F.col("relative_path"), 0)
    )


def read_run_metrics(
    spark: SparkSession, root: str, name: str = "metrics.json", schema: str | T.StructType = METRIC_SCHEMA,
    multi_line: bool = True,
) -> DataFrame:
    """Every record below ``root``; unreadable files are skipped.

    Only broken JSON is unreadable: scalar fields are read as text and then cast, so a number
    written as text counts and a value of another kind is null in an otherwise whole record.
    Adds ``relative_path`` and ``family``, the first part of it.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    nested = (T.StructType, T.ArrayType, T.MapType)
    read_as = [f if isinstance(f.dataType, nested) else T.StructField(f.name, T.StringType()) for f in fields.fields]
    with_bad = T.StructType([*read_as, T.StructField("_bad", T.StringType())])
    raw = (
        spark.read.schema(with_bad)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(root)
    )
    good = raw.select("*", F.col("_metadata.file_path").alias("__path")).where("_bad IS NULL")
    cells = [
        F.col(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
        for f in fields.fields
    ]
    return _with_location(good.select(*cells, "__path"), root, F.col("__path")).drop("__path")


# The number literals of some JSON writers that are no JSON.
_NO_NUMBER = r"(?<=[:\[,\s])-?(NaN|Infinity)(?=\s*[,\]}])"


def parse_records(texts: DataFrame, column: str = "value") -> DataFrame:
    """``texts`` with each JSON object as a VARIANT in ``record``; other texts are left out.

    A variant has no schema, so one odd field does not spoil its record. NaN and infinities written
    as bare words count as null.
    """
    plain = F.regexp_replace(column, "^\ufeff", "")
    repaired = F.regexp_replace(plain, _NO_NUMBER, "null")
    parsed = texts.withColumn("record", F.coalesce(F.try_parse_json(plain), F.try_parse_json(repaired)))
    return parsed.where(F.schema_of_variant("record").startswith("OBJECT")).drop(column)


def variant_schema(records: DataFrame, column: str = "record") -> T.StructType:
    """The union of the fields of all records; a field of several kinds is text."""
    found = records.agg(F.schema_of_variant_agg(column)).first()[0] or ""
    if not found.startswith("OBJECT<"):
        return T.StructType([])
    return _plain_kinds(T.StructType.fromDDL(found.replace("OBJECT<", "STRUCT<")[len("STRUCT<") : -1]))


def _plain_kinds(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain_kinds(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain_kinds(dtype.elementType))
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(dtype, (T.VariantType, T.NullType)) else dtype


def variant_fields(record: str, schema: T.StructType, flatten: Sequence[str] = (), depth: int = 2) -> list[Column]:
    """A column per field, read one by one: a value that does not fit its type is null, no other is lost.

    Objects named in ``flatten`` become ``name_key`` and ``name_key_subkey`` columns.
    """

    def step(name: str) -> str:
        quote = '"' if "'" in name else "'"
        return f"[{quote}{name}{quote}]"

    def leaves(dtype: T.DataType, path: str, name: str, level: int) -> list[Column]:
        if isinstance(dtype, T.StructType) and level < depth:
            return [leaf for f in dtype.fields for leaf in leaves(f.dataType, path + step(f.name), f"{name}_{f.name}", level + 1)]
        return [F.try_variant_get(record, path, dtype.simpleString()).alias(name)]

    return [leaf for f in schema.fields for leaf in leaves(f.dataType, "$" + step(f.name), f.name, 0 if f.name in flatten else depth)]


def read_efficiency(
    spark: SparkSession, root: str, name: str = "efficiency.json",
    schema: str | T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """Efficiency records below ``root`` with the nested ``inference`` object flattened.

    Records of different models have different fields; without a schema their union is found in one
    aggregation. Only texts that are no JSON object are skipped: a field of another kind than its
    column is null, or makes the column text where no schema is given. Adds ``relative_path`` and ``family``.
    """
    texts = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .text(root, wholetext=multi_line)
    )
    parsed = parse_records(texts.select("value", F.col("_metadata.file_path").alias("__path")))
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    cells = variant_fields("record", fields if fields is not None else variant_schema(parsed), ["inference"])
    return _with_location(parsed.select(*cells, "__path"), root, F.col("__path")).drop("__path")


def flatten_struct(df: DataFrame, column: str, depth: int = 2) -> DataFrame:
    """Replace a struct by ``column_key`` and ``column_key_subkey`` columns."""

    def leaves(dtype: T.DataType, ref: str, name: str, level: int) -> list[Column]:
        if isinstance(dtype, T.StructType) and level < depth:
            return [
                leaf
                for f in dtype.fields
                for leaf in leaves(f.dataType, f"{ref}.`{f.name}`", f"{name}_{f.name}", level + 1)
            ]
        return [F.col(ref).alias(name)]

    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, *leaves(df.schema[column].dataType, f"`{column}`", column, 0))


def resolve_records(listing: DataFrame, wanted: DataFrame, record: str = "metrics.json") -> DataFrame:
    """Pick the record of each wanted (base, name) from a listing of (base, path).

    ``path`` is relative to the base. A known layout wins in order of preference; else the
    only path whose last folder contains the name; among several, the only one that is not
    a side result. ``status`` is ``found``, ``missing`` or ``ambiguous``.

    Both matches are equi-joins: on the whole path, and on the parts of the last folder's name, of
    which a folder has as many as its length squared by two.
    """
    layouts = F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"),
                F.concat(
                    F.replace(F.lit(layout), F.lit("{name}"), F.col("name")), F.lit("/" + record)
                ).alias("path"),
            )
            for i, layout in enumerate(RECORD_LAYOUTS)
        ]
    )
    paths = listing.select("base", "path").distinct()
    candidates = wanted.select("base", "name", F.inline(layouts))
    direct = (
        candidates.join(paths, ["base", "path"])
        .groupBy("base", "name")
        .agg(F.min_by("path", "priority").alias("direct_path"))
    )
    folder = F.element_at(F.split("path", "/"), -2)
    length = F.greatest(F.length(folder), F.lit(1))
    parts = F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), length), lambda a: F.transform(F.sequence(F.lit(1), length - a + 1), lambda n: F.substring(folder, a, n))))
    )
    side = F.lit(False)
    for fragment in SIDE_RESULTS:
        side = side | F.lower(F.concat_ws("/", "base", "path")).contains(fragment)
    loose = (
        paths.where(F.element_at(F.split("path", "/"), -1) == record)
        .where(F.size(F.split("path", "/")) >= 2)
        .select(
            "base", "path", side.alias("side"),
            F.explode(parts).alias("name"),
        )
        .join(wanted.select("base", "name").distinct(), ["base", "name"])
        .groupBy("base", "name")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.min("path").alias("any_path"),
            F.count_if(~F.col("side")).alias("plain"),
            F.min(F.when(~F.col("side"), F.col("path"))).alias("plain_path"),
        )
    )
    joined = wanted.join(direct, ["base", "name"], "left").join(loose, ["base", "name"], "left")
    return joined.select(
        "base",
        "name",
        F.coalesce(
            "direct_path",
            F.when(F.col("matches") == 1, F.col("any_path")),
            F.when(F.col("plain") == 1, F.col("plain_path")),
        ).alias("path"),
        F.when(F.col("direct_path").isNotNull() | (F.col("matches") == 1) | (F.col("plain") == 1), "found")
        .when(F.col("matches") > 1, "ambiguous")
        .otherwise("missing")
        .alias("status"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a summary table as parquet, csv (with header) or json."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_tables(
    tables: dict[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a set of named tables below one folder."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt, mode)
