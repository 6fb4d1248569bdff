"""Flow-record CSV readers.

Spark tables have no row order, so readers of ordered files return the file, the byte
offset of the input split and the position inside it; sorting by these three columns
(``ORDER_COLUMNS``) restores the order of the records in the files, without reading a
file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.paths import half_day_rank, weekday_rank
from flowmill.operators.cleaning import clean_column_names, clean_drop_invalid, null_invalid
from flowmill.operators.ordering import Indexed, row_index
from flowmill.operators.quantiles import first_of
from flowmill.session import stage

ORDER_COLUMNS = ["_file", "_offset", "_position"]

# Patterns of an integer of any size and of any number.
_INTEGER = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity)$"
_INFINITE = r"^[+-]?([iI]nf|[iI]nfinity)$"
# Cell texts that CSV tools commonly write for a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Column names of the headerless nsl files, in order, and those that hold text.
NSL_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label",
    "difficulty",
]
NSL_TEXT = ["protocol_type", "service", "flag", "label"]


def nsl_schema() -> T.StructType:
    other = {name: T.StringType() for name in NSL_TEXT} | {"difficulty": T.IntegerType()}
    return T.StructType([T.StructField(name, other.get(name, T.DoubleType())) for name in NSL_COLUMNS])


def order_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_position"),
    ]


@dataclass(frozen=True)
class _Layout:
    """Files with one encoding and one header line, and the column names of that line."""

    charset: str
    files: list[str]  # as the metadata column spells them
    names: list[str]


def _layouts(
    spark: SparkSession, paths: Sequence[str], encoding: str | None, same_header: bool
) -> list[_Layout]:
    """The layouts of some files, in the order of their first file.

    One scan of the text combines encoding and heading per file before its shuffle; the driver gets
    one short row per file, which it has to list anyway, and the names of each distinct header.
    Files without a line of text are left out.
    """
    def names(charset: str, file: str) -> list[str]:
        reader = spark.read.option("header", True).option("encoding", charset)
        return clean_column_names(reader.csv(unquote(file))).columns

    files = sorted(spark.read.text(list(paths)).inputFiles())
    if encoding is not None and (same_header or len(files) == 1):
        return [_Layout(encoding, files, names(encoding, files[0]))]
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("position"),
    )
    heading = F.when(F.length(F.trim("value")) > 0, F.struct("start", "position"))
    seen = lines.groupBy("f").agg(
        F.min_by(F.md5("value"), heading).alias("heading"), F.bool_or(~F.is_valid_utf8("value")).alias("latin")
    )
    groups: dict[tuple[str, str], list[str]] = {}
    for r in seen.where("heading IS NOT NULL").collect():
        charset = encoding or ("ISO-8859-1" if r["latin"] else "UTF-8")
        groups.setdefault((charset, "" if same_header else r["heading"]), []).append(r["f"])
    if not groups:
        return [_Layout(encoding or "UTF-8", files, names(encoding or "UTF-8", files[0]))]
    members = [(charset, sorted(g, key=unquote)) for (charset, _), g in groups.items()]
    return [_Layout(c, g, names(c, g[0])) for c, g in sorted(members, key=lambda m: unquote(m[1][0]))]


def _read_layouts(spark: SparkSession, layouts: Sequence[_Layout], schema: T.StructType | str | None) -> tuple[DataFrame, list[str]]:
    """All files in one scan: cells are read by place and named by the layout of their file.

    Returns the rows, with their layout's number as ``_layout``, and the names that a schema or the
    headers together give. A file's missing columns are null; missing-value tokens are null too.
    """
    fields = _fields(schema)
    for layout in layouts:
        absent = [f.name for f in fields or [] if f.name not in layout.names]
        if absent:
            raise ValueError(f"columns {absent} are not in the header of {[unquote(f) for f in layout.files[:5]]}")
    names = [f.name for f in fields] if fields else list(dict.fromkeys(n for g in layouts for n in g.names))
    # Latin-1 keeps every byte, so files of both encodings can be read as that and then decoded
    charsets = {g.charset for g in layouts}
    charset = charsets.pop() if len(charsets) == 1 else "ISO-8859-1"
    places = [T.StructField(f"_c{i}", T.StringType()) for i in range(max(len(g.names) for g in layouts))]
    reader = spark.read.option("header", True).option("enforceSchema", True).option("encoding", charset)
    raw = reader.schema(T.StructType(places)).csv([unquote(f) for g in layouts for f in g.files])
    raw = raw.select("*", *order_columns())

    number = F.lit(0)
    if len(layouts) > 1:
        most = max(range(len(layouts)), key=lambda i: len(layouts[i].files))
        number = F.lit(most)
        for i, g in enumerate(layouts):
            if i != most:
                number = F.when(F.col("_file").isin(g.files), i).otherwise(number)
    raw = raw.withColumn("_layout", number)

    def cell(name: str) -> Column:
        by_place: dict[int, list[int]] = {}
        for i, g in enumerate(layouts):
            if name in g.names:
                by_place.setdefault(g.names.index(name), []).append(i)
        found = sum(map(len, by_place.values()))
        if len(by_place) == 1 and found == len(layouts):
            value = F.col(f"_c{next(iter(by_place))}")
        else:
            value = F.coalesce(*[F.when(F.col("_layout").isin(at), F.col(f"_c{place}")) for place, at in by_place.items()])
        utf = [i for i, g in enumerate(layouts) if g.charset != charset]
        if utf:
            odd = F.col("_layout").isin(utf) & F.rlike(value, F.lit("[^\\x00-\\x7F]"))
            value = F.when(odd, F.decode(F.encode(value, charset), "UTF-8")).otherwise(value)
        return F.when(~F.trim(value).isin(MISSING_TOKENS), value).alias(name)

    return raw.select(*[cell(n) for n in names], *ORDER_COLUMNS, "_layout"), names


def _read_headerless(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows as text with their order columns; missing-value tokens are null."""
    names = [f.name for f in _fields(schema)]
    reader = spark.read.option("header", False).option("encoding", "UTF-8")
    df = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    cells = [F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in names]
    return df.select(*cells, *order_columns())


def _fields(schema: T.StructType | str | None) -> list[T.StructField] | None:
    if schema is None:
        return None
    return (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields


def _clean_and_type(
    df: DataFrame, schema: T.StructType | str | None, layouts: Sequence[_Layout] = ()
) -> DataFrame:
    """Rows without a missing or infinite cell, then typed.

    A cell that is there but does not fit its type becomes null and its row stays. With ``layouts`` a
    row is tested on the columns of its own file only.
    """
    fields = _fields(schema)
    own = [*ORDER_COLUMNS, "_layout"]
    if fields is None:
        df = infer_types(df, keep=own)
    else:
        numbers = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
        df = df.select(
            *[
                F.when(~F.rlike(F.trim(F.col(f"`{c}`")), F.lit(_INFINITE)), F.col(f"`{c}`")).alias(c) if c in numbers else F.col(f"`{c}`")
                for c in df.columns
            ]
        )
    if layouts:
        df, keep = null_invalid(df), F.lit(True)
        for c in df.columns:
            having = [i for i, g in enumerate(layouts) if c in g.names]
            if c not in own:
                held = F.col(f"`{c}`").isNotNull()
                keep = keep & (held if len(having) == len(layouts) else held | ~F.col("_layout").isin(having))
        whole = df.where(keep)
    else:
        whole = clean_drop_invalid(df, keep=own)
    if fields is not None:
        whole = whole.withColumns({f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields})
    return whole.drop("_layout")


def _fits(cell: Column) -> Column:
    """Whether a cell is an integer of 64 bits."""
    whole = F.when(F.rlike(cell, F.lit(_INTEGER)), cell)
    return whole.isNotNull() & whole.try_cast("bigint").isNotNull()


def infer_types(df: DataFrame, keep: Sequence[str] = tuple(ORDER_COLUMNS)) -> DataFrame:
    """Text columns whose every value is a number become BIGINT or DOUBLE.

    One aggregate a column, the least fitting kind of its cells, decides; a column without values stays text, and so does one
    with an integer beyond 64 bits, which a DOUBLE would blur. Cells are tested by pattern first,
    because a failing cast raises and catches an error per cell.
    """
    texts = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in keep
    ]
    if not texts:
        return df
    kinds = []
    for c in texts:
        cell = F.trim(F.col(f"`{c}`"))
        real = F.rlike(cell, F.lit(_REAL)) & ~F.rlike(cell, F.lit(_INTEGER))
        kinds.append(F.max(F.when(cell.isNotNull(), F.when(_fits(cell), 0).when(real, 1).otherwise(2))))
    casts = {}
    for c, kind in zip(texts, first_of(df, kinds)):
        if kind in (0, 1):
            casts[c] = F.trim(F.col(f"`{c}`")).cast("bigint" if kind == 0 else "double")
    return df.withColumns(casts)


def read_custom(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None,
    ordered: bool = False, same_header: bool = False,
) -> DataFrame:
    """Any CSV with a header; rows with a missing value are dropped. Pass a schema to avoid inference.

    Several files need not have their columns in the same order; finding out takes a scan of the
    text, which ``same_header`` saves.
    """
    members = [paths] if isinstance(paths, str) else paths
    df = _clean_and_type(_read_layouts(spark, _layouts(spark, members, "UTF-8", same_header), schema)[0], schema)
    return df if ordered else df.drop(*ORDER_COLUMNS)


def read_fixed_schema(
    spark: SparkSession, train: str, test: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A headerless train and test file with a known schema, tagged by ``part``."""
    return _pair(spark, train, test, schema or nsl_schema(), header=False)


def read_train_test(
    spark: SparkSession, train: str, test: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """An official train and test file with a header, tagged by ``part``."""
    return _pair(spark, train, test, schema, header=True)


def _pair(spark, train, test, schema, header) -> DataFrame:
    parts = []
    for part, path in (("train", train), ("test", test)):
        if header:
            df, _ = _read_layouts(spark, _layouts(spark, [path], "UTF-8", False), schema)
        else:
            df = _read_headerless(spark, path, schema)
        parts.append(_clean_and_type(df, schema).withColumn("part", F.lit(part)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_multi_file(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None,
    per_file_clean: bool = False, encoding: str | None = None, same_header: bool = False,
) -> DataFrame:
    """Several CSV files as one table; ``ORDER_COLUMNS`` put them in alphabetical file order.

    Files that are not UTF-8 are read as Latin-1. However many encodings and headers there are, the
    rows come from one scan; finding them takes one more scan of the text, which a known ``encoding``
    together with ``same_header`` saves. Without a schema every file contributes its own columns; a
    column a file lacks is null there, and cleaning then drops that file's rows, while
    ``per_file_clean`` tests each row on the columns of its own file.
    """
    layouts = _layouts(spark, list(paths), encoding, same_header)
    rows, _ = _read_layouts(spark, layouts, schema)
    return _clean_and_type(rows, schema, layouts if per_file_clean else ())


def number_records(df: DataFrame, column: str = "row_idx", file_order: Sequence[Column] = ()) -> Indexed:
    """Number the records of a reader 0..n-1 in the order of files and of records in them, without a sort.

    ``df`` is what a reader with ``ORDER_COLUMNS`` returned, filtered or projected. Such rows lie in
    their tasks in record order, block after block. They are staged with their place in the task; a
    block's first number is a prefix sum over the blocks of its file and over the files, and both
    tables have a row per block at most. ``file_order`` are columns of ``_file`` that go before its
    name. Rows whose blocks were torn apart by a shuffle are sorted instead.
    """
    staged = stage(df.withColumn("__at", F.monotonically_increasing_id()), "records")
    where = F.min_by("_position", "__at") == F.min("_position"), F.max_by("_position", "__at") == F.max("_position")
    blocks = staged.groupBy("_file", "_offset").agg(
        F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"), F.max("__at").alias("high"), (where[0] & where[1]).alias("ordered")
    )
    in_file = Window.partitionBy("_file").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    in_order = Window.orderBy(*file_order, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = staged.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).select(
        "_file", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("file_base")
    )
    before = F.coalesce(F.sum("n").over(in_file), F.lit(0))
    torn = ~F.col("ordered") | (F.expr("high - low + 1") != F.col("n"))
    bases = blocks.select("_file", "_offset", "n", torn.alias("torn"), (before - F.col("low")).alias("shift")).join(files, "_file")
    bases = stage(bases.select("_file", "_offset", "n", "torn", (F.col("file_base") + F.col("shift")).alias("__shift")), "bases")
    torn, rows = bases.agg(F.coalesce(F.bool_or("torn"), F.lit(False)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if torn:
        return row_index(staged.drop("__at"), [*file_order, *ORDER_COLUMNS], column, unique=True)
    numbered = staged.join(bases.drop("n", "torn"), ["_file", "_offset"]).withColumn(column, F.col("__at") + F.col("__shift"))
    return Indexed(numbered.select(*df.columns, column), rows, column)


def chronological_rank(df: DataFrame, file_name: str = "_file") -> DataFrame:
    """Add ``day_rank`` and ``half_day``: sort by them and the name for weekday order."""
    return df.withColumn("day_rank", weekday_rank(F.col(file_name))).withColumn(
        "half_day", half_day_rank(F.col(file_name))
    )
