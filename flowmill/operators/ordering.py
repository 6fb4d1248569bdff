"""Record order on data too large for a single sorted task.

``row_number()`` without a partition key moves the whole table into one task,
and with a partition key it moves a hot group into one task. The three tools
here never do either:

* :func:`row_index` numbers rows through one range sort;
* :func:`running` evaluates prefix aggregates inside fixed-size chunks of that
  numbering and then adds what earlier chunks of the same group carried in;
* :func:`rank_totals` folds a sorted column into tie-aware rank sums, one short
  summary row per task and group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.session import stage

CHUNK_ROWS = 65_536
_POS = "__pos"
_TIE = "__tie"
_POS_BITS = 33  # monotonically_increasing_id keeps the task number above bit 33
_POS_MASK = (1 << _POS_BITS) - 1


@dataclass(frozen=True)
class Indexed:
    """A table with a dense 0-based order column and its known row count."""

    df: DataFrame
    rows: int
    column: str


def row_index(
    df: DataFrame, order_by: Sequence[str | Column], column: str = "row_idx", unique: bool = False
) -> Indexed:
    """Number rows 0..n-1 in the order of ``order_by``.

    The range sort spreads rows evenly whatever the key distribution. Equal keys would all
    meet in one task, so unless the key is declared ``unique`` the input position is
    appended to it; ties then keep their input order. The sorted rows are staged once with
    their position inside the writing task; the number of rows per task, a list no longer
    than the number of shuffle partitions, becomes a literal offset array. Everything after
    the staging is a narrow projection.
    """
    keys, source = list(order_by), df
    if not unique:
        source = df.withColumn(_TIE, F.monotonically_increasing_id())
        keys.append(_TIE)
    ordered = source.orderBy(*keys).drop(_TIE).withColumn(_POS, F.monotonically_increasing_id())
    staged = stage(ordered, "row-index")
    task = F.shiftright(_POS, _POS_BITS).cast("int")
    sizes = {
        r["task"]: r["n"]
        for r in staged.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    starts, total = [], 0
    for t in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(t, 0)
    offset = F.get(F.lit(np.array(starts or [0], dtype=np.int64)), task)
    position = offset + F.col(_POS).bitwiseAND(F.lit(_POS_MASK))
    indexed = staged.withColumn(column, F.coalesce(position, F.lit(-1).cast("bigint")))
    return Indexed(indexed.drop(_POS), total, column)


def row_index_within(
    df: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[str | Column],
    column: str = "row_idx",
    count_column: str | None = None,
    group_column: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Like ``row_number() - 1`` per group, but a hot group stays spread out.

    Sorts by (groups, order), so each group is one contiguous run of the global
    numbering and its local number is the distance from the run's first row. That first
    row also names the group: ``group_column`` returns it as a key that is never null.
    """
    indexed = row_index(df, [*groups, *order_by], "__global", unique)
    runs = stage(
        indexed.df.groupBy(*groups).agg(
            F.min("__global").alias("__run_start"), F.count(F.lit(1)).alias("__run_rows")
        ),
        "runs",
    )
    start = F.coalesce(F.col("__run_start"), F.lit(-1).cast("bigint"))
    extra = {column: F.col("__global") - start}
    if count_column:
        extra[count_column] = F.col("__run_rows")
    if group_column:
        extra[group_column] = start
    out = join_on(indexed.df, runs, groups).withColumns(extra)
    return out.drop("__global", "__run_start", "__run_rows")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join keeping the left key columns; Spark picks the strategy by size.

    A key the left side declares non-null is compared plainly, which lets the join reuse a
    partitioning by that key.
    """
    renamed = right
    for i, key in enumerate(keys):
        renamed = renamed.withColumnRenamed(key, f"__rk{i}")
    condition = F.lit(True)
    for i, key in enumerate(keys):
        other = F.col(f"__rk{i}")
        same = left[key].eqNullSafe(other) if left.schema[key].nullable else left[key] == other
        condition = condition & same
    return left.join(renamed, condition, how).drop(*[f"__rk{i}" for i in range(len(keys))])


def running(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Running sums and maxima per group in a given order.

    Same result as an unbounded-preceding window per group. With
    ``inclusive=False`` the current row is left out (0 / null on the first row).
    """
    indexed = row_index(df, [*by, *order_by], "__idx")
    out = running_over(indexed.df, by, "__idx", sums, maxes, inclusive, chunk_rows)
    return out.drop("__idx")


def running_over(
    rows: DataFrame,
    by: Sequence[str],
    idx: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`running` for rows that already carry a dense order column.

    Windows run inside chunks of ``chunk_rows`` consecutive rows of one group; what the
    earlier chunks of that group add up to is joined on, and only groups that span
    several chunks have such a row.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    columns = rows.columns
    rows = rows.withColumns({f"__v_{n}": e for n, e in {**sums, **maxes}.items()}).withColumn(
        "__chunk", F.coalesce(F.expr(f"`{idx}` div {int(chunk_rows)}"), F.lit(-1).cast("bigint"))
    )
    totals = rows.groupBy(*by, "__chunk").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxes],
    )
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(
        totals.select(
            *by,
            "__chunk",
            F.count(F.lit(1)).over(earlier).alias("__earlier"),
            *[F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
            *[F.max(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in maxes],
        ).where("__earlier > 0"),
        "carried",
    )

    end = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*by, "__chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    )
    out = rows.select(
        "*",
        *[F.sum(f"__v_{n}").over(local).alias(f"__l_{n}") for n in sums],
        *[F.max(f"__v_{n}").over(local).alias(f"__l_{n}") for n in maxes],
    )
    out = join_on(out, carried, [*by, "__chunk"], "left")
    return out.select(
        *columns,
        *[
            (F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.greatest(f"__l_{n}", f"__c_{n}").alias(n) for n in maxes],
    )


def group_medians(
    df: DataFrame, by: Sequence[str], value: str, out: str = "median"
) -> DataFrame:
    """Exact median of ``value`` per group: the middle rows of one range sort."""
    present = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    placed = row_index_within(present, by, ["__v"], "__i", "__n")
    middle = placed.where("__i = (__n - 1) div 2 OR __i = __n div 2")
    return middle.groupBy(*by).agg(F.avg("__v").alias(out))


def rank_totals(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    hits: Column,
    mass: Column,
    mass_type: str = "bigint",
) -> DataFrame:
    """Tie-aware rank sums per group.

    For each distinct value v let ``h`` and ``m`` be the sums of ``hits`` and
    ``mass`` over its rows. Per group this returns

    * ``below``: sum of ``h * (mass of smaller values + m / 2)``,
    * ``hits`` and ``mass``: the totals,
    * ``tie_cubes``: sum of ``m**3 - m`` (tie correction of rank tests),
    * ``ties``: number of distinct values with ``m > 1``.

    Equal values are combined on the map side first, so one very frequent value
    costs one row per task. The distinct values are then range-sorted and every
    task reduces its slice to one row per group, which is all that is gathered.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    cells = (
        df.select(
            *[F.col(c).alias(k) for c, k in zip(by, keys)],
            (F.col(value) if isinstance(value, str) else value).alias("__value"),
            hits.cast(mass_type).alias("__h"),
            mass.cast(mass_type).alias("__m"),
        )
        .groupBy(*keys, "__value")
        .agg(F.sum("__h").alias("__h"), F.sum("__m").alias("__m"))
        .orderBy(*keys, "__value")
        .select(
            *keys,
            F.col("__value").cast("double").alias("__value"),
            F.col("__h").cast("double").alias("__h"),
            F.col("__m").cast("double").alias("__m"),
        )
    )
    fields = [cells.schema[k] for k in keys] + [
        T.StructField(n, T.DoubleType())
        for n in ("__lo", "__below", "__hits", "__mass", "__cubes", "__ties")
    ]

    slices = cells.mapInPandas(_fold_slice(keys), T.StructType(fields))
    earlier = (
        Window.partitionBy(*keys).orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    )
    folded = slices.withColumn("__before", F.coalesce(F.sum("__mass").over(earlier), F.lit(0.0)))
    return folded.groupBy(*[F.col(k).alias(c) for c, k in zip(by, keys)]).agg(
        F.sum(F.col("__below") + F.col("__hits") * F.col("__before")).alias("below"),
        F.sum("__hits").alias("hits"),
        F.sum("__mass").alias("mass"),
        F.sum("__cubes").alias("tie_cubes"),
        F.sum("__ties").cast("bigint").alias("ties"),
    )


def _fold_slice(keys: list[str]):
    """Reduce one sorted slice to a row per group, carrying the running mass across batches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, acc = None, None
        for pdf in batches:
            parts = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                if acc is None or key != open_key:
                    if acc is not None:
                        yield pd.DataFrame([acc])
                    open_key = key
                    acc = {k: part[k].iloc[0] for k in keys}
                    acc |= {"__lo": part["__value"].iloc[0]}
                    acc |= dict.fromkeys(("__below", "__hits", "__mass", "__cubes", "__ties"), 0.0)
                h, m = part["__h"].to_numpy(), part["__m"].to_numpy()
                before = acc["__mass"] + np.cumsum(m) - m
                acc["__below"] += float(np.dot(h, before + m / 2))
                acc["__hits"] += float(h.sum())
                acc["__mass"] += float(m.sum())
                acc["__cubes"] += float((m**3 - m).sum())
                acc["__ties"] += float((m > 1).sum())
        if acc is not None:
            yield pd.DataFrame([acc])

    return fold
