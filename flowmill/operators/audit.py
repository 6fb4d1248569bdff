"""Leakage audits: duplicates, overlap between splits, label conflicts, order dependence.

Rows are compared by 256 bits of digest. One half groups them; the other tells whether a group holds
rows that differ, and such groups, if there are any, are read again and compared by value. Two
different rows are thus taken for equal with a chance of 2**-256 a pair, 2**-177 over all pairs of a
trillion rows. One grouping answers the duplicate, overlap and conflict questions together, and
identical rows combine on the map side, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.hashing import MISSING, comparable, row_hash
from flowmill.functions.numeric import ratio
from flowmill.operators.ordering import row_index_within
from flowmill.session import stage

SPLITS = ("train", "val", "test")
PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))

# Normalised names under which a session identity may appear.
SESSION_NAMES = [
    "flow id", "srcip", "src ip", "source ip", "dstip", "dst ip", "destination ip",
    "sport", "source port", "dsport", "destination port", "timestamp", "time",
    "proto", "protocol", "protocol type",
]


def feature_groups(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    splits: Sequence[str] = SPLITS,
    split: str = "split",
) -> DataFrame:
    """One row per distinct feature row: rows per split and the label range.

    The features themselves are not returned and only digests are shuffled. The input is evaluated
    once; only if a group's second digest is not the same throughout it is read again.
    """
    label_range = (
        [F.min("__y").alias("y_min"), F.max("__y").alias("y_max")] if label is not None else []
    )
    sums = [F.count_if(F.col("__split") == s).alias(f"n_{s}") for s in splits] + label_range
    values = [f"__f{i}" for i in range(len(features))]
    tagged = df.select(
        *[row_hash(df, features, salt=i).alias(f"__h{i}") for i in range(4)],
        F.col(split).alias("__split"),
        *([F.col(label).alias("__y")] if label is not None else []),
        *[c.alias(v) for c, v in zip(comparable(df, features), values)],
    )
    mixed = (F.min("__h2") != F.max("__h2")) | (F.min("__h3") != F.max("__h3"))
    digests = stage(tagged.groupBy("__h0", "__h1").agg(*sums, mixed.alias("__mixed")), "digests")
    alike = digests.where("NOT __mixed").drop("__h0", "__h1", "__mixed")
    if not digests.where("__mixed").limit(1).count():
        return alike
    differing = digests.where("__mixed").select("__h0", "__h1")
    compared = tagged.join(differing, ["__h0", "__h1"], "left_semi").groupBy(*values).agg(*sums)
    return alike.unionByName(compared.drop(*values))


def duplicate_summary(groups: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Per split: rows, distinct feature rows, rows beyond the first and their share."""
    wide = groups.agg(
        *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"rows_{s}") for s in splits],
        *[F.count_if(F.col(f"n_{s}") > 0).alias(f"distinct_{s}") for s in splits],
    )
    lines = [
        F.struct(
            F.lit(s).alias("split"),
            F.col(f"rows_{s}").alias("rows"),
            F.col(f"distinct_{s}").alias("unique_feature_rows"),
            (F.col(f"rows_{s}") - F.col(f"distinct_{s}")).alias("duplicate_rows_beyond_first"),
            ratio(
                F.col(f"rows_{s}") - F.col(f"distinct_{s}"), F.greatest(F.col(f"rows_{s}"), F.lit(1))
            ).alias("duplicate_fraction"),
        )
        for s in splits
    ]
    return wide.select(F.inline(F.array(*lines)))


def overlap_summary(
    groups: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS
) -> DataFrame:
    """Per pair of splits: shared distinct feature rows and the rows on each side they cover."""
    measures: list[Column] = []
    for a, b in pairs:
        shared = (F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0)
        measures += [
            F.count_if(shared).alias(f"common_{a}_{b}"),
            F.coalesce(F.sum(F.when(shared, F.col(f"n_{a}"))), F.lit(0)).alias(f"first_{a}_{b}"),
            F.coalesce(F.sum(F.when(shared, F.col(f"n_{b}"))), F.lit(0)).alias(f"second_{a}_{b}"),
        ]
    names = sorted({s for pair in pairs for s in pair})
    wide = groups.agg(
        *measures, *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"rows_{s}") for s in names]
    )
    lines = [
        F.struct(
            F.lit(a).alias("first_split"),
            F.lit(b).alias("second_split"),
            F.col(f"common_{a}_{b}").alias("common_unique"),
            F.col(f"first_{a}_{b}").alias("rows_first"),
            F.col(f"second_{a}_{b}").alias("rows_second"),
            ratio(F.col(f"first_{a}_{b}"), F.greatest(F.col(f"rows_{a}"), F.lit(1))).alias(
                "fraction_first"
            ),
            ratio(F.col(f"second_{a}_{b}"), F.greatest(F.col(f"rows_{b}"), F.lit(1))).alias(
                "fraction_second"
            ),
        )
        for a, b in pairs
    ]
    return wide.select(F.inline(F.array(*lines)))


def overlapping_rows(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose feature row also occurs in ``b``."""
    keys = [f"__k{i}" for i in range(len(features))]
    left = a.select("*", *[c.alias(k) for c, k in zip(comparable(a, features), keys)])
    # a frequent row of b is reduced to one per task before it is shuffled
    right = b.select(*[c.alias(f"{k}r") for c, k in zip(comparable(b, features), keys)]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return left.join(right, on, "left_semi").drop(*keys)


def label_conflicts(groups: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Feature rows that occur with both labels, over all splits, and how many rows they cover."""
    size = sum((F.col(f"n_{s}") for s in splits), F.lit(0))
    conflict = (size > 1) & (F.col("y_min") != F.col("y_max"))
    return groups.agg(
        F.count_if(conflict).alias("conflicting_feature_rows"),
        F.coalesce(F.sum(F.when(conflict, size)), F.lit(0)).alias("rows_in_conflict"),
    )


def adjacent_dependence(df: DataFrame, label: str, order: Sequence[str], split: str = "split") -> DataFrame:
    """Share of neighbouring rows with equal labels and the lag-1 correlation, per split.

    The correlation comes from sums over neighbour pairs and is null when either side is
    constant; a split with fewer than two rows gives nulls.
    """
    numbered = row_index_within(
        df.select(split, label, *order), [split], list(order), "__idx"
    ).select(F.col(split).alias("split"), F.col(label).cast("double").alias("y"), "__idx")
    return dependence_of(numbered, "__idx")


def dependence_of(numbered: DataFrame, idx: str, chunk_rows: int = 65_536) -> DataFrame:
    """:func:`adjacent_dependence` for rows that already carry a dense position per split.

    Neighbours meet in a join-free way: each row is sent to its own chunk, and the last row
    of a chunk also to the next one, so a ``lag`` inside equal chunks sees every pair once.
    """
    own = F.expr(f"`{idx}` div {chunk_rows}")
    last = F.expr(f"`{idx}` % {chunk_rows} = {chunk_rows - 1}")
    spread = numbered.select(
        "split", "y", F.col(idx).alias("__i"), own.alias("__own"),
        F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("__chunk"),
    )
    prev = F.lag("y").over(Window.partitionBy("split", "__chunk").orderBy("__i"))
    pairs = spread.withColumn("x", prev).where(F.col("__own") == F.col("__chunk"))
    has = F.col("x").isNotNull()
    x, y = F.col("x"), F.when(has, F.col("y"))
    sums = pairs.groupBy("split").agg(
        F.count("x").alias("n"),
        F.count_if(has & (F.col("x") == F.col("y"))).alias("same"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    return sums.select(
        "split",
        F.try_divide(F.col("same").cast("double"), n).alias("adjacent_label_agreement"),
        F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias(
            "lag1_label_correlation"
        ),
    )


def category_purity(df: DataFrame, category: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(category, benign, attack) counts, and the accuracy of guessing from the category alone."""
    table = df.groupBy(F.coalesce(F.col(category), F.lit(MISSING)).alias("category")).agg(
        F.count_if(F.col(label) == 0).alias("benign"),
        F.count_if(F.col(label) == 1).alias("attack"),
    )
    purity = table.agg(
        F.count(F.lit(1)).alias("categories"),
        ratio(
            F.coalesce(F.sum(F.greatest("benign", "attack")), F.lit(0)),
            F.greatest(F.coalesce(F.sum(F.col("benign") + F.col("attack")), F.lit(0)), F.lit(1)),
        ).alias("majority_accuracy"),
    )
    return table, purity


def _plain(name: str) -> str:
    return name.strip().lower().replace("-", " ").replace("_", " ")


def session_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose name denotes a session identity."""
    return [c for c in columns if _plain(c) in SESSION_NAMES]


def session_key(columns: Sequence[str]) -> list[str]:
    """Columns that identify a session: the flow id, else source and destination address
    with ports and protocol where present; empty when neither is available."""
    found = {_plain(c): c for c in session_columns(columns)}

    def first(*names: str) -> str | None:
        return next((found[n] for n in names if n in found), None)

    if "flow id" in found:
        return [found["flow id"]]
    src, dst = first("srcip", "src ip", "source ip"), first("dstip", "dst ip", "destination ip")
    if src is None or dst is None:
        return []
    extra = [
        first("sport", "source port"),
        first("dsport", "destination port"),
        first("proto", "protocol", "protocol type"),
    ]
    return [src, dst, *[c for c in extra if c is not None]]


def session_overlap(
    df: DataFrame, key: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] = PAIRS
) -> DataFrame | None:
    """:func:`overlap_summary` on the session key; None when the columns do not identify one."""
    columns = list(key) if key is not None else session_key(df.columns)
    if not columns:
        return None
    return overlap_summary(feature_groups(df, columns), pairs)


def session_inventory(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per session column: whether it belongs to the key, filled rows and distinct values."""
    names = list(columns) if columns is not None else session_columns(df.columns)
    key = set(session_key(names))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in key).alias("in_key"),
                F.col(f"`{c}`").cast("string").alias("value"),
            )
            for c in names
        ]
    )
    values = df.select(F.inline(cells)).groupBy("column", "in_key", "value").agg(
        F.count("value").alias("n")
    )
    return values.groupBy("column", "in_key").agg(
        F.sum("n").alias("filled_rows"), F.count("value").alias("distinct_values")
    )
