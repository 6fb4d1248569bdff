"""Train / validation / test assignment and sampling.

Every operator adds a ``split`` column instead of cutting the table into pieces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.hashing import seeded_order
from flowmill.functions.numeric import truncated
from flowmill.operators.ordering import Indexed, row_index_within
from flowmill.operators.quantiles import order_statistics

TRAIN, VAL, TEST = "train", "val", "test"


def split_sequential(indexed: Indexed, val_ratio: float, local: str = "split_idx") -> DataFrame:
    """First int(n(1-2v)) rows train, next int(n v) val, the rest test, in row order.

    Adds the row's 0-based position inside its split. The row count is already known
    from the numbering, so this is a narrow projection with literal boundaries.
    """
    n_train = truncated(indexed.rows, 1.0 - 2.0 * val_ratio)
    n_val = truncated(indexed.rows, val_ratio)
    idx = F.col(indexed.column)
    first_test = n_train + n_val
    return indexed.df.withColumn(
        "split",
        F.when(idx < n_train, TRAIN).when(idx < first_test, VAL).otherwise(TEST),
    ).withColumn(
        local,
        idx - F.when(idx < n_train, 0).when(idx < first_test, n_train).otherwise(first_test),
    )


def split_ordered_tail(
    train: Indexed, test: Indexed | None, val_ratio: float, local: str = "split_idx"
) -> DataFrame:
    """Validation is the last max(1, int(n v)) training rows; the test table stays as it is."""
    n_val = max(1, truncated(train.rows, val_ratio))
    n_train = train.rows - n_val
    if n_train < 1:
        raise ValueError("the validation share leaves no training rows")
    idx = F.col(train.column)
    parts = train.df.withColumn("split", F.when(idx < n_train, TRAIN).otherwise(VAL)).withColumn(
        local, idx - F.when(idx < n_train, 0).otherwise(n_train)
    )
    if test is None:
        return parts
    held = test.df.withColumn("split", F.lit(TEST)).withColumn(local, F.col(test.column))
    return parts.unionByName(held, allowMissingColumns=True)


def split_day_holdout(df: DataFrame, day: Column, require_all: bool = True) -> DataFrame:
    """Weekday ranks 0-2 train, 3 validate, 4 test; any other day is in no split.

    ``day`` is usually ``weekday_rank(file name)``, but may come from a timestamp.
    """
    out = df.withColumn(
        "split", F.when(day.between(0, 2), TRAIN).when(day == 3, VAL).when(day == 4, TEST)
    ).where("split IS NOT NULL")
    if require_all:
        present = {r["split"] for r in out.select("split").distinct().collect()}
        if len(present) < 3:
            raise ValueError(f"day holdout needs train, val and test days, found {sorted(present)}")
    return out


def split_stratified(
    df: DataFrame, label: str, val_ratio: float, order_key: Column, tie: str, rest: str = TRAIN
) -> DataFrame:
    """Random split that keeps class shares: per class floor(n v + 0.5) rows validate.

    ``order_key`` is the repeatable random order (see ``seeded_order``) and ``tie`` a unique
    numeric row key that completes it. The class quota is turned into a threshold on the
    order key by exact selection, so the data rows are neither sorted nor shuffled: a few
    narrow scans find the literals, and the split itself is a projection.
    """
    keyed = df.withColumn("__order", order_key.cast("double"))
    quotas = {}
    for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():
        quotas[r[label]] = math.floor(r["n"] * float(val_ratio) + 0.5)
    wanted = {c: q for c, q in quotas.items() if q > 0}

    def pick(values: dict, ranks: dict) -> dict:
        """The value at a rank, per class, of a per-class column expression."""
        names = {c: f"__c{i}" for i, c in enumerate(values)}
        wide = keyed.select(*[values[c].alias(names[c]) for c in values])
        found = order_statistics(wide, {names[c]: [ranks[c]] for c in values})
        return {c: found[n][0] for c, n in names.items()}

    validate = F.lit(False)
    if wanted:
        own = {c: F.col(label).eqNullSafe(F.lit(c)) for c in wanted}
        limit = pick(
            {c: F.when(own[c], F.col("__order")) for c in wanted}, {c: q - 1 for c, q in wanted.items()}
        )
        # rows that share the threshold value are told apart by their tie key, if not all of them go
        left = {c: q - limit[c].below for c, q in wanted.items() if q < limit[c].below + limit[c].at}
        tied = {c: own[c] & (F.col("__order") == F.lit(limit[c].value)) for c in left}
        # in two halves, as a DOUBLE holds 32 bits of a BIGINT exactly but not all 64
        key = F.col(tie).cast("bigint")
        high, low = F.shiftright(key, 32).cast("double"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
        top = pick({c: F.when(tied[c], high) for c in left}, {c: n - 1 for c, n in left.items()}) if left else {}
        rest_of = {c: n - 1 - top[c].below for c, n in left.items()}
        last = pick({c: F.when(tied[c] & (high == F.lit(top[c].value)), low) for c in left}, rest_of) if left else {}
        for c in wanted:
            inside = F.col("__order") <= F.lit(limit[c].value)
            if c in left:
                edge, step = F.lit(top[c].value), F.lit(last[c].value)
                inside = (F.col("__order") < F.lit(limit[c].value)) | (tied[c] & ((high < edge) | ((high == edge) & (low <= step))))
            validate = validate | (own[c] & inside)
    return keyed.withColumn("split", F.when(validate, VAL).otherwise(rest)).drop("__order")


def shuffle_within_split(
    df: DataFrame, order_key: Column | None = None, tie: str = "row_idx", seed: int = 2026,
    local: str = "split_idx",
) -> DataFrame:
    """Give every row a new position inside its split, in a repeatable random order."""
    key = order_key if order_key is not None else seeded_order(seed, F.col(tie))
    keyed = df.drop(local).withColumn("__order", key)
    return row_index_within(keyed, ["split"], ["__order", tie], local, unique=True).drop("__order")


def sample_with_replacement(
    df: DataFrame,
    label: str,
    order: str,
    weights: dict[int, float],
    seed: int = 0,
    uniform=None,
    block: int = 65_536,
) -> DataFrame:
    """Draw as many rows as the table has, with replacement, P proportional to class weight.

    Each draw picks a class by its total weight and then one of its rows by position, so
    the sample size is exact. Draws are counted per row and block of draw numbers before
    they meet the data: a rare class drawn very often costs one short row per block, and no
    input row is unfolded into more than ``block`` copies at once. Adds ``draw_block``.

    ``uniform(stream)`` maps a stream number (0: class, 1: row) to a column in [0, 1) over
    the draw number ``draw``; the default hashes it with the seed.
    """
    numbered = row_index_within(df, [label], [order], "__spot_of", "__class_rows")
    classes = {
        r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = sum(classes.values())
    mass = {c: weights[c] * n for c, n in classes.items()}
    whole = sum(mass.values())
    if uniform is None:
        uniform = lambda s: F.pmod(
            seeded_order(seed, F.lit(s), F.col("draw")), F.lit(1 << 53)
        ) / F.lit(float(1 << 53))

    pick, position, reached = None, None, 0.0
    ordered = sorted(classes)
    for c in ordered:
        reached += mass[c] / whole
        inside = F.col("__u") < F.lit(reached) if c != ordered[-1] else F.lit(True)
        spot = F.least(
            F.floor(F.col("__v") * F.lit(float(classes[c]))), F.lit(classes[c] - 1)
        ).cast("bigint")
        pick = F.when(inside, F.lit(c)) if pick is None else pick.when(inside, F.lit(c))
        position = F.when(inside, spot) if position is None else position.when(inside, spot)

    draws = (
        df.sparkSession.range(total)
        .withColumnRenamed("id", "draw")
        .select("draw", uniform(0).alias("__u"), uniform(1).alias("__v"))
        .select(
            pick.alias("__class"),
            position.alias("__spot"),
            F.expr(f"draw div {int(block)}").alias("draw_block"),
        )
        .groupBy("__class", "__spot", "draw_block")
        .agg(F.count(F.lit(1)).cast("int").alias("__copies"))
    )
    drawn = numbered.join(
        draws, (F.col(label) == F.col("__class")) & (F.col("__spot_of") == F.col("__spot"))
    )
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop(
        "__class", "__spot", "__copies", "__spot_of", "__class_rows"
    )


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def split_guard(
    df: DataFrame, seq_len: int, splits: Sequence[str] = (TRAIN, VAL, TEST), strict: bool = False
) -> DataFrame:
    """Rows per split against the minimum: seq_len, and at least max(2, seq_len) for train.

    Absent splits count as 0 rows. With ``strict`` a violation raises.
    """
    present = split_sizes(df)
    needed = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.lit(list(splits))).alias("split"))
    need = F.when(F.col("split") == TRAIN, F.greatest(F.lit(2), F.lit(seq_len))).otherwise(
        F.lit(seq_len)
    )
    out = needed.join(present, "split", "left").select(
        "split",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        need.cast("bigint").alias("required"),
    )
    out = out.withColumn("violated", F.col("rows") < F.col("required"))
    if strict:
        bad = [f"{r['split']}={r['rows']}" for r in out.where("violated").collect()]
        if bad:
            raise ValueError(f"too few rows for windows of {seq_len}: {', '.join(bad)}")
    return out
