"""Multi-seed experiment statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.distributions import (
    EXACT_MAX_PAIRS,
    normal_two_sided,
    signed_rank_p,
    t_quantile_column,
)
from flowmill.functions.numeric import is_close, to_number
from flowmill.operators.ordering import (
    group_medians,
    join_on,
    rank_totals,
    row_index_within,
    running_over,
)
from flowmill.session import stage

# Metrics summarised per group of runs, and those tested pairwise.
SUMMARY_METRICS = ("accuracy", "f1_macro", "auc", "fpr_macro", "fpr_attack_positive")
TESTED_METRICS = ("accuracy", "f1_macro", "auc")
#: Groups of at most this many rows are ranked by windows, one group in one task. If any group is
#: larger, range sorts over all groups do the same work spread out; results are equal.
GROUP_ROWS = 1 << 20


def summarize(
    runs: DataFrame, by: Sequence[str], metrics: Sequence[str] = SUMMARY_METRICS
) -> DataFrame:
    """Per group: n_runs, and per metric mean, sample deviation, 95 % half-width and text.

    Nulls are left out metric by metric; a single value has deviation and half-width 0.
    Metrics the table does not have are skipped; null group keys form their own group.
    """
    used = [m for m in metrics if m in runs.columns]
    numbers = runs.select(*by, *[to_number(F.col(m)).alias(m) for m in used])
    stats = numbers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.count(m).alias(f"__n_{m}") for m in used],
        *[F.avg(m).alias(f"{m}_mean") for m in used],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"__s_{m}") for m in used],
    )
    out = [F.col(c) for c in (*by, "n_runs")]
    for m in used:
        n, mean = F.col(f"__n_{m}"), F.col(f"{m}_mean")
        std = F.when(n > 0, F.col(f"__s_{m}"))
        half = F.when(n == 1, 0.0).when(
            n > 1, t_quantile_column(n - 1) * std / F.sqrt(n.cast("double"))
        )
        text = F.when(n > 0, F.format_string("%.4f ± %.4f", mean, std))
        out += [
            mean,
            std.alias(f"{m}_std"),
            half.alias(f"{m}_ci95_halfwidth"),
            text.alias(f"{m}_mean_std"),
        ]
    return stats.select(*out)


def melt_metrics(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value) with one row per run and metric."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), to_number(F.col(m)).alias("value")) for m in metrics]
    )
    return runs.select(*keys, F.inline(cells))


def seed_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], seed: str = "seed") -> DataFrame:
    """Runs of A and B with the same keys and seed: (on, seed, value_a, value_b), no nulls."""
    left = a.select(*on, to_number(F.col(seed)).alias("seed"), F.col("value").alias("value_a"))
    right = b.select(*on, to_number(F.col(seed)).alias("seed"), F.col("value").alias("value_b"))
    return left.join(right, [*on, "seed"]).dropna(subset=["seed", "value_a", "value_b"])


def comparison_pairs(
    long: DataFrame, comparisons: DataFrame, context: Sequence[str], arm: str, seed: str = "seed"
) -> DataFrame:
    """Seed pairs for a whole table of comparisons at once.

    ``long`` holds (context, arm, seed, metric, value); ``comparisons`` lists
    (comparison_a, comparison_b) values of ``arm``, optionally with context columns.
    """
    shared = [c for c in context if c in comparisons.columns]
    values = long.select(
        *context, F.col(arm).alias("__arm"), to_number(F.col(seed)).alias("seed"), "metric", "value"
    ).where("seed IS NOT NULL AND value IS NOT NULL")
    a = values.withColumnsRenamed({"__arm": "comparison_a", "value": "value_a"})
    b = values.withColumnsRenamed({"__arm": "comparison_b", "value": "value_b"})
    return a.join(comparisons, [*shared, "comparison_a"]).join(
        b, [*context, "comparison_b", "seed", "metric"]
    )


def paired_signed_rank(
    pairs: DataFrame,
    by: Sequence[str],
    a: str = "value_a",
    b: str = "value_b",
    digits: int = 12,
    exact_max: int = EXACT_MAX_PAIRS,
) -> DataFrame:
    """Two-sided signed-rank test per group, with effect sizes; groups below 2 pairs give no row.

    Zero differences are dropped and tied magnitudes share their average rank. The p-value
    is exact for up to ``exact_max`` untied differences, else the normal approximation
    with tie correction; differences that are all close to zero give (0, 1). Differences are
    rounded to ``digits`` so that representation noise does not split ties.
    """
    if exact_max > EXACT_MAX_PAIRS:
        raise ValueError(f"the exact distribution is tabulated for up to {EXACT_MAX_PAIRS} pairs")
    diffs = (
        pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(*by, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
        .withColumn("__d", F.round(F.col("__a") - F.col("__b"), digits))
    )
    diffs = stage(diffs, "differences")
    joined = (_ranked_in_groups if _largest(diffs, by) <= GROUP_ROWS else _ranked_apart)(diffs, by)
    n = F.col("mass")
    # average rank of a tied block = rows below + (block size + 1) / 2
    w_plus = F.col("below") + F.col("hits") / 2
    total = n * (n + 1) / 2
    joined = joined.withColumn("__w", F.least(w_plus, total - w_plus))
    variance = (n * (n + 1) * (2 * n + 1) - F.col("tie_cubes") / 2) / 24
    z = F.try_divide(F.col("__w") - n * (n + 1) / 4, F.sqrt(variance))
    approx = normal_two_sided(z)
    exact = (n <= exact_max) & (F.col("__tied") == 0)
    return joined.select(
        *by,
        "n_pairs", "mean_a", "mean_b", "mean_difference", "median_difference",
        "wins_a", "ties", "wins_b",
        (F.col("n_pairs") >= 6).alias("can_reach_0_05"),
        F.when(F.col("__flat"), 0.0).otherwise(F.col("__w")).alias("statistic"),
        F.when(F.col("__flat"), 1.0)
        .when(exact, signed_rank_p(n, F.col("__w")))
        .otherwise(approx)
        .alias("p_value"),
    )


def _effects() -> list[Column]:
    d = F.col("__d")
    return [
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("__a").alias("mean_a"),
        F.avg("__b").alias("mean_b"),
        F.avg(F.col("__a") - F.col("__b")).alias("mean_difference"),
        F.count_if(d > 0).alias("wins_a"),
        F.count_if(is_close(d)).alias("ties"),
        F.count_if(d < 0).alias("wins_b"),
        F.every(is_close(d)).alias("__flat"),
    ]


def _largest(rows: DataFrame, by: Sequence[str]) -> int:
    return rows.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _ranked_in_groups(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Effects, medians and rank sums of groups that each fit a task, by one exchange on the group."""
    d = F.col("__d")
    nonzero = F.when(d != 0, F.abs(d))
    tied = F.count(nonzero).over(Window.partitionBy(*by, nonzero))
    # nulls, the zero differences, come last and so do not shift a rank
    placed = F.rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(nonzero)))
    marked = diffs.select(*by, "__a", "__b", "__d", nonzero.isNotNull().alias("__used"), tied.alias("__t"), placed.alias("__r"))
    hit = F.col("__used") & (d > 0)
    used = F.count_if("__used")
    grouped = marked.groupBy(*by).agg(
        *_effects(),
        F.median("__d").alias("median_difference"),
        F.sum(F.when(hit, F.col("__r") - 1 + F.col("__t") / 2)).alias("below"),
        F.count_if(hit).cast("double").alias("hits"),
        used.cast("double").alias("mass"),
        F.sum(F.when(F.col("__used"), F.col("__t") * F.col("__t") - 1)).cast("double").alias("tie_cubes"),
        F.count_if(F.col("__used") & (F.col("__t") > 1)).alias("__tied"),
    )
    return grouped.where("n_pairs >= 2").withColumns(
        {"below": F.when(F.col("mass") > 0, F.coalesce("below", F.lit(0.0))), **{c: F.when(F.col("mass") > 0, F.col(c)) for c in ("hits", "mass", "tie_cubes", "__tied")}}
    )


def _ranked_apart(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same where a group may be too large for a task: by range sorts over all groups."""
    effects = diffs.groupBy(*by).agg(*_effects())
    middle = group_medians(diffs, by, "__d", "median_difference")
    positive = (F.col("__d") > 0).cast("int")
    ranks = rank_totals(
        diffs.where("__d != 0"), by, F.abs("__d"), hits=positive, mass=F.lit(1)
    ).withColumnRenamed("ties", "__tied")
    return join_on(
        join_on(effects.where("n_pairs >= 2"), middle, by, "left"), ranks, by, "left"
    )


def holm(tests: DataFrame, by: Sequence[str], p: str = "p_value", tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values per family: ``p_holm`` and ``significant_0_05``."""
    tests = stage(tests, "tests")
    if _largest(tests, by) <= GROUP_ROWS:
        family = Window.partitionBy(*by)
        order = family.orderBy(p, *tie)
        step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p))
        stepped = tests.withColumn("__step", step)
        adjusted = stepped.withColumn("p_holm", F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return adjusted.drop("__step").withColumn("significant_0_05", F.col("p_holm") < 0.05)
    placed = row_index_within(tests, by, [p, *tie], "__rank", "__tests", "__family")
    step = F.least(F.lit(1.0), (F.col("__tests") - F.col("__rank")) * F.col(p))
    adjusted = running_over(placed, ["__family"], "__rank", maxes={"p_holm": step})
    return adjusted.withColumn("significant_0_05", F.col("p_holm") < 0.05).drop(
        "__rank", "__tests", "__family"
    )


def best_and_stop_epoch(
    history: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    value: str = "val_f1_macro",
    patience: int = 10,
) -> DataFrame:
    """(run_id, best_epoch, best_value, stop_epoch).

    Best is the first epoch with the highest value. Training stops at the first epoch that
    lies ``patience`` or more epochs after the last strict improvement; null if never. Epochs
    are counted by their position in the run.
    """
    rows = history.select(
        F.col(run).alias("run_id"), F.col(epoch).alias("epoch"), F.col(value).alias("v")
    )
    rows = stage(rows, "history")
    if _largest(rows, ["run_id"]) <= GROUP_ROWS:
        order = Window.partitionBy("run_id").orderBy("epoch")
        seen = order.rowsBetween(Window.unboundedPreceding, -1)
        before = rows.withColumn("__i", F.row_number().over(order) - 1).withColumn("__best", F.max("v").over(seen))
        improved = F.when(F.col("__best").isNull() | (F.col("v") > F.col("__best")), F.col("__i"))
        marked = before.withColumn("__last", F.max(improved).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return _best_and_stop(marked, patience)
    placed = row_index_within(rows, ["run_id"], ["epoch"], "__i", group_column="__run")
    before = running_over(placed, ["__run"], "__i", maxes={"__best": F.col("v")}, inclusive=False)
    improved = F.when(F.col("__best").isNull() | (F.col("v") > F.col("__best")), F.col("__i"))
    return _best_and_stop(running_over(before, ["__run"], "__i", maxes={"__last": improved}), patience)


def _best_and_stop(marked: DataFrame, patience: int) -> DataFrame:
    return marked.groupBy("run_id").agg(
        F.max_by("epoch", F.struct(F.col("v"), -F.col("__i"))).alias("best_epoch"),
        F.max("v").alias("best_value"),
        F.min(F.when(F.col("__i") - F.col("__last") >= patience, F.col("epoch"))).alias(
            "stop_epoch"
        ),
    )


def backfill_reference(
    runs: DataFrame,
    reference: DataFrame,
    overrides: dict[str, Column],
    keys: Sequence[str],
    family: str,
) -> DataFrame:
    """Reference rows re-labelled for ``family``, except where an explicit run exists."""
    candidate = reference.withColumns({"family": F.lit(family), **overrides})
    explicit = runs.where(F.col("family") == family).select(
        *[F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)]
    ).distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__e{i}"))
    return candidate.join(explicit, on, "left_anti")


def macro_f1_report(
    runs: DataFrame, display: dict[str, str], dataset: str = "dataset", model: str = "model",
    value: str = "f1_macro", keep: Sequence[str] = (),
) -> DataFrame:
    """(dataset, model display name, macro F1 as a 4-decimal text), plus the ``keep`` columns."""
    names = F.create_map(*[F.lit(x) for pair in display.items() for x in pair])
    return runs.where(F.col(model).isin(list(display))).select(
        F.col(dataset).alias("dataset"),
        F.try_element_at(names, F.col(model)).alias("model"),
        *keep,
        F.format_string("%.4f", F.col(value)).alias("macro_f1"),
    )
