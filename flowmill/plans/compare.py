"""Multi-seed comparison of experiment runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.paths import path_part
from flowmill.operators.experiments import ABLATION_VARIANTS, LEAKAGE_PROTOCOLS
from flowmill.operators.statistics import (
    TESTED_METRICS, backfill_reference, comparison_pairs, holm, melt_metrics, paired_signed_rank,
    summarize,
)
from flowmill.session import stage

# Path tokens of the base value of each varied option.
BASE_TOKENS = {
    "hidden_channels": "64", "focal_gamma": "2p0", "learning_rate": "0p0005", "dropout": "0p1",
}


def add_reference_rows(
    runs: DataFrame, main_model: str, leakage_dataset: str, leakage_models: Sequence[str]
) -> DataFrame:
    """Union main runs into the families that vary one thing, as their base setting.

    A reference row is left out where an explicit run of the same key exists. The runs are read once
    and staged, as is the result, which summaries and tests read again and again.
    """
    runs = stage(runs, "runs")
    main = runs.where(F.col("family") == "main")
    of_model = main.where(F.col("model") == main_model)
    parts = [
        backfill_reference(
            runs,
            main.where(
                (F.col("dataset") == leakage_dataset) & F.col("model").isin(list(leakage_models))
            ),
            {"leakage_protocol": F.lit("clean")},
            ["model", "seed", "leakage_protocol"],
            "leakage",
        ),
        backfill_reference(
            runs, of_model, {"seq_len": F.lit(16)}, ["dataset", "seed", "seq_len"], "window"
        ),
        backfill_reference(
            runs, of_model, {"record_order": F.lit("original")},
            ["dataset", "seed", "record_order"], "order_sanity",
        ),
    ]
    base = of_model.where(F.col("dataset") == leakage_dataset)
    tokens = F.array(
        *[F.concat(F.lit(f"hyper/{p}/{v}/seed_"), F.col("seed").cast("int"), F.lit("/metrics.json"))
          for p, v in BASE_TOKENS.items()]
    )
    hyper = base.withColumn("relative_path", F.explode(tokens))
    parts.append(backfill_reference(runs, hyper, {}, ["relative_path"], "hyper"))
    out = runs
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return stage(out, "families")


def ablation_runs(runs: DataFrame, main_model: str) -> DataFrame:
    """Runs by ``ablation_variant``: the main model's own as ``full``, the ablation family by variant."""
    full = (F.col("family") == "main") & (F.col("model") == main_model)
    chosen = runs.where(full | (F.col("family") == "ablation"))
    return chosen.withColumn("ablation_variant", F.when(full, F.lit("full")).otherwise(F.col("variant")))


def summaries(runs: DataFrame, main_model: str | None = None) -> dict[str, DataFrame]:
    """One summary table per family; the ablation table needs the main model's name."""
    family = lambda name: runs.where(F.col("family") == name)
    hyper = family("hyper").withColumns(
        {
            "sensitivity_parameter": path_part(F.col("relative_path"), 1),
            "sensitivity_value": path_part(F.col("relative_path"), 2),
        }
    )
    out = {
        "main": summarize(family("main"), ["dataset", "model", "variant"]),
        "leakage": summarize(family("leakage"), ["leakage_protocol", "model"]),
        "window": summarize(family("window"), ["dataset", "seq_len"]),
        "order_sanity": summarize(family("order_sanity"), ["dataset", "record_order"]),
        "temporal": summarize(family("temporal"), ["dataset", "model"]),
        "hyper": summarize(hyper, ["sensitivity_parameter", "sensitivity_value"]),
    }
    if main_model is not None:
        out["ablation"] = summarize(ablation_runs(runs, main_model), ["dataset", "ablation_variant"])
    return out


def family_arms(runs: DataFrame, main_model: str, metrics: Sequence[str] = TESTED_METRICS) -> DataFrame:
    """What the tested families compare: (family, dataset, model, arm, seed, metrics).

    The context of a comparison is the data set, or in the leakage family the model; the other of
    the two columns is null. Runs without a context or an arm take no part.
    """

    def arms(rows: DataFrame, family: str, arm: str, context: str = "dataset") -> DataFrame:
        names = [F.col(c) if c == context else F.lit(None).cast("string").alias(c) for c in ("dataset", "model")]
        chosen = rows.select(F.lit(family).alias("family"), *names, F.col(arm).alias("arm"), "seed", *metrics)
        return chosen.where(F.col("arm").isNotNull() & F.col(context).isNotNull())

    of = lambda name: runs.where(F.col("family") == name)
    return (
        arms(of("main"), "main", "model")
        .unionByName(arms(ablation_runs(runs, main_model), "ablation", "ablation_variant"))
        .unionByName(arms(of("leakage"), "leakage", "leakage_protocol", "model"))
        .unionByName(arms(of("order_sanity"), "order_sanity", "record_order"))
    )


def family_comparisons(runs: DataFrame, main_model: str) -> DataFrame:
    """(family, comparison_a, comparison_b): the ready lists of all tested families.

    The main model meets every other model that has main runs; the other families' lists are fixed.
    """
    fixed = [("ablation", "full", v) for v in ABLATION_VARIANTS]
    fixed += [("leakage", p, "clean") for p in LEAKAGE_PROTOCOLS]
    fixed += [("order_sanity", "original", "shuffled")]
    listed = runs.sparkSession.createDataFrame(fixed, "family string, comparison_a string, comparison_b string")
    others = runs.where((F.col("family") == "main") & (F.col("model") != main_model)).select("model").distinct()
    return others.select(
        F.lit("main").alias("family"), F.lit(main_model).alias("comparison_a"), F.col("model").alias("comparison_b")
    ).unionByName(listed)


def family_tests(runs: DataFrame, main_model: str, metrics: Sequence[str] = TESTED_METRICS) -> DataFrame:
    """Signed-rank tests of the main, ablation, leakage and order families, Holm-adjusted.

    All families are tested together; the adjustment is within (family, data set or model, metric).
    Comparisons with fewer than two common seeds give no row.
    """
    context = F.coalesce("dataset", "model").alias("context")
    arms = family_arms(runs, main_model, metrics)
    long = melt_metrics(arms.select("family", context, "arm", "seed", *metrics), ["family", "context", "arm", "seed"], metrics)
    pairs = comparison_pairs(long, family_comparisons(runs, main_model), ["family", "context"], "arm")
    tests = paired_signed_rank(pairs, ["family", "context", "metric", "comparison_a", "comparison_b"])
    adjusted = holm(tests, ["family", "context", "metric"], tie=["comparison_a", "comparison_b"])
    by_model = F.col("family") == "leakage"
    return adjusted.withColumns(
        {"dataset": F.when(~by_model, F.col("context")), "model": F.when(by_model, F.col("context"))}
    ).drop("context")


def pairwise_tests(
    runs: DataFrame,
    comparisons: DataFrame,
    context: Sequence[str],
    arm: str,
    metrics: Sequence[str] = TESTED_METRICS,
) -> DataFrame:
    """Signed-rank tests of every listed comparison in every context, Holm-adjusted.

    Families of the adjustment are (context, metric). All comparisons run in one job.
    """
    long = melt_metrics(runs, [*context, arm, "seed"], metrics)
    pairs = comparison_pairs(long, comparisons, context, arm)
    tests = paired_signed_rank(
        pairs, [*context, "metric", "comparison_a", "comparison_b"]
    )
    return holm(tests, [*context, "metric"], tie=["comparison_a", "comparison_b"])
