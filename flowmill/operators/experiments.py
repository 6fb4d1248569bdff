"""Experiment grids as tables: what to run, what is already done, which options apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arms of the grid.
ABLATION_VARIANTS = ("no_multiscale", "no_attention", "no_focal_loss")
LEAKAGE_PROTOCOLS = ("attack_cat", "id", "both")
WINDOW_LENGTHS = (1, 8, 16, 32)
BASE_WINDOW = 16
HYPER_VALUES = {
    "hidden_channels": ["32", "64", "128"],
    "focal_gamma": ["1.0", "2.0", "3.0"],
    "learning_rate": ["0.0001", "0.0005", "0.001"],
    "dropout": ["0.0", "0.1", "0.3"],
}
HYPER_BASE = {
    "hidden_channels": "64", "focal_gamma": "2.0", "learning_rate": "0.0005", "dropout": "0.1",
}
# Option overrides of each ablation variant; absent means unchanged.
VARIANT_OVERRIDES = {
    "full": {},
    "no_multiscale": {"kernel_sizes": "3"},
    "no_attention": {"channel_attention": "false", "temporal_attention": "false"},
    "no_focal_loss": {"focal_loss": "false"},
}


@dataclass(frozen=True)
class GridSpec:
    """Names the grid is built over."""

    datasets: Sequence[str]
    seeds: Sequence[int]
    models: Sequence[str]
    main_model: str
    repeated: Mapping[str, Sequence[str]] = field(default_factory=dict)
    leakage_dataset: str = ""
    leakage_models: Sequence[str] = ()
    temporal_dataset: str = ""
    temporal_models: Sequence[str] = ()
    window_lengths: Sequence[int] = WINDOW_LENGTHS
    all_models_all_seeds: bool = False


_COLUMNS = (
    "family", "dataset", "model", "variant", "seed", "seq_len", "leakage_protocol",
    "split_policy", "record_order", "parameter", "value", "output_path", "reuse_path",
)
_SCHEMA = ", ".join(f"{c} {'INT' if c in ('seed', 'seq_len') else 'STRING'}" for c in _COLUMNS)
# Options of a run that no family overrides.
_DEFAULTS = {
    "variant": "full", "seq_len": BASE_WINDOW, "leakage_protocol": "clean",
    "split_policy": "default", "record_order": "original", "parameter": None, "value": None,
}


def _family(family: str, path: Sequence[str], reuse=None, **dims: Sequence) -> list[dict]:
    """All combinations of the given dimension values with the path of each run.

    ``path`` names the path parts below the family; ``reuse`` tells for a run whether a
    finished main run already covers it.
    """
    runs = []
    for values in product(*dims.values()):
        run = {**_DEFAULTS, "family": family, **dict(zip(dims, values))}
        parts = [part.format(**run) for part in path]
        run["output_path"] = "/".join([family, *parts, "seed_{seed}".format(**run)])
        covered = reuse is not None and reuse(run)
        run["reuse_path"] = "main/{dataset}/{model}/seed_{seed}".format(**run) if covered else None
        runs.append(run)
    return runs


def plan_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every run of every family, one row each (as many as the parameters span).

    The first seed covers all models; the other seeds only the pre-chosen comparison set
    of a dataset (or all models on request). Ablation varies one arm over all seeds,
    leakage over the first three; the sensitivity families use the first seed only. Rows
    that repeat a main run name it in ``reuse_path``.
    """
    seeds, main = list(spec.seeds), [spec.main_model]
    first, rest, three = seeds[:1], seeds[1:], seeds[:3]
    per_model = ["{dataset}", "{model}"]
    runs = _family("main", per_model, dataset=spec.datasets, model=spec.models, seed=first)
    for dataset in spec.datasets:
        again = spec.models if spec.all_models_all_seeds else spec.repeated.get(dataset, [])
        runs += _family("main", per_model, dataset=[dataset], model=again, seed=rest)
    runs += _family(
        "ablation", ["{dataset}", "{variant}"],
        dataset=spec.datasets, model=main, variant=ABLATION_VARIANTS, seed=seeds,
    )
    runs += _family(
        "window", ["{dataset}", "L{seq_len}"], lambda r: r["seq_len"] == BASE_WINDOW,
        dataset=spec.datasets, model=main, seq_len=spec.window_lengths, seed=first,
    )
    runs += _family(
        "order_sanity", ["{dataset}", "{record_order}"], lambda r: r["record_order"] == "original",
        dataset=spec.datasets, model=main, record_order=("original", "shuffled"), seed=first,
    )
    if spec.leakage_dataset:
        one = [spec.leakage_dataset]
        runs += _family(
            "leakage", ["{leakage_protocol}", "{model}"], lambda r: r["leakage_protocol"] == "clean",
            dataset=one, model=spec.leakage_models,
            leakage_protocol=("clean", *LEAKAGE_PROTOCOLS), seed=three,
        )
        for parameter, values in HYPER_VALUES.items():
            for value in values:
                token = value.replace(".", "p")
                runs += _family(
                    "hyper", ["{parameter}", token],
                    lambda r: r["value"] == HYPER_BASE[r["parameter"]],
                    dataset=one, model=main, parameter=[parameter], value=[value], seed=first,
                )
    if spec.temporal_dataset:
        runs += _family(
            "temporal", ["{model}"], dataset=[spec.temporal_dataset], model=spec.temporal_models,
            split_policy=["day_holdout"], seed=first,
        )
    return spark.createDataFrame([tuple(r[c] for c in _COLUMNS) for r in runs], _SCHEMA)


def plan_pending(plan: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    """Planned runs without a finished record, given the finished ``output_path`` values.

    A row covered by a finished main run is never pending; ``force`` repeats the others.
    """
    done = finished.select(F.col("output_path").alias("__done")).distinct()
    pending = plan.join(done, F.col("reuse_path") == F.col("__done"), "left_anti")
    if force:
        return pending
    return pending.join(done, F.col("output_path") == F.col("__done"), "left_anti")


def apply_overrides(
    base: DataFrame, variant: str = "variant", overrides: Mapping[str, Mapping[str, str]] | None = None
) -> DataFrame:
    """Overlay each row's options with those its variant overrides."""
    table = VARIANT_OVERRIDES if overrides is None else overrides
    changed = sorted({k for options in table.values() for k in options})
    out = {}
    for option in changed:
        value: Column = F.col(option)
        for name, options in table.items():
            if option in options:
                value = F.when(
                    F.col(variant) == name, F.lit(options[option]).cast(base.schema[option].dataType)
                ).otherwise(value)
        out[option] = value
    return base.withColumns(out)
