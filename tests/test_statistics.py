import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from flowmill.functions.distributions import signed_rank_p_values, t_quantile, t_quantile_column
from flowmill.operators import experiments, statistics
from flowmill.plans import compare

# Published validation macro F1 of 21 epochs; best at 11, stopped at 21 with patience 10.
HISTORY = [
    0.81492, 0.784114, 0.844632, 0.834581, 0.839771, 0.839932, 0.84431, 0.815378, 0.848429, 0.830574, 0.853626,
    0.845339, 0.827, 0.82806, 0.830623, 0.830323, 0.823535, 0.846928, 0.84804, 0.84156, 0.844188,
]


def test_history(spark):
    rows = [("a", i + 1, v) for i, v in enumerate(HISTORY)] + [("b", 1, 0.5), ("b", 2, 0.5), ("b", 3, 0.4)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, val_f1_macro double")
    got = {r.run_id: r for r in statistics.best_and_stop_epoch(df).collect()}
    assert (got["a"].best_epoch, got["a"].stop_epoch) == (11, 21)
    assert (got["b"].best_epoch, got["b"].stop_epoch) == (1, None)


def test_t_quantiles(spark):
    assert t_quantile(0.975, 4) == pytest.approx(2.7764451051977987)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736432095)
    far = spark.range(1).select(t_quantile_column(F.lit(150)).alias("t"), t_quantile_column(F.lit(4)).alias("u")).first()
    assert far.t == pytest.approx(t_quantile(0.975, 150), abs=1e-9) and far.u == pytest.approx(2.7764451051977987)


def test_signed_rank_table_for_five_pairs():
    p = signed_rank_p_values(5)
    assert p[:8] == pytest.approx([0.0625, 0.125, 0.1875, 0.3125, 0.4375, 0.625, 0.8125, 1.0])


def test_signed_rank_table_by_enumeration():
    for n in (1, 4, 8):
        sums = [sum(s) for s in itertools.product(*[(0, r) for r in range(1, n + 1)])]
        want = [min(1.0, 2 * sum(x <= w for x in sums) / 2**n) for w in range(n * (n + 1) // 2 + 1)]
        assert signed_rank_p_values(n) == pytest.approx(want)


def _rank_test(d):
    """Plain-Python signed-rank statistic and normal p-value with tie correction."""
    d = [x for x in d if x != 0]
    order = sorted(abs(x) for x in d)
    rank = {v: (order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in set(order)}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    n = len(d)
    w = min(plus, n * (n + 1) / 2 - plus)
    ties = sum(order.count(v) ** 3 - order.count(v) for v in set(order))
    z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return w, math.erfc(abs(z) / math.sqrt(2))


def test_signed_rank_groups(spark):
    rng = random.Random(9)
    hot = [(round(rng.gauss(0.1, 1), 1), 0.0) for _ in range(900)]  # many ties and zeros
    rows = [("hot", a, b) for a, b in hot]
    rows += [("five", 0.1 * i, 0.0) for i in (1, 2, 3, 4, -5)]
    rows += [("flat", 1.0, 1.0), ("flat", 2.0, 2.0), ("single", 1.0, 0.0)]
    got = {r.g: r for r in statistics.paired_signed_rank(
        spark.createDataFrame(rows, "g string, value_a double, value_b double"), ["g"]
    ).collect()}
    assert "single" not in got
    assert (got["flat"].statistic, got["flat"].p_value, got["flat"].ties) == (0.0, 1.0, 2)
    assert (got["five"].statistic, got["five"].p_value) == (5.0, pytest.approx(0.625))
    assert (got["five"].wins_a, got["five"].wins_b, got["five"].can_reach_0_05) == (4, 1, False)
    w, p = _rank_test([a for a, _ in hot])
    assert got["hot"].statistic == pytest.approx(w) and got["hot"].p_value == pytest.approx(p)
    ordered = sorted(a for a, _ in hot)
    assert got["hot"].median_difference == pytest.approx((ordered[449] + ordered[450]) / 2)


@pytest.mark.parametrize(
    "p,want",
    [((0.0625, 0.0625, 0.0625), (0.1875,) * 3), ((0.0625, 0.0625, 0.625), (0.1875, 0.1875, 0.625)), ((0.01, 0.04, 0.03), (0.03, 0.06, 0.06))],
)
def test_holm_values(spark, p, want):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p_value double")
    got = {r.i: r.p_holm for r in statistics.holm(df, ["f"], tie=["i"]).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want)


def test_holm_never_below_raw(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([("fg"[i % 2], i, rng.random() / 50) for i in range(60)], "f string, i int, p_value double")
    out = statistics.holm(df, ["f"], tie=["i"])
    assert out.where("p_holm < p_value OR p_holm > 1").count() == 0 and out.count() == 60


def test_summary_of_single_run_and_null_metric(spark):
    rows = [("d", "x", 0.5, None), ("d", "y", 0.9, None), ("d", "y", 0.7, 0.4), (None, "y", 0.1, None)]
    df = spark.createDataFrame(rows, "dataset string, model string, accuracy double, auc double")
    got = {(r.dataset, r.model): r for r in statistics.summarize(df, ["dataset", "model"]).collect()}
    assert got["d", "x"].accuracy_std == 0.0 and got["d", "x"].accuracy_ci95_halfwidth == 0.0
    assert got["d", "x"].accuracy_mean_std == "0.5000 ± 0.0000" and got["d", "x"].auc_mean is None
    y = got["d", "y"]
    assert y.accuracy_ci95_halfwidth == pytest.approx(12.706204736432095 * y.accuracy_std / math.sqrt(2))
    assert y.auc_mean == 0.4 and y.n_runs == 2 and (None, "y") in got


def _runs(spark):
    rows = []
    for seed in range(1, 6):
        for model, bonus in (("main", 0.05), ("mlp", 0.0), ("gbt", 0.1)):
            rows.append(("main", "d", model, "full", seed, 0.8 + bonus + seed / 1000 * (1 if model == "main" else 1.5), None, None, None, None))
    rows.append(("window", "d", "main", "full", 1, 0.7, 16, None, None, "window/d/L16/seed_1/metrics.json"))
    rows.append(("hyper", "d", "main", "full", 1, 0.7, None, None, None, "hyper/dropout/0p1/seed_1/metrics.json"))
    schema = "family string, dataset string, model string, variant string, seed int, accuracy double, seq_len int, leakage_protocol string, record_order string, relative_path string"
    return spark.createDataFrame(rows, schema)


def test_reference_rows_fill_only_gaps(spark):
    out = compare.add_reference_rows(_runs(spark), "main", "d", ["main", "gbt"])
    n = {r.family: r["count"] for r in out.groupBy("family").count().collect()}
    # window keeps its explicit seed 1; of the four hyper bases one seed of one option exists
    assert n == {"main": 15, "window": 5, "order_sanity": 5, "leakage": 10, "hyper": 20}
    tables = compare.summaries(out)
    assert tables["window"].first().n_runs == 5
    hyper = {r.sensitivity_parameter: r.n_runs for r in tables["hyper"].collect()}
    assert hyper == {"hidden_channels": 5, "focal_gamma": 5, "learning_rate": 5, "dropout": 5}


def test_pairwise_tests(spark):
    comparisons = spark.createDataFrame([("main", "mlp"), ("main", "gbt")], "comparison_a string, comparison_b string")
    got = {r.comparison_b: r for r in compare.pairwise_tests(
        _runs(spark).where("family='main'"), comparisons, ["dataset"], "model", ["accuracy"]
    ).collect()}
    assert got["mlp"].p_value == pytest.approx(0.0625) and got["mlp"].wins_a == 5
    assert got["gbt"].wins_b == 5 and got["gbt"].p_holm == pytest.approx(0.125)


def test_family_tests_and_ablation_summary(spark):
    extra = [("ablation", "d", "main", "no_attention", s, 0.7 + s / 500, None, None, None, None) for s in range(1, 6)]
    extra += [("leakage", "d", "gbt", "full", s, 0.95 - s / 400, None, "id", None, None) for s in range(1, 6)]
    extra += [("order_sanity", "d", "main", "full", 1, 0.6, None, None, "shuffled", None)]
    extra += [("main", None, "mlp", "full", 1, 0.1, None, None, None, None), ("ablation", "d", "main", None, 1, 0.2, None, None, None, None)]
    runs = _runs(spark).unionByName(spark.createDataFrame(extra, _runs(spark).schema))
    filled = compare.add_reference_rows(runs, "main", "d", ["main", "gbt"])
    got = {(r.family, r.comparison_a, r.comparison_b): r for r in compare.family_tests(filled, "main", ["accuracy"]).collect()}
    # one shuffled seed is no test, arms without runs give none
    assert set(got) == {("main", "main", "gbt"), ("main", "main", "mlp"), ("ablation", "full", "no_attention"), ("leakage", "id", "clean")}
    ablation, leak = got["ablation", "full", "no_attention"], got["leakage", "id", "clean"]
    assert ablation.dataset == "d" and ablation.model is None and ablation.wins_a == 5 and ablation.p_holm == pytest.approx(0.0625)
    assert leak.dataset is None and leak.model == "gbt" and leak.n_pairs == 5
    assert got["main", "main", "gbt"].p_holm == pytest.approx(0.125)  # two tests share a family, one each elsewhere
    summary = {r.ablation_variant: r.n_runs for r in compare.summaries(filled, "main")["ablation"].collect()}
    assert summary == {"full": 5, "no_attention": 5, None: 1}
    assert "ablation" not in compare.summaries(filled)


def test_family_tests_of_no_runs(spark):
    none = compare.add_reference_rows(_runs(spark).where("FALSE"), "main", "d", ["main"])
    assert compare.family_tests(none, "main", ["accuracy"]).count() == 0


def test_seed_pairs_drop_nulls(spark):
    a = spark.createDataFrame([("d", "1", 0.5), ("d", "2", None), ("d", "x", 0.1)], "k string, seed string, value double")
    b = spark.createDataFrame([("d", "1", 0.4), ("d", "2", 0.3)], "k string, seed string, value double")
    assert [(r.seed, r.value_a, r.value_b) for r in statistics.seed_pairs(a, b, ["k"]).collect()] == [(1.0, 0.5, 0.4)]


def test_grid_and_pending(spark):
    spec = experiments.GridSpec(
        datasets=["a", "b"], seeds=[42, 43], models=["main", "mlp"], main_model="main",
        repeated={"a": ["main"]}, leakage_dataset="a", leakage_models=["main"], temporal_dataset="b", temporal_models=["mlp"],
    )
    plan = experiments.plan_grid(spark, spec)
    n = {r.family: r["count"] for r in plan.groupBy("family").count().collect()}
    assert n == {"main": 5, "ablation": 12, "window": 8, "order_sanity": 4, "leakage": 8, "hyper": 12, "temporal": 1}
    assert plan.select("output_path").distinct().count() == plan.count()
    done = spark.createDataFrame([("main/a/main/seed_42",), ("window/a/L8/seed_42",)], "output_path string")
    pending = experiments.plan_pending(plan, done)
    # gone: the two finished runs, and what the main run covers (window 16, original order, clean, 4 base values)
    assert pending.count() == plan.count() - 2 - 7
    assert experiments.plan_pending(plan, done, force=True).count() == plan.count() - 7


def test_overrides(spark):
    df = spark.createDataFrame([("full", "3,5,7", True, True, True), ("no_attention", "3,5,7", True, True, True)],
        "variant string, kernel_sizes string, channel_attention boolean, temporal_attention boolean, focal_loss boolean")
    got = {r.variant: r for r in experiments.apply_overrides(df).collect()}
    assert got["full"].channel_attention and not got["no_attention"].channel_attention and got["no_attention"].focal_loss


def test_small_and_large_groups_agree(spark, monkeypatch):
    """Windows per group and range sorts over all groups give the same rows."""
    import random

    from flowmill.operators import statistics

    rng = random.Random(4)
    rows = [(g, rng.randrange(6) / 2, rng.randrange(6) / 2) for g in ("a", "b", "c", None) for _ in range({"a": 40, "b": 9, "c": 1, None: 5}[g])]
    rows += [("flat", 1.0, 1.0)] * 3 + [("untied", float(2 ** i), 0.0 if i % 3 else 3.0 * 2 ** i) for i in range(8)]
    pairs = spark.createDataFrame(rows, "g string, value_a double, value_b double").repartition(4)
    curve = [(r, e, v) for r in "xyz" for e, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.4, 0.1, 0.1, 0.1][: {"x": 8, "y": 3, "z": 1}[r]])]
    history = spark.createDataFrame(curve, "run_id string, epoch int, val_f1_macro double").repartition(3)

    def run():
        tests = statistics.paired_signed_rank(pairs, ["g"])
        done = statistics.holm(tests.withColumn("f", F.lit("f")), ["f"], tie=["g"]).collect()
        epochs = statistics.best_and_stop_epoch(history, patience=2).collect()
        return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in done), key=str), sorted(map(tuple, epochs))

    want = run()
    assert len(want[0]) == 5
    monkeypatch.setattr(statistics, "GROUP_ROWS", 0)
    assert run() == want
