import math
import random

import pytest
from pyspark.sql import functions as F

from flowmill.functions import probability
from flowmill.operators import audit, evaluation, refinement
from flowmill.plans.leakage import audit as full_audit
from flowmill.plans.refine import refine


def _counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)], "y_true int, y_pred int, n long")


# Published test-set confusion counts and the metrics derived from them.
TEST = (349931, 14778, 28407, 31051)
VAL = (221513, 7684, 52260, 142709)


def test_published_metrics(spark):
    counts = _counts(spark, *TEST)
    m = evaluation.classification_metrics(counts).first()
    assert m.accuracy == pytest.approx(0.8981886851169468)
    assert m.precision_macro == pytest.approx(0.8012283833238709)
    assert m.recall_macro == pytest.approx(0.7408571029557697)
    assert m.f1_macro == pytest.approx(0.765858301129656)
    assert m.precision_weighted == pytest.approx(0.8902401967864786)
    assert m.f1_weighted == pytest.approx(0.8925328559543693)
    assert m.fpr_macro == pytest.approx(0.2591428970442304)
    assert evaluation.false_positive_rates(counts).first().fpr_attack_positive == pytest.approx(0.04051997620020345)
    val = evaluation.classification_metrics(_counts(spark, *VAL)).first()
    assert val.f1_macro == pytest.approx(0.8536256631, abs=1e-9)


def test_published_threshold_metrics(spark):
    cells = _counts(spark, *TEST)
    rows = cells.withColumn("y_prob", F.when(F.col("y_pred") == 1, 0.9).otherwise(0.1))
    # weights instead of 424k rows: repeat each cell by its gcd-free share of a small table
    small = rows.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") / 1000).cast("int"))))
    m = evaluation.threshold_metrics(small, by=[]).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (349, 14, 28, 31)
    assert m.fpr == pytest.approx(14 / 363) and m.fnr == pytest.approx(28 / 59)
    assert m.auc == pytest.approx(((349 / 363) + (31 / 59)) / 2)


def test_rates_need_exactly_two_labels(spark):
    counts = spark.createDataFrame([(0, 0, 5), (1, 2, 3)], "y_true int, y_pred int, n long")
    assert evaluation.false_positive_rates(counts).first().fpr_attack_positive is None


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y_true int, y_prob double")
    m = evaluation.threshold_metrics(df).first()
    assert m.accuracy == 1.0 and m.f1_macro == 1.0 and m.auc is None and m.fnr == 0.0


def test_report_lists_absent_labels(spark):
    rep = {r.row: r for r in evaluation.class_report(_counts(spark, 5, 1, 2, 4), [0, 1, 2]).collect()}
    assert rep["2"].support == 0 and rep["2"].f1 == 0.0
    assert rep["accuracy"].f1 == pytest.approx(9 / 12)
    assert rep["weighted avg"].recall == pytest.approx(9 / 12)


def test_auc_with_ties_and_many_slices(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), rng.choice([0.0, rng.random()])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double").repartition(5)
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df).first().auc == pytest.approx(want)


def test_argmax_and_threshold_break_ties_differently(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "p array<double>").select(
        probability.argmax(F.col("p")).alias("a"), probability.at_threshold(F.col("p")[1]).alias("t")
    )
    assert df.first().asDict() == {"a": 0, "t": 1}


def test_probability_out_of_range(spark):
    df = spark.createDataFrame([([1.5],)], "p array<double>")
    assert df.select(probability.attack_probability(F.col("p")).alias("v")).first().v is None
    with pytest.raises(Exception, match="outside"):
        df.select(probability.attack_probability(F.col("p"), strict=True)).collect()


def test_focal_reduces_to_cross_entropy(spark):
    df = spark.createDataFrame([(0.25,)], "p double").select(
        probability.focal(F.col("p"), 0.0).alias("a"), probability.focal(F.col("p"), 2.0, F.lit(2.0)).alias("b"),
        probability.focal_weight_inside(F.col("p"), 2.0, F.lit(2.0)).alias("c"),
    ).first()
    ce = -math.log(0.25)
    assert df.a == pytest.approx(ce)
    assert df.b == pytest.approx(2 * 0.75**2 * ce)
    assert df.c == pytest.approx((1 - 0.25**2) ** 2 * 2 * ce)


# --- refinement ---------------------------------------------------------------


def _tables(spark, n=200):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.5), rng.random(), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, y_true int, a double, b double")
    return df.select("row_id", "y_true", F.col("a").alias("y_prob")), df.select("row_id", "y_true", F.col("b").alias("y_prob"))


def test_alpha_one_is_the_first_model(spark):
    a, b = _tables(spark)
    search = {round(r.alpha, 1): r for r in refinement.alpha_search(refinement.align_predictions(a, b)).collect()}
    assert search[1.0].auc == pytest.approx(evaluation.roc_auc(a).first().auc)
    assert search[0.0].f1_macro == pytest.approx(evaluation.threshold_metrics(b).first().f1_macro)
    assert len(search) == 11


def test_first_listed_weight_wins_a_tie_and_nulls_are_skipped(spark):
    rows = [(0, 0.3, 0.5, None), (1, 0.1, 0.5, 0.2), (2, 0.9, 0.4, 0.2)]
    s = spark.createDataFrame(rows, "grid_pos int, alpha double, f1_macro double, auc double").withColumn("fpr", F.col("f1_macro"))
    assert refinement.select_alpha(s, "f1_macro").first().alpha == 0.3
    assert refinement.select_alpha(s, "auc").first().alpha == 0.1
    assert refinement.select_alpha(s, "fpr").first().alpha == 0.9
    with pytest.raises(ValueError):
        refinement.select_alpha(s, "n")


def test_refine_rejects_misaligned_tables(spark):
    a, b = _tables(spark)
    with pytest.raises(ValueError):
        refine(a, b.where("row_id <> 3"), a, b)
    out = refine(a, b, a, b)
    assert out["predictions"].count() == 200 and out["metrics"].count() == 1


# --- audit --------------------------------------------------------------------


def _split_rows(spark):
    rows = (
        [(i, "train", "a", 1.0, 0, i) for i in range(300)]  # one hot duplicate
        + [(300 + i, "val", "a", 1.0, 1, i) for i in range(5)]
        + [(400 + i, "test", "b", float(i), 0, i) for i in range(10)]
        + [(500, "train", None, 2.0, 1, 300), (501, "test", None, 2.0, 1, 10)]
    )
    return spark.createDataFrame(rows, "id long, split string, srcip string, v double, y int, split_idx long")


def test_audit_numbers(spark):
    t = full_audit(_split_rows(spark), ["srcip", "v"], category="srcip", seq_len=3)
    dup = {r.split: r for r in t["duplicates"].collect()}
    assert (dup["train"].rows, dup["train"].unique_feature_rows, dup["train"].duplicate_rows_beyond_first) == (301, 2, 299)
    over = {(r.first_split, r.second_split): r for r in t["overlap"].collect()}
    assert (over["train", "val"].common_unique, over["train", "val"].rows_first, over["train", "val"].rows_second) == (1, 300, 5)
    assert over["train", "test"].rows_second == 1  # the row with a missing address
    c = t["conflicts"].first()
    assert (c.conflicting_feature_rows, c.rows_in_conflict) == (1, 305)
    assert t["purity"].first().majority_accuracy == pytest.approx((300 + 10 + 2) / 317)
    assert "sessions" not in t  # a source alone does not identify a session
    order = {r.split: r for r in t["order"].collect()}
    assert order["test"].adjacent_label_agreement == pytest.approx(9 / 10)
    assert order["val"].lag1_label_correlation is None
    assert t["windows"].first().cross_split_windows == 0


def test_dependence_across_chunks_and_single_rows(spark):
    rng = random.Random(4)
    ys = [rng.randint(0, 1) for _ in range(101)]
    df = spark.createDataFrame([("s", float(y), i) for i, y in enumerate(ys)] + [("one", 1.0, 0)], "split string, y double, i long")
    got = {r.split: r for r in audit.dependence_of(df, "i", chunk_rows=7).collect()}
    x, z = ys[:-1], ys[1:]
    mx, mz = sum(x) / 100, sum(z) / 100
    cov = sum((a - mx) * (b - mz) for a, b in zip(x, z))
    want = cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - mz) ** 2 for b in z))
    assert got["s"].lag1_label_correlation == pytest.approx(want)
    assert got["s"].adjacent_label_agreement == pytest.approx(sum(a == b for a, b in zip(x, z)) / 100)
    assert got["one"].adjacent_label_agreement is None
    direct = audit.adjacent_dependence(df, "y", ["i"]).where("split='s'").first()
    assert direct.lag1_label_correlation == pytest.approx(want)


@pytest.mark.parametrize(
    "columns,key",
    [
        (["Flow-ID", "srcip", "dstip"], ["Flow-ID"]),
        (["src_ip", "dst-ip", "sport", "Protocol", "x"], ["src_ip", "dst-ip", "sport", "Protocol"]),
        (["Source IP", "Destination IP", "dsport"], ["Source IP", "Destination IP", "dsport"]),
        (["srcip", "Timestamp"], []),
    ],
)
def test_session_key(columns, key):
    assert audit.session_key(columns) == key


def test_rows_that_share_a_digest_are_told_apart(spark, monkeypatch):
    from flowmill.operators import audit

    rows = [(i % 5, "train" if i % 2 else "test", i % 5 == 0 and i > 10) for i in range(40)]
    df = spark.createDataFrame([(float(a), s, int(y)) for a, s, y in rows], "a double, split string, y int")

    def run():
        groups = audit.feature_groups(df, ["a"], "y")
        return sorted(map(tuple, groups.collect()))

    want, real = run(), audit.row_hash
    monkeypatch.setattr(audit, "row_hash", lambda d, c, salt: real(d, c, salt) if salt > 1 else real(d, c, salt) % 2)
    assert run() == want and len(want) == 5
