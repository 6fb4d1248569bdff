import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.functions import labels
from flowmill.functions.hashing import row_hash
from flowmill.functions.paths import macro_f1, value_token
from flowmill.operators import cleaning, features, quantiles, sequence, splits
from flowmill.operators.ordering import Indexed, row_index
from flowmill.plans.prepare import prepare


def _split(spark, n, ratio=0.15):
    df = spark.range(n).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    return splits.split_sequential(row_index(df, ["id"]), ratio)


# --- medians ------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 501, 3000])
def test_medians_narrow_to_the_exact_value(spark, n):
    rng = random.Random(n)
    rows = [
        (rng.random(), float(rng.choice([1, 1, 1, 2, 5])), None, rng.gauss(0, 1) if i % 3 else None)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    # a coarse sketch and a tiny limit force several narrowing rounds
    got = {
        r.feature: r.median
        for r in quantiles.medians(df, ["a", "b", "c", "d"], sketch_size=64, gather_limit=5).collect()
    }
    for i, c in enumerate("abd"):
        values = [r["abcd".index(c)] for r in rows if r["abcd".index(c)] is not None]
        assert got[c] == (statistics.median(values) if values else None)
    assert got["c"] is None


def test_median_with_a_hot_value_next_to_the_middle(spark):
    # a third of the rows share one value; the middle falls right beside the block
    values = [0.0] * 334 + [float(i) for i in range(1, 668)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = quantiles.medians(df, ["a"], sketch_size=64, gather_limit=3).first().median
    assert got == statistics.median(values)


# --- cleaning and labels ------------------------------------------------------


def test_order_statistics_with_counts_and_missed_brackets(spark, monkeypatch):
    rows = [(float(i % 50), None if i % 3 else float(-i), 7.0, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d long").repartition(5)
    columns = [sorted(r[j] for r in rows if r[j] is not None) for j in range(4)]
    targets = {"a": [0, 1], "b": [500], "c": [2999], "d": [1234]}

    def check(**options):
        found = quantiles.order_statistics(df, targets, **options)
        for (name, ranks), values in zip(targets.items(), columns, strict=True):
            for k, got in zip(ranks, found[name], strict=True):
                v = values[k]
                assert (got.value, got.below, got.at) == (v, sum(x < v for x in values), values.count(v))

    check()
    check(sketch_size=64, gather_limit=10)
    quantile = quantiles.F.kll_sketch_get_quantile_double
    monkeypatch.setattr(quantiles.F, "kll_sketch_get_quantile_double", lambda s, r: quantiles.F.transform(quantile(s, r), lambda x: x + 3))
    check(gather_limit=10)  # brackets that miss are opened


def test_clean_drops_nan_infinity_and_texts(spark):
    rows = [(1.0, "x"), (float("nan"), "x"), (float("inf"), "x"), (2.0, "-inf"), (3.0, None), (4.0, "y")]
    df = spark.createDataFrame(rows, "a double, b string")
    assert [r.a for r in cleaning.clean_drop_invalid(df).orderBy("a").collect()] == [1.0, 4.0]


def test_clean_names(spark):
    df = spark.range(1).toDF("﻿ a ")
    assert cleaning.clean_column_names(df).columns == [" a"]


def test_dotted_one_reads_differently_in_the_two_label_forms(spark):
    df = spark.createDataFrame([("1.0",)], "t string").select(
        labels.binary_text(F.col("t"), "unsw").alias("text"), labels.binary_flag(F.col("t"), "unsw").alias("flag")
    )
    assert df.first().asDict() == {"text": "normal", "flag": 1}


def test_strict_label_raises(spark):
    df = spark.createDataFrame([("weird",)], "t string").select(labels.encode_binary(F.col("t"), strict=True))
    with pytest.raises(Exception, match="unexpected binary label"):
        df.collect()


def test_attack_families_have_39_names():
    assert sum(len(v.split()) for v in labels.ATTACK_FAMILIES.values()) == 39


@pytest.mark.parametrize(
    "text,want",
    [("DoS Hulk", "DoS Hulk"), ("DDoS", "DDoS"), ("Web Attack – XSS", "WebAttack"), ("FTP-Patator", "FTP-Patator"), ("Odd", "Odd")],
)
def test_collapse(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(labels.collapse_multiclass(F.col("t")).alias("l"))
    assert df.first().l == want


def test_row_hash_tells_null_positions_apart(spark):
    df = spark.createDataFrame([(None, 1.0, None), (1.0, None, None), (1.0, None, "<MISSING>")], "a double, b double, c string")
    h = [r.h for r in df.select(row_hash(df, ["a", "b", "c"]).alias("h")).collect()]
    assert h[0] != h[1] and h[1] == h[2]


def test_value_token_and_macro_f1(spark):
    df = spark.createDataFrame([(0.5, '{"macro_f1": 0.7}')], "v double, d string").select(
        value_token(F.col("v")).alias("t"), macro_f1(F.col("d")).alias("m")
    )
    assert df.first().asDict() == {"t": "0p5", "m": 0.7}


# --- splits -------------------------------------------------------------------


def test_sequential_split_of_the_published_size(spark):
    n = 2_827_876
    rows = Indexed(spark.range(n).withColumnRenamed("id", "row_idx").withColumn("y", F.lit(0)), n, "row_idx")
    info = {r.split: r for r in sequence.data_info(splits.split_sequential(rows, 0.15), "y", 16).collect()}
    assert [info[s].rows for s in ("train", "val", "test")] == [1979513, 424181, 424182]
    assert [info[s].windows for s in ("train", "val", "test")] == [1979498, 424166, 424167]


def test_ordered_tail_keeps_at_least_one_validation_row(spark):
    ix = row_index(spark.range(3), ["id"])
    out = splits.split_ordered_tail(ix, None, 0.01)
    assert {r.id: r.split for r in out.collect()} == {0: "train", 1: "train", 2: "val"}
    with pytest.raises(ValueError):
        splits.split_ordered_tail(row_index(spark.range(1), ["id"]), None, 0.5)


def test_day_holdout_needs_all_days(spark):
    df = spark.createDataFrame([(0,), (3,)], "d int")
    with pytest.raises(ValueError):
        splits.split_day_holdout(df, F.col("d"))


def test_stratified_quotas(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = splits.split_stratified(df, "y", 0.15, F.xxhash64(F.lit(1), "id"), "id")
    val = {r.y: r["count"] for r in out.where("split='val'").groupBy("y").count().collect()}
    assert val == {0: 135, 1: 15} and out.count() == 1000


def test_stratified_ties_follow_the_tie_key(spark):
    # every order key is shared by many rows, and a third of all rows share one
    df = spark.range(3000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    order = F.expr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5 END")
    got = splits.split_stratified(df, "y", 0.15, order, "id")
    w = Window.partitionBy("y").orderBy(order, "id")
    want = df.select("id", (F.row_number().over(w) <= F.when(F.col("y") == 1, 113).otherwise(338)).alias("val"))
    assert got.join(want, "id").where("(split = 'val') <> val").count() == 0
    assert got.where("split = 'val'").count() == 451
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shuffle_is_a_permutation_and_repeatable(spark):
    rows = _split(spark, 500)
    a = splits.shuffle_within_split(rows, seed=7)
    b = splits.shuffle_within_split(rows, seed=7)
    pa, pb = ({r.id: r.split_idx for r in x.collect()} for x in (a, b))
    assert pa == pb and pa != {r.id: r.split_idx for r in rows.collect()}
    for s, n in (("train", 350), ("val", 75), ("test", 75)):
        assert sorted(r.split_idx for r in a.where(F.col("split") == s).collect()) == list(range(n))


def test_weighted_sample_has_exact_size_and_share(spark):
    df = spark.range(4000).select("id", (F.col("id") % 20 == 0).cast("int").alias("y"))
    drawn = splits.sample_with_replacement(df, "y", "id", {0: 1.0, 1: 19.0}, seed=3, block=64)
    counts = {r.y: r["count"] for r in drawn.groupBy("y").count().collect()}
    assert sum(counts.values()) == 4000
    assert abs(counts[1] / 4000 - 0.5) < 0.05
    copies = drawn.groupBy("id", "draw_block").count().agg(F.max("count")).first()[0]
    assert copies <= 64


def test_split_guard(spark):
    rows = _split(spark, 40)
    assert {r.split for r in splits.split_guard(rows, 8).where("violated").collect()} == {"val", "test"}
    with pytest.raises(ValueError):
        splits.split_guard(rows, 8, strict=True)


# --- windows ------------------------------------------------------------------


def _brute_windows(values, length, stride):
    return [tuple(values[i : i + length]) for i in range(0, len(values) - length + 1, stride)]


@pytest.mark.parametrize("length,stride,chunk", [(1, 1, 4), (4, 1, 4), (5, 1, 7), (5, 3, 7), (5, 2, 1000), (4, 4, 8), (3, 7, 8)])
def test_windows_equal_slices(spark, length, stride, chunk):
    rows = _split(spark, 97)
    out = sequence.sequence_windows(rows, ["id"], "y", length, stride, chunk_rows=chunk).collect()
    by_split = {}
    for r in sorted(out, key=lambda r: r.end_idx):
        by_split.setdefault(r.split, []).append((tuple(int(v[0]) for v in r.x), r.y))
    source = {}
    for r in sorted(rows.collect(), key=lambda r: r.split_idx):
        source.setdefault(r.split, []).append(r.id)
    for s, ids in source.items():
        want = _brute_windows(ids, length, stride)
        assert [w for w, _ in by_split[s]] == want
        assert [y for _, y in by_split[s]] == [int(w[-1] % 4 == 0) for w in want]


def test_flat_windows_are_feature_major(spark):
    rows = _split(spark, 60).withColumn("neg", -F.col("id"))
    flat = sequence.flatten_windows(sequence.sequence_windows(rows, ["id", "neg"], "y", 3), 2)
    r = flat.where("split='train' AND end_idx=4").first()
    assert r.flat == [2.0, 3.0, 4.0, -2.0, -3.0, -4.0]


def test_class_weights_with_an_absent_class(spark):
    rows = _split(spark, 100)
    got = {r.y: r for r in sequence.class_weights(rows, "y", [0, 1, 5], 4).collect()}
    n = {k: got[k].windows for k in got}
    raw = {k: sum(n.values()) / max(v, 1) for k, v in n.items()}
    mean = sum(raw.values()) / 3
    assert n[5] == 0 and {k: got[k].weight for k in got} == pytest.approx({k: v / mean for k, v in raw.items()})


def test_windows_that_ignore_the_split_would_be_counted(spark):
    rows = _split(spark, 100)
    clean = sequence.window_dependence(rows, 5).first()
    mixed = sequence.window_dependence(
        rows.withColumn("origin", F.col("split")).withColumn("split", F.lit("all")), 5, origin="origin", idx="row_idx"
    ).first()
    assert clean.cross_split_windows == 0 and clean.shared_rows == 4
    assert mixed.cross_split_windows == 8  # two boundaries, four windows each


# --- fitted preprocessing -----------------------------------------------------


def test_codes_follow_first_appearance_and_unseen_is_minus_one(spark):
    rows = [(0, "train", "b"), (1, "train", "a"), (2, "train", "b"), (3, "train", None), (4, "val", "z"), (5, "val", None)]
    df = spark.createDataFrame(rows, "split_idx long, split string, c string")
    codes = features.category_codes(df.where("split='train'"), ["c"], "split_idx")
    out = features.encode_categories(df, codes, ["c"])
    assert [r.c for r in out.orderBy("split_idx").collect()] == [0, 1, 0, 2, -1, 2]


def test_fit_ignores_validation_and_test_rows(spark):
    rows = _split(spark, 200).withColumn("v", F.col("id") * 1.5)
    a = features.fit_numeric(rows.where("split='train'"), ["v"])
    wild = rows.withColumn("v", F.when(F.col("split") != "train", 1e9).otherwise(F.col("v")))
    b = features.fit_numeric(wild.where("split='train'"), ["v"])
    assert a == b


def test_constant_and_empty_columns(spark):
    df = spark.range(10).select(F.lit(3.0).alias("c"), F.lit(None).cast("double").alias("n"), F.col("id").cast("double").alias("v"))
    fit = features.fit_numeric(df, ["c", "n", "v"], "minmax")
    assert fit.dropped == ["n"] and fit.divisors["c"] == 1.0
    out = fit.transform(df)
    assert out.columns == ["c", "v"]
    assert {r.c for r in out.collect()} == {0.0} and max(r.v for r in out.collect()) == 1.0
    with pytest.raises(ValueError):
        features.fit_numeric(df, ["c"], "robust")


def test_prepare_end_to_end(spark):
    rows = splits.split_sequential(
        row_index(
            spark.range(300).select(
                "id", (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("string").alias("proto"),
                F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("id").cast("string")).alias("unused"),
                F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 0.5).alias("num"),
            ),
            ["id"],
        ),
        0.15,
    )
    p = prepare(rows, ["proto", "num"], seq_len=8)
    assert p.categorical == ["proto"] and p.features == ["proto", "num"]
    info = {r.split: r.windows for r in p.info().collect()}
    assert info == {"train": 203, "val": 38, "test": 38}
    assert p.windows().count() == 279 and p.flat().first().flat.__len__() == 16
    train = p.df.where("split='train'").agg(F.avg("num"), F.stddev_pop("num")).first()
    assert train[0] == pytest.approx(0.0, abs=1e-9) and train[1] == pytest.approx(1.0)
    assert {r.feature: r.categories for r in p.cardinalities().collect()} == {"proto": 3}
    shuffled = prepare(rows, ["proto", "num"], seq_len=8, shuffled=True)
    assert shuffled.info().where("split='train'").first().windows == 203
    with pytest.raises(ValueError):
        prepare(rows, ["num"], seq_len=100)


def test_small_and_large_dictionaries_agree(spark, monkeypatch):
    rows = [("train" if i % 3 else "test", i, f"v{i * i % 11}", "x" if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "split string, split_idx long, c string, d string")
    train = df.where("split = 'train'")

    def coded():
        return {tuple(r) for r in features.category_codes(train, ["c", "d"], "split_idx").collect()}

    by_window = coded()
    monkeypatch.setattr(features, "DICTIONARY_ROWS", 1)
    assert coded() == by_window
    seen = list(dict.fromkeys(r[2] for r in rows if r[0] == "train"))
    assert {(v, n) for f, v, n in by_window if f == "c"} == {(v, i) for i, v in enumerate(seen)}
    assert features.category_codes(train.limit(0), ["c"], "split_idx").count() == 0
