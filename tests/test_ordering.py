import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.operators.ordering import (
    group_medians, rank_totals, row_index, row_index_within, running, running_over,
)


def _skewed(spark, n=5000):
    """A third of the rows share one group and one value."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("g"),
        F.when(F.col("id") % 3 == 1, 7.0).otherwise(((F.col("id") * 7919) % 1009) / 10.0).alias("v"),
    )


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("k"))
    ix = row_index(df, ["k"])
    assert ix.rows == 10_000
    rows = [(r.k, r.row_idx) for r in ix.df.collect()]
    assert [k for k, _ in sorted(rows, key=lambda x: x[1])] == sorted(k for k, _ in rows)
    assert sorted(i for _, i in rows) == list(range(10_000))


def test_row_index_of_nothing(spark):
    ix = row_index(spark.range(0), ["id"])
    assert ix.rows == 0 and ix.df.count() == 0


def test_row_index_within_matches_window(spark):
    df = _skewed(spark)
    got = row_index_within(df, ["g"], ["id"], "i", "n")
    w = Window.partitionBy("g")
    want = df.select(
        "id", (F.row_number().over(w.orderBy("id")) - 1).alias("i2"), F.count("*").over(w).alias("n2")
    )
    assert got.join(want, "id").where("i <> i2 OR n <> n2").count() == 0
    assert got.count() == df.count()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("chunk", [3, 64, 100_000])
def test_running_matches_unbounded_window(spark, inclusive, chunk):
    df = _skewed(spark, 2000)
    got = running(
        df, ["g"], ["id"], {"s": F.lit(1)}, {"m": F.col("v")}, inclusive=inclusive, chunk_rows=chunk
    )
    w = Window.partitionBy("g").orderBy("id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    want = df.select(
        "id", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).alias("s2"), F.max("v").over(w).alias("m2")
    )
    assert got.join(want, "id").where("s <> s2 OR NOT m <=> m2").count() == 0
    assert got.count() == 2000


def test_running_over_given_positions(spark):
    df = row_index_within(_skewed(spark, 500), ["g"], ["v", "id"], "i")
    got = running_over(df, ["g"], "i", sums={"s": F.lit(2)}, chunk_rows=10)
    assert got.where("s <> 2 * (i + 1)").count() == 0


def test_rank_totals_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.choice([0.5, 0.5, rng.random()]), rng.random() < 0.4) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, hit boolean").repartition(7)
    got = {
        r.g: r for r in rank_totals(
            df, ["g"], "v", F.col("hit").cast("int"), F.when(F.col("hit"), 0).otherwise(1)
        ).collect()
    }
    for g in "ab":
        pos = [v for k, v, h in rows if k == g and h]
        neg = [v for k, v, h in rows if k == g and not h]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[g].below == pytest.approx(want)
        assert (got[g].hits, got[g].mass) == (len(pos), len(neg))


def test_group_medians(spark):
    df = _skewed(spark, 3001)
    got = {r.g: r.median for r in group_medians(df, ["g"], "v").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_plans_keep_every_exchange_partitioned(spark):
    """No single-partition exchange of data rows behind the numbering or the prefix sums."""
    df = row_index_within(_skewed(spark), ["g"], ["id"], "i")
    out = running_over(df, ["g"], "i", maxes={"m": F.col("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_equal_keys_do_not_meet_in_one_task(spark):
    """A key shared by a third of the rows is still spread by the range sort."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    ix = row_index(df, ["k"])
    rows = ix.df.where("k = 0").orderBy("row_idx")
    assert [r.id for r in rows.take(3)] == [0, 3, 6]  # ties keep their input order
    parts = ix.df.where("k = 0").select(F.col("_metadata.file_path").alias("f")).groupBy("f").count()
    assert parts.count() >= 2


def test_side_tables_have_a_known_size(spark):
    df = row_index_within(_skewed(spark), ["g"], ["id"], "i", group_column="run")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    out = running_over(df, ["run"], "i", sums={"s": F.lit(1)}, chunk_rows=50)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_side_tables_join_on_the_window_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = row_index_within(_skewed(spark, 3000), ["g"], ["id"], "i", group_column="run")
        out = running_over(df, ["run"], "i", sums={"s": F.lit(1)}, chunk_rows=50)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # one exchange for the window, one for the carried sums, two for the group starts
        assert plan.count("Exchange hashpartitioning") == 4
        assert out.where("s <> i + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
