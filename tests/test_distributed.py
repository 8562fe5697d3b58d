from pyspark.sql import functions as F

from revsift.operators.distributed import bounded_count, broadcast_if_small, cut_lineage, spread
from tests.conftest import rows


def test_spread_only_acts_on_coarse_input(spark):
    target = spark.sparkContext.defaultParallelism
    coarse = spark.range(100).coalesce(1)
    fine = spark.range(0, 100, 1, target)
    assert spread(fine, ["id"]) is fine                      # enough splits: untouched
    plan = spread(coarse, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan                      # redistributed by key
    assert rows(spread(coarse, ["id"])) == rows(coarse)


def test_bounded_count_stops_at_the_bound(spark):
    df = spark.range(1000)
    assert bounded_count(df, 10) == 11
    assert bounded_count(df, 5000) == 1000
    b, small = broadcast_if_small(df, 10)
    assert not small and b is df
    _, small = broadcast_if_small(df.limit(3), 10)
    assert small


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()  # reads the checkpoint
    assert rows(cut) == rows(df)
