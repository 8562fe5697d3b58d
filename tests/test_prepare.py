import pytest
from pyspark.sql import functions as F

from revsift.operators import prepare as pp
from revsift.operators.distributed import global_rank, salted
from tests.conftest import rows


def test_drop_missing_and_match_any(spark):
    df = spark.createDataFrame(
        [(1, None), (2, "Seafood, Bars"), (3, "FOOD"), (4, ""), (5, "Shoes")], "id int, cats string")
    assert rows(pp.drop_missing(df, ["cats"]), "id") == [(2,), (3,), (4,), (5,)]
    # substring regex, case-insensitive on every alternative
    assert rows(pp.match_any(df, "cats", ["Food", "shoe"]), "id") == [(2,), (3,), (5,)]


def test_prefix_columns(spark):
    df = spark.createDataFrame([(1, "a")], "business_id int, name string")
    out = pp.prefix_columns(df, "biz_", keep=["business_id"])
    assert out.columns == ["business_id", "biz_name"]


def test_join_m1_checks_duplicates(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    right_ok = spark.createDataFrame([(1, "A"), (None, "N")], "k int, w string")
    out = pp.join_m1(left, right_ok, "k")
    assert rows(out, "v", "w") == [("x", "A"), ("y", None), ("z", None)]
    right_dup = spark.createDataFrame([(1, "A"), (1, "B")], "k int, w string")
    with pytest.raises(Exception, match="duplicate key"):
        pp.join_m1(left, right_dup, "k").collect()


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", None, 2)],
                               "name string, id int, o int")
    assert rows(pp.last_by_key(df, "name", "id", "o")) == [("a", 2), ("b", 3)]


def test_filter_spec_rules(spark):
    schema = [pp.MetadataField("stars", "float"), pp.MetadataField("city", "str"),
              pp.MetadataField("n", "int")]
    df = spark.createDataFrame([(4.5, "Tucson", 3), (3.0, "Reno", 5)], "stars double, city string, n int")
    ok = pp.apply_filter_spec(df, {"filters": [{"key": "stars", "operator": "GTE", "value": 4}]}, schema)
    assert rows(ok, "city") == [("Tucson",)]
    for bad in ({"key": "zip", "operator": "EQ", "value": "1"},
                {"key": "city", "operator": "CONTAINS", "value": "T"},
                {"key": "n", "operator": "EQ", "value": "3"}):
        with pytest.raises(pp.FilterSpecError):
            pp.apply_filter_spec(df, {"filters": [bad]}, schema)
    two_eq = {"filters": [{"key": "city", "operator": "EQ", "value": "Tucson"},
                          {"key": "city", "operator": "EQ", "value": "Reno"}]}
    assert pp.apply_filter_spec(df, two_eq, schema).count() == 0


def test_filter_spec_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(100).select(F.col("id").cast("int").alias("n")).write.parquet(p)
    df = pp.apply_filter_spec(spark.read.parquet(p), {"filters": [{"key": "n", "operator": "GT", "value": 5}]},
                              [pp.MetadataField("n", "int")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n), GreaterThan(n,5)]" in plan


def test_stringify(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, 3, 1.5)], "id int, a int, b double")
    out = pp.stringify(df, ["a", "b"])
    assert rows(out) == [(1, "None", "nan"), (2, "3", "1.5")]


def test_sample_exact_size_and_partition_independence(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = rows(pp.sample_exact(df, 30, "k", 7))
    b = rows(pp.sample_exact(df.repartition(13), 30, "k", 7))
    assert len(a) == 30 and a == b
    assert pp.sample_exact(df, 5000, "k").count() == 1000
    assert pp.sample_exact(df, 0, "k").count() == 0


def test_sample_with_replacement(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    s = pp.sample_with_replacement(df, 30, "k", 3)
    got = rows(s, "draw", "k")
    assert [d for d, _ in got] == list(range(10))  # clamped to the population
    again = rows(pp.sample_with_replacement(df.repartition(4), 30, "k", 3), "draw", "k")
    assert got == again
    assert pp.sample_with_replacement(df, 0, "k").count() == 10


def test_group_split_disjoint(spark):
    df = spark.createDataFrame([(i, i % 17) for i in range(200)], "id int, g int")
    train, val = pp.split_by_group(df, "g", 0.7, 1)
    tg = {r.g for r in train.select("g").distinct().collect()}
    vg = {r.g for r in val.select("g").distinct().collect()}
    assert len(tg) == 11 and len(vg) == 6 and not (tg & vg)
    assert train.count() + val.count() == 200
    one = spark.createDataFrame([(1, 0), (2, 0)], "id int, g int")
    t1, v1 = pp.split_by_group(one, "g", 0.7, 1)
    assert t1.count() == 0 and v1.count() == 2


def test_global_rank_is_exact(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"))
    r = global_rank(df.repartition(5), [F.col("x")], num_partitions=6)
    got = [(row.x, row._rank) for row in r.collect()]
    assert sorted(got) == [(i, i + 1) for i in range(5000)]


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    plain = rows(big.join(small, "k"), "k", "v", "s")
    salty = rows(salted(big, 8, F.col("v")).join(salted(small, 8, replicate=True), ["k", "_salt"]), "k", "v", "s")
    assert plain == salty


def test_category_share(spark):
    df = spark.createDataFrame([("A, B",), ("A",), (None,)], "c string")
    out = rows(pp.category_share(df, "c", ", "), "category", "n", "total", "perc")
    assert out == [("A", 2, 2, 100.0), ("B", 1, 2, 50.0)]


def test_sample_with_replacement_many_draws(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = pp.sample_with_replacement(df, 600, "k", 5)
    got = rows(s, "draw")
    assert sorted(d for (d,) in got) == list(range(600))
    small = dict(rows(pp.sample_with_replacement(df, 10, "k", 5), "draw", "k"))
    big = dict(rows(s, "draw", "k"))
    assert all(big[j] == small[j] for j in range(10))  # draws are independent of n
    assert 400 < len(set(big.values())) < 520  # 451 different rows are expected of 600 draws of 1000
    # nulls and repeated keys are rows like others; an empty table has no draws
    odd = spark.createDataFrame([(None,), ("a",), ("a",), (None,)], "k string")
    assert {r["k"] for r in pp.sample_with_replacement(odd, 4, "k", 1).collect()} <= {None, "a"}
    assert pp.sample_with_replacement(odd, 9, "k").count() == 4 and pp.sample_with_replacement(odd.limit(0), 5, "k").count() == 0


def test_quantiles_with_a_hot_value(spark):
    from revsift.operators.profile import exact_quantiles
    import numpy as np
    vals = [5.0] * 700 + [float(v) for v in range(300)]
    df = spark.createDataFrame([("c", v) for v in vals], "column string, x double").repartition(4)
    q = exact_quantiles(df).first()
    assert (q.p25, q.p50, q.p75) == tuple(float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75))
