"""Order-dependent steps and salted joins on data where one key holds most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.plans.ordering import (
    SAMPLE_SIZE,
    carry_forward,
    global_index,
    heavy_keys,
    lag_in_order,
    ranged,
    row_numbers,
)
from tracewright.plans import ordering, skew
from tracewright.plans.skew import salted_join


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows = [("hot", v) for v in rng.sample(range(100_000), 4000)]
    rows += [(f"k{i % 700}", v) for i, v in enumerate(rng.sample(range(100_000), 4000))]
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "v"])


def test_sample_is_bounded_and_repeatable(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    first = heavy_keys(df, ["k"], ["v"])
    hot = df.filter("k = 'hot'").select(F.hash("k")).first()[0]
    assert first == heavy_keys(df.repartition(13), ["k"], ["v"]) and list(first) == [hot]
    assert 300 < first[hot] <= SAMPLE_SIZE  # half of all rows: about half of the sample


def test_heavy_keys_are_cut_in_many_ranges(spark, skewed):
    cut, is_heavy = ranged(spark.createDataFrame(skewed).repartition(5), ["k"], ["v"])
    counts = cut.withColumn("h", is_heavy).groupBy("k", "h", "_range").count().collect()
    hot = [r["count"] for r in counts if r.k == "hot"]
    assert 300 < len(hot) <= SAMPLE_SIZE + 1 and max(hot) < 120 and sum(hot) == 4000
    light = [r for r in counts if not r.h]
    assert len(light) == len({r.k for r in light}) == 700


def test_even_keys_get_the_plain_plan(spark, skewed):
    df = spark.createDataFrame(skewed[skewed.k != "hot"]).repartition(5)
    assert ranged(df, ["k"], ["v"])[1] is None
    assert "_salt" not in salted_join(df, df.withColumnRenamed("v", "w"), ["k"], ["v"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("order", ["t", "n", "d"])
def test_row_numbers_by_times_and_doubles(spark, order):
    df = spark.range(3000).selectExpr(
        "'a' as k", "timestamp_micros(id * 7919 % 3001 * 1000003) as t",
        "cast(timestamp_micros(id * 7919 % 3001 * 1000003) as timestamp_ntz) as n", "(id * 7919 % 3001) / 7 as d",
    )
    got = [r.p for r in row_numbers(df, ["k"], [order], "p").orderBy(order).collect()]
    assert got == list(range(1, 3001))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_row_numbers(spark, skewed, partitions):
    df = spark.createDataFrame(skewed).repartition(5).repartition(partitions)
    got = row_numbers(df, ["k"], ["v"], "n").toPandas()
    want = skewed.assign(n=skewed.groupby("k")["v"].rank(method="first").astype("int64"))
    cols = ["k", "v", "n"]
    assert got[cols].sort_values(cols).values.tolist() == want[cols].sort_values(cols).values.tolist()


def test_global_index(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = global_index(df, ["v", "k"], "i").toPandas().sort_values(["v", "k"])
    assert got["i"].tolist() == list(range(len(skewed)))


def test_global_index_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("b",), ("a",)], "x string")
    assert {(r.x, r.i) for r in global_index(df, ["x"], "i").collect()} == {("a", 0), ("b", 1)}
    assert global_index(df.filter("x = 'z'"), ["x"], "i").count() == 0


@pytest.mark.parametrize("run_length", [1, 3, 1000])
def test_lag_in_order(spark, run_length):
    rows = [(s, i, f"{s}{i * i % 5}") for s, n in (("a", 20), ("b", 1), ("c", 7)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "s string, p bigint, x string")
    got = {(r.s, r.p): r.y for r in lag_in_order(df, ["s"], "p", "x", "y", run_length).collect()}
    values = {(s, p): x for s, p, x in rows}
    assert got == {(s, p): values.get((s, p - 1)) for s, p in values}


@pytest.mark.parametrize("run_length", [1, 3, 1000])
@pytest.mark.parametrize("include_current", [True, False])
def test_carry_forward(spark, run_length, include_current):
    rng = random.Random(1)
    rows = [(s, i, rng.choice([None, None, None, "x", "y"])) for s in "abc" for i in range(1, 40)]
    df = spark.createDataFrame(rows, "s string, p bigint, x string")
    out = carry_forward(df, ["s"], "p", F.col("x"), "y", run_length, include_current)
    got = {(r.s, r.p): r.y for r in out.collect()}
    for s in "abc":
        last = None
        for _, p, x in [r for r in rows if r[0] == s]:
            before, last = last, x if x is not None else last
            assert got[(s, p)] == (last if include_current else before)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, skewed, how):
    left = spark.createDataFrame(skewed).repartition(5)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k string, w int")
    got = sorted(map(tuple, salted_join(left, right, ["k"], ["v"], how).collect()), key=repr)
    want = sorted(map(tuple, left.join(right, "k", how).select(*salted_join(left, right, ["k"], ["v"], how).columns).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("limit", [1, 1000])
def test_lookup_join(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", limit)
    left = spark.createDataFrame(skewed).repartition(5)
    table = spark.createDataFrame([("hot", 1), ("k1", 3)], "k string, w int")
    got = skew.lookup_join(left, table, ["k"], ["v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(table, "k").collect()))


def test_salted_join_refuses_right_joins(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    with pytest.raises(ValueError):
        salted_join(df, df, ["k"], ["v"], "full")


def test_keys_of_two_types_join_alike(spark, skewed):
    left = spark.createDataFrame(skewed).select(F.when(F.col("k") == "hot", 7).otherwise(F.col("v")).cast("int").alias("k"), "v")
    right = left.select(F.col("k").cast("bigint").alias("k"), (F.col("v") * 2).alias("w")).dropDuplicates(["k"])
    assert heavy_keys(left, ["k"], ["v"])
    assert salted_join(left, right, ["k"], ["v"]).count() == left.join(right, ["k"]).count()


def test_rows_of_a_null_key_are_numbered_through(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("k", F.when(F.col("k") != "hot", F.col("k"))).repartition(5)
    got = row_numbers(df, ["k"], ["v"], "n").filter("k is null").select("v", "n").collect()
    assert sorted(got) == [(v, i + 1) for i, v in enumerate(sorted(r.v for r in got))] and len(got) == 4000


def test_tasks_grow_with_the_rows_and_windows_of_the_key_need_no_further_shuffle(spark, monkeypatch, capsys):
    monkeypatch.setattr(ordering, "UNDEALT", 100)
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 50)
    rows = spark.range(3000).selectExpr("id div 3 as k", "id as v")
    numbered = ordering.row_numbers(rows, ["k"], ["v"], "n")
    assert numbered.rdd.getNumPartitions() == 60
    lagged = ordering.lag_in_order(numbered, ["k"], "n", "v", "before").groupBy("k").agg(F.count("before").alias("c"))
    lagged.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert lagged.filter("c = 2").count() == 1000
