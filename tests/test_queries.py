"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, line = check.compare(spark, con, SF, name)
    assert ok, line


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "token", "rank", "weight"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
@pytest.mark.parametrize("name", ["trace_vector", "kfold_assign", "line_diff", "best_split_gini", "listing_slice"])
@pytest.mark.parametrize("partitions", ["1", "64"])
def test_partition_counts_do_not_matter(spark, con, name, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ok, line = check.compare(spark, con, SF, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert ok, line
