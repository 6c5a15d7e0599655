"""Joins with hot keys give the plain join's rows, and deal hot rows to many tasks."""

import pytest
from pyspark.sql import functions as F

from sitegrain import joins


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 50)


def sides(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id", F.array("id").alias("list"), F.create_map("id", "id").alias("m"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k3", 4), (None, 5)], "k string, v int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows(spark, small, how):
    left, right = sides(spark)
    assert joins.hot_keys(left, "k") == ["hot"]
    shown = lambda df: sorted(((r.k, r.id, r.v) for r in df.select("k", "id", "v").collect()), key=str)
    assert shown(joins.skew_join(left, right, "k", how)) == shown(left.join(right, "k", how))


def test_hot_rows_are_dealt(spark, small):
    left, right = sides(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put these few rows into one task
    parts = joins.skew_join(left, right.where("v != 2"), "k").where("k = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 1000 and max(r["count"] for r in parts) < 500


def test_no_hot_keys(spark):
    left, right = sides(spark)
    assert joins.hot_keys(left, "k") == ["hot"]  # FEW_ROWS rows of it
    left = left.where("id < 1998")
    assert joins.hot_keys(left, "k") == [] and joins.hot_keys(left.where("false"), "k") == []
    assert "Union" not in joins.skew_join(left, right, "k")._jdf.queryExecution().optimizedPlan().toString()


def test_operators_with_hot_keys(spark, monkeypatch):
    """Every operator that salts gives the same with each key hot that can be."""
    from sitegrain.plans import queries as site

    names = ["j1_robots_allowed", "j2_link_status", "g1_edges", "r_findings"]
    names = [n for n in names if n in site.queries()]
    assert len(names) >= 3
    rows = lambda n: sorted(map(str, site.queries()[n](spark, "/root/testdata/sf0.001").collect()))
    before = [rows(n) for n in names]
    monkeypatch.setattr(joins, "FEW_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_SHARE", 1000)
    assert [rows(n) for n in names] == before
