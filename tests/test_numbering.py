"""Global numbers where range bounds come from a sample of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegrain.operators import tables, windows


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """As many partitions as on a cluster: small ones are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def wrong(rows, order):
    """How many rows do not have their place in the order as ``ord``."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).where("ord != place").count()


def test_number_rows_beyond_a_sample(spark):
    rows = spark.range(300_000, numPartitions=8).select("id", F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("more"))
    assert wrong(windows.number_rows(rows, ["key", "id"]), ["key", "id"]) == 0


def test_places_in_an_order_beyond_a_sample(spark):
    n = F.col("id")
    rows = spark.range(300_000, numPartitions=8).select("id", n.alias("ord"), F.concat(F.lit("Page "), (n % 17).cast("string")).alias("Name"))
    ordered = tables.sort_dataset(rows, "Name", desc=True).select("id", F.monotonically_increasing_id().alias("at"))
    assert wrong(windows.number_rows(ordered, ["at"]), [(n % 17).desc(), "id"]) == 0
