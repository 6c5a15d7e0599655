"""Order-keeping operators: distinct in order, caps, budgets, last write, global numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.cluster import checkpoints


def distinct_in_order(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The first row by ``pos`` of each (keys, value)."""
    w = Window.partitionBy(*keys, value).orderBy(pos)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_page(df: DataFrame, keys: list[str], pos: str, most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def last_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row by ``seq`` of each key, by a partial aggregation rather than a sort of all rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def number_rows(df: DataFrame, order: list[str], name: str = "ord", limit: int | None = None) -> DataFrame:
    """Global numbers from 0 in the given order, without bringing all rows to one task.

    Rows are range-partitioned by the order; each partition is numbered by itself, and the partitions' sizes, one row
    per partition, give the offsets. The ranged rows are checkpointed: the bounds come from a sample, so that rows and sizes
    would be dealt differently if each were computed by itself.
    """
    checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    local = ranged.withColumn("_own", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id").checkpoint()
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = local.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
    return out if limit is None else out.where(F.col(name) < limit)


def running_budget(df: DataFrame, size: str, limit: int, keys: list[str], order: list[str], skip: bool = False) -> DataFrame:
    """Rows within a budget of bytes per key. Without ``skip`` all rows from the first overflow on are dropped; with it only those that do not fit.

    With ``skip``, ``order`` tells a key's rows apart.
    """
    if not skip:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= limit).drop("_sum")
    # what fits depends on all that went before: one pass over each key's sorted sizes, which carry no payload and are not held
    narrow = df.select(*keys, *order, F.col(size).cast("long").alias("_size"))
    kept = narrow.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(_fitting(keys, limit), narrow.schema).drop("_size")
    return df.join(kept.hint("merge"), [*keys, *order], "left_semi")


def _fitting(keys: list[str], limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, used = None, 0
        for b in batches:
            keep = []
            for row in zip(*(b[k] for k in keys), b["_size"], strict=True):
                if row[:-1] != own:
                    own, used = row[:-1], 0
                fits = used + row[-1] <= limit
                used += row[-1] if fits else 0
                keep.append(fits)
            yield b[keep]

    return run


def share_of_max(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """A column's share of its largest value; the maximum is one row, found by an aggregation."""
    top = df.agg(F.greatest(F.lit(1), F.max(col)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, F.col(col) / F.col("_top")).drop("_top")


def waterfall(network: DataFrame) -> DataFrame:
    """Start and duration of each request as shares of its page's last end."""
    end = F.greatest(F.lit(1), F.max(F.col("start_ms") + F.col("duration_ms")).over(Window.partitionBy("page")))
    return network.withColumn("_end", end).withColumn("start_share", F.col("start_ms") / F.col("_end")).withColumn("duration_share", F.col("duration_ms") / F.col("_end")).drop("_end")


def nearest_rank(col: str, p: float) -> Column:
    """sorted[ceil(p * n) - 1] over non-negative finite values; null without any. Use in an aggregation."""

    return F.expr(f"percentile_disc({min(1.0, max(0.0, p))}) within group (order by case when {col} >= 0 and not isnan({col}) then {col} end)")
