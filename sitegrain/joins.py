"""Joins in which one key may hold much of the left side, as a crawl's one origin or its navigation links do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys looked for, the least share of the rows (one in HOT_SHARE) and number of rows that make a key hot, and the tasks that a hot key's rows are dealt to.
MOST_HOT, HOT_SHARE, FEW_ROWS, SALTS = 100, 100, 1_000, 64
#: Keys that the count of frequent keys keeps track of; a key of a share above 1 / TRACKED is never lost from it.
TRACKED = 10_000


def hot_keys(df: DataFrame, key: str) -> list:
    """Values of ``key`` that hold at least 1 / HOT_SHARE of the rows (so at most HOT_SHARE), from FEW_ROWS rows on.

    One pass with a bounded sketch a partition: nothing is shuffled by key. Its counts may be off by rows / TRACKED, which moves rows to other
    tasks and changes no result.
    """
    r = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {MOST_HOT}, {TRACKED})").alias("top")).first()
    return [t["item"] for t in r.top or [] if t["count"] >= max(FEW_ROWS, r.n // HOT_SHARE)]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, as an inner or left join; where some keys are hot, their rows of ``left`` are salted.

    ``right`` should have few rows a key: those of hot keys are repeated for every salt. The result is the plain join's. ``hot``: the hot keys, where
    they are known.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    deal = F.pmod(F.xxhash64(*[c for c in left.columns if _hashable(left, c)]), F.lit(SALTS)).cast("int")
    salted = left.where(is_hot).withColumn("_salt", deal)
    every = right.where(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = left.where(~is_hot).join(right.where(~is_hot).hint("merge"), key, how)
    return rest.unionByName(salted.join(every.hint("merge"), [key, "_salt"], how).drop("_salt"))


def _hashable(df: DataFrame, column: str) -> bool:
    return not any(k in df.schema[column].dataType.simpleString() for k in ("map<", "variant"))
