"""Shared scratch tables, size-checked joins and session settings of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.cluster import ship

#: Rows of an id list (8 to 16 bytes each) up to which it is broadcast; longer lists are shuffled.
BROADCAST_ROWS = 500_000
#: Rows in an Arrow batch sent to a Python worker: bounds a worker's memory where texts are long.
ARROW_ROWS = 512
#: A key is hot from this share of a table's rows on (so there are at most so many); its rows are dealt to SALTS tasks.
HOT_SHARE, SALTS = 200, 64
#: Rows of one key that a task takes in any case.
FEW_ROWS = 100

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where none is named, one of our own."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return "file://" + _own_dir[app]


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and bound this session's Arrow batches, as texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch:
    """Tables written to the shared folder so that lost executors cost no recomputation of what led to them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and gives Spark true sizes."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch_path"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy refers to any more."""
        for t in tables:
            if path := t.__dict__.pop("_scratch_path", None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def strategy(table: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str = "merge") -> str:
    """The join hint for ``table`` (narrow, already written): a broadcast if it has at most ``rows`` rows, else ``otherwise``."""
    return "broadcast" if len(table.limit(rows + 1).groupBy().count().where(F.col("count") <= rows).take(1)) else otherwise


def sized(table: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str = "merge") -> DataFrame:
    """``table`` (narrow, already written) hinted for a broadcast if it has at most ``rows`` rows, else for a shuffle."""
    return table.hint(strategy(table, rows, otherwise))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", n: str = "n") -> DataFrame:
    """``left`` joined with ``right`` (written; at most one row a key, with the number of ``left``'s rows of it in ``n``), where one key may hold much of ``left``.

    Rows of hot keys are salted, and what ``right`` has of these, at most HOT_SHARE rows, is repeated for each salt. The
    result is the plain join's, without ``n``. Keys are no nulls.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = [r[0] for r in right.where(F.col(n) > max(FEW_ROWS, total // HOT_SHARE)).select(key).collect()]
    right = right.drop(n)
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.where(is_hot).withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    every = right.where(is_hot).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rest = left.where(~is_hot).join(right.hint("merge"), key, how)
    return rest.unionByName(salted.join(every.hint("merge"), [key, "salt"], how).drop("salt"))
