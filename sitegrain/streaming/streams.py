"""Structured Streaming over captures: extraction, deduplication, telemetry, latest outcomes, run store, change monitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitegrain.operators.parse import parse_pages


def stream_extract(pages: DataFrame) -> DataFrame:
    """Parsed pages as they arrive; the same job as in batch."""
    return parse_pages(pages)


def stream_dedup(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark, which bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_telemetry(stream: DataFrame, time: str, group: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by group; late rows within the delay are counted."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), group)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
    )


OUTCOME_STATE = "ok boolean, seq long, status string"
#: State of keys that nothing arrives for is dropped after so long.
STATE_TTL_MS = 7 * 24 * 3600 * 1000


def _marked(stream: DataFrame, time: str | None, delay: str) -> tuple[DataFrame, str]:
    """The stream with a watermark where there is a column of times, and how its states end: by that, or never."""
    return (stream, GroupStateTimeout.NoTimeout) if time is None else (stream.withWatermark(time, delay), GroupStateTimeout.EventTimeTimeout)


def stream_latest_outcome(stream: DataFrame, time: str | None = None, delay: str = "1 hour", ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Latest outcome per key of (key, seq, ok, status): a success replaces a failure whatever their order of arrival, never the reverse.

    Where ``time`` names a column, a key is forgotten ``ttl_ms`` after the watermark has passed its newest row, and begins anew when it comes
    again. (Timeouts by the clock would keep a stream that reads what is there from ending.)
    """
    marked, ending = _marked(stream, time, delay)

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, until = state.get if state.exists else (False, -1, ""), 0
        for b in batches:
            for ok, seq, status in zip(b["ok"], b["seq"], b["status"], strict=True):
                best = max(best, (bool(ok), int(seq), str(status)))
            if time is not None and len(b):
                until = max(until, int(b[time].max().timestamp() * 1000))
        state.update(best)
        if time is not None:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "ok": [best[0]], "seq": [best[1]], "status": [best[2]]})

    key_type = stream.schema["key"].dataType.simpleString()
    return marked.groupBy("key").applyInPandasWithState(latest, f"key {key_type}, {OUTCOME_STATE}", OUTCOME_STATE, "update", ending)


def latest_outcome(rows: DataFrame) -> DataFrame:
    """The same in batch: one partial aggregation."""
    return rows.groupBy("key").agg(F.max(F.struct("ok", "seq", "status")).alias("o")).select("key", "o.*")


def write_run_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True):
    """Append each micro-batch, one row of each key, under its number, so that a replayed batch replaces itself; ``read_run_store`` keeps the newest row per key."""

    def put(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates(keys).withColumn("revision", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_run_store(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("r")).select(*keys, "r.*")


def monitor_changes(digests: DataFrame, state: DataFrame) -> DataFrame:
    """(run, digest, failures, changed, unhealthy) of runs (name, digest, failures) against stored digests (name, digest); a first run is a change."""
    before = state.select("name", F.col("digest").alias("was"))
    out = digests.join(before, "name", "left")
    return out.select("name", "digest", "failures", (F.col("was").isNull() | (F.col("was") != F.col("digest"))).alias("changed"), (F.col("failures") > 0).alias("unhealthy")).where("changed or unhealthy")


def advance_monitor(spark: SparkSession, digests: DataFrame, path: str) -> DataFrame:
    """``monitor_changes`` against the digests stored below ``path``, which are then those of ``digests``; a first call finds none.

    States are written as a new version beside the old one, whose name is the next number, so a failed write leaves the old one in force.
    """
    versions = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = versions.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in (fs.listStatus(versions) if fs.exists(versions) else [])]
    done = sorted(int(n[1:]) for n in found if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    state = spark.read.parquet(f"{path}/v{done[-1]}") if done else digests.select("name", "digest").limit(0)
    out = monitor_changes(digests, state).checkpoint()
    kept = state.join(digests.select("name").hint("merge"), "name", "left_anti").unionByName(digests.select("name", "digest"))
    kept.write.mode("overwrite").parquet(f"{path}/v{done[-1] + 1 if done else 0}")
    return out


def stream_budget(stream: DataFrame, limit: int, order: list[str] | None = None, time: str | None = None, delay: str = "1 hour", ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Rows of (run, size, ...) until a run's total exceeds ``limit``; the total is the state of its key, which ends as in ``stream_latest_outcome``.

    The rows of a batch are taken in the order of columns ``order``, where given; batches as they arrive.
    """
    schema = stream.schema
    marked, ending = _marked(stream, time, delay)

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, until = state.get[0] if state.exists else 0, 0
        arrived = [b for b in batches if len(b)]
        if arrived and used <= limit:  # of a run that is over its budget nothing more is taken
            rows = pd.concat(arrived)
            rows = rows.sort_values(order) if order else rows
            total = used + rows["size"].cumsum()
            used = int(total.iloc[-1])
            yield rows[total <= limit]
        if time is not None:
            until = max([0, *(int(b[time].max().timestamp() * 1000) for b in arrived)])
        state.update((used,))
        if time is not None:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + ttl_ms)

    return marked.groupBy("run").applyInPandasWithState(take, schema, "used long", "append", ending)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived, into a table below ``path``, and read it; the checkpoint lies beside it.

    ``append``: rows are added, each batch once; ``update``: so are rows that replace earlier ones. ``complete``: each batch's whole result is a version of its own,
    and the last is read.
    """
    spark = stream.sparkSession
    out = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        _ended(out.format("parquet").start(f"{path}/rows"))
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    _ended(out.foreachBatch(put).start())
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    if mode == "update":
        return spark.read.schema(stream.schema).parquet(*(f"{path}/rows/{n}" for n in names))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={max(int(n.split('=')[1]) for n in names)}")


def _ended(running) -> None:
    """Wait for a stream that ends by itself; what made it fail is raised."""
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
