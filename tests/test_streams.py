"""Streaming operators over files that arrive in pieces, and SQL names."""

import pytest
from pyspark.sql import functions as F

from sitegrain.functions.registry import register_functions, validate_rules
from sitegrain.operators import merge
from sitegrain.operators.parse import parse_pages
from sitegrain.sources import sinks
from sitegrain.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture()
def arriving(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), rows


def drain(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_dedup_and_telemetry(spark, arriving, tmp_path):
    stream, rows = arriving
    keys = drain(spark, streams.stream_dedup(stream.withColumn("key", F.col("event_id") % 50), "key", "ts", "3650 days").select("key"), tmp_path, "dedup")
    assert keys.count() == keys.distinct().count() == 50
    counted = drain(spark, streams.stream_telemetry(stream, "ts", "event_type", "1 hour", "3650 days"), tmp_path, "telemetry", "complete")
    assert counted.agg(F.sum("n")).first()[0] == rows.count()


def test_latest_outcome_does_not_depend_on_arrival(spark, arriving, tmp_path):
    stream, rows = arriving
    facts = lambda df: df.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("status"))
    out = drain(spark, streams.stream_latest_outcome(facts(stream)), tmp_path, "latest", "update")
    last = {r.key: (r.ok, r.seq) for r in out.groupBy("key").agg(F.max(F.struct("ok", "seq")).alias("m")).select("key", "m.*").collect()}
    assert last == {r.key: (r.ok, r.seq) for r in streams.latest_outcome(facts(rows)).collect()}


def test_run_store_keeps_the_newest(spark, arriving, tmp_path):
    stream, rows = arriving
    streams.write_run_stream(stream.select("user_id", "event_id"), f"{tmp_path}/store", f"{tmp_path}/ck", ["user_id"]).awaitTermination(120)
    assert streams.read_run_store(spark, f"{tmp_path}/store", ["user_id"]).count() == rows.select("user_id").distinct().count()


def test_budget_stops_a_run(spark, arriving, tmp_path):
    stream, _ = arriving
    out = drain(spark, streams.stream_budget(stream.select((F.col("user_id") % 3).alias("run"), F.lit(10).cast("long").alias("size")), 95), tmp_path, "budget")
    assert {r["count"] for r in out.groupBy("run").count().collect()} == {9}


def test_stream_extract(spark, tmp_path):
    spark.createDataFrame([("https://h/", "<h1>a</h1>")], "url string, html string").write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("url string, html string").parquet(f"{tmp_path}/p")
    out = drain(spark, streams.stream_extract(stream).select("url", "doc.heading"), tmp_path, "extract")
    assert [r.heading for r in out.collect()] == ["a"]


def test_monitor(spark):
    now = spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("c", "3", 1)], "name string, digest string, failures int")
    then = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "name string, digest string")
    assert {(r.name, r.changed, r.unhealthy) for r in streams.monitor_changes(now, then).collect()} == {("b", True, False), ("c", False, True)}


def test_sql_names(spark):
    register_functions(spark)
    spark.createDataFrame([("https://h/p", "<h2>T</h2><a href=x rel=nofollow>X</a><a href=/y>Y</a>")], "url string, html string").createOrReplaceTempView("some_pages")
    r = spark.sql("select html_heading(html) h, html_links(html, url) l from some_pages").first()
    assert (r.h, r.l) == ("T", ["https://h/x", "https://h/y"])
    rows = spark.sql("select p.url page, l.* from some_pages p, lateral extract_links(p.html, p.url) l").collect()
    assert [(x.pos, x.rel) for x in rows] == [(0, "nofollow"), (1, "")]


def test_rules_are_validated():
    assert validate_rules([{"name": "a", "selector": "p"}])[0]["mode"] == "text"
    for bad in ([{"name": "a", "selector": "p"}] * 2, [{"name": "1", "selector": "p"}], [{"name": "a", "selector": ""}], [{"name": "a", "selector": "p", "mode": "attribute"}]):
        with pytest.raises(ValueError):
            validate_rules(bad)


def test_contexts_and_sizes(spark):
    rows = spark.createDataFrame([("https://h/", "<a href=a>1</a> one")], "url string, html string")
    frames = spark.createDataFrame([("https://h/f", "<a href=b>2</a> two words")], "url string, html string")
    inner = parse_pages(frames).select(F.lit("https://h/").alias("url"), F.lit(0).alias("n"), F.lit("frame").alias("kind"), F.col("url").alias("context_url"), "doc")
    m = merge.merge_contexts(parse_pages(rows), inner).first()
    assert (m.word_count, len(m.links), m.outgoing_links, m.link_contexts[1]) == (5, 2, ["https://h/a", "https://h/b"], "frame 1 · https://h/f")
    images = spark.createDataFrame([("p", 0, ["u", "v"])], "page string, pos int, candidates array<string>")
    dims = spark.createDataFrame([("p", 1, "u", 5, 6), ("p", 0, "v", 7, 8)], "page string, n int, url string, width int, height int")
    assert merge.image_dims(images, dims).first().rendered_width == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", ["a", "b"], None)], "x string, y array<string>, z int")
    sinks.write_csv(df, f"{tmp_path}/c")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "c").glob("part-*"), key=lambda p: p.stat().st_size))
    assert text.endswith('"x","y","z"\r\n"\'=1+1","a | b",""\r\n')
    runs = spark.createDataFrame([(1, "u", 1), (2, "v", 1)], "run_id int, url string, rev int")
    sinks.save_run(runs, f"{tmp_path}/r", "rev")
    sinks.save_run(spark.createDataFrame([(1, "u", 2)], "run_id int, url string, rev int"), f"{tmp_path}/r", "rev")
    sinks.save_run(spark.createDataFrame([(1, "late", 1), (2, "w", 1)], "run_id int, url string, rev int"), f"{tmp_path}/r", "rev")
    assert {(r.run_id, r.rev, r.url) for r in sinks.read_runs(spark, f"{tmp_path}/r").collect()} == {("1", 2, "u"), ("2", 1, "v")}
    broken = spark.createDataFrame([(1, "x", 9)], "run_id int, url string, rev int").withColumn("url", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        sinks.save_run(broken, f"{tmp_path}/r", "rev")
    assert sinks.read_runs(spark, f"{tmp_path}/r").count() == 2
    sinks.delete_run(spark, f"{tmp_path}/r", "1")
    assert [r.run_id for r in sinks.read_runs(spark, f"{tmp_path}/r").collect()] == ["2"]


def test_saving_evidence_of_a_run_keeps_other_runs(spark, tmp_path):
    of = lambda run, n: spark.createDataFrame([(run, i, f"https://x/{i}", "p" * (i + 1)) for i in range(n)], "run_id string, seq long, url string, payload string")
    for rows in (of("a", 3), of("b", 2), of("a", 1)):
        sinks.save_evidence(rows, f"{tmp_path}/e")
    assert sorted((r.run_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [("a", 0), ("b", 0), ("b", 1)]


def test_monitor_stores_its_state(spark, tmp_path):
    from sitegrain.cluster import checkpoints
    from sitegrain.streaming.streams import advance_monitor

    checkpoints(spark)
    rows = lambda *x: spark.createDataFrame(x, "name string, digest string, failures long")
    seen = [sorted(r.name for r in advance_monitor(spark, d, f"{tmp_path}/m").collect()) for d in (rows(("a", "1", 0), ("b", "1", 0)), rows(("a", "1", 0), ("b", "2", 0)), rows(("a", "1", 3)), rows(("b", "2", 0), ("c", "9", 0)))]
    assert seen == [["a", "b"], ["b"], ["a"], ["c"]]


def test_outcomes_are_forgotten_behind_the_watermark(spark, tmp_path):
    from datetime import datetime

    schema = "key string, seq long, ok boolean, status string, ts timestamp"
    for rows in ([("a", 1, True, "good", datetime(2024, 1, 1))], [("b", 1, True, "good", datetime(2024, 2, 1))], [("c", 1, True, "good", datetime(2024, 2, 1))], [("a", 2, False, "bad", datetime(2024, 2, 2)), ("b", 2, False, "bad", datetime(2024, 2, 2))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.run_to_table(streams.stream_latest_outcome(stream, "ts", "1 hour", 3 * 24 * 3600 * 1000), f"{tmp_path}/out", "update")
    assert sorted(tuple(r) for r in out.collect()) == [("a", False, 2, "bad"), ("a", True, 1, "good"), ("b", True, 1, "good"), ("b", True, 1, "good"), ("c", True, 1, "good")]


def test_budget_takes_a_batch_in_order(spark, tmp_path):
    spark.createDataFrame([(1, 4, 3), (1, 4, 1), (1, 4, 2)], "run int, size long, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run int, size long, n int").parquet(f"{tmp_path}/in")
    assert sorted(r.n for r in streams.run_to_table(streams.stream_budget(stream, 8, ["n"]), f"{tmp_path}/out").collect()) == [1, 2]
