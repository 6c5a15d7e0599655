"""Sinks: JSON and CSV exports, the run store and the evidence store."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.functions.text import csv_safe
from sitegrain.operators.findings import issue_group, rank_pages
from sitegrain.operators.tables import select_rows
from sitegrain.operators.windows import running_budget

PAGE_BYTES, RUN_BYTES = 8 * 1024 * 1024, 128 * 1024 * 1024


def _cells(df: DataFrame, strict: bool) -> DataFrame:
    """All columns as text that no spreadsheet takes for a formula; arrays joined; unknown values empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.array_join(c.cast("array<string>"), " | ") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        cols.append(F.coalesce(csv_safe(c, strict), F.lit("")).alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, out: str, strict: bool = True, order: list[str] | None = None) -> None:
    df = df.orderBy(*order) if order else df
    _cells(df, strict).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n" if strict else "\n").csv(out)


def write_pages_json(pages: DataFrame, out: str) -> None:
    pages.orderBy("url").write.mode("overwrite").json(out)


def inventory(pages: DataFrame) -> DataFrame:
    counts = [F.size(c).alias(f"{c}_count") for c in ("internal_links", "external_links", "image_urls")]
    return pages.select("url", "status_code", "depth", "title", "heading", "first_paragraph", *counts, "duration_ms", "content_bytes")


def write_inventory_csv(pages: DataFrame, out: str) -> None:
    write_csv(inventory(pages), out, strict=True, order=["url"])


def write_run_json(run: DataFrame, pages: DataFrame, errors: DataFrame, out: str) -> None:
    """A run's header row, pages and errors as three JSON tables below one path; a run has no bounded size, so it isn't one value."""
    run.write.mode("overwrite").json(f"{out}/run")
    pages.orderBy("url").write.mode("overwrite").json(f"{out}/pages")
    errors.write.mode("overwrite").json(f"{out}/errors")


def write_summary(run: DataFrame, out: str) -> None:
    run.drop("pages").write.mode("overwrite").json(out)


def export_dataset(ds: DataFrame, out: str, fmt: str = "csv", selected: DataFrame | None = None, every: DataFrame | None = None) -> None:
    """The selected rows (by ``_id``) of ``every``, where there is a selection, else all of ``ds``, which is filtered; columns that start with ``_`` stay out."""
    ds = ds if every is None else select_rows(every, ds, selected, "_id")
    shown = ds.select(*[F.col(f"`{c}`") for c in ds.columns if not c.startswith("_")])
    write_csv(shown, out, strict=False) if fmt == "csv" else shown.write.mode("overwrite").json(out)


def export_graph(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    nodes.write.mode("overwrite").json(f"{out}/nodes")
    edges.write.mode("overwrite").json(f"{out}/edges")


def export_findings(found: DataFrame, out: str) -> None:
    """Filtered findings, in their order."""
    write_csv(found, out)


def export_page_metrics(metrics: DataFrame, out: str, by: str = "findings") -> None:
    """All pages by rank; unknown numbers are empty cells."""
    ranked = rank_pages(metrics, by)
    write_csv(ranked.select("url", "title", F.col("duration").alias("visit_ms"), "words", F.col("incoming").alias("incoming_pages"), "findings"), out)


def issue_rows(issues: DataFrame) -> DataFrame:
    return issues.select(issue_group(F.col("title")).alias("Category"), F.col("severity").alias("Severity"), F.col("title").alias("Issue"), F.col("url").alias("URL"), F.col("detail").alias("Evidence"))


def export_issues(issues: DataFrame, out: str) -> None:
    write_csv(issue_rows(issues), out)


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("url").alias("URL"), F.col("title").alias("Title"), F.col("status_code").alias("Status"), F.coalesce("method", F.lit("http")).alias("Method"), F.col("word_count").alias("Words"), F.col("depth").alias("Depth"),
        F.col("duration_ms").alias("Duration_ms"),
    )


def export_pages(every: DataFrame, filtered: DataFrame, out: str, selected: DataFrame | None = None) -> None:
    """The selected pages, where there is a selection, else the filtered ones."""
    write_csv(page_rows(select_rows(every, filtered, selected)), out)


def export_catalogue(catalogue: DataFrame, out: str, fmt: str = "csv") -> None:
    """A filtered element catalogue, all columns."""
    write_csv(catalogue, out) if fmt == "csv" else catalogue.write.mode("overwrite").json(out)


def export_network(network: DataFrame, out: str) -> None:
    write_csv(network.withColumn("redirects", F.to_json("redirects")) if "redirects" in network.columns else network, out)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a run store that were written whole, in order."""
    fs, path_of = _files(spark, path)
    heads = path_of(f"{path}/heads")
    names = [s.getPath().getName() for s in (fs.listStatus(heads) if fs.exists(heads) else [])]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(path_of(f"{path}/heads/{n}/_SUCCESS")))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    done = _versions(spark, path)
    schema = "run_id string, revision long, version int"
    return spark.read.schema(schema).parquet(f"{path}/heads/v{done[-1]}") if done else spark.createDataFrame([], schema)


def _advance(spark: SparkSession, path: str, heads: DataFrame, n: int) -> None:
    """Make ``heads`` the store's version ``n``: it is in force when its last file, the mark of success, is there."""
    heads.write.mode("overwrite").parquet(f"{path}/heads/v{n}")


def _claim(spark: SparkSession, path: str) -> int:
    """The number of the next version, which no other writer can have."""
    fs, path_of = _files(spark, path)
    n = max([-1, *_versions(spark, path)]) + 1
    while True:
        try:
            fs.create(path_of(f"{path}/claims/{n}"), False).close()
            return n
        except Py4JJavaError as e:
            if "Exists" not in str(e.java_exception.getClass().getName()):
                raise
            if n in _versions(spark, path):
                n += 1
            else:  # claimed, and not written whole: by another writer, or one that failed
                raise RuntimeError(f"version {n} of {path} is being written; if its writer failed, delete claims/{n}") from e


def save_run(rows: DataFrame, path: str, revision: str = "revision") -> None:
    """Put runs (run_id, ..., ``revision``) into the store; a run replaces what the store has of it if its revision is higher.

    Rows are written beside what is there, in a folder of their own, and then a new version of the list of runs, which names each run's
    revision and folder. A write that fails leaves the version before it in force, and an older revision that comes later changes nothing.
    """
    spark = rows.sparkSession
    n = _claim(spark, path)
    heads = _heads(spark, path)
    try:
        given = rows.withColumn("run_id", F.col("run_id").cast("string"))
        newest = given.groupBy("run_id").agg(F.max(F.col(revision).cast("long")).alias("new"))
        wins = newest.join(heads.hint("merge"), "run_id", "left").where("revision is null or new > revision").select("run_id", "new")
        kept = given.join(wins.hint("merge"), "run_id").where(F.col(revision) == F.col("new")).drop("new")
        kept.write.partitionBy("run_id").parquet(f"{path}/data/version={n}")
        after = heads.join(wins.hint("merge"), "run_id", "left_anti").unionByName(wins.select("run_id", F.col("new").alias("revision"), F.lit(n).alias("version")))
        _advance(spark, path, after, n)
    except Exception:
        fs, path_of = _files(spark, path)
        fs.delete(path_of(f"{path}/claims/{n}"), False)
        fs.delete(path_of(f"{path}/data/version={n}"), True)
        raise


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run in its newest revision."""
    heads = _heads(spark, path).select("run_id", "version")
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/data").parquet(f"{path}/data").withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(heads.hint("merge"), ["run_id", "version"], "left_semi").drop("version")


def delete_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Take a run out of the list of runs, then delete its rows."""
    n = _claim(spark, path)
    _advance(spark, path, _heads(spark, path).where(F.col("run_id") != run_id), n)
    fs, path_of = _files(spark, path)
    for folder in fs.globStatus(path_of(f"{path}/data/version=*/run_id={run_id}")) or []:
        fs.delete(folder.getPath(), True)


def save_evidence(evidence: DataFrame, path: str) -> DataFrame:
    """Evidence (run_id, seq, url, payload) under the digest of its address, within 8 MiB a page and 128 MiB a run; a row that doesn't fit is skipped.

    What the store has of these runs is replaced; other runs stay.
    """
    sized = evidence.withColumn("artifact_id", F.sha2("url", 256)).withColumn("size", F.octet_length("payload").cast("long")).where(F.col("size") <= PAGE_BYTES)
    kept = running_budget(sized, "size", RUN_BYTES, ["run_id"], ["seq"], skip=True)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return kept
