"""Sources: page stores, saved runs, robots and sitemap texts, evidence and image bytes; and the HTML gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.http import mime_type, raster_type

HTML_TYPES = ("text/html", "application/xhtml+xml")
ROBOTS_STORED = 64_000
SITEMAP_MOST = 2 * 1024 * 1024
EVIDENCE_MOST = 8 * 1024 * 1024
ACTIVE = ("queued", "running", "paused", "stopping", "starting")

PAGE = (
    "url string, requested_url string, status_code int, depth int, duration_ms bigint, content_bytes bigint, title string, heading string, description string,"
    " first_paragraph string, canonical_url string, outgoing_links array<string>, internal_links array<string>, external_links array<string>, image_urls array<string>"
)
ERROR = "url string, kind string, message string, attempts int, status_code int, stage string"
RUN = f"id string, name string, status string, start_url string, started_at string, pages map<string, struct<{PAGE.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint').replace(' array', ':array')}>>, errors array<struct<{ERROR.replace(' string', ':string').replace(' int', ':int')}>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page store: Parquet, or JSON where the path says so."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl", ".json.gz")) else spark.read.parquet(path)


def html_gate(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of responses (url, content_type, ...): what isn't HTML is an error of kind ``non-html``."""
    mime = F.coalesce(mime_type(F.col("content_type")), F.lit(""))
    pages = responses.where(mime.isin(*HTML_TYPES))
    errors = responses.where(~mime.isin(*HTML_TYPES)).select("url", F.lit("non-html").alias("kind"), F.concat(F.lit("Expected HTML, received "), F.when(mime == "", F.lit("no content type")).otherwise(mime)).alias("message"))
    return pages, errors


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, pages, errors) of saved runs, one JSON document each. Corrupt documents are left out; active runs were interrupted."""
    raw = spark.read.schema(f"{RUN}, _corrupt string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").where("_corrupt is null and id is not null")
    runs = raw.select("id", "name", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")).alias("status"), "start_url", "started_at")
    pages = raw.select(F.col("id").alias("run_id"), F.posexplode(F.map_values("pages")).alias("capture_seq", "p")).select("run_id", "capture_seq", "p.*")
    errors = raw.select(F.col("id").alias("run_id"), F.posexplode("errors").alias("error_seq", "e")).select("run_id", "error_seq", "e.*")
    return runs, pages, errors


def read_robots(rows: DataFrame) -> DataFrame:
    """robots.txt texts (origin, status, text): the stored part, without a byte order mark at its start."""
    return rows.withColumn("text", F.substring(F.regexp_replace("text", "^\\x{FEFF}", ""), 1, ROBOTS_STORED))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(sitemap_url, text) of sitemap files, gzip by their names; those with declarations or beyond 2 MiB are left out."""
    return usable_sitemaps(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("sitemap_url"), F.col("value").alias("text")))


def usable_sitemaps(rows: DataFrame) -> DataFrame:
    """Files of at most SITEMAP_MOST characters without a document type or entities; the pattern runs over short texts with a declaration only."""
    declared = F.col("text").contains("<!") & F.col("text").rlike("(?i)<!DOCTYPE|<!ENTITY")
    short = (F.octet_length("text") <= 4 * SITEMAP_MOST) & (F.length("text") <= SITEMAP_MOST)
    return rows.where(F.when(short, ~declared))


def read_evidence(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Render evidence of the named artifacts, or of all; records beyond 8 MiB are left out."""
    rows = spark.read.json(path)
    rows = rows.where(F.octet_length(F.to_json(F.struct("*"))) <= EVIDENCE_MOST)
    return rows if ids is None else rows.where(F.col("artifact_id").isin(*ids))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, type) of image files; null type where the bytes are no raster image."""
    return spark.read.format("binaryFile").load(path).select("path", "length", raster_type(F.col("content")).alias("type"))
