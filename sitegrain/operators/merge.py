"""Rendered pages: frames merged into their page, measured image sizes, evidence; run summary and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = {"images": 500, "links": 500, "resources": 500, "headings": 500, "forms": 500, "structured_data": 60, "outgoing_links": 2000, "image_urls": 2000}


def _size_of(name: str):
    return lambda x: F.size(x[name])


def merge_contexts(pages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Parsed pages (url, doc) with the inventories of their frames and shadow roots (url, n, kind, context_url, doc) appended, in order, and cut.

    Frames are few per page. Word counts are added; ``context`` labels of links are the frames' kind, number and address.
    """
    label = F.concat_ws(" ", "kind", (F.col("n") + 1).cast("string"), F.lit("·"), "context_url")
    lists = [f.name for f in pages.schema["doc"].dataType.fields if f.name in MOST]
    own = pages.select("url", F.lit(-1).alias("n"), F.lit("document").alias("context"), "doc")
    every = own.unionByName(contexts.select("url", "n", label.alias("context"), "doc"))
    row = F.struct("n", F.col("doc.word_count").alias("words"), F.size("doc.links").alias("n_links"), "context", *[F.col(f"doc.{c}").alias(c) for c in lists])
    parts = F.array_sort(F.collect_list(row))
    out = every.groupBy("url").agg(parts.alias("p"))

    def joined(name: str):
        flat = F.flatten(F.transform("p", lambda x: F.coalesce(x[name], F.array())))
        return F.slice(F.array_distinct(flat) if name in ("outgoing_links", "image_urls") else flat, 1, MOST[name]).alias(name)

    over = F.exists(F.array(*[F.aggregate(F.transform("p", _size_of(c)), F.lit(0), lambda a, n: a + n) > MOST[c] for c in lists]), lambda x: x)
    labels = F.slice(F.flatten(F.transform("p", lambda x: F.array_repeat(x["context"], x["n_links"]))), 1, MOST["links"])
    return out.select("url", F.aggregate("p", F.lit(0), lambda a, x: a + x["words"]).alias("word_count"), *[joined(c) for c in lists], labels.alias("link_contexts"), over.alias("truncated"))


def image_dims(images: DataFrame, dims: DataFrame) -> DataFrame:
    """Images (page, pos, candidates) with the first measured size (page, n, url, width, height) of any of their addresses."""
    shown = images.select("page", "pos", F.explode("candidates").alias("url"))
    hit = shown.join(dims.hint("merge"), ["page", "url"]).groupBy("page", "pos").agg(F.min_by(F.struct(F.col("width").alias("rendered_width"), F.col("height").alias("rendered_height")), "n").alias("d"))
    return images.join(hit.select("page", "pos", "d.*").hint("merge"), ["page", "pos"], "left")


def with_evidence(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    return pages.join(evidence, "artifact_id")


def recorded_images(urls: DataFrame, images: DataFrame, plain: DataFrame) -> DataFrame:
    """Addresses (url) that a run has as an image: a candidate of an element (candidates) or a plain one (image)."""
    known = images.select(F.explode("candidates").alias("url")).union(plain.select(F.col("image").alias("url"))).distinct()
    return urls.join(known.hint("merge"), "url", "left_semi")


def run_summary(pages: DataFrame, errors: DataFrame, frontier: DataFrame | None = None, decisions: DataFrame | None = None, stopped: bool = False) -> DataFrame:
    """One row: pages, failures, distinct internal and external links and images; with a frontier also ``scheduled``, with decisions
    ``limit_reached`` (whether the page limit refused a link), and ``stopped``.

    Addresses are made distinct by a shuffle each, and all is counted in one partial aggregation.
    """
    lists = [c for c in ("internal_links", "external_links", "image_urls") if c in pages.columns]
    parts = [pages.select(F.explode(c).alias("u")).distinct().select(F.lit(c).alias("what")) for c in lists]
    parts += [pages.select(F.lit("pages").alias("what")), errors.select(F.lit("failed").alias("what"))]
    if frontier is not None:
        parts.append(frontier.select(F.lit("scheduled").alias("what")))
    if decisions is not None:
        parts.append(decisions.where("reason = 'page_limit'").select(F.lit("limit").alias("what")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    of = lambda c: F.count_if(F.col("what") == c)
    out = [of("pages").alias("pages"), of("failed").alias("failed"), *[of(c).alias(c) for c in lists]]
    out += [of("scheduled").alias("scheduled"), F.lit(stopped).alias("stopped")] if frontier is not None else []
    out += [(of("limit") > 0).alias("limit_reached")] if decisions is not None else []
    return rows.agg(*out)


def mean_rate(runs: DataFrame) -> DataFrame:
    """``runs`` (requests, duration_ms, ...) with ``mean_rate``: requests a second, over a second at least, to a tenth."""
    seconds = F.greatest(F.lit(1.0), F.coalesce("duration_ms", F.lit(0)) / 1000)
    return runs.withColumn("mean_rate", F.floor(F.coalesce("requests", F.lit(0)) / seconds * 10 + 0.5) / 10)


def telemetry(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """(what, name, n): frontier rows by state and pages by method."""
    states = frontier.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n")).select(F.lit("state").alias("what"), "name", "n")
    methods = pages.groupBy(F.coalesce("method", F.lit("http")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("method").alias("what"), "name", "n")
    return states.unionByName(methods)
