"""Links between captured pages: redirect aliases, destination status, page link lists, inlinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.text import follow_state
from sitegrain.functions.urls import url_identity, url_origin
from sitegrain.joins import skew_join
from sitegrain.operators.windows import last_per_key


def aliases(pages: DataFrame) -> DataFrame:
    """(alias, identity): final and requested addresses of pages; of several captures the last counts, the final one after the requested."""
    own = pages.select(F.col("capture_seq"), url_identity(F.col("url")).alias("identity"), url_identity(F.col("requested_url")).alias("asked"))
    both = own.select(F.col("identity").alias("alias"), "identity", (F.col("capture_seq") * 2 + 1).alias("seq")).unionByName(
        own.where("asked is not null").select(F.col("asked").alias("alias"), "identity", (F.col("capture_seq") * 2).alias("seq"))
    )
    return last_per_key(both, ["alias"], "seq").select("alias", "identity")


def resolve_alias(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """``col`` as an identity: its page's final address where there is one, else its own."""
    own = df.withColumn("_id", url_identity(F.col(col)))
    return skew_join(own, table.withColumnRenamed("alias", "_id"), "_id", "left").withColumn(col, F.coalesce("identity", "_id")).drop("_id", "identity")


def page_links(parsed: DataFrame, most: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """url (and the columns ``keep``) with its distinct links in order, cut to ``most`` and split by origin, and how many were cut."""
    every = F.col("doc.outgoing_links")
    kept = F.slice(every, 1, most)
    origin = url_origin(F.col("url"))
    return parsed.select(
        "url", *keep, kept.alias("outgoing_links"),
        F.filter(kept, lambda u: url_origin(u) == origin).alias("internal_links"), F.filter(kept, lambda u: url_origin(u) != origin).alias("external_links"),
        F.greatest(F.size(every) - most, F.lit(0)).alias("link_limit"),
    )


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per link element (capture_seq, pos, source, destination, text, rel, discovery, context); plain addresses where a page has no elements."""
    plain = F.transform("outgoing_links", lambda u: F.struct(u.alias("url"), F.lit("").alias("text"), F.lit("").alias("rel"), F.lit("raw").alias("discovery"), F.lit("document").alias("context")))
    return pages.select("capture_seq", F.col("url").alias("source"), F.posexplode(F.coalesce("links", plain)).alias("pos", "l")).select(
        "capture_seq", "pos", "source", F.col("l.url").alias("destination"), "l.text", "l.rel", "l.discovery", "l.context"
    )


def link_status(links: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``links`` with ``status``: of the page captured last under a destination, else of its last error, else ``Not crawled``.

    Statuses are looked up once per distinct destination, as navigation links repeat on every page.
    """
    final = pages.select(F.col("url").alias("destination"), "url", "requested_url", "status_code", (F.col("capture_seq") * 2).alias("seq"))
    asked = pages.select(F.col("requested_url").alias("destination"), "url", "requested_url", "status_code", (F.col("capture_seq") * 2 + 1).alias("seq")).where("destination is not null")
    known = last_per_key(final.unionByName(asked), ["destination"], "seq")
    redirect = (F.col("requested_url") == F.col("destination")) & (F.col("requested_url") != F.col("url"))
    captured = known.select("destination", F.when(redirect, "Redirect").otherwise(F.col("status_code").cast("string")).alias("captured"))
    failed = last_per_key(errors.select(F.col("url").alias("destination"), "kind", "status_code", "error_seq"), ["destination"], "error_seq")
    failed = failed.select("destination", F.coalesce(F.col("status_code").cast("string"), "kind").alias("failed"))
    statuses = links.select("destination").distinct().join(captured.hint("merge"), "destination", "left").join(failed.hint("merge"), "destination", "left")
    statuses = statuses.select("destination", F.coalesce("captured", "failed", F.lit("Not crawled")).alias("status"))
    return skew_join(links, statuses, "destination", "left")


def dataset_links(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """The link table."""
    rows = link_status(link_rows(pages), pages, errors)
    return rows.select(
        F.col("source").alias("Source"), F.col("destination").alias("Destination"), F.col("text").alias("Anchor"),
        F.when(url_origin(F.col("destination")) == url_origin(F.col("source")), "Internal").otherwise("External").alias("Type"), F.col("status").alias("Status"),
        follow_state(F.col("rel")).alias("Follow"), F.coalesce("discovery", F.lit("raw")).alias("Discovery"), F.coalesce("context", F.lit("document")).alias("Context"), F.col("rel").alias("Rel"),
    )


def final_failures(errors: DataFrame, pages: DataFrame) -> DataFrame:
    """(identity, status_code): page errors of 400 to 599 whose address no capture has; the last of each."""
    own = errors.where("(stage is null or stage in ('', 'page')) and status_code between 400 and 599").select(url_identity(F.col("url")).alias("alias"), "status_code", "error_seq")
    left = own.join(aliases(pages).hint("merge"), "alias", "left_anti")
    return last_per_key(left.withColumnRenamed("alias", "identity"), ["identity"], "error_seq").select("identity", "status_code")


def internal_targets(pages: DataFrame) -> DataFrame:
    """(capture_seq, url, target, pos): the distinct resolved internal destinations of each page, in order."""
    links = pages.select("capture_seq", "url", F.posexplode("internal_links").alias("pos", "target"))
    return resolve_alias(links, "target", aliases(pages)).groupBy("capture_seq", "url", "target").agg(F.min("pos").alias("pos"))


def incoming(pages: DataFrame) -> DataFrame:
    """(identity, incoming): how many captured pages link to an address within the site, self-links included."""
    return internal_targets(pages).groupBy(F.col("target").alias("identity")).agg(F.count("*").alias("incoming"))


def inlinks(pages: DataFrame, url: str) -> DataFrame:
    """Pages that link to a page's final or requested address."""
    wanted = pages.where(F.col("url") == url).select(F.explode(F.array("url", "requested_url")).alias("target")).where("target is not null").distinct()
    return pages.select("url", F.explode("outgoing_links").alias("target")).join(wanted, "target", "left_semi").select("url").distinct()


def sample_failures(pages: DataFrame, errors: DataFrame, n: int = 5) -> DataFrame:
    """Per page: how many distinct internal destinations failed, the first ``n`` of them as text, and whether there are more."""
    hit = internal_targets(pages).join(final_failures(errors, pages).withColumnRenamed("identity", "target").hint("merge"), "target")
    w = Window.partitionBy("capture_seq", "url").orderBy("pos")
    first = hit.withColumn("k", F.row_number().over(w))
    shown = F.sort_array(F.collect_list(F.when(F.col("k") <= n, F.struct("k", F.concat(F.lit("HTTP "), "status_code", F.lit(": "), "target").alias("t")))))
    return first.groupBy("capture_seq", "url").agg(F.count("*").alias("failures"), F.array_join(shown["t"], " · ").alias("sample"), (F.count("*") > n).alias("more"))
