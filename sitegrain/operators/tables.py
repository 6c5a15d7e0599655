"""Derived tables, their filters, facets, sorts and pages; element catalogues; rendering and run comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.text import SPACE, added_text_percent, natural_key
from sitegrain.functions.urls import url_extension, url_host, url_origin


def dataset_structured(items: DataFrame) -> DataFrame:
    """The structured data table of rows (url, format, types, valid, error, value, context)."""
    types = F.array_join("types", ", ")
    return items.select(
        F.when(types == "", "Unspecified").otherwise(types).alias("Type"), F.col("format").alias("Format"), F.when(F.col("valid"), "Parsed").otherwise("Invalid").alias("Parsing"), F.col("url").alias("Source page"),
        F.coalesce("context", F.lit("document")).alias("Context"), F.coalesce("error", F.lit("")).alias("Error"), F.coalesce("value", F.lit("{}")).alias("Object"),
    )


def dataset_resources(network: DataFrame, resources: DataFrame, images: DataFrame, most: int = 100) -> DataFrame:
    """The resource table of each page: its first observed requests, declared resources it did not observe, then image candidates seen as neither.

    network (url, pos, resource, type, status, error, content_type, body_bytes, duration_ms, cached); resources (url, pos, resource, kind, type); images (url, pos, resource, alt).
    """
    first = Window.partitionBy("url").orderBy("pos")
    seen = network.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select(
        "url", "resource", F.lit(0).alias("rank"), "pos", F.col("type").alias("Type"), F.when(F.col("error").isNotNull(), "Failed/blocked").otherwise(F.coalesce(F.col("status").cast("string"), F.lit("Unknown"))).alias("Status"),
        F.col("body_bytes").cast("string").alias("Body bytes"), F.col("duration_ms").cast("string").alias("Duration ms"), F.when(F.col("cached"), "Raw response reused").otherwise("Browser request").alias("Evidence"), F.coalesce("error", "content_type").alias("Detail"),
    )
    blank = lambda df: df.withColumn("Status", F.lit("Not fetched")).withColumn("Body bytes", F.lit("")).withColumn("Duration ms", F.lit(""))
    declared = blank(resources.select("url", "resource", F.lit(1).alias("rank"), "pos", F.col("kind").alias("Type"), F.lit("Declared in DOM").alias("Evidence"), F.col("type").alias("Detail")))
    pictures = blank(images.select("url", "resource", F.lit(2).alias("rank"), "pos", F.lit("image").alias("Type"), F.lit("Image candidate").alias("Evidence"), F.coalesce("alt", F.lit("Missing alt attribute")).alias("Detail")))
    every = seen.unionByName(declared).unionByName(pictures)
    best = Window.partitionBy("url", "resource").orderBy("rank", "pos")
    kept = every.withColumn("n", F.row_number().over(best)).where("rank = 0 or n = 1")
    return kept.select(F.col("resource").alias("URL"), "Type", "Status", url_host(F.col("resource")).alias("Host"), "Body bytes", "Duration ms", F.col("url").alias("Source page"), "Evidence", "Detail")


def custom_dataset(pages: DataFrame, names: list[str]) -> DataFrame:
    """One row per page of (url, method, custom, errors) with any extracted field, also where pages share an address; a column ``Field: name`` per rule of the map ``custom``."""
    out = pages.where(F.size("custom") > 0)
    fields = [F.array_join(F.col("custom")[n], " | ").alias(f"Field: {n}") for n in names]
    return out.select(F.col("url").alias("URL"), F.col("method").alias("Method"), *fields, F.array_join("errors", "; ").alias("Errors"))


def filter_dataset(ds: DataFrame, query: str = "", facets: dict[str, str] | None = None) -> DataFrame:
    """Rows with the text in any visible column and equal to every facet that is not empty."""
    q = query.lower().strip()
    for name, value in (facets or {}).items():
        ds = ds.where(F.col(f"`{name}`").cast("string") == value) if value else ds
    visible = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")), F.lit("")) for c in ds.columns if not c.startswith("_")]
    return ds.where(F.exists(F.array(*visible), lambda c: c.contains(q))) if q else ds


def sort_dataset(ds: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """Numbers as numbers, other values with runs of digits as numbers; ties by ``ord`` where there is one."""
    c = F.col(f"`{col}`")
    key = c if ds.schema[col].dataType.typeName() in ("integer", "long", "double", "float", "short") else natural_key(F.coalesce(c.cast("string"), F.lit("")))
    return ds.orderBy(key.desc() if desc else key.asc(), *(["ord"] if "ord" in ds.columns else []))


def facets(ds: DataFrame, col: str, most: int = 80) -> DataFrame:
    c = F.col(f"`{col}`").cast("string")
    return ds.select(c.alias("value")).where("value is not null and value != ''").distinct().orderBy("value").limit(most)


def project(ds: DataFrame, cols: list[str], allowed: list[str]) -> DataFrame:
    """The wanted columns among the allowed ones, each once, in their canonical order."""
    return ds.select(*[F.col(f"`{c}`") for c in allowed if c in set(cols)])


def page_of(df: DataFrame, order: list[Column | str], index: int, size: int) -> DataFrame:
    """One page of an order, its index held within what there is, with ``page`` and ``pages``."""
    total = df.count()
    pages = max(1, -(-total // size))
    index = min(max(0, index), pages - 1)
    return df.orderBy(*order).offset(index * size).limit(size).withColumn("page", F.lit(index)).withColumn("pages", F.lit(pages))


def select_rows(every: DataFrame, filtered: DataFrame, selected: DataFrame | None, key: str = "url") -> DataFrame:
    """The selected rows that still exist; without any selection, the filtered ones."""
    return filtered if selected is None or not selected.take(1) else every.join(selected.select(key).distinct(), key, "left_semi")


PAGE_KEYS = {"url", "title", "status", "method", "words", "depth", "internal", "external", "duration"}


def page_inventory(pages: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif("title", F.lit("")), "heading", F.lit(""))
    return pages.select(
        "url", title.alias("title"), F.col("status_code").alias("status"), F.coalesce("method", F.lit("http")).alias("method"), F.col("word_count").alias("words"), "depth",
        F.when(F.col("discovery") == "sitemap", "seed").otherwise(F.col("depth").cast("string")).alias("depth_label"), F.size("internal_links").alias("internal"), F.size("external_links").alias("external"), F.col("duration_ms").alias("duration"),
    )


def sort_pages(inventory: DataFrame, key: str, desc: bool = False) -> DataFrame:
    """By a column of the inventory; unknown values last in both directions, ties by address."""
    if key not in PAGE_KEYS:
        raise ValueError(f"no such sort key: {key}")
    return inventory.orderBy(F.col(key).desc_nulls_last() if desc else F.col(key).asc_nulls_last(), "url")


def filter_pages(pages: DataFrame, query: str = "", which: str = "all") -> DataFrame:
    """Text in address, title or heading, and one of all, browser, http, render-failed, sitemap, review, external, no-external."""
    conditions = {
        "all": F.lit(True), "browser": F.col("method") == "browser", "http": F.coalesce(F.col("method"), F.lit("http")) != "browser", "render-failed": F.col("render_failure").isNotNull(), "sitemap": F.col("discovery") == "sitemap",
        "review": F.col("review") if "review" in pages.columns else F.lit(False), "external": F.size("external_links") > 0, "no-external": F.size("external_links") == 0,
    }
    out = pages.where(conditions[which])
    return out.where(F.lower(F.concat_ws(" ", "url", "title", "heading")).contains(query.lower())) if query else out


def search_pages(pages: DataFrame, query: str, n: int = 12) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "url", "title", "heading", F.array_join("image_urls", " ")))
    return pages.where(text.contains(query.lower())).orderBy("capture_seq").limit(n)


def filter_elements(cat: DataFrame, query: str = "", source: str = "", kind: str = "") -> DataFrame:
    """Text in any field, a source page, and for images missing, decorative, unknown or an extension, for others the kind."""
    out = cat.where(F.lower(F.to_json(F.struct("*"))).contains(query.lower())) if query else cat
    out = out.where(F.array_contains("sources", source)) if source else out
    if kind and "missing" in cat.columns:
        return out.where(F.col(kind) > 0 if kind in ("missing", "decorative", "unknown") else F.col("extension") == kind)
    return out.where(F.col("kind") == kind) if kind else out


def _ordered(value: str, *by: str) -> Column:
    """Distinct values in their first order. A row's list is as long as its entry has values; ``catalogue_sources`` is the same as a table."""
    pairs = F.array_sort(F.collect_list(F.struct(*by, F.col(value).alias("v"))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def image_catalogue(images: DataFrame, plain: DataFrame) -> DataFrame:
    """Images by address, from elements (capture_seq, url, pos, candidate, alt, width, height) and plain addresses (capture_seq, url, image) without an element.

    A page counts once however often it shows an image; alternatives are distinct.
    """
    shown = images.select("capture_seq", "url", "candidate").distinct()
    bare = plain.withColumnRenamed("image", "candidate").join(shown, ["capture_seq", "url", "candidate"], "left_anti").select("capture_seq", "url", F.lit(1 << 30).alias("pos"), "candidate", F.lit(None).cast("string").alias("alt"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.lit(True).alias("bare"))
    every = images.select("capture_seq", "url", "pos", "candidate", "alt", "width", "height").withColumn("bare", F.lit(False)).unionByName(bare)
    pages = every.groupBy("candidate", "url").agg(F.min("capture_seq").alias("capture_seq")).groupBy("candidate").agg(_ordered("url", "capture_seq").alias("sources"))
    alts = every.where("alt != ''").groupBy("candidate", "alt").agg(F.min(F.struct("capture_seq", "pos")).alias("at")).groupBy("candidate").agg(_ordered("alt", "at").alias("alts"))
    at = F.struct("capture_seq", "pos")
    counts = every.groupBy("candidate").agg(
        F.count_if(~F.col("bare") & F.col("alt").isNull()).alias("missing"), F.count_if(F.col("alt") == "").alias("decorative"), F.count_if("bare").alias("unknown"),
        F.min_by("width", F.when(F.col("width").isNotNull(), at)).alias("width"), F.min_by("height", F.when(F.col("height").isNotNull(), at)).alias("height"),
    )
    out = counts.join(pages, "candidate").join(alts, "candidate", "left")
    return out.select(F.col("candidate").alias("url"), "sources", F.coalesce("alts", F.array().cast("array<string>")).alias("alts"), "missing", "decorative", "unknown", "width", "height", url_extension(F.col("candidate")).alias("extension"))


def link_catalogue(links: DataFrame, root: str, most: int = 1000) -> DataFrame:
    """Links by destination (capture_seq, pos, source, destination, text, rel): texts joined while under ``most`` characters, distinct rels, sources.

    Sources, texts and rels are made distinct before any list is collected.
    """
    at = F.min(F.struct("capture_seq", "pos"))
    distinct = lambda c: links.where(F.col(c) != "").groupBy("destination", c).agg(at.alias("at")).groupBy("destination").agg(_ordered(c, "at").alias(c))
    join = lambda a, x: F.when(F.length(a) >= most, a).when(a == "", x).otherwise(F.concat(a, F.lit(" · "), x))
    texts = distinct("text").select("destination", F.aggregate("text", F.lit(""), join).alias("text"))
    rels = distinct("rel").select("destination", F.array_join("rel", " ").alias("detail"))
    out = distinct("source").join(texts, "destination", "left").join(rels, "destination", "left")
    kind = F.when(url_origin(F.col("destination")) == url_origin(F.lit(root)), "internal").otherwise("external")
    return out.select(kind.alias("kind"), F.col("destination").alias("url"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("detail", F.lit("")).alias("detail"), F.col("source").alias("sources"))


def resource_catalogue(resources: DataFrame) -> DataFrame:
    """Resources by kind and address (capture_seq, pos, url, kind, resource, type)."""
    firsts = resources.groupBy("kind", "resource", "url").agg(F.min("capture_seq").alias("capture_seq"), F.min_by("type", F.struct("capture_seq", "pos")).alias("type"))
    out = firsts.groupBy("kind", "resource").agg(_ordered("url", "capture_seq").alias("sources"), F.min_by("type", "capture_seq").alias("detail"))
    return out.select("kind", F.col("resource").alias("url"), url_extension(F.col("resource")).alias("text"), "detail", "sources")


def heading_occurrences(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("url", F.posexplode("doc.headings").alias("pos", "h"))
    return rows.select(F.concat(F.lit("H"), F.col("h.level").cast("string")).alias("kind"), "url", "pos", F.col("h.text").alias("text"), F.when(F.col("h.id") != "", F.concat(F.lit("#"), "h.id")).otherwise("").alias("detail"))


def form_occurrences(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("url", F.posexplode("doc.forms").alias("pos", "f"))
    fields = F.array_join(F.transform("f.fields", lambda c: F.concat(F.when(c["name"] == "", "(unnamed)").otherwise(c["name"]), F.lit(": "), c["type"])), " · ")
    return rows.select(F.col("f.method").alias("kind"), F.col("f.action").alias("url"), F.concat(F.size("f.fields").cast("string"), F.lit(" controls")).alias("text"), fields.alias("detail"), F.col("url").alias("source"), "pos")


def set_delta(left: str, right: str, most: int = 2000) -> Column:
    """Distinct values of ``left`` that ``right`` lacks, in order."""
    return F.slice(F.array_except(left, right), 1, most)


COMPARED = ("title", "description", "canonical", "h1", "robots")


def compare_rendering(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Facts of both versions of a page (url, words, links, images, title, description, canonical, h1, robots) side by side."""
    side = lambda df, p: df.select("url", *[F.col(c).alias(f"{p}_{c}") for c in ("words", "links", "images", *COMPARED)])
    both = side(raw, "raw").join(side(rendered, "new"), "url")
    text = lambda p, c: F.coalesce(f"{p}_{c}", F.lit(""))
    changes = F.array_compact(F.array(*[F.when(text("raw", c) != text("new", c), F.struct(F.lit("H1" if c == "h1" else c).alias("field"), text("raw", c).alias("raw"), text("new", c).alias("rendered"))) for c in COMPARED]))
    words = lambda p: F.coalesce(f"{p}_words", F.lit(0)).cast("long")
    return both.select(
        "url", words("raw").alias("raw_words"), words("new").alias("rendered_words"), (words("new") - words("raw")).alias("word_delta"), added_text_percent(words("raw"), words("new")).alias("added_text_percent"),
        set_delta("new_links", "raw_links").alias("added_links"), set_delta("raw_links", "new_links").alias("removed_links"), set_delta("new_images", "raw_images").alias("added_images"), set_delta("raw_images", "new_images").alias("removed_images"),
        changes.alias("metadata_changes"),
    )


def source_line_diff(pairs: DataFrame, most_lines: int = 300, most_chars: int = 1200, most_text: int = 120_000) -> DataFrame:
    """(id, line, same, added, removed) of pairs (id, before, after): lines as they are broken, and between tags, as a multiset; order is not aligned."""

    def lines(col: str, name: str) -> DataFrame:
        cut = F.slice(F.split(F.regexp_replace(F.substring(col, 1, most_text), f">{SPACE}*<", ">\n<"), r"\r?\n"), 1, most_lines)
        rows = pairs.select("id", F.explode(cut).alias("line")).select("id", F.substring("line", 1, most_chars).alias("line"))
        return rows.groupBy("id", "line").agg(F.count("*").alias(name))

    both = lines("before", "b").join(lines("after", "a"), ["id", "line"], "full_outer").fillna(0, ["a", "b"])
    return both.select("id", "line", F.least("a", "b").alias("same"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("added"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("removed"))


def render_totals(network: DataFrame, console: DataFrame | None = None) -> DataFrame:
    """Requests, errors and body bytes (not those reused) of each page; with console entries (url, ...) also how many it has."""
    bad = F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) >= 400)
    if console is not None:
        entries = console.groupBy("url").agg(F.count("*").alias("console_entries"))
        return render_totals(network).join(entries.hint("merge"), "url", "full_outer").na.fill(0, ["requests", "errors", "bytes", "console_entries"])
    return network.groupBy("url").agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.coalesce(F.sum(F.when(~F.col("cached"), F.col("body_bytes"))), F.lit(0)).cast("long").alias("bytes"))


#: Rows of a leaf of a digest tree, on average.
LEAF_ROWS = 1024


def digest_tree(pages: DataFrame, errors: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, prefix, digest): a hash tree over a run's pages, less timings, depth and requested address, and its errors.

    A page lies below the first digits of its address's hash, an error below those of its own, ``depth`` of them (else as many as leave about
    LEAF_ROWS rows a leaf, by the number of rows). A leaf hashes its rows' digests in order, a node the digests of its at most 16
    children: no list is longer than a leaf, and a page that changes changes one path. Equal rows are one with a count.
    """
    left_out = ("duration_ms", "depth", "requested_url", "capture_seq")
    of = lambda df, skip: F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in skip])), 256)
    known = pages.select(F.lit("p").alias("k"), F.sha2("url", 256).alias("at"), of(pages, left_out).alias("h"))
    failed = errors.select(F.lit("e").alias("k"), of(errors, ("error_seq",)).alias("at"), of(errors, ("error_seq",)).alias("h"))
    rows = known.unionByName(failed).groupBy("k", "at", "h").agg(F.count("*").alias("n")).checkpoint()
    if depth is None:
        depth = max(0, math.ceil(math.log(max(1, rows.count() / LEAF_ROWS), 16)))
    entries = F.array_sort(F.collect_list(F.concat_ws(":", "k", "at", "h", "n")))
    level = rows.groupBy(F.substring("at", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(entries, ""), 256).alias("digest")).checkpoint()
    out = level.withColumn("level", F.lit(depth))
    for k in reversed(range(depth)):
        children = F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest")))
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sha2(F.array_join(children, ""), 256).alias("digest")).checkpoint()
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "prefix", "digest")


def run_digest(pages: DataFrame, errors: DataFrame, stopped: bool = False, depth: int | None = None) -> DataFrame:
    """One row (digest): the root of ``digest_tree`` and whether the run was stopped."""
    root = digest_tree(pages, errors, depth).where("level = 0").agg(F.max("digest").alias("root"))
    return root.select(F.sha2(F.concat(F.coalesce("root", F.lit("")), F.lit(str(stopped))), 256).alias("digest"))


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, change): added, removed or changed pages of two runs, by a digest of each page's facts."""
    facts = lambda df: df.select("url", F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("duration_ms", "depth", "requested_url", "capture_seq")])), 256).alias("h"))
    both = facts(before).withColumnRenamed("h", "was").join(facts(after).withColumnRenamed("h", "is"), "url", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("url", change.alias("change")).where("change is not null")


ATTENTION = ("failed", "blocked", "interrupted", "stopped")


def filter_runs(runs: DataFrame, query: str = "", which: str = "all", active: tuple[str, ...] = ("queued", "running", "paused", "stopping")) -> DataFrame:
    conditions = {"all": F.lit(True), "completed": F.col("status") == "completed", "active": F.col("status").isin(*active), "attention": (F.col("failures") > 0) | F.col("status").isin(*ATTENTION)}
    out = runs.where(conditions[which])
    return out.where(F.lower(F.concat_ws(" ", "name", "start_url")).contains(query.lower())) if query else out


def sort_runs(runs: DataFrame, by: str = "date") -> DataFrame:
    return runs.orderBy(*{"name": [F.asc("name"), F.asc("id")], "pages": [F.desc("pages"), F.asc("id")]}.get(by, [F.desc("started_at"), F.asc("id")]))


def run_status(blocked: Column, pages: Column, failed: Column, stopped: Column) -> Column:
    return F.when(blocked, "blocked").when((pages == 0) & (failed > 0), "failed").when(stopped, "stopped").otherwise("completed")


def insights(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(name, count) of statuses over pages and errors; an error without one is ``Network / other``."""
    own = pages.select(F.coalesce(F.col("status_code").cast("string"), F.lit("Unknown")).alias("name"))
    bad = errors.select(F.when(F.coalesce("status_code", F.lit(0)) != 0, F.col("status_code").cast("string")).otherwise("Network / other").alias("name"))
    return own.unionByName(bad).groupBy("name").agg(F.count("*").alias("count"))


def upper_median(df: DataFrame, col: str) -> DataFrame:
    """One row: sorted[n div 2] of known values, by the count and one ranked row rather than a collected list."""
    known = df.where(F.col(col).isNotNull()).select(col)
    n = known.count()
    return known.orderBy(col).offset(n // 2).limit(1).withColumnRenamed(col, "median")


def depth_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("depth").agg(F.count("*").alias("count"))


def insight_totals(pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: total bytes, the upper median of durations (0 without pages) and how many images of a catalogue lack an alt anywhere.

    The median is the first of the values from rank n div 2 on: an exact discrete percentile, aggregated by distinct values.
    """
    own = pages.agg(F.coalesce(F.sum("content_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("duration_ms").alias("n"))
    ranked = pages.where("duration_ms is not null").groupBy("duration_ms").agg(F.count("*").alias("k"))
    ranked = ranked.select("duration_ms", F.sum("k").over(Window.orderBy("duration_ms")).alias("upto"))
    n = F.broadcast(own.select("n"))
    median = ranked.crossJoin(n).where("upto > n div 2").agg(F.coalesce(F.min("duration_ms"), F.lit(0)).cast("long").alias("median_ms"))
    missing = catalogue.agg(F.count_if(F.col("missing") > 0).alias("images_missing_alt"))
    return own.select("bytes").crossJoin(F.broadcast(median)).crossJoin(F.broadcast(missing))


def capture_quality(pages: DataFrame) -> DataFrame:
    """One row: pages without an element inventory, and those whose inventory was cut (elements: a struct with ``truncated``)."""
    return pages.agg(F.count_if(F.col("elements").isNull()).alias("legacy_pages"), F.count_if(F.coalesce("elements.truncated", F.lit(False))).alias("truncated_pages"))


def dataset_javascript(pages: DataFrame, comparisons: DataFrame) -> DataFrame:
    """The rendering table of pages (url, word_count, rendering: null or struct<method, status, settled, failure, reasons, console_errors, network_errors>)
    and comparisons as ``compare_rendering`` makes them. Unknown numbers are null."""
    r = lambda c: F.col(f"rendering.{c}")
    both = pages.join(comparisons.hint("merge"), "url", "left")
    reasons = F.when(F.col("rendering").isNotNull(), F.array_join(F.coalesce(r("reasons"), F.array().cast("array<string>")), "; ")).otherwise("Saved before rendering analysis")
    return both.select(
        F.col("url").alias("URL"), F.upper(F.coalesce(r("method"), F.lit("http"))).alias("Method"), F.coalesce(r("status"), F.lit("Legacy HTTP")).alias("State"),
        F.coalesce("raw_words", F.col("word_count").cast("long")).alias("Raw words"), F.col("rendered_words").alias("Rendered words"), F.col("word_delta").alias("Word change"), F.col("added_text_percent").alias("Added text estimate %"),
        F.coalesce(F.size("added_links"), F.lit(0)).alias("JS links"), F.coalesce(F.size("metadata_changes"), F.lit(0)).alias("Metadata changes"),
        F.coalesce(r("console_errors"), F.lit(0)).alias("Console entries"), F.coalesce(r("network_errors"), F.lit(0)).alias("Resource errors"),
        F.coalesce(r("settled"), F.lit("")).alias("Settle state"), F.coalesce(r("failure"), reasons).alias("Reason"),
    )


def dataset_robots(excluded: DataFrame) -> DataFrame:
    """The robots table of excluded encounters (url)."""
    return excluded.select(F.col("url").alias("URL"), F.lit("Disallowed by applicable robots policy").alias("Reason"))


def sort_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy("url", *[c for c in ("kind", "text") if c in catalogue.columns])


def catalogue_sources(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """One row per catalogue entry (``keys``) and source page with its first capture: the whole list, however long, as a table."""
    return rows.groupBy(*keys, source).agg(F.min("capture_seq").alias("capture_seq"))
