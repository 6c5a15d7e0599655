"""Sitemap entries, robots directives, index expansion, and comparison with captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.text import declares_noindex
from sitegrain.functions.urls import normalize_url, url_origin
from sitegrain.operators.windows import last_per_key, running_budget
from sitegrain.sources.captures import usable_sitemaps

# Limits of discovery.
MOST_CHILDREN, MOST_PER_INDEX = 10_001, 32
MOST_QUEUED, MOST_FILES, MOST_URLS, MOST_BYTES = 100, 16, 10_000, 4 * 1024 * 1024
_FIELDS = {"loc": 8193, "lastmod": 100, "changefreq": 40, "priority": 20}
_ENTRY = f"array<struct<{', '.join(f'{f}:array<string>' for f in _FIELDS)}>>"


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, kind, pos, url, lastmod, changefreq, priority) of files (sitemap_url, text): entries of the same origin, fields cut.

    Files are read as XML: an entry is a child of the root, and a field the first child of an entry with that local name, whatever its
    prefix. Files that are no well-formed XML, or have another root, have no entries. Elements inside a field stay as they are written.
    """
    root = F.regexp_extract("text", r"^(?:\s|\x{FEFF}|<\?[\s\S]*?\?>|<!--[\s\S]*?-->)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    kind = F.when(root == "sitemapindex", "index").when(root == "urlset", "urlset")
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = usable_sitemaps(sitemaps).withColumn("kind", kind).where("kind is not null").withColumn("x", F.from_xml("text", f"url {_ENTRY}, sitemap {_ENTRY}, _bad string", options))
    every = F.concat(F.coalesce("x.url", F.array().cast(_ENTRY)), F.coalesce("x.sitemap", F.array().cast(_ENTRY)))
    rows = read.where("x._bad is null").select(F.col("sitemap_url").alias("sitemap"), "kind", F.posexplode(F.slice(every, 1, MOST_CHILDREN)).alias("pos", "e"))
    field = {f: F.substring(F.btrim(F.coalesce(F.get(F.col("e")[f], F.lit(0)), F.lit(""))), 1, most).alias(f) for f, most in _FIELDS.items()}
    rows = rows.select("sitemap", "kind", "pos", *field.values()).where("length(loc) between 1 and 8192").withColumn("url", normalize_url(F.col("loc")))
    return rows.where(url_origin(F.col("url")) == url_origin(F.col("sitemap"))).drop("loc")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(origin, pos, url): the first 20 distinct sitemap directives of the same origin."""
    found = F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    rows = robots.select("origin", F.posexplode(found).alias("pos", "raw")).withColumn("url", normalize_url(F.col("raw"))).where(url_origin(F.col("url")) == F.col("origin"))
    first = rows.groupBy("origin", "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("origin").orderBy("pos"))).where("n <= 20").select("origin", "pos", "url")


def _visited(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, n, sitemap): the files of each origin in the order in which a first-in-first-out queue comes to them.

    A level's files are all those that the queue held when the level before was done; an origin's state is one row: the files visited, the
    queue's next level, and how many addresses were ever queued. What a file adds, and whether there is room, follows from the
    order of the files, so that any depth and order gives the queue's own result. A level is one join, cut by a checkpoint.
    """
    index = Window.partitionBy("sitemap").orderBy("pos")
    children = entries.where("kind = 'index'").withColumn("i", F.row_number().over(index)).where(F.col("i") <= MOST_PER_INDEX)
    children = children.groupBy("sitemap").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "url"))), lambda x: x["url"]).alias("kids")).checkpoint()
    order = F.col("pos") if "pos" in seeds.columns else F.lit(0)
    given = seeds.select("origin", F.struct(order.cast("long").alias("pos"), F.col("url").alias("url"), normalize_url(F.col("url")).alias("at")).alias("s"))
    state = given.groupBy("origin").agg(F.sort_array(F.collect_set("s")).alias("s"))
    root = F.concat("origin", F.lit("/sitemap.xml"))
    ever = F.array_distinct(F.concat(F.transform("s", lambda x: x["url"]), F.array(root)))
    own = F.filter(F.transform("s", lambda x: F.when(url_origin(x["at"]) == F.col("origin"), x["at"])), lambda u: u.isNotNull())
    state = state.select("origin", F.array().cast("array<string>").alias("visited"), F.concat(own, F.array(normalize_url(root))).alias("queue"), F.size(ever).alias("ever")).checkpoint()
    done = []
    while True:
        new = F.slice(F.array_except("queue", "visited"), 1, F.greatest(F.lit(MOST_FILES) - F.size("visited"), F.lit(0)))
        step = state.withColumn("before", F.size("visited")).withColumn("new", new).withColumn("visited", F.concat("visited", "new")).checkpoint()
        done.append(step.select("origin", F.posexplode("new").alias("i", "sitemap"), "before").select("origin", (F.col("i") + F.col("before") + 1).alias("n"), "sitemap"))
        going = step.where(f"size(new) > 0 and size(visited) < {MOST_FILES}")
        if not going.take(1):
            break
        at = going.select("origin", F.posexplode("new").alias("i", "sitemap"), "before").select("origin", "sitemap", (F.col("i") + F.col("before") + 1).alias("n"))
        found = at.join(children.hint("merge"), "sitemap").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("n", "kids"))).alias("files"))
        seen = lambda kid: F.array_position("visited", kid)
        pushed = F.flatten(F.transform("files", lambda f: F.filter(f["kids"], lambda kid: (seen(kid) == 0) | (seen(kid) > f["n"]))))
        queue = F.slice(pushed, 1, F.greatest(F.lit(MOST_QUEUED) - F.col("ever"), F.lit(0)))
        state = going.join(found.hint("merge"), "origin").select("origin", "visited", queue.alias("queue"), (F.col("ever") + F.size(queue)).alias("ever")).checkpoint()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _owned(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Each address in the first file that lists it, in order, within the limits of addresses and bytes."""
    listed = entries.where("kind = 'urlset'").join(files.hint("merge"), "sitemap")
    own = listed.groupBy("origin", "url").agg(F.min_by(F.struct("sitemap", "lastmod", "changefreq", "priority", "n", "pos"), F.struct("n", "pos")).alias("r")).select("origin", "url", "r.*")
    own = own.withColumn("size", F.octet_length(F.to_json(F.struct("url", "sitemap", "lastmod", "changefreq", "priority"))))
    own = running_budget(own, "size", MOST_BYTES, ["origin"], ["n", "pos"])
    return own.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy("n", "pos"))).where(F.col("k") <= MOST_URLS)


def _known(store: DataFrame) -> DataFrame:
    good = store.where(F.coalesce(F.col("status"), F.lit(200)) < 400) if "status" in store.columns else store
    return sitemap_entries(good.select(normalize_url(F.col("sitemap_url")).alias("sitemap_url"), "text")).checkpoint()


def expand_sitemaps(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, sitemap, url, lastmod, changefreq, priority): what the files that a queue comes to list, from the seeds on.

    ``store`` has captured files (sitemap_url, text, perhaps status), ``seeds`` addresses (origin, url, perhaps their order pos); each origin's
    ``/sitemap.xml`` is queued after them. A file that was not captured, or failed, is visited and lists nothing.
    """
    entries = _known(store)
    return _owned(entries, _visited(entries, seeds)).select("origin", "sitemap", "url", "lastmod", "changefreq", "priority")


def sitemap_files(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, n, sitemap, kind, urls): the files visited, in order, up to where the limit of addresses or of bytes ends the search."""
    entries = _known(store)
    files = _visited(entries, seeds).checkpoint()
    kinds = entries.groupBy("sitemap").agg(F.max("kind").alias("kind"))
    own = _owned(entries, files).groupBy("origin", "sitemap").agg(F.count("*").alias("urls"))
    listed = entries.where("kind = 'urlset'").join(files.hint("merge"), "sitemap").groupBy("origin", "url").agg(F.min(F.struct("n", "pos", "sitemap")).alias("r"))
    first = listed.groupBy("origin", "r.sitemap").agg(F.count("*").alias("all"))
    rows = files.join(kinds.hint("merge"), "sitemap", "left").join(own.hint("merge"), ["origin", "sitemap"], "left").join(first.hint("merge"), ["origin", "sitemap"], "left")
    rows = rows.select("origin", "n", "sitemap", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("urls", F.lit(0)).cast("long").alias("urls"), F.coalesce("all", F.lit(0)).alias("all"))
    before = Window.partitionBy("origin").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    full = (F.coalesce(F.sum("urls").over(before), F.lit(0)) >= MOST_URLS) | F.coalesce(F.max((F.col("urls") < F.col("all"))).over(before), F.lit(False))
    return rows.withColumn("full", full).where(~F.col("full")).drop("full", "all")


def _inlinked(pages: DataFrame) -> DataFrame:
    links = pages.select("url", F.explode("outgoing_links").alias("to"))
    return links.where(url_origin(F.col("to")) == url_origin(F.col("url"))).select(F.col("to").alias("URL")).distinct().withColumn("linked", F.lit(True))


def dataset_sitemaps(pages: DataFrame, errors: DataFrame, entries: DataFrame, start_url: str, discovered: bool = True) -> DataFrame:
    """The sitemap table: every entry's capture status, internal discovery and indexability; then captured pages that no sitemap lists."""
    asked = pages.select(F.col("url").alias("URL"), "capture_seq", F.lit(0).alias("k"), F.col("url").alias("final"), "requested_url", "robots", "x_robots_tag").unionByName(
        pages.where("requested_url is not null").select(F.col("requested_url").alias("URL"), "capture_seq", F.lit(1).alias("k"), F.col("url").alias("final"), "requested_url", "robots", "x_robots_tag")
    )
    known = last_per_key(asked.withColumn("seq", F.col("capture_seq") * 2 + F.col("k")).drop("capture_seq", "k"), ["URL"], "seq")
    noindex = F.when(declares_noindex(F.col("robots"), F.col("x_robots_tag")), "noindex declared").otherwise("No noindex observed")
    known = known.select("URL", F.when(F.col("requested_url") != F.col("final"), "Redirected").otherwise("Crawled").alias("captured"), noindex.alias("idx"))
    failed = last_per_key(errors.select(F.col("url").alias("URL"), "kind", "status_code", "error_seq"), ["URL"], "error_seq").select("URL", F.concat(F.lit("Error "), F.coalesce(F.col("status_code").cast("string"), "kind")).alias("failed"))
    inside = _inlinked(pages)
    listed = entries.withColumnRenamed("url", "URL").join(known, "URL", "left").join(failed, "URL", "left").join(inside, "URL", "left").select(
        "URL", F.coalesce("captured", "failed", F.lit("Not crawled")).alias("Status"),
        F.when(F.col("linked"), "Linked internally").when(F.col("URL") == start_url, "Start URL").otherwise("No captured inlink").alias("Internal discovery"),
        F.coalesce("idx", F.lit("Unknown")).alias("Indexability"), F.col("sitemap").alias("Sitemap"), F.col("lastmod").alias("Lastmod"), F.col("changefreq").alias("Changefreq"), F.col("priority").alias("Priority"),
    )
    if not discovered:
        return listed
    absent = absent_from_sitemaps(pages, entries).select(F.col("url").alias("URL"), "robots").join(inside, "URL", "left").select(
        "URL", F.lit("Absent from discovered sitemaps").alias("Status"), F.when(F.col("linked"), "Linked internally").otherwise("Start/redirect URL").alias("Internal discovery"),
        F.when(F.coalesce("robots", F.lit("")).rlike("(?i)noindex"), "noindex declared").otherwise("No noindex observed").alias("Indexability"),
        F.lit("").alias("Sitemap"), F.lit("").alias("Lastmod"), F.lit("").alias("Changefreq"), F.lit("").alias("Priority"),
    )
    return listed.unionByName(absent)


def absent_from_sitemaps(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages that no sitemap lists under their final or requested address."""
    listed = entries.select(F.col("url").alias("_listed")).distinct()
    out = pages.join(listed, F.col("url") == F.col("_listed"), "left_anti")
    return out.join(listed, F.col("requested_url") == F.col("_listed"), "left_anti")
