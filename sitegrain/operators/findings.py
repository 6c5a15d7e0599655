"""Audit findings, coverage and histograms over captured pages.

Pages carry url, requested_url, capture_seq, title, description, canonical_url, robots, x_robots_tag, internal_links,
duration_ms, depth, status_code, content_fingerprint, word_count, render_failure and an ``accessibility`` struct, each nullable:
absent means unknown, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import declares_noindex, is_fingerprint
from sitegrain.functions.urls import url_identity
from sitegrain.joins import hot_keys, skew_join
from sitegrain.operators.links import aliases, incoming, sample_failures
from sitegrain.operators.windows import last_per_key

CATEGORIES = ("Content", "Accessibility", "Links", "Indexability", "Capture")
TIMINGS = ("Under 250 ms", "250–999 ms", "1–2.99 s", "3 s or more", "Unknown")
OUTCOMES = ("2xx", "3xx", "4xx", "5xx", "No HTTP status", "Other status")
#: Fixed values: (count, title, what is wrong).
UNNAMED = (
    ("images_missing_alt", "Images missing alt", "images lack an alt attribute; empty alt is accepted for decorative images."),
    ("controls_without_name", "Controls needing names", "form controls lack a name recognized by these static heuristics."),
    ("links_without_name", "Links needing names", "links lack a name recognized by these static heuristics."),
    ("buttons_without_name", "Buttons needing names", "buttons lack a name recognized by these static heuristics."),
)


def known_number(c: Column) -> Column:
    """Finite and not negative, else null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d < float("inf")), c)


def _finding(cond: Column, severity: str, category: str, title: str, detail: Column | str, related: Column | None = None) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    row = F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"), detail.alias("detail"), (related if related is not None else F.lit("")).alias("related_url"))
    return F.when(cond, row)


def page_rules() -> list[Column]:
    """Findings that a page's own row decides; null where a rule does not apply."""
    a = lambda f: F.col(f"accessibility.{f}")
    blank = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) == "")
    some = F.col("accessibility").isNotNull()
    cut = F.coalesce(a("truncated"), F.lit(False))
    unnamed = [
        _finding(some & (a(n) > 0), "review", "Accessibility", title, F.concat(a(n).cast("string"), F.lit(" " + what), F.when(cut, " Partial sample.").otherwise("")))
        for n, title, what in UNNAMED
    ]
    return [
        _finding(blank("title"), "review", "Content", "Missing title", "No nonempty HTML title was captured."),
        _finding(blank("description"), "review", "Content", "Missing description", "No nonempty meta description was captured."),
        _finding(some & cut, "info", "Capture", "Accessibility sample capped", "Static checks stopped after 5,000 elements. This page is excluded from element coverage percentages."),
        _finding(some & (F.coalesce(a("language"), F.lit("")) == ""), "review", "Accessibility", "Missing document language", "The document has no nonempty lang attribute. This check does not validate language tags."),
        _finding(some & ~cut & (F.coalesce(a("h1_count"), F.lit(0)) == 0), "review", "Accessibility", "No main heading", "No visible-in-markup H1 was found. Confirm the intended heading structure manually."),
        _finding(some & (a("h1_count") > 1), "info", "Accessibility", "Multiple main headings", F.concat(a("h1_count").cast("string"), F.lit(" H1 elements were observed. Multiple H1s are not automatically an accessibility failure."))),
        *unnamed,
        _finding(declares_noindex(F.col("robots"), F.col("x_robots_tag")), "info", "Indexability", "Noindex declared", "Captured robots directives include noindex. This may be intentional; it is not an error."),
        _finding((F.coalesce("canonical_url", F.lit("")) != "") & (url_identity(F.col("canonical_url")) != url_identity(F.col("url"))), "info", "Indexability", "Canonical points elsewhere", "Review the captured canonical destination; a different canonical can be intentional.", F.col("canonical_url")),
        _finding(F.coalesce("render_failure", F.lit("")) != "", "review", "Capture", "Rendering incomplete", F.col("render_failure")),
    ]


def related_duplicate(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its group's ``size`` and ``related``: the group's first page, or the second for the first itself.

    Groups are aggregated before the join, and the rows of a title that many pages share are dealt to many tasks.
    """
    first = df.groupBy(key).agg(F.count("*").alias("size"), F.min(F.struct("capture_seq", "url")).alias("one"))
    hot = hot_keys(df, key)
    second = skew_join(df, first, key, hot=hot).where(F.col("capture_seq") != F.col("one.capture_seq")).groupBy(key).agg(F.min(F.struct("capture_seq", "url")).alias("two"))
    return skew_join(df, first.where("size > 1").join(second, key, "left"), key, hot=hot).withColumn("related", F.when(F.col("capture_seq") == F.col("one.capture_seq"), F.col("two.url")).otherwise(F.col("one.url"))).drop("one", "two")


def repeated_titles(pages: DataFrame) -> DataFrame:
    """(capture_seq, url, title, size, related) of pages whose trimmed title others share."""
    rows = pages.select("capture_seq", "url", F.trim("title").alias("title")).where("title != ''")
    return related_duplicate(rows, "title")


def duplicate_text(pages: DataFrame) -> DataFrame:
    """(capture_seq, url, content_fingerprint, size, related) of pages with equal body texts."""
    rows = pages.select("capture_seq", "url", "content_fingerprint").where(is_fingerprint(F.col("content_fingerprint")))
    return related_duplicate(rows, "content_fingerprint")


def findings(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(capture_seq, url, severity, category, title, detail, related_url): all rules."""
    own = pages.select("capture_seq", "url", F.explode(F.array_compact(F.array(*page_rules()))).alias("f")).select("capture_seq", "url", "f.*")
    row = lambda df, severity, category, title, detail, related: df.select("capture_seq", "url", F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"), detail.alias("detail"), related.alias("related_url"))
    failed = sample_failures(pages, errors)
    more = F.when(F.col("more"), " · More destinations are available in Issues.").otherwise("")
    links = row(failed, "error", "Links", "Failed internal destinations", F.concat(F.col("failures").cast("string"), F.lit(" distinct internal destinations returned captured HTTP errors. "), "sample", more, F.lit(" Unvisited URLs are not classified as broken.")), F.lit(""))
    titles = row(repeated_titles(pages), "review", "Content", "Repeated title", F.concat(F.col("size").cast("string"), F.lit(" captured pages share this case-sensitive, trimmed title.")), F.coalesce("related", F.lit("")))
    same = row(duplicate_text(pages), "review", "Content", "Matching body text", F.concat(F.col("size").cast("string"), F.lit(" pages share the same complete whitespace-normalized body-text fingerprint. This is not a visual, semantic, or byte-for-byte HTML comparison.")), F.coalesce("related", F.lit("")))
    return own.unionByName(links).unionByName(titles).unionByName(same)


def coverage(pages: DataFrame) -> DataFrame:
    """(label, present, eligible, unit, percent) of the six axes; percent is null where nothing is eligible."""
    a = lambda f: F.col(f"accessibility.{f}")
    some = F.col("accessibility").isNotNull()
    whole = some & ~F.coalesce(a("truncated"), F.lit(False))
    given = lambda c: F.when(F.col(c).isNotNull(), F.when(F.trim(F.col(c)) != "", 1).otherwise(0))
    axes = [
        ("Title", "pages", given("title"), F.when(F.col("title").isNotNull(), 1)),
        ("Description", "pages", given("description"), F.when(F.col("description").isNotNull(), 1)),
        ("Main heading", "pages", F.when(whole & (a("h1_count") > 0), 1), F.when(whole, 1)),
        ("Language", "pages", F.when(some & (a("language") != ""), 1), F.when(some, 1)),
        ("Image alt", "images", F.when(whole, a("images") - a("images_missing_alt")), F.when(whole, a("images"))),
        ("Control names", "controls", F.when(whole, a("controls") - a("controls_without_name")), F.when(whole, a("controls"))),
    ]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = pages.agg(*[zero(p).alias(f"p{i}") for i, (_, _, p, _) in enumerate(axes)], *[zero(e).alias(f"e{i}") for i, (_, _, _, e) in enumerate(axes)])
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"p{i}").alias("present"), F.col(f"e{i}").alias("eligible"), F.lit(unit).alias("unit")) for i, (label, unit, _, _) in enumerate(axes)])
    return sums.select(F.explode(rows).alias("r")).select("r.*", F.when(F.col("r.eligible") > 0, F.floor(F.col("r.present") / F.col("r.eligible") * 100 + 0.5)).cast("long").alias("percent"))


def _filled(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Counts of every label in its order, zero where there are none."""
    every = df.sparkSession.createDataFrame(list(enumerate(labels)), "ord int, label string")
    return every.join(df.groupBy("label").agg(F.count("*").alias("count")), "label", "left").select("ord", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def timing_histogram(pages: DataFrame) -> DataFrame:
    d = known_number(F.col("duration_ms"))
    label = F.when(d.isNull(), TIMINGS[4]).when(d < 250, TIMINGS[0]).when(d < 1000, TIMINGS[1]).when(d < 3000, TIMINGS[2]).otherwise(TIMINGS[3])
    return _filled(pages.select(label.alias("label")), TIMINGS)


def outcomes(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """HTTP outcomes of distinct addresses: a page's status, else that of the last page error of an address no capture has."""
    last = last_per_key(pages.select(url_identity(F.col("url")).alias("id"), "status_code", "capture_seq"), ["id"], "capture_seq").select("id", "status_code")
    bad = errors.where("stage is null or stage in ('', 'page')").select(url_identity(F.col("url")).alias("id"), "status_code", "error_seq")
    bad = bad.join(aliases(pages).select(F.col("alias").alias("id")), "id", "left_anti")
    # the last write counts even where it has no status
    bad = bad.groupBy("id").agg(F.max_by(F.struct("status_code"), "error_seq").alias("r")).select("id", "r.status_code")
    s = F.col("status_code")
    label = F.when(s.isNull() | (s == 0), OUTCOMES[4]).when(s.between(200, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))).otherwise(OUTCOMES[5])
    return _filled(last.unionByName(bad).select(label.alias("label")), OUTCOMES)


def depth_buckets(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(depth, label, clear, review): pages without and with findings at each depth, unknown (-1) first."""
    flagged = pages.join(found.select("url").distinct().withColumn("hit", F.lit(True)), "url", "left").select(F.coalesce(known_number(F.col("depth")), F.lit(-1)).cast("long").alias("depth"), F.coalesce("hit", F.lit(False)).alias("hit"))
    label = F.when(F.col("depth") < 0, "Unknown").otherwise(F.concat(F.lit("Depth "), F.col("depth").cast("string")))
    return flagged.groupBy("depth").agg(F.count_if(~F.col("hit")).alias("clear"), F.count_if("hit").alias("review")).select("depth", label.alias("label"), "clear", "review")


def page_metrics(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(url, title, duration, words, incoming, findings) of every page."""
    counts = found.groupBy("url").agg(F.count("*").alias("findings"))
    return (
        pages.withColumn("identity", url_identity(F.col("url"))).join(incoming(pages), "identity", "left").join(counts, "url", "left")
        .select(
            "url", F.coalesce("title", F.lit("")).alias("title"), known_number(F.col("duration_ms")).alias("duration"), known_number(F.col("word_count")).alias("words"),
            F.coalesce("incoming", F.lit(0)).cast("long").alias("incoming"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
        )
    )


def rank_pages(metrics: DataFrame, by: str = "findings") -> DataFrame:
    """By findings, duration or incoming links, most first, unknown last, then by address."""
    return metrics.orderBy(F.col(by if by in ("duration", "incoming") else "findings").desc_nulls_last(), "url")


def filter_findings(found: DataFrame, query: str = "", category: str = "all", severity: str = "all") -> DataFrame:
    q = query.strip().lower()
    out = found.where(F.col("category") == category) if category not in ("", "all") else found
    out = out.where(F.col("severity") == severity) if severity not in ("", "all") else out
    return out.where(F.exists(F.array("url", "title", "detail", "related_url"), lambda c: F.lower(c).contains(q))) if q else out


def sort_findings(found: DataFrame, order: str = "severity") -> DataFrame:
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "review", 1).otherwise(2)
    return found.orderBy("url" if order == "url" else rank, "category", "url", "title")


# Issues: the second set of rules. It counts unknown titles as missing and takes the first H1 or H2 for the heading.


#: Title, what is said (after a number, or whole), severity.
ISSUES = {
    "rendering": ("JavaScript · Rendering incomplete", "", "review"),
    "console": ("JavaScript · Console entries", " console warnings/errors captured. Inspect JavaScript evidence; not all warnings indicate a broken page.", "review"),
    "requests": ("Resources · Failed or blocked requests", " requests failed or were blocked by crawl policy. Inspect the network waterfall.", "review"),
    "structured": ("Structured data · Invalid JSON-LD", "At least one JSON-LD block could not be parsed. Inspect the captured error.", "review"),
    "rule": ("Custom extraction · Rule error", "", "review"),
    "noindex": ("Indexability · noindex declared", "This page declares noindex. This may be intentional; review before including it in a sitemap.", "info"),
    "title": ("Missing page title", "No text was found in the HTML <title> element.", "review"),
    "heading": ("Missing main heading", "No H1 or fallback H2 heading was found.", "review"),
    "description": ("Missing meta description", "No meta description was found in the downloaded HTML.", "review"),
    "repeated": ("Repeated page title", " crawled pages share this exact title. Review whether this is intentional.", "review"),
}


def issues(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(title, detail, url, severity) of failures and pages. Pages also carry heading, console_errors, network_errors, structured_invalid and extraction_errors."""
    status = F.col("status_code")
    failed = errors.select(
        F.when(F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" · "), F.when(F.col("kind") == "non-html", "Not an HTML page").otherwise("Request failed")))
        .otherwise(F.concat(F.when(F.col("kind") == "network", "Connection failed").otherwise(F.col("kind")), F.lit(" · Could not read page"))).alias("title"),
        F.col("message").alias("detail"), "url", F.when(F.col("kind").isin("non-html", "aborted"), "info").otherwise("error").alias("severity"),
    )
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0

    def row(name: str, before: Column | None = None) -> Column:
        title, said, severity = ISSUES[name]
        detail = F.lit(said) if before is None else F.concat(before.cast("string"), F.lit(said))
        return F.struct(F.lit(title).alias("title"), detail.alias("detail"), F.lit(severity).alias("severity"))

    rules = F.array(
        F.when(~empty("render_failure"), row("rendering", F.col("render_failure"))),
        F.when(more("console_errors"), row("console", F.col("console_errors"))),
        F.when(more("network_errors"), row("requests", F.col("network_errors"))),
        F.when(F.coalesce("structured_invalid", F.lit(False)), row("structured")),
        F.when(declares_noindex(F.col("robots"), F.col("x_robots_tag")), row("noindex")),
        F.when(blank("title"), row("title")),
        F.when(empty("heading"), row("heading")),
        F.when(blank("description"), row("description")),
    )
    custom = F.transform(F.coalesce("extraction_errors", F.array().cast("array<string>")), lambda e: row("rule", e))
    own = pages.select("url", F.explode(F.concat(F.array_compact(rules), custom)).alias("i"))
    shared = repeated_titles(pages).select("url", row("repeated", F.col("size")).alias("i"))
    return failed.unionByName(own.unionByName(shared).select("i.title", "i.detail", "url", "i.severity"))


def issue_group(title: Column) -> Column:
    prefix = F.split_part(title, F.lit(" · "), F.lit(1))
    named = F.when(prefix.isin("JavaScript", "Resources", "Structured data", "Custom extraction", "Indexability"), prefix).when(prefix.rlike("(?i)robots"), "Robots").otherwise("HTTP / Network")
    return F.when(title.contains(" · "), named).when(title.rlike("(?i)heading"), "Content").otherwise("Metadata")


def issue_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(issue_group(F.col("title")).alias("group")).agg(F.count("*").alias("count"))


def filter_issues(rows: DataFrame, group: str = "All", query: str = "") -> DataFrame:
    out = rows if group == "All" else rows.where(issue_group(F.col("title")) == group)
    return out.where(F.lower(F.concat_ws(" ", "title", "detail", "url")).contains(query.lower())) if query else out


def with_review(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """``pages`` with ``review``: whether an issue names the page."""
    return pages.join(rows.select("url").distinct().withColumn("review", F.lit(True)), "url", "left").withColumn("review", F.coalesce("review", F.lit(False)))
