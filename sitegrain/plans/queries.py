"""Registered queries, named by the operator that each one shows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions import http, text, urls
from sitegrain.operators import findings as fi
from sitegrain.operators import frontier, graph, links, robots, sitemaps, tables, windows
from sitegrain.operators.parse import parse_pages, structured_rows
from sitegrain.plans.captures import CAPTURES, ENRICHED, ENRICHED_WHOLE, ERRORS, ROOT, TARGETS, captures, enriched, errors, parsed, table
from sitegrain.streaming.streams import latest_outcome

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Names that queries' SQL may use: pages with more markup, captures, their links and their failures.
WITH = f"""WITH ep AS (SELECT page_id, url, {ENRICHED} AS html FROM pages),
cap AS (SELECT * FROM ({CAPTURES})), tgt AS (SELECT * FROM ({TARGETS})), err AS (SELECT * FROM ({ERRORS})),
ident AS (SELECT capture_seq, pos, regexp_replace(target, '#.*$', '') AS raw, target FROM tgt),
alias AS (SELECT alias, arg_max(identity, seq) AS identity FROM (SELECT url AS alias, url AS identity, capture_seq * 2 + 1 AS seq FROM cap UNION ALL SELECT requested_url, url, capture_seq * 2 FROM cap) GROUP BY alias),
res AS (SELECT i.capture_seq, i.pos, c.url AS source, coalesce(a.identity, i.raw) AS target, i.target AS raw FROM ident i JOIN cap c USING (capture_seq) LEFT JOIN alias a ON a.alias = i.raw)
"""
HOST = "lower(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1))"
PATH = "CASE WHEN regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"
H, P = HOST.format("url"), PATH.format("url")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# Functions


@query("f01_normalize_url", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+)$', '\\1/') AS normal FROM pages")
def f01(spark, d):
    return pages(spark, d).select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query(
    "f02_resolve_url",
    """SELECT page_id, i AS pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%20', '%20'), '%27', '''') AS target
FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS l FROM pages))""",
)
def f02(spark, d):
    hrefs = pages(spark, d).select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("pos", "href"))
    return hrefs.select("page_id", F.col("pos").cast("long").alias("pos"), urls.resolve_url(F.col("href"), F.lit(None).cast("string"), F.col("url")).alias("target"))


@query(
    "f03_strip_tracking",
    """SELECT page_id, CASE WHEN NOT regexp_matches(u, '[?&](utm_[a-z]*|fbclid|gclid|msclkid)=') THEN u ELSE
  regexp_replace(regexp_replace(regexp_replace(u, '(utm_[a-z]*|fbclid|gclid|msclkid)=[^&]*', '', 'g'), '&+$', ''), '\\?$', '') END AS clean
FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)""",
)
def f03(spark, d):
    return pages(spark, d).select("page_id", urls.strip_tracking(F.col("url")).alias("clean"))


@query(
    "f04_url_parts",
    f"""SELECT page_id, {H} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, {P} AS path, regexp_replace({H} || {P}, '/$', '') AS key,
  coalesce(nullif(list_filter(string_split({P}, '/'), lambda x: x <> '')[1], ''), '(root)') AS grp,
  CASE WHEN regexp_extract({P}, '\\.([A-Za-z0-9]{{1,8}})$', 1) = '' THEN 'unknown' ELSE lower(regexp_extract({P}, '\\.([A-Za-z0-9]{{1,8}})$', 1)) END AS extension,
  {P} || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.+)$', 1) AS label, CAST(len(list_filter(string_split({P}, '/'), lambda x: x <> '')) AS INTEGER) AS segments FROM pages""",
)
def f04(spark, d):
    u = F.col("url")
    return pages(spark, d).select(
        "page_id", urls.url_host(u).alias("host"), urls.url_origin(u).alias("origin"), urls.url_path(u).alias("path"), urls.url_key(u).alias("key"), urls.path_group(u).alias("grp"),
        urls.url_extension(u).alias("extension"), urls.path_label(u).alias("label"), F.size(urls.path_segments(u)).alias("segments"),
    )


@query("f05_in_scope", f"SELECT page_id, {P} = '/en' OR starts_with({P}, '/en/') AS inside, regexp_extract(url, '^[a-z]+://[^/?#]*') = regexp_extract(url, '^[a-z]+://[^/?#]*') AS whole FROM pages")
def f05(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.in_scope(u, urls.url_origin(u), F.lit("/en/")).alias("inside"), urls.in_scope(u, urls.url_origin(u), F.lit("")).alias("whole"))


@query("f07_canonical_transition", f"SELECT page_id, NOT starts_with(url, 'https') OR true AS up, false AS down, starts_with(url, 'http://') OR starts_with(url, 'https://') AS www FROM pages WHERE {H} <> ''")
def f07(spark, d):
    u, host = F.col("url"), urls.url_host(F.col("url"))
    https, http_ = F.concat(F.lit("https://"), host), F.concat(F.lit("http://"), host)
    return pages(spark, d).select(
        "page_id", urls.canonical_transition(u, https).alias("up"), urls.canonical_transition(https, http_).alias("down"), urls.canonical_transition(u, F.concat(F.lit("https://www."), host)).alias("www")
    )


@query("f13_clean_text", "SELECT doc_id, substr(trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')), 1, 200) AS clean FROM documents")
def f13(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text"), 200).alias("clean"))


ESCAPES = """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN regexp_matches(text, '^[\\x00-\\x20]*[=+@-]') OR regexp_matches(text, '^[\\t\\r\\n]') THEN '''' || text ELSE text END AS csv FROM documents"""


@query("f14_escapes", ESCAPES)
@query("f14_escapes_whole", ESCAPES)
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", text.html_escape(F.col("text")).alias("html"), text.csv_safe(F.col("text")).alias("csv"))


@query(
    "f16_messages",
    """SELECT event_id, regexp_replace(m, '(https?://)[^\\s/@]+:[^\\s/@]+@', '\\1[redacted]@', 'g') AS message,
  CASE WHEN event_id % 7 = 0 THEN 'dns' WHEN event_id % 7 = 1 THEN 'tls' WHEN event_id % 7 = 2 THEN 'connection-refused' WHEN event_id % 7 = 3 THEN 'unreachable' WHEN event_id % 7 = 4 THEN 'timeout' ELSE 'network' END AS kind
FROM (SELECT event_id, ['getaddrinfo ENOTFOUND', 'CERT_HAS_EXPIRED', 'ECONNREFUSED', 'EHOSTUNREACH', 'request timed out', 'reset', 'https://a:b@h/x broke'][CAST(event_id % 7 AS INTEGER) + 1] || ' ' || event_type AS m FROM events)""",
)
def f16(spark, d):
    m = F.concat(F.get(F.array(*[F.lit(x) for x in ("getaddrinfo ENOTFOUND", "CERT_HAS_EXPIRED", "ECONNREFUSED", "EHOSTUNREACH", "request timed out", "reset", "https://a:b@h/x broke")]), (F.col("event_id") % 7).cast("int")), F.lit(" "), "event_type")
    return table(spark, d, "events").select("event_id", text.redact_credentials(m).alias("message"), http.failure_kind(m).alias("kind"))


@query(
    "f20_is_public_ip",
    """SELECT event_id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b IN (0, 168) OR (b = 88 AND c = 99)))
  OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)) AS public
FROM (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b, user_id % 256 AS c FROM events)""",
)
def f20(spark, d):
    ip = F.expr("concat_ws('.', event_id * 7 % 256, event_id * 13 % 256, user_id % 256, 9)")
    return table(spark, d, "events").select("event_id", http.is_public_ip(ip).alias("public"))


PRINTS = """SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 2097151 THEN 'sha256-text-v1:' || sha256(text) END AS fp,
  CASE WHEN text = '' THEN 0 ELSE CAST(len(regexp_split_to_array(text, '[\\s\\x{A0}]+')) AS INTEGER) END AS words FROM documents"""


@query("f22_content_fingerprint", PRINTS)
@query("f22_content_fingerprint_all", PRINTS)
def f22(spark, d):
    words = F.when(F.col("text").isNotNull(), text.word_count(F.col("text")))
    return table(spark, d, "documents").select("doc_id", text.content_fingerprint(F.col("text")).alias("fp"), words.alias("words"))


@query("f29_retry", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 90 * 1000 WHEN event_id % 3 = 1 THEN 0 END AS ms, s IN (408, 429, 500, 502, 503, 504) AS again FROM (SELECT *, 400 + event_id % 110 AS s FROM events)")
def f29(spark, d):
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 3 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise("soon")
    return table(spark, d, "events").select("event_id", http.retry_after_ms(header, F.col("ts").cast("timestamp")).alias("ms"), http.is_retryable(400 + F.col("event_id") % 110).alias("again"))


# Extraction

#: Runs of space as ``dom.clean`` makes them one, and the character references that pages' texts have; HTML reads these without their semicolon too.
CLEAN = "trim(regexp_replace({0}, '[\\t-\\r \\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"
UNESCAPE = "{0}"
for _name, _is in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    UNESCAPE = f"regexp_replace({UNESCAPE}, '&{_name};?', '{_is}', 'g')"


@query("e01_page_core", f"""{WITH} SELECT page_id, {CLEAN.format(UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title, {CLEAN.format(UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS heading,
  CASE WHEN page_id % 3 = 0 THEN 'About ' || page_id ELSE '' END AS description, CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/c/1' ELSE '' END AS canonical_url,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CASE WHEN page_id % 7 = 0 THEN 'NoIndex, follow' ELSE '' END AS robots FROM ep""")
def e01(spark, d):
    return parsed(spark, d).select("page_id", *[F.col(f"doc.{c}").alias(c) for c in ("title", "heading", "description", "canonical_url", "language", "robots")])


@query("e03_headings", f"""{WITH} SELECT page_id, 0 AS pos, 1 AS level, {CLEAN.format(UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS text, '' AS id FROM ep UNION ALL SELECT page_id, 1, 2, 'More on page', 'more' FROM ep""")
def e03(spark, d):
    return parsed(spark, d).select("page_id", F.posexplode("doc.headings").alias("pos", "h")).select("page_id", "pos", "h.level", "h.text", "h.id")


@query("e04_images", f"""{WITH} SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/i/' || page_id % 10 || '.png' AS src, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '' ELSE 'Picture ' || page_id % 10 END AS alt,
  CAST(CASE WHEN page_id % 4 > 0 THEN page_id % 4 * 100 END AS DOUBLE) AS width FROM ep""")
def e04(spark, d):
    return parsed(spark, d).select("page_id", F.explode("doc.images").alias("i")).select("page_id", "i.src", "i.alt", "i.width")


@query("e05_links", f"""{WITH} SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN h[1:1] = '/' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%27', '''') ELSE h END AS target
FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM ep))""")
def e05(spark, d):
    return parsed(spark, d).select("page_id", F.posexplode("doc.links").alias("pos", "l")).select("page_id", "pos", F.col("l.url").alias("target"))


@query("e06_resources", f"""{WITH} SELECT page_id, kind, o || p AS target FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS o, unnest(['stylesheet', 'script', 'document']) AS kind, unnest(['/s.css', '/_next/app.js', '/doc/' || page_id % 6 || '.pdf']) AS p FROM ep)""")
def e06(spark, d):
    return parsed(spark, d).select("page_id", F.explode("doc.resources").alias("r")).select("page_id", "r.kind", F.col("r.url").alias("target"))


@query("e07_forms", f"""{WITH} SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/send' AS action, 'POST' AS method, '3 controls' AS text, 'mail: text · t: hidden · (unnamed): submit' AS detail FROM ep""")
def e07(spark, d):
    forms = tables.form_occurrences(parsed(spark, d).withColumn("url", F.col("page_id")))
    return forms.select(F.col("source").alias("page_id"), F.col("url").alias("action"), F.col("kind").alias("method"), "text", "detail")


@query("e11_jsonld", f"""{WITH} SELECT page_id, page_id % 5 = 0 AS valid, CASE WHEN page_id % 5 = 0 THEN 'Article,Person,Agent' ELSE '' END AS types FROM ep WHERE page_id % 5 < 2""")
def e11(spark, d):
    return structured_rows(parsed(spark, d), "page_id").select("page_id", "valid", F.array_join("types", ",").alias("types"))


@query("e14_hints", f"""{WITH} SELECT page_id, 'Next.js' AS name, CAST(CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS meta, 'de' AS alternate FROM ep""")
def e14(spark, d):
    p = parsed(spark, d)
    named = F.map_filter("doc.metadata", lambda k, v: k.isin("description", "keywords", "robots"))
    return p.select("page_id", F.col("doc.technologies")[0]["name"].alias("name"), F.size(named).alias("meta"), F.col("doc.hreflang")[0]["language"].alias("alternate"))


@query("e17_accessibility", f"""{WITH.replace(ENRICHED, ENRICHED_WHOLE)} SELECT page_id, CAST(1 AS INTEGER) AS h1_count, CAST(1 AS INTEGER) AS images, CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS images_missing_alt, CAST(1 AS INTEGER) AS controls, CAST(1 AS INTEGER) AS controls_without_name,
  CAST(len(regexp_extract_all(html, '<a href="')) AS INTEGER) AS links, CAST(1 AS INTEGER) AS buttons, CAST(0 AS INTEGER) AS buttons_without_name FROM ep""")
def e17(spark, d):
    return parsed(spark, d, ENRICHED_WHOLE).select("page_id", *[F.col(f"doc.accessibility.{c}").alias(c) for c in ("h1_count", "images", "images_missing_alt", "controls", "controls_without_name", "links", "buttons", "buttons_without_name")])


@query("e16_custom_fields", f"""{WITH} SELECT page_id, 'Paper' AS doc_link, 'mail|t' AS names, 'bad: invalid or unsupported CSS selector' AS errors FROM ep""")
def e16(spark, d):
    rules = [
        {"name": "doc_link", "selector": "a[rel=nofollow]", "mode": "text", "attribute": None}, {"name": "names", "selector": "form > input", "mode": "attribute", "attribute": "name"}, {"name": "bad", "selector": "a:hover", "mode": "text", "attribute": None},
    ]
    p = parse_pages(enriched(spark, d), rules)
    return p.select("page_id", F.array_join(F.col("doc.custom")["doc_link"], "|").alias("doc_link"), F.array_join(F.col("doc.custom")["names"], "|").alias("names"), F.array_join("doc.extraction_errors", "; ").alias("errors"))


# Links and graph


@query("d1_dataset_links", f"""{WITH}, known AS (SELECT dest, arg_max(status, seq) AS status FROM (SELECT url AS dest, CAST(status_code AS VARCHAR) AS status, capture_seq * 2 AS seq FROM cap
  UNION ALL SELECT requested_url, CASE WHEN requested_url <> url THEN 'Redirect' ELSE CAST(status_code AS VARCHAR) END, capture_seq * 2 + 1 FROM cap) GROUP BY dest),
fail AS (SELECT url AS dest, coalesce(CAST(arg_max(status_code, error_seq) FILTER (WHERE true) AS VARCHAR), '') AS s, max(error_seq) AS m FROM err GROUP BY url),
last AS (SELECT f.dest, coalesce(CAST(e.status_code AS VARCHAR), e.kind) AS s FROM fail f JOIN err e ON e.url = f.dest AND e.error_seq = f.m)
SELECT c.url AS Source, t.target AS Destination, CASE WHEN starts_with(t.target, 'https://site.example') THEN 'Internal' ELSE 'External' END AS Type, coalesce(k.status, l.s, 'Not crawled') AS Status
FROM tgt t JOIN cap c USING (capture_seq) LEFT JOIN known k ON k.dest = t.target LEFT JOIN last l ON l.dest = t.target""")
def d1(spark, d):
    p = captures(spark, d).withColumn("links", F.lit(None).cast("array<struct<url:string,text:string,rel:string,discovery:string,context:string>>"))
    return links.dataset_links(p, errors(spark, d)).select("Source", "Destination", "Type", "Status")


@query("g1_edges", f"{WITH} SELECT DISTINCT source, target FROM res")
def g1(spark, d):
    return graph.edges(captures(spark, d))


@query("a18_degrees", f"{WITH}, e AS (SELECT DISTINCT source, target FROM res) SELECT id, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT source AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY id")
def a18(spark, d):
    return graph.degrees(graph.edges(captures(spark, d)))


@query("g2_nodes", f"""{WITH}, e AS (SELECT DISTINCT source, target FROM res), deg AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY id),
every AS (SELECT url AS id, 'page' AS state, coalesce(depth, -1) AS depth, 0 AS rank, capture_seq AS seq FROM cap UNION ALL SELECT coalesce(a.identity, r.url), 'error', -1, 1, error_seq FROM err r LEFT JOIN alias a ON a.alias = r.url
  UNION ALL SELECT target, CASE WHEN starts_with(target, 'https://site.example') THEN 'discovered' ELSE 'external' END, -1, 2, 0 FROM e UNION ALL SELECT 'https://site.example/map/' || page_id, 'discovered', -1, 3, 0 FROM pages WHERE page_id % 25 = 0),
best AS (SELECT id, arg_min(state, rank * 10000000 + seq) AS state, arg_min(depth, rank * 10000000 + seq) AS depth FROM every GROUP BY id)
SELECT b.id, state, CAST(depth AS BIGINT) AS depth, CASE WHEN state = 'external' THEN 'external' ELSE coalesce(list_filter(string_split({PATH.format("b.id")}, '/'), lambda x: x <> '')[1], '(root)') END AS grp,
  CAST(coalesce(i, 0) AS BIGINT) AS inbound, CAST(coalesce(o, 0) AS BIGINT) AS outbound, starts_with(b.id, 'https://site.example/map/') AS sitemap_only FROM best b LEFT JOIN deg ON deg.id = b.id""")
def g2(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    p = captures(spark, d).checkpoint()
    listed = pages(spark, d).where("page_id % 25 = 0").select(F.concat(F.lit("https://site.example/map/"), F.col("page_id").cast("string")).alias("url"))
    n = graph.nodes(p, errors(spark, d), graph.edges(p).checkpoint(), listed, ROOT)
    return n.select("id", "state", "depth", F.col("group").alias("grp"), "inbound", "outbound", "sitemap_only")


@query("g3_hop_levels", f"""{WITH}, e AS (SELECT DISTINCT source, target FROM res), l0 AS (SELECT url AS id FROM cap WHERE page_id % 50 = 0), l1 AS (SELECT DISTINCT target AS id FROM e WHERE source IN (FROM l0) AND target NOT IN (FROM l0)),
l2 AS (SELECT DISTINCT target AS id FROM e WHERE source IN (FROM l1) AND target NOT IN (FROM l0) AND target NOT IN (FROM l1)) SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def g3(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    p = captures(spark, d)
    return graph.hop_levels(graph.edges(p), p.where("page_id % 50 = 0").select(F.col("url").alias("id")), 2)


@query("g3_chain_routes", """WITH n AS (SELECT page_id AS id, page_id // 101 AS b FROM pages), t AS (SELECT id, b FROM n WHERE id % 40 = 0)
SELECT CAST(t.id AS VARCHAR) AS target, CAST(n.id - 101 * n.b + 1 AS INTEGER) AS step, CAST(n.id AS VARCHAR) AS id FROM t JOIN n ON n.b = t.b AND n.id <= t.id
UNION ALL SELECT CAST(id AS VARCHAR), 0, 'root' FROM t""")
def g3_chain(spark, d):
    """Routes along chains of 101 pages that each begin at one root; every page also leads back to its chain's first."""
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    n = F.col("page_id")
    first, text = F.floor(n / 101) * 101, lambda c: c.cast("string")
    p = pages(spark, d).select("page_id")
    down = p.where(n % 101 > 0).select(text(n - 1).alias("source"), text(n).alias("target"))
    back = p.where(n % 101 > 1).select(text(n).alias("source"), text(first).alias("target"))
    start = p.where(n % 101 == 0).select(F.lit("root").alias("source"), text(n).alias("target"))
    tree = graph.route_tree(down.unionByName(back).unionByName(start), "root")
    return graph.routes(tree, p.where(n % 40 == 0).select(text(n).alias("id")))


@query("g3_route_tree", f"""{WITH.replace("WITH ep", "WITH RECURSIVE ep", 1)}, e AS (SELECT DISTINCT source, target FROM res UNION SELECT 'hub', url FROM cap WHERE page_id % 9 = 0),
hops AS (SELECT 'hub' AS id, 0 AS level UNION SELECT target, level + 1 FROM hops JOIN e ON e.source = hops.id WHERE level < 40), lev AS (SELECT id, min(level) AS level FROM hops GROUP BY id)
SELECT l.id AS id, min(e.source) AS parent, l.level AS level FROM lev l LEFT JOIN (SELECT e.source, e.target, p.level FROM e JOIN lev p ON p.id = e.source) e ON e.target = l.id AND e.level = l.level - 1 GROUP BY l.id, l.level""")
def g3_tree(spark, d):
    """The tree over the link graph, from a hub that links every ninth page."""
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    p = captures(spark, d)
    hub = p.where("page_id % 9 = 0").select(F.lit("hub").alias("source"), F.col("url").alias("target"))
    return graph.route_tree(graph.edges(p).select("source", "target").unionByName(hub), "hub")


#: Addresses in odd forms, and whether they are public.
ODD_ADDRESSES = [
    ("01.2.3.4", False), ("1.2.3", False), ("256.1.1.1", False), ("1.2.3.4.5", False), ("8.8.4.4", True), ("192.88.99.7", False), ("198.19.0.1", False), ("203.0.113.9", False), ("223.255.255.255", True),
    ("2606:1:2:3:4:5:6:7:8:9", False), ("2606::1::2", False), ("2606:::::", False), ("2606::", True), ("2606:4700::8.8.8.8", True), ("2606:4700::8.8.8", False), ("::ffff:8.8.8.8", False), ("::", False),
    ("2001:1ff::1", False), ("2001:200::1", True), ("2001:DB8:1::", False), ("2001:db9::", True), ("3ffe::1", True), ("3fff:1::", False), ("2002::1", False), ("4000::1", False), ("1:2:3:4:5:6:7:8", False), ("2a00:0:0:0:0:0:0:1", True),
]


@query("f20_odd_addresses", f"SELECT page_id, address, public FROM (SELECT page_id, page_id % {len(ODD_ADDRESSES)} AS i FROM pages) JOIN (VALUES {', '.join(f'({i}, {a!r}, {str(ok).lower()})' for i, (a, ok) in enumerate(ODD_ADDRESSES))}) v(i, address, public) USING (i)")
def f20_odd(spark, d):
    address = F.element_at(F.array(*(F.lit(a) for a, _ in ODD_ADDRESSES)), (F.col("page_id") % len(ODD_ADDRESSES) + 1).cast("int"))
    return pages(spark, d).select("page_id", address.alias("address")).withColumn("public", http.is_public_ip(F.col("address")))


@query("f34_long_numbers", """WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'page ' || repeat('9', CAST(page_id % 37 + 1 AS INTEGER)) WHEN 1 THEN 'Page ' || page_id WHEN 2 THEN 'page 0' || page_id WHEN 3 THEN 'pâge ' || page_id ELSE 'pager' END AS title FROM pages)
SELECT page_id, title, row_number() OVER (ORDER BY CASE page_id % 5 WHEN 4 THEN 2 ELSE 1 END, CASE WHEN page_id % 5 = 0 THEN page_id % 37 + 1 WHEN page_id % 5 < 4 THEN length(CAST(page_id AS VARCHAR)) END,
  CASE page_id % 5 WHEN 0 THEN repeat('9', CAST(page_id % 37 + 1 AS INTEGER)) WHEN 4 THEN '' ELSE CAST(page_id AS VARCHAR) END, page_id) AS place FROM t""")
def f34_order(spark, d):
    """Titles with long numbers, leading zeros, accents and capitals in natural order: by one global numbering, not one window."""
    from sitegrain.functions.text import natural_key

    i = F.col("page_id")
    number = i.cast("string")
    title = F.when(i % 5 == 0, F.concat(F.lit("page "), F.expr("repeat('9', cast(page_id % 37 + 1 as int))"))).when(i % 5 == 1, F.concat(F.lit("Page "), number)).when(i % 5 == 2, F.concat(F.lit("page 0"), number)).when(i % 5 == 3, F.concat(F.lit("pâge "), number)).otherwise(F.lit("pager"))
    rows = pages(spark, d).select("page_id", title.alias("title")).withColumn("key", natural_key(F.col("title")))
    return windows.number_rows(rows, ["key", "page_id"], "place").select("page_id", "title", (F.col("place") + 1).alias("place"))


@query("a13_path_groups", f"{WITH} SELECT coalesce(list_filter(string_split({P}, '/'), lambda x: x <> '')[1], '(root)') AS name, count(*) AS count FROM pages GROUP BY 1")
def a13(spark, d):
    return graph.path_groups(pages(spark, d))


@query("a20_path_tree", f"""SELECT path, count(*) AS count FROM (SELECT unnest(list_concat(['/'], list_transform(range(1, len(s) + 1), lambda i: '/' || array_to_string(s[1:i], '/')))) AS path FROM (SELECT list_filter(string_split({P}, '/'), lambda x: x <> '') AS s FROM pages)) GROUP BY path""")
def a20(spark, d):
    return graph.path_tree(pages(spark, d).select(F.col("url").alias("id"), F.lit("page").alias("state")))


@query("a09_incoming", f"{WITH} SELECT target AS identity, count(DISTINCT capture_seq) AS incoming FROM res WHERE starts_with(target, 'https://site.example') GROUP BY target")
def a09(spark, d):
    return links.incoming(captures(spark, d))


FAILED = """fail AS (SELECT url AS identity, arg_max(status_code, error_seq) AS status FROM err WHERE status_code BETWEEN 400 AND 599 AND url NOT IN (SELECT alias FROM alias) GROUP BY url)"""


@query("j13_final_failures", f"{WITH}, {FAILED} SELECT identity, status AS status_code FROM fail")
def j13(spark, d):
    return links.final_failures(errors(spark, d), captures(spark, d))


@query("w12_sample_failures", f"""{WITH}, {FAILED}, hit AS (SELECT capture_seq, target, min(pos) AS pos FROM res WHERE starts_with(target, 'https://site.example') GROUP BY 1, 2)
SELECT h.capture_seq, count(*) AS failures, string_agg('HTTP ' || status || ': ' || target, ' · ' ORDER BY pos) AS sample FROM hit h JOIN fail f ON f.identity = h.target GROUP BY h.capture_seq""")
def w12(spark, d):
    return links.sample_failures(captures(spark, d), errors(spark, d)).select("capture_seq", "failures", "sample")


# Findings

RULE_SQL = f"""{WITH}, {FAILED}, hit AS (SELECT capture_seq, count(DISTINCT target) AS n FROM res JOIN fail ON identity = target WHERE starts_with(target, 'https://site.example') GROUP BY 1),
t AS (SELECT capture_seq, trim(title) AS k FROM cap WHERE trim(title) <> ''), f AS (
SELECT capture_seq, 'Missing title' AS title FROM cap WHERE title IS NOT NULL AND trim(title) = '' UNION ALL SELECT capture_seq, 'Missing description' FROM cap WHERE description = ''
UNION ALL SELECT capture_seq, 'Accessibility sample capped' FROM cap WHERE page_id % 6 <> 5 AND page_id % 10 = 0 UNION ALL SELECT capture_seq, 'Missing document language' FROM cap WHERE page_id % 6 <> 5 AND page_id % 14 = 0
UNION ALL SELECT capture_seq, 'No main heading' FROM cap WHERE page_id % 6 <> 5 AND page_id % 10 <> 0 AND page_id % 3 = 0 UNION ALL SELECT capture_seq, 'Multiple main headings' FROM cap WHERE page_id % 6 <> 5 AND page_id % 3 = 2
UNION ALL SELECT capture_seq, 'Images missing alt' FROM cap WHERE page_id % 6 <> 5 AND least(page_id % 8, page_id % 4) > 0 UNION ALL SELECT capture_seq, 'Controls needing names' FROM cap WHERE page_id % 6 <> 5 AND page_id % 5 > 3
UNION ALL SELECT capture_seq, 'Links needing names' FROM cap WHERE page_id % 6 <> 5 AND page_id % 2 = 1 UNION ALL SELECT capture_seq, 'Buttons needing names' FROM cap WHERE page_id % 6 <> 5 AND page_id % 9 = 0
UNION ALL SELECT capture_seq, 'Noindex declared' FROM cap WHERE page_id % 7 = 0 OR page_id % 37 = 0 UNION ALL SELECT capture_seq, 'Canonical points elsewhere' FROM cap WHERE page_id % 4 = 0
UNION ALL SELECT capture_seq, 'Rendering incomplete' FROM cap WHERE page_id % 41 = 0 UNION ALL SELECT capture_seq, 'Failed internal destinations' FROM hit
UNION ALL SELECT capture_seq, 'Repeated title' FROM t WHERE k IN (SELECT k FROM t GROUP BY k HAVING count(*) > 1)
UNION ALL SELECT capture_seq, 'Matching body text' FROM cap WHERE (page_id - page_id % 2) IN (SELECT page_id - page_id % 2 FROM pages GROUP BY 1 HAVING count(*) > 1))"""


@query("r_findings", RULE_SQL + " SELECT capture_seq, title FROM f")
def r_findings(spark, d):
    return fi.findings(captures(spark, d), errors(spark, d)).select("capture_seq", "title")


@query("a10_finding_counts", RULE_SQL + " SELECT title, count(*) AS n, count(DISTINCT capture_seq) AS pages FROM f GROUP BY title")
def a10(spark, d):
    return fi.findings(captures(spark, d), errors(spark, d)).groupBy("title").agg(F.count("*").alias("n"), F.count_distinct("capture_seq").alias("pages"))


@query("r15_repeated_title", f"""{WITH}, t AS (SELECT capture_seq, url, trim(title) AS k FROM cap WHERE trim(title) <> ''), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS size, first_value(url) OVER w AS one, nth_value(url, 2) OVER w AS two, row_number() OVER (PARTITION BY k ORDER BY capture_seq) AS i
  FROM t WINDOW w AS (PARTITION BY k ORDER BY capture_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT capture_seq, size, CASE WHEN i = 1 THEN two ELSE one END AS related FROM n WHERE size > 1""")
def r15(spark, d):
    return fi.repeated_titles(captures(spark, d)).select("capture_seq", "size", "related")


@query("a03_coverage", f"""{WITH}, a AS (SELECT * FROM cap WHERE page_id % 6 <> 5), w AS (SELECT * FROM a WHERE page_id % 10 <> 0), c AS (
SELECT 'Title' AS label, count(*) FILTER (WHERE trim(title) <> '') AS present, count(title) AS eligible FROM cap UNION ALL SELECT 'Description', count(*) FILTER (WHERE trim(description) <> ''), count(description) FROM cap
UNION ALL SELECT 'Main heading', count(*) FILTER (WHERE page_id % 3 > 0), count(*) FROM w UNION ALL SELECT 'Language', count(*) FILTER (WHERE page_id % 14 <> 0), count(*) FROM a
UNION ALL SELECT 'Image alt', sum(page_id % 8 - least(page_id % 8, page_id % 4)), sum(page_id % 8) FROM w UNION ALL SELECT 'Control names', sum(page_id % 5 - CASE WHEN page_id % 5 > 3 THEN 2 ELSE 0 END), sum(page_id % 5) FROM w)
SELECT label, CAST(present AS BIGINT) AS present, CAST(eligible AS BIGINT) AS eligible, CAST(floor(present / eligible * 100 + 0.5) AS BIGINT) AS percent FROM c""")
def a03(spark, d):
    return fi.coverage(captures(spark, d)).select("label", "present", "eligible", "percent")


@query("a04_outcomes", f"""{WITH}, s AS (SELECT url, arg_max(coalesce(status_code, 0), capture_seq) AS s FROM cap GROUP BY url UNION ALL SELECT url, arg_max(coalesce(status_code, 0), error_seq) FROM err WHERE url NOT IN (SELECT alias FROM alias) GROUP BY url),
l AS (SELECT CASE WHEN s = 0 THEN 'No HTTP status' WHEN s BETWEEN 200 AND 599 THEN s // 100 || 'xx' ELSE 'Other status' END AS label FROM s)
SELECT v.label, (SELECT count(*) FROM l WHERE l.label = v.label) AS count FROM (VALUES ('2xx'), ('3xx'), ('4xx'), ('5xx'), ('No HTTP status'), ('Other status')) v(label)""")
def a04(spark, d):
    return fi.outcomes(captures(spark, d), errors(spark, d)).select("label", "count")


@query("a05_timing_histogram", f"""{WITH}, l AS (SELECT CASE WHEN duration_ms IS NULL THEN 'Unknown' WHEN duration_ms < 250 THEN 'Under 250 ms' WHEN duration_ms < 1000 THEN '250–999 ms' WHEN duration_ms < 3000 THEN '1–2.99 s' ELSE '3 s or more' END AS label FROM cap)
SELECT v.label, (SELECT count(*) FROM l WHERE l.label = v.label) AS count FROM (VALUES ('Under 250 ms'), ('250–999 ms'), ('1–2.99 s'), ('3 s or more'), ('Unknown')) v(label)""")
def a05(spark, d):
    return fi.timing_histogram(captures(spark, d)).select("label", "count")


@query("a06_depth_buckets", RULE_SQL + " SELECT CAST(coalesce(c.depth, -1) AS BIGINT) AS depth, count(*) FILTER (WHERE c.capture_seq NOT IN (SELECT capture_seq FROM f)) AS clear, count(*) FILTER (WHERE c.capture_seq IN (SELECT capture_seq FROM f)) AS review FROM cap c GROUP BY 1")
def a06(spark, d):
    p = captures(spark, d)
    return fi.depth_buckets(p, fi.findings(p, errors(spark, d))).select("depth", "clear", "review")


@query("a11_nearest_rank", f"{WITH} SELECT CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS median, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95, count(duration_ms) AS measured FROM cap")
def a11(spark, d):
    return captures(spark, d).agg(windows.nearest_rank("duration_ms", 0.5).cast("long").alias("median"), windows.nearest_rank("duration_ms", 0.95).cast("long").alias("p95"), F.count("duration_ms").alias("measured"))


@query("a12_insights", f"{WITH} SELECT name, count(*) AS count FROM (SELECT CAST(status_code AS VARCHAR) AS name FROM cap UNION ALL SELECT coalesce(CAST(status_code AS VARCHAR), 'Network / other') FROM err) GROUP BY name")
def a12(spark, d):
    return tables.insights(captures(spark, d), errors(spark, d))


@query("a21_issue_groups", f"""{WITH}, i AS (SELECT 'HTTP / Network' AS g FROM err UNION ALL SELECT 'JavaScript' FROM cap WHERE page_id % 41 = 0 UNION ALL SELECT 'Resources' FROM cap WHERE page_id % 20 = 0 UNION ALL SELECT 'Structured data' FROM cap WHERE page_id % 5 = 1
UNION ALL SELECT 'Indexability' FROM cap WHERE page_id % 7 = 0 OR page_id % 37 = 0 UNION ALL SELECT 'Metadata' FROM cap WHERE coalesce(trim(title), '') = '' UNION ALL SELECT 'Content' FROM cap WHERE heading = '' UNION ALL SELECT 'Metadata' FROM cap WHERE coalesce(trim(description), '') = ''
UNION ALL SELECT 'Metadata' FROM cap WHERE trim(title) <> '' AND trim(title) IN (SELECT trim(title) FROM cap WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1)) SELECT g AS "group", count(*) AS count FROM i GROUP BY g""")
def a21(spark, d):
    return fi.issue_groups(fi.issues(captures(spark, d), errors(spark, d)))


@query("a08_duplicate_text", "SELECT fp AS content_fingerprint, count(*) AS size FROM (SELECT 'sha256-text-v1:' || sha256(text) AS fp FROM documents WHERE length(text) BETWEEN 1 AND 2097151) GROUP BY fp HAVING count(*) > 1")
def a08(spark, d):
    docs = table(spark, d, "documents").select(text.content_fingerprint(F.col("text")).alias("content_fingerprint")).where("content_fingerprint is not null")
    return docs.groupBy("content_fingerprint").agg(F.count("*").alias("size")).where("size > 1")


# Catalogues, tables, windows


@query("a14_image_catalogue", f"""{WITH}, i AS (SELECT page_id, url AS page, 'https://cdn.example/i/' || page_id % 10 || '.png' AS url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '' ELSE 'Picture ' || page_id % 4 END AS alt FROM pages)
SELECT url, CAST(count(DISTINCT page) AS INTEGER) AS sources, count(*) FILTER (WHERE alt IS NULL) AS missing, count(*) FILTER (WHERE alt = '') AS decorative, CAST(count(DISTINCT alt) FILTER (WHERE alt <> '') AS INTEGER) AS alts, 'png' AS extension FROM i GROUP BY url""")
def a14(spark, d):
    n = F.col("page_id")
    rows = pages(spark, d).select(
        n.alias("capture_seq"), "url", F.lit(0).alias("pos"), F.concat(F.lit("https://cdn.example/i/"), (n % 10).cast("string"), F.lit(".png")).alias("candidate"),
        F.when(n % 3 == 1, "").when(n % 3 == 2, F.concat(F.lit("Picture "), (n % 4).cast("string"))).alias("alt"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"),
    )
    out = tables.image_catalogue(rows, rows.select("capture_seq", "url", F.col("candidate").alias("image")))
    return out.select("url", F.size("sources").alias("sources"), "missing", "decorative", F.size("alts").alias("alts"), "extension")


@query("a15_link_catalogue", f"""{WITH} SELECT target AS url, CASE WHEN starts_with(target, 'https://site.example') THEN 'internal' ELSE 'external' END AS kind, CAST(count(DISTINCT capture_seq) AS INTEGER) AS sources, 'link ' || min(pos) AS first_text FROM tgt GROUP BY target""")
def a15(spark, d):
    rows = links.link_rows(captures(spark, d).withColumn("links", F.lit(None).cast("array<struct<url:string,text:string,rel:string,discovery:string,context:string>>")))
    rows = rows.withColumn("text", F.concat(F.lit("link "), F.col("pos").cast("string")))
    out = tables.link_catalogue(rows, ROOT)
    return out.select("url", "kind", F.size("sources").alias("sources"), F.array_min(F.split("text", " · ")).alias("first_text"))


@query("d5_sitemaps", f"""{WITH}, m AS (SELECT DISTINCT u FROM (SELECT url AS u FROM cap WHERE page_id % 2 = 0 UNION ALL SELECT 'https://site.example/missing/' || page_id % 34 FROM pages UNION ALL SELECT 'https://site.example/only/' || page_id FROM pages WHERE page_id % 30 = 0)),
last AS (SELECT url, 'Error ' || coalesce(CAST(arg_max(coalesce(status_code, -1), error_seq) AS VARCHAR), '') AS s FROM err GROUP BY url), fix AS (SELECT l.url, CASE WHEN l.s = 'Error -1' THEN 'Error network' ELSE l.s END AS s FROM last l)
SELECT m.u AS "URL", coalesce(CASE WHEN c.url IS NULL THEN NULL WHEN c.requested_url <> c.url THEN 'Redirected' ELSE 'Crawled' END, f.s, 'Not crawled') AS Status, CASE WHEN m.u IN (SELECT target FROM tgt) THEN 'Linked internally' ELSE 'No captured inlink' END AS "Internal discovery" FROM m LEFT JOIN cap c ON c.url = m.u LEFT JOIN fix f ON f.url = m.u
UNION ALL SELECT url, 'Absent from discovered sitemaps', CASE WHEN url IN (SELECT target FROM tgt) THEN 'Linked internally' ELSE 'Start/redirect URL' END FROM cap WHERE page_id % 2 = 1""")
def d5(spark, d):
    p = captures(spark, d)
    n = F.col("page_id").cast("string")
    own = p.where("page_id % 2 = 0").select("url")
    far = pages(spark, d).select(F.concat(F.lit("https://site.example/missing/"), (F.col("page_id") % 34).cast("string")).alias("url")).union(pages(spark, d).where("page_id % 30 = 0").select(F.concat(F.lit("https://site.example/only/"), n).alias("url")))
    listed = own.union(far).distinct().select("url", F.lit("https://site.example/sitemap.xml").alias("sitemap"), *[F.lit("").alias(c) for c in ("lastmod", "changefreq", "priority")])
    return sitemaps.dataset_sitemaps(p, errors(spark, d), listed, ROOT).select("URL", "Status", "Internal discovery")


@query("e22_sitemap_entries", f"""SELECT 'https://site.example/m' || page_id || '.xml' AS sitemap, 'urlset' AS kind, 'https://site.example/g' || page_id || '?a=1&b=2' AS url, '2024-01-0' || page_id % 9 + 1 AS lastmod FROM pages WHERE page_id % 4 <> 3
UNION ALL SELECT 'https://site.example/m' || page_id || '.xml', 'index', 'https://site.example/m' || page_id + 1 || '.xml', '' FROM pages WHERE page_id % 4 = 3""")
def e22(spark, d):
    n = F.col("page_id").cast("string")
    urlset = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://site.example/g'), n, F.lit("?a=1&amp;b=2 </loc><lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod></url><url><loc>https://else.example/</loc></url></urlset>"))
    index = F.concat(F.lit('<sitemapindex><sitemap><loc>https://site.example/m'), (F.col("page_id") + 1).cast("string"), F.lit(".xml</loc></sitemap></sitemapindex>"))
    store = pages(spark, d).select(F.concat(F.lit("https://site.example/m"), n, F.lit(".xml")).alias("sitemap_url"), F.when(F.col("page_id") % 4 == 3, index).otherwise(urlset).alias("text"))
    return sitemaps.sitemap_entries(store).select("sitemap", "kind", "url", "lastmod")


ROBOTS = "User-agent: *\nDisallow: /en\nAllow: /en/1*5$\n\nUser-agent: site\nUser-agent: other\nDisallow: /*utm_source=\nDisallow: /fr\nAllow: /fr/8\nCrawl-delay: 2\nSitemap: /map.xml"


@query("j1_robots_allowed", f"""SELECT page_id, CASE WHEN starts_with(p, '/fr/8') AND NOT regexp_matches(q, 'utm_source=') THEN true WHEN regexp_matches(q, 'utm_source=') THEN false WHEN starts_with(p, '/fr') THEN false ELSE true END AS allowed
FROM (SELECT page_id, {P} AS p, {P} || regexp_extract(url, '(\\?[^#]*)', 1) AS q FROM pages)""")
def j1(spark, d):
    p = pages(spark, d)
    texts = p.select(urls.url_origin(F.col("url")).alias("origin")).distinct().withColumn("text", F.lit(ROBOTS))
    return robots.robots_allowed(p.select("page_id", "url"), robots.robots_rules(texts), "SiteBot/2.0 test").select("page_id", "allowed")


@query("e21_robots_rules", f"""SELECT origin, CAST(grp AS BIGINT) AS grp, agent, allow, pattern, CAST(length AS INTEGER) AS length, CAST(delay AS BIGINT) AS delay_ms FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages),
(VALUES (1, '*', false, '/en', 3, 0), (1, '*', true, '/en/1*5', 6, 0), (2, 'site', false, '/*utm_source=', 12, 2000), (2, 'site', false, '/fr', 3, 2000), (2, 'site', true, '/fr/8', 5, 2000), (2, 'other', false, '/*utm_source=', 12, 2000), (2, 'other', false, '/fr', 3, 2000), (2, 'other', true, '/fr/8', 5, 2000)) v(grp, agent, allow, pattern, length, delay)""")
def e21(spark, d):
    texts = pages(spark, d).select(urls.url_origin(F.col("url")).alias("origin")).distinct().withColumn("text", F.lit(ROBOTS))
    return robots.robots_rules(texts).select("origin", "grp", "agent", "allow", "pattern", "length", "delay_ms")


@query("w1_distinct_in_order", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def w1(spark, d):
    return windows.distinct_in_order(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id").withColumnRenamed("event_id", "first_id")


@query("w4_cap_per_page", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def w4(spark, d):
    return windows.cap_per_page(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("w6_running_budget", "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 100")
def w6(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return windows.running_budget(rows, "size", 100, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("w7_last_per_key", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w7(spark, d):
    return windows.last_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("w8_number_rows", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ord FROM documents")
def w8(spark, d):
    return windows.number_rows(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "ord")


@query("w11_neighbours", f"{WITH} SELECT url, lag(url) OVER w AS previous, lead(url) OVER w AS next, row_number() OVER w AS position, count(*) OVER () AS total FROM cap WINDOW w AS (ORDER BY url)")
def w11(spark, d):
    return graph.neighbours_in_order(captures(spark, d), ["url"])


@query("o2_set_delta", "SELECT user_id, CAST(len(list_distinct(list_filter(list(event_type), lambda x: x <> 'click'))) AS INTEGER) AS n FROM events GROUP BY user_id")
def o2(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).withColumn("b", F.array(F.lit("click")))
    return rows.select("user_id", F.size(tables.set_delta("a", "b")).alias("n"))


LINE_SIDES = f"""{WITH}, b AS (SELECT page_id AS id, unnest(list_slice(regexp_split_to_array(regexp_replace(substr(html, 1, 120000), '>\\s*<', '>' || chr(10) || '<', 'g'), '\r?\n'), 1, 300)) AS line FROM pages),
a AS (SELECT page_id AS id, unnest(list_slice(regexp_split_to_array(regexp_replace(substr(html, 1, 120000), '>\\s*<', '>' || chr(10) || '<', 'g'), '\r?\n'), 1, 300)) AS line FROM ep),
c AS (SELECT id, substr(line, 1, 1200) AS line, count(*) FILTER (WHERE k = 'b') AS nb, count(*) FILTER (WHERE k = 'a') AS na FROM (SELECT *, 'b' AS k FROM b UNION ALL SELECT *, 'a' FROM a) GROUP BY 1, 2)
SELECT id, CAST(sum(least(na, nb)) AS BIGINT) AS same, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS added, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS removed FROM c GROUP BY id"""


@query("o7_source_line_diff", LINE_SIDES)
@query("o7_source_line_diff_sides", LINE_SIDES)
@query("o7_source_line_sides", LINE_SIDES)
def o7(spark, d):
    pairs = pages(spark, d).select(F.col("page_id").alias("id"), F.col("html").alias("before")).join(enriched(spark, d).select(F.col("page_id").alias("id"), F.col("html").alias("after")).hint("merge"), "id")
    return tables.source_line_diff(pairs).groupBy("id").agg(*[F.sum(c).cast("long").alias(c) for c in ("same", "added", "removed")])


@query("j7_compare_rendering", f"{WITH} SELECT url, CAST(10 AS BIGINT) AS word_delta, CASE WHEN page_id * 7 % 500 + 10 > 0 THEN CAST(floor(10 / (page_id * 7 % 500 + 10) * 100 + 0.5) AS BIGINT) END AS added_text_percent, CAST(1 AS INTEGER) AS added, CAST(1 AS INTEGER) AS removed, CAST(CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS changes FROM cap")
def j7(spark, d):
    p = captures(spark, d)
    facts = p.select("page_id", "url", F.col("word_count").alias("words"), F.col("outgoing_links").alias("links"), F.array().cast("array<string>").alias("images"), "title", "description", F.col("canonical_url").alias("canonical"), F.col("heading").alias("h1"), "robots")
    new = facts.withColumn("words", F.col("words") + 10).withColumn("links", F.concat(F.slice("links", 2, 10), F.array(F.lit("https://site.example/new"))))
    new = new.withColumn("title", F.when(F.col("page_id") % 10 == 0, "changed title").otherwise(F.col("title")))
    out = tables.compare_rendering(facts.drop("page_id"), new.drop("page_id"))
    return out.select("url", "word_delta", "added_text_percent", F.size("added_links").alias("added"), F.size("removed_links").alias("removed"), F.size("metadata_changes").alias("changes"))


@query("j16_diff_runs", f"{WITH} SELECT url, CASE WHEN page_id % 10 = 3 THEN 'removed' ELSE 'changed' END AS change FROM cap WHERE page_id % 10 IN (3, 4)")
def j16(spark, d):
    p = captures(spark, d).select("page_id", "url", "title", "heading", "duration_ms")
    after = p.where("page_id % 10 != 3").withColumn("heading", F.when(F.col("page_id") % 10 == 4, "Other").otherwise(F.col("heading"))).withColumn("duration_ms", F.lit(1))
    return tables.diff_runs(p, after)


@query("p3_filter_dataset", f"{WITH} SELECT c.url AS Source, t.target AS Destination FROM tgt t JOIN cap c USING (capture_seq) WHERE NOT starts_with(t.target, 'https://site.example') AND (contains(lower(c.url), '/p1') OR contains(t.target, '/p1'))")
def p3(spark, d):
    p = captures(spark, d).withColumn("links", F.lit(None).cast("array<struct<url:string,text:string,rel:string,discovery:string,context:string>>"))
    ds = links.dataset_links(p, errors(spark, d))
    return tables.filter_dataset(ds.select("Source", "Destination", "Type"), "/P1 ", {"Type": "External", "Source": ""}).select("Source", "Destination")


@query("p11_page_inventory", f"{WITH} SELECT url, CASE WHEN coalesce(title, '') = '' THEN heading ELSE title END AS title, status_code AS status, page_id * 7 % 500 AS words, depth, CAST(5 AS INTEGER) AS internal, CAST(1 AS INTEGER) AS external, duration_ms AS duration FROM cap")
def p11(spark, d):
    p = captures(spark, d).withColumn("method", F.lit("http")).withColumn("discovery", F.lit("link"))
    return tables.page_inventory(p).select("url", "title", "status", "words", "depth", "internal", "external", "duration")


@query("l1_sort_pages", f"{WITH} SELECT url, CAST(duration_ms AS BIGINT) AS duration FROM cap ORDER BY duration_ms DESC NULLS LAST, url LIMIT 50")
def l1(spark, d):
    p = captures(spark, d).withColumn("method", F.lit("http")).withColumn("discovery", F.lit("link"))
    return tables.sort_pages(tables.page_inventory(p), "duration", desc=True).select("url", "duration").limit(50)


@query("g6_resolve_redirects", """SELECT 'https://site.example/r' || page_id AS requested_url, 'https://site.example/' || CASE WHEN page_id % 9 < 6 THEN 'end' ELSE 'r' || (page_id - page_id % 9 + CASE WHEN page_id % 9 = 6 THEN 6 WHEN page_id % 9 = 7 THEN 8 ELSE 7 END) END || CASE WHEN page_id % 9 < 6 THEN CAST(page_id - page_id % 9 AS VARCHAR) ELSE '' END AS url,
  CAST(CASE WHEN page_id % 9 < 6 THEN page_id % 9 WHEN page_id % 9 = 6 THEN 0 ELSE 1 END AS INTEGER) AS hops, CASE WHEN page_id % 9 < 6 THEN NULL WHEN page_id % 9 = 6 THEN 'missing-location' ELSE 'loop' END AS error FROM pages WHERE page_id % 9 > 0 AND page_id - page_id % 9 + 8 <= (SELECT max(page_id) FROM pages)""")
def g6(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    n, k = F.col("page_id"), F.col("page_id") % 9
    base = (n - k).cast("string")
    to = F.when(k == 1, F.concat(F.lit("https://site.example/end"), base)).when(k < 6, F.concat(F.lit("https://site.example/r"), (n - 1).cast("string"))).when(k == 6, F.lit(None)).when(k == 7, F.concat(F.lit("https://site.example/r"), (n + 1).cast("string"))).otherwise(F.concat(F.lit("https://site.example/r"), (n - 1).cast("string")))
    p = pages(spark, d)
    top = p.agg(F.max("page_id").alias("top"))
    rows = p.crossJoin(F.broadcast(top)).where("page_id % 9 > 0 and page_id - page_id % 9 + 8 <= top").select(F.concat(F.lit("https://site.example/r"), n.cast("string")).alias("url"), F.lit(301).alias("status"), to.alias("location"))
    return frontier.resolve_redirects(rows)


@query("t4_latest_outcome", "SELECT user_id AS key, bool_or(event_type = 'purchase') AS ok, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), max(event_id)) AS seq FROM events GROUP BY user_id")
def t4(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return latest_outcome(rows).select("key", "ok", "seq")


@query("t3_telemetry", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t3(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def arriving(spark: SparkSession, rows: DataFrame, part: Column, parts: int, files: int = 1) -> DataFrame:
    """A stream of ``rows`` that arrive in ``parts`` pieces, one after another, ``files`` of them a batch."""
    from sitegrain.cluster import new_folder

    at = new_folder(spark, "arriving")
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_stream_extract", f"""SELECT page_id, url, {CLEAN.format(UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title, CAST(len(list_distinct(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))) AS INTEGER) AS links FROM pages""")
def t1_stream(spark, d):
    """Pages parsed as they arrive in three pieces."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    rows = streams.stream_extract(arriving(spark, pages(spark, d), F.col("page_id") % 3, 3)).select("page_id", "url", F.col("doc.title").alias("title"), F.size("doc.plain_links").alias("links"))
    return streams.run_to_table(rows, new_folder(spark, "t1"))


@query("t2_stream_dedup", "SELECT DISTINCT user_id * 10 + event_id % 7 AS key FROM events")
def t2_stream(spark, d):
    """The first row of each key, in pieces of which each repeats keys of the ones before; the last piece's rows are the oldest."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    rows = clicks(spark, d).select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("key"), "ts")
    stream = arriving(spark, rows, F.lit(3) - F.floor((F.dayofmonth("ts") - 1) / 8), 4)
    return streams.run_to_table(streams.stream_dedup(stream, "key", "ts", "60 days"), new_folder(spark, "t2")).select("key")


@query("t3_stream_telemetry", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t3_stream(spark, d):
    """Hourly counts and sums of rows that arrive in four pieces, the oldest last and all counted."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    stream = arriving(spark, clicks(spark, d).select("ts", "event_type", "value"), F.lit(3) - F.floor((F.dayofmonth("ts") - 1) / 8), 4)
    out = streams.run_to_table(streams.stream_telemetry(stream, "ts", "event_type", "1 hour", "60 days"), new_folder(spark, "t3"), "complete")
    return out.withColumn("total", F.round("total", 4))


@query("t4_stream_latest_outcome", "SELECT user_id AS key, bool_or(event_type = 'purchase') AS ok, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 1000000000 + event_id) AS seq, arg_max(event_type, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 1000000000 + event_id) AS status FROM events GROUP BY user_id")
def t4_stream(spark, d):
    """Latest outcomes by keyed state, over rows that arrive in four pieces, the newest first."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    n = F.col("event_id")
    rows = clicks(spark, d).select(F.col("user_id").alias("key"), n.alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("status"), "ts")
    stream = arriving(spark, rows, F.lit(3) - F.col("seq") % 4, 4)
    return streams.latest_outcome(streams.run_to_table(streams.stream_latest_outcome(stream, "ts", "60 days"), new_folder(spark, "t4"), "update"))


@query("t7_stream_budget", """WITH o AS (SELECT user_id % 20 AS run, event_id, sum(CAST(1 + event_id % 50 AS BIGINT)) OVER (PARTITION BY user_id % 20 ORDER BY event_id % 4, ts, event_id) AS used FROM events)
SELECT CAST(run AS INTEGER) AS run, event_id FROM o WHERE used <= 5000""")
def t7_stream(spark, d):
    """Rows of each run within its budget: four pieces in the order of their arrival, and in each by time."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    n = F.col("event_id")
    rows = clicks(spark, d).select((F.col("user_id") % 20).cast("int").alias("run"), (1 + n % 50).cast("long").alias("size"), "ts", "event_id")
    stream = streams.stream_budget(arriving(spark, rows, n % 4, 4), 5000, ["ts", "event_id"], "ts", "60 days")
    return streams.run_to_table(stream, new_folder(spark, "t7")).select("run", "event_id")


@query("t5_stream_run_store", "SELECT user_id, arg_max(n, part) AS n, max(part) AS part FROM (SELECT user_id, event_id % 4 AS part, count(*) AS n FROM events WHERE (user_id + event_id % 4) % 3 > 0 GROUP BY 1, 2) GROUP BY user_id")
def t5_stream(spark, d):
    """The newest row of each key in a store that a stream appends to, batch by batch."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    part = (F.col("event_id") % 4).alias("part")
    rows = clicks(spark, d).where((F.col("user_id") + F.col("event_id") % 4) % 3 > 0).groupBy("user_id", part).agg(F.count("*").alias("n"))
    at = new_folder(spark, "t5")
    streams.write_run_stream(arriving(spark, rows, F.col("part"), 4), f"{at}/rows", f"{at}/checkpoint", ["user_id"]).awaitTermination()
    return streams.read_run_store(spark, f"{at}/rows", ["user_id"]).select("user_id", "n", "part")


@query("t6_monitor", """WITH w AS (SELECT r.r AS run, user_id % 40 AS name, CASE WHEN user_id % 40 % 3 = 0 THEN r.r ELSE r.r // 2 END AS digest, user_id % 40 % 10 = 0 AND r.r = 2 AS bad, user_id % 40 < 30 OR r.r > 0 AS there
  FROM (SELECT DISTINCT user_id FROM events), range(0, 3) r(r)), d AS (SELECT DISTINCT run, name, digest, bad FROM w WHERE there), c AS (SELECT *, lag(digest) OVER (PARTITION BY name ORDER BY run) AS was FROM d)
SELECT CAST(run AS INTEGER) AS run, CAST(name AS VARCHAR) AS name, was IS NULL OR was <> digest AS changed, bad AS unhealthy FROM c WHERE was IS NULL OR was <> digest OR bad""")
def t6(spark, d):
    """What three calls of the monitor report: new sites, changed digests, failures."""
    from sitegrain.cluster import new_folder
    from sitegrain.streaming import streams

    at, out = new_folder(spark, "t6"), None
    names = table(spark, d, "events").select((F.col("user_id") % 40).alias("name")).distinct()
    for run in range(3):
        digest = F.when(F.col("name") % 3 == 0, run).otherwise(run // 2).cast("string").alias("digest")
        bad = F.when((F.col("name") % 10 == 0) & F.lit(run == 2), 1).otherwise(0).cast("long").alias("failures")
        given = names.where((F.col("name") < 30) | F.lit(run > 0)).select(F.col("name").cast("string").alias("name"), digest, bad)
        told = streams.advance_monitor(spark, given, at).select(F.lit(run).alias("run"), "name", "changed", "unhealthy")
        out = told if out is None else out.unionByName(told)
    return out


@query("a01_site_summary", f"""SELECT {H} AS host, count(*) AS pages, CAST(sum(n) AS BIGINT) AS links FROM (SELECT url, len(list_distinct(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))) AS n FROM pages) GROUP BY 1""")
def a01(spark, d):
    """Pages and distinct internal links of each host: parse once, then aggregate."""
    p = parse_pages(pages(spark, d))
    return p.groupBy(urls.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.size("doc.plain_links")).alias("links"))


# More of the inventory


@query("e09_metadata", f"""{WITH} SELECT page_id, 'robots' AS name, 'NoIndex, follow' AS value FROM ep WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'keywords', 'a,b' FROM ep WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'description', CASE WHEN page_id % 3 = 0 THEN 'About ' || page_id ELSE '' END FROM ep WHERE page_id % 3 < 2""")
def e09(spark, d):
    return parsed(spark, d).select("page_id", F.explode("doc.metadata").alias("name", "v")).select("page_id", "name", F.explode("v").alias("value")).where("name in ('robots', 'keywords', 'description')")


@query("e15_render_signals", f"{WITH} SELECT page_id, CAST(0 AS INTEGER) AS empty_root FROM ep")
def e15(spark, d):
    return parsed(spark, d).select("page_id", F.size(F.filter("doc.render_signals", lambda s: s == "Empty application root")).alias("empty_root"))


@query("e20_page_links", f"""{WITH}, l AS (SELECT DISTINCT page_id, CASE WHEN h[1:1] = '/' THEN 'in' ELSE 'out' END AS side, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM ep))
SELECT page_id, CAST(count(*) FILTER (WHERE side = 'in') AS INTEGER) AS internal, CAST(count(*) FILTER (WHERE side = 'out') AS INTEGER) AS external, CAST(0 AS INTEGER) AS cut FROM l GROUP BY page_id""")
def e20(spark, d):
    out = links.page_links(parsed(spark, d), keep=("page_id",))
    return out.select("page_id", F.size("internal_links").alias("internal"), F.size("external_links").alias("external"), F.col("link_limit").alias("cut"))


@query("e23_robots_sitemaps", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/maps/all.xml' AS url FROM pages")
def e23(spark, d):
    origin = urls.url_origin(F.col("url"))
    texts = pages(spark, d).select(origin.alias("origin")).distinct().withColumn("text", F.concat(F.lit("User-agent: *\nSitemap: "), "origin", F.lit("/maps/all.xml\nSITEMAP : "), "origin", F.lit("/maps/all.xml\nSitemap: https://elsewhere.example/m.xml")))
    return sitemaps.robots_sitemaps(texts).select("origin", "url")


def origin_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an index for each origin, where 15 pages make an origin: with the index, as many files as are read of one."""
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    n = F.col("page_id")
    origin = F.concat(F.lit("https://o"), F.floor(n / 15).cast("string"), F.lit(".example"))
    p = pages(spark, d).select(origin.alias("origin"), n.cast("string").alias("n"))
    leaf = p.select(F.concat("origin", F.lit("/b"), "n", F.lit(".xml")).alias("sitemap_url"), F.concat(F.lit("<urlset><url><loc>"), "origin", F.lit("/leaf"), "n", F.lit("</loc></url></urlset>")).alias("text"))
    child = F.concat(F.lit("<sitemap><loc>"), "origin", F.lit("/b"), "n", F.lit(".xml</loc></sitemap>"))
    index = p.groupBy("origin").agg(F.array_join(F.sort_array(F.collect_list(child)), "").alias("x")).select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("text"))
    store = leaf.unionByName(index.select(F.col("url").alias("sitemap_url"), "text")).checkpoint()
    return sitemaps.expand_sitemaps(store, index.select("origin", "url")).select("origin", "sitemap", "url")


ORIGIN_SITEMAPS = """SELECT 'https://o' || page_id // 15 || '.example' AS origin, 'https://o' || page_id // 15 || '.example/b' || page_id || '.xml' AS sitemap,
  'https://o' || page_id // 15 || '.example/leaf' || page_id AS url FROM pages"""


@query("g7_expand_sitemaps", f"SELECT sitemap, url FROM ({ORIGIN_SITEMAPS})")
def g7(spark, d):
    return origin_sitemaps(spark, d).select("sitemap", "url")


def nested_sitemaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Captured files and origins where each index lists the next one and a file; a file also lists the address of the file before, in markup that hides more."""
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    n, k = F.col("page_id"), F.col("page_id") % 15
    at = F.concat(F.lit("https://n"), F.floor(n / 15).cast("string"), F.lit(".example"))
    p = pages(spark, d).select(at.alias("origin"), k.alias("k"), "url")
    say = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.col(x) if x == "origin" else F.lit(x) for x in parts))
    one, up, below = F.col("k").cast("string"), (F.col("k") + 1).cast("string"), F.greatest(F.col("k") - 1, F.lit(0)).cast("string")
    index = p.select(say("origin", "/c", one, "/i.xml").alias("sitemap_url"), say("<!-- <sitemap><loc>", "origin", "/hidden.xml</loc></sitemap> --><sitemapindex><sitemap><loc>", "origin", "/c", up, "/i.xml</loc></sitemap><sitemap><loc>", "origin", "/c", one, "/u.xml</loc></sitemap></sitemapindex>").alias("text"))
    leaf = p.select(
        say("origin", "/c", one, "/u.xml").alias("sitemap_url"),
        say("<s:urlset xmlns:s='x' xmlns:image='y'><s:url><image:image><image:loc>", "origin", "/picture</image:loc></image:image><s:loc>", "origin", "/at/", one, "</s:loc></s:url><s:url><s:loc><![CDATA[", "origin", "/at/", below, "]]></s:loc></s:url><!-- <s:url><s:loc>", "origin", "/no</s:loc></s:url> --></s:urlset>").alias("text"),
    )
    first = p.select("origin").distinct().select(say("origin", "/sitemap.xml").alias("sitemap_url"), say("<sitemapindex><sitemap><loc>", "origin", "/c0/i.xml</loc></sitemap></sitemapindex>").alias("text"))
    return index.unionByName(leaf).unionByName(first).checkpoint(), p.select("origin", say("origin", "/sitemap.xml").alias("url")).distinct()


@query("g7_nested_sitemaps", "SELECT 'https://n' || page_id // 15 || '.example' AS origin, 'https://n' || page_id // 15 || '.example/c' || page_id % 15 || '/u.xml' AS sitemap, 'https://n' || page_id // 15 || '.example/at/' || page_id % 15 AS url FROM pages WHERE page_id % 15 <= 6")
def g7_nested(spark, d):
    """Nine levels, until sixteen files of an origin are read."""
    return sitemaps.expand_sitemaps(*nested_sitemaps(spark, d)).select("origin", "sitemap", "url")


@query("g7_sitemap_files", """WITH o AS (SELECT page_id // 15 AS o, max(page_id % 15) AS last FROM pages GROUP BY 1), at AS (SELECT 'https://n' || o || '.example' AS origin, last, k FROM o, range(0, 8) r(k))
SELECT DISTINCT origin, 1 AS n, origin || '/sitemap.xml' AS sitemap, 'index' AS kind, 0 AS urls FROM at UNION ALL SELECT origin, CASE k WHEN 0 THEN 2 ELSE 2 * k + 1 END, origin || '/c' || k || '/i.xml', CASE WHEN k <= last THEN 'index' ELSE 'unknown' END, 0 FROM at WHERE k <= last + 1
UNION ALL SELECT origin, 2 * k + 4, origin || '/c' || k || '/u.xml', 'urlset', 1 FROM at WHERE k <= least(last, 6)""".replace(", at AS", ", spots AS").replace("FROM at", "FROM spots"))
def g7_files(spark, d):
    return sitemaps.sitemap_files(*nested_sitemaps(spark, d)).select("origin", F.col("n").cast("int").alias("n"), "sitemap", "kind", F.col("urls").cast("int").alias("urls"))


@query("e22_sitemap_markup", "SELECT 'https://n' || page_id // 15 || '.example/c' || page_id % 15 || '/u.xml' AS sitemap, i AS pos, 'https://n' || page_id // 15 || '.example/at/' || greatest(page_id % 15 - i, 0) AS url FROM pages, range(0, 2) r(i)")
def e22_markup(spark, d):
    """Entries among comments, CDATA, prefixes and pictures' addresses."""
    store, _ = nested_sitemaps(spark, d)
    return sitemaps.sitemap_entries(store).where("kind = 'urlset'").select("sitemap", F.col("pos").cast("long").alias("pos"), "url")


@query("k11_run_store", """SELECT CAST(user_id % 30 AS VARCHAR) AS run_id, CASE WHEN user_id % 30 % 3 = 0 THEN 5 WHEN user_id % 30 % 3 = 1 THEN 3 ELSE 4 END AS revision, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM events WHERE user_id % 30 < 25 AND CASE user_id % 30 % 3 WHEN 0 THEN event_id % 2 = 1 WHEN 1 THEN event_id % 2 = 0 ELSE event_id % 5 = 0 END GROUP BY 1, 2""")
def k11(spark, d):
    """A store of runs after four writes: revision 3 of every run, 5 of a third, 4 of a third and then, too late, 2 of all; and without five runs."""
    from sitegrain.cluster import new_folder
    from sitegrain.sources import sinks

    at, run, n = new_folder(spark, "runs"), F.col("user_id") % 30, F.col("event_id")
    rows = table(spark, d, "events").select(run.cast("string").alias("run_id"), "event_id", (run % 3).alias("third"))
    of = lambda where, revision: rows.where(where).withColumn("revision", F.lit(revision)).drop("third")
    for part in (of(n % 2 == 0, 3), of((F.col("third") == 0) & (n % 2 == 1), 5), of((F.col("third") == 2) & (n % 5 == 0), 4), of(n % 7 == 0, 2)):
        sinks.save_run(part, at)
    for gone in range(25, 30):
        sinks.delete_run(spark, at, str(gone))
    return sinks.read_runs(spark, at).groupBy("run_id", "revision").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("a24_digest_tree", """WITH r AS (SELECT 'p:' || sha256(url) || ':' || sha256(to_json({'page_id': page_id, 'url': url})) || ':1' AS e, sha256(url) AS spot FROM pages UNION ALL
SELECT 'e:' || x || ':' || x || ':1', x FROM (SELECT sha256(to_json({'kind': 'http', 'url': url})) AS x FROM pages WHERE page_id % 10 = 0)),
l2 AS (SELECT spot[1:2] AS prefix, sha256(string_agg(e, '' ORDER BY e)) AS digest FROM r GROUP BY 1), l1 AS (SELECT prefix[1:1] AS prefix, sha256(string_agg(prefix || ':' || digest, '' ORDER BY prefix)) AS digest FROM l2 GROUP BY 1)
SELECT 2 AS level, prefix, digest FROM l2 UNION ALL SELECT 1, prefix, digest FROM l1 UNION ALL SELECT 0, '', sha256(string_agg(prefix || ':' || digest, '' ORDER BY prefix)) FROM l1""")
def a24_tree(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    p = pages(spark, d).select("page_id", "url").withColumn("duration_ms", F.col("page_id") * 3)
    failed = p.where(F.col("page_id") % 10 == 0).select("url", F.lit("http").alias("kind"), F.col("page_id").alias("error_seq"))
    return tables.digest_tree(p, failed, depth=2)


@query("a01_run_summary", f"{WITH} SELECT count(*) AS pages, (SELECT count(*) FROM err) AS failed, (SELECT count(DISTINCT target) FROM tgt WHERE starts_with(target, 'https://site.example')) AS internal_links, (SELECT count(DISTINCT target) FROM tgt WHERE NOT starts_with(target, 'https://site.example')) AS external_links FROM cap")
def a01_run(spark, d):
    from sitegrain.operators.merge import run_summary

    return run_summary(captures(spark, d), errors(spark, d))


@query("a22_render_totals", "SELECT user_id AS url, count(*) AS requests, count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 500 >= 400) AS errors, CAST(coalesce(sum(CASE WHEN event_id % 3 > 0 THEN length(props) END), 0) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def a22(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("url"), F.when(n % 7 == 0, "blocked").alias("error"), (n % 500).alias("status"), (n % 3 == 0).alias("cached"), F.length("props").alias("body_bytes"))
    return tables.render_totals(rows)


@query("a23_facets", "SELECT DISTINCT event_type AS value FROM events ORDER BY 1 LIMIT 80")
def a23(spark, d):
    return tables.facets(table(spark, d, "events"), "event_type")


@query("a26_telemetry", f"{WITH} SELECT 'state' AS what, CASE WHEN page_id % 4 = 0 THEN 'queued' ELSE 'fetched' END AS name, count(*) AS n FROM cap GROUP BY 2 UNION ALL SELECT 'method', CASE WHEN page_id % 3 = 0 THEN 'browser' ELSE 'http' END, count(*) FROM cap GROUP BY 2")
def a26(spark, d):
    from sitegrain.operators.merge import telemetry

    p = captures(spark, d)
    return telemetry(p.select(F.when(F.col("page_id") % 4 == 0, "queued").otherwise("fetched").alias("state")), p.select(F.when(F.col("page_id") % 3 == 0, "browser").alias("method")))


@query("j9_inlinks", f"{WITH} SELECT DISTINCT c.url FROM tgt t JOIN cap c USING (capture_seq) WHERE t.target IN ('https://site.example/g0/p0', 'https://site.example/old/0')")
def j9(spark, d):
    return links.inlinks(captures(spark, d), "https://site.example/g0/p0")


@query("j10_neighbourhood", f"{WITH}, e AS (SELECT DISTINCT source, target FROM res) SELECT target AS id FROM e WHERE source = 'https://site.example/g1/p1' UNION SELECT source FROM e WHERE target = 'https://site.example/g1/p1' UNION SELECT 'https://site.example/g1/p1'")
def j10(spark, d):
    return graph.neighbourhood(graph.edges(captures(spark, d)), "https://site.example/g1/p1")


@query("j6_absent_from_sitemaps", f"{WITH} SELECT url FROM cap WHERE page_id % 3 <> 0 AND NOT (page_id % 13 = 0 AND page_id % 26 = 0)")
def j6(spark, d):
    p = captures(spark, d)
    listed = p.where("page_id % 3 = 0").select("url").union(p.where("page_id % 26 = 0").select("requested_url"))
    return sitemaps.absent_from_sitemaps(p, listed.toDF("url")).select("url")


@query("l4_rank_pages", f"""{WITH}, inc AS (SELECT target, count(DISTINCT capture_seq) AS n FROM res WHERE starts_with(target, 'https://site.example') GROUP BY target)
SELECT c.url, CAST(coalesce(n, 0) AS BIGINT) AS incoming FROM cap c LEFT JOIN inc ON inc.target = c.url ORDER BY 2 DESC, 1 LIMIT 20""")
def l4(spark, d):
    p = captures(spark, d)
    none = fi.findings(p, errors(spark, d))
    return fi.rank_pages(fi.page_metrics(p, none), "incoming").select("url", "incoming").limit(20)


@query("l5_top_hubs", f"""{WITH}, e AS (SELECT DISTINCT source, target FROM res) SELECT target AS id, count(*) AS inbound FROM e WHERE target IN (SELECT url FROM cap) GROUP BY target ORDER BY 2 DESC, 1 LIMIT 6""")
def l5(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    # only what nodes are made of is written, without the columns of findings
    p = captures(spark, d).select("capture_seq", "url", "requested_url", "outgoing_links", "status_code", "depth", "title", "heading").checkpoint()
    n = graph.nodes(p, errors(spark, d), graph.edges(p).checkpoint(), pages(spark, d).select("url").limit(0), ROOT)
    return graph.top_hubs(n, 6).select("id", "inbound")


@query("l7_page_of", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def l7(spark, d):
    return tables.page_of(table(spark, d, "documents"), [F.desc("n_chars"), "doc_id"], 2, 50).select("doc_id")


@query("p1_filter_pages", f"{WITH} SELECT url FROM cap WHERE contains(lower(url), '/p1')")
def p1(spark, d):
    return tables.filter_pages(captures(spark, d).withColumn("method", F.lit("http")).withColumn("discovery", F.lit("link")), "/P1", "external").select("url")


@query("p2_filter_findings", RULE_SQL + " SELECT f.capture_seq, title FROM f JOIN cap USING (capture_seq) WHERE title IN ('Missing title', 'Missing description', 'Repeated title', 'Matching body text') AND contains(url, '/g1/')".replace("SELECT f.capture_seq, title", "SELECT f.capture_seq, f.title").replace("WHERE title IN", "WHERE f.title IN"))
def p2(spark, d):
    found = fi.findings(captures(spark, d), errors(spark, d))
    return fi.filter_findings(found, category="Content", severity="review").where(F.col("url").contains("/g1/")).select("capture_seq", "title")


@query("p6_filter_issues", f"{WITH} SELECT url, message AS detail FROM err WHERE contains(lower(message), 'late') OR contains(url, 'late')")
def p6(spark, d):
    return fi.filter_issues(fi.issues(captures(spark, d), errors(spark, d)), "HTTP / Network", "LATE").select("url", "detail")


@query("w2_cap_query_variants", f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {H}, {P}, regexp_extract(url, '^[a-z]+') ORDER BY page_id) AS n FROM pages) WHERE n <= 1")
def w2(spark, d):
    return frontier.cap_query_variants(pages(spark, d), 1, ["page_id"]).select("page_id")


@query("w10_waterfall", "SELECT event_id, event_id % 100 / greatest(1, max(event_id % 100 + user_id % 50) OVER (PARTITION BY user_id)) AS start_share FROM events")
def w10(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("page"), (F.col("event_id") % 100).alias("start_ms"), (F.col("user_id") % 50).alias("duration_ms"))
    return windows.waterfall(rows).select("event_id", "start_share")


@query("w13_share_of_max", "SELECT user_id, n / max(n) OVER () AS share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def w13(spark, d):
    return windows.share_of_max(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n").select("user_id", "share")


@query("d4_structured", f"""{WITH} SELECT url AS "Source page", CASE WHEN page_id % 5 = 0 THEN 'Article, Person, Agent' ELSE 'Unspecified' END AS "Type", CASE WHEN page_id % 5 = 0 THEN 'Parsed' ELSE 'Invalid' END AS "Parsing" FROM ep WHERE page_id % 5 < 2""")
def d4(spark, d):
    items = structured_rows(parsed(spark, d), "url").select("*", F.lit(None).cast("string").alias("context"))
    return tables.dataset_structured(items).select("Source page", "Type", "Parsing")


@query("d7_custom", f"""{WITH} SELECT url AS "URL", 'Paper' AS "Field: paper", 'mail | t' AS "Field: names" FROM ep""")
def d7(spark, d):
    rules = [{"name": "paper", "selector": "a[rel=nofollow]", "mode": "text", "attribute": None}, {"name": "names", "selector": "form input[name]", "mode": "attribute", "attribute": "name"}]
    rows = parse_pages(enriched(spark, d), rules).select("url", F.lit("http").alias("method"), F.col("doc.custom").alias("custom"), F.col("doc.extraction_errors").alias("errors"))
    return tables.custom_dataset(rows, ["paper", "names"]).select("URL", "Field: paper", "Field: names")


@query("d3_resources", f"""{WITH}, o AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS o FROM ep), r AS (
SELECT page_id, o || '/s.css' AS "URL", 'Browser request' AS "Evidence" FROM o UNION ALL SELECT page_id, o || '/_next/app.js', 'Declared in DOM' FROM o UNION ALL SELECT page_id, o || '/doc/' || page_id % 6 || '.pdf', 'Declared in DOM' FROM o UNION ALL SELECT page_id, o || '/i/' || page_id % 10 || '.png', 'Image candidate' FROM o)
SELECT "URL", "Evidence", count(*) AS n FROM r GROUP BY 1, 2""")
def d3(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    # three tables come from the parsed pages, so they are written once
    p = parsed(spark, d).select("page_id", F.col("page_id").cast("string").alias("url"), F.col("url").alias("u"), "doc.resources", "doc.images").checkpoint()
    seen = p.select("url", F.lit(0).alias("pos"), F.concat(urls.url_origin(F.col("u")), F.lit("/s.css")).alias("resource"), F.lit("stylesheet").alias("type"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.lit("text/css").alias("content_type"), F.lit(10).alias("body_bytes"), F.lit(5).alias("duration_ms"), F.lit(False).alias("cached"))
    declared = p.select("url", F.posexplode("resources").alias("pos", "r")).select("url", "pos", F.col("r.url").alias("resource"), "r.kind", "r.type")
    shown = p.select("url", F.posexplode("images").alias("pos", "i")).select("url", "pos", F.explode("i.candidates").alias("resource"), "i.alt")
    return tables.dataset_resources(seen, declared, shown).groupBy("URL", "Evidence").agg(F.count("*").alias("n"))


@query("g4_replay_crawl", """WITH RECURSIVE w AS (SELECT 0 AS depth, 0 AS n UNION ALL SELECT depth + 1, n * 2 + k FROM w, (VALUES (1), (2)) v(k) WHERE depth < 4 AND n * 2 + k <= (SELECT max(page_id) FROM pages))
SELECT 'https://site.example/n' || CAST(n AS VARCHAR) AS url, depth, 'fetched' AS state FROM w""")
def g4(spark, d):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    n = F.col("page_id")
    at = lambda c: F.concat(F.lit("https://site.example/n"), c.cast("string"))
    p = pages(spark, d)
    top = p.agg(F.max("page_id").alias("top"))
    own = [F.when(n * 2 + k <= F.col("top"), at(n * 2 + k)) for k in (1, 2)]
    store = p.crossJoin(F.broadcast(top)).select(at(n).alias("url"), F.array_compact(F.array(*own, at(n), F.lit("https://else.example/"))).alias("outgoing_links"))
    found, _ = frontier.replay_crawl(store, "https://site.example/n0", max_depth=4, max_pages=100_000)
    return found.select("url", "depth", "state")


def _every() -> None:
    """Register what the other modules have; they use names of this one."""
    from sitegrain.plans import whole_rows  # noqa: F401


def queries() -> dict[str, Query]:
    _every()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _every()
    return dict(ORACLES)
