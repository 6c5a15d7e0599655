"""More registered queries: whole rows of operators whose first queries show some columns only, and operators without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.cluster import checkpoints
from sitegrain.functions import http, text, urls
from sitegrain.functions.jsonld import is_json, with_jsonld_types
from sitegrain.operators import findings as fi
from sitegrain.operators import frontier, graph, links, merge, robots, sitemaps, tables, windows
from sitegrain.operators.parse import parse_pages, structured_rows
from sitegrain.plans.captures import ROOT, captures, enriched, errors, parsed, table
from sitegrain.plans.queries import CLEAN, FAILED, ORIGIN_SITEMAPS, H, P, PATH, RULE_SQL, UNESCAPE, WITH, origin_sitemaps, pages, query
from sitegrain.sources import captures as sources
from sitegrain.sources import sinks

SITE = "https://site.example"
LINKS = "array<struct<url:string,text:string,rel:string,discovery:string,context:string>>"
INSIDE = f"starts_with({{0}}, '{SITE}')"


def with_elements(p):
    """Captures with an element for each link: text by its place, every third one nofollow."""
    one = lambda u, i: F.struct(u.alias("url"), F.concat(F.lit("link "), i.cast("string")).alias("text"), F.when(i % 3 == 1, "noopener NoFollow").otherwise("").alias("rel"), F.when(i == 2, "rendered").otherwise("raw").alias("discovery"), F.lit("document").alias("context"))
    return p.withColumn("links", F.transform("outgoing_links", one).cast(LINKS))


def with_method(p):
    n = F.col("page_id")
    return p.withColumn("method", F.when(n % 3 == 0, "browser").when(n % 3 == 1, "http")).withColumn("discovery", F.when(n % 8 == 0, "sitemap").otherwise("link")).withColumn("image_urls", F.array(F.concat(F.lit("https://site.example/i/"), (n % 10).cast("string"), F.lit(".png"))))


# Functions


@query("f07_canonical_moves", f"""SELECT page_id, x AS kind, CASE x WHEN 'to https' THEN true WHEN 'to http' THEN NOT starts_with(url, 'https') WHEN 'to www' THEN true WHEN 'elsewhere' THEN false ELSE false END AS moves
FROM pages, (VALUES ('to https'), ('to http'), ('to www'), ('elsewhere'), ('other port')) v(x)""")
def f07_moves(spark, d):
    u, host = F.col("url"), urls.url_host(F.col("url"))
    to = {"to https": F.concat(F.lit("https://"), host), "to http": F.concat(F.lit("http://"), host), "to www": F.concat(F.lit("https://www."), host), "elsewhere": F.concat(F.lit("https://else."), host), "other port": F.concat(F.lit("https://"), host, F.lit(":8443"))}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), urls.canonical_transition(u, v).alias("moves")) for k, v in to.items()])
    return pages(spark, d).select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


@query("f15_csv_safe_lenient", "SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*[=+@-]') THEN '''' || text ELSE text END AS csv FROM (SELECT doc_id, ['=', ' -', '@x ', '', '  '][CAST(doc_id % 5 AS INTEGER) + 1] || text AS text FROM documents)")
def f15_lenient(spark, d):
    t = F.concat(F.get(F.array(*map(F.lit, ("=", " -", "@x ", "", "  "))), (F.col("doc_id") % 5).cast("int")), "text")
    return table(spark, d, "documents").select("doc_id", text.csv_safe(t, strict=False).alias("csv"))


@query("f18_access_challenge", """SELECT event_id, CASE WHEN event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 7 < 3) THEN 'Vercel' WHEN event_id % 5 = 2 THEN 'Cloudflare' END AS provider,
  CASE WHEN event_id % 5 IN (0, 2) OR (event_id % 5 = 1 AND event_id % 7 < 3) THEN 'access-challenge' END AS kind FROM events""")
def f18(spark, d):
    n = F.col("event_id")
    headers = F.when(n % 5 == 0, F.create_map(F.lit("x-vercel-mitigated"), F.lit("challenge"), F.lit("cf-mitigated"), F.lit("challenge"))).when(n % 5 == 2, F.create_map(F.lit("cf-mitigated"), F.lit("challenge"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    status = F.when(n % 7 == 0, 403).when(n % 7 == 1, 429).when(n % 7 == 2, 503).otherwise(200)
    c = http.access_challenge(headers, status, F.when(n % 5 == 1, "<TITLE id=a> Vercel security checkpoint </title>").otherwise("<title>ok</title>"))
    return table(spark, d, "events").select("event_id", c["provider"].alias("provider"), c["kind"].alias("kind"))


@query("f19_inspect_headers", """SELECT event_id, 'content-type' AS name, 'Text/HTML; Charset="utf-8"' AS value, 'text/html' AS mime, 'utf-8' AS charset FROM events UNION ALL SELECT event_id, 'etag', substr(repeat(event_type, 2000), 1, 4000), 'text/html', 'utf-8' FROM events WHERE event_id % 2 = 0""")
def f19(spark, d):
    n, kind = F.col("event_id"), F.lit('Text/HTML; Charset="utf-8"')
    base = F.create_map(F.lit("content-type"), kind, F.lit("set-cookie"), F.lit("secret"))
    headers = F.when(n % 2 == 0, F.map_concat(base, F.create_map(F.lit("etag"), F.repeat("event_type", F.lit(2000))))).otherwise(base)
    rows = table(spark, d, "events").select("event_id", F.explode(http.inspect_headers(headers)).alias("name", "value"))
    return rows.select("event_id", "name", "value", http.mime_type(kind).alias("mime"), http.charset(kind).alias("charset"))


@query("f20_is_public_ip_v6", "SELECT event_id, event_id % 8 IN (0, 7) AS public FROM events")
def f20_v6(spark, d):
    v6 = F.get(F.array(*[F.lit(x) for x in ("2606:4700::", "fe80::", "fc00::", "2001:db8::", "2002:102:304::", "::", "ff02::", "2a00:1450:4001::")]), (F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").select("event_id", http.is_public_ip(F.concat(v6, F.lower(F.hex(F.col("event_id") % 60000 + 1)))).alias("public"))


@query("f21_raster_type", "SELECT event_id, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/avif', NULL, NULL][CAST(event_id % 7 AS INTEGER) + 1] AS type FROM events")
def f21(spark, d):
    heads = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "5249464601020304574542505650", "0000001C667479706D696631000000006D69663161766966", "0000001C667479706D70343200000000", "3C737667")
    data = F.concat(*[F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 7).cast("int"))), F.encode(F.col("event_type"), "utf-8")])
    return table(spark, d, "events").select("event_id", http.raster_type(data).alias("type"))


@query("f26_follow_state", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'nofollow' ELSE 'follow' END AS state FROM events")
def f26(spark, d):
    rel = F.get(F.array(*[F.lit(x) for x in ("nofollow", "noopener NoFollow ugc", "notnofollowed", "")]), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", text.follow_state(rel).alias("state"))


@query("f28_normalize_website", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' ELSE regexp_extract(url, '^[a-z]+://') END || {H} || {P} AS site FROM pages""")
def f28(spark, d):
    bare = F.concat(urls.url_host(F.col("url")), urls.url_path(F.col("url")))
    typed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("  "), bare, F.lit(" "))).otherwise(F.concat(F.regexp_extract("url", "^[a-z]+://", 0), bare))
    return pages(spark, d).select("page_id", urls.normalize_website(typed).alias("site"))


@query("f29_retry_after_dates", "SELECT event_id, CAST(greatest(0, (event_id % 100 - 50) * 60000) AS BIGINT) AS ms FROM events")
def f29_dates(spark, d):
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    header = F.concat(F.date_format(at + F.make_dt_interval(mins=(F.col("event_id") % 100 - 50).cast("int")), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, d, "events").select("event_id", http.retry_after_ms(header, at).alias("ms"))


@query("f34_natural_order", "SELECT event_id, row_number() OVER (ORDER BY event_id % 13, event_id % 1000, event_id) - 1 AS ord FROM events")
def f34(spark, d):
    n = F.col("event_id")
    key = text.natural_key(F.concat(F.lit("Row "), (n % 13).cast("string"), F.when(n % 2 == 0, " b").otherwise(" B"), (n % 1000).cast("string")))
    return windows.number_rows(table(spark, d, "events").select("event_id", key.alias("key")), ["key", "event_id"]).select("event_id", "ord")


@query("f36_run_status", "SELECT user_id, CASE WHEN count(*) % 5 = 0 THEN 'blocked' WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 AND count(*) FILTER (WHERE event_type = 'click') > 0 THEN 'failed' WHEN count(*) % 3 = 0 THEN 'stopped' ELSE 'completed' END AS status FROM events GROUP BY user_id")
def f36(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") == "click").alias("bad"))
    return n.select("user_id", tables.run_status(F.col("n") % 5 == 0, F.col("ok"), F.col("bad"), F.col("n") % 3 == 0).alias("status"))


# Sources and extraction

TYPES = "['text/html; charset=utf-8', 'application/xhtml+xml', 'TEXT/HTML', 'image/png', NULL][CAST(page_id % 5 AS INTEGER) + 1]"


@query("s2_html_gate", f"""SELECT url, CASE WHEN page_id % 5 < 3 THEN 'page' ELSE 'non-html' END AS kind, CASE WHEN page_id % 5 = 3 THEN 'Expected HTML, received image/png' WHEN page_id % 5 = 4 THEN 'Expected HTML, received no content type' END AS message FROM pages""")
def s2(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/xhtml+xml", "TEXT/HTML", "image/png", None)])
    good, bad = sources.html_gate(pages(spark, d).withColumn("content_type", F.get(kinds, (F.col("page_id") % 5).cast("int"))))
    return good.select("url", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("message")).unionByName(bad)


@query("s4_read_robots", f"""SELECT {H} || page_id AS origin, substr(repeat(url, 3000), 1, 64000) AS text FROM pages""")
def s4(spark, d):
    rows = pages(spark, d).select(F.concat(urls.url_host(F.col("url")), F.col("page_id").cast("string")).alias("origin"), F.concat(F.lit("﻿"), F.repeat("url", F.lit(3000))).alias("text"))
    return sources.read_robots(rows)


@query("s5_usable_sitemaps", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def s5(spark, d):
    head = F.when(F.col("page_id") % 3 == 1, "<!doctype x>").when(F.col("page_id") % 3 == 2, F.repeat(F.lit("x"), F.lit(2 * 1024 * 1024))).otherwise("<urlset>")
    return sources.usable_sitemaps(pages(spark, d).select("page_id", F.concat(head, F.lit("</urlset>")).alias("text"))).select("page_id")


@query("e05_link_rows", f"""{WITH} SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN h[1:1] = '/' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%27', '''') ELSE h END AS target,
  CASE WHEN starts_with(h, '/doc/') THEN 'nofollow' ELSE '' END AS rel, CASE WHEN h = 'https://out.example/x' THEN 'far' ELSE '' END AS title
FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM ep))""")
def e05_rows(spark, d):
    return parsed(spark, d).select("page_id", F.posexplode("doc.links").alias("pos", "l")).select("page_id", "pos", F.col("l.url").alias("target"), F.coalesce("l.rel", F.lit("")).alias("rel"), F.coalesce("l.title", F.lit("")).alias("title"))


@query("a17_heading_occurrences", f"""{WITH} SELECT url, 'H1' AS kind, 0 AS pos, {CLEAN.format(UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS text, '' AS detail FROM ep UNION ALL SELECT url, 'H2', 1, 'More on page', '#more' FROM ep""")
def a17(spark, d):
    return tables.heading_occurrences(parsed(spark, d)).select("url", "kind", "pos", "text", "detail")


# Links, graph, replay


@query("o5_frontier_links", f"""{WITH}, r AS (SELECT capture_seq, pos AS k, target FROM tgt WHERE pos >= 2 UNION ALL SELECT capture_seq, 100, 'https://site.example/new' FROM cap UNION ALL SELECT capture_seq, 200 + pos, target FROM tgt), f AS (SELECT capture_seq, target, min(k) AS k FROM r GROUP BY 1, 2),
n AS (SELECT capture_seq, target, row_number() OVER (PARTITION BY capture_seq ORDER BY k) - 1 AS pos FROM f) SELECT capture_seq, CAST(pos AS INTEGER) AS pos, target FROM n WHERE pos < 5""")
def o5(spark, d):
    rendered = F.concat(F.slice("outgoing_links", 3, 10), F.array(F.lit("https://site.example/new")))
    return captures(spark, d).select("capture_seq", F.posexplode(frontier.frontier_links(F.col("outgoing_links"), rendered, 5)).alias("pos", "target"))


@query("d1_dataset_links_rows", f"""{WITH}, known AS (SELECT dest, arg_max(status, seq) AS status FROM (SELECT url AS dest, CAST(status_code AS VARCHAR) AS status, capture_seq * 2 AS seq FROM cap
  UNION ALL SELECT requested_url, CASE WHEN requested_url <> url THEN 'Redirect' ELSE CAST(status_code AS VARCHAR) END, capture_seq * 2 + 1 FROM cap) GROUP BY dest),
last AS (SELECT url AS dest, arg_max(coalesce(CAST(status_code AS VARCHAR), kind), error_seq) AS s FROM err GROUP BY url)
SELECT c.url AS "Source", t.target AS "Destination", 'link ' || pos AS "Anchor", CASE WHEN {INSIDE.format('t.target')} THEN 'Internal' ELSE 'External' END AS "Type", coalesce(k.status, l.s, 'Not crawled') AS "Status",
  CASE WHEN pos % 3 = 1 THEN 'nofollow' ELSE 'follow' END AS "Follow", CASE WHEN pos = 2 THEN 'rendered' ELSE 'raw' END AS "Discovery", 'document' AS "Context", CASE WHEN pos % 3 = 1 THEN 'noopener NoFollow' ELSE '' END AS "Rel"
FROM tgt t JOIN cap c USING (capture_seq) LEFT JOIN known k ON k.dest = t.target LEFT JOIN last l ON l.dest = t.target""")
def d1_rows(spark, d):
    return links.dataset_links(with_elements(captures(spark, d)), errors(spark, d))


@query("j2_link_status", f"""{WITH} SELECT capture_seq, CAST(pos AS INTEGER) AS pos, url AS source, target AS destination, 'link ' || pos AS text, CASE WHEN pos % 3 = 1 THEN 'noopener NoFollow' ELSE '' END AS rel, CASE WHEN pos = 2 THEN 'rendered' ELSE 'raw' END AS discovery, 'document' AS context FROM tgt JOIN cap USING (capture_seq)""")
def j2(spark, d):
    return links.link_rows(with_elements(captures(spark, d)))


NODES = f"""{WITH}, e AS (SELECT DISTINCT source, target FROM res), deg AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY id),
every AS (SELECT url AS id, 'page' AS state, CASE WHEN page_id % 8 = 0 THEN -1 ELSE coalesce(depth, -1) END AS depth, coalesce(status_code, 0) AS status, coalesce(nullif(title, ''), heading, '') AS title, coalesce(CASE page_id % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'http' END, 'http') AS rendering, 0 AS rank, capture_seq AS seq FROM cap
  UNION ALL SELECT coalesce(a.identity, r.url), 'error', -1, coalesce(status_code, 0), kind, NULL, 1, error_seq FROM err r LEFT JOIN alias a ON a.alias = r.url
  UNION ALL SELECT target, CASE WHEN {INSIDE.format('target')} THEN 'discovered' ELSE 'external' END, -1, 0, '', NULL, 2, 0 FROM e UNION ALL SELECT 'https://site.example/map/' || page_id, 'discovered', -1, 0, '', NULL, 3, 0 FROM pages WHERE page_id % 25 = 0),
best AS (SELECT id, arg_min(state, rank * 10000000 + seq) AS state, arg_min(depth, rank * 10000000 + seq) AS depth, arg_min(status, rank * 10000000 + seq) AS status, arg_min(title, rank * 10000000 + seq) AS title, arg_min(rendering, rank * 10000000 + seq) AS rendering FROM every GROUP BY id),
nodes AS (SELECT b.id, {PATH.format("b.id")} || regexp_extract(b.id, '(\\?[^#]+)', 1) AS path, CASE WHEN state = 'external' THEN 'external' ELSE coalesce(list_filter(string_split({PATH.format("b.id")}, '/'), lambda x: x <> '')[1], '(root)') END AS grp, state, CAST(depth AS BIGINT) AS depth, CAST(status AS BIGINT) AS status, title,
  CAST(coalesce(i, 0) AS BIGINT) AS inbound, CAST(coalesce(o, 0) AS BIGINT) AS outbound, false AS root, rendering, starts_with(b.id, 'https://site.example/map/') AS sitemap, starts_with(b.id, 'https://site.example/map/') AS sitemap_only FROM best b LEFT JOIN deg ON deg.id = b.id)"""


def nodes_of(spark, d):
    checkpoints(spark)
    p = with_method(captures(spark, d)).checkpoint()
    listed = pages(spark, d).where("page_id % 25 = 0").select(F.concat(F.lit("https://site.example/map/"), F.col("page_id").cast("string")).alias("url"))
    e = graph.edges(p).checkpoint()
    return graph.nodes(p, errors(spark, d), e, listed, ROOT), e


@query("g2_node_rows", NODES + " SELECT * FROM nodes")
def g2_rows(spark, d):
    return nodes_of(spark, d)[0].withColumnRenamed("group", "grp")


@query("p4_filter_nodes", NODES + " SELECT id FROM nodes WHERE state IN ('page', 'discovered') AND rendering = 'browser' AND grp IN ('g1') AND contains(lower(id || ' ' || title), 'p1')")
def p4(spark, d):
    return graph.filter_nodes(nodes_of(spark, d)[0], ["page", "discovered"], group="g1", query="P1", rendering="browser").select("id")


@query("p4_focus_nodes", NODES + f", near AS (SELECT target AS id FROM e WHERE source = '{SITE}/g1/p1' UNION SELECT source FROM e WHERE target = '{SITE}/g1/p1' UNION SELECT '{SITE}/g1/p1') SELECT id, state FROM nodes WHERE id IN (FROM near) AND state <> 'external'")
def p4_focus(spark, d):
    n, e = nodes_of(spark, d)
    return graph.filter_nodes(n, ["page", "discovered", "error"], focus=f"{SITE}/g1/p1", edge_rows=e).select("id", "state")


@query("p8_filter_paths", NODES + " SELECT id, 'all' AS which FROM nodes WHERE state <> 'external' AND contains(lower(id || ' ' || title), 'g2') UNION ALL SELECT id, 'pages' FROM nodes WHERE state = 'page'")
def p8(spark, d):
    n = nodes_of(spark, d)[0]
    return graph.filter_paths(n, "G2", pages_only=False).select("id", F.lit("all").alias("which")).unionByName(graph.filter_paths(n).select("id", F.lit("pages").alias("which")))


@query("l6_graph_subset", NODES + " SELECT id FROM nodes ORDER BY inbound DESC, id LIMIT 40")
def l6(spark, d):
    n, e = nodes_of(spark, d)
    return graph.graph_subset(n, e, limit=40)[0].select("id")


@query("l9_top_groups", f"SELECT coalesce(list_filter(string_split({P}, '/'), lambda x: x <> '')[1], '(root)') AS name, count(*) AS count FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9")
def l9(spark, d):
    return graph.top_groups(graph.path_groups(pages(spark, d)))


TREE = """WITH RECURSIVE w AS (SELECT 0 AS depth, 0 AS n UNION ALL SELECT depth + 1, n * 2 + k FROM w, (VALUES (1), (2)) v(k) WHERE depth < {0} AND n * 2 + k <= (SELECT max(page_id) FROM pages) {1})"""


def tree(spark, d):
    """A store whose page n links to 2n + 1 and 2n + 2 (while there are such), to itself, another site, three variants of itself and no address."""
    n = F.col("page_id")
    at = lambda c: F.concat(F.lit("https://site.example/n"), c.cast("string"))
    p = pages(spark, d)
    top = p.agg(F.max("page_id").alias("top"))
    own = [F.when(n * 2 + k <= F.col("top"), at(n * 2 + k)) for k in (1, 2)]
    variants = [F.concat(at(n), F.lit(f"?v={k}")) for k in (1, 2, 3)]
    return p.crossJoin(F.broadcast(top)).select(at(n).alias("url"), F.array_compact(F.array(*own, at(n), F.lit("https://else.example/"), *variants, F.lit("mailto:x"))).alias("outgoing_links"))


@query("g4_replay_deep", TREE.format(8, "") + " SELECT 'https://site.example/n' || n AS url, depth, 'fetched' AS state FROM w UNION ALL SELECT 'https://site.example/n' || n || '?v=1', depth + 1, 'missing' FROM w WHERE depth < 8")
def g4_deep(spark, d):
    checkpoints(spark)
    return frontier.replay_crawl(tree(spark, d), f"{SITE}/n0", max_depth=8, max_pages=10_000_000, max_variants=2)[0]


DECIDED = """, s AS (SELECT 'https://site.example/n' || n AS url, depth + 1 AS depth, 'duplicate' AS reason FROM w UNION ALL SELECT 'https://else.example/', depth + 1, 'out_of_scope' FROM w UNION ALL SELECT 'mailto:x', depth + 1, 'invalid_url' FROM w
  UNION ALL SELECT 'https://site.example/n' || n || '?v=' || k, depth + 1, 'query_limit' FROM w, (VALUES (2), (3)) v(k) WHERE depth < 6 UNION ALL SELECT 'https://site.example/n' || n || '?v=' || k, depth + 1, 'depth_limit' FROM w, (VALUES (1), (2), (3)) v(k) WHERE depth = 6
  UNION ALL SELECT 'https://site.example/n' || (n * 2 + k), 7, 'depth_limit' FROM w, (VALUES (1), (2)) v(k) WHERE depth = 6 AND n * 2 + k <= (SELECT max(page_id) FROM pages))"""


@query("g5_replay_decisions", TREE.format(6, "") + DECIDED + " SELECT * FROM s")
def g5(spark, d):
    checkpoints(spark)
    return frontier.replay_crawl(tree(spark, d), f"{SITE}/n0", max_depth=6, max_pages=10_000_000, max_variants=2)[1].select("url", "depth", "reason")


@query("a02_skip_counts", TREE.format(6, "") + DECIDED + " SELECT reason, count(*) AS count FROM s GROUP BY reason")
def a02(spark, d):
    checkpoints(spark)
    return frontier.skip_counts(frontier.replay_crawl(tree(spark, d), f"{SITE}/n0", max_depth=6, max_pages=10_000_000, max_variants=2)[1])


@query("d6_dataset_robots", TREE.format(12, "AND NOT contains(CAST(n * 2 + k AS VARCHAR), '5')") + """ SELECT 'https://site.example/n' || (n * 2 + k) AS "URL", 'Disallowed by applicable robots policy' AS "Reason" FROM w, (VALUES (1), (2)) v(k) WHERE contains(CAST(n * 2 + k AS VARCHAR), '5') AND depth < 12 AND n * 2 + k <= (SELECT max(page_id) FROM pages) ORDER BY depth, n, k LIMIT 1000""")
def d6(spark, d):
    checkpoints(spark)
    rules = robots.robots_rules(pages(spark, d).select(F.lit(SITE).alias("origin"), F.lit("User-agent: *\nDisallow: /n*5\nAllow: /x").alias("text")).distinct())
    skipped = frontier.replay_crawl(tree(spark, d), f"{SITE}/n0", max_depth=12, max_pages=10_000_000, max_variants=2, rules=rules)[1]
    return tables.dataset_robots(frontier.robots_excluded(skipped))


@query("g8_effective_start", f"""SELECT 'http://h' || page_id || '.example/' AS seed, CASE WHEN page_id % 4 = 0 THEN 'https://h' || page_id || '.example/' WHEN page_id % 4 = 1 THEN 'https://www.h' || page_id || '.example/' ELSE 'http://h' || page_id || '.example/' END AS effective_start_url,
  CASE WHEN page_id % 4 = 2 THEN 'out-of-scope' WHEN page_id % 4 = 3 THEN 'missing-location' END AS error FROM pages""")
def g8(spark, d):
    checkpoints(spark)
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    seed, https, www = F.concat(F.lit("http://h"), n, F.lit(".example/")), F.concat(F.lit("https://h"), n, F.lit(".example/")), F.concat(F.lit("https://www.h"), n, F.lit(".example/"))
    p = pages(spark, d)
    first = p.select(seed.alias("url"), F.lit(301).alias("status"), F.when(k < 2, https).when(k == 2, F.lit("https://else.example/")).alias("location"))
    second = p.select(https.alias("url"), F.when(k == 1, 308).otherwise(200).alias("status"), F.when(k == 1, www).alias("location"))
    return frontier.effective_start(first.unionByName(second), p.select(seed.alias("url")))


@query("g6_redirect_duplicates", """SELECT 'https://site.example/old/' || page_id AS requested_url, 'https://site.example/new/' || page_id % 20 AS url FROM pages WHERE page_id >= 20""")
def g6_again(spark, d):
    checkpoints(spark)
    n = F.col("page_id")
    old, new = F.concat(F.lit("https://site.example/old/"), n.cast("string")), F.concat(F.lit("https://site.example/new/"), (n % 20).cast("string"))
    resolved = frontier.resolve_redirects(pages(spark, d).select(old.alias("url"), F.lit(302).alias("status"), new.alias("location")))
    return frontier.redirect_duplicates(resolved, pages(spark, d).select(old.alias("requested_url"), n.alias("ord")))


# Findings, issues, tables

ROWS_SQL = RULE_SQL[: RULE_SQL.index(", f AS (")] + f""", g AS (SELECT capture_seq, t.k, count(*) OVER (PARTITION BY t.k) AS size FROM t),
x AS (SELECT c.*, page_id % 14 = 0 AS no_lang, page_id % 6 <> 5 AS known, CASE WHEN page_id % 10 = 0 THEN ' Partial sample.' ELSE '' END AS cut FROM cap c), f AS (
SELECT url, 'review' AS severity, 'Content' AS category, 'Missing title' AS title, 'No nonempty HTML title was captured.' AS detail, '' AS related_url FROM x WHERE title IS NOT NULL AND trim(title) = ''
UNION ALL SELECT url, 'review', 'Content', 'Missing description', 'No nonempty meta description was captured.', '' FROM x WHERE description = ''
UNION ALL SELECT url, 'info', 'Capture', 'Accessibility sample capped', 'Static checks stopped after 5,000 elements. This page is excluded from element coverage percentages.', '' FROM x WHERE known AND page_id % 10 = 0
UNION ALL SELECT url, 'review', 'Accessibility', 'Missing document language', 'The document has no nonempty lang attribute. This check does not validate language tags.', '' FROM x WHERE known AND no_lang
UNION ALL SELECT url, 'review', 'Accessibility', 'No main heading', 'No visible-in-markup H1 was found. Confirm the intended heading structure manually.', '' FROM x WHERE known AND page_id % 10 <> 0 AND page_id % 3 = 0
UNION ALL SELECT url, 'info', 'Accessibility', 'Multiple main headings', '2 H1 elements were observed. Multiple H1s are not automatically an accessibility failure.', '' FROM x WHERE known AND page_id % 3 = 2
UNION ALL SELECT url, 'review', 'Accessibility', 'Images missing alt', least(page_id % 8, page_id % 4) || ' images lack an alt attribute; empty alt is accepted for decorative images.' || cut, '' FROM x WHERE known AND least(page_id % 8, page_id % 4) > 0
UNION ALL SELECT url, 'review', 'Accessibility', 'Controls needing names', '2 form controls lack a name recognized by these static heuristics.' || cut, '' FROM x WHERE known AND page_id % 5 > 3
UNION ALL SELECT url, 'review', 'Accessibility', 'Links needing names', '1 links lack a name recognized by these static heuristics.' || cut, '' FROM x WHERE known AND page_id % 2 = 1
UNION ALL SELECT url, 'review', 'Accessibility', 'Buttons needing names', '1 buttons lack a name recognized by these static heuristics.' || cut, '' FROM x WHERE known AND page_id % 9 = 0
UNION ALL SELECT url, 'info', 'Indexability', 'Noindex declared', 'Captured robots directives include noindex. This may be intentional; it is not an error.', '' FROM x WHERE page_id % 7 = 0 OR page_id % 37 = 0
UNION ALL SELECT url, 'info', 'Indexability', 'Canonical points elsewhere', 'Review the captured canonical destination; a different canonical can be intentional.', canonical_url FROM x WHERE page_id % 4 = 0
UNION ALL SELECT url, 'review', 'Capture', 'Rendering incomplete', 'Timed out', '' FROM x WHERE page_id % 41 = 0
UNION ALL SELECT x.url, 'error', 'Links', 'Failed internal destinations', hit.n || ' distinct internal destinations returned captured HTTP errors. ' || s.sample || ' Unvisited URLs are not classified as broken.', '' FROM hit JOIN x USING (capture_seq) JOIN
  (SELECT h.capture_seq, string_agg('HTTP ' || status || ': ' || target, ' · ' ORDER BY pos) AS sample FROM (SELECT capture_seq, target, min(pos) AS pos FROM res WHERE {INSIDE.format('target')} GROUP BY 1, 2) h JOIN fail ON identity = target GROUP BY 1) s USING (capture_seq)
UNION ALL SELECT x.url, 'review', 'Content', 'Repeated title', g.size || ' captured pages share this case-sensitive, trimmed title.', r.related FROM g JOIN x USING (capture_seq) JOIN (SELECT a.capture_seq, min_by(c.url, b.capture_seq) AS related FROM t a JOIN t b ON a.k = b.k AND a.capture_seq <> b.capture_seq JOIN cap c ON c.capture_seq = b.capture_seq GROUP BY 1) r USING (capture_seq) WHERE g.size > 1
UNION ALL SELECT x.url, 'review', 'Content', 'Matching body text', '2 pages share the same complete whitespace-normalized body-text fingerprint. This is not a visual, semantic, or byte-for-byte HTML comparison.', y.url FROM x JOIN x y ON y.page_id - y.page_id % 2 = x.page_id - x.page_id % 2 AND y.page_id <> x.page_id)"""


@query("r_finding_rows", ROWS_SQL + " SELECT * FROM f")
def r_rows(spark, d):
    return fi.findings(captures(spark, d), errors(spark, d)).drop("capture_seq")


@query("a10_severity_counts", ROWS_SQL + " SELECT severity, category, count(*) AS n FROM f GROUP BY 1, 2")
def a10_severity(spark, d):
    return fi.findings(captures(spark, d), errors(spark, d)).groupBy("severity", "category").agg(F.count("*").alias("n"))


@query("l3_sort_findings", ROWS_SQL + " SELECT url, title, severity FROM f ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, category, url, title LIMIT 100")
def l3(spark, d):
    return fi.sort_findings(fi.findings(captures(spark, d), errors(spark, d))).select("url", "title", "severity").limit(100)


@query("j14_with_review", ROWS_SQL + " SELECT url, url IN (SELECT url FROM f WHERE severity <> 'info') AS review FROM cap")
def j14(spark, d):
    p = captures(spark, d)
    return fi.with_review(p, fi.findings(p, errors(spark, d)).where("severity != 'info'")).select("url", "review")


@query("d2_dataset_javascript", f"""{WITH} SELECT url AS "URL", CASE WHEN page_id % 3 = 0 THEN 'BROWSER' ELSE 'HTTP' END AS "Method", CASE WHEN page_id % 3 = 2 THEN 'Legacy HTTP' ELSE 'rendered' END AS "State", page_id * 7 % 500 AS "Raw words",
  CASE WHEN page_id % 3 = 0 THEN page_id * 7 % 500 + 10 END AS "Rendered words", CASE WHEN page_id % 3 = 0 THEN CAST(10 AS BIGINT) END AS "Word change", CASE WHEN page_id % 3 = 0 THEN CAST(floor(10 / (page_id * 7 % 500 + 10) * 100 + 0.5) AS BIGINT) END AS "Added text estimate %",
  CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "JS links", CAST(CASE WHEN page_id % 30 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "Metadata changes", CAST(CASE WHEN page_id % 3 = 2 THEN 0 ELSE page_id % 4 END AS INTEGER) AS "Console entries", CAST(CASE WHEN page_id % 3 = 2 THEN 0 ELSE page_id % 5 END AS INTEGER) AS "Resource errors",
  CASE WHEN page_id % 3 = 2 THEN '' ELSE 'idle' END AS "Settle state", CASE WHEN page_id % 3 = 2 THEN 'Saved before rendering analysis' WHEN page_id % 41 = 0 THEN 'Timed out' ELSE 'small text; app root' END AS "Reason" FROM cap""")
def d2(spark, d):
    n = F.col("page_id")
    p = captures(spark, d)
    facts = p.select("page_id", "url", F.col("word_count").alias("words"), F.col("outgoing_links").alias("links"), F.array().cast("array<string>").alias("images"), "title", "description", F.col("canonical_url").alias("canonical"), F.col("heading").alias("h1"), "robots").where("page_id % 3 = 0")
    new = facts.withColumn("words", F.col("words") + 10).withColumn("links", F.concat(F.slice("links", 2, 10), F.array(F.lit("https://site.example/new")))).withColumn("title", F.when(n % 10 == 0, "changed title").otherwise(F.col("title")))
    state = F.struct(F.when(n % 3 == 0, "browser").otherwise("http").alias("method"), F.lit("rendered").alias("status"), F.lit("idle").alias("settled"), F.col("render_failure").alias("failure"), F.array(F.lit("small text"), F.lit("app root")).alias("reasons"), (n % 4).cast("int").alias("console_errors"), (n % 5).cast("int").alias("network_errors"))
    return tables.dataset_javascript(p.withColumn("rendering", F.when(n % 3 != 2, state)), tables.compare_rendering(facts.drop("page_id"), new.drop("page_id")))


@query("j7_rendering_lists", f"""{WITH} SELECT c.url, 'added' AS side, 'https://site.example/x' || page_id AS value FROM cap c UNION ALL SELECT c.url, 'removed', t.target FROM cap c JOIN tgt t USING (capture_seq) WHERE t.pos = page_id % 4 AND t.target NOT IN (SELECT u.target FROM tgt u WHERE u.capture_seq = c.capture_seq AND u.pos <> page_id % 4)
UNION ALL SELECT c.url, 'title', coalesce(title, '') || '>' || coalesce(title, '') || '!' FROM cap c UNION ALL SELECT c.url, 'robots', robots || '>' FROM cap c WHERE robots <> ''""")
def j7_lists(spark, d):
    n = F.col("page_id")
    p = captures(spark, d)
    facts = p.select("page_id", "url", F.col("word_count").alias("words"), F.col("outgoing_links").alias("links"), F.array().cast("array<string>").alias("images"), "title", "description", F.col("canonical_url").alias("canonical"), F.col("heading").alias("h1"), "robots")
    k = (n % 4).cast("int")
    fewer = F.concat(F.slice("links", F.lit(1), k), F.slice("links", k + 2, F.lit(10)), F.array(F.concat(F.lit("https://site.example/x"), n.cast("string"))))
    new = facts.withColumn("links", fewer).withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).withColumn("robots", F.lit(None).cast("string"))
    out = tables.compare_rendering(facts.drop("page_id"), new.drop("page_id"))
    side = lambda c, name: F.transform(c, lambda x: F.struct(F.lit(name).alias("side"), x.alias("value")))
    changed = F.transform("metadata_changes", lambda m: F.struct(m["field"].alias("side"), F.concat(m["raw"], F.lit(">"), m["rendered"]).alias("value")))
    return out.select("url", F.explode(F.concat(side("added_links", "added"), side("removed_links", "removed"), changed)).alias("r")).select("url", "r.*")


@query("a12_depth_counts", f"{WITH} SELECT depth, count(*) AS count FROM cap GROUP BY depth")
def a12_depths(spark, d):
    return tables.depth_counts(captures(spark, d))


IMAGES = f"""{WITH}, i AS (SELECT page_id, url AS page, 'https://cdn.example/i/' || page_id % 10 || '.png' AS url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '' ELSE 'Picture ' || page_id % 4 END AS alt FROM pages)"""


def image_rows(spark, d):
    n = F.col("page_id")
    return pages(spark, d).select(
        n.alias("capture_seq"), "url", F.lit(0).alias("pos"), F.concat(F.lit("https://cdn.example/i/"), (n % 10).cast("string"), F.lit(".png")).alias("candidate"),
        F.when(n % 3 == 1, "").when(n % 3 == 2, F.concat(F.lit("Picture "), (n % 4).cast("string"))).alias("alt"), F.when(n % 6 == 5, (n % 4 * 100).cast("double")).alias("width"), F.lit(None).cast("double").alias("height"),
    )


@query("a12_insight_totals", f"{IMAGES} SELECT (SELECT CAST(sum(content_bytes) AS BIGINT) FROM cap) AS bytes, (SELECT CAST(list_sort(list(duration_ms) FILTER (WHERE duration_ms IS NOT NULL))[count(duration_ms) // 2 + 1] AS BIGINT) FROM cap) AS median_ms, (SELECT count(DISTINCT url) FROM i WHERE alt IS NULL) AS images_missing_alt")
def a12_totals(spark, d):
    rows = image_rows(spark, d)
    return tables.insight_totals(captures(spark, d), tables.image_catalogue(rows, rows.select("capture_seq", "url", F.col("candidate").alias("image"))))


@query("a14_image_rows", f"""{IMAGES}, p AS (SELECT url, page, min(page_id) AS s FROM i GROUP BY 1, 2), l AS (SELECT url, alt, min(page_id) AS s FROM i WHERE alt <> '' GROUP BY 1, 2)
SELECT i.url, (SELECT string_agg(page, ' ' ORDER BY s) FROM p WHERE p.url = i.url) AS sources, (SELECT coalesce(string_agg(alt, '|' ORDER BY s), '') FROM l WHERE l.url = i.url) AS alts, count(*) FILTER (WHERE alt IS NULL) AS missing, count(*) FILTER (WHERE alt = '') AS decorative, CAST(0 AS BIGINT) AS unknown,
  CAST(arg_min(CASE WHEN page_id % 6 = 5 THEN page_id % 4 * 100 END, CASE WHEN page_id % 6 = 5 THEN page_id END) AS DOUBLE) AS width, CAST(NULL AS DOUBLE) AS height, 'png' AS extension FROM i GROUP BY i.url""")
def a14_rows(spark, d):
    rows = image_rows(spark, d)
    out = tables.image_catalogue(rows, rows.select("capture_seq", "url", F.col("candidate").alias("image")))
    return tables.sort_catalogue(out.withColumn("sources", F.array_join("sources", " ")).withColumn("alts", F.array_join("alts", "|")))


@query("p5_filter_elements", f"{IMAGES} SELECT url, count(*) FILTER (WHERE alt IS NULL) AS missing FROM i GROUP BY url HAVING count(*) FILTER (WHERE alt IS NULL) > 0 AND contains(url, '/3')")
def p5(spark, d):
    rows = image_rows(spark, d)
    cat = tables.image_catalogue(rows, rows.select("capture_seq", "url", F.col("candidate").alias("image"))).drop("sources", "alts")
    return tables.filter_elements(cat, "/I/3", kind="missing").select("url", "missing")


@query("a15_link_sources", f"{WITH} SELECT target AS destination, url AS source, min(capture_seq) AS capture_seq FROM tgt JOIN cap USING (capture_seq) GROUP BY 1, 2")
def a15_sources(spark, d):
    return tables.catalogue_sources(links.link_rows(with_elements(captures(spark, d))), ["destination"], "source")


RES = "SELECT page_id, url, 'https://cdn.example/r' || page_id % 12 || '.js' AS resource, CASE WHEN page_id % 2 = 0 THEN 'script' ELSE 'stylesheet' END AS kind, 'type ' || page_id % 5 AS type FROM pages"


@query("a16_resource_catalogue", f"""WITH r AS ({RES}), p AS (SELECT kind, resource, url, min(page_id) AS s FROM r GROUP BY 1, 2, 3) SELECT kind, resource AS url, 'js' AS text, arg_min(type, page_id) AS detail, (SELECT string_agg(p.url, ' ' ORDER BY s) FROM p WHERE p.kind = r.kind AND p.resource = r.resource) AS sources FROM r GROUP BY kind, resource""")
def a16(spark, d):
    n = F.col("page_id")
    rows = pages(spark, d).select(n.alias("capture_seq"), F.lit(0).alias("pos"), "url", F.when(n % 2 == 0, "script").otherwise("stylesheet").alias("kind"), F.concat(F.lit("https://cdn.example/r"), (n % 12).cast("string"), F.lit(".js")).alias("resource"), F.concat(F.lit("type "), (n % 5).cast("string")).alias("type"))
    return tables.resource_catalogue(rows).withColumn("sources", F.array_join("sources", " "))


@query("a19_capture_quality", "SELECT count(*) FILTER (WHERE page_id % 6 = 5) AS legacy_pages, count(*) FILTER (WHERE page_id % 6 <> 5 AND page_id % 10 = 0) AS truncated_pages FROM pages")
def a19(spark, d):
    return tables.capture_quality(captures(spark, d).withColumnRenamed("accessibility", "elements"))


@query("a22_render_console", """SELECT coalesce(r.url, c.url) AS url, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(bytes, 0) AS bytes, coalesce(n, 0) AS console_entries FROM (SELECT user_id AS url, count(*) AS requests, count(*) FILTER (WHERE event_id % 500 >= 400) AS errors, CAST(coalesce(sum(CASE WHEN event_id % 3 > 0 THEN length(props) END), 0) AS BIGINT) AS bytes FROM events WHERE event_type <> 'click' GROUP BY user_id) r
FULL JOIN (SELECT user_id AS url, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) c ON c.url = r.url""")
def a22_console(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("url"), F.lit(None).cast("string").alias("error"), (n % 500).alias("status"), (n % 3 == 0).alias("cached"), F.length("props").alias("body_bytes"), "event_type")
    return tables.render_totals(rows.where("event_type != 'click'"), rows.where("event_type = 'click'"))


@query("a26_mean_rate", "SELECT user_id, floor(count(*) / greatest(1.0, sum(event_id % 900) / 1000) * 10 + 0.5) / 10 AS mean_rate FROM events GROUP BY user_id")
def a26_rate(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.sum(F.col("event_id") % 900).alias("duration_ms"))
    return merge.mean_rate(runs).select("user_id", "mean_rate")


@query("a01_run_summary_whole", f"{WITH} SELECT count(*) AS pages, (SELECT count(*) FROM err) AS failed, (SELECT count(DISTINCT target) FROM tgt WHERE {INSIDE.format('target')}) AS internal_links, (SELECT count(DISTINCT target) FROM tgt WHERE NOT {INSIDE.format('target')}) AS external_links, (SELECT count(DISTINCT page_id % 10) FROM pages) AS image_urls, (SELECT count(*) FROM pages WHERE page_id % 4 = 0) AS scheduled, true AS stopped, true AS limit_reached FROM cap")
def a01_whole(spark, d):
    p = with_method(captures(spark, d))
    decisions = pages(spark, d).select(F.when(F.col("page_id") % 9 == 0, "page_limit").otherwise("duplicate").alias("reason"))
    return merge.run_summary(p, errors(spark, d), pages(spark, d).where("page_id % 4 = 0"), decisions, stopped=True)


@query("p1_filter_pages_each", f"""{WITH} SELECT url, w AS which FROM cap, (VALUES ('all'), ('browser'), ('http'), ('render-failed'), ('sitemap'), ('external'), ('no-external')) v(w)
WHERE CASE w WHEN 'all' THEN true WHEN 'browser' THEN page_id % 3 = 0 WHEN 'http' THEN page_id % 3 <> 0 WHEN 'render-failed' THEN page_id % 41 = 0 WHEN 'sitemap' THEN page_id % 8 = 0 WHEN 'external' THEN true ELSE false END""")
def p1_each(spark, d):
    p, out = with_method(captures(spark, d)), None
    for which in ("all", "browser", "http", "render-failed", "sitemap", "external", "no-external"):
        rows = tables.filter_pages(p, "", which).select("url", F.lit(which).alias("which"))
        out = rows if out is None else out.unionByName(rows)
    return out


RUNS = "SELECT user_id AS id, 'Run ' || user_id % 7 AS name, ['completed', 'running', 'failed', 'stopped'][CAST(user_id % 4 AS INTEGER) + 1] AS status, count(*) AS pages, count(*) FILTER (WHERE event_type = 'purchase') AS failures, CAST(min(event_id) AS VARCHAR) AS started_at FROM events GROUP BY user_id"


def runs_of(spark, d):
    n = F.col("user_id")
    status = F.get(F.array(*map(F.lit, ("completed", "running", "failed", "stopped"))), (n % 4).cast("int"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("pages"), F.count_if(F.col("event_type") == "purchase").alias("failures"), F.min("event_id").cast("string").alias("started_at"))
    return rows.select(n.alias("id"), F.concat(F.lit("Run "), (n % 7).cast("string")).alias("name"), status.alias("status"), "pages", "failures", "started_at", F.lit("https://site.example/").alias("start_url"))


@query("p7_filter_runs", f"WITH r AS ({RUNS}) SELECT id, w AS which FROM r, (VALUES ('all'), ('completed'), ('active'), ('attention')) v(w) WHERE contains(lower(name), 'run 3') AND CASE w WHEN 'all' THEN true WHEN 'completed' THEN status = 'completed' WHEN 'active' THEN status = 'running' ELSE failures > 0 OR status IN ('failed', 'stopped') END")
def p7(spark, d):
    runs, out = runs_of(spark, d), None
    for which in ("all", "completed", "active", "attention"):
        rows = tables.filter_runs(runs, "RUN 3", which).select("id", F.lit(which).alias("which"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("l10_sort_runs", f"WITH r AS ({RUNS}) (SELECT id, 'name' AS o FROM r ORDER BY name, id LIMIT 50) UNION ALL (SELECT id, 'pages' FROM r ORDER BY pages DESC, id LIMIT 50) UNION ALL (SELECT id, 'date' FROM r ORDER BY started_at DESC, id LIMIT 50)")
def l10(spark, d):
    runs, out = runs_of(spark, d), None
    for by in ("name", "pages", "date"):
        rows = tables.sort_runs(runs, by).limit(50).select("id", F.lit(by).alias("o"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("p9_project", f"{WITH} SELECT url, title, depth FROM cap")
def p9(spark, d):
    return tables.project(captures(spark, d), ["depth", "title", "url", "secret", "title"], ["url", "title", "status_code", "depth"])


@query("p10_search_pages", f"{WITH} SELECT url FROM cap WHERE contains(url, '/g3/') OR contains('https://site.example/i/' || page_id % 10 || '.png', '/g3/') OR contains(lower(coalesce(title, '')), '/g3/') ORDER BY capture_seq LIMIT 12")
def p10(spark, d):
    return tables.search_pages(with_method(captures(spark, d)), "/G3/").select("url")


@query("p11_page_inventory_rows", f"""{WITH} SELECT url, CASE WHEN coalesce(title, '') = '' THEN heading ELSE title END AS title, status_code AS status, CASE WHEN page_id % 3 = 0 THEN 'browser' ELSE 'http' END AS method, page_id * 7 % 500 AS words, depth, CASE WHEN page_id % 8 = 0 THEN 'seed' ELSE CAST(depth AS VARCHAR) END AS depth_label, CAST(5 AS INTEGER) AS internal, CAST(1 AS INTEGER) AS external, duration_ms AS duration FROM cap""")
def p11_rows(spark, d):
    return tables.page_inventory(with_method(captures(spark, d)))


SORTS = ("url", "title", "status", "method", "words", "depth", "duration")


@query("l1_sort_pages_each", f"""{WITH}, p AS (SELECT url, CASE WHEN coalesce(title, '') = '' THEN heading ELSE title END AS title, status_code AS status, CASE WHEN page_id % 3 = 0 THEN 'browser' ELSE 'http' END AS method, page_id * 7 % 500 AS words, depth, duration_ms AS duration FROM cap) """ + " UNION ALL ".join(f"SELECT '{k}' AS key, url, row_number() OVER (ORDER BY {k} DESC NULLS LAST, url) - 1 AS ord FROM p" for k in SORTS))
def l1_each(spark, d):
    p, out = tables.page_inventory(with_method(captures(spark, d))), None
    for k in SORTS:
        ordered = tables.sort_pages(p, k, desc=True).select("url", k)
        # the place of each row in the operator's order
        rows = ordered.select("url", F.monotonically_increasing_id().alias("at")).transform(lambda x: windows.number_rows(x, ["at"])).select(F.lit(k).alias("key"), "url", "ord")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("l2_sort_dataset", "SELECT event_id, row_number() OVER (ORDER BY event_id % 17 DESC, event_id) - 1 AS ord FROM events")
def l2(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", n.alias("ord"), F.concat(F.lit("Page "), (n % 17).cast("string")).alias("Name"))
    ordered = tables.sort_dataset(rows, "Name", desc=True)
    return windows.number_rows(ordered.select("event_id", F.monotonically_increasing_id().alias("at")), ["at"], "place").select("event_id", F.col("place").alias("ord"))


@query("l4_rank_pages_each", f"""{WITH}, inc AS (SELECT target, count(DISTINCT capture_seq) AS n FROM res WHERE {INSIDE.format('target')} GROUP BY target)
SELECT c.url, coalesce(title, '') AS title, CAST(duration_ms AS BIGINT) AS duration, CAST(page_id * 7 % 500 AS BIGINT) AS words, CAST(coalesce(n, 0) AS BIGINT) AS incoming, row_number() OVER (ORDER BY duration_ms DESC NULLS LAST, c.url) - 1 AS by_duration FROM cap c LEFT JOIN inc ON inc.target = c.url""")
def l4_each(spark, d):
    p = captures(spark, d)
    metrics = fi.page_metrics(p, fi.findings(p, errors(spark, d)))
    ranked = fi.rank_pages(metrics, "duration").withColumn("at", F.monotonically_increasing_id())
    return windows.number_rows(ranked, ["at"], "by_duration").select("url", "title", "duration", "words", "incoming", "by_duration")


@query("w6_budget_that_skips", """WITH RECURSIVE e AS (SELECT user_id, event_id, length(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, size <= 100 AS fits, CASE WHEN size <= 100 THEN size ELSE 0 END AS used FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, f.used + e.size <= 100, CASE WHEN f.used + e.size <= 100 THEN f.used + e.size ELSE f.used END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, event_id FROM f WHERE fits""")
def w6_skip(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return windows.running_budget(rows, "size", 100, ["user_id"], ["event_id"], skip=True).select("user_id", "event_id")


@query("w10_waterfall_rows", "SELECT event_id, event_id % 100 / e AS start_share, user_id % 50 / e AS duration_share FROM (SELECT *, greatest(1, max(event_id % 100 + user_id % 50) OVER (PARTITION BY user_id)) AS e FROM events)")
def w10_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("page"), (F.col("event_id") % 100).alias("start_ms"), (F.col("user_id") % 50).alias("duration_ms"))
    return windows.waterfall(rows).select("event_id", "start_share", "duration_share")


@query("w3_cap_candidates", "SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 500")
def w3(spark, d):
    return frontier.cap_candidates(table(spark, d, "documents"), 500, ["n_chars", "doc_id"]).select("doc_id")


@query("j11_with_evidence", f"{WITH} SELECT url, 'evidence ' || page_id AS notes FROM cap WHERE page_id % 4 = 0")
def j11(spark, d):
    p = captures(spark, d).select("url", F.sha2("url", 256).alias("artifact_id"), "page_id")
    return merge.with_evidence(p.drop("page_id"), p.where("page_id % 4 = 0").select("artifact_id", F.concat(F.lit("evidence "), F.col("page_id").cast("string")).alias("notes"))).select("url", "notes")


@query("j12_recorded_images", "SELECT DISTINCT 'https://cdn.example/i/' || page_id % 30 || '.png' AS url FROM pages WHERE page_id % 30 < 12")
def j12(spark, d):
    at = lambda k: F.concat(F.lit("https://cdn.example/i/"), (F.col("page_id") % k).cast("string"), F.lit(".png"))
    p = pages(spark, d)
    return merge.recorded_images(p.select(at(30).alias("url")).distinct(), p.select(F.array(at(10)).alias("candidates")), p.select(at(12).alias("image")))


@query("o2_set_delta_values", "SELECT user_id, unnest(list_filter(list_distinct(list(event_type)), lambda x: x <> 'click')) AS value FROM events GROUP BY user_id")
def o2_values(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).withColumn("b", F.array(F.lit("click")))
    return rows.select("user_id", F.explode(tables.set_delta("a", "b")).alias("value"))


@query("o4_duplicate_text_rows", f"{WITH} SELECT c.capture_seq, CAST(2 AS BIGINT) AS size, y.url AS related FROM cap c JOIN cap y ON y.page_id - y.page_id % 2 = c.page_id - c.page_id % 2 AND y.page_id <> c.page_id")
def o4(spark, d):
    return fi.duplicate_text(captures(spark, d)).select("capture_seq", "size", "related")


@query("a08_duplicate_text_groups", "SELECT fp AS content_fingerprint, count(*) AS size FROM (SELECT 'sha256-text-v1:' || sha256(text) AS fp FROM documents WHERE length(text) BETWEEN 1 AND 2097151) GROUP BY fp HAVING count(*) > 1")
def a08_groups(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("capture_seq"), F.col("doc_id").cast("string").alias("url"), text.content_fingerprint(F.col("text")).alias("content_fingerprint"))
    return fi.duplicate_text(docs).select("content_fingerprint", "size").distinct()


@query("d5_sitemap_indexability", f"""{WITH} SELECT url AS "URL", CASE WHEN page_id % 2 = 1 THEN CASE WHEN page_id % 7 = 0 THEN 'noindex declared' ELSE 'No noindex observed' END WHEN page_id % 7 = 0 OR page_id % 37 = 0 THEN 'noindex declared' ELSE 'No noindex observed' END AS "Indexability", CASE WHEN page_id % 2 = 0 THEN 'https://site.example/sitemap.xml' ELSE '' END AS "Sitemap", CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '' END AS "Lastmod" FROM cap""")
def d5_index(spark, d):
    p = captures(spark, d)
    listed = p.where("page_id % 2 = 0").select("url", F.lit("https://site.example/sitemap.xml").alias("sitemap"), F.lit("2024-01-01").alias("lastmod"), *[F.lit("").alias(c) for c in ("changefreq", "priority")])
    return sitemaps.dataset_sitemaps(p, errors(spark, d), listed, ROOT).select("URL", "Indexability", "Sitemap", "Lastmod")


@query("k7_issue_rows", f"""{WITH}, {FAILED} SELECT 'HTTP / Network' AS "Category", CASE WHEN kind = 'non-html' THEN 'info' ELSE 'error' END AS "Severity", CASE WHEN coalesce(status_code, 0) <> 0 THEN 'HTTP ' || status_code || ' · ' || CASE WHEN kind = 'non-html' THEN 'Not an HTML page' ELSE 'Request failed' END ELSE CASE WHEN kind = 'network' THEN 'Connection failed' ELSE kind END || ' · Could not read page' END AS "Issue", url AS "URL", message AS "Evidence" FROM err""")
def k7(spark, d):
    return sinks.issue_rows(fi.issues(captures(spark, d), errors(spark, d))).where("Category = 'HTTP / Network'")


def _issue(name: str, where: str, before: str = "''", rows: str = "cap") -> str:
    title, said, severity = fi.ISSUES[name]
    return f"SELECT '{title}' AS t, {before} || '{said}' AS e, url, '{severity}' AS s FROM {rows} WHERE {where}"


#: Every rule on pages, with console entries on pages by number and a rule error on each ninth.
ISSUE_SQL = " UNION ALL ".join([
    _issue("rendering", "page_id % 41 = 0", "'Timed out'"), _issue("console", "page_id % 4 > 0", "(page_id % 4)"), _issue("requests", "page_id % 20 = 0", "1"), _issue("structured", "page_id % 5 = 1"),
    _issue("noindex", "page_id % 7 = 0 OR page_id % 37 = 0"), _issue("title", "trim(coalesce(title, '')) = ''"), _issue("heading", "page_id % 12 = 0"), _issue("description", "page_id % 3 > 0"),
    _issue("rule", "page_id % 9 = 0", "('field ' || page_id % 3 || ': no match')"),
    _issue("repeated", "n > 1", "n", "(SELECT url, count(*) OVER (PARTITION BY trim(title)) AS n FROM cap WHERE trim(title) <> '')"),
])


@query("k7_issue_rows_all", f"""{WITH}, {FAILED}, failed AS (SELECT CASE WHEN coalesce(status_code, 0) <> 0 THEN 'HTTP ' || status_code || ' · ' || CASE WHEN kind = 'non-html' THEN 'Not an HTML page' ELSE 'Request failed' END ELSE CASE WHEN kind = 'network' THEN 'Connection failed' ELSE kind END || ' · Could not read page' END AS t, message AS e, url, CASE WHEN kind = 'non-html' THEN 'info' ELSE 'error' END AS s FROM err)
SELECT CASE WHEN t LIKE 'JavaScript · %' THEN 'JavaScript' WHEN t LIKE 'Resources · %' THEN 'Resources' WHEN t LIKE 'Structured data · %' THEN 'Structured data' WHEN t LIKE 'Custom extraction · %' THEN 'Custom extraction' WHEN t LIKE 'Indexability · %' THEN 'Indexability'
  WHEN t LIKE '% · %' THEN 'HTTP / Network' WHEN t LIKE '%heading%' THEN 'Content' ELSE 'Metadata' END AS "Category", s AS "Severity", t AS "Issue", url AS "URL", e AS "Evidence" FROM (SELECT t, e, url, s FROM failed UNION ALL {ISSUE_SQL})""")
def k7_all(spark, d):
    n = F.col("page_id")
    error = F.when(n % 9 == 0, F.array(F.concat(F.lit("field "), (n % 3).cast("string"), F.lit(": no match"))))
    return sinks.issue_rows(fi.issues(captures(spark, d).withColumns({"console_errors": n % 4, "extraction_errors": error}), errors(spark, d)))


#: Texts by page number: nested and mixed types, depth, strings that look like objects, long lists, order of keys, trailing text.
JSON_TEXTS = r"""case page_id % 5
  when 0 then concat('{"@graph":[{"@type":"', host, '","n":1},{"@type":["Person","Agent",7]}],"@type":"Thing"}')
  when 1 then concat(repeat('{"x":', cast(page_id % 16 as int)), '{"@type":"', host, '"}', repeat('}', cast(page_id % 16 as int)))
  when 2 then concat('{"a":"{\\"@type\\":\\"No\\"}","@type":"', host, '"}')
  when 3 then concat('[', array_join(transform(sequence(1, page_id % 130 + 1), i -> concat('{"@type":"T', i, '"}')), ','), ']')
  else concat('{"z":{"@type":"Z"},"a":{"@type":"', host, '"}}', if(page_id % 10 = 4, ' tail', ' ')) end"""


@query("f33_jsonld_types", r"""SELECT page_id, page_id % 10 <> 4 AS valid, CASE page_id % 5 WHEN 0 THEN 'Thing,' || host || ',Person,Agent' WHEN 1 THEN CASE WHEN page_id % 16 <= 12 THEN host ELSE '' END WHEN 2 THEN host
  WHEN 3 THEN array_to_string(['T' || i for i in range(1, least(page_id % 130 + 1, 40) + 1)], ',') ELSE CASE WHEN page_id % 10 = 4 THEN '' ELSE 'Z,' || host END END AS types FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def f33(spark, d):
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    texts = hosts.select("page_id", F.expr(JSON_TEXTS).alias("text"))
    return with_jsonld_types(texts, "text").select("page_id", is_json(F.col("text")).alias("valid"), F.array_join("types", ",").alias("types"))


@query("e11_structured_rows", f"""{WITH} SELECT page_id, 0 AS pos, 'json-ld' AS format, CASE WHEN page_id % 5 = 0 THEN 'Article,Person,Agent' ELSE '' END AS types, page_id % 5 = 0 AS valid, CASE WHEN page_id % 5 = 1 THEN 'invalid JSON' END AS error,
  CASE WHEN page_id % 5 = 0 THEN '{{"@type":"Article","author":{{"@type":["Person","Agent"]}}}}' END AS value FROM ep WHERE page_id % 5 < 2""")
def e11_rows(spark, d):
    return structured_rows(parsed(spark, d), "page_id").withColumn("types", F.array_join("types", ","))


@query("k7_page_rows", f"""{WITH} SELECT url AS "URL", title AS "Title", status_code AS "Status", CASE WHEN page_id % 3 = 0 THEN 'browser' ELSE 'http' END AS "Method", page_id * 7 % 500 AS "Words", depth AS "Depth", duration_ms AS "Duration_ms" FROM cap""")
def k7_pages(spark, d):
    return sinks.page_rows(with_method(captures(spark, d)))


@query("j15_select_rows", f"{WITH} SELECT url FROM cap WHERE page_id % 5 = 0")
def j15(spark, d):
    p = captures(spark, d)
    return tables.select_rows(p, p.where("page_id < 10"), p.where("page_id % 5 = 0").select("url")).select("url")


@query("g7_expand_origin_sitemaps", ORIGIN_SITEMAPS)
def g7_origins(spark, d):
    return origin_sitemaps(spark, d)


@query("e24_parse_errors", "SELECT page_id, page_id % 7 = 0 AS failed FROM pages")
def e24(spark, d):
    def extractor(html, url):
        if html.startswith("broken"):
            raise ValueError("no page")
        return {"title": url}

    rows = pages(spark, d).withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("broken"), "html")).otherwise(F.col("html")))
    return parse_pages(rows, extractor=extractor).select("page_id", F.col("parse_error").isNotNull().alias("failed"))
