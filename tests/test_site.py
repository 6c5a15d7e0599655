"""Operators over captured pages: exact rows of small sites."""

from pyspark.sql import functions as F

from sitegrain.cluster import checkpoints
from sitegrain.functions import http, text, urls
from sitegrain.operators import frontier, graph, links, robots, tables, windows
from sitegrain.operators.parse import parse_pages
from sitegrain.sources import captures as sources


def one(spark, col, value, type_="string"):
    return spark.createDataFrame([(value,)], f"c {type_}").select(col(F.col("c")).alias("r")).first().r


def test_scalar_functions(spark):
    assert one(spark, urls.normalize_url, "https://h.example") == "https://h.example/"
    assert one(spark, urls.normalize_url, "https://U:p@h.example/") is None
    assert one(spark, urls.strip_tracking, "https://h/p?a&utm_x=1&b=c%20d") == "https://h/p?a=&b=c+d"
    assert one(spark, urls.strip_tracking, "https://h/p?a&b=c%20d") == "https://h/p?a&b=c%20d"
    assert one(spark, urls.path_group, "nonsense") == "(other)"
    assert one(spark, text.natural_key, "page-10") > one(spark, text.natural_key, "page-9")
    assert one(spark, text.clean_text and (lambda c: text.clean_text(c, 9)), " a  b﻿") == "a b"
    assert [one(spark, http.is_public_ip, x) for x in ("8.8.8.8", "10.0.0.1", "192.0.2.1", "2001:db8::1", "2606:4700::1", "fe80::1")] == [True, False, False, False, True, False]
    assert one(spark, http.raster_type, bytearray(b"\x89PNG\r\n\x1a\n0000"), "binary") == "image/png"


def site(spark):
    rows = [
        (0, "https://s.example/", "https://s.example/", ["https://s.example/a", "https://s.example/old", "https://s.example/x"]),
        (1, "https://s.example/a", "https://s.example/a", ["https://s.example/b#z", "https://s.example/a"]),
        (2, "https://s.example/b", "https://s.example/old", ["https://far.example/"]),
    ]
    return spark.createDataFrame(rows, "capture_seq long, url string, requested_url string, outgoing_links array<string>").withColumn("internal_links", F.filter("outgoing_links", lambda u: u.startswith("https://s.")))


def test_aliases_edges_degrees_and_routes(spark):
    checkpoints(spark)
    e = graph.edges(site(spark)).cache()
    assert {(r.source[-1], r.target[-1]) for r in e.collect()} == {("/", "a"), ("/", "b"), ("/", "x"), ("a", "b"), ("a", "a"), ("b", "/")}
    assert {r.id: (r.inbound, r.outbound) for r in graph.degrees(e).collect()}["https://s.example/b"] == (2, 1)
    route = graph.shortest_route(e, "https://s.example/a", "https://far.example/")
    assert [r.id for r in route.orderBy("step").collect()] == ["https://s.example/a", "https://s.example/b", "https://far.example/"]
    assert graph.shortest_route(e, "https://far.example/", "https://s.example/").count() == 0
    assert {r.identity: r.incoming for r in links.incoming(site(spark)).collect()}["https://s.example/b"] == 2


def test_replay_order_of_reasons(spark):
    checkpoints(spark)
    found, skipped = frontier.replay_crawl(site(spark), "https://s.example/", max_depth=2, max_pages=3)
    assert [(r.url[18:], r.depth, r.state) for r in found.orderBy("depth", "url").collect()] == [("", 0, "fetched"), ("a", 1, "fetched"), ("old", 1, "missing")]
    assert {r.reason: r["count"] for r in frontier.skip_counts(skipped).collect()} == {"page_limit": 2, "duplicate": 1}


def test_budgets(spark):
    rows = spark.createDataFrame([(1, 1, 6), (1, 2, 6), (1, 3, 3)], "k int, seq int, size long")
    assert [r.seq for r in windows.running_budget(rows, "size", 10, ["k"], ["seq"]).collect()] == [1]
    assert [r.seq for r in windows.running_budget(rows, "size", 10, ["k"], ["seq"], skip=True).collect()] == [1, 3]


def test_html_gate_and_parse_errors(spark):
    rows = spark.createDataFrame([("https://h/", "text/html; charset=x", "<p>a"), ("https://h/f", "application/pdf", "")], "url string, content_type string, html string")
    pages, errors = sources.html_gate(rows)
    assert [r.doc.first_paragraph for r in parse_pages(pages).collect()] == ["a"]
    assert [r.kind for r in errors.collect()] == ["non-html"]

    def broken(html, url):
        raise ValueError("no")

    r = parse_pages(pages, extractor=broken).first()
    assert r.doc is None and "ValueError" in r.parse_error


def test_pages_and_selection(spark):
    rows = spark.range(45).select(F.format_string("u%03d", "id").alias("url"))
    p = tables.page_of(rows, ["url"], 9, 20).collect()
    assert [r.url for r in p] == [f"u{i:03d}" for i in range(40, 45)] and p[0].pages == 3
    assert tables.select_rows(rows, rows.limit(1), spark.createDataFrame([("u044",), ("gone",)], "url string")).count() == 1


def test_run_digest_ignores_timings(spark):
    checkpoints(spark)
    a = spark.createDataFrame([("u", "h", 1), ("v", "h", 2)], "url string, heading string, duration_ms int")
    none = spark.createDataFrame([], "url string, kind string")
    d = lambda df: tables.run_digest(df, none).first().digest
    assert d(a) == d(a.withColumn("duration_ms", F.lit(9)).orderBy(F.desc("url"))) != d(a.withColumn("heading", F.lit("other")))


def test_replay_reasons_of_links_before_and_after_the_budget_is_full(spark):
    from sitegrain.cluster import checkpoints

    checkpoints(spark)
    at = "https://x.example/"
    links = [f"{at}q?{i}" for i in range(4)] + [f"{at}z?{i}" for i in range(4)]
    store = spark.createDataFrame([(at, links)], "url string, outgoing_links array<string>")
    found, skipped = frontier.replay_crawl(store, at, max_depth=2, max_pages=4, max_variants=2)
    assert sorted(r.url for r in found.collect()) == [at, f"{at}q?0", f"{at}q?1", f"{at}z?0"]
    assert {r.url: r.reason for r in skipped.collect()} == {f"{at}q?2": "query_limit", f"{at}q?3": "query_limit", f"{at}z?1": "page_limit", f"{at}z?2": "page_limit", f"{at}z?3": "page_limit"}


def test_replay_of_a_deep_chain(spark):
    at = lambda i: f"https://x.example/{i}"
    store = spark.createDataFrame([(at(i), [at(i + 1), at(0)]) for i in range(14)], "url string, outgoing_links array<string>")
    found, skipped = frontier.replay_crawl(store, at(0), max_depth=9)
    assert sorted((r.depth, r.url) for r in found.collect()) == [(i, at(i)) for i in range(10)]
    assert sorted((r.reason, r.depth) for r in skipped.collect()) == sorted([("duplicate", i) for i in range(1, 11)] + [("depth_limit", 10)])


def test_robots_patterns_take_no_longer_with_many_wildcards(spark):
    import re
    import time

    patterns = ["/", "/a", "/a*b", "/*b", "/a**c*", "/*", "/ab*ab", "/*a*b*", "/x.y", "/[a]*"]
    paths = ["/", "/a", "/ab", "/aab", "/abab", "/xb", "/acb", "/abc", "/x.y", "/xzy", "/[a]b"]
    rows = spark.createDataFrame([(p, q, e) for p in paths for q in patterns for e in (True, False)], "path string, pattern string, e boolean")
    got = rows.withColumn("ok", robots.pattern_matches("path", "pattern", "e")).collect()
    for r in got:
        regex = ".*".join(map(re.escape, r.pattern.split("*"))) + ("$" if r.e else "")
        assert r.ok == bool(re.match(regex, r.path)), r
    text = "User-agent: *\nDisallow: /" + "*a" * 200 + "*b$"
    urls = spark.createDataFrame([("https://x.example/" + "a" * 5000,)], "url string")
    began = time.monotonic()
    rules = robots.robots_rules(spark.createDataFrame([("https://x.example", text)], "origin string, text string"))
    assert robots.robots_allowed(urls, rules, "bot").first().allowed and time.monotonic() - began < 30


def test_an_over_long_robots_rule_closes_its_origin_only(spark):
    texts = spark.createDataFrame([("https://x.example", "User-agent: *\nDisallow: /" + "a" * 5000), ("https://y.example", "User-agent: *\nDisallow: /a")], "origin string, text string")
    urls = spark.createDataFrame([("https://x.example/b",), ("https://y.example/b",), ("https://y.example/a",)], "url string")
    rules = robots.robots_rules(texts)
    assert {r.url: r.allowed for r in robots.robots_allowed(urls, rules, "bot").collect()} == {"https://x.example/b": False, "https://y.example/b": True, "https://y.example/a": False}


def test_budget_that_skips(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([4, 9, 5, 2, 1])] + [("b", 0, 11), ("b", 1, 10)], "k string, i long, size long")
    kept = windows.running_budget(rows, "size", 10, ["k"], ["i"], skip=True).collect()
    assert sorted((r.k, r.i) for r in kept) == [("a", 0), ("a", 2), ("a", 4), ("b", 1)]


def test_effective_start_moves_only_by_canonical_transitions(spark):
    rows = [("http://x.example/", 301, "https://x.example/"), ("https://x.example/", 301, "https://www.x.example/home"), ("https://www.x.example/home", 200, None), ("https://y.example/", 302, "https://z.example/"), ("https://z.example/", 200, None), ("https://q.example/", 301, None)]
    responses = spark.createDataFrame(rows, "url string, status int, location string")
    seeds = spark.createDataFrame([("http://x.example/",), ("https://y.example/",), ("https://q.example/",), ("https://z.example/",)], "url string")
    out = {r.seed: (r.effective_start_url, r.error) for r in frontier.effective_start(responses, seeds).collect()}
    assert out == {"http://x.example/": ("https://www.x.example/home", None), "https://y.example/": ("https://y.example/", "out-of-scope"), "https://q.example/": ("https://q.example/", "missing-location"), "https://z.example/": ("https://z.example/", None)}


#: Addresses and their normal form.
NORMAL = [
    ("HTTP://Host.Example:80/a/../b?Q=1#f", "http://host.example/b?Q=1"), ("https://h", "https://h/"), ("ftp://h/", None), ("https://u:p@h/", None), ("https://@h/", "https://h/"),
    ("http://a/?", "http://a/?"), ("http://a/é?ü='x'", "http://a/%C3%A9?%C3%BC=%27x%27"), ("http://bücher.example/", "http://xn--bcher-kva.example/"),
    ("http://例え.テスト/", "http://xn--r8jz45g.xn--zckzah/"), ("http://☃.net/😀", "http://xn--n3h.net/%F0%9F%98%80"), ("http://127.1/", "http://127.0.0.1/"), ("http://0x7f.1", "http://127.0.0.1/"),
    ("http://256.256.256.256/", None), ("http://1.2.3.4.5/", None), ("http://[::1]/", "http://[::1]/"), ("http://[2001:db8:0:0:1:0:0:1]:8080/", "http://[2001:db8::1:0:0:1]:8080/"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"), ("http://[1:2]/", None), ("http://a b/", None), ("http://ex%41mple.com/x", "http://example.com/x"),
    (" \thttp:\\\\h\\a\\..\\b ", "http://h/b"), ("http:h/x", "http://h/x"), ("http://h:0080/", "http://h/"), ("http://h:65536/", None), ("http://h:/x", "http://h/x"),
    ("http://h/a/%2e%2E/b/.", "http://h/b/"), ("http://h/..", "http://h/"), ("http://h/a{b}`c", "http://h/a%7Bb%7D%60c"), ("http://h/a?{}`\"<>", "http://h/a?{}`%22%3C%3E"),
    ("javascript:x", None), ("/x", None), ("", None), (None, None), ("http://", None), ("https://h/p?x=%zz", "https://h/p?x=%zz"), ("https://a.example/b/./c", "https://a.example/b/c"),
]
#: References, base elements, pages and what they lead to.
RESOLVED = [
    ("a", None, "http://h/x/y?q", "http://h/x/a"), ("../a", None, "http://h/x/y/z", "http://h/x/a"), ("?z", None, "http://h/x/y?q", "http://h/x/y?z"), ("#z", None, "http://h/x/y?q", "http://h/x/y?q"),
    ("//k/a", None, "https://h/", "https://k/a"), ("/a", None, "http://h:81/x", "http://h:81/a"), ("http:a", None, "http://h/x/y", "http://h/x/a"), ("http:a", None, "https://h/x/y", "http://a/"),
    ("mailto:x", None, "http://h/", None), ("\\a", None, "http://h/x", "http://h/a"), ("/é", None, "https://f.example/p", "https://f.example/%C3%A9"), ("x", None, "nope", None),
    ("https://z/", None, "nope", "https://z/"), ("1:2", None, "http://h/x/y", "http://h/x/1:2"), ("a", "s/", "http://h/x/y", "http://h/x/s/a"), ("a", "ftp://q/", "http://h/x/y", "http://h/x/a"), (" ", None, "http://h/", None),
]


def test_addresses(spark):
    got = spark.createDataFrame(NORMAL, "c string, want string").select("c", "want", urls.normalize_url(F.col("c")).alias("got"))
    assert got.where("not (got <=> want)").collect() == []
    got = spark.createDataFrame(RESOLVED, "c string, base string, page string, want string").withColumn("got", urls.resolve_url(F.col("c"), F.col("base"), F.col("page")))
    assert got.where("not (got <=> want)").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_addresses_where_executors_lack_the_package(tmp_path):
    """Queries over addresses run from another folder, where workers can't import the package."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.path.insert(0, {str(Path(__file__).parents[1])!r})\n" + (
        "from pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local-cluster[1,2,1024]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "s.sparkContext.setLogLevel('ERROR')\n"
        "print(*(len(e.queries()[n](s, '/root/testdata/sf0.001').collect()) for n in ('f01_normalize_url', 'f02_resolve_url', 'j1_robots_allowed')))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert all(int(n) > 0 for n in done.stdout.split()[-3:]) and len(done.stdout.split()) >= 3, done.stderr[-2000:]
