"""Sitemap discovery against a plain queue, and entries of odd XML."""

import random

import pytest
from pyspark.sql import functions as F

from sitegrain.cluster import checkpoints
from sitegrain.operators import sitemaps

O = "https://h.example"  # noqa: E741


def queue_walk(files, seeds):
    """Files in order, and who owns which address."""
    queue, visited, seen, i = list(dict.fromkeys([*seeds, f"{O}/sitemap.xml"])), [], {}, 0
    while i < len(queue) and len(visited) < 16:
        u, i = queue[i], i + 1
        if not u.startswith(O + "/") or u in visited:
            continue
        visited.append(u)
        kind, listed = files.get(u, ("", []))
        if kind == "index":
            for c in listed[:32]:
                if c not in visited and len(queue) < 100:
                    queue.append(c)
        elif kind == "urlset":
            for c in listed:
                seen.setdefault(c, u)
    return visited, seen


def text(kind, listed):
    root, one = ("sitemapindex", "sitemap") if kind == "index" else ("urlset", "url")
    return f"<{root}>" + "".join(f"<{one}><loc>{c}</loc></{one}>" for c in listed) + f"</{root}>"


def run(spark, files, seeds):
    checkpoints(spark)
    store = spark.createDataFrame([(u, text(*f)) for u, f in files.items()] or [("x", "")], "sitemap_url string, text string")
    given = spark.createDataFrame([(O, u, i) for i, u in enumerate(seeds)], "origin string, url string, pos int")
    got = sitemaps.expand_sitemaps(store, given).collect()
    names = [r.sitemap for r in sitemaps.sitemap_files(store, given).orderBy("n").collect()]
    return names, {r.url: r.sitemap for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_queue(spark, seed):
    r = random.Random(seed)
    names = [f"{O}/s{i}.xml" for i in range(30)] + [f"{O}/sitemap.xml"]
    files = {}
    for u in r.sample(names, 26) + [f"{O}/sitemap.xml"]:
        index = r.random() < 0.7
        files[u] = ("index", [r.choice(names) for _ in range(r.choice([2, 5, 40]))]) if index else ("urlset", [f"{O}/p{r.randint(0, 30)}" for _ in range(6)])
    seeds = [r.choice([*names, "https://far.example/s.xml"]) for _ in range(r.randint(1, 5))]
    assert run(spark, files, seeds) == queue_walk(files, seeds)


def test_chain_of_eight(spark):
    files = {f"{O}/sitemap.xml": ("index", [f"{O}/1.xml"])} | {f"{O}/{i}.xml": ("index", [f"{O}/{i + 1}.xml"]) for i in range(1, 7)} | {f"{O}/7.xml": ("urlset", [f"{O}/page"])}
    assert run(spark, files, [f"{O}/sitemap.xml"])[1] == {f"{O}/page": f"{O}/7.xml"}


def test_odd_xml(spark):
    rows = [
        ("a", f"<?xml version='1.0'?><!-- x --><urlset xmlns='u' xmlns:i='i'><!-- <url><loc>{O}/no</loc></url> --><url><i:image><i:loc>{O}/i</i:loc></i:image><loc> {O}/a?x=1&amp;y=2 </loc><lastmod>2026</lastmod></url><url/><url><loc><![CDATA[{O}/b]]></loc></url></urlset>"),
        ("b", f"<urlset><url><loc>{O}/x</loc></url><url><loc>broken</urlset>"), ("c", f"<html><url><loc>{O}/x</loc></url></html>"), ("d", f"<!DOCTYPE x><urlset><url><loc>{O}/x</loc></url></urlset>"),
        ("e", ""), ("f", "<urlset/>"), ("g", f"<urlset><url><loc>https://far.example/</loc></url><url><loc>https://u:p@h.example/</loc></url><url><loc>{O}/ok</loc></url></urlset>"),
    ]
    df = spark.createDataFrame([(f"{O}/{n}.xml", t) for n, t in rows], "sitemap_url string, text string")
    got = {(r.sitemap[-5:], r.pos, r.url[len(O) :], r.lastmod) for r in sitemaps.sitemap_entries(df).where(F.col("kind") == "urlset").collect()}
    assert got == {("a.xml", 0, "/a?x=1&y=2", "2026"), ("a.xml", 2, "/b", ""), ("g.xml", 2, "/ok", "")}


def test_the_pattern_leaves_long_files_alone(spark):
    from sitegrain.sources.captures import SITEMAP_MOST, usable_sitemaps

    ends = ["<!doctype x>", "<urlset>", "<!entity", "<!-- DOCTYPE -->"]
    rows = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate([(e, n) for e in ends for n in (0, SITEMAP_MOST - len(e), SITEMAP_MOST - len(e) + 1)])] + [(99, None, 0)], "id int, e string, n int")
    texts = rows.select("id", F.concat("e", F.expr("repeat('é', n)")).alias("text"))
    assert sorted(r.id for r in usable_sitemaps(texts).collect()) == [3, 4, 9, 10]
    plan = usable_sitemaps(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("length(") < plan.index("RLIKE")
