"""Replay of a crawl: how often the store is read, and robots rules that are broken, double or silent about a page."""

from sitegrain.cluster import checkpoints
from sitegrain.operators import frontier, robots

AT = "https://s.example/n"


def counted(df, reads):
    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema)


def test_store_is_read_once(spark):
    checkpoints(spark)
    reads = spark.sparkContext.accumulator(0)
    store = counted(spark.createDataFrame([(f"{AT}{i}", [f"{AT}{2 * i + 1}", f"{AT}{2 * i + 2}", f"{AT}{i}"]) for i in range(15)], "url string, outgoing_links array<string>"), reads)
    rules = robots.robots_rules(spark.createDataFrame([("https://s.example", "User-agent: *\nDisallow: /n*5")], "origin string, text string"))
    found, skipped = frontier.replay_crawl(store, f"{AT}0", max_depth=3, rules=rules)
    assert {r.url for r in found.collect()} == {f"{AT}{i}" for i in range(15) if i not in (5, 11, 12)}
    assert [(r.url, r.depth, r.parent) for r in skipped.where("reason = 'robots'").collect()] == [(f"{AT}5", 2, [1])]
    assert reads.value == 15


def test_verdicts_by_origin(spark):
    texts = [("https://a.example", "User-agent: *\nDisallow: /p\nAllow: /p/q"), ("https://b.example", f"User-agent: *\nAllow: /\nDisallow: /{'x' * 5000}")]
    rules = robots.robots_rules(spark.createDataFrame(texts, "origin string, text string"))
    urls = [f"https://{h}.example/{p}" for h in "abc" for p in ("p", "p/q", "z")]
    rows = spark.createDataFrame([(u,) for u in urls] * 2 + [(None,)], "url string")
    got = [(r.url, r.allowed) for r in robots.robots_allowed(rows, rules, "bot").collect()]
    want = {u: u.startswith("https://c") or u in ("https://a.example/p/q", "https://a.example/z") for u in urls}
    assert sorted(got, key=str) == sorted([*list(want.items()) * 2, (None, True)], key=str)


def test_order_where_the_budget_cuts(spark):
    checkpoints(spark)
    store = spark.createDataFrame([(f"{AT}0", [f"{AT}{i}" for i in (4, 2, 3, 1)])], "url string, outgoing_links array<string>")
    found, skipped = frontier.replay_crawl(store, f"{AT}0", max_pages=3)
    assert {r.url for r in found.where("depth = 1").collect()} == {f"{AT}4", f"{AT}2"}
    assert {(r.url, r.reason) for r in skipped.collect()} == {(f"{AT}3", "page_limit"), (f"{AT}1", "page_limit")}
