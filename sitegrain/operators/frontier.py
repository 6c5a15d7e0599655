"""Replay of a bounded crawl over captured pages, and redirect chains over captured responses.

Order is (depth, parent's position, link's position), as with one worker. Every level is a few joins over all its
links at once and is checkpointed, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.urls import canonical_transition, in_scope, normalize_url, url_identity, url_origin, url_path
from sitegrain.operators.robots import robots_allowed, robots_verdicts

REASONS = ("invalid_url", "out_of_scope", "duplicate", "depth_limit", "robots", "page_limit", "query_limit")


def cap_query_variants(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most ``n`` distinct addresses per origin and path, by order."""
    w = Window.partitionBy(url_origin(F.col("url")), url_path(F.col("url"))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cap_candidates(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of an order: a top-k, not a global window."""
    return rows.orderBy(*order).limit(n)


def replay_crawl(store: DataFrame, seed: str, max_depth: int = 3, max_pages: int = 1000, max_variants: int = 100, prefix: str = "", rules: DataFrame | None = None, agent: str = "bot") -> tuple[DataFrame, DataFrame]:
    """(frontier, decisions) of a store (url, outgoing_links).

    frontier: url, depth, state (``fetched`` where the store has the page, else ``missing``). decisions: url, depth, reason, parent, link of every
    skipped link, by the first reason that applies in the order of ``REASONS``; parent and link are its place in its level. A skipped address is
    not remembered as seen. A page's position is the list of the places of the links that led to it, one for each level.
    """
    spark = store.sparkSession
    origin = url_origin(F.lit(seed))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # addresses are put in normal form once, and pages lie by them, so that a level shuffles its own rows only
    links = store.select(url_identity(F.col("url")).alias("url"), "outgoing_links").repartition(n, "url").sortWithinPartitions("url").checkpoint()
    rules = None if rules is None else rules.checkpoint()
    level = spark.createDataFrame([(seed, [])], "url string, pos array<int>").select(normalize_url(F.col("url")).alias("url"), "pos", F.lit(0).alias("depth"))
    level = level.withColumn("o", url_origin(F.col("url"))).withColumn("p", url_path(F.col("url"))).checkpoint()
    accepted, skipped, taken = level, None, 1
    for depth in range(1, max_depth + 2):
        found = level.join(links.hint("merge"), "url").select(F.col("pos").alias("parent"), F.posexplode("outgoing_links").alias("link", "raw"))
        found = found.select("parent", "link", "raw", normalize_url(F.col("raw")).alias("to"))
        seen = accepted.select(F.col("url").alias("to"), F.lit(True).alias("seen"))
        found = found.join(seen.hint("merge"), "to", "left")
        # the first of equal links of a level is the candidate; later ones are duplicates if it is accepted
        w = Window.partitionBy("to").orderBy("parent", "link")
        found = found.withColumn("again", F.row_number().over(w) > 1)
        early = (
            F.when(F.col("to").isNull(), "invalid_url").when(~in_scope(F.col("to"), origin, F.lit(prefix)), "out_of_scope").when(F.col("seen"), "duplicate").when(F.lit(depth > max_depth), "depth_limit")
        )
        found = found.withColumn("reason", early)
        found = found.checkpoint()
        if rules is not None:
            # the rules are asked about a level's rows as they are written, not about what leads to them
            verdict = robots_verdicts(found.where("reason is null and not again").select(F.col("to").alias("url")), rules, agent).select(F.col("url").alias("to"), "allowed")
            found = found.join(verdict.hint("merge"), "to", "left").withColumn("reason", F.when(F.col("reason").isNull() & ~F.coalesce("allowed", F.lit(True)), "robots").otherwise(F.col("reason"))).checkpoint()
        left = max(0, max_pages - taken)
        fresh = found.where("reason is null and not again").select(F.col("to").alias("url"), "parent", "link")
        known = accepted.groupBy("o", "p").agg(F.count("*").alias("have"))
        fresh = fresh.withColumn("o", url_origin(F.col("url"))).withColumn("p", url_path(F.col("url"))).join(known.hint("merge"), ["o", "p"], "left")
        nth = F.row_number().over(Window.partitionBy("o", "p").orderBy("parent", "link")) + F.coalesce("have", F.lit(0))
        new = fresh.withColumn("nth", nth).where(F.col("nth") <= max_variants)
        level = new.select("url", F.array_append("parent", F.col("link")).alias("pos"), F.lit(depth).alias("depth"), "o", "p").checkpoint()
        count = level.count()
        if count > left:  # only then is there an order to cut at
            level = level.orderBy("pos").limit(left).checkpoint()
            count = left
        # the budget is full after the link that took its last place; what comes later is not tried for its variants
        full = F.lit(left == 0)
        if count and count >= left:
            last = level.agg(F.max("pos").alias("at")).first().at
            full = F.array_append("parent", F.col("link")) > F.array(*[F.lit(x) for x in last])
        marked = found.join(level.select(F.col("url").alias("to"), F.lit(True).alias("ok")).hint("merge"), "to", "left")
        reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("ok"), F.when(F.col("again"), "duplicate")).when(full, "page_limit").otherwise("query_limit")
        dropped = marked.select(F.coalesce("to", "raw").alias("url"), F.lit(depth).alias("depth"), reason.alias("reason"), "parent", "link").where("reason is not null")
        skipped = dropped if skipped is None else skipped.unionByName(dropped)
        if not count:
            break
        accepted, taken = accepted.unionByName(level), taken + count
    have = links.select("url").distinct().withColumn("state", F.lit("fetched"))
    frontier = accepted.select("url", "depth").join(have.hint("merge"), "url", "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    return frontier, skipped


def skip_counts(decisions: DataFrame) -> DataFrame:
    """Encounters of each reason, not distinct addresses."""
    return decisions.groupBy("reason").agg(F.count("*").alias("count"))


def robots_excluded(decisions: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` links that robots rules excluded, in the order in which they were met."""
    return decisions.where("reason = 'robots'").orderBy("depth", "parent", "link").limit(most).select("url")


def frontier_links(raw: Column, rendered: Column, most: int = 2000) -> Column:
    """The links that a rendered page puts to the frontier: its own, then those of the raw page, each once, in order."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(rendered, F.array().cast("array<string>")), F.coalesce(raw, F.array().cast("array<string>")))), 1, most)


REDIRECTS = (301, 302, 303, 307, 308)


def _steps(responses: DataFrame) -> DataFrame:
    """(url, to, more): where each captured redirect leads."""
    step = responses.where(F.col("status").isin(*REDIRECTS)).select("url", F.col("location").alias("to")).dropDuplicates(["url"])
    return step.withColumn("more", F.lit(True)).hint("merge")


def resolve_redirects(responses: DataFrame, max_hops: int = 5, rules: DataFrame | None = None, agent: str = "bot") -> DataFrame:
    """(requested_url, url, hops, error) of responses (url, status, location): each followed over at most ``max_hops`` captured redirects.

    Errors: ``loop``, ``missing-location``, ``out-of-scope`` (another origin), ``robots`` (a target that ``rules`` exclude) and ``too-many``. Hops are
    self-joins; finished chains leave the join.
    """
    step = _steps(responses)
    going = responses.select(F.col("url").alias("requested_url"), "url", F.array("url").alias("visited"), F.lit(0).alias("hops"))
    done = None
    for _ in range(max_hops + 1):
        at = going.join(step, "url", "left").withColumn("allowed", F.lit(True))
        if rules is not None:
            verdict = robots_allowed(at.where("to is not null").select(F.col("to").alias("url")).distinct(), rules, agent)
            at = at.drop("allowed").join(verdict.select(F.col("url").alias("to"), "allowed").hint("merge"), "to", "left")
        error = (
            F.when(F.col("to").isNull(), "missing-location").when(F.array_contains("visited", F.col("to")), "loop")
            .when(url_origin(F.col("to")) != url_origin(F.col("requested_url")), "out-of-scope").when(~F.coalesce("allowed", F.lit(True)), "robots").when(F.col("hops") >= max_hops, "too-many")
        )
        at = at.withColumn("error", F.when(F.col("more"), error)).checkpoint()
        ended = at.where("more is null or error is not null").select("requested_url", "url", "hops", "error")
        done = ended if done is None else done.unionByName(ended)
        going = at.where("more and error is null").select("requested_url", F.col("to").alias("url"), F.array_append("visited", F.col("to")).alias("visited"), (F.col("hops") + 1).alias("hops"))
    return done


def redirect_duplicates(resolved: DataFrame, order: DataFrame) -> DataFrame:
    """(requested_url, url): requests, in the order (requested_url, ord), that end at an address which an earlier one reached."""
    ends = resolved.where("error is null").join(order.hint("merge"), "requested_url")
    first = ends.groupBy("url").agg(F.min("ord").alias("first"))
    return ends.join(first.hint("merge"), "url").where("ord > first").select("requested_url", "url")


def effective_start(responses: DataFrame, seeds: DataFrame, prefix: str = "", max_hops: int = 5) -> DataFrame:
    """(seed, effective_start_url, error) of seeds (url): redirects are followed within an origin, and to another one only
    by a canonical transition, which moves the scope there. The effective address is the last one that moved it, else the seed."""
    step = _steps(responses)
    going = seeds.select(F.col("url").alias("seed"), "url", F.col("url").alias("effective_start_url"), F.lit(0).alias("hops"))
    done = None
    for _ in range(max_hops + 1):
        at = going.join(step, "url", "left")
        to, url = F.col("to"), F.col("url")
        moves = (url_origin(to) != url_origin(url)) & canonical_transition(url, to) & in_scope(to, url_origin(to), F.lit(prefix))
        error = F.when(to.isNull(), "missing-location").when(~in_scope(to, url_origin(url), F.lit(prefix)) & ~moves, "out-of-scope").when(F.col("hops") >= max_hops, "too-many")
        at = at.withColumn("moves", moves).withColumn("error", F.when(F.col("more"), error)).checkpoint()
        ended = at.where("more is null or error is not null").select("seed", "effective_start_url", "error")
        done = ended if done is None else done.unionByName(ended)
        going = at.where("more and error is null").select("seed", F.col("to").alias("url"), F.when(F.col("moves"), F.col("to")).otherwise(F.col("effective_start_url")).alias("effective_start_url"), (F.col("hops") + 1).alias("hops"))
    return done
