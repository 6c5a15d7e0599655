"""The link graph: edges, nodes, degrees, neighbourhoods, routes, path hierarchy."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.cluster import checkpoints
from sitegrain.functions.urls import path_group, path_label, path_segments, url_identity, url_origin
from sitegrain.joins import skew_join
from sitegrain.operators.links import aliases, resolve_alias


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) identities of all links, aliases resolved; what has no origin is dropped, self-edges stay."""
    checkpoints(pages.sparkSession)
    # both are read again by the joins and by their search for hot keys
    links = pages.select(F.col("url").alias("source"), F.explode("outgoing_links").alias("target")).distinct().checkpoint()
    table = aliases(pages).checkpoint()
    out = resolve_alias(resolve_alias(links, "target", table).checkpoint(), "source", table)
    return out.where(url_origin(F.col("target")).isNotNull()).select("source", "target").distinct()


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(id, inbound, outbound) over distinct edges, self-edges counted on both sides; one shuffle for both."""
    ends = edge_rows.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edge_rows.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").cast("long").alias("inbound"), F.sum("o").cast("long").alias("outbound"))


def known_urls(pages: DataFrame, errors: DataFrame, edge_rows: DataFrame, sitemap: DataFrame, root: str) -> DataFrame:
    """(id, state, depth, status, title) of every known address: a page before an error before a link's target before a sitemap's entry."""
    table = aliases(pages)
    rank = lambda df, n: df.withColumn("rank", F.lit(n).cast("long"))
    own = pages.select(F.col("url").alias("id"), F.lit("page").alias("state"), F.col("depth").cast("long").alias("depth"), F.coalesce("status_code", F.lit(0)).cast("long").alias("status"), F.coalesce(F.nullif("title", F.lit("")), "heading", F.lit("")).alias("title"), F.col("capture_seq").alias("seq"))
    bad = errors.select(F.col("url").alias("id"), F.lit("error").alias("state"), F.lit(-1).cast("long").alias("depth"), F.coalesce("status_code", F.lit(0)).cast("long").alias("status"), F.col("kind").alias("title"), F.col("error_seq").alias("seq"))
    outside = url_origin(F.col("target")) != url_origin(F.lit(root))
    far = edge_rows.select(F.col("target").alias("id"), F.when(outside, "external").otherwise("discovered").alias("state")).distinct()
    listed = sitemap.select(F.col("url").alias("id"), F.lit("discovered").alias("state"))
    plain = lambda df: df.withColumn("depth", F.lit(-1).cast("long")).withColumn("status", F.lit(0).cast("long")).withColumn("title", F.lit("")).withColumn("seq", F.lit(0).cast("long"))
    every = rank(own, 0).unionByName(rank(bad, 1)).unionByName(rank(plain(far), 2)).unionByName(rank(plain(listed), 3))
    checkpoints(pages.sparkSession)
    every = resolve_alias(every.checkpoint(), "id", table)
    best = every.groupBy("id").agg(F.min_by(F.struct("state", "depth", "status", "title"), F.struct("rank", "seq")).alias("b"))
    return best.select("id", "b.*")


def nodes(pages: DataFrame, errors: DataFrame, edge_rows: DataFrame, sitemap: DataFrame, root: str) -> DataFrame:
    """Known addresses with path, group, degrees, how a page was rendered (null for other addresses), and what sitemaps say.

    A page that only a sitemap led to has no depth (-1).
    """
    table = aliases(pages)
    known = known_urls(pages, errors, edge_rows, sitemap, root)
    method = F.col("method") if "method" in pages.columns else F.lit(None).cast("string")
    by_sitemap = (F.col("discovery") == "sitemap") if "discovery" in pages.columns else F.lit(False)
    own = pages.select(url_identity(F.col("url")).alias("id"), "capture_seq", F.coalesce(method, F.lit("http")).alias("rendering"), F.coalesce(by_sitemap, F.lit(False)).alias("by_sitemap"))
    # of several captures of an address the last gives the rendering, and any of them that it came from a sitemap
    own = own.groupBy("id").agg(F.max_by("rendering", "capture_seq").alias("rendering"), F.max("by_sitemap").alias("by_sitemap"))
    listed = resolve_alias(sitemap.select(F.col("url").alias("id")), "id", table).distinct().withColumn("sitemap", F.lit(True))
    is_root = F.col("id") == url_identity(F.lit(root))
    out = known.join(degrees(edge_rows).hint("merge"), "id", "left").join(listed.hint("merge"), "id", "left").join(own.hint("merge"), "id", "left")
    unknown = F.lit(-1).cast("long")
    inbound = F.coalesce("inbound", F.lit(0))
    return out.select(
        "id", F.coalesce(path_label(F.col("id")), "id").alias("path"), F.when(F.col("state") == "external", "external").otherwise(path_group(F.col("id"))).alias("group"),
        "state", F.when(F.col("by_sitemap"), unknown).otherwise(F.coalesce("depth", unknown)).alias("depth"), "status", "title", inbound.cast("long").alias("inbound"), F.coalesce("outbound", F.lit(0)).cast("long").alias("outbound"),
        is_root.alias("root"), "rendering", F.coalesce("sitemap", F.lit(False)).alias("sitemap"), (F.coalesce("sitemap", F.lit(False)) & (inbound == 0) & ~is_root).alias("sitemap_only"),
    )


def neighbourhood(edge_rows: DataFrame, focus: str) -> DataFrame:
    """(id) of a node and all that one edge in either direction reaches."""
    out = edge_rows.where(F.col("source") == focus).select(F.col("target").alias("id"))
    back = edge_rows.where(F.col("target") == focus).select(F.col("source").alias("id"))
    return out.union(back).union(edge_rows.sparkSession.createDataFrame([(focus,)], "id string")).distinct()


def top_hubs(node_rows: DataFrame, n: int = 6) -> DataFrame:
    return node_rows.where("state = 'page'").orderBy(F.desc("inbound"), "id").limit(n)


def filter_nodes(node_rows: DataFrame, states: list[str], group: str = "", query: str = "", sitemap_only: bool = False, rendering: str = "", focus: str = "", edge_rows: DataFrame | None = None) -> DataFrame:
    """By state, rendering, membership of sitemaps only, group, text in address or title, and nearness to a node (which needs the edges)."""
    out = node_rows.where(F.col("state").isin(*states))
    out = out.where(F.col("rendering") == rendering) if rendering else out
    out = out.join(neighbourhood(edge_rows, focus).hint("merge"), "id", "left_semi") if focus else out
    out = out.where(F.col("group") == group) if group else out
    out = out.where("sitemap_only") if sitemap_only else out
    return out.where(F.lower(F.concat_ws(" ", "id", "title")).contains(query.lower())) if query else out


def filter_paths(node_rows: DataFrame, query: str = "", pages_only: bool = True) -> DataFrame:
    """Nodes of the path tree: none of other sites, with or without those that are no pages, by text in address or title."""
    out = node_rows.where("state = 'page'" if pages_only else "state != 'external'")
    return out.where(F.lower(F.concat_ws(" ", "id", "title")).contains(query.lower())) if query else out


def top_groups(counts: DataFrame, n: int = 9) -> DataFrame:
    """The first bars of a distribution (name, count): most first, then by name."""
    return counts.orderBy(F.desc("count"), "name").limit(n)


def graph_subset(node_rows: DataFrame, edge_rows: DataFrame, focus: str = "", limit: int = 500, most_edges: int = 3000) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` first nodes by focus, root, inbound and id, and the first edges among them but for self-edges."""
    near = node_rows.join(neighbourhood(edge_rows, focus), "id", "left_semi") if focus else node_rows
    top = near.orderBy((F.col("id") == focus).desc(), F.desc("root"), F.desc("inbound"), "id").limit(min(500, max(1, limit)))
    ids = top.select("id")
    among = edge_rows.where("source != target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return top, among.orderBy("source", "target").limit(most_edges)


#: Rounds that one job takes while a round has few nodes, and how many are few.
ROUNDS_A_JOB, FEW_NODES = 4, 1000


def only_ways(edge_rows: DataFrame) -> DataFrame:
    """(id, above, top, span): nodes that one edge alone leads to, its source, and the first node upwards that is no such node, ``span`` edges up.

    Found by pointer doubling, in a logarithmic number of joins. What lies on or behind a ring of such nodes is in reach of none and is left out.
    """
    one = edge_rows.groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("above")).where("n = 1").select(F.col("target").alias("id"), "above").checkpoint()
    ends = skew_join(one.select("id", "above", F.col("above").alias("top")), one.select(F.col("id").alias("top"), F.lit(True).alias("more")), "top", "left")
    up = ends.select("id", "above", "top", F.lit(1).alias("span"), F.col("more").isNull().alias("done")).checkpoint()
    left = up.where("not done").count()
    while left:
        step = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("span").alias("by"), F.col("done").alias("end"))
        on = skew_join(up.where("not done"), step, "top").select("id", "above", F.col("next").alias("top"), (F.col("span") + F.col("by")).alias("span"), F.col("end").alias("done"))
        up = up.where("done").unionByName(on).checkpoint()
        before, left = left, up.where("not done").count()
        if left == before:  # rings
            break
    return up.where("done").drop("done")


def route_tree(edge_rows: DataFrame, root: str, until: str | None = None) -> DataFrame:
    """(id, parent, level): a breadth-first tree over all nodes in reach of ``root``, or over the levels up to that of ``until``.

    A node's parent is the smallest of those one level above. Nodes that one edge alone leads to, as in chains of pages, take no round: they lie a known
    number of levels below others (``only_ways``), between which edges have that number as their length. A round goes on from all nodes whose level fell,
    so there are at most as many rounds as levels. A job takes one round, or up to ROUNDS_A_JOB where they are small, and jobs are cut by checkpoints.
    """
    spark = edge_rows.sparkSession
    edge_rows = edge_rows.select("source", "target").where((F.col("source") != F.col("target")) & (F.col("target") != root)).distinct().checkpoint()
    ways = only_ways(edge_rows)
    single = edge_rows.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select("target")
    many = skew_join(edge_rows, single, "target").select("source", "target").checkpoint()
    near = skew_join(many, ways.select(F.col("id").alias("source"), "top", "span"), "source", "left")
    long = near.select(F.coalesce("top", "source").alias("source"), "target", (F.coalesce("span", F.lit(0)) + 1).alias("length")).where("source != target").groupBy("source", "target").agg(F.min("length").alias("length"))
    # edges lie by their source, as each round's nodes do after they are grouped, so a round is one shuffle
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(n, "source").sortWithinPartitions("source").checkpoint()
    # levels beyond that of ``until`` are not gone into
    at = ways.where(F.col("id") == until).select("top", "span").first() if until is not None else None
    goal, below = (at.top, at.span) if at else (until, 0)
    frontier = spark.createDataFrame([(root, 0)], "id string, level int").checkpoint()
    reached, most, steps = frontier, None, 1
    for job in itertools.count(1):
        part = frontier.withColumn("fresh", F.lit(True))
        for _ in range(steps):
            step = part.join(long.hint("merge"), (F.col("id") == F.col("source")) & F.col("fresh"), "left")
            own, child = F.struct("id", "level", F.col("level").alias("was")), F.struct(F.col("target").alias("id"), (F.col("level") + F.col("length")).alias("level"), F.lit(None).cast("int").alias("was"))
            both = step.select(F.explode(F.array(own, child)).alias("x")).select("x.*").where("id is not null")
            part = both.groupBy("id").agg(F.min("level").alias("level"), F.min("was").alias("was")).select("id", "level", (F.col("was").isNull() | (F.col("level") < F.col("was"))).alias("fresh"))
        old = reached.groupBy("id").agg(F.min("level").alias("old"))
        new = part.join(old.hint("merge"), "id", "left").where("old is null or level < old").select("id", "level", "fresh").checkpoint()
        reached = reached.unionByName(new.select("id", "level"))
        if until is not None and (hit := reached.where(F.col("id") == goal).agg(F.min("level").alias("level")).first().level) is not None:
            most = hit + below
        frontier = new.where("fresh").select("id", "level") if most is None else new.where(F.col("fresh") & (F.col("level") < most)).select("id", "level")
        if not frontier.take(1):
            break
        if job % 8 == 0:  # one table again
            reached = reached.groupBy("id").agg(F.min("level").alias("level")).checkpoint()
        steps = min(2 * steps, ROUNDS_A_JOB) if frontier.limit(FEW_NODES + 1).count() <= FEW_NODES else 1
    top = reached.groupBy(F.col("id").alias("top")).agg(F.min("level").alias("at"))
    lower = skew_join(ways, top, "top").select("id", F.col("above").alias("parent"), (F.col("at") + F.col("span")).alias("level"))
    lower = lower.checkpoint()
    levels = lower.select(F.col("id").alias("source"), "level").unionByName(top.select(F.col("top").alias("source"), F.col("at").alias("level"))).checkpoint()
    # the least level above, and the smallest node there
    best = skew_join(many, levels, "source").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("level", "source")).alias("b"))
    upper = best.select("id", F.col("b.source").alias("parent"), (F.col("b.level") + 1).alias("level"))
    first = spark.createDataFrame([(root, None, 0)], "id string, parent string, level int")
    tree = first.unionByName(lower).unionByName(upper)
    return (tree if most is None else tree.where(F.col("level") <= most)).checkpoint()


def routes(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, id): the route to each target (id) that is in the tree, the root first, read off by pointer doubling.

    After k rounds a node points 2 ** k levels up, and a route's known part doubles, so a route of n steps takes log n joins.
    """
    top = tree.agg(F.max("level")).first()[0] or 0
    up = tree.where("parent is not null").select("id", F.col("parent").alias("above")).checkpoint()
    known = targets.select("id").distinct().join(tree.select("id", "level").hint("merge"), "id").select(F.col("id").alias("target"), F.col("level").alias("step"), "id").checkpoint()
    span = 1
    while span <= top:
        more = known.join(up.hint("merge"), "id").select("target", (F.col("step") - span).alias("step"), F.col("above").alias("id"))
        known = known.unionByName(more).checkpoint()
        up = up.join(up.select(F.col("id").alias("above"), F.col("above").alias("next")).hint("merge"), "above").select("id", F.col("next").alias("above")).checkpoint()
        span *= 2
    return known.select("target", "step", "id")


def shortest_route(edge_rows: DataFrame, root: str, target: str) -> DataFrame:
    """(step, id) of a shortest directed route; no rows if the target is out of reach, one row from a node to itself."""
    wanted = edge_rows.sparkSession.createDataFrame([(target,)], "id string")
    return routes(route_tree(edge_rows, root, target), wanted).select("step", "id")


def hop_levels(edge_rows: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(id, level): the least number of edges from any root (id), up to ``hops``; levels are joins, cut by a checkpoint each."""
    reached = roots.select("id", F.lit(0).alias("level")).distinct()
    frontier = reached
    for level in range(1, hops + 1):
        step = edge_rows.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        reached = reached.unionByName(frontier)
    return reached


def path_groups(pages: DataFrame) -> DataFrame:
    return pages.groupBy(path_group(F.col("url")).alias("name")).agg(F.count("*").alias("count"))


def path_tree(node_rows: DataFrame) -> DataFrame:
    """(path, count): how many addresses lie at or below each path prefix, all levels; ``/`` has them all."""
    parts = path_segments(F.col("id"))
    prefixes = F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.when(F.size(parts) >= i, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))))
    return node_rows.where("state != 'external'").select(F.explode(F.array_compact(prefixes)).alias("path")).groupBy("path").agg(F.count("*").alias("count"))


def neighbours_in_order(pages: DataFrame, order: list[str]) -> DataFrame:
    """Each page's predecessor and successor, position and total in an order, by global numbers rather than one window."""
    from sitegrain.operators.windows import number_rows

    numbered = number_rows(pages.select("url", *[c for c in order if c != "url"]), order)
    side = lambda shift, name: numbered.select((F.col("ord") + shift).alias("ord"), F.col("url").alias(name))
    total = numbered.agg(F.count("*").alias("total"))
    return numbered.join(side(1, "previous"), "ord", "left").join(side(-1, "next"), "ord", "left").crossJoin(F.broadcast(total)).select("url", "previous", "next", (F.col("ord") + 1).alias("position"), "total")


