"""robots.txt as tables: rules, and which addresses they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.urls import normalize_url, url_origin, url_path
from sitegrain.joins import hot_keys, skew_join

LONGEST_RULE = 4096
TOO_LONG = "robots.txt rule exceeds the supported length"


def octets(c: Column) -> Column:
    """A pattern or path with unreserved escapes decoded, other escapes in upper case, and non-ASCII percent-encoded."""
    # One escape or character at a time; url_encode covers what is not ASCII.
    parts = F.regexp_extract_all(c, F.lit(r"(%[0-9A-Fa-f]{2}|[\s\S])"), F.lit(1))
    code = lambda p: F.conv(F.substring(p, 2, 2), 16, 10).cast("int")
    one = lambda p: (
        F.when(p.rlike("^%.."), F.when(F.char(code(p)).rlike("^[A-Za-z0-9._~-]$"), F.char(code(p))).otherwise(F.upper(p)))
        .when(p.rlike(r"[^\x21-\x7e]|[\"<>\\^`{|}]"), F.when(p == " ", "%20").otherwise(F.url_encode(p)))
        .otherwise(p)
    )
    return F.array_join(F.transform(parts, one), "")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, grp, agent, allow, pattern, end, length, delay_ms) of texts (origin, text): one row per agent and rule; a null pattern stands for an agent without rules.

    Consecutive agent lines share a group. ``length`` counts no ``*`` and an escape as one. A rule that is too
    long may not be ignored: its pattern is null and ``error`` says so, and ``robots_allowed`` allows nothing of its origin.
    """
    lines = robots.select("origin", F.posexplode(F.split(F.regexp_replace("text", "^\\x{FEFF}", ""), "\r?\n")).alias("pos", "raw"))
    line = F.btrim(F.split_part("raw", F.lit("#"), F.lit(1)))
    kv = lines.select("origin", "pos", line.alias("line")).where(F.instr("line", ":") > 0).select(
        "origin", "pos", F.lower(F.btrim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.btrim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")
    )
    w = Window.partitionBy("origin").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    kv = kv.withColumn("grp", F.sum(starts.cast("int")).over(w)).where("grp > 0")
    agents = kv.where("key = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent")).distinct()
    delay = kv.where(r"key = 'crawl-delay' and value rlike '^\\d+(\\.\\d+)?$'").groupBy("origin", "grp").agg(F.max(F.col("value").cast("double") * 1000).cast("long").alias("delay_ms"))
    rules = kv.where("key in ('allow', 'disallow') and startswith(value, '/')").select("origin", "grp", "pos", (F.col("key") == "allow").alias("allow"), octets(F.col("value")).alias("rule"))
    long = F.length("rule") > LONGEST_RULE
    rules = rules.withColumn("error", F.when(long, TOO_LONG)).withColumn("rule", F.when(~long, F.col("rule")))
    end = F.col("rule").endswith("$")
    rules = rules.select("origin", "grp", "error", "allow", F.when(end, F.expr("left(rule, length(rule) - 1)")).otherwise(F.col("rule")).alias("pattern"), end.alias("end"))
    rules = rules.withColumn("length", F.length(F.regexp_replace(F.replace("pattern", F.lit("*"), F.lit("")), "%[0-9A-Fa-f]{2}", "x")))
    return agents.join(rules.hint("merge"), ["origin", "grp"], "left").join(delay.hint("merge"), ["origin", "grp"], "left").withColumn("delay_ms", F.coalesce("delay_ms", F.lit(0)).cast("long"))


def best_groups(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the groups that name an agent best: a name within its product token, the longest; ``*`` last; ties together."""
    token = agent.replace("/", " ").split(" ")[0].lower()
    score = F.when(F.col("agent") == "*", 0).when((F.col("agent") != "") & F.lit(token).contains(F.col("agent")), F.length("agent"))
    scored = rules.withColumn("score", score).where("score is not null")
    return scored.withColumn("rank", F.rank().over(Window.partitionBy("origin").orderBy(F.desc("score")))).where("rank = 1").drop("rank", "score")


def pattern_matches(path: str, pattern: str, end: str) -> Column:
    """Whether a path (columns by name) starts with a rule's pattern: ``*`` for anything, all else literal; to its end if ``end``.

    The pieces between ``*`` are sought from left to right, each at its first place after the one before, so the work is
    bounded by the lengths, whatever the pattern.
    """
    parts = f"split({pattern}, '[*]', -1)"
    head, last = f"element_at({parts}, 1)", f"element_at({parts}, -1)"
    inner = f"filter(slice({parts}, 2, greatest(size({parts}) - 2, 0)), p -> p != '')"
    # the place after what was matched; 0 where a piece is missing
    after = f"aggregate({inner}, if(startswith({path}, {head}), length({head}) + 1, 0), (at, p) -> if(at = 0 or locate(p, {path}, at) = 0, 0, locate(p, {path}, at) + length(p)))"
    tail = f"if({end}, endswith({path}, {last}) and length({path}) - length({last}) + 1 >= {after}, {last} = '' or locate({last}, {path}, {after}) > 0)"
    one = f"startswith({path}, {head}) and (not {end} or length({path}) = length({head}))"
    return F.expr(f"case when size({parts}) = 1 then {one} else {after} > 0 and {tail} end")


def robots_verdicts(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(url, allowed) of distinct addresses whose origin has rules, as far as one of them applies: by the longest matching rule, allow before disallow.

    Paths are joined with their origin's rules, and the pattern is checked behind that equi-join. Nothing of an origin whose rules have an error is allowed.
    """
    own = best_groups(rules, agent).where("pattern is not null").select("origin", "allow", "length", "pattern", F.col("end").alias("to_end"), F.lit(False).alias("broken"))
    # what an origin forbids as a whole is a row beside its rules
    none = rules.where("error is not null").select("origin").distinct().select("origin", *[F.lit(None).cast(t).alias(c) for c, t in own.dtypes[1:-1]], F.lit(True).alias("broken"))
    query = F.regexp_extract(normalize_url(F.col("url")), r"(\?[^#]*)", 1)
    asked = urls.select("url", url_origin(F.col("url")).alias("origin"), octets(F.concat(url_path(F.col("url")), query)).alias("path"))
    hot = hot_keys(urls.select(url_origin(F.col("url")).alias("origin")), "origin")
    hit = skew_join(asked, own.unionByName(none), "origin", hot=hot).where(F.col("broken") | pattern_matches("path", "pattern", "to_end"))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct("length", "allow")).alias("allow"), F.max("broken").alias("broken"))
    return verdict.select("url", (F.coalesce("allow", F.lit(True)) & ~F.col("broken")).alias("allowed"))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url, ...) with ``allowed``, as ``robots_verdicts`` says; allowed where no rule applies. Distinct addresses are judged, and the rows then joined."""
    verdict = robots_verdicts(urls.select("url").distinct(), rules, agent)
    return skew_join(urls, verdict, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
