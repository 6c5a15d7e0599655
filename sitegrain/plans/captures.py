"""Captures that the registered queries run on, derived from ``pages`` by expressions that SQL has too.

The given pages have no images, forms, descriptions or structured data, and no response metadata. ``enriched`` adds markup
to each page's html, and ``captures`` adds responses, by arithmetic on its id, so work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.text import content_fingerprint
from sitegrain.operators.parse import parse_pages

ROOT = "https://site.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for one page's html with more markup (Spark and DuckDB): its head, and what comes after the page.
HEAD = """replace(html, '</head>', concat(
  case when page_id % 3 = 0 then concat('<meta name="Description" content=" About ', cast(page_id as varchar(20)), ' "><meta name="keywords" content="a,b">') when page_id % 3 = 1 then '<meta name="description" content="">' else '' end,
  case when page_id % 4 = 0 then '<link rel="canonical" href="/c/1">' else '' end,
  case when page_id % 7 = 0 then '<meta name="robots" content="NoIndex, follow">' else '' end,
  '<link rel="stylesheet" href="/s.css"><script src="/_next/app.js"></script><link rel="alternate" hreflang="de" href="/de/x">',
  case when page_id % 5 = 0 then '<script type="application/ld+json">{"@type":"Article","author":{"@type":["Person","Agent"]}}</script>' when page_id % 5 = 1 then '<script type="application/ld+json">{broken</script>' else '' end,
  '</head>'))"""
MORE = """
  '<h2 id="more">More  on page</h2><img src="/i/', cast(page_id % 10 as varchar(20)), '.png"', case when page_id % 3 = 0 then '' when page_id % 3 = 1 then ' alt=""' else concat(' alt="Picture ', cast(page_id % 10 as varchar(20)), '"') end, ' width="', cast(page_id % 4 * 100 as varchar(20)), '">',
  '<a href="/doc/', cast(page_id % 6 as varchar(20)), '.pdf" rel="nofollow">Paper</a><a href="https://out.example/x" title="far">Far</a>',
  '<form action="/send" method="post"><input name="mail" required><input type="hidden" name="t"><button>Send</button></form>',
  case when page_id % 2 = 0 then '<div hidden>gone</div>' else '' end,
  '</body></html>')
"""
#: With the markup in place of what follows the first end of a body, and after the whole page.
ENRICHED = f"""
concat(regexp_replace({HEAD}, '(?s)</body>.*$', ''),{MORE}"""
ENRICHED_WHOLE = f"""
concat({HEAD},{MORE}"""


def enriched(spark: SparkSession, sf_dir: str, html: str = ENRICHED) -> DataFrame:
    """(page_id, url, html)"""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(html.replace("varchar(20)", "string")).alias("html"))


def parsed(spark: SparkSession, sf_dir: str, html: str = ENRICHED) -> DataFrame:
    return parse_pages(enriched(spark, sf_dir, html))


#: SQL of captures over pages (Spark and DuckDB): page i has the address of a small site and links to others by number.
CAPTURES = """
select page_id as capture_seq, concat('https://site.example/g', cast(page_id % 7 as varchar(20)), '/p', cast(page_id as varchar(20))) as url,
  case when page_id % 13 = 0 then concat('https://site.example/old/', cast(page_id as varchar(20))) else concat('https://site.example/g', cast(page_id % 7 as varchar(20)), '/p', cast(page_id as varchar(20))) end as requested_url,
  cast(case when page_id % 29 = 0 then 0 when page_id % 19 = 0 then 203 else 200 end as int) as status_code,
  case when page_id % 31 = 0 then null else cast(page_id % 5 as int) end as depth,
  case when page_id % 23 = 0 then null else page_id * 37 % 4000 end as duration_ms,
  cast(octet_length(encode(html)) as bigint) as content_bytes,
  case when page_id % 11 = 0 then '  ' when page_id % 17 = 1 then null else regexp_extract(html, '<title>([^<]*)</title>', 1) end as title,
  case when page_id % 12 = 0 then '' else 'Heading' end as heading,
  case when page_id % 3 = 0 then 'About' when page_id % 3 = 1 then '' else null end as description,
  case when page_id % 4 = 0 then 'https://site.example/c/1' else '' end as canonical_url,
  case when page_id % 7 = 0 then 'NoIndex, follow' else '' end as robots,
  case when page_id % 37 = 0 then 'noindex' else null end as x_robots_tag,
  case when page_id % 41 = 0 then 'Timed out' else null end as render_failure,
  page_id % 6 as links_from, (page_id * 3 + 1) % 50 as linked, page_id
from pages
"""
#: SQL of the addresses that page i links to: old and new addresses of pages, missing ones, another site, itself.
TARGETS = """
select page_id as capture_seq, 0 as pos, concat('https://site.example/g', cast((page_id + 1) % 7 as varchar(20)), '/p', cast(page_id + 1 as varchar(20))) as target from pages
union all select page_id, 1, concat('https://site.example/old/', cast(page_id - page_id % 13 as varchar(20))) from pages
union all select page_id, 2, concat('https://site.example/missing/', cast(page_id % 34 as varchar(20))) from pages
union all select page_id, 3, concat('https://far.example/', cast(page_id % 9 as varchar(20))) from pages
union all select page_id, 4, concat('https://site.example/g', cast(page_id % 7 as varchar(20)), '/p', cast(page_id as varchar(20)), '#top') from pages
union all select page_id, 5, 'https://site.example/g0/p0' from pages
"""
#: SQL of failures: missing addresses by number, a timeout, a file that is no page, and an old address that was captured later.
ERRORS = """
select page_id as error_seq, concat('https://site.example/missing/', cast(page_id % 34 as varchar(20))) as url, case when page_id % 17 = 3 then 'network' else 'http' end as kind,
  concat('failure ', cast(page_id % 34 as varchar(20))) as message, cast(case when page_id % 17 = 3 then null when page_id % 2 = 0 then 404 else 503 end as int) as status_code, 'page' as stage
from pages where page_id % 17 < 5
union all select 1000000 + page_id, concat('https://site.example/old/', cast(page_id as varchar(20))), 'http', 'late', 503, 'page' from pages where page_id % 13 = 0
union all select 2000000 + page_id, concat('https://site.example/f/', cast(page_id as varchar(20))), 'non-html', 'a file', 200, 'page' from pages where page_id % 43 = 0
"""


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query.replace("varchar(20)", "string").replace("from pages", "from {pages}").replace("encode(html)", "html"), pages=table(spark, sf_dir, "pages"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages with links and the columns that findings read."""
    same = lambda u: F.try_parse_url(u, F.lit("HOST")) == "site.example"
    links = _sql(spark, sf_dir, TARGETS).groupBy("capture_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("outgoing_links"))
    n = F.col("page_id")
    access = F.struct(
        F.lit(1).alias("version"), F.when(n % 14 == 0, "").otherwise("en").alias("language"), (n % 3).cast("int").alias("h1_count"), (n % 8).cast("int").alias("images"), F.least(n % 8, n % 4).cast("int").alias("images_missing_alt"),
        (n % 5).cast("int").alias("controls"), F.when(n % 5 > 3, 2).otherwise(0).alias("controls_without_name"), F.lit(6).alias("links"), (n % 2).cast("int").alias("links_without_name"), F.lit(1).alias("buttons"), F.when(n % 9 == 0, 1).otherwise(0).alias("buttons_without_name"),
        F.lit(20).alias("inspected_elements"), (n % 10 == 0).alias("truncated"),
    )
    rows = _sql(spark, sf_dir, CAPTURES).join(links, "capture_seq")
    return rows.select(
        "*", F.filter("outgoing_links", same).alias("internal_links"), F.filter("outgoing_links", lambda u: ~same(u)).alias("external_links"),
        F.when(n % 6 != 5, access).alias("accessibility"), content_fingerprint(F.concat(F.lit("text "), (n - n % 2).cast("string"))).alias("content_fingerprint"),
        (n * 7 % 500).alias("word_count"), F.array().cast("array<string>").alias("extraction_errors"), F.lit(0).alias("console_errors"), (n % 20 == 0).cast("int").alias("network_errors"), (n % 5 == 1).alias("structured_invalid"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ERRORS)
