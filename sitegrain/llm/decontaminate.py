"""Benchmark decontamination by a prefix-filtered set join, in DataFrame expressions only.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one window). A
window is the set of its shingles of ``SHINGLE`` words at their offsets, and it occurs in a document when
the document has all of them at matching positions.

1. One pass over the documents makes their shingles and keeps those that the benchmark has
   (*postings*: document, position, shingle).
2. Shingles are ordered by rarity, as counted over the postings of all documents. Full containment
   leaves a prefix of one shingle: a window's rarest. Joining it with the postings gives candidates.
3. Positional and length bounds drop candidates that would start before or end after their document.
4. The rest are verified: every shingle of the window has a posting at its position. A false window
   would need several 64-bit hashes to collide at once, so this is exact containment.

Hits are counted over the union of the intervals that verified windows cover.

Joins with tables of the benchmark broadcast it while it is small, as counted, and shuffle it beyond.

Defined results: null or empty texts, and texts without words, have no words and no hits. Null and
empty items have no windows; an empty benchmark hits nothing. Items of equal text all count. Repeated rows are returned each
with the same result. A null id is carried. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm.scratch import Scratch, sized

WINDOW = 10
SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is; text that is ASCII throughout takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, wid, window, size): the distinct windows of every item; ``wid`` numbers equal windows alike."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {width}, 0)), i -> slice(w, i + 1, {width}))")).alias("window")).distinct()
    return cut.select("item", F.sha2(F.array_join("window", " "), 256).alias("wid"), "window", F.size("window").alias("size"))


def find_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``text_hash`` (xxhash64) tells rows of one id apart."""
    s = Scratch(spark)
    named = s.save(windows_of(benchmark, item_col, item_text_col, width))
    windows = named.select("wid", "window", "size").dropDuplicates(["wid"])
    short = F.least("size", F.lit(SHINGLE))
    # (wid, size, k, m, off, h): shingle h of k words at offset off, of the m shingles of its window
    parts = s.save(
        windows.withColumn("k", short)
        .select("wid", "size", "k", (F.col("size") - F.col("k") + 1).alias("m"), F.posexplode(F.expr("transform(sequence(0, size - k), i -> xxhash64(slice(window, i + 1, k)))")).alias("off", "h"))
    )
    lengths = sorted(r.k for r in parts.select("k").distinct().collect())  # at most SHINGLE numbers
    known = s.save(parts.select("k", "h").distinct())

    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("kid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("w"))
    n = F.size("w")
    # A first element for each document, so that it keeps a row. The outer form, as the plain one evaluates its input
    # once more in a filter.
    listed = F.array(F.lit(0).cast("long"))
    posted = None
    for k in lengths or [SHINGLE]:
        runs = F.when(n >= k, F.expr(f"slice(transform(w, (x, i) -> xxhash64(slice(w, i + 1, {k}))), 1, size(w) - {k - 1})")).otherwise(F.array().cast("array<bigint>"))
        rows = text.select("kid", "doc_id", "th", n.cast("long").alias("n_words"), F.concat(listed, runs).alias("runs"))
        rows = rows.select("kid", "doc_id", "th", "n_words", F.posexplode_outer("runs").alias("at", "h"))
        if posted is not None:
            rows = rows.where("at > 0")
        own = known.where(F.col("k") == k).select("h", F.lit(True).alias("known"))
        rows = rows.join(sized(own), "h", "left").where("known or at = 0").select("kid", "doc_id", "th", "n_words", (F.col("at") - 1).alias("pos"), F.lit(k).alias("k"), "h")
        posted = rows if posted is None else posted.unionByName(rows)
    posted = s.save(posted)
    base = posted.where("pos = -1").select("kid", "doc_id", "th", "n_words")
    postings = posted.where("pos >= 0")

    rarity = s.save(postings.groupBy("k", "h").agg(F.count("*").alias("freq")))
    prefix = s.save(
        parts.join(rarity.hint("merge"), ["k", "h"], "left")
        .groupBy("wid", "size", "m")
        .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "k", "h")).alias("p"))
        .where("p.freq > 0")
        .select("wid", "size", "m", "p.off", "p.k", "p.h")
    )
    near = postings.join(sized(prefix), ["k", "h"]).withColumn("start", F.col("pos") - F.col("off"))
    candidates = s.save(near.where("start >= 0 and start + size <= n_words").select("kid", "th", "start", "wid", "size").distinct())
    wanted = candidates.join(sized(parts.select("wid", "k", "m", "off", "h")), "wid").select("kid", "th", (F.col("start") + F.col("off")).alias("pos"), "k", "h", "start", "wid", "size", "m", "off")
    there = postings.select("kid", "th", "pos", "k", "h").hint("merge")
    verified = s.save(
        wanted.join(there, ["kid", "th", "pos", "k", "h"])
        .groupBy("kid", "th", "start", "wid", "size", "m").agg(F.count_distinct("off").alias("seen"))
        .where("seen = m").select("kid", "th", "start", "wid", "size")
    )
    s.drop(known, rarity, prefix, candidates)

    ends = verified.groupBy("kid", "th", "start").agg(F.max(F.col("start") + F.col("size")).alias("upto"))
    ends = ends.selectExpr("kid", "th", "start", "upto", "max(upto) over (partition by kid, th order by start rows between unbounded preceding and 1 preceding) as before")
    hits = s.save(ends.groupBy("kid", "th").agg(F.sum(F.greatest(F.lit(0), F.col("upto") - F.greatest("start", F.coalesce("before", "start")))).cast("long").alias("n_hit")))
    of_items = verified.select("kid", "th", "wid").distinct().join(sized(named.select("wid", "item")), "wid")
    items = s.save(of_items.groupBy("kid", "th").agg(F.array_sort(F.collect_set("item")).alias("items")))
    s.drop(verified)
    found = hits.join(items.hint("merge"), ["kid", "th"])
    return (
        base.join(found.hint("merge"), ["kid", "th"], "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.col("th").alias("text_hash"),
        )
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, array_to_string(w[i + 1 : i + 10], ' ') AS win, len(w[i + 1 : i + 10]) AS size FROM bi
), sizes AS (SELECT DISTINCT size FROM win
), dw AS (
  SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS start FROM d, sizes WHERE len(w) >= size
), dx AS (
  SELECT doc_id, start, size, array_to_string(w[start + 1 : start + size], ' ') AS win FROM dw
), hit AS (
  SELECT doc_id, start, dx.size AS size, item FROM dx JOIN win ON dx.win = win.win
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
