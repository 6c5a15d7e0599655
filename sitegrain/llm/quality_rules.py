"""Quality rules by robust multivariate outliers, in DataFrame expressions only.

A document's words, symbols, repeated lines and repeated five-word windows become a vector of
transformed statistics. Per language and source, minimum-covariance-determinant estimates of the
vectors' centre and scatter come from concentration steps: of all documents, the share ``SUBSET``
nearest to the present estimate gives the next one. Two deterministic starts (all documents; those near
the coordinates' medians) run side by side and the smaller determinant wins. A document whose squared
Mahalanobis distance exceeds a chi-squared quantile is rejected.

A concentration step is one grouped aggregation with partial sums: counts, sums and cross products by bins of the log
distance (a bounded number of bins per group). What lies up to the bin that holds the subset's radius gives the next
estimate. No group is gathered anywhere, whatever its size. Estimates are one row per group and start, and medians
are read off histograms, so no result depends on an order.

A language and source of fewer than ``LEAST_GROUP`` documents is judged by the estimates of its whole language, and a
language of so few by those of all documents. Ratios are smoothed towards a constant by ``SMOOTH`` words, so that short texts vary as
little as long ones, and a floor on each coordinate's variance keeps constant coordinates and few documents usable.

Defined results: null or empty text, or no words: all counts 0, base_failed true, kept false. Null
language or source is a group like any other. Repeated rows count each. Extra columns are ignored,
whatever their names. Repeated windows are found by 64-bit hashes of their words within a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrain.llm.scratch import Scratch, sized

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
SUBSET = 0.75
STEPS = 5
LEAST_GROUP = 60
SMOOTH = 30.0
#: Bins of a histogram of log squared distances, to one unit of the logarithm.
BINS = 16
#: Cells of a coordinate's histogram, to one unit.
CELLS = 1024
#: Groups up to which their estimates are broadcast.
GROUPS = 20_000
#: Standard normal quantile of the rejection level (3 in 100,000).
Z_REJECT = 4.0
#: Least standard deviations of the coordinates.
FLOORS = (0.08, 0.12, 0.06, 0.05, 0.12)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2(p: int, z: float) -> float:
    """The chi-squared quantile at a standard normal quantile, by Wilson and Hilferty's formula."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, n_upper."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = docs.select(
        *[c for c in docs.columns if c != text_col],
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+")).alias("_words"),
        lines.alias("_lines"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(text, r"[A-Z!]", -1)) - 1).cast("long").alias("n_upper"),
    )
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") > WINDOW,
            F.expr(f"slice(transform(_words, (x, i) -> xxhash64(slice(_words, i + 1, {WINDOW}))), 1, size(_words) - {WINDOW - 1})"),
        ).alias("_runs"),
    ).drop("_words", "_lines")
    df = df.select("*", (F.size(F.array_distinct("_runs")) < F.size("_runs")).alias("_some"))
    df = df.select("*", F.when(F.col("_some"), F.expr("array_sort(transform(_runs, (h, i) -> struct(h as h, i as i)))")).alias("_sorted")).drop("_runs")
    at = "array_sort(filter(transform(_sorted, (x, i) -> if(x.h <=> get(_sorted, i - 1).h or x.h <=> get(_sorted, i + 1).h, x.i, null)), p -> p is not null))"
    df = df.select("*", F.when(F.col("_some"), F.expr(at)).alias("_at")).drop("_sorted")
    covered = f"aggregate(transform(_at, (p, i) -> least({WINDOW}, coalesce(get(_at, i + 1) - p, {WINDOW}))), 0, (a, x) -> a + x)"
    return df.select("*", F.when(F.col("_some"), F.expr(covered)).otherwise(0).cast("long").alias("n_repeat_words")).drop("_at", "_some")


def vector() -> list[Column]:
    """Transformed statistics: word length, symbols, repeated lines, repeated windows, capitals and exclamation marks."""
    words = F.col("n_words") + SMOOTH
    return [
        F.log((F.col("word_chars") + 5 * SMOOTH) / words),
        F.log1p(4 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / (F.col("n_lines") + 8),
        F.col("n_repeat_words") / words,
        F.log1p(2 * F.greatest(F.lit(0.0), F.col("n_upper") / words - 0.15)),
    ]


def _estimates(sums: DataFrame) -> DataFrame:
    """Means, the Cholesky factor of the covariance (with floors) and its log determinant, from sums and cross products."""
    n = F.greatest(F.col("n"), F.lit(1))
    df = sums.select("grp", "start", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)], *[(F.col(f"c{i}{j}") / n).alias(f"c{i}{j}") for i, j in PAIRS])
    df = df.select(
        "grp", "start", *[f"m{i}" for i in range(P)],
        *[(F.greatest(F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) + FLOORS[i] ** 2 if i == j else F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    for i in range(P):  # row by row: each entry needs those before it
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select("grp", "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """``df``, with estimates joined, and the squared Mahalanobis distance ``d2``."""
    total = F.lit(0.0)
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return df.withColumn("d2", total)


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * BINS).cast("long")


SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]]


def _binned(rows: DataFrame, d2: Column) -> DataFrame:
    """Count, sums and cross products of ``rows`` (grp, start, x0..) by bins of ``d2``."""
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in PAIRS]]
    return rows.groupBy("grp", "start", _bin(d2).alias("bin")).agg(*sums)


def _nearest(binned: DataFrame, share: float) -> DataFrame:
    """(grp, start, bin, sums): the first bin up to which ``share`` of a group's documents lies, and the sums up to it."""
    group = Window.partitionBy("grp", "start")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = binned.select("grp", "start", "bin", F.ceil(F.sum("n").over(group) * share).alias("need"), F.col("n").alias("own"), *[F.sum(c).over(upto).alias(c) for c in SUMS])
    return df.where("n >= need and n - own < need").drop("need", "own")


def _medians(rows: DataFrame) -> DataFrame:
    """(grp, md0..): each coordinate's median, to half a cell."""
    cells = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(x) * CELLS) for x in X])).alias("i", "cell")).groupBy("grp", "i", "cell").agg(F.count("*").alias("own"))
    cells = cells.selectExpr("*", "sum(own) over (partition by grp, i order by cell) as n", "sum(own) over (partition by grp, i) as total")
    cells = cells.where("2 * n >= total and 2 * (n - own) < total")
    return cells.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, (F.col("cell") + 0.5) / CELLS)).alias(f"md{i}") for i in range(P)])


def robust_distances(scratch: Scratch, rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(row columns, d2) for rows (grp, x0..): scaled squared distances to the estimates of their group, made from
    ``members`` (grp, x0..), by default the rows themselves."""
    members = rows if members is None else members
    medians = scratch.save(_medians(members))
    few = medians.limit(GROUPS + 1).count() <= GROUPS
    small = F.broadcast if few else lambda t: t.hint("merge")

    central = sum((F.pow((F.col(x) - F.col(f"md{i}")) / FLOORS[i], 2) for i, x in enumerate(X)), F.lit(0.0))
    first = scratch.save(_binned(members.join(small(medians), "grp").withColumn("start", F.lit(1)), central))
    whole = first.groupBy("grp").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("start", F.lit(0))
    est = scratch.save(_estimates(_nearest(first, 0.5).drop("bin").unionByName(whole)))
    scratch.drop(medians, first)
    starts = members.select("grp", *X, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    for _ in range(STEPS):
        new = scratch.save(_estimates(_nearest(_binned(_distance(starts.join(small(est), ["grp", "start"])), F.col("d2")), SUBSET)))
        scratch.drop(est)
        est = new
    best = scratch.save(est.groupBy("grp").agg(F.min_by(F.struct(*[c for c in est.columns if c != "grp"]), F.struct("logdet", "start")).alias("e")).select("grp", "e.*"))
    of_best = lambda t: _distance(t.withColumn("start", F.lit(0)).join(small(best.drop("start")), "grp"))
    half = scratch.save(_nearest(_binned(of_best(members), F.col("d2")), 0.5).select("grp", "bin"))
    # consistency: the median of the distances is that of a chi-squared variable, unless floors hold it below
    scale = F.greatest(F.exp((F.col("bin") + 0.5) / BINS) / chi2(P, 0.0), F.lit(1.0))
    return of_best(rows).join(small(half), "grp").select(*rows.columns, (F.col("d2") / scale).alias("d2"))


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its statistics, ``distance2``, ``base_failed`` and ``kept``; ``text_hash`` (xxhash64) tells rows of one id apart."""
    s = Scratch(spark)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.to_json(F.struct(F.col(lang_col).alias("l"))).alias("pool"), F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))).alias("own"))
    df = statistics(raw)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = s.save(df.select("*", failed.alias("base_failed"), *[v.cast("double").alias(f"x{i}") for i, v in enumerate(vector())]))

    # each language and source is judged by the estimates of its own group, its language or all; a group has members from all that it covers
    sizes = s.save(stats.groupBy("pool", "own").agg(F.count("*").alias("n")))
    enough = F.col("n") >= LEAST_GROUP
    pools = s.save(sizes.groupBy("pool").agg(F.sum("n").alias("pool_n"), F.max(~enough).alias("asked")))
    by_all = F.lit("")
    grp = F.when(enough, F.col("own")).when(F.col("pool_n") >= LEAST_GROUP, F.col("pool")).otherwise(by_all)
    all_asked = bool(pools.where(F.col("pool_n") < LEAST_GROUP).take(1))
    of = F.array_compact(F.array(F.when(enough, F.col("own")), F.when(F.col("asked") & (F.col("pool_n") >= LEAST_GROUP), F.col("pool")), by_all if all_asked else F.lit(None)))
    groups = s.save(sizes.join(pools.hint("merge"), "pool").select("own", grp.alias("grp"), of.alias("member_of")))
    rows = s.save(
        stats.join(sized(groups, GROUPS), "own")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "text_hash", "grp", "member_of", *X)
    )
    s.drop(stats, sizes, pools, groups)
    both = robust_distances(s, rows.drop("member_of"), rows.select(F.explode("member_of").alias("grp"), *X))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("d2") <= chi2(P, Z_REJECT))).alias("kept"), F.col("d2").alias("distance2"), "text_hash",
    )
