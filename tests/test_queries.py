"""Every registered query against its SQL, over the smallest tables."""

import pytest

import __spark_entry__ as entry
from sitegrain.plans import queries as site

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or str(x) in ("NaT", "<NA>", "nan", "None") else f"{float(x):.6f}" if hasattr(x, "__float__") and not isinstance(x, str | bool) and "bool" not in type(x).__name__ else str(x)
    return list(df.columns), sorted([tuple(map(cell, r)) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(site.queries()))
def test_query_matches_sql(spark, duck, name):
    got = rows(site.queries()[name](spark, SF).toPandas())
    if name in site.oracle_sql():
        assert got == rows(duck.sql(site.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r.html for r in site.queries()["f14_escapes_whole"](spark, SF).collect()}
    plain = {r.doc_id: r.text for r in docs.collect() if r.text is not None and not set(r.text) & set("&<>\"'")}
    assert plain and all(out[i] == t for i, t in plain.items())
    assert site.queries()["f22_content_fingerprint_all"](spark, SF).count() == docs.count()


def test_line_diff_sides(spark):
    import re

    sides = {r.id: (r.same + r.removed, r.same + r.added) for r in site.queries()["o7_source_line_diff_sides"](spark, SF).collect()}
    lines = lambda df: {r.page_id: len(re.split(r"\r?\n", re.sub(r">\s*<", ">\n<", r.html[:120_000]))[:300]) for r in df.collect()}
    before, after = lines(site.pages(spark, SF)), lines(site.enriched(spark, SF))
    assert sides == {i: (n, after[i]) for i, n in before.items()} and any(a != b for a, b in sides.values())
