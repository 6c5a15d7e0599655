"""Queries over pages against their SQL where titles are cut within a character reference, have odd spaces, and addresses come twice."""

import pytest

from sitegrain.plans import queries as site

TITLES = ["R&amp;D &amp", "Salt &ampand&quot;s&quot", "a &lt;b&gt; &amp;lt; &l", "one &nbsp;two　three", "&copy 2024 &middot x"]
COLUMNS = {"e01_page_core": "page_id, title, heading", "e03_headings": "page_id, pos, text", "a17_heading_occurrences": "url, pos, text", "t1_stream_extract": "page_id, title, links", "d7_custom": "URL, Field: paper, Field: names"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("odd"))
    html = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><p><a href="/x">x</a></p><h1>{0}</h1></body></html>'
    rows = [(i, f"https://odd.example/{i % 4}", html.format(t)) for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{to}/pages.parquet")
    return to


@pytest.mark.parametrize("name", COLUMNS)
def test_odd_pages_match_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    columns = COLUMNS[name]
    got = sorted(tuple(r) for r in site.queries()[name](spark, folder).selectExpr(*[f"`{c.strip()}`" for c in columns.split(",")]).collect())
    quoted = ", ".join(f'"{c.strip()}"' for c in columns.split(","))
    assert got and got == sorted(con.sql(f"select {quoted} from ({site.oracle_sql()[name]})").fetchall())
