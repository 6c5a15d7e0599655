"""Accessible names over whole pages: beyond the first elements, labels and references, after the end of a body, and beside a very long text."""

import pytest

from sitegrain.operators.parse import page_details
from sitegrain.plans import queries as site

URL = "https://fixture.example/"
LINK = '<a href="/x">x</a>'


def facts(html):
    return page_details(html, URL)["accessibility"]


def test_elements_beyond_the_first():
    a = facts("<div>" + "<span>x</span>" * 6000 + "</div><h1>Last</h1><img src=i><a href=y></a><button></button><input>" + LINK * 6000)
    assert [a[c] for c in ("h1_count", "images_missing_alt", "controls_without_name", "buttons_without_name", "links", "links_without_name")] == [1, 1, 1, 1, 6001, 1]
    assert a["inspected_elements"] == 12_008 and not a["truncated"]


def test_labels_and_references_beyond_the_first():
    assert facts("<input id=a>" + "<label for=a></label>" * 40 + "<label for=a>x</label>")["controls_without_name"] == 0
    assert facts("<label>x" + "<label>" * 40 + "<input>")["controls_without_name"] == 0
    assert facts(f"<b id=n>x</b><a href=y aria-labelledby='{'m ' * 20}n'></a><a href=y aria-labelledby='m'></a>")["links_without_name"] == 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("whole"))
    html = '<!DOCTYPE html><html lang="en"><head><title>t</title></head><body>{}<h1>x</h1>{}</body></html>{}'
    parts = [("", "", ""), (LINK * 6000, "", ""), ("<i></i>" * 6000, LINK, ""), ("<script>a='</body>'</script>", LINK, ""), ("", LINK, LINK * 2 + "</body></html>\n"), ("", "<!-- </body> -->", LINK)]
    parts += [(f"<script type='application/ld+json'>{'w' * 21_000_000}</script>", LINK, "")]  # one text longer than a JSON reader takes by default
    rows = [(i, f"{URL}{i}", html.format(*p)) for i, p in enumerate(parts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{to}/pages.parquet")
    return to


def test_whole_pages_match_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    got = site.queries()["e17_accessibility"](spark, folder)
    said = con.sql(f"select {', '.join(got.columns)} from ({site.oracle_sql()['e17_accessibility']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(said)
    assert {r.page_id: r.links for r in got.collect()} == {0: 2, 1: 6002, 2: 3, 3: 3, 4: 5, 5: 3, 6: 3}
