"""SQL names for the helpers: scalar functions over html, and a table function of a page's links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sitegrain.cluster import ship
from sitegrain.operators.parse import page_details

#: Names of modes of a declarative extraction rule.
MODES = ("text", "attribute", "html")
MOST_RULES = 12


def validate_rules(rules: list[dict]) -> list[dict]:
    """At most 12 rules with unique simple names, a selector, a known mode, and an attribute where the mode needs one."""
    import re

    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} extraction rules")
    names = [str(r.get("name", "")) for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("extraction rule names must be unique")
    for r in rules:
        if not re.fullmatch(r"[A-Za-z][\w -]{0,49}", str(r.get("name", ""))):
            raise ValueError(f"not a simple rule name: {r.get('name')!r}")
        if not str(r.get("selector", "")).strip() or r.get("mode", "text") not in MODES or (r.get("mode") == "attribute" and not r.get("attribute")):
            raise ValueError(f"incomplete rule: {r.get('name')!r}")
    return [{"name": r["name"], "selector": r["selector"], "mode": r.get("mode", "text"), "attribute": r.get("attribute")} for r in rules]


def register_functions(spark: SparkSession) -> None:
    """``html_heading(html)``, ``html_paragraph(html)``, ``html_links(html, url)``, ``html_images(html, url)`` and, for ``LATERAL``, ``extract_links(html, url)``."""
    ship(spark)

    def of(field: str, kind):
        @F.pandas_udf(kind)
        def read(html: pd.Series, url: pd.Series) -> pd.Series:
            return pd.Series([page_details(h or "", u or "https://example.invalid/")[field] for h, u in zip(html, url, strict=True)])

        return read

    def alone(field: str):
        @F.pandas_udf(StringType())
        def read(html: pd.Series) -> pd.Series:
            return html.map(lambda h: page_details(h or "", "https://example.invalid/")[field])

        return read

    spark.udf.register("html_heading", alone("heading"))
    spark.udf.register("html_paragraph", alone("first_paragraph"))
    spark.udf.register("html_links", of("plain_links", ArrayType(StringType())))
    spark.udf.register("html_images", of("plain_images", ArrayType(StringType())))

    @F.udtf(returnType="pos int, url string, text string, rel string")
    class ExtractLinks:
        def eval(self, html: str, url: str):
            for i, x in enumerate(page_details(html or "", url or "https://example.invalid/")["links"]):
                yield i, x["url"], x["text"], x["rel"]

    spark.udtf.register("extract_links", ExtractLinks)
