"""JSON-LD: texts, names and budgets against a plain walk over the parsed value."""

import json

from pyspark.sql import functions as F

from sitegrain.functions.jsonld import is_json, with_jsonld_types
from sitegrain.operators.parse import OVER_BUDGET, parse_pages, structured_rows


def walk(value, found, depth=0):
    if depth <= 12 and len(found) < 40 and isinstance(value, dict | list):
        if isinstance(value, dict):
            own = value.get("@type")
            found.update(dict.fromkeys(t[:200] for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)))
        for v in list(value if isinstance(value, list) else value.values())[:100]:
            walk(v, found, depth + 1)
    return list(found)


def plain(text):
    try:
        return True, walk(json.loads(text, parse_constant=lambda c: 1 / 0), {})
    except (ValueError, ZeroDivisionError, TypeError):
        return False, []


def deep(n):
    return '{"x":' * n + '{"@type":"Deep"}' + "}" * n


TEXTS = [
    '{"b":{"z":"[1]","@type":"A"},"a":[1,{"@type":["X",3]}],"@type":"T \\u003c","n":1.0}', '{"a":1} x', '{"a":NaN}', "[1,2]", '"s"', "{'a':1}", "", '{"a":1,}', '{"a":"x\ty"}', None, " 5 ", '{"a":1}{"b":2}',
    '{"a":01}', '{"k":"\\"}"}', "5]", '5,"end"]', "5,0", "5}", "{bad", '{"a":"{\\"@type\\":\\"No\\"}","@type":"Yes"}', deep(12), deep(13), "null", '{"@type":{"@type":"in"}}', '{"x":{"a":1,"a":{"@type":"D"}}}',
    "[" + ",".join('{"@type":"T%d"}' % (i % 3) for i in range(130)) + ',{"@type":"beyond"}]', "[" + ",".join('{"@type":"T%d"}' % i for i in range(60)) + "]", '[{"@type":["%s"]}]' % '","'.join(f"L{i}" for i in range(50)),
    '\n [{"@type":["a","b"]},[{"@type":"c"}],{"@type":"a","q":{"@type":null}}] ', json.dumps({"@type": "x" * 300, "é": {"@type": "ü"}}),
]


def test_names_and_validity(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in with_jsonld_types(df, "text").select("i", is_json(F.col("text")).alias("valid"), "types").collect():
        valid, names = plain(TEXTS[r.i])
        assert (r.valid, r.types) == (valid, names), TEXTS[r.i]


def test_blocks_of_pages(spark):
    ld = lambda t, kind="application/ld+json": f'<script type="{kind}">{t}</script>'
    htmls = [
        ld('{"@type":["A","B"], "x":[{"@type":"C"}]}', "application/LD+json") + ld("{bad"),
        ld('"' + "x" * 64_000 + '"') + ld('{"@type":"S"}') + '<div itemscope itemtype="  T1  T2 "><b itemprop=p>v</b></div><p typeof=R>t</p>',
        ld('"' + "x" * 50_000 + '"') * 3,
        ld("{}") * 21,
        "<p>none",
    ]
    parsed = parse_pages(spark.createDataFrame([(str(i), h) for i, h in enumerate(htmls)], "url string, html string"))
    blocks = structured_rows(parsed, "url").orderBy("url", "pos").collect()
    shown = [[(b.format, b.types, b.valid, b.error) for b in blocks if b.url == str(i)] for i in range(len(htmls))]
    rows = parsed.select("doc.inspection_truncated").orderBy("url").collect()
    over = ("json-ld", [], False, OVER_BUDGET)
    assert shown[0] == [("json-ld", ["A", "B", "C"], True, None), ("json-ld", [], False, "invalid JSON")]
    assert shown[1] == [over, ("json-ld", ["S"], True, None), ("microdata", ["T1", "T2"], True, None), ("rdfa", ["R"], True, None)]
    assert [v for _, _, v, _ in shown[2]] == [True, True, False] and shown[2][2] == over
    assert len(shown[3]) == 20 and shown[4] == []
    assert [r.inspection_truncated for r in rows] == [False, True, True, True, False]
    assert blocks[0].value == '{"@type":["A","B"],"x":[{"@type":"C"}]}'
    assert blocks[4].value == '{"text":"v","properties":[{"name":"p","value":"v"}]}'


def test_extractors_give_blocks_as_they_are(spark):
    own = {"structured_data": [{"format": "mine", "types": ["M"], "valid": True, "error": None, "value": "{}"}]}
    df = parse_pages(spark.createDataFrame([("u", "<p>")], "url string, html string"), extractor=lambda html, url: own)
    assert [tuple(b) for b in structured_rows(df).collect()] == [(0, "mine", ["M"], True, None, "{}")]
