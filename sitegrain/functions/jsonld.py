"""JSON-LD in DataFrame code: whether a text is JSON, and the ``@type`` names in it.

Texts are opened a level at a time, inside the row, so nothing is shuffled. Objects and lists are opened twice: as texts, which
keep the order of the document (a VARIANT sorts its keys), and as VARIANT, which tells a string from the object that it looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the outermost one, children of an object or list, and characters of a name that are looked at; names after which no more is opened.
DEEPEST, MOST_CHILDREN, LONGEST_NAME, MOST_NAMES = 12, 100, 200, 40

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _no_names() -> Column:
    return F.array().cast("array<string>")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; false for null.

    Spark's readers stop after the first value. So the text must be the first of two values of a list, where it cannot hold an unmatched ``}``, and
    the value of an object's key, where it cannot hold an unmatched ``]``. Repeated keys are allowed.
    """
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit(",0]")), "array<string>", _STRICT)
    in_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _STRICT)
    return F.coalesce((F.size(in_list) == 2) & in_object.isNotNull(), F.lit(False))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _names(value: Column) -> Column:
    """The names in the VARIANT of a ``@type``: a string, or the strings of a list."""
    of = lambda v: F.left(F.variant_get(v, "$", "string"), F.lit(LONGEST_NAME))
    listed = F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: _kind(v) == "STRING"), of)
    return F.when(_kind(value) == "STRING", F.array(of(value))).when(_kind(value).startswith("ARRAY"), listed)


def _opened(node: Column) -> Column:
    """A node (path, text of an object or list) as (path, names, inside: the texts in it, kinds: what they are)."""
    text = node["text"]
    of_object = text.startswith("{")
    values = F.from_json(text, "map<string,variant>", _STRICT)
    kinds = F.transform(F.when(of_object, F.map_values(values)).otherwise(F.from_json(text, "array<variant>", _STRICT)), _kind)
    inside = F.when(of_object, F.map_values(F.from_json(text, "map<string,string>", _STRICT))).otherwise(F.from_json(text, "array<string>", _STRICT))
    names = F.when(of_object, _names(F.get(F.map_values(F.map_filter(values, lambda k, v: k == "@type")), F.lit(0))))
    return F.struct(node["path"].alias("path"), F.coalesce(names, _no_names()).alias("names"), F.slice(inside, 1, MOST_CHILDREN).alias("inside"), kinds.alias("kinds"))


def _below(node: Column) -> Column:
    """The objects and lists in an opened node, as nodes."""
    # where the kinds are unknown (repeated keys), a text's first character decides
    nested = lambda text, i: F.coalesce(F.get(node["kinds"], i).rlike("^(OBJECT|ARRAY)"), text.rlike(r"^[\[{]"))
    child = lambda text, i: F.when(nested(text, i), F.struct(F.concat(node["path"], F.array(i)).alias("path"), text.alias("text")))
    return F.array_compact(F.transform(node["inside"], child))


def with_jsonld_types(df: DataFrame, text: str, out: str = "types") -> DataFrame:
    """``df`` with ``out``: the distinct ``@type`` names in the column ``text``, in the order of the document.

    Null texts, and texts that are no JSON or neither object nor list, have none. Levels beyond DEEPEST and children beyond MOST_CHILDREN are not
    looked at, and nothing more is opened once MOST_NAMES names are found. Of repeated keys each counts, and the first as ``@type``. ``df`` has no columns that start with ``_jsonld``.
    Filters belong before this: one on ``out`` would be repeated for each level on its way down.
    """
    t = F.col(text)
    root = F.struct(F.array().cast("array<int>").alias("path"), F.regexp_replace(t, r"^\s+", "").alias("text"))
    roots = F.when(is_json(t) & t.rlike(r"^\s*[\[{]"), F.array(root)).otherwise(F.array().cast("array<struct<path:array<int>,text:string>>"))
    named = F.transform("_jsonld_open", lambda n: F.struct(n["path"].alias("path"), n["names"].alias("names")))
    level = {"_jsonld_all": F.concat("_jsonld_all", named), "_jsonld_open": F.transform(F.flatten(F.transform("_jsonld_open", _below)), _opened)}
    df = df.withColumns({"_jsonld_open": F.transform(roots, _opened), "_jsonld_all": F.array().cast("array<struct<path:array<int>,names:array<string>>>")})
    for _ in range(DEEPEST):
        df = df.withColumns(level)
    # a path comes before the longer ones that it starts, so paths in order are the document's order
    add = lambda found, n: F.when(F.size(found) >= MOST_NAMES, found).otherwise(F.array_union(found, n["names"]))
    return df.withColumn(out, F.aggregate(F.array_sort(level["_jsonld_all"]), _no_names(), add)).drop("_jsonld_open", "_jsonld_all")
