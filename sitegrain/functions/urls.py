"""URL functions over columns, as expressions; an address that is already in normal form is told by a pattern and left as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.hosts import apply, host_sql, let

#: Tracking parameters that ``strip_tracking`` removes, besides those that start with utm_.
TRACKING = ("fbclid", "gclid", "msclkid")
_PLAIN = r"^https?://[a-z0-9.-]+(/[A-Za-z0-9_~!$&()*+,;=:@/-]*(\.[A-Za-z0-9_~!$&()*+,;=:@-]+)*)?(\?[A-Za-z0-9._~!$&()*+,;=:@/?%-]*)?$"
#: Characters that stay in a path, and in a query; others are written as the bytes of their UTF-8.
_IN_PATH = r"A-Za-z0-9/:@!$&'()*+,;=._~%\[\]|\\^-"
_IN_QUERY = r"A-Za-z0-9/:@!$&()*+,;=._~%\[\]|\\^{}`?-"


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, r"#[\s\S]*$", "")


def _is_plain(c: Column) -> Column:
    """Already in normal form, but perhaps for a missing path: nothing to decode, resolve or encode, and no host that ends in a number."""
    return c.rlike(_PLAIN) & ~c.rlike(r"/\.{1,2}(/|$|\?)") & ~c.rlike(r"%2[eE]") & ~c.rlike(r"^https?://([^/?]*\.)?(\d+|0x[0-9a-f]*)\.?([/?]|$)")


def _trimmed(v: str) -> str:
    """SQL: without control characters and spaces around, and without tabs and line breaks."""
    return rf"regexp_replace(regexp_replace({v}, r'^[\x00-\x20]+|[\x00-\x20]+$', ''), r'[\t\n\r]', '')"


def _encoded(v: str, safe: str) -> str:
    """SQL: other characters than the safe ones as the bytes of their UTF-8."""
    runs = f'regexp_extract_all(e, r"([{safe}]+|[^{safe}])", 1)'
    written = f"transform({runs}, x -> if(x rlike r\"^[{safe}]\", x, regexp_replace(hex(encode(x, 'UTF-8')), '(..)', '%$1')))"
    return let("e", v, f"if(e rlike r\"^[{safe}]*$\", e, array_join({written}, ''))")


def _without_dots(v: str) -> str:
    """SQL: a path (from its first slash on) with dot segments resolved."""
    up, here = (rf"x.p rlike r'(?i)^(\.|%2e){n}$'" for n in ("{2}", ""))
    end, above = "if(x.last, array(''), array())", "slice(a, 1, greatest(size(a) - 1, 0))"
    step = f"case when {up} then concat({above}, {end}) when {here} then concat(a, {end}) else concat(a, array(x.p)) end"
    walked = let("m", "split(substring(d, 2), '/')", f"aggregate(transform(m, (x, i) -> struct(x as p, i = size(m) - 1 as last)), cast(array() as array<string>), (a, x) -> {step}, a -> concat('/', array_join(a, '/')))")
    return let("d", v, rf"if(d rlike r'(?i)/(\.|%2e){{1,2}}(/|$)', {walked}, d)")


def _serialised_sql(v: str) -> str:
    """SQL: any http(s) address in normal form; null for anything else and for addresses with credentials."""
    start = r"(?i)^https?:[/\\]*"
    host_port = rf"regexp_extract(v, r'{start}(?:[^/\\?#]*@)?([^/\\?#@]*)', 1)"
    parts = ", ".join(
        f"{value} as {name}"
        for name, value in {
            "scheme": "lower(regexp_extract(v, r'(?i)^(https?):', 1))",
            "who": rf"regexp_extract(v, r'{start}([^/\\?#]*)@', 1)",
            "ok": rf"{host_port} rlike r'^(\[[^\]]*\]|[^:]*)(:\d*)?$'",
            "port": rf"regexp_extract({host_port}, r':0*(\d*)$', 1)",
            "path": rf"replace(regexp_extract(v, r'{start}[^/\\?#]*([^?#]*)', 1), r'\', '/')",
            "query": rf"regexp_extract(v, r'{start}[^?#]*(\?[^#]*)', 1)",
            "host": let("w", rf"regexp_extract({host_port}, r'^(\[[^\]]*\]|[^:]*)', 1)", host_sql("w")),
        }.items()
    )
    port = "if(p.port = '' or p.port = if(p.scheme = 'http', '80', '443'), '', concat(':', p.port))"
    ok = "p.scheme in ('http', 'https') and p.who in ('', ':') and p.ok and p.host is not null and (p.port = '' or length(p.port) <= 5 and try_cast(p.port as int) <= 65535)"
    path = _without_dots(_encoded("if(startswith(p.path, '/'), p.path, concat('/', p.path))", _IN_PATH))
    whole = f"if({ok}, concat(p.scheme, '://', p.host, {port}, {path}, {_encoded('p.query', _IN_QUERY)}), null)"
    return let("v", _trimmed(v), let("p", f"struct({parts})", whole))


def _normal_sql(v: str) -> str:
    """SQL: ``v`` in normal form, an address that is so already told by a pattern."""
    plain = rf"b rlike r'{_PLAIN}' and not b rlike r'/\.{{1,2}}(/|$|\?)' and not b rlike '%2[eE]' and not b rlike r'^https?://([^/?]*\.)?(\d+|0x[0-9a-f]*)\.?([/?]|$)'"
    slash = "if(b rlike '^https?://[^/?]+$', concat(b, '/'), regexp_replace(b, r'^(https?://[^/?]+)\\?', '$1/?'))"
    return let("b", rf"regexp_replace({v}, r'#[\s\S]*$', '')", f"if({plain}, {slash}, {_serialised_sql(v)})")


def normalize_url(c: Column) -> Column:
    """http(s) address without fragment in normal form; null for anything else, and for addresses with credentials."""
    bare = without_fragment(c)
    slash = F.when(bare.rlike(r"^https?://[^/?]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"^(https?://[^/?]+)\?", "$1/?"))
    return F.when(_is_plain(bare), slash).otherwise(apply(c, "u", _serialised_sql("u")))


try_normalize_url = normalize_url


def _against(href: Column, base: Column) -> Column:
    """``href`` against an address in normal form (else only a whole ``href`` counts); null unless http(s)."""
    origin, path, scheme = r"regexp_extract(x.b, r'^(https?://[^/?#]*)', 1)", r"regexp_extract(x.b, r'^https?://[^/?#]*([^?#]*)', 1)", r"regexp_extract(x.b, '^(https?:)', 1)"
    relative = (
        rf"case when r rlike r'^[/\\]{{2}}' then concat({scheme}, r) when r rlike r'^[/\\]' then concat({origin}, r) when startswith(r, '?') then concat({origin}, {path}, r)"
        rf" when r = '' or startswith(r, '#') then x.b else concat({origin}, regexp_replace({path}, '[^/]*$', ''), r) end"
    )
    own = rf"lower(regexp_extract(x.h, '^([A-Za-z]*:)', 1)) = {scheme} and x.h rlike r'(?i)^https?:([^/\\]|$)'"
    given = let("r", "if(x.h rlike '(?i)^https?:', regexp_replace(x.h, '^[^:]*:', ''), x.h)", relative)
    placed = f"case when x.h rlike '(?i)^https?:' and not coalesce({own}, false) then x.h when not x.h rlike '(?i)^https?:' and x.h rlike '^[A-Za-z][A-Za-z0-9+.-]*:' then null when x.b is not null then {given} end"
    both = F.struct(href.alias("h"), F.when(base.rlike("^https?://[^/?#]"), without_fragment(base)).alias("b"))
    return apply(both, "y", let("x", f"struct({_trimmed('y.h')} as h, y.b as b)", let("u", placed, _normal_sql("u"))))


def resolve_url(href: Column, base_href: Column | None, page_url: Column) -> Column:
    """``href`` against the first base element's address, itself against the page; null if blank, too long or not http(s)."""
    bare = F.trim(href)
    base = page_url if base_href is None else F.when(base_href.isNull(), page_url).otherwise(F.coalesce(_against(base_href, page_url), page_url))
    return F.when((F.length(bare) > 0) & (F.length(bare) <= 8192), _against(bare, base))


def url_identity(c: Column) -> Column:
    """The address without its fragment; what cannot be parsed stays as it is."""
    return F.coalesce(normalize_url(c), c)


def strip_tracking(c: Column) -> Column:
    """Without tracking parameters; only if one is dropped, the others get an equals sign and plus signs for spaces."""
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    tracked = lambda p: name(p).startswith("utm_") | name(p).isin(*TRACKING)
    bare = without_fragment(c)
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?([\s\S]*)$", 1)
    parts = F.split(query, "&")
    kept = F.filter(parts, lambda p: ~tracked(p) & (p != ""))
    again = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), F.replace(p, F.lit("%20"), F.lit("+"))).otherwise(F.concat(F.replace(p, F.lit("%20"), F.lit("+")), F.lit("=")))), "&")
    return F.when(F.exists(parts, tracked), F.when(again == "", path).otherwise(F.concat_ws("?", path, again))).otherwise(bare)


_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def url_origin(c: Column) -> Column:
    """scheme://host[:port], lower case, without a port that is the scheme's own; null if the address has no host."""
    head = F.regexp_replace(F.lower(F.regexp_extract(c, _HEAD, 0)), r"//[^@/]*@", "//")
    return F.nullif(F.regexp_replace(head, r"^(http://.*):80$|^(https://.*):443$", "$1$2"), F.lit(""))


def url_host(c: Column) -> Column:
    return F.nullif(F.regexp_extract(url_origin(c), r"^[^/]*//(.*?)(:\d+)?$", 1), F.lit(""))


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_port(c: Column) -> Column:
    """The port where it is written and is not the scheme's own; else empty."""
    return F.regexp_extract(url_origin(c), r":(\d+)$", 1)


def url_path(c: Column) -> Column:
    """The path, ``/`` if empty; null if the address has no host."""
    path = F.regexp_extract(c, _HEAD + r"(/[^?#]*)?", 1)
    return F.when(c.rlike(_HEAD), F.when(path == "", F.lit("/")).otherwise(path))


def url_key(c: Column) -> Column:
    """Host and path without one trailing slash: neither scheme nor port, so never an identity."""
    return F.regexp_replace(F.concat(url_host(c), url_path(c)), "/$", "")


def in_scope(c: Column, origin: Column, prefix: Column) -> Column:
    """Same origin, and below the prefix by whole path segments; an empty prefix or ``/`` is the whole origin."""
    stem = F.regexp_replace(prefix, "/$", "")
    below = (url_path(c) == stem) | url_path(c).startswith(F.concat(stem, F.lit("/")))
    return (url_origin(c) == origin) & (F.coalesce(prefix, F.lit("")).isin("", "/") | below)


def canonical_transition(a: Column, b: Column) -> Column:
    """Whether a redirect from ``a`` to ``b`` may move the entry: one ``www.`` more or less, never to http, no other port."""
    named = url_scheme(b).isin("http", "https") & ~F.try_parse_url(a, F.lit("USERINFO")).isNotNull() & ~F.try_parse_url(b, F.lit("USERINFO")).isNotNull()
    down = (url_scheme(a) == "https") & (url_scheme(b) != "https")
    ported = (url_port(a) != "") | (url_port(b) != "")
    www = (url_host(a) == url_host(b)) | (url_host(a) == F.concat(F.lit("www."), url_host(b))) | (url_host(b) == F.concat(F.lit("www."), url_host(a)))
    return F.coalesce(named & ~down & F.when(ported, url_origin(a) == url_origin(b)).otherwise(www), F.lit(False))


def path_segments(c: Column) -> Column:
    return F.array_remove(F.split(url_path(c), "/"), "")


def path_group(c: Column) -> Column:
    """The first path segment, ``(root)`` without one, ``(other)`` where there is no path."""
    return F.when(url_path(c).isNull(), F.lit("(other)")).otherwise(F.coalesce(F.get(path_segments(c), F.lit(0)), F.lit("(root)")))


def path_label(c: Column) -> Column:
    return F.concat(url_path(c), F.regexp_extract(without_fragment(c), r"(\?[\s\S]+)$", 1))


def url_extension(c: Column) -> Column:
    found = F.lower(F.regexp_extract(url_path(c), r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(found == "", F.lit("unknown")).otherwise(F.coalesce(found, F.lit("unknown")))


def normalize_website(c: Column) -> Column:
    """What someone typed: trimmed, with https where no scheme is given."""
    bare = F.trim(c)
    return normalize_url(F.when(bare.rlike(r"(?i)^[a-z][a-z\d+.-]*:"), bare).otherwise(F.concat(F.lit("https://"), bare)))


def is_document_link(c: Column) -> Column:
    return c.rlike(r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv|txt)($|[?#])")
