"""Hosts of addresses: IPv4 and IPv6 as numbers, domain names in ASCII.

The functions give SQL text for a value that is named in SQL, so that a long expression is parsed once where it is used, and not built
call by call. Names with other letters than ASCII are written by the rules of IDNA 2003, so that a sharp s is two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"{_OCTET}(\.{_OCTET}){{3}}"
_HEX = "[0-9a-f]{1,4}"
#: Flag of java.net.IDN: names may have letters that are newer than its tables.
_ALLOW_UNASSIGNED = 1


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def apply(value: Column, name: str, body: str) -> Column:
    """Column: SQL ``body``, in which ``name`` stands for ``value``."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def octets_sql(v: str) -> str:
    """SQL: the four octets of a dotted address without leading zeros; else null."""
    return f"if({v} rlike r'^{_DOTTED}$', transform(split({v}, r'\\.'), o -> int(o)), null)"


def groups_sql(v: str) -> str:
    """SQL: the eight 16-bit groups of an address in lower case, with ``::`` or a dotted end or not; else null."""
    ended = let(
        "q", octets_sql(f"regexp_extract({v}, r'([^:]*)$', 1)"),
        f"if(contains({v}, '.'), concat(regexp_extract({v}, r'^([\\s\\S]*:)', 1), lower(hex(q[0] * 256 + q[1])), ':', lower(hex(q[2] * 256 + q[3]))), {v})",
    )
    few = f"({_HEX}(:{_HEX})*)?"
    sides = "transform(array(0, 1), i -> array_remove(split(coalesce(get(split(t, '::'), i), ''), ':'), ''))"
    whole = f"t rlike r'^({few}::{few}|{_HEX}(:{_HEX}){{7}})$' and (not contains(t, '::') or size(s[0]) + size(s[1]) <= 7)"
    every = "concat(s[0], array_repeat('0', greatest(8 - size(s[0]) - size(s[1]), 0)), s[1])"
    return let("t", ended, let("s", sides, f"if({whole}, transform({every}, g -> int(conv(g, 16, 10))), null)"))


def _short(groups: str) -> str:
    """SQL: groups as text, the first of the longest runs of zeros as ``::``."""
    at = " ".join(f"when instr(t, '{':0' * n}:') > 0 then concat(substring(t, 1, instr(t, '{':0' * n}:') - 1), '::', substring(t, instr(t, '{':0' * n}:') + {2 * n + 1}))" for n in range(8, 1, -1))
    return let("t", f"concat(':', array_join(transform({groups}, g -> lower(hex(g))), ':'), ':')", f"regexp_replace(case {at} else t end, r'^:(?!:)|(?<!:):$', '')")


def _ipv4(name: str) -> str:
    """SQL: a name that ends in a number as a dotted address: up to four parts, octal, decimal or hexadecimal; null if it is none."""
    part = (
        "case when x rlike '^0x[0-9a-f]*$' then coalesce(cast(conv(nullif(substring(x, 3), ''), 16, 10) as decimal(20, 0)), 0) when x rlike '^0[0-7]+$' then cast(conv(x, 8, 10) as decimal(20, 0))"
        r" when x rlike r'^(0|[1-9]\d*)$' then cast(conv(x, 10, 10) as decimal(20, 0)) end"
    )
    ok = "size(n) <= 4 and not exists(n, x -> x is null) and not exists(slice(n, 1, size(n) - 1), x -> x > 255) and n[size(n) - 1] < cast(power(256D, 5 - size(n)) as decimal(20, 0))"
    octets = ", ".join(f"string(if(size(n) > {i + 1}, bigint(n[least({i}, size(n) - 1)]), bigint(n[size(n) - 1]) div {256 ** (3 - i)} % 256))" for i in range(4))
    return let("n", rf"transform(split(regexp_replace({name}, r'\.$', ''), r'\.'), x -> {part})", f"if(coalesce({ok}, false), concat_ws('.', {octets}), null)")


def host_sql(v: str) -> str:
    """SQL: a host as it stands in a normal address; null if it can't be one."""
    decoded = f"if(contains({v}, '%'), try_url_decode(replace({v}, '+', '%2B')), {v})"
    name = f"replace(regexp_replace(lower({decoded}), '[\u3002\uff0e\uff61]', '.'), '\u00ad', '')"
    forbidden = r"h = '' or h rlike r'[\x00-\x20#%/:<>?@\[\\\]^|\x7F]'"
    in_ascii = f"try_reflect('java.net.IDN', 'toASCII', h, {_ALLOW_UNASSIGNED})"
    named = rf"case when {forbidden} then null when h rlike r'[^\x00-\x7F]' then {in_ascii} when h rlike r'(^|\.)(\d+|0x[0-9a-f]*)\.?$' then {_ipv4('h')} else h end"
    six = let("k", groups_sql(rf"lower(regexp_extract({v}, r'^\[([^\]]*)\]$', 1))"), f"if(k is null, null, concat('[', {_short('k')}, ']'))")
    return f"if(startswith({v}, '['), {six}, {let('h', name, named)})"


def ipv4_octets(c: Column) -> Column:
    """The four octets of a dotted address without leading zeros; else null."""
    return apply(c, "v", octets_sql("v"))


def ipv6_groups(c: Column) -> Column:
    """The eight 16-bit groups of an address; else null."""
    return apply(F.lower(c), "v", groups_sql("v"))
