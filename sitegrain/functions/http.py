"""Functions over response metadata."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.hosts import ipv4_octets, ipv6_groups

RETRYABLE = (408, 429, 500, 502, 503, 504)
#: Response headers that are kept.
KEPT_HEADERS = (
    "content-type", "content-length", "content-language", "cache-control", "etag", "last-modified", "expires", "server", "x-powered-by", "x-robots-tag",
    "strict-transport-security", "content-security-policy", "referrer-policy", "location", "vary",
)


def mime_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def charset(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*\"?([^\s;\"]+)", 1))


def inspect_headers(headers: Column) -> Column:
    """The kept headers, values cut to 4000 characters."""
    return F.transform_values(F.map_filter(headers, lambda k, v: k.isin(*KEPT_HEADERS)), lambda k, v: F.substring(v, 1, 4000))


def failure_kind(message: Column) -> Column:
    """What a connection's error message is about: the first kind that fits."""
    return (
        F.when(message.rlike(r"(?i)ENOTFOUND|EAI_AGAIN|DNS"), "dns")
        .when(message.rlike(r"(?i)CERT_|CERTIFICATE|TLS|SSL|SELF_SIGNED"), "tls")
        .when(message.contains("ECONNREFUSED"), "connection-refused")
        .when(message.rlike("ENETUNREACH|EHOSTUNREACH"), "unreachable")
        .when(message.rlike("(?i)ETIMEDOUT|timed out"), "timeout")
        .otherwise("network")
    )


def access_challenge(headers: Column, status: Column, sample: Column) -> Column:
    """struct<kind, provider> where a response is a provider's security check, else null."""
    header = lambda name: F.coalesce(F.element_at(headers, name), F.lit("")) == "challenge"
    vercel = header("x-vercel-mitigated") | (status.isin(403, 429, 503) & F.coalesce(sample, F.lit("")).rlike(r"(?i)<title[^>]*>\s*Vercel Security Checkpoint\s*</title>"))
    provider = F.when(vercel, "Vercel").when(header("cf-mitigated"), "Cloudflare")
    return F.when(provider.isNotNull(), F.struct(F.lit("access-challenge").alias("kind"), provider.alias("provider")))


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def retry_after_ms(header: Column, at: Column) -> Column:
    """A retry-after header in milliseconds from ``at``: seconds, or an HTTP date; else null."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(header.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.round(F.trim(header).try_cast("double") * 1000)).when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(date) - F.unix_millis(at)).cast("double"))).cast("long")


# Prefixes of addresses that are not public.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
PRIVATE_V6 = ("2001::/23", "2001:db8::/32", "2002::/16", "3fff::/16")
#: Global unicast; what lies outside is not public.
UNICAST_V6 = ("2000::/3",)


def _within(first: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether an address (its first 32 bits) lies in one of the prefixes, of at most 32 bits each."""
    parsed = [ip_network(p) for p in prefixes]
    rows = F.array(*(F.struct(F.lit((int(n.network_address) >> n.max_prefixlen - 32) >> 32 - n.prefixlen).cast("long").alias("value"), F.lit(2 ** (32 - n.prefixlen)).cast("long").alias("size")) for n in parsed))
    return F.exists(rows, lambda p: F.floor(first / p["size"]) == p["value"])


def is_public_ip(c: Column) -> Column:
    """Global unicast addresses: not private, loopback, link-local, shared, documentation, benchmark, multicast or reserved.

    An address is taken as a number, whichever way it is written; what is no address is not public.
    """
    octets, groups = ipv4_octets(c), ipv6_groups(F.regexp_replace(c, r"%[0-9A-Za-z.:-]+$", ""))
    number = lambda parts, base: F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * base + x)
    v4, v6 = number(octets, 256), number(F.slice(groups, 1, 2), 65536)
    return F.coalesce(F.when(octets.isNotNull(), ~_within(v4, PRIVATE_V4)).otherwise(_within(v6, UNICAST_V6) & ~_within(v6, PRIVATE_V6)), F.lit(False))


def raster_type(data: Column) -> Column:
    """png, jpeg, gif, webp or avif by the first bytes; else null."""
    h = F.hex(F.substring(data, 1, 40))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 64).rlike("^(..)*?(61766966|61766973)"), "image/avif")
    )
