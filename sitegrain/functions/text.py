"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions have it: more than Java's ``\s``.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MAX_TEXT = 2 * 1024 * 1024
FINGERPRINT = "sha256-text-v1:"


def clean_text(c: Column, most: int) -> Column:
    """Runs of white space to one space, trimmed, cut to ``most`` code points; null stays null."""
    return F.substring(F.btrim(F.regexp_replace(c, SPACE + "+", " ")), 1, most)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_safe(c: Column, strict: bool = True) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula; ``strict``: also after controls, and before tab, CR, LF."""
    risky = r"^[\x00-\x20]*[=+@-]|^[\t\r\n]" if strict else r"^\s*[=+@-]"
    return F.when(c.rlike(risky), F.concat(F.lit("'"), c)).otherwise(c)


def redact_credentials(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"(https?://)[^\s/@]+:[^\s/@]+@", "$1[redacted]@"), 1, 3000)


def content_fingerprint(c: Column) -> Column:
    """A tagged SHA-256 of a text; null if it is empty or may have been cut."""
    return F.when(F.length(c).between(1, MAX_TEXT - 1), F.concat(F.lit(FINGERPRINT), F.sha2(c, 256)))


def is_fingerprint(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^sha256-text-v1:[a-f0-9]{64}$"), F.lit(False))


def word_count(c: Column) -> Column:
    """Pieces between runs of white space; 0 for an empty text."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, SPACE + "+")))


def natural_key(c: Column) -> Column:
    """A value in whose order texts come as readers expect: runs of digits by their value, whatever their length, letters by a Unicode collation.

    Pieces come first, without case and accents, digits as their count and themselves; where these tie, accents and then case decide.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = F.transform(runs, lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
    number = lambda p: p.rlike(r"^\d")
    piece = lambda p: F.struct(
        F.when(number(p), 0).otherwise(1).alias("kind"), F.when(number(p), F.length(p)).otherwise(0).alias("size"), F.when(number(p), p).otherwise("").alias("digits"),
        F.collate(F.when(number(p), "").otherwise(p), "UNICODE_CI_AI").alias("letters"),
    )
    return F.struct(F.transform(bare, piece).alias("pieces"), F.collate(F.array_join(bare, ""), "UNICODE").alias("tie"))


def declares_noindex(meta_robots: Column, x_robots_tag: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(meta_robots, F.lit("")), F.coalesce(x_robots_tag, F.lit(""))).rlike(r"(?i)\bnoindex\b")


def follow_state(rel: Column) -> Column:
    return F.when(rel.rlike(r"(?i)\bnofollow\b"), F.lit("nofollow")).otherwise(F.lit("follow"))


def added_text_percent(raw: Column, rendered: Column) -> Column:
    """Share of the rendered words beyond the raw ones, rounded half up; 0 without rendered words."""
    return F.when(rendered > 0, F.floor(F.greatest(F.lit(0), rendered - raw) / rendered * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
