"""Absolute http(s) addresses in one serialisation: a small helper for Arrow functions.

Scheme and host are lower-cased, default ports and dot segments dropped, an empty path is ``/``, characters
that may not stand in a path or query are percent-encoded as UTF-8, and the fragment is removed.
"""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

_PATH_SAFE = "/:@!$&'()*+,;=-._~%[]|\\^"
_QUERY_SAFE = "/:@!$&()*+,;=-._~%[]|\\^{}`?"
_DEFAULT = {"http": 80, "https": 443}
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def absolute(value: str | None, base: str | None = None) -> str | None:
    """``value``, resolved against ``base`` if given; None if it isn't an http(s) address without credentials."""
    if value is None:
        return None
    value = value.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a\x0b\x0c\x0d\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f ")
    value = value.translate({9: None, 10: None, 13: None})
    try:
        if not _SCHEME.match(value):
            if base is None:
                return None
            head = urlsplit(base)
            value = value if not value.startswith("\\") else value.replace("\\", "/")
            value = base.split("#", 1)[0] if value == "" or value.startswith("#") else urljoin(f"{head.scheme}://{head.netloc}{head.path or '/'}{'?' + head.query if head.query else ''}", value)
        parts = urlsplit(value)
        scheme = parts.scheme.lower()
        if scheme not in _DEFAULT or parts.username or parts.password or not parts.hostname:
            return None
        host = parts.hostname.lower()
        if not host.isascii():
            host = host.encode("idna").decode()
        if re.search(r"[\s<>^|%#/?@\\]", host):
            return None
        port = parts.port
        at = f"[{host}]" if ":" in host else host
        if port is not None and port != _DEFAULT[scheme]:
            at += f":{port}"
        path = _dots(quote(parts.path.replace("\\", "/") or "/", safe=_PATH_SAFE))
        query = "?" + quote(parts.query, safe=_QUERY_SAFE) if "?" in value.split("#", 1)[0] else ""
        return f"{scheme}://{at}{path}{query}"
    except (ValueError, UnicodeError):
        return None
