"""The address of a page in the one form that all addresses serving it share."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column, functions as F, types as T

#: Query parameters that do not change what is served: campaigns, click ids, sessions, referrers.
CARRIED = re.compile(
    r"(?:utm_\w*|mtm_\w*|pk_\w*|matomo_\w*|piwik_\w*|hsa_\w*|mc_cid|mc_eid|fbclid|gclid|gclsrc|dclid|msclkid|yclid|twclid|igshid|gbraid|wbraid|_ga|_gl|"
    r"ref|referrer|referer|sessionid|session_id|sid|jsessionid|phpsessid|aspsessionid\w*|cfid|cftoken)",
    re.I,
)
INDEX = re.compile(r"/(?:index|default|home)\.(?:html?|php\d?|aspx?|jsp|cgi)$", re.I)
UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _decoded(text: str, plus: bool = False) -> str:
    """Percent codes of unreserved and of non-ASCII characters resolved, all others in capitals."""

    def one(m: re.Match) -> str:
        raw = unquote_to_bytes(m.group())
        try:
            shown = raw.decode("utf-8")
        except UnicodeDecodeError:
            return m.group().upper()
        return "".join(c if ord(c) > 127 or ord(c) in UNRESERVED else "".join(f"%{b:02X}" for b in c.encode()) for c in shown)

    if plus:
        text = text.replace("+", "%20")
    return unicodedata.normalize("NFC", re.sub(r"(?:%[0-9a-fA-F]{2})+", one, text.replace(" ", "%20")))


def page_address(url: str | None) -> str | None:
    """Host, path and content parameters of an http(s) address; None for anything else.

    Scheme, ``www.``, letter case of the host, default ports, fragments, dot and empty
    path segments, a final slash, index files, the order of parameters, their repetition
    and parameters in ``CARRIED`` do not count.
    """
    if url is None:
        return None
    m = re.match(r"\s*(https?):/{2,}([^/?#\s]+)([^?#]*)(?:\?([^#]*))?", url.strip(), re.I)
    if not m:
        return None
    scheme, authority, path, query = m.group(1).lower(), m.group(2).rpartition("@")[2].lower(), m.group(3), m.group(4) or ""
    host, _, port = authority.partition(":") if not authority.startswith("[") else (authority, "", "")
    host = re.sub(r"^www\d?\.", "", host.rstrip("."))
    try:
        if host.startswith("xn--") or ".xn--" in host:
            host = host.encode().decode("idna")
    except UnicodeError:
        pass
    if port and port not in ("80", "443"):
        host += ":" + port
    path = re.sub(r";jsessionid=[^/]*", "", path, flags=re.I)
    parts: list[str] = []
    for part in _decoded(path.replace("\\", "/").strip()).split("/"):
        if part == "..":
            if parts:
                parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    path = INDEX.sub("", "/" + "/".join(parts))
    kept = set()
    for pair in re.split(r"[&;]", query.strip()):
        key, _, value = pair.partition("=")
        if key and not CARRIED.fullmatch(key):
            kept.add((_decoded(key, True), _decoded(value, True)))
    return host + (path.rstrip("/") or "/") + ("?" + "&".join(f"{k}={v}" for k, v in sorted(kept)) if kept else "")


#: Addresses whose form needs nothing but its ends trimmed: lower-case host without www, plain path, no query.
PLAIN = r"^https?://(?!www\d?\.)(?!.*xn--)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+(?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)*/?\z"


def address(column: str | Column) -> Column:
    """``page_address`` as a column: plain addresses by expressions, the others in Python."""
    c = F.col(column) if isinstance(column, str) else column

    @F.pandas_udf(T.StringType())
    def of(values):
        import pandas as pd

        return pd.Series([None if v is None else page_address(v) for v in values], dtype="object")

    bare = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/+$", "")
    plain = F.coalesce(c.rlike(PLAIN) & ~bare.rlike("(?i)" + INDEX.pattern), F.lit(False))
    return F.when(plain, F.when(bare.contains("/"), bare).otherwise(F.concat(bare, F.lit("/")))).otherwise(of(F.when(~plain, c)))
