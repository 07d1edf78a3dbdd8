"""robots.txt and sitemaps: one Arrow pass each."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, functions as F, types as T

MOST_SITEMAPS, MOST_ROBOTS, MOST_XML = 20, 512 * 1024, 20 * 1024 * 1024


def robots_sitemaps(body: str | Column) -> Column:
    """Sitemap addresses a robots.txt declares, in order, 20 at most (a rule of the format's readers)."""
    lines = F.split(F.regexp_replace(F.col(body) if isinstance(body, str) else body, "\r", "\n"), "\n")
    hits = F.filter(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == "sitemap")
    urls = F.transform(hits, lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    return F.slice(F.filter(urls, lambda u: u != ""), 1, MOST_SITEMAPS)


def robots_allowed(body: str | Column, url: str | Column, agent: str) -> Column:
    """allowed, disallowed or invalid (too large) by the rules of a robots.txt."""

    @F.pandas_udf(T.StringType())
    def judge(bodies, urls):
        from urllib.robotparser import RobotFileParser

        import pandas as pd

        known: dict[str, RobotFileParser] = {}
        out = []
        for b, u in zip(bodies, urls):
            if u is None:
                out.append(None)
            elif b is not None and len(b.encode()) > MOST_ROBOTS:
                out.append("invalid")
            else:
                if b not in known:
                    known[b] = RobotFileParser()
                    known[b].parse((b or "").splitlines())
                out.append("allowed" if known[b].can_fetch(agent, u) else "disallowed")
        return pd.Series(out, dtype="object")

    return judge(body, url)


def parse_sitemap(content: bytes | None) -> tuple[list[str], bool, bool]:
    """(addresses, is an index, is valid) of a sitemap, plain or gzipped."""
    if not content:
        return [], False, False
    try:
        if content[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(content)) as z:
                content = z.read(MOST_XML + 1)
        if len(content) > MOST_XML or b"<!DOCTYPE" in content[:4096] or b"<!ENTITY" in content[:4096]:
            return [], False, False
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, OSError, EOFError, ValueError, zlib.error):
        return [], False, False
    kind = root.tag.rpartition("}")[2]
    if kind not in ("urlset", "sitemapindex"):
        return [], False, False
    return [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and (e.text or "").strip()], kind == "sitemapindex", True


def sitemap_locations(files: DataFrame) -> DataFrame:
    """sitemap_url, ord, loc, is_index of each address; an unreadable file gives one row with a null loc.

    ``files``: sitemap_url, content (binary).
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = {"sitemap_url": [], "ord": [], "loc": [], "is_index": []}
            for url, content in zip(batch["sitemap_url"], batch["content"]):
                locs, index, valid = parse_sitemap(content)
                for i, loc in enumerate(locs if valid else [None]):
                    out["sitemap_url"].append(url)
                    out["ord"].append(i)
                    out["loc"].append(loc)
                    out["is_index"].append(index)
            yield pd.DataFrame(out)

    return files.select("sitemap_url", "content").mapInPandas(read, "sitemap_url string, ord int, loc string, is_index boolean")
