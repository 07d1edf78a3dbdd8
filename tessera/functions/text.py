"""Text, hash and check expressions.  All are built-in column expressions.

Nulls stay null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column, most: int = 2000) -> Column:
    """White space of any kind folded to one blank, trimmed, cut to ``most`` characters; null gives ''."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", " ")), 1, most)


def excerpt(label: str | Column, value: str | Column, most: int = 500) -> Column:
    """``label: value``, cleaned and cut."""
    return clean_text(F.concat(F.coalesce(_c(label), F.lit("")), F.lit(": "), F.coalesce(_c(value), F.lit(""))), most)


def formula_safe(c: str | Column) -> Column:
    """A cell that no spreadsheet takes for a formula: an apostrophe before = + - @ tab and return; null gives ''."""
    return F.when(_c(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _c(c))).otherwise(F.coalesce(_c(c), F.lit("")))


def fold_key(c: str | Column) -> Column:
    """Key of texts that differ in letter case and white space only; sharp s equals ss."""
    return F.replace(F.lower(clean_text(c, 1 << 30)), F.lit("ß"), F.lit("ss"))


def html_escape(c: str | Column) -> Column:
    out = F.replace(_c(c), F.lit("&"), F.lit("&amp;"))
    for raw, shown in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def content_hash(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def cache_path(host: str | Column, digest: str | Column, content_type: str | Column) -> Column:
    """Where a page of a host and content hash is kept."""
    ending = F.when(F.lower(F.coalesce(_c(content_type), F.lit(""))).contains("text/plain"), ".txt").otherwise(".html")
    return F.concat(F.lit("pages/"), F.substring(F.sha2(F.lower(_c(host)), 256), 1, 20), F.lit("/"), _c(digest), ending)


def country_code(c: str | Column) -> Column:
    """Two ASCII letters in capitals, null for anything else."""
    up = F.upper(F.trim(_c(c)))
    return F.when(up.rlike("^[A-Z]{2}$"), up)


def is_label(c: str | Column) -> Column:
    """A reviewer label: letters, digits, blank and . _ - up to 80 characters, no mail address."""
    return F.coalesce(_c(c).rlike(r"^[\p{L}0-9][\p{L}0-9 ._-]{0,79}$"), F.lit(False))


def is_output_name(c: str | Column) -> Column:
    return F.coalesce(_c(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$") & ~_c(c).contains(".."), F.lit(False))
