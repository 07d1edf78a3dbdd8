"""Addresses as column expressions: the stored canonical form, checks, and scores of links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
PROGRAMME_TERMS = ["programme", "program", "programmes", "programs", "degree", "degrees", "study", "bachelor", "master", "msc", "bsc", "course-of-study", "studiengang", "studium"]
TRAP_TERMS = ["login", "account", "calendar", "news", "event", "events", "privacy", "legal", "staff", "people", "publication", "publications", "contact", "search"]
MEDIA_ENDINGS = ["pdf", "jpg", "jpeg", "png", "gif", "zip", "doc", "docx"]
MEDIA = r"\.(?:" + "|".join(MEDIA_ENDINGS) + ")$"
PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\s*$"
EMIT_SCORE = 20


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(c: str | Column) -> Column:
    return F.lower(_part(_c(c), 1))


def host(c: str | Column) -> Column:
    """Host in lower case without port and final dot; '' where there is none."""
    authority = F.regexp_extract(_part(_c(c), 2), r"(?:.*@)?([^@]*)$", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d*$", "")), r"\.+$", "")


def path(c: str | Column) -> Column:
    return _part(_c(c), 3)


def canonical_url(c: str | Column) -> Column:
    """The form under which addresses are compared: scheme and host in lower case, no default port, no final
    slash, no fragment, parameters decoded, sorted by key and value, encoded again, without campaign and click ids.

    Null for other schemes, without host, with credentials, or with a port that is no number.
    """
    u = _c(c)
    authority = _part(u, 2)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme(u) == "http") & (port == "80")) | ((scheme(u) == "https") & (port == "443"))
    shown_port = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    bare = F.regexp_replace(path(u), "/+$", "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), decode(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(F.lit(""))).alias("v"))
    pairs = F.transform(F.filter(F.split(_part(u, 4), "&"), lambda x: x != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin("fbclid", "gclid")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    made = F.concat(scheme(u), F.lit("://"), host(u), shown_port, F.when(bare == "", "/").otherwise(bare), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    good = scheme(u).isin("http", "https") & (host(u) != "") & ~authority.contains("@") & ~authority.rlike(r":[^\]]*[^\d\]]")
    return F.when(good, made)


def without_query(c: str | Column) -> Column:
    return F.substring_index(_c(c), "?", 1)


def without_query_and_fragment(c: str | Column) -> Column:
    return F.substring_index(F.substring_index(_c(c), "#", 1), "?", 1)


def safe_canonical(c: str | Column, most: int = 4096) -> Column:
    """The canonical form without query, or what was given without query, cut."""
    return F.coalesce(without_query(canonical_url(c)), F.substring(without_query(_c(c)), 1, most))


def address_problem(c: str | Column, most: int = 4096) -> Column:
    """Why an address must not be fetched, the first reason that holds; null if it may be."""
    u = _c(c)
    authority = _part(u, 2)
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    number = port.try_cast("int")
    h = host(u)
    private = r"^(?:127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|22[4-9]\.|23\d\.|2[45]\d\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)"
    return (
        F.when(u.isNull() | (F.length(u) > most), "invalid_url")
        .when(~scheme(u).isin("http", "https"), "unsupported_scheme")
        .when(authority.contains("@"), "credentials_not_allowed")
        .when(h == "", "missing_host")
        .when((h == "localhost") | h.endswith(".localhost"), "local_host")
        .when(authority.rlike(r":[^\]]*$") & (port != "") & (number.isNull() | ~number.between(1, 65535)), "invalid_port")
        .when(authority.rlike(r":[^\]\d]*$") & ~authority.endswith(":") & (port == ""), "invalid_port")
        .when(h.rlike(r"^\d+\.\d+\.\d+\.\d+$") & h.rlike(private), "blocked_address")
        .when(h.rlike(r"^[\d.]+$") & ~h.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ambiguous_host")
        .when(h.rlike(r"^0x[0-9a-f.]*"), "ambiguous_host")
    )


def is_host_name(c: str | Column) -> Column:
    v = _c(c)
    return F.coalesce((F.length(v) <= 253) & v.rlike(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"), F.lit(False))


def within_domain(h: str | Column, domain: str | Column) -> Column:
    """The host is the domain or lies under it."""
    a, b = (F.regexp_replace(F.lower(_c(x)), r"\.+$", "") for x in (h, domain))
    return F.coalesce((a == b) | a.endswith(F.concat(F.lit("."), b)), F.lit(False))


def host_suffixes(h: str | Column) -> Column:
    """The host and all domains above it: turns the suffix test into an equi-join."""
    parts = F.split(_c(h), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_trap(c: str | Column) -> Column:
    """A media file, or a path with a segment that never leads to a programme."""
    p = F.lower(path(c))
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(t) for t in TRAP_TERMS])) | p.rlike(MEDIA)


def link_score(url: str | Column, text: str | Column, catalogue: str | Column) -> Column:
    """struct(score, signals): how likely a link leads to a programme, 0 to 100, and why."""
    p, t = F.lower(path(url)), F.lower(F.coalesce(_c(text), F.lit("")))
    trap = F.concat(p, F.lit(" "), t).rlike(r"(?U)(?:^|[\W_/.-])(?:" + "|".join(TRAP_TERMS) + r")(?:$|[\W_/.-])") | p.rlike(MEDIA)
    hits = lambda where: F.array_compact(F.array(*[F.when(where.contains(x), F.lit(x)) for x in sorted(PROGRAMME_TERMS)]))
    in_path, in_text = hits(p), hits(t)
    cat = F.coalesce(_c(catalogue), F.lit(False))
    score = F.least(F.lit(100), 25 * F.size(in_path) + 15 * F.size(in_text) + F.when(cat, 20).otherwise(0))
    shown = lambda name, found: F.when(F.size(found) > 0, F.concat(F.lit(name + ":"), F.array_join(F.slice(found, 1, 4), ",")))
    signals = F.array_compact(F.array(shown("path", in_path), shown("text", in_text), F.when(cat, F.lit("catalogue-context"))))
    return F.when(trap, F.struct(F.lit(0).alias("score"), F.array(F.lit("negative:trap-or-media")).alias("signals"))).otherwise(F.struct(score.cast("int").alias("score"), signals.alias("signals")))
