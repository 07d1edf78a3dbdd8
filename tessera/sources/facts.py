"""Facts of an HTML page as rows: one tree for each page, one Arrow pass.

Each row: page, ord, kind (jsonld, meta, title, heading, label, link, warning), name, value, locator.
Naming fields, normal forms and deduplication follow as column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.functions import values
from tessera.functions.markup import Node, build_tree, hidden, text_of
from tessera.functions.text import clean_text, excerpt

# Fixed values.
NOISE = frozenset("script style noscript nav footer header form aside".split())
MOST_BYTES, MOST_JSONLD, MOST_JSON_CHARS, MOST_LABELS, MOST_LINK_TEXT = 5 * 1024 * 1024, 20, 200_000, 1000, 300
PROGRAMME_TYPES = {"Course", "EducationalOccupationalProgram", "CourseInstance"}
INSTITUTION_TYPES = {"CollegeOrUniversity", "EducationalOrganization", "ResearchOrganization"}
LABEL_FIELDS = {
    "programme": "program_name", "program": "program_name", "programme name": "program_name", "program name": "program_name",
    "university": "university_name", "institution": "university_name", "provider": "university_name",
    "degree": "degree_level", "degree awarded": "degree_level", "qualification": "degree_level",
    "language of instruction": "teaching_language", "teaching language": "teaching_language", "language": "teaching_language",
    "duration": "duration", "standard period of study": "duration", "standard duration of studies": "duration",
    "location": "city", "campus": "city", "city": "city", "main locations": "city",
    "country": "country_code", "country code": "country_code",
    "study mode": "study_mode", "mode of study": "study_mode", "type of study": "study_mode",
    "start semester": "intake", "intake": "intake", "field of study": "field_category", "subject area": "field_category",
    "application": "application_url", "application url": "application_url", "apply": "application_url",
}
CARD = re.compile("card|spec|box|flex__")
INSTITUTION = ("university", "universität", "universitaet")
#: Beside the fact itself: the address it resolves to, the page's first heading, whether the page shows a programme, whether it has og:title.
FACTS = "page_url string, ord int, kind string, name string, value string, locator string, resolved string, first_heading string, shows_programme boolean, has_og boolean"
MOST_HEADINGS = 5


def _walk(root: Node, skip_noise: bool):
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.children) if isinstance(c, Node) and not (skip_noise and (c.tag in NOISE or hidden(c))))


def _line(node: Node) -> str:
    return " ".join(text_of(node, NOISE).split())


def _json_objects(found):
    todo = [found]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            yield x
            if "@graph" in x:
                todo.append(x["@graph"])


def page_facts(url: str, html: str | None) -> list[tuple[str, str, str, str]]:
    """(kind, name, value, locator) in the order of the page; nothing for an empty or oversized page."""
    if not html or len(html.encode("utf-8", "ignore")) > MOST_BYTES:
        return []
    root = build_tree(html)
    out: list[tuple[str, str, str, str]] = []
    blocks = [n for n in _walk(root, False) if n.tag == "script" and n.attrs.get("type", "").lower().strip() == "application/ld+json"]
    for n in blocks[:MOST_JSONLD]:
        raw = "".join(c for c in n.children if isinstance(c, str))
        if len(raw) > MOST_JSON_CHARS:
            out.append(("warning", "oversized_json_ld", "", "json-ld"))
            continue
        try:
            found = json.loads(raw)
        except ValueError:
            out.append(("warning", "invalid_json_ld", "", "json-ld"))
            continue
        for x in _json_objects(found):
            kinds = x.get("@type")
            kinds = set(kinds if isinstance(kinds, list) else [kinds]) - {None}
            text = lambda v: v if isinstance(v, str) and v.strip() else None
            if kinds & PROGRAMME_TYPES:
                provider = x.get("provider")
                for name, v in (("program_name", x.get("name")), ("university_name", provider.get("name") if isinstance(provider, dict) else None), ("teaching_language", x.get("inLanguage")), ("duration", x.get("timeToComplete"))):
                    if text(v):
                        out.append(("jsonld", name, v, f"json-ld:{name}"))
            if kinds & INSTITUTION_TYPES:
                place = x.get("address")
                for name, v in (("university_name", x.get("name")), ("country_code", place.get("addressCountry") if isinstance(place, dict) else None)):
                    if text(v):
                        out.append(("jsonld", name, v, f"json-ld:{name}"))
    canonical = None
    for n in _walk(root, False):
        if n.tag == "meta" and n.attrs.get("content"):
            key = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
            if key in ("og:site_name", "og:title", "author", "publisher"):
                out.append(("meta", key, n.attrs["content"], f"meta:{key}"))
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href"):
            canonical = canonical or resolved(url, n.attrs["href"])
        elif n.tag == "title" and _line(n):
            out.append(("title", "title", _line(n), "title"))
    if canonical:
        out.append(("link", "source", canonical.split("?")[0], "link:canonical"))
    elif url:
        out.append(("link", "source", url.split("?")[0], "source-page-record"))
    institution = _institution(out)
    if institution:
        out.append(("meta", "institution", *institution))
    labels = headings = 0
    named = False
    for n in _walk(root, True):
        if n.tag == "h1" and headings < MOST_HEADINGS and not named:
            headings += 1
            if headings == 1:  # what stands beside the first one, which may be empty
                beside = " ".join(x for x in map(_line, _neighbours(root, n)) if x)
            if _line(n):
                named = True
                out.append(("heading", "h1", _line(n), "h1"))
                out.append(("beside", "h1", beside, "h1[1]:adjacent-degree-context"))
        pairs: list[tuple[str, str, str]] = []
        kids = [c for c in n.children if isinstance(c, Node)]
        if n.tag == "dl":
            for a, b in zip(kids, kids[1:]):
                if a.tag == "dt" and b.tag == "dd":
                    pairs.append((_line(a), _value(b), "definition-list"))
        elif n.tag == "tr":
            cells = [c for c in kids if c.tag in ("td", "th")]
            if len(cells) >= 2:
                pairs.append((_line(cells[0]), _value(cells[1]), "table"))
        elif any(c.tag == "br" for c in kids):
            for line in text_of(n, NOISE, breaks=True).split("\n"):
                label, mark, value = line.partition(":")
                if mark and label.strip() and value.strip():
                    pairs.append((" ".join(label.split()), " ".join(value.split()), "labelled-lines"))
        elif n.tag == "p" and kids and kids[0].tag in ("strong", "b") and not "".join(c for c in n.children[: n.children.index(kids[0])] if isinstance(c, str)).strip():
            pairs.append((_line(kids[0]), _line(n)[len(_line(kids[0])) :].strip(" :"), "inline-strong"))
        shown = [c for c in kids if c.tag not in NOISE and not hidden(c)]
        if CARD.search(n.attrs.get("class") or ""):
            value = " ".join(" ".join(_line(c) for c in shown if c.tag != "strong").split())
            # the value of a card with a heading begins with the heading, as in the reference
            pairs.extend((_line(c), value, "labelled-card") for c in shown if c.tag in ("strong", "h2", "h3", "h4", "h5", "h6") and value != _line(c))
        for a, b in zip(shown, shown[1:]):
            if a.tag == "p":
                strong = [c for c in a.children if isinstance(c, Node) and c.tag == "strong"]
                if strong and _line(a).strip(" :") == _line(strong[-1]).strip(" :"):  # no value of its own: it stands in the next element
                    pairs.append((_line(strong[-1]), _line(b), "labelled-paragraph"))
        for label, value, where in pairs:
            if label and value and labels < MOST_LABELS:
                labels += 1
                out.append(("label", label, value, where))
    return out


def _neighbours(root: Node, node: Node) -> list[Node]:
    """The elements right before and behind a node."""
    parent = next((p for p in _walk(root, True) if any(c is node for c in p.children)), root)
    around = [c for c in parent.children if isinstance(c, Node) and not (c.tag in NOISE or hidden(c))]
    at = next(i for i, c in enumerate(around) if c is node)
    return around[max(0, at - 1) : at] + around[at + 1 : at + 2]


def resolved(url: str | None, target: str) -> str | None:
    """``target`` as an absolute http(s) address, seen from the page."""
    try:
        joined = urljoin(url or "", target.strip())
    except ValueError:
        return None
    return joined if re.match(r"(?i)https?://[^/?#]", joined) else None


def _field(label: str) -> str | None:
    return LABEL_FIELDS.get(" ".join(label.split()).lower().rstrip(":"))


def described(url: str | None, html: str | None) -> list[tuple]:
    """The facts of a page as rows of ``FACTS`` without page_url."""
    found = page_facts(url, html)
    heading = next((v for k, _, v, _ in found if k == "heading"), None)
    has_og = any(k == "meta" and n == "og:title" for k, n, _, _ in found)
    shows = any((k == "label" and _field(n)) or (k == "jsonld" and n in ("program_name", "duration", "teaching_language")) for k, n, _, _ in found)
    return [(i, k, n, v, where, resolved(url, v) if k == "label" and _field(n) == "application_url" else None, heading, bool(shows), has_og) for i, (k, n, v, where) in enumerate(found)]


def _institution(found: list[tuple[str, str, str, str]]) -> tuple[str, str] | None:
    """(value, locator) of the first that names a university: author, segments of the title from its end, publisher."""
    first: dict[str, str] = {}
    for _, name, value, _ in (x for x in found if x[0] in ("meta", "title")):
        first.setdefault(name, " ".join(value.split()))
    tried = [(first.get("author", ""), "meta:author")]
    tried += [(x.strip(), "title:institution-segment") for x in reversed((first.get("og:title") or first.get("title", "")).split("|"))]
    tried.append((first.get("publisher", ""), "meta:publisher"))
    return next(((v, where) for v, where in tried if any(x in v.casefold() for x in INSTITUTION)), None)


def _value(cell: Node) -> str:
    """The text of a cell; where it speaks of applying, the address it links to."""
    text = _line(cell)
    if re.search(r"appl(?:y|ication)", text, re.I):
        link = next((n.attrs["href"] for n in _walk(cell, True) if n.tag == "a" and n.attrs.get("href")), None)
        if link:
            return link
    return text


def html_facts(pages: DataFrame) -> DataFrame:
    """Rows of ``FACTS`` of all pages (page_url, html); columns of other names are ignored."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(u, *f) for u, h in zip(batch["page_url"], batch["html"]) for f in described(u, h)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return pages.select("page_url", "html").mapInPandas(read, FACTS)


def html_links(pages: DataFrame) -> DataFrame:
    """page_url, ord, target (absolute), text of each anchor with an http(s) target."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for u, h in zip(batch["page_url"], batch["html"]):
                anchors = [n for n in _walk(build_tree(h or ""), False) if n.tag == "a" and n.attrs.get("href")]
                for i, n in enumerate(anchors):
                    target = resolved(u, n.attrs["href"])
                    if target:
                        rows.append((u, i, target, _line(n)[:MOST_LINK_TEXT]))
            yield pd.DataFrame(rows, columns=["page_url", "ord", "target", "text"])

    return pages.select("page_url", "html").mapInPandas(read, "page_url string, ord int, target string, text string")


def suggestions(facts: DataFrame) -> DataFrame:
    """page_url, ord, field_name, extracted_value, normalized_value, locator, excerpt, confidence of the pages that describe a programme.

    A page does if it has programme metadata, a known label or a degree in its first heading.  Labels
    whose value has no normal form are dropped; so are languages and durations of metadata, other
    metadata stand as they are.  A duration gives its value, unit and semesters; a degree in the first
    heading, or else right beside it, is evidence too.  Of equal (field, folded value, locator) the first
    counts.  The facts are read once: everything here is a projection and one aggregation.
    """
    fields = F.create_map(*[F.lit(x) for kv in LABEL_FIELDS.items() for x in kv])
    label = F.regexp_replace(F.lower(clean_text("name")), ":+$", "")
    kind, name = F.col("kind"), F.col("name")
    og_title = (kind == "meta") & (name == "og:title")
    titled = og_title | (kind == "title")
    f = (
        F.when(kind == "jsonld", name)
        .when(kind == "label", F.try_element_at(fields, label))
        .when(kind == "heading", "program_name")
        .when(kind == "beside", "degree_level")
        .when((kind == "meta") & name.isin("og:site_name", "institution"), "university_name")
        .when(titled, "program_name")
        .when(kind == "link", "source_url")
    )
    has_h1 = F.col("first_heading").isNotNull()
    shown = facts.filter(F.col("shows_programme") | values.degree("first_heading").isNotNull())
    rows = shown.withColumn("field_name", f).filter("field_name is not null")
    rows = rows.filter(~(titled & has_h1) & ~((kind == "title") & F.col("has_og")) & ~((kind == "beside") & values.degree("first_heading").isNotNull()))
    # a degree in the heading is a second piece of evidence of the same fact
    also = F.when((kind == "heading") & values.degree("value").isNotNull(), F.array(F.struct(F.lit("program_name").alias("field_name"), F.col("locator")), F.struct(F.lit("degree_level").alias("field_name"), F.lit("h1[1]:controlled-degree-token").alias("locator"))))
    rows = rows.withColumn("_e", F.explode(F.coalesce(also, F.array(F.struct("field_name", "locator"))))).withColumns({"field_name": F.col("_e.field_name"), "locator": F.col("_e.locator")})
    raw = clean_text(F.when(titled, values.metadata_title("value")).otherwise(F.col("value")))
    rows = rows.withColumn("extracted_value", raw).filter("extracted_value <> ''")
    field, v = F.col("field_name"), F.col("extracted_value")
    normal = (
        F.when(field == "degree_level", values.degree(v))
        .when(field == "program_name", values.program_name(v))
        .when(field == "teaching_language", values.teaching_language(v))
        .when(field == "study_mode", values.study_mode(v))
        .when(field == "country_code", values.country(v))
        .when((field == "application_url") & (kind == "label"), F.col("resolved"))
        .otherwise(v)
    )
    # metadata without a normal form stands as it is
    normal = F.when((kind == "jsonld") & ~field.isin("teaching_language", "duration"), F.coalesce(normal, v)).otherwise(normal)
    time = F.col("_time")
    parts = F.filter(
        F.array(
            F.struct(F.lit("duration_value").alias("field_name"), time["value"].cast("string").alias("normalized_value")),
            F.struct(F.lit("duration_unit").alias("field_name"), time["unit"].alias("normalized_value")),
            F.struct(F.lit("duration_semesters").alias("field_name"), time["semesters"].cast("string").alias("normalized_value")),
        ),
        lambda x: x["normalized_value"].isNotNull(),
    )
    told = F.when(field == "duration", parts).otherwise(F.array(F.struct(field.alias("field_name"), normal.alias("normalized_value"))))
    rows = rows.withColumn("_time", F.when(field == "duration", values.duration(v))).withColumn("_f", F.explode(told)).filter("_f.normalized_value is not null")
    confidence = F.when(kind.isin("meta", "title", "beside") | F.col("locator").startswith("h1[1]:"), "medium").otherwise("high")
    rows = rows.select("page_url", "ord", "_f.field_name", "extracted_value", "_f.normalized_value", "locator", excerpt("name", "extracted_value").alias("excerpt"), confidence.alias("confidence"))
    key = ["page_url", "field_name", "folded", "locator"]
    rows = rows.withColumn("folded", F.lower("normalized_value"))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("page_url", "field_name", "locator", "r.*")
