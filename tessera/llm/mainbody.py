"""The main body of a page, and the lines around it.

Markup is rendered first: a tree builder with implied end tags and visibility rules gives
all visible text, one block a line, with lists and aligned table cells.  The lines, rendered
or stored as such, are then built into a tree again: a heading opens a section, a blank
line, a heading or a line of the site closes it, and whether a section is main body is
decided for the section, by what stands in it.

Which lines are the site's own is learned from all pages, not listed: menus, notices and
footers return from page to page, and they stand before the title or behind all content,
where the sentences and facts about a programme do not.  For every line (numbers and the
site's own name masked), its lead-in before a colon and what follows it, the pages are
counted on which it stands before the title, within the content and behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.rendering import render
from tessera.operators.orphans import clean_key
from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import cut, stored

# ---------------------------------------------------------------- lines

# Labels of facts, names of months and headings of sections, in English and German.
LABELS = re.compile(
    r"(?:programme(?: name)?|program(?: name)?|studiengang|course(?: name)?|title|titel|name|university|provider|hochschule|institution|universität|anbieter|country|land|location|campus|city|standort|ort|studienort|"
    r"qualification|degree(?: awarded)?|abschluss|field of study|subject area|fachrichtung|fachgebiet|studienfeld|language of instruction|teaching language|unterrichtssprache|sprache|study mode|type of study|studienform|studienmodus|"
    r"intake|start semester|start|studienbeginn|beginn|application|apply|bewerbung|bewerbungslink|duration|standard period of study|dauer|regelstudienzeit|studiendauer|tuition(?: fees?)?|fees?|gebühren|studiengebühren|credits|ects|"
    r"admission|zulassung|deadline|bewerbungsfrist|places|plätze|studienplätze)(?:\s*[:–—-]\s*|\s+)\S",
    re.I,
)
#: A label with its mark.
MARKED = re.compile(r"[^:–—]{2,40}(?::|\s[–—-])\s\S")
MONTH = r"(?:jan\w*|feb\w*|mar\w*|mär\w*|apr\w*|may|mai|jun\w*|jul\w*|aug\w*|sep\w*|o[ck]t\w*|nov\w*|de[cz]\w*)"
DATE = re.compile(rf"(?:[-*•–]\s*)?(?:\d{{1,2}}\.?\s+{MONTH}|{MONTH}\s+\d{{1,2}}|\d{{1,2}}\.\d{{1,2}}\.(?:\d{{2,4}})?|\d{{4}}-\d\d-\d\d)\b.{{0,60}}$", re.I)
#: A dated headline.
NEWS = re.compile(rf"(?:\d{{1,2}}\.?\s+{MONTH}|{MONTH}\s+\d{{1,2}}|\d{{1,2}}\.\d{{1,2}}\.(?:\d{{2,4}})?)(?:\s+\d{{4}})?:\s+\D", re.I)
BULLET = re.compile(r"\s*(?:[-*•‣▪◦·+]|\d{1,2}[.)])\s+\S")
TRAIL = re.compile(r"\s(?:[/>»›→|])\s")
MODULES = re.compile(r"(?:modules?|module|modul(?:e|liste|übersicht|plan)|curriculum|what you (?:will )?(?:study|learn)|course contents?|contents|inhalte?|studieninhalte?|studienverlauf|studienplan|lehrinhalte|was sie (?:lernen|studieren)|courses|subjects|fächer)[:.]?", re.I)
DATES = re.compile(r"(?:key dates|deadlines?|fristen|when to apply|important dates|wichtige termine|bewerbungsfristen|dates|termine|application (?:period|deadlines?|dates)|dates and deadlines|termine und fristen)[:.]?", re.I)
QUESTIONS = re.compile(r"(?:questions(?: and answers)?|faqs?|frequently asked questions|häufige fragen|fragen(?: und antworten)?|good to know|your questions)[:.]?", re.I)


def folded(text: str) -> str:
    return " ".join(text.split()).strip()


def _plain_title(text: str) -> str:
    t = folded(text).casefold()
    t = re.sub(r"^(?:master|bachelor)(?: of (?:science|arts))?\b|^(?:m\.?sc\.?|b\.?sc\.?|ph\.?d\.?)(?=\W)", "", t)
    t = re.sub(r"[,(–-]?\s*\b(?:master|bachelor)(?: of (?:science|arts))?\)?$|[,(–-]?\s*(?:m\.?sc\.?|b\.?sc\.?|ph\.?d\.?|doctorate)\)?$", "", t)
    return re.sub(r"[\W_]+", " ", t.replace("&", " and ")).strip()


KINDS = ("blank", "site", "fact", "date", "item", "prose", "question", "trail", "sentence", "short")


def line_kind(line: str) -> str:
    """blank, fact, date, item, prose, question, trail, sentence or short; site for a dated headline."""
    return _kind_of_short(line) if len(line) <= 120 else _kind(line)


@lru_cache(maxsize=50_000)  # lines of the site stand on many pages
def _kind_of_short(line: str) -> str:
    return _kind(line)


def _kind(line: str) -> str:
    text = folded(line)
    words = len(text.split())
    if not text:
        return "blank"
    long = words >= 8 and re.search(r"[.!?…]['\")]?$", text)
    marks = len(TRAIL.findall(text)) + text.count("·")
    if (marks >= 2 or len(re.findall(r"(?<=\S) {2,}(?=\S)", line.strip())) >= 2) and not re.search(r"[.!?]$", text) and not re.match(r"[^:]{3,30}:\s", text):
        return "trail"
    if NEWS.match(text):
        return "site"
    if DATE.match(text):
        return "date"
    label = LABELS.match(text + "x" if text[-1] in ":–—" else text)
    if label and (not long or re.search(r"[:–—]\s*\S$", label.group())) and not text.endswith("?"):
        return "fact"
    if BULLET.match(line):
        return "item"
    if long or words >= 16:
        return "prose"
    if text.endswith("?"):
        return "question"
    if marks >= 1 or len(re.findall(r" {2,}", line.strip())) >= 2:
        return "trail"
    if words >= 4 and re.search(r"[.!…]['\")]?$", text):
        return "sentence"
    return "short"


def _is_heading(text: str) -> bool:
    """A heading of the sections that a programme's page has."""
    return any(h.fullmatch(text) for h in (MODULES, DATES, QUESTIONS))


def find_title(lines: list[str], kinds: list[str], sure: bool = False) -> int:
    """Number of the line that is the programme's title as heading, -1 for none.  ``sure``: only one that the page names elsewhere."""
    first = next((i for i, k in enumerate(kinds) if k in ("prose", "fact")), len(lines))
    named = set()
    for i, (line, k) in enumerate(zip(lines, kinds)):
        if k == "trail" and i < first:
            named.add(_plain_title(re.split(r"\s[/>»›→]\s", folded(line))[-1]))
        if k == "fact":
            m = re.match(r"(?:programme(?: name)?|program(?: name)?|studiengang|course(?: name)?|title|titel)(?:\s*[:–—-]\s*|\s+)(.+)", folded(line), re.I)
            if m:
                named.add(_plain_title(m.group(1)))
    named.discard("")
    exact = [i for i in range(first) if kinds[i] == "short" and _plain_title(lines[i]) in named]
    if exact:
        return exact[-1]
    exact = [i for i in range(len(lines)) if kinds[i] == "short" and _plain_title(lines[i]) in named]
    if exact:
        return exact[0]
    before = [i for i in range(first) if kinds[i] == "short"]
    return before[-1] if before and not sure else -1


def is_main(lines: list[str], site: frozenset[int] = frozenset(), kinds: list[str] | None = None, title: int | None = None) -> list[bool]:
    """For every line whether it is main body.  ``site``: numbers of lines known to be the site's own."""
    kinds = list(kinds) if kinds else [line_kind(x) for x in lines]
    # headings of sections stand everywhere, and a fact with its mark is never the site's
    own = [i for i in site if kinds[i] != "blank" and not _is_heading(folded(lines[i])) and not (kinds[i] == "fact" and MARKED.match(folded(lines[i])))]
    if title is None and own:
        # the title may be as frequent as a line of the site: first without judging short lines
        soft = list(kinds)
        for i in own:
            if kinds[i] not in ("short", "trail"):
                soft[i] = "site"
        title = find_title(lines, soft, sure=True)
        title = None if title < 0 else title
    for i in own:
        if i != title:
            kinds[i] = "site"
    if title is None:
        title = find_title(lines, kinds)
    out = [False] * len(lines)
    body = title if title >= 0 else next((i for i, k in enumerate(kinds) if k in ("prose", "fact")), len(lines))
    if title >= 0:
        out[title] = True
    i = body + (title >= 0)
    n = len(lines)

    def following(j: int) -> int:
        j += 1
        while j < n and kinds[j] == "blank":
            j += 1
        return j

    while i < n:
        k, text = kinds[i], folded(lines[i])
        j = following(i)
        nearest = kinds[j] if j < n else ""
        if k in ("prose", "fact", "date", "item", "sentence"):
            out[i] = True
        elif k == "question":
            out[i] = True
            if i + 1 < n and kinds[i + 1] in ("short", "sentence", "fact", "prose"):
                out[i + 1] = True
                i += 1
        elif MODULES.fullmatch(text) and (nearest == "item" or (nearest == "short" and j == i + 1)):
            out[i] = True
            i = j
            while i < n and kinds[i] in ("item", "short"):
                if kinds[i] == "short" and (MODULES.fullmatch(folded(lines[i])) or DATES.fullmatch(folded(lines[i])) or QUESTIONS.fullmatch(folded(lines[i]))):
                    break
                out[i] = True
                i += 1
            continue
        elif DATES.fullmatch(text) and nearest == "date":
            out[i] = True
        elif QUESTIONS.fullmatch(text) and nearest == "question":
            out[i] = True
        i += 1
    return out


# ---------------------------------------------------------------- over tables

#: One letter a line: main body, around it, known as the site's own, blank.
MAIN, AROUND, SITE, BLANK = "mas "
READ = "cached_file_path string, page_text string, kinds binary, keys array<bigint>, at array<int>, places array<tinyint>"


def site_of(path):
    return F.coalesce(F.nullif(F.regexp_extract(path, r"pages/([^/]+)/", 1), F.lit("")), F.col("cached_file_path"))


def _text(page: str | None) -> str:
    if page and re.search(r"<(?:html|body|div|p|table|ul|h1)\b[^>]*>", page, re.I):
        return render(page)
    return page or ""


PLAINER = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
LEAD_IN = re.compile(r"([^:.!?]{3,60}):\s+(\S.*\S)")


@lru_cache(maxsize=10_000)
def _own_name(site: str):
    """What masks the words that a site's host is made of."""
    parts = sorted({re.escape(t[:5]) for t in re.split(r"[^a-z]+", site.lower()) if len(t) >= 5})
    return re.compile(r"\b(?:" + "|".join(parts) + r")\w*") if parts else None


def masked(text: str, site: str) -> str:
    """A folded line without letter case, with 0 for numbers and a mark for the site's own name."""
    t = re.sub(r"\d+", "0", text.casefold().translate(PLAINER))
    own = _own_name(site)
    return own.sub("§", t) if own else t


def _number(text: str) -> int:
    import xxhash

    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


def line_keys(text: str, site: str) -> list[int]:
    """Numbers of a folded line, and for a sentence of its lead-in before a colon and of what follows."""
    return _keys_of_short(text, site) if len(text) <= 120 else _keys(text, site)


@lru_cache(maxsize=200_000)
def _keys_of_short(text: str, site: str) -> list[int]:
    return _keys(text, site)


def _keys(text: str, site: str) -> list[int]:
    m = masked(text, site)
    out = [_number(m)]
    if "§" in m:  # a word of the host may be a common one
        out.append(_number(masked(text, "")))
    lead = LEAD_IN.fullmatch(m) if ":" in m and (m[-1] in ".!" or m.count(" ") >= 7) else None
    if lead:
        out += [_number("<" + lead.group(1)), _number(">" + lead.group(2))]
    return out


HEAD, WITHIN, TAIL, UNKNOWN, TITLE = 0, 1, 2, 3, 4


def read_page(text: str, site: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Kinds of the lines of a page; and its keys with line and place: before the title, within the content, behind it or as the title.

    Pages without a sure title tell nothing of places.  The content ends with the last fact beside
    another fact, date, list, question or answer.
    """
    lines = text.split("\n")
    kinds = [line_kind(x) for x in lines]
    title = find_title(lines, kinds, sure=True)
    n = len(lines)
    last = title
    if title >= 0:
        main = is_main(lines, kinds=kinds, title=title)
        beside = lambda i: (i and kinds[i - 1] == "fact") or (i + 1 < n and kinds[i + 1] == "fact")
        for i in range(n - 1, title, -1):
            k = kinds[i]
            if main[i] and (k in ("date", "item", "question", "short") or (k == "fact" and beside(i)) or (i and kinds[i - 1] == "question")):
                last = i
                break
    out = []
    for i, line in enumerate(lines):
        if kinds[i] != "blank":
            place = UNKNOWN if title < 0 else TITLE if i == title else HEAD if i < title else WITHIN if i <= last else TAIL
            out.extend((k, i, place) for k in line_keys(folded(line), site))
    return kinds, out


#: A line of the site stands before the title on this share of its pages; content does not.
HEAD_SHARE = 0.08
#: A line that is the title of pages on this share is a programme's name, wherever else it stands.
TITLE_SHARE = 0.01
#: Or it stands within the content on few pages: log likelihoods of a page for (one in eight against one in two), and what they must add up to.
IN_CONTENT, BEHIND, CERTAIN = 1.43, -0.565, -3.4


def site_keys(read: DataFrame) -> DataFrame:
    """key of the lines that are the site's own, by their places on all pages (``read``: keys, places)."""
    each = read.select(F.explode(F.arrays_zip("keys", "places")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    count = lambda p: F.count_if(F.col("place") == p)
    counts = each.groupBy("key").agg(count(HEAD).alias("head"), count(WITHIN).alias("within"), count(TAIL).alias("tail"), count(TITLE).alias("titles"))
    every = F.col("head") + F.col("within") + F.col("tail")
    behind = F.col("within") * IN_CONTENT + F.col("tail") * BEHIND
    return counts.filter((every > 1) & (F.col("titles") <= TITLE_SHARE * every) & ((F.col("head") >= HEAD_SHARE * every) | (behind <= CERTAIN))).select("key")


def flagged_pages(pages: DataFrame) -> DataFrame:
    """cached_file_path, page_text as it is shown, and flags: one letter a line (``MAIN``, ``AROUND``, ``SITE``, ``BLANK``).

    Null pages have no row, empty ones no lines.  A page without title or text of its own has no
    main body.  Further columns are ignored.
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        number = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            out: dict[str, list] = {"page_text": [], "kinds": [], "keys": [], "at": [], "places": []}
            for page, site in zip(batch["page_text"], batch["site"]):
                shown = _text(page)
                kinds, keys = read_page(shown, site)
                out["page_text"].append(shown)
                out["kinds"].append(bytes(number[k] for k in kinds))
                for name, values in zip(("keys", "at", "places"), zip(*keys) if keys else ((), (), ())):
                    out[name].append(list(values))
            yield pd.DataFrame({"cached_file_path": batch["cached_file_path"]} | out)

    def flagged(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for page, raw, own in zip(batch["page_text"], batch["kinds"], batch["own"]):
                kinds = [KINDS[k] for k in raw]
                own = frozenset(own.tolist()) if own is not None else frozenset()
                flags = is_main(page.split("\n"), own, kinds)
                out.append("".join(BLANK if k == "blank" else MAIN if main else SITE if i in own else AROUND for i, (k, main) in enumerate(zip(kinds, flags))))
            yield pd.DataFrame({"cached_file_path": batch["cached_file_path"], "page_text": batch["page_text"], "flags": out})

    pages = pages.select("cached_file_path", "page_text").filter("page_text is not null")
    seen = stored(pages.withColumn("site", site_of(F.col("cached_file_path"))).select("cached_file_path", "page_text", "site").mapInPandas(read, READ))
    own = cut(site_keys(seen))
    each = seen.select(path_key(), F.explode(F.arrays_zip("keys", "at")).alias("x")).select("path", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    hits = salted_join(each, own, "key", F.col("path.a"), "left_semi").groupBy("path").agg(F.collect_set("at").alias("own"))  # at most the lines of a page
    joined = seen.select("cached_file_path", "page_text", "kinds", path_key()).join(hits, "path", "left")
    return joined.select("cached_file_path", "page_text", "kinds", "own").mapInPandas(flagged, "cached_file_path string, page_text string, flags string")


def lines_of():
    """The non-blank lines of a flagged page: line_no (from 1 over all lines), line, main."""
    each = F.transform(F.split("page_text", "\n"), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line"), F.col("flags").substr(i + 1, F.lit(1)).alias("flag")))
    return F.transform(F.filter(each, lambda x: x["flag"] != BLANK), lambda x: F.struct(x["line_no"], x["line"], (x["flag"] == MAIN).alias("main")))


def path_key():
    """16 bytes that stand for a path."""
    return F.struct(F.xxhash64("cached_file_path").alias("a"), F.xxhash64(F.reverse("cached_file_path")).alias("b")).alias("path")


def page_lines(pages: DataFrame) -> DataFrame:
    """cached_file_path, line_no, line, main of every non-blank line."""
    return flagged_pages(pages).select("cached_file_path", F.explode(lines_of()).alias("x")).select("cached_file_path", "x.*")


def _folded(text):
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _pairs(text):
    """Every two neighbouring words of a text."""
    words = F.split(_folded(text), " ")
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


class Shown:
    """A page's lines as words, indexed once for all snippets that quote it."""

    def __init__(self, lines: list[str], main: list[bool], site: list[bool]):
        self.words = [folded(x).split(" ") for x in lines]
        self.main = main
        self.of_main = {" ".join(ws) for ws, m in zip(self.words, main) if m}
        self.singles = {ws[0] for ws, m in zip(self.words, main) if not m and len(ws) == 1} - self.of_main
        self.known = {ws[0] for ws, own in zip(self.words, site) if own and len(ws) == 1}
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for r, ws in enumerate(self.words):
            for c, w in enumerate(ws):
                self.starts.setdefault(w, []).append((r, c))

    @classmethod
    def of(cls, page: str, flags: str) -> "Shown":
        kept = [(x, f) for x, f in zip(page.split("\n"), flags) if f != BLANK]
        return cls([x for x, _ in kept], [f == MAIN for _, f in kept], [f == SITE for _, f in kept])

    def quotes_one_word(self, text: str, words: list[str]) -> bool:
        """A line of the site of one word stands alone, or before or behind a line or fact of the main body.

        The same word within a fact ("Study mode: full_time") is no quotation.
        """
        if text in self.singles:
            return True
        if len(words) < 2:
            return False
        rest = " ".join(words[1:])
        if words[0] in self.singles and not LABELS.match(text) and (rest in self.of_main or LABELS.match(rest)):
            return True
        rest = " ".join(words[:-1])
        return words[-1] in self.singles and (rest in self.of_main or (words[-1] in self.known and bool(LABELS.match(rest))))

    def quoted_in(self, snippet: str) -> bool:
        """The snippet holds a line of the site, or a long part of one, that the main body does not hold."""
        text = folded(snippet)
        if not text:
            return False
        words, shown, main = text.split(" "), self.words, self.main
        if self.quotes_one_word(text, words):
            return True
        i = 0
        while i < len(words):
            best_main = best_site = 0
            whole = False
            for r, c in self.starts.get(words[i], ()):
                ws, n = shown[r], 0
                while i + n < len(words) and c + n < len(ws) and words[i + n] == ws[c + n]:
                    n += 1
                if main[r]:
                    best_main = max(best_main, n)
                else:
                    # a line of the site may run on into the next one
                    rr, total, full = r, n, c == 0 and n == len(ws)
                    while full and rr + 1 < len(shown) and not main[rr + 1]:
                        nxt, m = shown[rr + 1], 0
                        while i + total + m < len(words) and m < len(nxt) and words[i + total + m] == nxt[m]:
                            m += 1
                        total += m
                        rr += 1
                        if m < len(nxt):
                            break
                    if total > best_site or (total == best_site and full):
                        best_site, whole = total, full or total > n
            # part of a line counts if it is long or runs over menu entries: names of the institution and of programmes stand everywhere
            menu = sum(w in "/|>»›→·" for w in words[i : i + best_site])
            if best_site > best_main and ((whole and best_site >= 2) or best_site >= 7 or (best_site >= 3 and menu >= 2)):
                after = words[i + best_site] if i + best_site < len(words) else None
                if best_site >= 3 or after is None or any(c == 0 for _, c in self.starts.get(after, ())):
                    return True
            i += max(1, best_main, 1)
        return False


def boilerplate(pages: DataFrame, evidence: DataFrame, source_pages: DataFrame) -> DataFrame:
    """record_table, record_id, line_no of lines that are no main body, and of evidence that quotes such.

    Evidence without snippet, page, or kept text of its page is no case, nor is a snippet that is the
    extracted value and nothing else.  Keys compare
    without letter case and white space; repeated rows count once.
    """
    flagged = stored(flagged_pages(pages))
    around = (
        # only the letters are read here
        flagged.select("cached_file_path", F.posexplode(F.split("flags", "")).alias("at", "flag"))
        .filter(F.col("flag").isin(AROUND, SITE))
        .select(F.lit("cached_pages").alias("record_table"), F.col("cached_file_path").alias("record_id"), (F.col("at") + 1).cast("bigint").alias("line_no"))
        .distinct()
    )
    not_main = F.transform(F.filter(F.arrays_zip(F.split("page_text", "\n").alias("line"), F.split("flags", "").alias("flag")), lambda x: x["flag"].isin(AROUND, SITE)), lambda x: _folded(x["line"]))
    kept = (
        flagged.filter(F.col("flags").rlike(f"[{AROUND}{SITE}]"))
        .select(path_key(), "page_text", "flags", F.explode(F.array(not_main)).alias("n"))  # computed once
        .withColumn("singles", F.array_distinct(F.transform(F.filter("n", lambda x: ~x.contains(" ")), lambda x: F.hash(x))))
        .withColumn("around", F.array_distinct(F.transform(_pairs(F.array_join("n", " ")), lambda x: F.hash(x))))
        .drop("n")
    )
    where = source_pages.select(clean_key("id").alias("page"), path_key(), "cached_file_path").filter("page is not null and cached_file_path is not null").select("page", "path").distinct()
    asked = evidence.select("id", clean_key("source_page_id").alias("page"), F.col("short_evidence_text").alias("snippet"), F.col("extracted_value").alias("short_value")).filter(
        F.col("page").isNotNull() & (_folded(F.col("snippet")) != "") & ~_folded(F.col("snippet")).eqNullSafe(_folded(F.col("short_value")))  # the bare value quotes nothing
    ).drop("short_value")
    counts = cut(asked.groupBy("page").count())
    placed = salted_join(asked, where, "page", F.col("id"), heavy=heavy_keys(counts, "page", count="count")).drop("page")
    heavy_paths = heavy_keys(counts.join(where, "page").withColumn("a", F.col("path.a")), "a", count="count")
    joined = salted_join(placed.withColumn("a", F.col("path.a")), kept.withColumn("a", F.col("path.a")).withColumnRenamed("path", "kept_path"), "a", F.col("id"), heavy=heavy_paths)
    # only snippets that share two neighbouring words with the lines around, or begin or end with a line of one word, go to Python
    words = F.split(_folded(F.col("snippet")), " ")
    ends = F.array(F.hash(F.element_at(words, 1)), F.hash(F.element_at(words, -1)))
    shared = F.arrays_overlap(F.transform(_pairs(F.col("snippet")), lambda x: F.hash(x)), F.col("around")) | F.arrays_overlap(ends, F.col("singles"))
    likely = joined.filter((F.col("path") == F.col("kept_path")) & shared).select("id", "snippet", "page_text", "flags")

    def judge(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            keep, last, shown = [], None, None
            for snippet, page, flags in zip(batch["snippet"], batch["page_text"], batch["flags"]):
                if last is None or page != last[0] or flags != last[1]:  # the join brings the snippets of a page together
                    last, shown = (page, flags), Shown.of(page, flags)
                keep.append(shown.quoted_in(snippet))
            yield pd.DataFrame({"record_id": batch["id"][keep]})

    quoting = likely.mapInPandas(judge, "record_id string").distinct()
    return around.unionByName(quoting.select(F.lit("evidence_records").alias("record_table"), "record_id", F.lit(0).cast("bigint").alias("line_no")))
