"""Per-document text statistics, and what kind of text they tell: prose, list, table or junk.

One pass of Arrow batches over the documents, no shuffle.  Scripts without blanks are cut into
pairs of letters first.  Every line is measured, lines
are grouped into blocks, repetition statistics (duplicate lines and paragraphs, the
characters covered by the dominant n-gram) are added, and combined rules give each
character to prose, list, table or junk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, types as T

from tessera.session import spread

# Common words of English, German, French and Spanish.
COMMON = frozenset(
    (
        "the of and to in a is are that for with or by on at be an as it this from which who but not may can will has have their they your you we our its do does what when while where if there them "
        "der die das und ist sind zu den dem des ein eine einer einem einen von für mit auf im werden wird kann als auch nach bei sich oder am an aus dass diese dieser ihre ihren zum zur vom bis nicht wer hat haben nur "
        "le la les et est une un du en pour dans que qui sur par au aux ou avec il elle ils sont se ce cette ces leur leurs ne pas plus son sa ses "
        "el los las y del una con por al es son su sus que o no lo como más para desde entre"
    ).split()
)
KINDS = ("list", "table", "junk")

STATS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("digit_ratio", T.DoubleType()),
        T.StructField("punctuated_line_share", T.DoubleType()),
        T.StructField("bulleted_line_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("duplicate_line_share", T.DoubleType()),
        T.StructField("duplicate_paragraph_share", T.DoubleType()),
        T.StructField("top_2gram_share", T.DoubleType()),
        T.StructField("top_3gram_share", T.DoubleType()),
        T.StructField("top_4gram_share", T.DoubleType()),
        T.StructField("prose_share", T.DoubleType()),
        T.StructField("list_share", T.DoubleType()),
        T.StructField("table_share", T.DoubleType()),
        T.StructField("junk_share", T.DoubleType()),
        T.StructField("kind", T.StringType()),
    ]
)

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
ENDS = re.compile(r"[.!?…:;][\"'»“”)\]]*$")
STOPS = re.compile(r"[.!?…][\"'»“”)\]]*$")
BULLET = re.compile(r"\s*(?:[-*+•‣◦▪·–—►✓☐☑■□●○]|o|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])\s+\S")
ADDRESS = re.compile(r"(?:[-*•]\s*)?(?:https?://|www\.|mailto:)\S+$")
CODE = re.compile(
    r"\bfunction\s*\w*\(|=>|\bvar \w+\s*=|\b(?:const|let) \w+\s*=|\breturn\b.*;\s*$|[{};]\s*$|^\s*[}\])]+[;,]?\s*$|\{\{.*\}\}|\{%.*%\}|\$\{|</?[a-zA-Z][^>]{0,200}>|"
    r"[.#]?[\w-]+\s*\{[^}]*:[^}]*\}|\w+\([^)]*\)\s*;|&[a-z]+;|&#\d+;|\\u[0-9a-f]{4}|^\s*(?:at|File) .*:\d+|\b(?:SELECT|INSERT) .* FROM\b|^\s*(?:import|#include|<\?php)"
)
LONG = re.compile(r"\S{35,}")
GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
#: Marks of letters lost in decoding.  More than one for each two words leaves nothing to read.
DEBRIS = re.compile(r"\ufffd|ï¿½|â€[\u0080-\u00bf\u2018-\u203a™œ]?|Ã[\u0080-\u00bf\u0152-\u0178\u2018-\u203a€™]|Â(?=[\W\u0080-\u00bf]|[a-z])")
DAMAGED = 0.5
ODD = re.compile(r"[{}\[\]<>~^\\§$%&+*#=_@]")
NOT_ALNUM, NOT_DIGIT = re.compile(r"[\W_]+"), re.compile(r"\D+")
#: A word that nobody can say: no vowel, or four consonants in a row.
UNSAYABLE = re.compile(r"^[^aeiouyäöüáéíóúàèìòùâêîôûãõåæøœıěėęąůőű]+$|[bcdfghjklmnpqrstvwxzß]{4}", re.I)
#: Scripts written without blanks: Chinese and Japanese, Thai, Lao, Burmese, Khmer.
UNSPACED = re.compile(r"[\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]+")
FULL_STOPS = str.maketrans({"。": ". ", "！": "! ", "？": "? ", "．": ". ", "।": ". "})
#: What a line of plain prose has none of; anything else is looked at closely.
SPECIAL = re.compile(r"[\t|{}<>;&\\$=(\[#~^§%*+_@/·•–»\ufffdÃâÂï]| [- ]|\S{35}")
RULE = re.compile(r"[\s|+:=-]*[-=]{2,}[\s|+:=-]*$")


@lru_cache(maxsize=4096)  # asked twice for each line
def _cells(line: str) -> tuple[str, int]:
    """How the line is laid out in cells: the separator and the number of cells; ("", 1) for none."""
    text = line.strip()
    if "\t" in text:
        return "\t", len(re.split(r"\t+", text))
    if text.startswith("|") and text.endswith("|") and text.count("|") >= 3:
        return "|", text.count("|") - 1
    bars = len(re.findall(r"(?<=\s)[|¦│](?=\s)", text))
    if bars:
        return "|", bars + 1
    if re.match(r'"[^"]*"(?:[,;]"[^"]*")+$', text):
        return '"', text.count('","') + text.count('";"') + 1
    tight = len(re.findall(r";(?=\S)", text))
    if tight >= 1 and "; " not in text and not ENDS.search(text.rstrip(";")):
        return ";", tight + 1
    tight = len(re.findall(r",(?=\S)", text))
    if tight >= 2 and ", " not in text:
        return ",", tight + 1
    gaps = len(GAPS.findall(text))
    if gaps >= 1:
        return " ", gaps + 1
    return "", 1


def _variety(words: list[str], window: int = 50) -> float:
    """Mean share of different words in windows, so that long texts are not taken for monotonous ones."""
    parts = [words[i : i + window] for i in range(0, max(1, len(words) - window // 2), window)]
    return sum(max(0.0, len(set(p)) - 1) / len(p) for p in parts) / len(parts)


def _common(words: list[str]) -> float:
    return sum(map(COMMON.__contains__, words)) / len(words) if words else 0.0


def segmented(text: str) -> str:
    """Text of scripts without blanks with a blank after every two letters, so that rules on words hold for it."""
    if not UNSPACED.search(text):
        return text

    def apart(m: re.Match) -> str:
        run, whole = m.group(), m.string
        before = m.start() and not whole[m.start() - 1].isspace()
        after = m.end() < len(whole) and whole[m.end()].isalnum()
        return " " * bool(before) + " ".join(run[i : i + 2] for i in range(0, len(run), 2)) + " " * after

    return UNSPACED.sub(apart, text.translate(FULL_STOPS))


def _inline_items(text: str) -> int:
    """Items of a line that is an enumeration and nothing else, 0 for any other line."""
    for mark in ("; ", " / ", " | ", " · ", " • ", " – ", " - ", ", ", " > ", " » "):
        if text.count(mark) < 3:
            continue
        parts = [p.strip() for p in text.split(mark)]
        sizes = [len(WORD.findall(p)) for p in parts]
        if max(sizes) <= 6 and sum(sizes) / len(sizes) <= 3.6 and not any(STOPS.search(p) for p in parts[:-1]):
            upper = sum(p[:1].isupper() or p[:1].isdigit() for p in parts) / len(parts)
            lead = sum(bool(WORD.findall(p)) and WORD.findall(p)[0].lower() in COMMON for p in parts) / len(parts)
            if upper >= 0.7 or (lead < 0.2 and _common([w.lower() for w in WORD.findall(text)]) < 0.2):
                return len(parts)
    return 0


def _line_kind(line: str, words: list[str]) -> str:
    """prose, list, table, junk, short (a few words, no sentence) or rule, of one line by itself with its words in lower case."""
    text = line.strip()
    if len(words) >= 9 and text[-1] in ".!?" and not SPECIAL.search(text) and text.count(", ") < 3 and 2 * sum(map(len, words)) > len(text) and _common(words) >= 0.25 and _variety(words) > 0.2:
        return "prose"
    dense, alnum = len("".join(text.split())), len(NOT_ALNUM.sub("", text))
    if RULE.match(text) and "|" in text:
        return "rule"
    if alnum < 0.35 * dense or len(ODD.findall(text)) > 0.25 * dense:
        return "junk"
    if ADDRESS.match(text):
        return "list"
    code = (any(c in text for c in "{}<>;&\\$=(") or text.startswith(("at ", "File ", "import", "#")) or "SELECT" in text or "INSERT" in text) and bool(CODE.search(text))
    mark, n = _cells(line)
    if mark and n >= 3 and not code and len(words) <= 3.5 * n:
        return "table"
    longest = LONG.search(text)
    if longest and not re.search(r"https?://|www\.", text) and len(longest.group()) > 0.5 * len(text):
        return "junk"
    common = _common(words)
    if code and common < 0.25:
        return "junk"
    if len(words) >= 8 and _variety(words) <= 0.2:
        return "junk"
    if mark and n >= 2 and len(words) <= 5 * n and (common < 0.3 or len(words) <= 4):
        return "table" if n >= 3 or mark in "\t|\";," else "cells2"
    if BULLET.match(line) and not (len(words) >= 9 and STOPS.search(text) and common >= 0.2):
        return "list"
    if _inline_items(text):
        return "list"
    if len(DEBRIS.findall(text)) > DAMAGED * max(1, len(words)):
        return "junk"
    if len(words) >= 7 or (STOPS.search(text) and len(words) >= 3):
        latin = [w for w in words if len(w) >= 3 and w.isascii()]
        if len(latin) >= 6 and common < 0.1 and sum(bool(UNSAYABLE.search(w)) for w in latin) > 0.35 * len(latin):
            return "junk"
        return "prose"
    if not words:
        return "digits"
    return "short"


def _top_gram(words: list[str], n: int) -> tuple[float, int]:
    """Share of the word characters covered by the most frequent n-gram if it is repeated, and its count."""
    total = sum(map(len, words))
    if len(words) < n + 1 or not total:
        return 0.0, 0
    grams = Counter(zip(*(words[i:] for i in range(n))))
    most = max(grams.values())
    if most < 2:
        return 0.0, 1
    best = 0.0
    for gram in [g for g, k in grams.items() if k == most]:
        covered, i = [False] * len(words), 0
        if len(set(gram)) == 1:  # overlapping with itself
            run = sum(len(w) for w in words if w == gram[0])
            best = max(best, run / total)
            continue
        best = max(best, min(1.0, most * sum(map(len, gram)) / total))
    return best, most


def measure(text: str | None) -> dict:
    """All statistics and the kind of one text; null, empty and white-space texts have zeros and no kind."""
    out = {f.name: 0.0 for f in STATS.fields if f.dataType == T.DoubleType()} | {"n_words": 0, "n_lines": 0, "kind": None}
    if text is None or not text.strip():
        return out
    text = segmented(text)
    lines = [x for x in re.split(r"[\n\r\x0b\x0c\x85\u2028\u2029]", text) if x.strip()]
    words_of = [[w.lower() for w in WORD.findall(x)] for x in lines]
    lower = [w for ws in words_of for w in ws]
    dense, alnum, digits = len("".join(text.split())), len(NOT_ALNUM.sub("", text)), len(NOT_DIGIT.sub("", text))
    out["n_words"], out["n_lines"] = len(lower), len(lines)
    out["mean_word_length"] = sum(map(len, lower)) / len(lower) if lower else 0.0
    out["symbol_ratio"], out["digit_ratio"] = (dense - alnum) / dense, digits / dense
    out["punctuated_line_share"] = sum(bool(ENDS.search(x.strip())) for x in lines) / len(lines)
    out["bulleted_line_share"] = sum(bool(BULLET.match(x)) for x in lines) / len(lines)
    out["common_word_share"] = _common(lower)
    total = sum(len(x.strip()) for x in lines)
    counts = Counter(x.strip() for x in lines)
    out["duplicate_line_share"] = sum(len(x) * (k - 1) for x, k in counts.items()) / total
    paragraphs = Counter(p.strip() for p in re.split(r"\n\s*\n", text) if p.strip())
    out["duplicate_paragraph_share"] = sum(len(p) * (k - 1) for p, k in paragraphs.items()) / sum(len(p) * k for p, k in paragraphs.items())
    grams = {n: _top_gram(lower, n) for n in (2, 3, 4)}
    for n, (share, _) in grams.items():
        out[f"top_{n}gram_share"] = share

    kinds = [_line_kind(x, ws) for x, ws in zip(lines, words_of)]
    # a line that fills most of the text by being repeated is noise, whatever it says
    top, times = counts.most_common(1)[0]
    if times >= 4 and len(top) * times >= 0.25 * total and len(counts) < 0.5 * len(lines):
        rest = [k for x, k in counts.items() if x != top and len(WORD.findall(x)) < 7]
        if times >= 0.5 * sum(k for x, k in counts.items() if len(WORD.findall(x)) < 7 or x == top) and (not rest or times > 3 * max(rest)):
            kinds = ["junk" if x.strip() == top else k for x, k in zip(lines, kinds)]
    # tables: neighbours with the same layout; single lines in two cells are no table
    layout = [_cells(x) for x in lines]
    for i, k in enumerate(kinds):
        if k == "cells2":
            near = [layout[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            kinds[i] = "table" if any(n[0] == layout[i][0] for n in near) else "short"
        elif k == "rule":
            kinds[i] = "table"
    # runs of short lines: three or more are a list, digits alone a table column, fewer are headings
    i = 0
    while i < len(kinds):
        if kinds[i] not in ("short", "digits"):
            i += 1
            continue
        j = i
        while j < len(kinds) and kinds[j] in ("short", "digits"):
            j += 1
        after = kinds[j] if j < len(kinds) else None
        before = kinds[i - 1] if i else None
        run = [w for ws in words_of[i:j] for w in ws]
        if j - i >= 2 and len(run) >= 4.5 * (j - i) and _common(run) >= 0.2:  # prose in narrow lines
            kinds[i:j] = ["prose"] * (j - i)
        elif j - i >= 4 or (j - i == 3 and after != "prose"):
            numeric = sum(any(c.isdigit() for c in x) for x in lines[i:j]) / (j - i)
            kinds[i:j] = ["table" if numeric >= 0.5 else "list"] * (j - i)
        elif after in KINDS and after != "junk":
            kinds[i:j] = [after] * (j - i)
        elif before in ("list", "table"):
            kinds[i:j] = [before] * (j - i)
        else:
            kinds[i:j] = ["prose" if "prose" in (before, after) else "heading"] * (j - i)
        i = j
    sizes = Counter()
    for x, k in zip(lines, kinds):
        sizes[k] += len(x.strip())
    # whole-text repetition: one n-gram makes up most of the characters
    share4, n4 = grams[4]
    share2, n2 = grams[2]
    copied = max(out["duplicate_line_share"], out["duplicate_paragraph_share"])
    if (share2 >= 0.5 and n2 >= 8) or (share4 >= 0.6 and n4 >= 6) or (copied >= 0.8 and out["top_3gram_share"] >= 0.1 and grams[3][1] >= 8):
        moved = sizes["prose"] + sizes["heading"]
        sizes["junk"] += moved
        sizes["prose"] = sizes["heading"] = 0
    shown = sizes["prose"] + sum(sizes[k] for k in KINDS)
    if shown:
        for k in ("prose", *KINDS):
            out[f"{k}_share"] = sizes[k] / shown
        if sizes["prose"] < 0.5 * shown:
            out["kind"] = max(KINDS, key=lambda k: sizes[k])
    return out


def _measure(batches: Iterator) -> Iterator:
    import pandas as pd

    names = [f.name for f in STATS.fields]
    for batch in batches:
        rows = [{"doc_id": d} | measure(t) for d, t in zip(batch["doc_id"], batch["text"])]
        yield pd.DataFrame(rows, columns=names)


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row a document, with statistics and kind (null: prose, or nothing to read).

    Null, empty and white-space texts give zeros and a null kind.  Repeated rows stay
    repeated; columns but doc_id and text are ignored; whole texts are read.
    """
    return spread(documents.select("doc_id", "text")).mapInPandas(_measure, STATS)


def not_prose(documents: DataFrame) -> DataFrame:
    return text_statistics(documents).filter("kind is not null").select("doc_id", "kind").distinct()
