"""Normal forms of field values.  Null in, null out; no match gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import clean_text

# Fixed values.
DEGREE_FORMS = {
    "bachelor": r"(?iU)\b(?:b\.?\s*sc\.?|bachelor(?: of science)?)(?!\w)",
    "master": r"(?iU)\b(?:m\.?\s*sc\.?|master(?: of science)?)(?!\w)",
    "phd": r"(?iU)\b(?:ph\.?d\.?|doctorate|dr\.?-?ing\.?)(?!\w)",
}
COUNTRIES = {"germany": "DE", "deutschland": "DE", "netherlands": "NL", "france": "FR", "italy": "IT", "spain": "ES", "united kingdom": "GB", "austria": "AT", "switzerland": "CH"}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
#: Degrees that a programme's name may begin or end with: abbreviations by their parts, and words with what may follow.
NAMED_DEGREES = [("b", "sc"), ("m", "sc"), ("ph", "d"), ("bachelor",), ("master",)]
JOINTS = "-–—,:"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def degree(c: str | Column) -> Column:
    """bachelor before master before phd, by whole words."""
    out = F.lit(None).cast("string")
    for level, form in reversed(DEGREE_FORMS.items()):
        out = F.when(_c(c).rlike(form), level).otherwise(out)
    return out


def _degree_wording() -> str:
    """One expression for all ``NAMED_DEGREES``: parts may be dotted and, for the sciences, spaced."""
    spelled = []
    for parts in NAMED_DEGREES:
        if len(parts) == 1:
            spelled.append(parts[0] + "(?: of science)?")
        else:
            spelled.append(parts[0] + r"\.?" + (r"\s*" if parts[1] == "sc" else "") + parts[1] + r"\.?")
    return "(?:" + "|".join(spelled) + ")"


def program_name(c: str | Column) -> Column:
    """Without one degree before and one behind, with at most one joint; the whole name if nothing else is left."""
    t = F.when(_c(c).isNotNull(), clean_text(_c(c)))
    joint = rf"\s*[{JOINTS}]?\s*"
    bare = F.regexp_replace(t, rf"(?iU)^{_degree_wording()}{joint}", "")
    bare = clean_text(F.regexp_replace(bare, rf"(?iU){joint}{_degree_wording()}$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), t)


def teaching_language(c: str | Column) -> Column:
    """English, German, both, or ``bilingual`` where it says so and names not both."""
    low = F.lower(clean_text(_c(c)))
    english = low.contains("english") | low.contains("englisch")
    german = low.contains("german") | low.contains("deutsch")
    return F.when(english & german, "English and German").when(low.contains("bilingual"), "bilingual").when(english, "English").when(german, "German")


def study_mode(c: str | Column) -> Column:
    """By words with blanks or hyphens between them; other joints (``full_time``) are unknown."""
    low = F.when(_c(c).isNotNull(), F.replace(F.lower(clean_text(_c(c))), F.lit("-"), F.lit(" ")))
    return (
        F.when(low.contains("hybrid") | low.contains("blended"), "hybrid")
        .when(low.contains("online") | low.contains("distance"), "online")
        .when(low.contains("part time"), "part_time")
        .when(low.contains("full time"), "full_time")
        .when(low.isNotNull(), "unknown")
    )


def duration(c: str | Column) -> Column:
    """struct(value, unit, semesters) of ISO years and months, else of the first number before a unit; null for none."""
    t = F.lower(_c(c))
    iso_n, iso_u = F.regexp_extract(t, r"^\s*p(\d{1,9})([ym])\s*$", 1), F.regexp_extract(t, r"^\s*p(\d{1,9})([ym])\s*$", 2)
    word = r"(?U)\b(\d{1,9}|" + "|".join(NUMBERS) + r")\s+(semester|year|month)s?\b"
    raw, unit = F.regexp_extract(t, word, 1), F.regexp_extract(t, word, 2)
    words = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    n = F.coalesce(raw.try_cast("int"), F.try_element_at(words, raw))
    made = lambda v, u, s: F.struct(v.cast("int").alias("value"), u.alias("unit"), s.cast("int").alias("semesters"))
    i = iso_n.try_cast("int")
    iso = F.when(iso_u == "y", made(i, F.lit("years"), i * 2)).otherwise(
        F.when(F.pmod(i, F.lit(6)) == 0, made((i / 6), F.lit("semesters"), i / 6)).otherwise(made(i, F.lit("months"), F.lit(None)))
    )
    prose = made(n, F.concat(unit, F.lit("s")), F.when(unit == "semester", n).when(unit == "year", n * 2))
    return F.when(iso_u != "", iso).when(unit != "", prose)


def country(c: str | Column) -> Column:
    """ISO letters in capitals, or the code of a known name."""
    t = F.trim(_c(c))
    names = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).otherwise(F.try_element_at(names, F.lower(t)))


def metadata_title(c: str | Column) -> Column:
    """Text before the first separator of a page title."""
    return F.trim(F.element_at(F.split(_c(c), r"(?U)\s+[|–—]\s+", 2), 1))


def checked_override(field: str | Column, value: str | Column) -> Column:
    """struct(ok, value, error) of a reviewer's value; blank clears a field and is allowed."""
    f, v = _c(field), F.trim(_c(value))
    made = lambda ok, x, e: F.struct(F.lit(ok).alias("ok"), x.alias("value"), F.lit(e).cast("string").alias("error"))
    norm = F.when(f == "degree_level", degree(v)).when(f == "teaching_language", teaching_language(v)).when(f == "country_code", country(v)).when(f == "study_mode", study_mode(v))
    null = F.lit(None).cast("string")
    return (
        F.when(v.isNull() | (F.length(v) > 2000), made(False, null, "length"))
        .when(v == "", made(True, F.lit(""), None))
        .when(f.isin("degree_level", "teaching_language", "country_code"), F.when(norm.isNotNull(), made(True, norm, None)).otherwise(made(False, null, "value")))
        .when(f == "study_mode", F.when(norm != "unknown", made(True, norm, None)).otherwise(made(False, null, "value")))
        .when(f.isin("duration_value", "duration_semesters"), F.when(v.rlike("^0*[1-9][0-9]{0,8}$"), made(True, v, None)).otherwise(made(False, null, "number")))
        .when(f.isin("application_url", "source_url"), F.when(v.rlike(r"(?i)^https?://[^/?#\s@]+"), made(True, v, None)).otherwise(made(False, null, "url")))
        .otherwise(made(True, v, None))
    )
