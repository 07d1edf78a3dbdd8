"""Quantities written in many units and wordings, brought to one unit.

The distinct unit spellings of the data, a small set next to the rows, are mapped to known
units by fuzzy matching: an inverted index of character n-grams proposes units, a weighted
edit distance accepts or refuses them.  The accepted spellings form an alias dictionary
that is joined to all rows.  Everything around it is built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.operators.skew import salted_join
from tessera.session import cut, stored

# Units of time in months, with their known spellings (English, German, French, Spanish).
UNITS = {
    "semester": (6.0, ["semester", "semesters", "semestre", "semestres", "sem", "fachsemester"]),
    "trimester": (4.0, ["trimester", "trimesters", "trimestre", "trimestres"]),
    "month": (1.0, ["month", "months", "mo", "mos", "mth", "mths", "m", "monat", "monate", "monaten", "mois", "mes", "meses", "mon"]),
    "year": (12.0, ["year", "years", "yr", "yrs", "y", "jahr", "jahre", "jahren", "j", "an", "ans", "année", "années", "annee", "annees", "año", "años", "ano", "anos"]),
    "week": (12.0 / 52.0, ["week", "weeks", "wk", "wks", "w", "woche", "wochen", "semaine", "semaines", "semana", "semanas"]),
    "day": (12.0 / 365.0, ["day", "days", "d", "tag", "tage", "tagen", "jour", "jours", "día", "días", "dia", "dias"]),
}
# Number words.
NUMBER_WORDS = {
    1: ["one", "ein", "eine", "einem", "einer", "eins", "un", "une", "uno", "una"],
    2: ["two", "zwei", "deux", "dos"],
    3: ["three", "drei", "trois", "tres"],
    4: ["four", "vier", "quatre", "cuatro"],
    5: ["five", "fünf", "cinq", "cinco"],
    6: ["six", "sechs", "seis"],
    7: ["seven", "sieben", "sept", "siete"],
    8: ["eight", "acht", "huit", "ocho"],
    9: ["nine", "neun", "neuf", "nueve"],
    10: ["ten", "zehn", "dix", "diez"],
    11: ["eleven", "elf", "onze", "once"],
    12: ["twelve", "zwölf", "douze", "doce"],
}
LETTERS = "a-zäöüßéèñíáóú"
#: Words of a wording that leaves the duration open: ranges, alternatives, bounds.
OPEN = (
    r"(?U)\b(?:or|oder|ou|to|bis|up to|at least|at most|not more than|no more than|no less than|more than|less than|under|over|between|zwischen|entre|min|max|"
    r"minimum|maximum|mindestens|höchstens|maximal|minimal|ab|from|au moins|au plus|al menos|hasta|jusqu)\b|[<>≤≥]|\d\s*\+"
)


def _replace_words(text: Column) -> Column:
    for value, words in NUMBER_WORDS.items():
        text = F.regexp_replace(text, rf"(?U)\b(?:{'|'.join(words)})\b(?!\.)", str(value))
    return text


def plain(text: Column) -> Column:
    """Lower case, single spaces, digits for number words, decimals with a point, halves as .5."""
    t = F.regexp_replace(F.lower(text), r"(?U)[\s   ​﻿]+", " ")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"(?U)(?<!and )\b(?:a|one) half (?=year)", "0.5 ")
    t = F.regexp_replace(t, "½", " 1/2")
    t = _replace_words(t)
    t = F.regexp_replace(t, r"(?U)\b(\d+) (?:and a half|und 1 halb\w*|et demie?|y medio|y media)\b", "$1.5")
    t = F.regexp_replace(t, r"(?U)\b1(?:einhalb|½)\b|\banderthalb\b|\beineinhalb\b", "1.5")
    t = F.regexp_replace(t, r"(\d) ?1/2\b", "$1.5")
    t = F.regexp_replace(t, r"(?<![\d.])1/2\b", "0.5")
    t = F.regexp_replace(t, r"\bp(\d+)y(\d+)m\b", "$1 years $2 months")
    t = F.regexp_replace(t, r"\bp(\d+(?:\.\d+)?)y\b", "$1 years")
    t = F.regexp_replace(t, r"\bp(\d+(?:\.\d+)?)m\b", "$1 months")
    t = F.regexp_replace(t, r"\bp(\d+(?:\.\d+)?)w\b", "$1 weeks")
    t = F.regexp_replace(t, r"\bp(\d+(?:\.\d+)?)d\b", "$1 days")
    return F.trim(t)


#: Words that bring in what a duration holds, or may; and parts of a study.
HOLDS = r"(?:incl|including|included|inkl|inklusive|einschließlich|einschl|of which|davon|thereof|inclusive)"
BESIDE = r"(?:plus|with|mit|avec|con)"
PARTS = r"(?:intern\w*|thes[ie]s|thèse|tesis|placement\w*|praktik\w*|praxis\w*|practic\w*|prácticas?|stage\w*|\w*arbeit|project\w*|projekt\w*|abroad|ausland\w*|prep\w*|vorbereit\w*|foundation|exam\w*|prüfung\w*|break|language|sprach\w*|ects|credits?)"


def core(text: Column) -> Column:
    """``plain`` without brackets, credits and the parts of the study (``incl. 20-week internship``).

    A clause behind ``with`` or ``plus`` goes only if it names a part of the study.
    """
    t = F.regexp_replace(plain(text), r"\([^)]*\)?", " ")
    return _bare_of_parts(t)


def bracketed(text: Column) -> Column:
    """What stands in brackets, read like ``core``: it counts where the text around states no duration."""
    return _bare_of_parts(F.array_join(F.regexp_extract_all(plain(text), F.lit(r"\(([^)]*)\)?"), F.lit(1)), " ; "))


def _bare_of_parts(t: Column) -> Column:
    t = F.regexp_replace(t, rf"(?U)[,;]?\s*\b{HOLDS}\b.*$", " ")
    t = F.regexp_replace(t, rf"(?U)[,;]?\s*\b{BESIDE}\b(?=.*\b{PARTS}\b).*$", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\d+(?:\.\d+)?[\s-]*(?:ects|credits?|cp|lp|kp|credit points?|leistungspunkte|points?|créditos|crédits)\b(?:[\s-]*(?:credits?|points?|punkte))?", " "))


def is_open(text: Column) -> Column:
    """The wording leaves the duration open."""
    return text.rlike(OPEN) | text.rlike(r"\d\s*[-–—‒/~]\s*\d") | text.rlike(rf"(?U)\d\s*[{LETTERS}]+\s*[-–—‒/]\s*\d")


PIECE = rf"(?U)(?<![\d.])(\d+(?:\.\d+)?)[\s-]*(?:(?:academic|full|calendar|akademische|studien|full-time|volle|años|consecutive)[\s-]+)?([{LETTERS}]+)"


def pieces(text: Column) -> Column:
    """(amount, unit spelling) of every number that a word follows."""
    numbers = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(PIECE), F.lit(2))
    return F.arrays_zip(numbers.alias("amount"), words.alias("spelling"))


def _grams(word: Column, n: int = 2) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, n)))


#: Letters that are taken for each other in writing cost half an edit.
NEAR = [set("eéè"), set("aáä"), set("oóö"), set("uúü"), set("ií1l"), set("nñ"), set("mn"), set("sz")]


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with adjacent swaps; near letters and doubled letters cost half."""
    inf = float(len(a) + len(b))
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            best = inf
            if i:
                best = min(best, rows[i - 1][j] + (0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0))
            if j:
                best = min(best, rows[i][j - 1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
            if i and j:
                same = a[i - 1] == b[j - 1]
                near = any(a[i - 1] in s and b[j - 1] in s for s in NEAR)
                best = min(best, rows[i - 1][j - 1] + (0.0 if same else 0.5 if near else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 0.75)
            rows[i][j] = best
    return rows[-1][-1]


def unit_aliases(spellings: DataFrame) -> DataFrame:
    """spelling, unit, months_each of each distinct spelling that is close enough to one unit.

    Spellings of up to four letters must be known exactly, longer ones may be off by an
    edit for each five letters.  A spelling as close to two units maps to none.
    """
    spark = spellings.sparkSession
    known = spark.createDataFrame([(k, u, m) for u, (m, words) in UNITS.items() for k in words], "known string, unit string, months_each double")
    index = known.select("known", "unit", "months_each", F.explode(_grams(F.col("known"))).alias("gram"))
    words = spellings.select("spelling").distinct().filter(F.length("spelling") > 0)
    asked = words.select("spelling", F.size(_grams(F.col("spelling"))).alias("n"), F.explode(_grams(F.col("spelling"))).alias("gram"))
    proposed = (
        asked.join(F.broadcast(index), "gram")  # a fixed list: bounded by UNITS
        .groupBy("spelling", "known", "unit", "months_each", "n")
        .agg(F.count(F.lit(1)).alias("shared"))
        # an edit of cost 1 takes away four 2-grams at most (two near letters, or a swap at 0.75 three)
        .filter((F.col("spelling") == F.col("known")) | ((F.length("spelling") > 4) & (F.col("shared") >= F.col("n") - 4 * F.floor(F.length("spelling") / 5))))
    )

    @F.pandas_udf(T.DoubleType())
    def distance(a, b):
        import pandas as pd

        return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")

    judged = proposed.withColumn("distance", distance("spelling", "known")).filter(
        (F.col("distance") == 0) | (F.col("distance") <= F.floor(F.length("spelling") / 5))
    )
    best = judged.groupBy("spelling", "unit", "months_each").agg(F.min("distance").alias("distance"))
    return (
        best.groupBy("spelling")
        .agg(F.min_by(F.struct("unit", "months_each"), "distance").alias("u"), F.min("distance").alias("d"), F.sort_array(F.collect_list("distance")).alias("all"))
        .filter((F.size("all") == 1) | (F.try_element_at("all", F.lit(2)) > F.col("d")))
        .select("spelling", "u.unit", "u.months_each")
    )


ALIAS_BOUND = 50_000


def stated_parts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, _raw, _within, _amount, spelling: the numbers with a word behind of every text that is not open.

    ``_within``: 0 for the text itself, 1 for what it has in brackets.
    """
    # the one-element explode keeps the long expressions from being copied into each use
    told = rows.select(*keys, F.explode(F.array(F.struct(core(F.col(text)).alias("_t"), bracketed(F.col(text)).alias("_b")))).alias("_c"), F.col(text).alias("_raw"))
    told = told.filter(F.col("_c._t").isNotNull() & ~is_open(F.col("_c._t")))
    inner = F.when(is_open(F.col("_c._b")), F.lit("")).otherwise(F.col("_c._b"))
    told = told.select(*keys, "_raw", F.posexplode(F.array(F.col("_c._t"), inner)).alias("_within", "_t")).filter("_t <> ''")
    return told.select(*keys, "_raw", "_within", F.explode(pieces(F.col("_t"))).alias("_x")).select(*keys, "_raw", "_within", F.col("_x.amount").cast("double").alias("_amount"), F.col("_x.spelling").alias("spelling"))


def with_months(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and months of each row whose text states one duration; one row a key and text.

    Null, blank and open texts, texts without a unit, and several different durations that
    are not the years and months of one give no row; texts of any length are read.  What stands
    in brackets counts only where the text around it states nothing.  Months are rounded to
    whole ones.
    """
    told = stored(stated_parts(rows, keys, text))
    aliases = cut(unit_aliases(told.select("spelling")))
    if aliases.limit(ALIAS_BOUND + 1).count() <= ALIAS_BOUND:  # checked size
        told = told.join(F.broadcast(aliases), "spelling")
    else:
        told = salted_join(told, aliases, "spelling", F.xxhash64(*keys))
    each = F.col("_amount") * F.col("months_each")
    parts = told.groupBy(*keys, "_raw", "_within").agg(
        F.sum(each).alias("_sum"),
        F.max(each).alias("_max"),
        F.min(F.round(each, 3)).alias("_least"),
        F.max(F.round(each, 3)).alias("_most"),
        F.sort_array(F.collect_set("unit")).alias("_units"),
        F.count(F.lit(1)).alias("_n"),
    )
    mixed = (F.col("_n") == 2) & (F.col("_units") == F.array(F.lit("month"), F.lit("year"))) & (F.col("_least") < 12)
    value = F.when(F.col("_least") == F.col("_most"), F.col("_max")).when(mixed, F.col("_sum"))
    parts = parts.select(*keys, "_raw", "_within", F.round(value).cast("bigint").alias("_m"))
    first = parts.groupBy(*keys, "_raw").agg(F.min_by("_m", "_within").alias("months"))
    return first.filter("months > 0").select(*keys, F.col("_raw").alias(text), "months")


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " ")).rlike(r"^\d+(?:[.,]\d+)?$")


def candidate_statements(candidates: DataFrame) -> DataFrame:
    """Texts of each candidate that may state its duration; a broken JSON text has none."""
    get = lambda k: F.get_json_object("normalized_data", f"$.{k}")
    value, unit = get("duration_value"), F.nullif(F.trim(get("duration_unit")), F.lit(""))
    semesters = get("duration_semesters")
    texts = F.array(
        get("duration"),
        F.when(_bare(value) & unit.isNotNull(), F.concat_ws(" ", value, unit)).otherwise(value),
        F.when(_bare(semesters), F.concat(semesters, F.lit(" semesters"))).otherwise(semesters),
    )
    return candidates.filter(F.expr("try_parse_json(normalized_data) is not null")).select(
        F.lit("candidate_records").alias("record_table"), F.col("id").alias("record_id"), F.explode(texts).alias("text")
    )


def evidence_statements(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.col("field_name").isin("duration_value", "duration_unit", "duration_semesters")).select(
        F.lit("evidence_records").alias("record_table"), F.col("id").alias("record_id"), F.col("extracted_value").alias("text")
    )


def durations(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """record_table, record_id, duration_months of each row that states one duration.

    A row whose keys state different durations states none.  Rows without id are kept
    under a null id; repeated rows count once; other columns are ignored.
    """
    rows = candidate_statements(candidates).unionByName(evidence_statements(evidence)).filter("text is not null").distinct()
    found = with_months(rows, ["record_table", "record_id"])
    return (
        found.groupBy("record_table", "record_id")
        .agg(F.min("months").alias("duration_months"), F.max("months").alias("_most"))
        .filter(F.col("duration_months") == F.col("_most"))
        .drop("_most")
    )
