"""The surviving values of each group of records that describe one programme.

A group is an institution, a title and a degree level.  Every member gives up to two records,
what was extracted and what a reviewer set, each with its trust, its recency and its fields, null
cells included.  Records are first reduced to the latest of each (group, trust, set of filled
fields), which is partial aggregation and bounds a group by 2 x 1024 records whatever its size.
Then a record is dominated if another is at least as trusted and recent and fills at least the
same fields; the undominated ones are the skyline.  A lexicographic policy (trust, recency,
completeness, id) orders the skyline; the first record gives its values, and each null is filled
from the next record in that order that has the field.  Completeness is compared by the fields
themselves, not by their number, since trust and recency decide field by field: so every value
that can survive lies in the skyline, and what deeper layers hold is never needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.names import PLACEHOLDERS, entities, name_spellings, read_names, spelling_clusters
from tessera.operators.skew import salted_join
from tessera.session import cut, stored

FIELDS = ["program_name", "university_name", "country_code", "city", "degree_level", "field_category", "teaching_language", "study_mode", "intake", "application_url"]

# Wordings of degree levels.
DEGREES = {
    "phd": r"ph\.?\s?d\.?|d\.?\s?phil\.?|doctorate|doctoral(?: degree| programme)?|doctor(?: of (?:philosophy|science|engineering))?|dr\.?(?: rer\.? nat\.?| phil\.?)?|promotion|doktor(?:at)?",
    "master": r"masters?(?:'s)?(?: degree)?(?: of (?:science|arts|engineering|laws|education|business administration|fine arts|music))?|m\.?\s?sc\.?|m\.?\s?a\.|m\.?\s?eng\.?|m\.?\s?ed\.?|m\.?b\.?a\.?|ll\.?m\.?|mres|mphil|m\.?\s?f\.?a\.?",
    "bachelor": r"bachelors?(?:'s)?(?: degree)?(?: of (?:science|arts|engineering|laws|education|business administration|fine arts|music))?|b\.?\s?sc\.?|b\.?\s?a\.|b\.?\s?eng\.?|b\.?\s?ed\.?|b\.?b\.?a\.?|ll\.?b\.?|b\.?\s?f\.?a\.?|licence|licenciatura|grado",
}
_ANY = "|".join(DEGREES.values())
_LEAD = rf"(?iU)^\s*[\[(]?\s*(?:{_ANY})(?![\p{{L}}\d])\s*[\])]?\s*(?:in\b)?\s*[-–—:,|/]*\s*"
_TAIL = rf"(?iU)\s*[-–—:,|/(\[]*\s*(?<![\p{{L}}\d.])(?:{_ANY})\s*[\])]?\s*$"


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def is_value(c: Column) -> Column:
    """Not null, blank or a placeholder in any wording."""
    return c.isNotNull() & ~spaced(c).rlike(rf"(?iU)^(?:{PLACEHOLDERS.pattern})$")


def degree_of(c: Column) -> Column:
    """bachelor, master or phd where a text is one, whatever its form."""
    out = F.lit(None).cast("string")
    for level, words in DEGREES.items():
        out = F.when(spaced(c).rlike(rf"(?iU)^[\s(]*(?:{words})[\s)]*$"), level).otherwise(out)
    return out


def degree_in_title(c: Column) -> Column:
    """The level a title begins or ends with."""
    out = F.lit(None).cast("string")
    for level, words in DEGREES.items():
        out = F.when(
            spaced(c).rlike(rf"(?iU)^[\[(]?\s*(?:{words})(?![\p{{L}}\d])") | spaced(c).rlike(rf"(?iU)(?<![\p{{L}}\d.])(?:{words})\s*[\])]?$"), level
        ).otherwise(out)
    return out


def title_words(c: Column) -> Column:
    """Words of a title without its degree, in lower case."""
    t = F.regexp_replace(spaced(c), r"&", " and ")
    bare = F.regexp_replace(F.regexp_replace(t, _LEAD, ""), _TAIL, "")
    t = F.when(F.length(F.regexp_replace(bare, r"(?U)[^\p{L}\d]", "")) > 0, bare).otherwise(t)
    return F.filter(F.split(F.lower(F.regexp_replace(t, r"(?U)[^\p{L}\d]+", " ")), " "), lambda w: F.length(w) > 0)


def candidate_records(candidates: DataFrame) -> DataFrame:
    """id, updated_at, records: one row a candidate id with up to two records (trust, values in the order of ``FIELDS``).

    Trust is 0 for data and 1 for overrides.  Placeholders are null cells; a record without any value
    is none.  Of several rows of an id the last updated one counts.  Broken JSON has no values; of
    equal keys in one object the first counts.
    """
    told = lambda c: F.from_json(F.when(F.expr(f"try_parse_json({c}) is not null"), F.col(c)), T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
    rows = candidates.select("id", "updated_at", "normalized_data", "reviewer_overrides").filter("id is not null")
    last = rows.groupBy("id").agg(
        F.max_by(F.struct("normalized_data", "reviewer_overrides"), F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("normalized_data", F.lit("")))).alias("r"), F.max("updated_at").alias("updated_at")
    )
    # the one-element explode keeps each JSON text from being parsed once a field
    read = last.select("id", "updated_at", "r.*").select("id", "updated_at", F.explode(F.array(F.struct(told("normalized_data").alias("d"), told("reviewer_overrides").alias("o")))).alias("x"))
    cells = lambda of: F.transform(F.array(*[F.col(f"x.{of}.{f}") for f in FIELDS]), lambda v: F.when(is_value(v), v))
    both = F.array(F.struct(F.lit(0).alias("trust"), cells("d").alias("values")), F.struct(F.lit(1).alias("trust"), cells("o").alias("values")))
    return read.select("id", "updated_at", F.filter(both, lambda r: F.exists(r["values"], lambda v: v.isNotNull())).alias("records"))


def stated(field: str) -> Column:
    """The value of a field in the data of ``records``, overrides aside."""
    return F.try_element_at(F.filter("records", lambda r: r["trust"] == 0), F.lit(1))["values"][FIELDS.index(field)]


def title_spellings(base: DataFrame) -> DataFrame:
    """The words of all titles as spellings: field ``word``, token, is_cut, uses (titles that have it)."""
    in_titles = base.select(F.explode(F.array_distinct("words")).alias("token"), F.xxhash64("words").alias("title")).distinct()
    return in_titles.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).filter("length(token) >= 2").select(F.lit("word").alias("field"), "token", F.lit(False).alias("is_cut"), "uses")


def titled(records: DataFrame) -> DataFrame:
    """id, name, degree, words of every candidate whose institution, title and degree level are stated."""
    base = stored(
        records.select("id", stated("university_name").alias("name"), stated("program_name").alias("program"), stated("degree_level").alias("level")).filter("name is not null and program is not null")
    )  # the long expressions below read columns, not the records
    return base.select("id", "name", F.coalesce(degree_of(F.col("level")), degree_in_title(F.col("program"))).alias("degree"), title_words(F.col("program")).alias("words")).filter("degree is not null and size(words) > 0")


def programme_groups(base: DataFrame, linked: DataFrame, clusters: DataFrame) -> DataFrame:
    """id, group_id of the rows of ``titled`` that are in groups of two or more.

    ``linked``: name, entity of the institution names; ``clusters``: field, token, cluster.  Words
    of titles are read as the words they are misspellings of.
    """
    meant = clusters.filter("field = 'word' and cluster <> 'word|' || token").select("token", "cluster")
    # a title is mended once, not once a row
    titles = base.groupBy("words").agg(F.count(F.lit(1)).alias("uses")).withColumn("title", F.array_join("words", " "))
    worded = titles.select("title", F.posexplode("words").alias("at", "token"))
    mended = (
        salted_join(worded, meant, "token", F.col("title"), "left")
        .groupBy("title")
        .agg(F.sort_array(F.collect_set(F.struct("at", F.coalesce("cluster", F.concat(F.lit("word|"), "token")).alias("w")))).alias("ws"))
        .select("title", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("title_key"))
    )
    keyed = salted_join(base.withColumn("title", F.array_join("words", " ")), mended, "title", F.col("id"))
    keyed = salted_join(keyed, linked.select("name", "entity"), "name", F.col("id"))
    keyed = keyed.select("id", F.xxhash64("entity", "title_key", "degree").alias("h1"), F.hash("degree", "title_key", "entity").alias("h2")).select("id", F.concat_ws("-", F.hex("h1"), F.hex("h2")).alias("group_id"))
    keyed = stored(keyed)
    several = keyed.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("group_id")
    return salted_join(keyed, several, "group_id", F.col("id"), "left_semi")


def dominates(y: Column, x: Column) -> Column:
    """y is at least as trusted and recent as x and fills all its fields, and differs in one of these."""
    at_least = (y["trust"] >= x["trust"]) & (y["at"] >= x["at"]) & (y["filled"].bitwiseAND(x["filled"]) == x["filled"])
    return at_least & ((y["trust"] > x["trust"]) | (y["at"] > x["at"]) | (y["filled"] != x["filled"]))


def skylines(records: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, skyline: the undominated records of each group (trust, at, filled, id, values) in the order of the policy."""
    filled = lambda vs: F.aggregate(F.transform(vs, lambda v, i: F.when(v.isNotNull(), F.pow(F.lit(2.0), i).cast("int")).otherwise(F.lit(0))), F.lit(0), lambda a, b: a + b)
    cells = (
        records.join(groups, "id")
        .select("group_id", "id", F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("at"), F.explode("records").alias("r"))
        .select("group_id", "id", "at", "r.trust", "r.values", filled(F.col("r.values")).alias("filled"))
        # the smaller id counts among equals: the latest of a set of fields hides the others
        .groupBy("group_id", "trust", "filled")
        .agg(F.max("at").alias("at"), F.min_by(F.struct("id", "values"), F.struct(-F.unix_micros(F.col("at").cast("timestamp")), F.col("id"))).alias("of"))
    )
    gathered = cells.groupBy("group_id").agg(F.collect_list(F.struct("trust", "at", "filled", "of")).alias("cells"))
    undominated = F.filter("cells", lambda x: ~F.exists("cells", lambda y: dominates(y, x)))
    order = lambda x: F.struct(-x["trust"], -F.unix_micros(x["at"].cast("timestamp")), -F.bit_count(x["filled"]), x["of"]["id"], x["filled"], x["of"]["values"].alias("values"))
    return gathered.select("group_id", F.sort_array(F.transform(undominated, order)).alias("s")).select(
        "group_id", F.transform("s", lambda x: F.struct((-x["col1"]).alias("trust"), (-x["col2"]).alias("at"), x["filled"].alias("filled"), x["id"].alias("id"), x["values"].alias("values"))).alias("skyline")
    )


def surviving_values(skyline: DataFrame) -> DataFrame:
    """group_id, field_name, candidate_id, value, rank: for each field the first record of the skyline that has it, and its place.

    No row for a field without a value in the group.
    """
    placed = F.transform("skyline", lambda r, i: F.struct(r["id"].alias("id"), r["values"].alias("values"), i.alias("rank")))
    having = lambda f: F.try_element_at(F.filter(placed, lambda r: r["values"][f].isNotNull()), F.lit(1))
    first = F.array(*[having(f) for f in range(len(FIELDS))])
    each = skyline.select("group_id", F.posexplode(first).alias("f", "r")).filter("r is not null")
    names = F.array(*[F.lit(f) for f in FIELDS])
    return each.select("group_id", names[F.col("f")].alias("field_name"), F.col("r.id").alias("candidate_id"), F.col("r.values")[F.col("f")].alias("value"), F.col("r.rank").alias("rank"))


def survivors(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """The surviving values of all groups.  ``names``: every institution name of the data (name string).

    Candidates without id, with broken JSON, or with no institution, title or degree level
    belong to no group.  Repeated rows of an id are one member.  Other columns are ignored.
    """
    records = stored(candidate_records(candidates))
    base = stored(titled(records))
    read = cut(read_names(names))
    # names and titles are mended in one clustering
    clusters = cut(spelling_clusters(name_spellings(read).unionByName(title_spellings(base))))
    groups = stored(programme_groups(base, entities(read, clusters), clusters))
    return surviving_values(skylines(records, groups))
