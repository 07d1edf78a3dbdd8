"""Agreement and conflict between pieces of evidence, by candidate and field.

Input: evidence rows with candidate_id, field_name, extracted_value, normalized_value,
confidence, source_page_id and an order (``ord``).  Every operator is one or two partially
aggregated group-bys on (candidate, field); a hot candidate costs no single task its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
SUPPORTED = ["program_name", "university_name", "country_code", "city", "degree_level", "field_category", "teaching_language", "duration_value", "duration_unit", "duration_semesters", "study_mode", "intake", "application_url", "source_url"]
CORE = ["program_name", "university_name", "degree_level", "teaching_language", "source_url"]


def rank(confidence: str | Column) -> Column:
    """high 0, medium 1, low 2; unknown confidence counts as low."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def priority(confidence: str | Column) -> Column:
    return rank(confidence) + 1


def ranked_evidence(evidence: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Supported evidence with value (normalised, else as extracted; '' counts as absent), folded value, rank and order.

    Exact duplicate rows stay; no operator on the result counts rows.  With ``candidates`` (id, source_page_id), evidence for
    source_url from the candidate's own page makes that from other pages void.
    """
    v = F.coalesce(F.nullif(F.col("normalized_value"), F.lit("")), F.nullif(F.col("extracted_value"), F.lit("")))
    rows = (
        evidence.filter(F.col("field_name").isin(SUPPORTED))
        .select("id", "candidate_id", "field_name", "source_page_id", v.alias("value"), F.lower(v).alias("folded"), rank("confidence").alias("rank"), F.struct("created_at", "id").alias("ord"))
        .filter("value is not null and candidate_id is not null")
    )
    if candidates is None:
        return rows
    own = candidates.select(F.col("id").alias("candidate_id"), F.col("source_page_id").alias("own_page")).filter("own_page is not null").distinct()
    urls = rows.filter("field_name = 'source_url'").join(own, "candidate_id", "left").withColumn("own", F.coalesce(F.col("source_page_id") == F.col("own_page"), F.lit(False)))
    has_own = urls.filter("own").select("candidate_id").distinct()
    kept = urls.filter("own").unionByName(urls.join(has_own, "candidate_id", "left_anti")).select(rows.columns)
    return rows.filter("field_name <> 'source_url'").unionByName(kept)


def resolve(ranked: DataFrame) -> DataFrame:
    """candidate_id, field_name, outcome, value, values, pages, confidence, first_evidence_id, second_evidence_id.

    outcome: ``agreed`` (one value), ``low_only`` (one value of low confidence: none chosen),
    ``outranked`` (the strongest agree against weaker ones), ``conflict`` (the strongest differ: none
    chosen, and the first two that differ are named).  Medium agreement of two pages counts as high.
    """
    best = ranked.groupBy("candidate_id", "field_name").agg(
        F.min("rank").alias("best"),
        F.count_distinct("folded").alias("values"),
        F.count_distinct("source_page_id").alias("pages"),
    )
    # one row a distinct value and rank before the join, so a hot candidate is no skewed key
    strongest = (
        ranked.groupBy("candidate_id", "field_name", "rank", "folded")
        .agg(F.min("ord").alias("ord"), F.min_by(F.struct("id", "value"), "ord").alias("e"))
        .join(best, ["candidate_id", "field_name"])
        .filter("rank = best")
    )
    # the first two of the strongest by a bounded rank, their number by a count: no list of all of them
    place = Window.partitionBy("candidate_id", "field_name").orderBy("ord")
    firsts = strongest.select("candidate_id", "field_name", "ord", "e").withColumn("_n", F.row_number().over(place)).filter("_n <= 2")
    firsts = firsts.groupBy("candidate_id", "field_name").agg(F.max(F.when(F.col("_n") == 1, F.col("e"))).alias("first"), F.max(F.when(F.col("_n") == 2, F.col("e"))).alias("next"))
    two = strongest.groupBy("candidate_id", "field_name", "best", "values", "pages").agg(F.count(F.lit(1)).alias("top_values")).join(firsts, ["candidate_id", "field_name"])
    outcome = (
        F.when((F.col("values") == 1) & (F.col("best") == 2), "low_only")
        .when(F.col("values") == 1, "agreed")
        .when(F.col("top_values") == 1, "outranked")
        .otherwise("conflict")
    )
    confidence = F.when((F.col("best") == 0) | ((F.col("best") == 1) & (F.col("pages") >= 2)), "high").when(F.col("best") == 1, "medium").otherwise("low")
    return two.select(
        "candidate_id", "field_name", outcome.alias("outcome"),
        F.when(outcome.isin("agreed", "outranked"), F.col("first.value")).alias("value"),
        "values", "pages", confidence.alias("confidence"),
        F.when(outcome == "conflict", F.col("first.id")).alias("first_evidence_id"),
        F.when(outcome == "conflict", F.col("next.id")).alias("second_evidence_id"),
    )


def agreement(evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """candidate_id, field_name, agreement of every field with evidence.

    ``conflict`` where a conflict row names the field, whatever its status; else ``agreement across
    sources`` where several pages give one value (letter case aside); else single source or
    complementary.  Evidence without candidate or field has no row; a null page is a page of its own.
    """
    v = F.coalesce(F.nullif(F.col("normalized_value"), F.lit("")), F.col("extracted_value"), F.lit(""))
    told = evidence.filter("candidate_id is not null and field_name is not null").select("candidate_id", "field_name", F.coalesce("source_page_id", F.lit("")).alias("page"), F.lower(v).alias("folded"))
    # least and greatest tell one from several, without sets
    several = lambda c: F.min(c) < F.max(c)
    fields = told.groupBy("candidate_id", "field_name").agg(several("page").alias("pages"), several("folded").alias("values"))
    named = conflicts.filter("candidate_id is not null and field_name is not null").select("candidate_id", "field_name").distinct().withColumn("_k", F.lit(True))
    label = F.when(F.col("_k"), "conflict").when(F.col("pages") & ~F.col("values"), "agreement across sources").otherwise("single source or complementary")
    return fields.join(named, ["candidate_id", "field_name"], "left").select("candidate_id", "field_name", label.alias("agreement"))


def missing_fields(present: DataFrame, candidates: DataFrame, wanted: list[str] = SUPPORTED) -> DataFrame:
    """candidate_id, missing (sorted array) of every candidate; ``present``: candidate_id, field_name."""
    have = present.filter(F.col("field_name").isin(wanted)).groupBy("candidate_id").agg(F.collect_set("field_name").alias("have"))
    all_ = F.array(*[F.lit(f) for f in sorted(wanted)])
    return candidates.select(F.col("id").alias("candidate_id")).distinct().join(have, "candidate_id", "left").select("candidate_id", F.array_sort(F.array_except(all_, F.coalesce("have", F.array().cast("array<string>")))).alias("missing"))
