"""Idempotent merges of a new extraction into what is kept: by keys and anti-joins, nothing in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.skew import heavy_keys, salted_join

EVIDENCE_KEY = ["candidate_id", "source_page_id", "field_name", "extracted_value", "evidence_locator"]
#: What one extraction replaces: the evidence of its version for a candidate from a page.
EVIDENCE_SCOPE = ["candidate_id", "source_page_id", "extraction_version"]


def merge_by_key(existing: DataFrame, incoming: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """The table after the merge, with ``change``: kept, inserted.

    Within the scopes (values of ``scope``) that ``incoming`` has, keys not in it go; keys in both keep
    the existing row, id included; new keys are added.  Other scopes stay as they are.  Nulls in
    a key are values.  Applied twice it changes nothing.
    """
    k = F.struct(*[F.col(c) for c in key])
    s = F.struct(*[F.col(c) for c in scope])
    old, new = existing.withColumn("_k", F.xxhash64(k)).withColumn("_t", F.to_json(k, {"ignoreNullFields": "false"})), incoming.withColumn("_k", F.xxhash64(k)).withColumn("_t", F.to_json(k, {"ignoreNullFields": "false"}))
    scopes = incoming.select(F.to_json(s, {"ignoreNullFields": "false"}).alias("_s")).distinct()
    old = old.withColumn("_s", F.to_json(s, {"ignoreNullFields": "false"}))
    heavy = heavy_keys(old, "_s")
    outside = salted_join(old, scopes, "_s", F.col("_k"), "left_anti", heavy=heavy).drop("_s")
    inside = salted_join(old, scopes, "_s", F.col("_k"), "left_semi", heavy=heavy).drop("_s").join(new.select("_k", "_t").distinct(), ["_k", "_t"], "left_semi")
    added = new.join(old.select("_k", "_t").distinct(), ["_k", "_t"], "left_anti")
    order = [c for c in ("created_at", "id") if c in incoming.columns] or key
    added = added.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_t").orderBy(*order))).filter("_n = 1").drop("_n")
    mark = lambda d, change: d.select(*existing.columns, F.lit(change).alias("change"))
    return mark(outside, "kept").unionByName(mark(inside, "kept")).unionByName(mark(added, "inserted"))


def removed_by_merge(existing: DataFrame, incoming: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """Existing rows that the merge leaves out."""
    in_scope = existing.join(incoming.select(*scope).distinct(), [existing[c].eqNullSafe(incoming[c]) for c in scope], "left_semi")
    return in_scope.join(incoming, [in_scope[c].eqNullSafe(incoming[c]) for c in key], "left_anti")


def without_evidence(conflicts: DataFrame, removed: DataFrame) -> DataFrame:
    """Conflicts neither of whose sides is among the removed evidence (``removed``: id)."""
    gone = removed.select("id").filter("id is not null").distinct()
    out = conflicts
    for side in ("first_evidence_id", "second_evidence_id"):
        out = salted_join(out, gone.withColumnRenamed("id", side), side, F.col("candidate_id"), "left_anti")
    return out.select(conflicts.columns)


def merge_conflicts(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """Conflicts after a new derivation: the same field and unordered pair keeps its resolution, others reopen or go.

    Both: candidate_id, field_name, first_evidence_id, second_evidence_id; existing also
    resolution_status and resolved_value.  Of several resolutions of one pair the last by text counts.
    """
    pair = F.array_sort(F.array("first_evidence_id", "second_evidence_id")).alias("pair")
    kept = existing.select("candidate_id", "field_name", pair, "resolution_status", "resolved_value").groupBy("candidate_id", "field_name", "pair").agg(F.max_by(F.struct("resolution_status", "resolved_value"), F.struct(F.col("resolution_status") != "unresolved", F.coalesce("resolution_status", F.lit("")), F.coalesce("resolved_value", F.lit("")))).alias("r"))
    now = derived.select("candidate_id", "field_name", pair).distinct()
    return now.join(kept, ["candidate_id", "field_name", "pair"], "left").select(
        "candidate_id", "field_name", F.col("pair")[0].alias("evidence_a"), F.col("pair")[1].alias("evidence_b"), F.coalesce("r.resolution_status", F.lit("unresolved")).alias("resolution_status"), F.col("r.resolved_value").alias("resolved_value")
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last writer by ``order`` wins for each key, over both tables: one partially aggregated group-by."""
    every = existing.unionByName(incoming)
    rest = [c for c in every.columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_r")).select(*key, "_r.*").select(*every.columns)
