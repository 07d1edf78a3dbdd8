"""Values in layers: extraction, then context for absent keys, then overrides, which win even when blank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXTRACTION, CONTEXT, OVERRIDE = 0, 1, 2


def json_layer(rows: DataFrame, column: str, layer: int) -> DataFrame:
    """candidate_id, field_name, value, layer of a JSON object column; broken JSON and null give nothing.

    An absent key has no row; a key with null has a row with a null value.
    """
    entries = F.explode(F.map_entries(F.from_json(F.when(F.expr(f"try_parse_json({column}) is not null"), F.col(column)), "map<string,string>")))
    return rows.select(F.col("id").alias("candidate_id"), entries.alias("e")).distinct().select("candidate_id", F.col("e.key").alias("field_name"), F.col("e.value").alias("value"), F.lit(layer).alias("layer"))


def effective_values(*layers: DataFrame) -> DataFrame:
    """candidate_id, field_name, value, layer name of the layer that counts.

    An override replaces whatever there is, also by ''; extraction goes before context.
    """
    rows = layers[0]
    for x in layers[1:]:
        rows = rows.unionByName(x)
    order = F.when(F.col("layer") == OVERRIDE, 0).when(F.col("layer") == EXTRACTION, 1).otherwise(2)
    best = rows.groupBy("candidate_id", "field_name").agg(F.min_by(F.struct("value", "layer"), F.struct(order, F.coalesce("value", F.lit("")))).alias("b"))
    name = F.when(F.col("b.layer") == OVERRIDE, "override").when(F.col("b.layer") == EXTRACTION, "extraction").otherwise("context")
    return best.select("candidate_id", "field_name", F.col("b.value").alias("value"), name.alias("layer"))


def provenance_counts(effective: DataFrame) -> DataFrame:
    """layer, fields: non-blank effective values by the layer they come from."""
    return effective.filter(F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0).groupBy("layer").agg(F.count(F.lit(1)).alias("fields"))


def context_contradictions(context: DataFrame, evidence: DataFrame) -> DataFrame:
    """candidate_id, field_name, value, contradicting (sorted distinct), effective.

    ``context``: candidate_id, field_name, value.  Evidence contradicts where its normalised value
    is present and differs, letter case included.
    """
    against = evidence.select("candidate_id", "field_name", F.col("normalized_value").alias("found")).filter("found is not null").distinct()
    hit = context.join(against, ["candidate_id", "field_name"]).filter("found <> value").groupBy("candidate_id", "field_name").agg(F.array_sort(F.collect_set("found")).alias("contradicting"))
    out = context.join(hit, ["candidate_id", "field_name"], "left")
    return out.select("candidate_id", "field_name", "value", F.coalesce("contradicting", F.array().cast("array<string>")).alias("contradicting"), F.col("contradicting").isNull().alias("effective"))
