"""Rows of a declared table contract: building, value maps, violations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass
class Entity:
    """A table of a contract: ordered columns and the rules that bind them."""

    name: str
    columns: list[str]
    required: list[str] = field(default_factory=list)
    conditional: dict[str, list[str]] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    status_column: str = "data_status"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])


def read_manifest(text: str) -> dict[str, Entity]:
    """Entities by name from a JSON manifest."""
    out = {}
    for e in json.loads(text)["entities"]:
        out[e["entity_type"]] = Entity(e["entity_type"], e["columns"], e.get("required_columns", []), e.get("conditional_required", {}), e.get("allowed_values", {}), e.get("date_columns", []), e.get("url_columns", []), e.get("value_mappings", {}))
    return out


def header_problems(found: list[str], wanted: list[str]) -> list[str]:
    """Missing, unknown and misplaced columns of a header."""
    out = [f"missing:{c}" for c in wanted if c not in found] + [f"unknown:{c}" for c in found if c not in wanted]
    return out or ([] if found == wanted else ["order"])


def map_values(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """``rows`` with ``column`` mapped and ``unmapped`` set where there is no target for its value."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    mapped = F.try_element_at(m, F.col(column))
    return rows.withColumn("unmapped", F.col(column).isNotNull() & mapped.isNull()).withColumn(column, mapped)


def violations(rows: DataFrame, entity: Entity, id_column: str) -> DataFrame:
    """id, rule, column of every rule a row breaks.

    Rules: required, conditional, allowed, date, url; and duplicate for rows equal in all
    columns of the contract.  One pass over the rows, and one aggregation for duplicates.
    """
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""
    made = lambda test, rule, c: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column")))
    tests = [made(blank(c), "required", c) for c in entity.required]
    tests += [made((F.col(entity.status_column) == status) & blank(c), "conditional", c) for status, cs in entity.conditional.items() for c in cs]
    tests += [made(~blank(c) & ~F.col(c).isin(values), "allowed", c) for c, values in entity.allowed.items()]
    tests += [made(~blank(c) & ~(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()), "date", c) for c in entity.dates]
    tests += [made(~blank(c) & ~F.col(c).rlike(r"(?i)^https?://[^/?#\s]+"), "url", c) for c in entity.urls]
    single = rows.select(F.col(id_column).alias("id"), F.explode(F.array_compact(F.array(*tests))).alias("v")).select("id", "v.rule", "v.column")
    same = rows.groupBy(*entity.columns).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("id")).filter("n > 1")
    return single.unionByName(same.select("id", F.lit("duplicate").alias("rule"), F.lit("*").alias("column"))).distinct()
