"""References to records that do not exist, and what they take down with them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import cut, stored


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


#: Columns whose broken references are reported.
REPORTED = (
    ForeignKey("candidate_records", "source_page_id", "source_pages"),
    ForeignKey("evidence_records", "source_page_id", "source_pages"),
    ForeignKey("conflict_records", "first_evidence_id", "evidence_records"),
    ForeignKey("conflict_records", "second_evidence_id", "evidence_records"),
)
#: The whole graph, for the cascade.
GRAPH = (*REPORTED, ForeignKey("evidence_records", "candidate_id", "candidate_records"), ForeignKey("conflict_records", "candidate_id", "candidate_records"))


def clean_key(column: str | Column) -> Column:
    """Keys compare without letter case and outer white space; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(column), r"(?U)^\s+|\s+$", ""), F.lit(""))


def deleted_keys(log: DataFrame) -> DataFrame:
    """Keys with an entry in the log that was not restored."""
    return (
        log.filter("restored_at is null")
        .select(clean_key("record_table").alias("parent"), clean_key("record_id").alias("key"))
        .filter("parent is not null and key is not null")
        .distinct()
    )


def references(tables: dict[str, DataFrame], keys=REPORTED) -> DataFrame:
    """One row a non-blank reference: child table and column, referring id, its time, parent and key."""
    parts = [
        tables[k.child].select(
            F.lit(k.child).alias("record_table"),
            F.lit(k.column).alias("record_column"),
            F.col("id").alias("record_id"),
            F.col("created_at").alias("at"),
            F.lit(k.parent).alias("parent"),
            clean_key(k.column).alias("key"),
        )
        for k in keys
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("key is not null")


def parents(tables: dict[str, DataFrame], log: DataFrame, keys=REPORTED) -> DataFrame:
    """Per parent and key: the earliest time it stands in its table, and whether it is deleted."""
    names = list(dict.fromkeys(k.parent for k in keys))
    parts = [tables[n].select(F.lit(n).alias("parent"), clean_key("id").alias("key"), F.col("created_at").alias("stands"), F.lit(True).alias("there"), F.lit(False).alias("gone")) for n in names]
    parts.append(deleted_keys(log).select("parent", "key", F.lit(None).cast("timestamp_ntz").alias("stands"), F.lit(False).alias("there"), F.lit(True).alias("gone")))
    out = parts[0].withColumn("stands", F.col("stands").cast("timestamp_ntz"))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("stands", F.col("stands").cast("timestamp_ntz")))
    return out.filter("key is not null").groupBy("parent", "key").agg(F.min("stands").alias("stands"), F.bool_or("there").alias("there"), F.bool_or("gone").alias("gone"))


def _joined(tables: dict[str, DataFrame], log: DataFrame, keys) -> DataFrame:
    left = references(tables, keys).withColumn("link", F.concat_ws("|", "parent", "key")).withColumn("at", F.col("at").cast("timestamp_ntz"))
    right = parents(tables, log, keys).withColumn("link", F.concat_ws("|", "parent", "key")).drop("parent", "key")
    return salted_join(left, right, "link", F.col("record_id"), "left").drop("link")


CASCADED = ["record_table", "record_column", "record_id", "kind", "orphanhood", "depth", "report_month"]


def cascade(tables: dict[str, DataFrame], log: DataFrame, keys=GRAPH) -> DataFrame:
    """Broken references, and the rows that hang on a row with one at any depth; columns ``CASCADED``.

    ``direct`` rows, one a reference (depth 0): its kind is ``deleted`` before ``missing`` before
    ``late``.  ``inherited`` rows, one a record (record_id cleaned, record_column and kind null):
    the record's own references stand, but one leads to a record with a deleted or missing
    reference, or to such a record; a late reference takes nothing down.  Each round joins the
    frontier alone, down the key graph, and the walk ends when a round finds nothing new, so
    chains of any length are followed and cycles end.  Null times make no reference late and
    give a null month; repeated rows count once; a null referring id is kept as null.
    """
    kind = (
        F.when(F.col("gone"), "deleted")
        .when(F.col("there").isNull() | ~F.col("there"), "missing")
        .when(F.col("stands") > F.col("at"), "late")
    )
    nodes = {k.child for k in keys}
    edges = stored(
        _joined(tables, log, keys)
        .withColumn("kind", kind)
        # a sound reference to a table without references of its own hands nothing down
        .filter(F.col("kind").isNotNull() | F.col("parent").isin(sorted(nodes)))
        .select("record_table", "record_column", "record_id", "parent", "key", "kind", F.date_format("at", "yyyy-MM").alias("report_month"))
    )
    direct = edges.filter("kind is not null").select("record_table", "record_column", "record_id", "kind", F.lit("direct").alias("orphanhood"), F.lit(0).alias("depth"), "report_month").distinct()
    link = lambda table, key: F.concat_ws("|", table, key)
    sound = edges.filter(F.col("parent").isin(sorted(nodes)) & F.coalesce(F.col("kind") == "late", F.lit(True))).select("record_table", clean_key("record_id").alias("node"), link("parent", "key").alias("link"), "report_month").filter("node is not null")
    found = cut(edges.filter("kind in ('deleted', 'missing')").select(link("record_table", clean_key("record_id")).alias("link")).filter(F.col("link").contains("|")).distinct())
    heavy, frontier, depth, rounds = None, found, 0, []
    while True:
        depth += 1
        heavy = heavy_keys(sound, "link") if heavy is None else heavy
        hit = salted_join(sound, frontier, "link", F.col("node"), "left_semi", heavy=heavy)
        hit = hit.groupBy("record_table", "node").agg(F.min("report_month").alias("report_month")).withColumn("link", link("record_table", "node"))
        fresh = cut(hit.join(found, "link", "left_anti"))
        if fresh.isEmpty():
            break
        rounds.append(fresh.select("record_table", F.lit(None).cast("string").alias("record_column"), F.col("node").alias("record_id"), F.lit(None).cast("string").alias("kind"), F.lit("inherited").alias("orphanhood"), F.lit(depth).alias("depth"), "report_month"))
        frontier = fresh.select("link")
        found = found.unionByName(frontier)
        if depth % 8 == 0:  # a long chain keeps a short plan
            found, rounds = cut(found), [cut(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds, direct).select(*CASCADED)


def broken_references(cascaded: DataFrame, keys=REPORTED) -> DataFrame:
    """record_table, record_column, record_id, kind, report_month: the direct layer of a cascade, in the columns of ``keys``."""
    wanted = [f"{k.child}.{k.column}" for k in keys]
    direct = cascaded.filter(F.col("orphanhood") == "direct").filter(F.concat_ws(".", "record_table", "record_column").isin(wanted))
    return direct.select("record_table", "record_column", "record_id", "kind", "report_month")


def orphan_counts(cascaded: DataFrame) -> DataFrame:
    """record_table, report_month, orphanhood, depth, rows: records with a deleted or missing reference, and those below them."""
    records = (
        cascaded.filter("orphanhood = 'inherited' or kind in ('deleted', 'missing')")
        .withColumn("record_id", clean_key("record_id"))
        .filter("record_id is not null")
        .groupBy("record_table", "record_id", "orphanhood", "depth")
        .agg(F.min("report_month").alias("report_month"))
    )
    return records.groupBy("record_table", "report_month", "orphanhood", "depth").agg(F.count(F.lit(1)).alias("rows"))
