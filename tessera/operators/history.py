"""Current state from append-only logs, first occurrences, and cut-offs over an ordered stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.skew import salted_join
from tessera.session import stored


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` must end in a unique column."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*log.columns)


def first_occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def fold_overrides(log: DataFrame, order: list[str]) -> DataFrame:
    """candidate_id, field_name, value: the last value of each field over all events that set it.

    ``log``: candidate_id, overrides (map) and the order columns.
    """
    rows = log.select("candidate_id", *order, F.explode("overrides").alias("field_name", "value"))
    return rows.groupBy("candidate_id", "field_name").agg(F.max_by("value", F.struct(*order)).alias("value"))


def emission_status(rows: DataFrame, key: str, known: Column, order: list[str]) -> DataFrame:
    """``rows`` with status: already_existing, candidate (first of its key) or duplicate."""
    firsts = first_occurrences(rows.filter(~known & F.col(key).isNotNull()).select(key, *order), [key], order).select(key, F.struct(*order).alias("_first"))
    out = salted_join(rows, firsts, key, F.xxhash64(*order), "left")
    return out.withColumn("status", F.when(known, "already_existing").when(F.struct(*order) == F.col("_first"), "candidate").otherwise("duplicate")).drop("_first")


def cut_at_target(rows: DataFrame, is_hit: Column, order: list[str], target: int, partitions: int | None = None) -> DataFrame:
    """Rows up to and including the ``target``-th hit in the given order.

    Two passes without a global sort in one task: rows are range-partitioned and written with the
    number of their range, hits are counted by range, and only ranges before or at the cut keep
    rows.  The range bounds come from a sample, so the ranges are stored before they are counted.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = stored(rows.withColumn("_hit", F.coalesce(is_hit, F.lit(False)).cast("int")).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    per = {r["_p"]: r["h"] for r in parted.groupBy("_p").agg(F.sum("_hit").alias("h")).collect()}  # one number a partition
    before, total = {}, 0
    for p in sorted(per):
        before[p] = total
        total += per[p]
    offsets = spark.createDataFrame([(p, b) for p, b in before.items() if b < target] or [(-1, 0)], "_p int, _b long")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = parted.join(F.broadcast(offsets), "_p").withColumn("_seen", F.sum("_hit").over(w) - F.col("_hit") + F.col("_b"))
    return seen.filter(F.col("_seen") < target).select(rows.columns)
