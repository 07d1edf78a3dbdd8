"""Counters, duplicate groups, histograms and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import fold_key


def counters(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def duplicate_groups(rows: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """group_key, members, smallest_id of rows equal in all keys after folding; a row with an empty key is in no group."""
    folded = [fold_key(k) for k in keys]
    keyed = rows.select(id_column, F.array(*folded).alias("keys")).filter(~F.exists("keys", lambda k: k == "")).distinct()
    return keyed.groupBy("keys").agg(F.count(F.lit(1)).alias("members"), F.min(id_column).alias("smallest_id")).filter("members > 1").select(F.array_join("keys", " | ").alias("group_key"), "members", "smallest_id")


def histogram(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """level, n of every level, zero included."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(x,) for x in levels], f"{column} string")
    return all_.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rates(rows: DataFrame, flags: dict[str, Column], averages: dict[str, Column]) -> DataFrame:
    """One row of shares of true flags and of averages; nulls count as false, an empty table gives nulls."""
    share = lambda c: F.round(F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)), 6)
    return rows.agg(*[share(c).alias(n) for n, c in flags.items()], *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in averages.items()])


def failures_by_category(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
