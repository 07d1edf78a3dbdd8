"""Bounded breadth-first walks over links, and the joins discovery needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.urls import host_suffixes
from tessera.operators.skew import salted_join
from tessera.session import cut


def walk(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, node, depth, catalogue of all nodes reached within ``depth`` steps, each at its least depth.

    ``seeds``: root, node, catalogue (handed down to what is reached); ``edges``: src, dst.  Each round
    joins the frontier only; cycles end because reached nodes are taken out.
    """
    edges = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    found = cut(seeds.groupBy("root", "node").agg(F.bool_or("catalogue").alias("catalogue")).withColumn("depth", F.lit(0)))
    frontier = found
    for step in range(1, depth + 1):
        reached = salted_join(frontier.withColumnRenamed("node", "src"), edges, "src", F.xxhash64("root"))
        fresh = reached.groupBy("root", F.col("dst").alias("node")).agg(F.bool_or("catalogue").alias("catalogue")).join(found.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.select("root", "node", "depth", "catalogue")


def match_domains(rows: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Rows with the domain their host lies in; the suffix test as an equi-join."""
    wide = rows.withColumn(domain, F.explode(host_suffixes(host)))
    return salted_join(wide, domains.filter(F.col(domain).isNotNull()).dropDuplicates([domain]), domain, F.xxhash64(host))


def known_addresses(rows: DataFrame, key: str, known: DataFrame, known_keys: list[str]) -> DataFrame:
    """``rows`` with ``known``: whether the key is one of the known rows' addresses under any name."""
    every = known.select(F.explode(F.array_distinct(F.array(*[F.col(k) for k in known_keys]))).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_k", F.lit(True))
    return salted_join(rows, every, key, F.xxhash64(key), "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")
