"""The same operators over a stream of fetch attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.urls import canonical_url
from tessera.sources.fetchlog import is_transient, outcome


def first_sightings(log: DataFrame, time: str = "fetched_at", late: str = "2 hours") -> DataFrame:
    """Attempts of addresses not seen within the watermark; state is bounded by it."""
    keyed = log.withColumn("page_key", canonical_url("url")).filter("page_key is not null")
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["page_key"])


def host_windows(log: DataFrame, time: str = "fetched_at", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Attempts, transient failures and bytes of each host and window; late rows within the watermark count."""
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1)
    rows = log.select(host.alias("host"), F.col(time).alias("at"), is_transient(F.col("http_status"), F.col("error")).cast("int").alias("transient"), outcome(F.col("http_status"), F.col("content_type"), F.col("bytes"), F.col("error")).alias("outcome"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return (
        rows.withWatermark("at", late)
        .groupBy(F.window("at", width), "host")
        .agg(F.count(F.lit(1)).alias("attempts"), F.sum("transient").alias("transient"), F.sum(F.when(F.col("outcome") == "fetched", 1).otherwise(0)).alias("fetched"), F.sum("bytes").alias("bytes"))
        .select(F.col("window.start").alias("start"), "host", "attempts", "transient", "fetched", "bytes")
    )


def append_to(folder: str):
    """A foreachBatch sink that writes each batch once: a repeated batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
