"""A log of fetch attempts as a source: retries, redirects, outcome and cache.

Fetching itself needs a network; here the attempts are rows (url, attempt, status,
http_status, content_type, body, retry_after) and everything after them is a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
RETRIED = [408, 429, 500, 502, 503, 504]
CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain", "application/xml", "text/xml"]
MOST_ATTEMPTS, MOST_BYTES, MOST_WAIT = 3, 5 * 1024 * 1024, 30


def is_transient(http_status: Column, error: Column) -> Column:
    return F.coalesce(http_status.isin(RETRIED), F.lit(False)) | F.coalesce(error.isin("timeout", "network"), F.lit(False))


def bounded_wait(retry_after: Column) -> Column:
    """Seconds to wait by a numeric Retry-After, 0 to 30; null for anything else."""
    seconds = F.trim(retry_after).try_cast("double")
    return F.when(seconds.isNotNull(), F.least(F.lit(float(MOST_WAIT)), F.greatest(F.lit(0.0), seconds)))


def outcome(http_status: Column, content_type: Column, size: Column, error: Column) -> Column:
    """fetched, or the first thing that is wrong."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(error.isNotNull(), error)
        .when(http_status.isin(401, 403), "access_blocked")
        .when(http_status == 429, "rate_limited")
        .when(http_status.isNull() | ~http_status.between(200, 299), "http_error")
        .when(~kind.isin(CONTENT_TYPES), "unsupported_content_type")
        .when(size > MOST_BYTES, "response_too_large")
        .otherwise("fetched")
    )


def final_attempts(log: DataFrame) -> DataFrame:
    """The attempt that counts for each url: the first that is not transient, else the last of those allowed."""
    tried = log.filter(F.col("attempt") <= MOST_ATTEMPTS).withColumn("transient", is_transient(F.col("http_status"), F.col("error")))
    rest = [c for c in tried.columns if c != "url"]
    order = F.struct(F.col("transient").cast("int"), F.when(F.col("transient"), -F.col("attempt")).otherwise(F.col("attempt")))
    return tried.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("r"), F.count(F.lit(1)).alias("attempts")).select("url", "r.*", "attempts")


def robots_status(http_status: Column) -> Column:
    """What a robots.txt answer means before its rules are read."""
    return (
        F.when(http_status.isin(401, 403), "disallowed")
        .when(http_status.between(200, 299), "read")
        .when(http_status.between(400, 499) & (http_status != 429), "allowed")
        .otherwise("unavailable")
    )


def kept_hashes(kept: DataFrame) -> DataFrame:
    """cached_file_path, kept_hashes: the hashes of the copies themselves (``content``, text or binary); a null copy is none."""
    return kept.filter("content is not null").groupBy("cached_file_path").agg(F.collect_set(F.sha2("content", 256)).alias("kept_hashes"))


def cache_hits(pages: DataFrame, kept: DataFrame, now: Column) -> DataFrame:
    """Pages whose kept copy may be used: fetched, not expired, copy there, its hash the page's.

    ``pages``: id, fetch_status, cache_expires_at, cached_file_path, content_hash; ``kept``: cached_file_path, content.
    """
    usable = pages.filter(F.col("fetch_status").isin("fetched", "cache_hit") & (F.col("cache_expires_at") > now))
    return usable.join(kept_hashes(kept), "cached_file_path").filter(F.array_contains("kept_hashes", F.col("content_hash"))).drop("kept_hashes")


def source_integrity(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """id, state of every page: missing_cache_metadata, cache_missing, cache_hash_mismatch or ok.

    ``pages``: id, cached_file_path, content_hash; ``kept``: cached_file_path, content.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    state = (
        F.when(blank("cached_file_path") | blank("content_hash"), "missing_cache_metadata")
        .when(F.col("kept_hashes").isNull(), "cache_missing")
        .when(~F.array_contains("kept_hashes", F.col("content_hash")), "cache_hash_mismatch")
        .otherwise("ok")
    )
    return pages.select("id", "cached_file_path", "content_hash").distinct().join(kept_hashes(kept), "cached_file_path", "left").select("id", state.alias("state"))


def candidate_integrity(links: DataFrame, states: DataFrame) -> DataFrame:
    """candidate_id, state: the first of its sources that is not ok, missing_source_relationship without sources.

    ``links``: candidate_id, source_page_id, created_at (a null or unknown page is no source); ``states``: id, state.
    """
    found = links.join(states.select(F.col("id").alias("source_page_id"), "state"), "source_page_id", "left")
    bad = F.min_by(F.when(F.col("state") != "ok", F.col("state")), F.when(F.col("state") != "ok", F.struct("created_at", "source_page_id")))
    state = F.when(F.count("state") == 0, "missing_source_relationship").otherwise(F.coalesce(bad, F.lit("ok")))
    return found.groupBy("candidate_id").agg(state.alias("state"))
