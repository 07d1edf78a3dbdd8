"""Whole stages as functions from tables to tables, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions.urls import EMIT_SCORE, canonical_url, host, is_trap, link_score, safe_canonical, within_domain
from tessera.operators import crawl, history, layers, merge, resolve
from tessera.operators.skew import salted_join
from tessera.session import cut as shortened, table
from tessera.sources import facts, sitemaps

TABLES = ["collection_jobs", "source_pages", "candidate_records", "evidence_records", "conflict_records", "batch_input_rows", "discovery_seeds", "documents", "cached_pages", "raw_input_records", "record_deletions", "mix_targets"]


def register(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> None:
    """The tables of a folder as temporary views, for ``spark.sql``."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# Sitemaps read of a domain, steps from a sitemap index to its sitemaps.
MOST_SITEMAPS, SITEMAP_DEPTH = 25, 2
# Pages crawled of a domain, links considered of a page or sitemap.
MOST_PAGES, MOST_LINKS = 20, 1000


def sitemap_links(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """root, depth, src, ord, dst of the addresses in the sitemaps of each domain, indexes expanded.

    ``files``: sitemap_url, content (binary); ``seeds``: official_domain and, if there, sitemap_url (one that
    robots.txt declares is a further row).  The conventional places are tried besides.
    """
    root = F.lower("official_domain")
    places = [F.concat(F.lit("https://"), root, F.lit("/sitemap.xml")), F.concat(F.lit("https://"), root, F.lit("/sitemap_index.xml"))]
    if "sitemap_url" in seeds.columns:
        places.append(F.col("sitemap_url"))
    starts = seeds.filter("official_domain is not null").select(root.alias("root"), F.explode(F.array(*places)).alias("at"))
    roots = starts.select("root", canonical_url("at").alias("node"), F.lit(False).alias("catalogue")).filter(F.col("node").isNotNull() & within_domain(host("node"), F.col("root")))
    found = sitemaps.sitemap_locations(files).select(canonical_url("sitemap_url").alias("src"), "ord", canonical_url("loc").alias("dst"), "is_index")
    found = shortened(found.filter((F.col("ord") < MOST_LINKS) & F.col("src").isNotNull() & F.col("dst").isNotNull()))
    reached = crawl.walk(roots, found.filter("is_index"), SITEMAP_DEPTH).filter(within_domain(host("node"), F.col("root")))
    first = reached.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))).filter(F.col("n") <= MOST_SITEMAPS)
    return first.select("root", "depth", F.col("node").alias("src")).join(found.filter("not is_index"), "src").select("root", "depth", "src", "ord", "dst")


def discover(links: DataFrame, seeds: DataFrame, known: DataFrame, depth: int, target: int, files: DataFrame | None = None) -> DataFrame:
    """Links found in the seeds' sitemaps, then from their catalogues, scored, with status, up to ``target`` new candidates.

    ``links``: page_url, ord, target, text; ``seeds``: official_domain, catalogue_url, sitemap_url (may be absent);
    ``known``: normalized_url; ``files``: the sitemaps, as ``sitemap_links`` takes them.  A domain without
    catalogue is walked from its root.  The first ``MOST_PAGES`` pages of a domain by depth and address are
    crawled, and the first ``MOST_LINKS`` links of a page considered.
    """
    domain = F.regexp_replace(F.lower(F.trim("official_domain")), r"\.+$", "")
    start = F.coalesce(canonical_url("catalogue_url"), canonical_url(F.concat(F.lit("https://"), domain, F.lit("/"))))
    roots = seeds.filter("official_domain is not null").select(domain.alias("root"), start.alias("node"), canonical_url("catalogue_url").isNotNull().alias("catalogue")).filter("root <> '' and node is not null")
    links = links.filter(F.col("ord") < MOST_LINKS)
    edges = links.select(canonical_url("page_url").alias("src"), canonical_url("target").alias("dst"), "text", "ord").filter("src is not null and dst is not null")
    inside = edges.filter(~is_trap("dst"))
    crawled = Window.partitionBy("root").orderBy("depth", "node")
    pages = crawl.walk(roots, inside, depth).filter(within_domain(host("node"), F.col("root"))).withColumn("_n", F.row_number().over(crawled)).filter(F.col("_n") <= MOST_PAGES).drop("_n")
    reached = salted_join(inside, pages.withColumnRenamed("node", "src"), "src", F.xxhash64("dst")).withColumn("source", F.lit(1))
    if files is not None:
        listed = sitemap_links(files, seeds).withColumns({"text": F.lit(""), "catalogue": F.lit(False), "source": F.lit(0)})
        reached = reached.unionByName(listed)
    within = reached.filter((host("dst") == F.col("root")) | host("dst").endswith(F.concat(F.lit("."), "root")))
    scored = within.withColumn("s", link_score("dst", "text", "catalogue")).filter(F.col("s.score") >= EMIT_SCORE)
    flagged = crawl.known_addresses(scored.withColumn("key", F.col("dst")), "key", known.select(canonical_url("normalized_url").alias("u")), ["u"])
    order = ["root", "source", "depth", "src", "ord", "dst"]
    status = history.emission_status(flagged, "key", F.col("known"), order)
    cut = history.cut_at_target(status, F.col("status") == "candidate", order, target)
    return cut.select("root", "depth", safe_canonical("dst").alias("discovered_url"), F.col("s.score").alias("score"), F.array_join("s.signals", ";").alias("signals"), "status")


def extract(pages: DataFrame, version: str = "1") -> DataFrame:
    """Evidence rows of HTML pages (page_url, html), with ids that depend on their content alone."""
    rows = facts.suggestions(facts.html_facts(pages))
    key = F.sha2(F.concat_ws("|", "page_url", "field_name", "locator", "extracted_value", F.lit(version)), 256)
    return rows.withColumn("id", key).withColumn("extraction_version", F.lit(version))


def current_values(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Effective value of each candidate and field: overrides, then resolved evidence."""
    resolved = resolve.resolve(resolve.ranked_evidence(evidence, candidates)).filter("value is not null").select("candidate_id", "field_name", "value", F.lit(layers.EXTRACTION).alias("layer"))
    return layers.effective_values(resolved, layers.json_layer(candidates, "reviewer_overrides", layers.OVERRIDE))


__all__ = ["register", "discover", "extract", "current_values", "merge"]
