import gzip
import os
from datetime import datetime as dt, timedelta

from pyspark.sql import functions as F

from tessera.plans import stages
from tessera.sources import facts, fetchlog, sinks, sitemaps
from tessera.streaming import ingest

PAGE = """<html><head><title>Rail | Uni</title><link rel=canonical href="/rail?x=1"><meta property="og:site_name" content="University of Bergtal">
<script type="application/ld+json">{"@graph": [{"@type": "Course", "name": "Rail Systems", "provider": {"name": "Uni Bergtal"}, "timeToComplete": "P2Y"}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><dl><dt>City<dd>Nowhere</dl></nav><h1>Master Rail Systems</h1>
<dl><dt>Degree</dt><dd>M.Sc.</dd><dt>Language of instruction<dd>English and German</dl><table><tr><th>Country<td>Germany<tr><td>Application<td><a href="https://a.example/apply">apply here</a></table>
<div>Study mode: Part-time<br>Intake: winter</div><p><strong>Campus:</strong> Bergtal</p><a href="x?q=1">More</a><a href="mailto:a@b">m</a></body></html>"""


def test_facts(spark):
    pages = spark.createDataFrame([("https://u.example/p/rail", PAGE), ("https://u.example/n", "<h1>News</h1><p>x"), ("https://u.example/e", None)], "page_url string, html string")
    found = facts.html_facts(pages)
    assert found.filter("kind = 'warning'").count() == 1
    got = {(r.field_name, r.normalized_value) for r in facts.suggestions(found).collect()}
    assert {("program_name", "Rail Systems"), ("university_name", "Uni Bergtal"), ("university_name", "University of Bergtal"), ("duration_value", "2"), ("duration_unit", "years"), ("duration_semesters", "4"), ("degree_level", "master"), ("teaching_language", "English and German"), ("country_code", "DE"), ("application_url", "https://a.example/apply"), ("study_mode", "part_time"), ("intake", "winter"), ("city", "Bergtal"), ("source_url", "https://u.example/rail")} == got
    assert {(r.target, r.text) for r in facts.html_links(pages).collect()} == {("https://a.example/apply", "apply here"), ("https://u.example/p/x?q=1", "More")}
    assert stages.extract(pages).select("id").distinct().count() == stages.extract(pages).count()


def test_attempts(spark):
    log = spark.createDataFrame([("u", 1, 503, None), ("u", 2, 200, None), ("u", 3, 500, None), ("v", 1, 503, None), ("v", 2, None, "timeout"), ("w", 1, 404, None)], "url string, attempt int, http_status int, error string")
    assert {(r.url, r.attempt, r.attempts) for r in fetchlog.final_attempts(log).collect()} == {("u", 2, 3), ("v", 2, 2), ("w", 1, 1)}
    rows = spark.createDataFrame([(200, "text/html; charset=x", 5, None), (200, "image/png", 5, None), (403, None, 0, None), (429, None, 0, None), (None, None, 0, None), (200, "text/html", 6_000_000, None), (None, None, 0, "timeout")], "h int, c string, s long, e string")
    assert [r[0] for r in rows.coalesce(1).select(fetchlog.outcome(F.col("h"), F.col("c"), F.col("s"), F.col("e"))).collect()] == ["fetched", "unsupported_content_type", "access_blocked", "rate_limited", "http_error", "response_too_large", "timeout"]
    waits = spark.createDataFrame([("5",), ("99",), ("-1",), ("soon",), (None,)], "r string").coalesce(1)
    assert [r[0] for r in waits.select(fetchlog.bounded_wait(F.col("r"))).collect()] == [5.0, 30.0, 0.0, None, None]


def test_sitemaps(spark):
    xml = b'<?xml version="1.0"?><urlset xmlns="http://s"><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>'
    files = [("p", xml), ("g", gzip.compress(xml)), ("i", b"<sitemapindex><sitemap><loc>https://a/s</loc></sitemap></sitemapindex>"), ("bad", b"<urlset><loc>"), ("other", b"<x/>"), ("none", None), ("cut", gzip.compress(xml)[:20])]
    got = {(r.sitemap_url, r.loc, r.is_index) for r in sitemaps.sitemap_locations(spark.createDataFrame(files, "sitemap_url string, content binary")).collect()}
    assert got == {("p", "https://a/1", False), ("p", "https://a/2", False), ("g", "https://a/1", False), ("g", "https://a/2", False), ("i", "https://a/s", True), *((n, None, False) for n in ("bad", "other", "none", "cut"))}
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /x\nSitemap: https://a/s.xml\r\nsitemap:https://a/t", "https://a/x/1"), ("", "https://a/x"), ("#" * 600_000, "https://a/x")], "b string, u string").coalesce(1)
    assert [r[0] for r in robots.select(sitemaps.robots_allowed("b", "u", "bot")).collect()] == ["disallowed", "allowed", "invalid"]
    assert robots.select(sitemaps.robots_sitemaps("b")).first()[0] == ["https://a/s.xml", "https://a/t"]


def test_package(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 'a "b", c'), ("ü", None), ("x", "two\nlines")], "a string, b string")
    made = sinks.write_package({"t": (rows, ["a", "b"])}, f"{tmp_path}/p")
    assert made["files"]["t"]["record_count"] == 3
    body = b"".join(open(f"{tmp_path}/p/t/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/p/t") if f.endswith(".csv"))
    assert b"'=1" in body and b'"a ""b"", c"\r\n' in body and b"a,b\r\n" in body
    assert os.path.exists(f"{tmp_path}/p/manifest.json")
    same = sinks.file_digest(sinks.csv_lines(rows.repartition(7), ["a", "b"]), "a,b").first()
    assert same.digest == made["files"]["t"]["digest"]
    html = sinks.html_report(rows.withColumn("k", F.lit(1)), "k", ["a", "b"]).first().html
    assert html.startswith("<table><tr><th>a</th>") and "&quot;b&quot;" in html


def test_discover(spark):
    links = spark.createDataFrame([("https://u.example/cat", 0, "https://u.example/programmes/a", "A"), ("https://u.example/cat", 1, "https://u.example/news", "N"), ("https://u.example/cat", 2, "https://other.example/programmes/b", "B"), ("https://u.example/programmes/a", 0, "https://s.u.example/study/c", "C"), ("https://u.example/cat", 3, "https://u.example/programmes/a#x", "A")], "page_url string, ord int, target string, text string")
    seeds = spark.createDataFrame([("u.example", "https://u.example/cat/")], "official_domain string, catalogue_url string")
    known = spark.createDataFrame([("https://s.u.example/study/c",)], "normalized_url string")
    got = sorted((r.discovered_url, r.status) for r in stages.discover(links, seeds, known, 2, 10).collect())
    assert got == [("https://s.u.example/study/c", "already_existing"), ("https://u.example/programmes/a", "candidate"), ("https://u.example/programmes/a", "duplicate")]


def test_stream(spark, tmp_path):
    day = dt(2025, 1, 1)
    rows = [(f"https://a.example/{i % 4}?utm_source={i}", day + timedelta(minutes=i), 200 if i % 3 else 503, "text/html", 10, None) for i in range(40)]
    schema = "url string, fetched_at timestamp, http_status int, content_type string, bytes long, error string"
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df in (("seen", ingest.first_sightings(stream)), ("hosts", ingest.host_windows(stream))):
        q = df.writeStream.foreachBatch(ingest.append_to(f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/c-{name}").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 4
    hosts = spark.read.parquet(f"{tmp_path}/hosts").collect() if os.listdir(f"{tmp_path}/hosts") else []
    assert all(r.attempts == 10 for r in hosts)
