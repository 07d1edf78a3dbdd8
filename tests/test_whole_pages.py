"""Passes and fallbacks over pages that the kept texts do not reach: cards, labels above their value, institutions, sitemaps."""

from tessera.plans import stages
from tessera.sources import facts

CARDS = """<html><head><title>Rail Systems | Research | Universität Bergtal</title><meta name="publisher" content="University Press"></head><body>
<div class="info-card"><strong>Campus:</strong><span>Bergtal</span></div><div class="flex__item"><h3>Degree</h3><p>M.Sc.</p></div>
<div class="plain"><h3>Intake</h3><p>summer</p></div>
<p><strong>Duration:</strong></p><p>four semesters</p><p><strong>Study mode:</strong> Part-time</p><p>something else</p></body></html>"""
AUTHOR = """<head><title>A | University of B</title><meta property="og:title" content="Optics | B"><meta name="author" content="UNIVERSITY of C"></head><div>Degree: PhD<br>City: D</div>"""
PUBLISHER = """<head><meta name="author" content="A. Person"><meta name="publisher" content="Universitaet E"></head><h1>Master Law</h1>"""

BESIDE = """<body><h1> </h1><div><p>Faculty of Water</p><h1>Water</h1><p>Bachelor of Science</p></div><h1>Master Other</h1><dl><dt>Apply<dd><a href="/apply">how to apply</a><dt>Degree<dd>certificate<dt>Language<dd>Latin<dt>Duration<dd>long</dl>"""


def test_cards_siblings_and_institutions(spark):
    pages = spark.createDataFrame([("https://u.example/c?x=1", CARDS), ("a", AUTHOR), ("p", PUBLISHER), ("https://u.example/d/", BESIDE)], "page_url string, html string")
    got = {(r.page_url[18:19] if r.page_url.startswith("http") else r.page_url, r.field_name, r.normalized_value, r.locator, r.confidence) for r in facts.suggestions(facts.html_facts(pages)).collect()}
    assert got == {
        ("c", "program_name", "Rail Systems", "title", "medium"), ("c", "university_name", "Universität Bergtal", "title:institution-segment", "medium"),
        ("c", "city", "Bergtal", "labelled-card", "high"), ("c", "degree_level", "master", "labelled-card", "high"), ("c", "duration_value", "4", "labelled-paragraph", "high"), ("c", "duration_unit", "semesters", "labelled-paragraph", "high"), ("c", "duration_semesters", "4", "labelled-paragraph", "high"), ("c", "source_url", "https://u.example/c", "source-page-record", "high"), ("c", "study_mode", "part_time", "inline-strong", "high"),
        ("a", "program_name", "Optics", "meta:og:title", "medium"), ("a", "university_name", "UNIVERSITY of C", "meta:author", "medium"), ("a", "degree_level", "phd", "labelled-lines", "high"), ("a", "city", "D", "labelled-lines", "high"),
        ("p", "university_name", "Universitaet E", "meta:publisher", "medium"), ("p", "program_name", "Law", "h1", "high"), ("p", "degree_level", "master", "h1[1]:controlled-degree-token", "medium"), ("a", "source_url", "a", "source-page-record", "high"), ("p", "source_url", "p", "source-page-record", "high"),
        ("d", "program_name", "Water", "h1", "high"), ("d", "degree_level", "bachelor", "h1[1]:adjacent-degree-context", "medium"), ("d", "application_url", "https://u.example/apply", "definition-list", "high"), ("d", "source_url", "https://u.example/d/", "source-page-record", "high"),
    }


def test_discover_expands_sitemap_indexes(spark):
    index = lambda *at: ("<sitemapindex>" + "".join(f"<sitemap><loc>{a}</loc></sitemap>" for a in at) + "</sitemapindex>").encode()
    pages = lambda *at: ("<urlset>" + "".join(f"<url><loc>{a}</loc></url>" for a in at) + "</urlset>").encode()
    u = "https://u.example"
    files = [
        (f"{u}/maps.xml", index(f"{u}/m1.xml", f"{u}/maps.xml", "https://other.example/m.xml")), (f"{u}/m1.xml", index(f"{u}/m2.xml")), (f"{u}/m2.xml", pages(f"{u}/programmes/deep", f"{u}/plain", "https://other.example/programmes/x")),
        (f"{u}/sitemap.xml", pages(f"{u}/programmes/a", f"{u}/programmes/known")), ("https://other.example/m.xml", pages(f"{u}/programmes/foreign")), (f"{u}/stray.xml", pages(f"{u}/programmes/stray")),
    ]
    links = spark.createDataFrame([(f"{u}/cat", 0, f"{u}/programmes/a", "A"), (f"{u}/cat", 1, f"{u}/programmes/b", "B")], "page_url string, ord int, target string, text string")
    seeds = spark.createDataFrame([("U.example", f"{u}/cat", f"{u}/maps.xml")], "official_domain string, catalogue_url string, sitemap_url string")
    known = spark.createDataFrame([(f"{u}/programmes/known",)], "normalized_url string")
    got = sorted((r.discovered_url, r.status) for r in stages.discover(links, seeds, known, 2, 10, spark.createDataFrame(files, "sitemap_url string, content binary")).collect())
    assert got == [(f"{u}/programmes/a", "candidate"), (f"{u}/programmes/a", "duplicate"), (f"{u}/programmes/b", "candidate"), (f"{u}/programmes/deep", "candidate"), (f"{u}/programmes/known", "already_existing")]
    assert len(stages.discover(links, seeds, known, 2, 10).collect()) == 2


def test_discovery_is_bounded_by_pages_and_links(spark, monkeypatch):
    monkeypatch.setattr(stages, "MOST_PAGES", 3)
    monkeypatch.setattr(stages, "MOST_LINKS", 5)
    u = "https://u.example"
    links = [(f"{u}/", i, f"{u}/study/{i}", "") for i in range(9)] + [(f"{u}/study/{i}", 0, f"{u}/study/{i}/master", "") for i in range(9)]
    seeds = spark.createDataFrame([("U.example.", None)], "official_domain string, catalogue_url string")
    known = spark.createDataFrame([], "normalized_url string")
    got = {r.discovered_url for r in stages.discover(spark.createDataFrame(links, "page_url string, ord int, target string, text string"), seeds, known, 2, 100).collect()}
    assert got == {f"{u}/study/{i}" for i in range(5)} | {f"{u}/study/{i}/master" for i in range(2)}
