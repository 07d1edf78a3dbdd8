import random
from datetime import datetime as dt

import pytest

from tessera.llm import mainbody as m
from tessera.llm.rendering import render

PAGE = """Research · Study · Login · Library
Study > Programmes > Rail Systems
Related programmes
Urban Planning
Rail Systems
The programme teaches how railways are planned and run, and it ends with a thesis.

Country: DE
Degree – M.Sc.
Key dates
2 August – winter
Share this page
12 May: library extends opening hours
Modules
- Signals
Track Design
* Thesis

Do I need a laptop?
No.
Quick links
Marketing
Alumni
© 2024 Some University. All rights reserved.
Imprint | Privacy | Accessibility"""
SITE = frozenset(i for i, x in enumerate(PAGE.split("\n")) if x.startswith(("©", "Quick", "Alumni", "Share", "Imprint", "Related")))
MAIN = {5, 6, 8, 9, 10, 11, 14, 15, 16, 17, 19, 20}


def test_sections():
    lines = PAGE.split("\n")
    assert {i for i, x in enumerate(m.is_main(lines, SITE), 1) if x and lines[i - 1].strip()} == MAIN


@pytest.mark.parametrize("text", ["", "\n\n", "x", "Research\nLogin", "a" * 100_000, "Home\n" * 5000])
def test_odd_pages(text):
    assert len(m.is_main(text.split("\n"))) == text.count("\n") + 1


def test_often_lines_are_of_the_site():
    lines = ["Rail Systems", "The programme teaches how railways are planned and run, and it ends with a thesis.", "Modules", "- Signals", "Unser Mensaplan", "- Track"]
    assert m.is_main(lines)[5] and not m.is_main(lines, frozenset([4]))[4] and m.is_main(lines, frozenset([2]))[:4] == [True] * 4


@pytest.mark.parametrize(
    "snippet,want",
    [
        ("Country: DE", False), ("Imprint | Privacy | Accessibility", True), ("Country: DE  Share this page", True), ("Research", False), ("Study", False), ("Rail Systems", False),
        ("Study mode: full_time", False), ("Quick links", True), ("Study > Programmes > Rail", True), ("Some University", False), ("", False), ("nothing of the page", False), ("Library extends", False), ("Alumni", True), ("Alumni Country: DE", True), ("Degree – M.Sc. Alumni", True), ("Alumni University: Some", True), ("Programme: Art Marketing", False), ("Country: DE Marketing", True), ("Marketing of trains", False),
    ],
)
def test_quotations(snippet, want):
    lines = PAGE.split("\n")
    assert m.Shown(lines, m.is_main(lines, SITE), [i in SITE for i in range(len(lines))]).quoted_in(snippet) is want


def test_rendering():
    html = """<html><head><title>T</title><script>if (a<b) x()</script></head><body><!-- c --><p>One<p>Two <b>bold</b> &amp; more<ul><li>a<li>b<ul><li>c</ul></ul>
    <div style="display: none">gone</div><ol><li>x</li><li>y</ol><table><tr><td>Fee<td>Day<tr><td>500<td>3</table><dl><dt>K<dd>V</dl><span hidden>no</span>end<br>line</body>"""
    assert [x for x in render(html).split("\n") if x] == ["One", "Two bold & more", "- a", "- b", "  - c", "1. x", "2. y", "Fee  Day", "500  3", "K", "V", "end", "line"]
    assert render("<div>" * 20_000 + "deep") == "deep"
    assert render("") == "" and render("</p></p>a<") == "a<"


# A site that nothing here was made for: its own phrases, in two languages the lists do not know.
NOTICES = ["We value your choices; pick what we may keep on this machine and read how long it stays there, which parties may read it and how you can withdraw all of it later, in the centre for such questions that you find under the link at the very end of every single one of our pages, on all days, at any hour you like to.", "Valitse, mitä saamme tallentaa tälle laitteelle, ja lue lisää ehdoista."]
MENU = ["Campus shuttle times", "Etusivu", "Ruokalista", "Our harbour", "Ota yhteyttä", "Kirjaudu sisään"]
FOOTERS = ["Our town has many parks and a harbour, and the sauna is open to all of our guests.", "Tämä sivu on päivitetty viimeksi 3.4. klo 12", "Kaikki sivut ja palvelut", "Painettava versio"]
NAMES = ["Rail", "Water", "Forest", "Harbour", "Paper", "Sauna", "Ice", "Light", "Sound", "Metal", "Glass", "Wood"]


def unseen_site(n, seed):
    draw = random.Random(seed)
    pages, truth = [], []
    for k in range(n):
        title = f"{draw.choice(NAMES)} and {draw.choice(NAMES)} Engineering"
        own = [title, f"Students of {title.lower()} plan {draw.choice(NAMES).lower()} works with group {draw.randrange(10**6)}, and they learn to measure what they build."]
        facts = [f"Programme: {title}", "Degree: M.Sc.", f"Duration: {draw.randrange(2, 9)} semesters"]
        late = [f"Graduates number {draw.randrange(10**6)} work in harbours, and many of them come back for a visit to the department."] * draw.randrange(2)
        modules = ["Modules", "- Ropes", f"- {draw.choice(NAMES)} Studies"] if draw.random() < 0.5 else []
        lines = [(x, False) for x in draw.sample(NOTICES, 1) + draw.sample(MENU, 4)] + [(f"Etusivu > Opinnot > {title}", False)] + [(own[0], True)]
        lines += [(own[1], True)] + [(x, False) for x in draw.sample(["Jaa tämä sivu", "Useita kysymyksiä", "Muut ohjelmat"], 2)] + [(x, True) for x in draw.choice([facts + modules + late, late + facts + modules])]
        lines += [("", False)] + [(x, False) for x in draw.sample(FOOTERS, 3) + draw.sample(NOTICES, 1)]
        pages.append((f"pages/koulu-{k % 3}.example/{k}", "\n".join(x for x, _ in lines)))
        truth += [(f"pages/koulu-{k % 3}.example/{k}", i, main) for i, (x, main) in enumerate(lines, 1) if x]
    return pages, truth


def test_an_unseen_site_is_learned_from_its_pages(spark):
    pages, truth = unseen_site(90, 1)
    got = {(r.cached_file_path, r.line_no): r.main for r in m.page_lines(spark.createDataFrame(pages, "cached_file_path string, page_text string")).collect()}
    around = {(p, i) for p, i, main in truth if not main}
    found = {k for k, main in got.items() if not main}
    assert len(found & around) >= 0.98 * len(around) and len(found & around) >= 0.98 * len(found)
    assert set(got) == {(p, i) for p, i, _ in truth}


def test_long_notices_are_learned_too(spark):
    pages, _ = unseen_site(60, 2)
    lines = m.page_lines(spark.createDataFrame(pages, "cached_file_path string, page_text string")).filter("length(line) > 250").collect()
    assert len(NOTICES[0]) > 250 and len(lines) > 30 and not any(r.main for r in lines)


def test_tables(spark):
    day = dt(2025, 1, 1)
    pages = spark.createDataFrame([("pages/s/1", PAGE, "z"), ("pages/s/2", None, "z"), ("pages/s/3", "", "z")], "cached_file_path string, page_text string, id string")
    sources = spark.createDataFrame([("P1", "pages/s/1", day), ("p1 ", "pages/s/1", day), ("p2", "pages/lost", day), ("p3", None, day)], "id string, cached_file_path string, created_at timestamp_ntz")
    evidence = spark.createDataFrame([("e1", " p1", "Quick links"), ("e1", " p1", "Quick links"), ("e2", "p1", "Country: DE"), ("e3", "p2", "Quick links"), ("e4", None, "Quick links"), ("e5", "p1", None), ("e6", "p1", " ")], "id string, source_page_id string, short_evidence_text string").selectExpr("*", "'x' as extracted_value")
    got = {tuple(r) for r in m.boilerplate(pages, evidence, sources).collect()}
    lines = PAGE.split("\n")
    # one page alone does not tell that its sentence of rights (line 24) is the site's
    assert got == {("cached_pages", "pages/s/1", i) for i, x in enumerate(lines, 1) if x.strip() and i not in MAIN | {24}} | {("evidence_records", "e1", 0)}
    assert m.boilerplate(pages.limit(0), evidence.limit(0), sources.limit(0)).count() == 0
