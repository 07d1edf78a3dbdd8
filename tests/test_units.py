import pytest

from tessera.operators import units

CASES = {
    "24 months": 24, "P2Y": 24, "P1Y6M": 18, "2½ years": 30, "2 1/2 years": 30, "2,5 Jahre": 30, "two and a half years": 30, "1 year and 6 months": 18,
    "4 semesters incl. 8-week internship": 24, "120 ECTS, 4 semesters": 24, "Duration 2 years, 120 credits": 24, "3 J.": 36, "156 weeks": 36, "1095 days": 36,
    "6 trimesters": 24, "fünf Semester": 30, "approx. 36 months": 36, "5y": 60, "4 semsters": 24, "2 years": 24, "three years (180 ECTS)": 36,
    "": None, "4": None, "2-3 semesters": None, "24–30 months": None, "2 to 4 Semester": None, "up to 24 months": None, "max. 2 years": None, "at least 4 semesters": None,
    "winter semester": None, "120 ECTS": None, "two or three years": None, "n/a": None, "6 wombats": None, "x" * 100_000: None,
    "Master of Science (4 semesters)": 24, "Duration (24 months)": 24, "4 semesters (or 3)": 24, "up to (24 months)": None, "Degree (2-3 years)": None, "3 years (incl. 20-week internship)": 36,
    "12 months" + " of study at the campus in the north of the town" * 40: 12, "1 year plus 6 months": 18, "Vollzeitstudium mit 4 Semestern": 24, "2 years plus 6-month internship": 24, "4 semesters with a thesis of 6 months": 24, "6 tirmetsers": 24,
}


def test_wordings(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "k int, text string")
    got = {r.text: r.months for r in units.with_months(rows, ["k"]).collect()}
    assert got == {t: m for t, m in CASES.items() if m is not None}


def test_aliases_equal_brute_force(spark):
    words = ["semestre", "semetser", "yaers", "yeers", "Monat".lower(), "monta", "weaks", "mo", "mi", "trimestr", "tri", "xyz", "dayss", "", "semsters", "tirmetsers", "semesterrrrrrrrrrrrrrrrrrrrr", "y" * 5000]
    got = {r.spelling: r.unit for r in units.unit_aliases(spark.createDataFrame([(w,) for w in words], "spelling string")).collect()}
    for w in words:
        near = {}
        for u, (_, known) in units.UNITS.items():
            d = min(units.weighted_distance(w, k) for k in known)
            if (w in known) or (len(w) > 4 and d <= len(w) // 5):
                near[u] = d
        least = sorted(near.values())
        want = min(near, key=near.get) if near and (len(least) == 1 or least[1] > least[0]) else None
        assert got.get(w) == want, w


def test_rows_of_both_tables(spark):
    candidates = spark.createDataFrame(
        [("a", '{"duration_value": 24, "duration_unit": "mths"}', "x"), ("b", '{"duration_semesters": "4", "duration": "2 years"}', "x"), ("c", '{"duration": "2 years", "duration_semesters": "5"}', "x"), ("d", '{"duration": "2 ye', "x"), ("e", None, "x"), (None, '{"duration": "1 year"}', "x"), ("b", '{"duration_semesters": "4", "duration": "2 years"}', "x")],
        "id string, normalized_data string, months string",
    )
    evidence = spark.createDataFrame([("f", "duration_unit", "3 yrs"), ("g", "city", "3 yrs"), ("h", "duration_semesters", "4"), ("i", None, None)], "id string, field_name string, extracted_value string")
    got = {(r.record_id, r.duration_months) for r in units.durations(candidates, evidence).collect()}
    assert got == {("a", 24), ("b", 24), (None, 12), ("f", 36)}
    assert units.durations(candidates.limit(0), evidence.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,d", [("week", "week", 0), ("wek", "week", 0.5), ("weke", "week", 0.75), ("", "ab", 2)])
def test_distance(a, b, d):
    assert units.weighted_distance(a, b) == pytest.approx(d)
