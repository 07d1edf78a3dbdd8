import pytest
from pyspark.sql import functions as F

from tessera.functions import text, urls, values


def ask(spark, expr, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_text(spark):
    assert ask(spark, text.clean_text("x"), " a \n b ", None, "") == ["a b", "", ""]
    assert ask(spark, text.clean_text("x", 3), "abcdef") == ["abc"]
    assert ask(spark, text.excerpt(F.lit("City"), "x"), " Bonn ") == ["City: Bonn"]
    assert ask(spark, text.formula_safe("x"), "=1", "+1", "-", "@x", "\tx", "a=1", None) == ["'=1", "'+1", "'-", "'@x", "'\tx", "a=1", ""]
    assert ask(spark, text.fold_key("x"), "Große  Straße", "GROSSE STRASSE") == ["grosse strasse"] * 2
    assert ask(spark, text.html_escape("x"), "<a & 'b'>\"") == ["&lt;a &amp; &#x27;b&#x27;&gt;&quot;"]
    assert ask(spark, text.country_code("x"), " de", "DEU", None) == ["DE", None, None]
    assert ask(spark, text.is_label("x"), "Ann B.", "a@b", "", None) == [True, False, False, False]
    assert ask(spark, text.is_output_name("x"), "run_1.csv", "../x", "a..b", "") == [True, False, False, False]


def test_canonical_addresses(spark):
    got = ask(spark, urls.canonical_url("x"), "HTTPS://A.Example:443/x/?utm_source=1&b=2&a=%C3%A4&a#t", "http://a.example", "http://a.example:8080/x?k", "ftp://a.b/x", "http://u@a.b/", "nothing", None, "http://a.b/x?GCLID=1")
    assert got == ["https://a.example/x?a=&a=%C3%A4&b=2", "http://a.example/", "http://a.example:8080/x?k=", None, None, None, None, "http://a.b/x"]
    assert ask(spark, urls.without_query("x"), "a?b#c", "a#c") == ["a", "a#c"] and ask(spark, urls.without_query_and_fragment("x"), "a#c?d") == ["a"]


def test_address_checks(spark):
    got = ask(spark, urls.address_problem("x"), "http://a.example/", "ftp://a.b", "http://localhost/", "http://x.localhost", "http://u:p@a.b", "http://a.b:70000/", "http://10.0.0.1/", "http://8.8.8.8/", "http://123/", "http://0x7f.1/", "http:///x", None)
    assert got == [None, "unsupported_scheme", "local_host", "local_host", "credentials_not_allowed", "invalid_port", "blocked_address", None, "ambiguous_host", "ambiguous_host", "missing_host", "invalid_url"]
    assert ask(spark, urls.is_host_name("x"), "a.example", "a", "-a.example", None) == [True, False, False, False]
    assert ask(spark, urls.within_domain("x", F.lit("A.example.")), "a.example", "b.a.example", "ba.example", None) == [True, True, False, False]
    assert ask(spark, urls.host_suffixes("x"), "a.b.c") == [["a.b.c", "b.c", "c"]]
    assert ask(spark, urls.is_trap("x"), "http://a.b/news/1", "http://a.b/newsletter", "http://a.b/x.PDF") == [True, False, True]


def test_link_scores(spark):
    score = urls.link_score("x", F.lit("our master"), F.lit(True))
    assert ask(spark, score["score"], "http://a.b/programmes/x", "http://a.b/x", "http://a.b/news-archive/master") == [100, 35, 0]
    assert ask(spark, F.array_join(score["signals"], ";"), "http://a.b/study") == ["path:study;text:master;catalogue-context"]


def test_values(spark):
    assert ask(spark, values.degree("x"), "M.Sc.", "Bachelor of Science", "Dr.-Ing.", "PhD", "mastery", None) == ["master", "bachelor", "phd", "phd", None, None]
    assert ask(spark, values.program_name("x"), "Master of Science - Rail", "Rail (M.Sc.)", "Rail, M. Sc.", "Master in Law", "Doctorate Law", "Bachelor  Ph.D.", "Master", None) == ["Rail", "Rail (M.Sc.)", "Rail", "in Law", "Doctorate Law", "Bachelor Ph.D.", "Master", None]
    assert ask(spark, values.teaching_language("x"), "Deutsch, Englisch", "bilingual", "english", "other") == ["English and German", "bilingual", "English", None]
    assert ask(spark, values.study_mode("x"), "Part-time", "full_time", "blended online", "?", None) == ["part_time", "unknown", "hybrid", "unknown", None]
    assert [tuple(r) if r else None for r in ask(spark, values.duration("x"), "P2Y", "P18M", "P7M", "four semesters", "2 year course", "2-year course", "none")] == [(2, "years", 4), (3, "semesters", 3), (7, "months", None), (4, "semesters", 4), (2, "years", 4), None, None]
    assert ask(spark, values.country("x"), "de", "Germany", "Atlantis") == ["DE", "DE", None]
    assert ask(spark, values.metadata_title("x"), "Rail | Uni", "Rail") == ["Rail", "Rail"]


@pytest.mark.parametrize("field,value,ok,out", [("degree_level", "MSc", True, "master"), ("degree_level", "x", False, None), ("city", "", True, ""), ("duration_value", "0", False, None), ("duration_value", "12", True, "12"), ("source_url", "ftp://x", False, None), ("city", None, False, None), ("city", "x" * 2001, False, None)])
def test_overrides(spark, field, value, ok, out):
    got = ask(spark, values.checked_override(F.lit(field), "x"), value)[0]
    assert (got.ok, got.value) == (ok, out)
