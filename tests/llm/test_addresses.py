import pytest

from tessera.llm.addresses import address, page_address

SAME = [
    "https://a.example/x/y",
    "http://www.A.example:80//x/./y/?utm_source=q&fbclid=1#top",
    " HTTPS://a.example.:443/x/z/../%79/index.html ",
    "https://a.example/x/y/index.php/?PHPSESSID=9&ref=home",
    "https://u@a.example/x/y?&",
]


def test_same_page():
    assert {page_address(u) for u in SAME} == {"a.example/x/y"}
    assert page_address("https://a.example/?b=2&a=1&b=2&gclid=x") == page_address("https://a.example/index.htm?a=1&b=2")
    assert page_address("https://a.example/g%C3%A4") == page_address("https://a.example/gä")


@pytest.mark.parametrize("u", ["https://a.example/x", "https://a.example/x/Y", "https://b.a.example/x/y", "https://a.example:8080/x/y", "https://a.example/x/y?id=1", "https://a.example/x%2Fy", "https://a.example/de/x/y"])
def test_other_page(u):
    assert page_address(u) != "a.example/x/y"


def test_no_page(spark):
    assert [page_address(u) for u in (None, "", "ftp://a.example", "a.example/x", "https://", "mailto:x@y.example")] == [None] * 6
    df = spark.createDataFrame([("http://a.example",), (None,)], "u string")
    assert [r[0] for r in df.select(address("u")).collect()] == ["a.example/", None]


def test_column_gives_the_same_form(spark):
    urls = [*SAME, "https://a.example/x/y/index.htm/", "https://a.example/index.php/", "https://a.example/x/y\n", "https://a.example/x/y/default.aspx//"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(address("u")).collect()] == [page_address(u) for u in urls]
