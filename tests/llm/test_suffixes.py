from datetime import datetime as dt

from hypothesis import given, settings, strategies as st

from tessera.llm import suffixes

TEXT = st.text(alphabet="ab\n", max_size=60).map(str.encode)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.text(alphabet="ab\n", min_size=1, max_size=8).map(str.encode))
def test_suffix_array_and_longest_match(text, pattern):
    order = suffixes.suffix_array(text)
    assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
    n, first, last = suffixes.longest_match(text, order, pattern)
    want = max((k for k in range(len(pattern) + 1) if pattern[:k] in text), default=0) if text else 0
    assert n == want
    if n:
        assert sorted(order[first:last]) == [i for i in range(len(text)) if text[i : i + n] == pattern[:n]]


def test_segments_are_binary_digits():
    for n in range(1, 70):
        got = {suffixes.segment_of(i, n) for i in range(n)}
        assert len(got) == bin(n).count("1") and sum(z for _, z in got) == n
        assert all(s <= i < s + z for i in range(n) for s, z in [suffixes.segment_of(i, n)])


def test_coverage():
    text = b"\nabcdef\nabcxyz\n"
    starts = [i for i, c in enumerate(text) if c == 10]
    order = suffixes.suffix_array(text)
    assert suffixes.covered(text, order, starts, b"abcdef", 1.0) == {0: 1.0}
    assert suffixes.covered(text, order, starts, b"abcde", 1.0) == {}
    assert 0 in suffixes.covered(text, order, starts, b"abcdeg", 0.7)


def test_known_pages(spark):
    d1, d2, d3 = dt(2025, 1, 1), dt(2025, 4, 1), dt(2025, 6, 1)
    batch = spark.createDataFrame(
        [(1, "http://www.a.example/x/", d2, "z"), (2, "https://a.example/x?id=2", d2, "z"), (3, None, d2, "z"), (4, "https://a.example/x", None, "z"), (5, "https://A.example//x", d1, "z"), (1, "http://www.a.example/x/", d2, "z"), (6, "https://b.example/" + "y" * 50_000, d3, "z")],
        "batch_row_id bigint, canonical_url string, submitted_at timestamp_ntz, id string",
    )
    pages = spark.createDataFrame(
        [("p", "https://a.example/x", d1, "z"), ("p", "https://a.example/x", d1, "z"), ("q", "https://a.example/x#s", d3, "z"), ("r", "not a page", d1, "z"), ("s", None, d1, "z"), ("t", "https://b.example/" + "y" * 50_000, d2, "z"), ("u", "https://b.example/" + "y" * 49_999, d2, "z")],
        "id string, normalized_url string, created_at timestamp_ntz, batch_row_id string",
    )
    assert sorted(map(tuple, suffixes.known_pages(batch, pages).collect())) == [(1, "p"), (6, "t")]
    assert suffixes.known_pages(batch.limit(0), pages).count() == 0
    assert suffixes.known_pages(batch, pages.limit(0)).count() == 0
