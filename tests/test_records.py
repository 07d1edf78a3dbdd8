import random

from hypothesis import given, settings, strategies as st

from tessera.sources import records

SCHEMA = "record_id bigint, file_name string, input_kind string, line_no int, raw_record string, reason string"


def test_reasons_and_typed_rows(spark):
    rows = [
        (1, "a", "batch", 1, "﻿source_url;expected_university_name;expected_program_name;operator_notes\r", "clash"),
        (2, "a", "batch", 2, 'https://x.example/a;"He said ""hi""";;"two\nlines"\r', "clash"),
        (3, "a", "batch", 3, 'https://x.example/a;He "said";;\r', None),
        (4, "a", "batch", 4, "https://x.example/a;b;c\r", None),
        (5, "a", "batch", 5, "https://u:p@x.example/a;b;c;d\r", None),
        (6, "a", "batch", 6, " ; ;;\r", None),
        (7, "a", "batch", 7, None, None),
        (8, "a", "batch", 8, "", None),
        (9, "b", "seed", 1, "official_domain,institution_name,catalogue_url,sitemap_url,operator_notes", None),
        (10, "b", "seed", 2, " X.Example. ,Uni,,,", None),
        (11, "b", "seed", 3, "x.example/path,Uni,,,", None),
        (12, "b", "seed", 4, "x.example/path, ,,,", None),
        (13, "b", "seed", 5, '"x.example,Uni,,,', None),
        (14, "lost", "seed", 7, "Uni,x.example,,,", None),
        (15, "a", "batch", 9, "x" * 3_000_000, None),
    ]
    parsed = records.parse_records(spark.createDataFrame(rows, SCHEMA))
    assert {r.record_id: r.reason for r in records.rejected(parsed).collect()} == {
        3: "quoting", 4: "column_count", 5: "source_url", 11: "official_domain", 12: "institution_name", 13: "quoting", 15: "column_count",
    }
    batch = records.loaded(parsed, "batch").collect()
    assert [(r.record_id, r.expected_university_name, r.operator_notes) for r in batch] == [(2, 'He said "hi"', "two\nlines")]
    assert sorted(r.official_domain for r in records.loaded(parsed, "seed").collect()) == ["x.example", "x.example"]


def test_empty(spark):
    assert records.parse_records(spark.createDataFrame([], SCHEMA)).count() == 0


CELL = st.text(alphabet='ab",; \n\r', max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=30), st.sampled_from(",;"))
def test_bisection_equals_strict_reading(rows, delimiter):
    columns = ["x", "y", "z"]
    texts = [t for t in (delimiter.join(r) for r in rows) if t]
    if not texts:
        return
    got = records.parse_block(texts, "other", delimiter, columns)
    for text, (reason, cells) in zip(texts, got):
        want = records.diagnose(text, "other", delimiter, columns)
        if want[0] is None and ("\r" in text):
            assert reason is None or reason == want[0]
        else:
            assert (reason, cells if reason is None else []) == (want[0], want[1] if want[0] is None else [])


def test_round_trip_of_well_formed_records():
    draw = random.Random(5)
    for _ in range(50):
        rows = [["".join(draw.choice('a",\n ') for _ in range(draw.randrange(6))) for _ in range(3)] for _ in range(20)]
        texts = [",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows]
        assert [c for _, c in records.parse_block(texts, "other", ",", ["x", "y", "z"])] == rows


def test_addresses():
    good = ["http://a.example", "HTTPS://A.example:443/x y", "https://a.example:/", "https://localhost/x", "https://[::1]:80/", " https://a.b/ "]
    bad = ["", "a.example", "//a.example/x", "https:/a.example", "https:///x", "ftp://a.b", "https://a.b:port/", "https://a.b:99999/", "https://u@a.b/", "javascript:void(0)", "https://:80/", "https://a b.example/"]
    assert not any(map(records.bad_source_url, good)) and all(map(records.bad_source_url, bad))
    assert not any(map(records.bad_domain, ["a.example", " A.B.example. "])) and all(map(records.bad_domain, ["", "localhost", "a..b", ".a.b", "*.a.b", "a.b:80", "a.1", "a_b.c", "x.c/d", "a.b.."]))


def test_files_are_taken_or_rejected_whole(spark):
    head = "source_url,expected_university_name,expected_program_name,operator_notes"
    seeds = "institution_name,official_domain,catalogue_url,sitemap_url,operator_notes"
    rows = [
        (1, "a", "batch", 1, head), (2, "a", "batch", 2, "https://x.example/a/,U,P,"), (3, "a", "batch", 3, "HTTPS://X.example/a?utm_source=q,V,P,"), (4, "a", "batch", 4, "https://x.example/b,U,P,"), (5, "a", "batch", 5, " , ,,"),
        (6, "b", "batch", 1, head), (7, "b", "batch", 2, "https://x.example/a,U,P,"), (8, "b", "batch", 3, "ftp://x.example,U,P,"), (9, "b", "batch", 4, "https://x.example/c,U,P"),
        (10, "c", "seed", 1, seeds), (11, "c", "seed", 2, "U,x.example.,https://www.x.example/cat,,"), (12, "c", "seed", 3, "V,X.example,,,"), (13, "d", "seed", 1, seeds), (14, "d", "seed", 2, "U,x.example,https://y.example/cat,,"),
    ]
    checked = records.checked_rows(records.parse_records(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)))
    assert {(r.file_name, r.records, r.errors, r.accepted) for r in records.file_status(checked).collect()} == {("a", 3, 0, True), ("b", 3, 2, False), ("c", 2, 0, True), ("d", 1, 1, False)}
    assert {(r.record_id, r.error) for r in checked.filter("error is not null").collect()} == {(8, "source_url"), (9, "column_count"), (14, "outside_domain")}
    assert sorted(r.record_id for r in records.accepted_rows(checked, "batch").collect()) == [2, 4]
    assert [(r.record_id, r.official_domain) for r in records.accepted_rows(checked, "seed").collect()] == [(11, "x.example")]
    assert records.file_status(checked.limit(0)).count() == 0


def test_one_file_with_most_rows(spark):
    rows = [(i, "hot" if i % 3 else f"f{i}", "batch", 2, f"https://x.example/{i},U,P,n", None) for i in range(6000)] + [(-1, "hot", "batch", 1, "expected_program_name,source_url,expected_university_name,operator_notes", None)]
    parsed = records.parse_records(spark.createDataFrame(rows, SCHEMA))
    assert parsed.count() == 6000
    assert parsed.filter("file_name = 'hot' and reason = 'source_url'").count() == 4000 and parsed.filter("file_name <> 'hot' and reason is null").count() == 2000
