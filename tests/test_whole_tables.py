"""Queries over whole tables: no row is left out before the operator runs."""

import hashlib
import re
from collections import defaultdict
from datetime import datetime as dt

from tessera import queries_reference as q
from tessera.sources import fetchlog


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_duplicate_groups_of_any_names(spark, tmp_path):
    names = [("Universität  Köln", "Verkehr"), ("UNIVERSITÄT Köln ", " verkehr"), ("École\u00a0A", "Génie"), ("école a", "GÉNIE"), ("Große Schule", "B"), ("Grosse\tSchule", "b"), ("a b", "c"), ("A  B", "C"), ("A B", "c"), ("", "c"), (None, "c"), ("x", None), ("x", " \n"), ("y", "z")]
    rows = [(i, u, p) for i, (u, p) in enumerate(names)]
    save(spark, tmp_path, "batch_input_rows", rows + rows[:1], "batch_row_id bigint, expected_university_name string, expected_program_name string")
    fold = lambda s: re.sub(r"\s+", " ", s or "").strip().lower().replace("ß", "ss")
    want = defaultdict(set)
    for i, u, p in rows:
        if fold(u) and fold(p):
            want[f"{fold(u)} | {fold(p)}"].add(i)
    got = {r.group_key: (r.members, r.smallest_id) for r in q.queries()["duplicate_groups"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items() if len(v) > 1} and len(got) == 4


def test_kept_copies_are_hashed(spark, tmp_path):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    late = dt(2026, 1, 1)
    pages = [("good", "a", h("text ä"), "fetched", late), ("corrupt", "b", h("text"), "fetched", late), ("gone", "c", h("x"), "fetched", late), ("empty", "d", h("x"), "cache_hit", late), ("bare", None, h("x"), "fetched", late), ("nohash", "a", None, "fetched", late), ("old", "a", h("text ä"), "fetched", dt(2024, 1, 1)), ("failed", "a", h("text ä"), "http_error", late)]
    save(spark, tmp_path, "source_pages", pages + pages[:2], "id string, cached_file_path string, content_hash string, fetch_status string, cache_expires_at timestamp_ntz")
    save(spark, tmp_path, "cached_pages", [("a", "text ä"), ("b", "text!"), ("d", None)], "cached_file_path string, page_text string")
    states = q.queries()["source_integrity"](spark, str(tmp_path))
    got = sorted((r.id, r.state) for r in states.collect())
    assert got == sorted({"good": "ok", "corrupt": "cache_hash_mismatch", "gone": "cache_missing", "empty": "cache_missing", "bare": "missing_cache_metadata", "nohash": "missing_cache_metadata", "old": "ok", "failed": "ok"}.items())
    assert [r.id for r in q.queries()["cache_hits"](spark, str(tmp_path)).collect()] == ["good"]
    links = spark.createDataFrame([("1", "good", 1), ("1", "corrupt", 3), ("1", "gone", 2), ("2", "good", 1), ("3", None, 1), ("4", "unknown", 1)], "candidate_id string, source_page_id string, created_at int")
    assert {(r.candidate_id, r.state) for r in fetchlog.candidate_integrity(links, states).collect()} == {("1", "cache_missing"), ("2", "ok"), ("3", "missing_source_relationship"), ("4", "missing_source_relationship")}


def test_degree_words_of_all_values(spark, tmp_path):
    forms = {"bachelor": ["bachelor", "Bachelor of Science", "B.Sc.", "BSc", "b. sc", "Bachelor and Master"], "master": ["master", "M.Sc.", "MSc", "Master of Science (M.Sc.)"], "phd": ["phd", "Ph.D.", "Doctorate", "Dr.-Ing."], None: ["mastery", "Diplom", "", None]}
    rows = [(f"{level}{i}", "degree_level", v, level) for level, values in forms.items() for i, v in enumerate(values)]
    save(spark, tmp_path, "evidence_records", [*[r[:3] for r in rows], rows[0][:3], ("other", "city", "master")], "id string, field_name string, extracted_value string")
    assert sorted(map(str, q.queries()["degree_words"](spark, str(tmp_path)).collect())) == sorted(f"Row(id={r[0]!r}, level={r[3]!r})" for r in rows)
