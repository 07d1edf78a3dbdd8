from datetime import datetime as dt

from tessera.operators import orphans
from tessera.operators.skew import heavy_keys, salted_join

T1, T2, T3 = dt(2025, 1, 1), dt(2025, 2, 1), dt(2025, 3, 1)


def tables(spark):
    page = spark.createDataFrame([("p1", T1, "x"), ("p1", T1, "x"), ("P3", T3, "x"), ("p4", T1, "x"), ("p5", T1, "x")], "id string, created_at timestamp_ntz, key string")
    cand = spark.createDataFrame([("c1", " P1 ", T2), ("c2", "p2", T2), ("c3", "p3", T2), ("c4", "p4", T2), ("c5", None, T2), ("c6", "  ", T2), ("c7", "p5", T2), ("c8", "p1", None)], "id string, source_page_id string, created_at timestamp_ntz")
    evid = spark.createDataFrame([("e1", "c2", "p1", T2), ("e2", "c1", "p1", T2), ("e2", "c1", "p1", T2)], "id string, candidate_id string, source_page_id string, created_at timestamp_ntz")
    conf = spark.createDataFrame([("k1", "c1", "e1", "e2", T3), ("k2", "c1", "e2", "e9", T3)], "id string, candidate_id string, first_evidence_id string, second_evidence_id string, created_at timestamp_ntz")
    log = spark.createDataFrame([("source_pages", "P4", T1, None), ("source_pages", "p5", T1, T2), ("evidence_records", "p1", T1, None)], "record_table string, record_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    return {"source_pages": page, "candidate_records": cand, "evidence_records": evid, "conflict_records": conf}, log


def test_kinds(spark):
    got = {(r.record_id, r.record_column, r.kind, r.report_month) for r in orphans.broken_references(orphans.cascade(*tables(spark))).collect()}
    assert got == {("c2", "source_page_id", "missing", "2025-02"), ("c3", "source_page_id", "late", "2025-02"), ("c4", "source_page_id", "deleted", "2025-02"), ("k2", "second_evidence_id", "missing", "2025-03")}


def test_cascade(spark):
    found = orphans.cascade(*tables(spark))
    got = {(r.record_id, r.orphanhood, r.depth, r.kind) for r in found.collect()}
    assert got == {("c2", "direct", 0, "missing"), ("c3", "direct", 0, "late"), ("c4", "direct", 0, "deleted"), ("k2", "direct", 0, "missing"), ("e1", "inherited", 1, None), ("k1", "inherited", 2, None)}
    counts = {(r.record_table, r.orphanhood, r.depth): r.rows for r in orphans.orphan_counts(found).collect()}
    assert counts == {("candidate_records", "direct", 0): 2, ("conflict_records", "direct", 0): 1, ("evidence_records", "inherited", 1): 1, ("conflict_records", "inherited", 2): 1}


def test_long_chains_and_cycles_end_by_themselves(spark):
    rows = [(f"n{i}", f"n{i - 1}", T1) for i in range(26)] + [("a", "b", T1), ("b", "a", T1), ("c", "n25", T1), ("d", "c", T1), ("c", "d", T1)]
    one = {"t": spark.createDataFrame(rows, "id string, up string, created_at timestamp_ntz")}
    log = spark.createDataFrame([], "record_table string, record_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    found = orphans.cascade(one, log, (orphans.ForeignKey("t", "up", "t"),))
    got = {(r.record_id, r.depth) for r in found.collect()}
    assert got == {(f"n{i}", i) for i in range(26)} | {("c", 26), ("d", 27)}


def test_empty(spark):
    some, log = tables(spark)
    none = {k: v.limit(0) for k, v in some.items()}
    found = orphans.cascade(none, log.limit(0))
    assert found.count() == 0 and orphans.broken_references(found).count() == 0 and orphans.orphan_counts(found).count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 50 as string) end as k")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("8", 3), (None, 4)], "k string, v int")
    assert heavy_keys(left, "k", floor=100) == [("hot", 17)]
    from pyspark.sql import functions as F

    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        got = salted_join(left, right, "k", F.col("id"), how, heavy=[("hot", 17)]).select(left.join(right, "k", how).columns)
        assert sorted(map(str, got.collect())) == want
