import json
import random
from datetime import datetime as dt, timedelta

from pyspark.sql import functions as F

from tessera.operators import contract, crawl, groups, history, layers, merge, resolve

DAY = dt(2025, 1, 1)
EVID = "id string, candidate_id string, source_page_id string, field_name string, extracted_value string, normalized_value string, evidence_locator string, confidence string, created_at timestamp_ntz, value string"


def evidence(n=400, seed=3):
    draw = random.Random(seed)
    return [(f"e{i:03}", f"c{draw.randrange(20)}", f"p{draw.randrange(3)}", draw.choice(["city", "intake", "other", "source_url"]), draw.choice(["A", "a", "B", "C"]), draw.choice([None, "", "A", "b"]), "x", draw.choice(["high", "medium", "low", None]), DAY + timedelta(days=draw.randrange(5)), "clash") for i in range(n)]


def test_resolution_equals_brute_force(spark):
    rows = evidence()
    got = {(r.candidate_id, r.field_name): (r.outcome, r.value, r.confidence, r.first_evidence_id, r.second_evidence_id) for r in resolve.resolve(resolve.ranked_evidence(spark.createDataFrame(rows + rows[:50], EVID))).collect()}
    rank = {"high": 0, "medium": 1}
    want = {}
    for key in {(r[1], r[3]) for r in rows if r[3] in resolve.SUPPORTED}:
        mine = sorted(((rank.get(r[7], 2), r[8], r[0], r[5] or r[4], r[2]) for r in rows if (r[1], r[3]) == key), key=lambda x: x[1:3])
        best = min(x[0] for x in mine)
        top = [x for x in mine if x[0] == best]
        values, tops = {x[3].lower() for x in mine}, {x[3].lower() for x in top}
        conf = "high" if best == 0 or (best == 1 and len({x[4] for x in mine}) > 1) else "medium" if best == 1 else "low"
        if len(values) == 1:
            want[key] = ("low_only", None, conf, None, None) if best == 2 else ("agreed", top[0][3], conf, None, None)
        elif len(tops) == 1:
            want[key] = ("outranked", top[0][3], conf, None, None)
        else:
            want[key] = ("conflict", None, conf, top[0][2], next(x[2] for x in top if x[3].lower() != top[0][3].lower()))
    assert got == want


def test_own_page_wins_for_source_url(spark):
    rows = [("1", "c", "p", "source_url", "u1", None, "x", "low", DAY, ""), ("2", "c", "q", "source_url", "u2", None, "x", "high", DAY, ""), ("3", "d", "q", "source_url", "u2", None, "x", "high", DAY, "")]
    candidates = spark.createDataFrame([("c", "p"), ("d", "p")], "id string, source_page_id string")
    assert {r.id for r in resolve.ranked_evidence(spark.createDataFrame(rows, EVID), candidates).collect()} == {"1", "3"}


def test_layers(spark):
    rows = spark.createDataFrame([("c", '{"a": "1", "b": "2", "n": null}', '{"b": "", "d": "4"}'), ("x", '{"a', None)], "id string, data string, over string")
    context = spark.createDataFrame([("c", "a", "9", 1), ("c", "e", "5", 1)], "candidate_id string, field_name string, value string, layer int")
    got = {r.field_name: (r.value, r.layer) for r in layers.effective_values(layers.json_layer(rows, "data", 0), context, layers.json_layer(rows, "over", 2)).collect()}
    assert got == {"a": ("1", "extraction"), "b": ("", "override"), "n": (None, "extraction"), "d": ("4", "override"), "e": ("5", "context")}


def test_merge_is_idempotent(spark):
    rows = evidence()
    old, new = spark.createDataFrame(rows[:250], EVID), spark.createDataFrame([(f"n{r[0]}", *r[1:]) for r in rows[200:]], EVID)
    once = merge.merge_by_key(old, new, merge.EVIDENCE_KEY, ["candidate_id", "source_page_id"])
    again = merge.merge_by_key(once.drop("change"), new, merge.EVIDENCE_KEY, ["candidate_id", "source_page_id"])
    assert sorted(r.id for r in once.collect()) == sorted(r.id for r in again.collect()) and again.filter("change = 'inserted'").count() == 0
    gone = {r.id for r in merge.removed_by_merge(old, new, merge.EVIDENCE_KEY, ["candidate_id", "source_page_id"]).collect()}
    assert gone == {r[0] for r in rows[:250]} - {r.id for r in once.collect()}
    assert merge.merge_by_key(old, new.limit(0), merge.EVIDENCE_KEY, ["candidate_id"]).count() == 250


def test_conflicts_keep_their_resolution(spark):
    kept = spark.createDataFrame([("c", "f", "e2", "e1", "resolved", "v"), ("c", "g", "e3", "e4", "resolved", "v")], "candidate_id string, field_name string, first_evidence_id string, second_evidence_id string, resolution_status string, resolved_value string")
    now = spark.createDataFrame([("c", "f", "e1", "e2"), ("c", "g", "e3", "e5")], "candidate_id string, field_name string, first_evidence_id string, second_evidence_id string")
    assert {(r.field_name, r.resolution_status, r.resolved_value) for r in merge.merge_conflicts(kept, now).collect()} == {("f", "resolved", "v"), ("g", "unresolved", None)}


def test_history(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in history.latest(rows, ["k"], ["t"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in history.first_occurrences(rows, ["k"], ["t"]).collect()} == {("a", "x"), ("b", None)}
    stream = spark.createDataFrame([(i, f"u{i % 7}", i % 5 == 0) for i in range(40)] + [(40, None, False)], "ord int, u string, known boolean")
    got = [r.status for r in history.emission_status(stream, "u", F.col("known"), ["ord"]).orderBy("ord").collect()]
    seen, want = set(), []
    for i in range(41):
        u, known = (f"u{i % 7}", i % 5 == 0) if i < 40 else (None, False)
        want.append("already_existing" if known else "duplicate" if u in seen or u is None else "candidate")
        if not known:
            seen.add(u)
    assert got == want


def test_cut_at_target(spark):
    rows = spark.range(500).selectExpr("500 - id as o", "id % 3 = 0 as hit")
    for target in (0, 1, 20, 10_000):
        got = sorted(r.o for r in history.cut_at_target(rows, F.col("hit"), ["o"], target).collect())
        want, hits = [], 0
        for o in range(1, 501):
            if hits < target:
                want.append(o)
            hits += (500 - o) % 3 == 0
        assert got == want


def test_groups(spark):
    rows = spark.createDataFrame([(1, "A  b", "x"), (2, "a B", "X"), (3, "", "x"), (4, None, "x"), (5, "", "x")], "id int, a string, b string")
    assert [tuple(r) for r in groups.duplicate_groups(rows, "id", [F.col("a"), F.col("b")]).collect()] == [("a b | x", 2, 1)]
    assert {tuple(r) for r in groups.histogram(rows.selectExpr("b as level"), "level", ["x", "z"]).collect()} == {("x", 4), ("z", 0)}
    assert groups.rates(rows, {"r": F.col("a") == ""}, {"m": F.col("id")}).collect()[0] == (0.4, 3.0)


def test_walk(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", None)], "src string, dst string")
    seeds = spark.createDataFrame([("r", "a", True), ("s", "d", False)], "root string, node string, catalogue boolean")
    got = {(r.root, r.node, r.depth, r.catalogue) for r in crawl.walk(seeds, edges, 3).collect()}
    assert got == {("r", "a", 0, True), ("r", "b", 1, True), ("r", "c", 2, True), ("r", "d", 3, True), ("s", "d", 0, False), ("s", "e", 1, False)}


def test_contract(spark):
    entity = contract.read_manifest(json.dumps({"entities": [{"entity_type": "t", "columns": ["a", "s", "u", "d", "data_status"], "required_columns": ["a"], "conditional_required": {"ok": ["u"]}, "allowed_values": {"s": ["x"]}, "date_columns": ["d"], "url_columns": ["u"]}]}))["t"]
    rows = spark.createDataFrame([(1, "v", "x", "http://h/", "2025-02-03", "ok"), (2, "", "y", None, "2025-02-30", "ok"), (3, "v", "x", "h", "03.02.2025", "no"), (4, "v", "x", "http://h/", "2025-02-03", "ok")], "id int, a string, s string, u string, d string, data_status string")
    got = {tuple(r) for r in contract.violations(rows, entity, "id").collect()}
    assert got == {(1, "duplicate", "*"), (2, "required", "a"), (2, "conditional", "u"), (2, "allowed", "s"), (2, "date", "d"), (3, "url", "u"), (3, "date", "d")}
    assert contract.header_problems(["a", "b"], ["b", "a"]) == ["order"] and contract.header_problems(["a"], ["a", "c"]) == ["missing:c"]
    mapped = contract.map_values(spark.createDataFrame([("DE",), ("ES",), (None,)], "c string"), "c", {"DE": "DEU"}).collect()
    assert {tuple(r) for r in mapped} == {("DEU", False), (None, True), (None, False)}


def test_cut_at_target_is_exact_where_ranges_outgrow_their_sample(spark):
    rows = spark.range(0, 3_000_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at"), "id")
    kept = history.cut_at_target(rows, F.lit(True), ["at", "id"], 1_000_000, partitions=64)
    got = kept.agg(F.count(F.lit(1)), F.max(F.struct("at", "id"))).collect()[0]
    last = rows.orderBy("at", "id").limit(1_000_000).agg(F.max(F.struct("at", "id"))).collect()[0]
    assert got[0] == 1_000_000 and got[1] == last[0]


def test_conflict_resolution_does_not_hang_on_the_order_of_rows(spark):
    kept = [("c", "f", "a", "b", "accepted", "x"), ("c", "f", "b", "a", "accepted", "y"), ("c", "f", "a", "b", "unresolved", "z")]
    derived = spark.createDataFrame([("c", "f", "b", "a")], "candidate_id string, field_name string, first_evidence_id string, second_evidence_id string")
    schema = "candidate_id string, field_name string, first_evidence_id string, second_evidence_id string, resolution_status string, resolved_value string"
    for rows in (kept, kept[::-1]):
        assert [tuple(r) for r in merge.merge_conflicts(spark.createDataFrame(rows, schema), derived).collect()] == [("c", "f", "a", "b", "accepted", "y")]


def test_agreement_and_conflicts_of_removed_evidence(spark):
    e = spark.createDataFrame([("c", "f", "p", "A", None), ("c", "f", "q", "x", "a"), ("c", "g", "p", "a", ""), ("c", "g", "p", "b", None), ("c", "h", None, None, None), (None, "h", "p", "a", None)], "candidate_id string, field_name string, source_page_id string, extracted_value string, normalized_value string")
    k = spark.createDataFrame([("1", "c", "g", "e1", "e2"), ("2", "c", "z", "e3", None), ("3", None, "z", None, "e1")], "id string, candidate_id string, field_name string, first_evidence_id string, second_evidence_id string")
    assert {(r.field_name, r.agreement) for r in resolve.agreement(e, k).collect()} == {("f", "agreement across sources"), ("g", "conflict"), ("h", "single source or complementary")}
    assert resolve.agreement(e.limit(0), k.limit(0)).count() == 0
    assert [r.id for r in merge.without_evidence(k, spark.createDataFrame([("e1",), (None,)], "id string")).collect()] == ["2"]
