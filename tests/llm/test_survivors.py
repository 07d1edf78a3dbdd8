import json
from datetime import datetime as dt, timedelta
import random

from tessera.llm import survivors as s
from tessera.llm.names import PLACEHOLDERS

SCHEMA = "id string, updated_at timestamp_ntz, normalized_data string, reviewer_overrides string, group_id int"
DAY = dt(2025, 1, 1)


def row(i, day, data, over=None):
    return (i, DAY + timedelta(days=day) if day is not None else None, json.dumps({"university_name": "University of Bergtal", "program_name": "Rail Systems", "degree_level": "master"} | data), json.dumps(over) if isinstance(over, dict) else over, 1)


def test_survivors(spark):
    rows = [
        row("a", 1, {"city": "Bergtal", "intake": "n/a"}, {"study_mode": "online", "city": "k. A."}),
        row("b", 2, {"program_name": "M.Sc. - RAIL  SYSTEMS", "degree_level": "?", "intake": "winter"}, ""),
        row("c", 3, {"university_name": "Uni Bergtal", "degree_level": "Master of Science", "city": " ", "study_mode": "hybrid"}, None),
        row("c", 3, {"university_name": "Uni Bergtal", "degree_level": "Master of Science", "city": " ", "study_mode": "hybrid"}, None),
        row("d", 9, {"degree_level": "BSc"}),
        row("e", None, {"program_name": "Rail Sytsems"}),
        ("f", DAY, '{"program_name": "Ra', None, 1),
        ("g", DAY, None, None, 1),
    ]
    names = spark.createDataFrame([("University of Bergtal",), ("Uni Bergtal",)], "name string")
    more = [row(f"z{i}", 0, {"program_name": f"{w} Systems", "degree_level": "phd"}) for i, w in enumerate(["Art", "Rail", "Media", "Water"])]
    got = {(r.field_name, r.candidate_id) for r in s.survivors(spark.createDataFrame(rows + more, SCHEMA), names).collect()}
    assert got == {("program_name", "c"), ("university_name", "c"), ("degree_level", "c"), ("city", "a"), ("intake", "b"), ("study_mode", "a")}
    assert s.survivors(spark.createDataFrame([], SCHEMA), names).count() == 0


def test_policy_equals_brute_force(spark):
    draw = random.Random(7)
    values = ["x", "y", None, "", "n/a", "--"]
    rows = []
    for i in range(300):
        data = {f: draw.choice(values) for f in s.FIELDS}
        over = {f: draw.choice(values) for f in s.FIELDS if draw.random() < 0.2}
        rows.append((f"{i:03}", DAY + timedelta(days=draw.randrange(40)), json.dumps(data), json.dumps(over), i % 9))
    df = spark.createDataFrame(rows, SCHEMA)
    groups = df.selectExpr("id", "cast(group_id as string) as group_id")
    got = {(r.group_id, r.field_name): r.candidate_id for r in s.surviving_values(s.skylines(s.candidate_records(df), groups)).collect()}
    good = lambda v: v is not None and not PLACEHOLDERS.fullmatch(v.strip())
    want = {}
    for g in range(9):
        for f in s.FIELDS:
            entries = []
            for i, at, data, over, gid in rows:
                if gid == g:
                    d, o = json.loads(data), json.loads(over)
                    full = sum(good(o.get(x)) or good(d.get(x)) for x in s.FIELDS)
                    entries += [(t, at, full, i) for t, v in ((1, o.get(f)), (0, d.get(f))) if good(v)]
            if entries:
                top = max(e[:3] for e in entries)
                want[(str(g), f)] = {e[3] for e in entries if e[:2] == top[:2]}
    assert set(got) == set(want) and all(got[k] in want[k] for k in want)


def test_skyline_equals_brute_force_and_fills_from_its_records(spark):
    draw = random.Random(9)
    rows = []
    for i in range(200):
        data = {f: "v" for f in s.FIELDS if draw.random() < 0.4}
        over = {f: "w" for f in s.FIELDS if draw.random() < 0.1}
        rows.append((f"{i:03}", DAY + timedelta(days=draw.randrange(30)), json.dumps(data), json.dumps(over), i % 6))
    df = spark.createDataFrame(rows, SCHEMA)
    sky = s.skylines(s.candidate_records(df), df.selectExpr("id", "cast(group_id as string) as group_id"))
    got = {r.group_id: [(x.trust, x.id) for x in r.skyline] for r in sky.collect()}
    left_out = 0
    for g in range(6):
        records = [(t, at, frozenset(json.loads(j)), i) for i, at, data, over, gid in rows if gid == g for t, j in ((0, data), (1, over)) if json.loads(j)]
        beaten = lambda x: any(y[0] >= x[0] and y[1] >= x[1] and y[2] >= x[2] and y[:3] != x[:3] for y in records)  # noqa: E731, B023
        want = {}
        for x in records:
            if not beaten(x):
                want[x[:3]] = min(want.get(x[:3], x[3]), x[3])
        left_out += len(records) - len(want)
        order = sorted((-t, -at.timestamp(), -len(fs), i, t) for (t, at, fs), i in want.items())
        assert [(x[4], x[3]) for x in order] == got[str(g)]
    assert left_out > 50
    # nulls are filled from later records of the skyline
    assert {r.rank for r in s.surviving_values(sky).collect()} > {0, 1}


def test_a_group_of_a_third_of_all_rows_stays_bounded(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as id", "timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(cast(id % 1000 as int)) as updated_at", "concat('{\"city\":\"c', id, '\"', if(id % 3 = 0, ',\"intake\":\"w\"', ''), '}') as normalized_data", "cast(null as string) as reviewer_overrides")
    sky = s.skylines(s.candidate_records(rows), rows.selectExpr("id", "'g' as group_id")).collect()
    assert [(x.id, x.filled) for x in sky[0].skyline] == [("12999", 2**3 + 2**8)]  # the smallest of the latest ids


def test_titles_and_degrees(spark):
    df = spark.createDataFrame([("Master of Science - Rail & Water",), ("Rail and Water, M.Sc.",), ("Rail and Water (BSc)",), ("Mastering Rail",), ("PhD",), ("Dr. Rail",)], "t string")
    got = [(r[0], r[1]) for r in df.select(s.F.array_join(s.title_words(s.F.col("t")), " "), s.degree_in_title(s.F.col("t"))).collect()]
    assert got[0] == ("rail and water", "master") and got[1] == ("rail and water", "master") and got[2] == ("rail and water", "bachelor") and got[3] == ("mastering rail", None)
