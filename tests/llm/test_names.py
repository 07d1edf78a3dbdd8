import random

import pytest

from tessera.llm import names as n


@pytest.mark.parametrize(
    "name,want",
    [
        ("Technische Universität Bergtal", ("tech", "bergtal", None)), ("T.U. Bergtal", ("tech", "bergtal", None)), ("Bergtal (TU)", ("tech", "bergtal", None)), ("TU BERGT.", ("tech", "bergt", None)),
        ("Bergtal University of Applied Sciences", ("applied", "bergtal", None)), ("UAS Bergtal", ("applied", "bergtal", None)), ("Hochsch. Bergtal / Bergtal", ("applied", "bergtal", None)),
        ("Kunstakademie Bergtal", ("arts", "bergtal", None)), ("The University of Bergtal", ("univ", "bergtal", None)), ("Bergtal, University of", ("univ", "bergtal", None)), ("Bergtal University", ("lone", "bergtal", None)),
        ("Anna Holtkamp University of Bergtal", ("named", "bergtal", "holtkamp")), ("Univ. Holtkamp, Bergtal", ("named", "bergtal", "holtkamp")), ("University Bergtal (Anna Holtkamp)", ("named", "bergtal", "holtkamp")), ("Anna Holtkamp Univ.", ("named", None, "holtkamp")),
    ],
)
def test_reading(name, want):
    got = n.parse(name)
    assert (got["kind"], got["place"], got["patron"]) == want


@pytest.mark.parametrize("name", [None, "", " ", "?", "n/a", "unknown", "see notes", "k. A.", "--", "TBA", "not specified"])
def test_placeholders(name):
    assert n.parse(name) is None


def test_components_equal_union_find(spark):
    draw = random.Random(2)
    edges = [(str(draw.randrange(300)), str(draw.randrange(300))) for _ in range(220)] + [(f"c{i}", f"c{i + 1}") for i in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in n.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    for x in parent:
        assert got.get(x, x) == find(x)


def test_linking(spark):
    same = [
        ["Technical University of Bergtal", "TU Bergtal", "Begrtal Tech", "TU BERGT.", " Technische Universitaet Bergtal"],
        ["University of Bergtal", "Uni Bergtal", "Université de Bergtal", "Bergtal, University of / Bergtal"],
        ["Anna Holtkamp University of Wendlau", "AHU Wendlau", "A. Holtkamp Univ. Wendlau", "Holtkamp Uni", "Holtkapm University Wendlau"],
        ["University of Wendlau", "Universität Wendlau"],
        ["Moorbrück UAS", "FH Moorbrueck", "Fachhochschule Moorbruck - official"],
    ]
    rows = [(x,) for g in same for x in g] + [(None,), ("unknown",), ("",), ("TU Bergtal",)]
    got = {r.name: r.entity for r in n.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert set(got) == {x for g in same for x in g}
    assert [len({got[x] for x in g}) for g in same] == [1] * len(same)
    assert len(set(got.values())) == len(same)
    pairs = n.name_pairs(n.link_names(spark.createDataFrame(rows, "name string"))).collect()
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in same) and all(r.name_a < r.name_b for r in pairs)
    assert n.link_names(spark.createDataFrame([], "name string")).count() == 0


def test_nicknames_and_initials_choose_between_namesakes(spark):
    rows = ["William Holtkamp University of Bergtal", "Holtkamp University Bergtal", "Anna Holtkamp University of Wendlau", "Bill Holtkamp Univ.", "A. Holtkamp Univ.", "WHU Bergtal", "Karl Drossen University of Bergtal", "KDU Bergtal"]
    got = {r.name: r.entity for r in n.link_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    assert got["Bill Holtkamp Univ."] == got["William Holtkamp University of Bergtal"] == got["WHU Bergtal"] == got["Holtkamp University Bergtal"]
    assert got["A. Holtkamp Univ."] == got["Anna Holtkamp University of Wendlau"] != got["WHU Bergtal"]
    assert got["KDU Bergtal"] == got["Karl Drossen University of Bergtal"] != got["WHU Bergtal"]


def test_distances():
    assert n.edits("abcd", "abdc") == 1 and n.edits("", "ab") == 2 and n.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-3) and n.jaro_winkler("a", "") == 0


WORDS = [("heidelberg", 40), ("heidelbrg", 2), ("heidelbreg", 3), ("marburg", 30), ("maburg", 1), ("warburg", 28), ("tuebing", 3)]


def clusters(spark, rows):
    df = spark.createDataFrame([("place|univ", w, w == "tuebing", u) for w, u in rows] + [("place|univ", "tuebingen", False, rows[0][1])], "field string, token string, is_cut boolean, uses bigint")
    out = {}
    for r in n.spelling_clusters(df).collect():
        out.setdefault(r.cluster, set()).add(r.token)
    return sorted(map(sorted, out.values()))


def test_links_do_not_change_when_all_counts_grow(spark):
    want = [["heidelberg", "heidelbreg", "heidelbrg"], ["maburg", "marburg"], ["tuebing", "tuebingen"], ["warburg"]]
    for times in (1, 5, 500):
        assert clusters(spark, [(w, u * times) for w, u in WORDS]) == want


def test_large_blocks_are_split_without_loss(spark, monkeypatch):
    want = clusters(spark, WORDS)
    monkeypatch.setattr(n, "BLOCK", 1)
    assert clusters(spark, WORDS) == want


def test_finer_codes_meet_within_two_edits():
    draw = random.Random(3)
    for _ in range(400):
        a = "".join(draw.choice("abcde") for _ in range(draw.randrange(7, 12)))
        b = list(a)
        for _ in range(draw.randrange(1, 3)):
            i = draw.randrange(len(b))
            b[i : i + 1] = draw.choice([[], [draw.choice("abcde")], [b[i], draw.choice("abcde")]])
        b = "".join(b)
        if len(b) >= 7 and n.edits(a, b) <= 2:
            assert set(n.finer_codes(a, False)) & set(n.finer_codes(b, False)), (a, b)


def test_pairs_of_a_large_entity(spark, monkeypatch):
    monkeypatch.setattr(n, "PAIRED_AT_ONCE", 7)
    linked = spark.createDataFrame([(f"n{i}", "e") for i in range(60)] + [("x", "f"), ("y", "f"), ("z", "g")], "name string, entity string")
    got = {tuple(r) for r in n.name_pairs(linked).collect()}
    names = sorted(f"n{i}" for i in range(60))
    assert got == {(a, b) for a in names for b in names if a < b} | {("x", "y")}
