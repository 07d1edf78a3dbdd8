import random

import pytest

from tessera.llm.textstats import measure, not_prose, text_statistics

PROSE = "The library is open on every day of the week, and it is free for all of the students who come from the region. "
CASES = {
    None: None,
    "": None,
    " \n\t ": None,
    PROSE: None,
    PROSE * 3 + "\n- Maths\n- Physics\n": None,
    (PROSE * 3).replace(". ", ".\n").lower().replace(",", ""): None,
    "a short sentence that is not ended": None,
    "Bücher sind für die Studierenden in der Bibliothek frei, und sie ist am Abend offen.": None,
    "我们学校的图书馆每天都开放,所有学生都可以免费使用。图书馆里有很多关于历史和科学的书籍,学生们常常在那里学习到很晚。": None,
    "ห้องสมุดของมหาวิทยาลัยเปิดทุกวันและนักศึกษาทุกคนสามารถใช้ได้โดยไม่เสียค่าใช้จ่าย นักศึกษาจำนวนมากมักจะอ่านหนังสือที่นั่นจนดึก": None,
    "この大学の図書館は毎日開いていて、すべての学生が無料で利用できます。\n多くの学生は夜遅くまでそこで勉強しています。": None,
    "- 数学\n- 物理\n- 化学\n- 法律": "list",
    "姓名\t年龄\n王明\t23\n李华\t24": "table",
    "- Maths\n- Physics\n- Art History\n- Law": "list",
    "Maths\nPhysics\nArt History\nMedia Law\nForestry": "list",
    "Maths, Physics, Art History, Media Law, Forestry, Logistics": "list",
    "https://a.example/x\nhttps://a.example/y\nhttps://a.example/z": "list",
    "Room | Fee | Day\nA1 | 20 | 3\nB2 | 30 | 4": "table",
    "Room\tFee\nA1\t20\nB2\t30": "table",
    "Room  Fee   Day\nA1    20    3\nB2    30    4": "table",
    '"Room","Fee"\n"A1","20"\n"B2","30"\n"C3","40"': "table",
    "=====\n#####\n~~~~~~~": "junk",
    "var a=function(e){return e.id(1)||{}};\nvar b=function(e){return e.id(2)||{}};": "junk",
    "click here " * 40: "junk",
    "Error 500\n" * 20: "junk",
    "qzxkw vbnrt plkjh gfdsw rtzpl mnbvc xsdfg hjklw qwrtz": "junk",
    "aG9sYSBtdW5kbyBkZSBsYXMgY29zYXMgcXVlIG5vIHNvbiBjb3Nhcw0KYWJjZGVmZ2hp": "junk",
}


_draw = random.Random(4)
_words = ["".join(_draw.choice(["ba", "re", "ti", "lo", "mu", "sen", "kor", "dal"]) for _ in range(_draw.randrange(1, 4))) for _ in range(600)]
LONG = " ".join(" ".join(_draw.choice(["the", "of", "and", "is", "for"]) if k % 3 == 0 else _draw.choice(_words) for k in range(14)) + "." for _ in range(30_000))


@pytest.mark.parametrize("text,kind", list(CASES.items()))
def test_kinds(text, kind):
    assert measure(text)["kind"] == kind


def test_repetition_statistics():
    got = measure("one two three four\none two three four\n\nfive")
    assert got["duplicate_line_share"] == pytest.approx(18 / 40)
    assert got["top_2gram_share"] == pytest.approx(2 * 8 / sum(map(len, "one two three four one two three four five".split())), abs=0.2)
    assert measure("a\n\na\n\nb")["duplicate_paragraph_share"] == pytest.approx(1 / 3)
    got = measure("Hi there.\nNo")
    assert (got["n_words"], got["n_lines"], got["punctuated_line_share"]) == (3, 2, 0.5)
    assert got["mean_word_length"] == pytest.approx(3.0) and got["symbol_ratio"] == pytest.approx(1 / 10)


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(99, LONG, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert {(r.doc_id, r.kind) for r in not_prose(docs).collect()} == {(i, k) for i, (t, k) in enumerate(CASES.items()) if k}
    assert text_statistics(docs).count() == len(rows)
    assert text_statistics(docs.limit(0)).count() == 0
