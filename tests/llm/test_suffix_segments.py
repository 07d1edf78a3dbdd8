"""Parts of texts and appended batches over more buckets than one, against brute force."""

import random
import shutil
from pathlib import Path

from tessera.llm import suffixes


def words(draw, n):
    return "/".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(4, 9))) for _ in range(n))


def brute(asked, history, least):
    want = set()
    for text in history:  # each text alone
        record = f"\n{text}\n".encode()
        order, starts = suffixes.suffix_array(record), [0, len(record) - 1]
        want |= {(k, text) for k in asked if k and 0 in suffixes.covered(record, order, starts, k.encode(), least)}
    return want


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_appended_batches_and_near_duplicates(spark, tmp_path):
    draw = random.Random(5)
    texts = [words(draw, 8) for _ in range(60)]
    batches = [texts[:15], texts[15:30], texts[25:45], texts[45:]]
    asked = [t[:-4] + "zzzz" for t in texts[::2]] + ["new/" + t for t in texts[1::7]] + [t[:20] + "-" + t[21:] for t in texts[::5]] + texts[1::4] + ["", "a", "x" * 50_000]
    index = suffixes.Index(spark, str(tmp_path / "index"), 8)
    hits = wanted = 0
    for i, keys in enumerate(batches):
        index = index.append(frame(spark, keys))
        spans = {(r.start, r.batches) for r in index.segments().collect()}
        assert spans == {suffixes.segment_of(j, i + 1) for j in range(i + 1)}
        history = {k for b in batches[: i + 1] for k in b}
        got = {(r.key, r.match) for r in index.search(frame(spark, asked), 1.0).collect()}
        assert got == {(k, k) for k in asked if k in history}
        want = brute(asked, history, 0.8)
        got = {(r.key, r.match) for r in index.search(frame(spark, asked), 0.8).collect()}
        assert got <= want and {(k, m) for k, m in want if k == m} <= got
        hits, wanted = hits + len(got), wanted + len(want)
    assert wanted > 100 and hits >= 0.9 * wanted
    assert suffixes.Index(spark, str(tmp_path / "none"), 8).search(frame(spark, asked)).count() == 0


def test_a_batch_reads_its_own_buckets_and_rebuilds_nothing(spark, tmp_path):
    draw = random.Random(6)
    texts = [words(draw, 6) for _ in range(120)]
    index = suffixes.Index(spark, str(tmp_path), 64).append(frame(spark, texts[:40])).append(frame(spark, texts[40:80]))
    asked = frame(spark, [texts[7], texts[50]])
    shelves = {a % 64 for t in (texts[7], texts[50]) for a in suffixes.anchors_of([t.encode()])[0]}
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    for p in before:  # what the batch does not ask for is gone
        if int(p.parent.name.removeprefix("shelf=")) not in shelves:
            shutil.rmtree(p.parent)
    assert {r.key for r in index.search(asked, 0.8).collect()} == {texts[7], texts[50]}
    left = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    for folder in {p.parent.parent for p in left}:  # the third batch joins no older segment: none is there to be read
        folder.rename(folder.with_name("_" + folder.name))
    grown = index.append(frame(spark, texts[80:]))
    for folder in [p for p in Path(tmp_path).iterdir() if p.name.startswith("_span")]:
        folder.rename(folder.with_name(folder.name[1:]))
    assert all(p.stat().st_mtime_ns == t for p, t in left.items())
    assert {r.key for r in grown.search(frame(spark, [texts[7], texts[100]]), 1.0).collect()} == {texts[7], texts[100]}


def test_large_buckets_are_cut_and_asked_whole(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_CHARS", 2000)
    monkeypatch.setattr(suffixes, "ASKED_AT_ONCE", 20)
    draw = random.Random(7)
    head = "one.example/with/a/common/beginning/of/all/"
    texts = [head + words(draw, 3) for _ in range(150)]
    segments = suffixes.build(spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "key string, batch int"), 2)
    assert segments.filter("pieces > 1").count() > 3
    got = {(r.key, r.match) for r in suffixes.search(segments, frame(spark, texts[::2]), 2, 1.0).collect()}
    assert got == {(t, t) for t in texts[::2]}


def test_anchors_of_a_common_passage():
    draw = random.Random(8)
    for _ in range(200):
        common = "".join(draw.choice("ab/") for _ in range(suffixes.GRAM + suffixes.WINDOW - 1))
        a, b = words(draw, 3) + common, common + words(draw, 2)
        one, two = suffixes.anchors_of([a.encode(), b.encode()], 10**6)
        assert set(one) & set(two) and one == sorted(one, key=lambda v: v & (2**64 - 1))
    assert suffixes.anchors_of([b"", b"ab", b"ab", b"abc"], 3)[1] == suffixes.anchors_of([b"ab"], 3)[0]


def test_every_near_duplicate_is_found(spark):
    draw = random.Random(9)
    history, asked = set(), set()
    for _ in range(150):
        text = words(draw, draw.randrange(1, 9)) + draw.choice(["", "/a\nb", "/\u00e4"])
        history |= {text, text + "/x", text[: len(text) * 9 // 10]}  # the longest match of one is not that of the others
        cut = draw.randrange(len(text))
        asked |= {text[:cut] + "-" + text[cut + 1 :], text[cut:] + text[:cut], text[2:] + "zz", text[: len(text) // 2] + "--" + text[len(text) // 2 :]}
    asked |= {"", "a", "ab", *draw.sample(sorted(history), 20)}
    segments = suffixes.build(spark.createDataFrame([(t, i % 3) for i, t in enumerate(sorted(history))], "key string, batch int"), 64)
    want = {(k, t): share for k in asked if k for t in history if (share := suffixes.coverage(*(b"\n" + suffixes._bytes(x) + b"\n" for x in (k, t)), 0.8))}
    got = {(r.key, r.match): r.coverage for r in suffixes.search(segments, frame(spark, asked), 64, 0.8).collect()}
    assert got == want and len(want) > 800
    assert sum(len(k) < 34 for k, _ in want) > 100 and any("\n" in k for k, _ in want)


def test_coverage_of_one_record():
    draw = random.Random(10)
    for _ in range(2000):
        pattern, record = ("\n" + "".join(draw.choice("abc") for _ in range(draw.randrange(1, 14))) + "\n" for _ in range(2))
        least = draw.choice([0.3, 0.5, 0.8, 1.0])
        long, need = suffixes.bounds(len(pattern), least)
        inside = {j for i in range(len(pattern) - long + 1) if pattern[i : i + long] in record for j in range(i, i + long)}
        want = len(inside) / len(pattern) if len(inside) >= need else 0.0
        assert suffixes.coverage(pattern.encode(), record.encode(), least) == want
        text = record.encode()
        assert suffixes.covered(text, suffixes.suffix_array(text), [0, len(text) - 1], pattern[1:-1].encode(), least).get(0, 0.0) == want
