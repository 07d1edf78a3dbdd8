import math
import os
import random

import pytest

from tessera.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabulary files")
DOC = "doc_id bigint, text string, source string, copies int"
MIX = "mix_name string, source string, target_weight double, max_repeats int, total_tokens bigint, n_tokens int"


def documents(spark):
    draw = random.Random(1)
    rows = [(i, "word " * draw.randrange(1, 60), "big" if i % 3 else "mid", 0) for i in range(900)]
    rows += [(1000 + i, "rare words here", "small", 0) for i in range(10)] + [(2000, None, "big", 0), (2001, "", "big", 0), (2002, "x", None, 0), (0, rows[0][1], "mid", 0)]
    return spark.createDataFrame(rows, DOC)


def test_shares_and_caps(spark):
    targets = [("m", "big", 3.0, 1, 10_000, 0), ("m", "mid", 1.0, 3, 10_000, 0), ("m", "small", 1.0, 4, 10_000, 0), ("m", "none", 1.0, 4, 10_000, 0), ("up", "mid", 1.0, 5, 30_000, 0), ("bad", None, 1.0, 1, 10, 0), ("bad", "big", None, 1, 10, 0), ("zero", "big", 0.0, 1, 10, 0)]
    copies, shares = mixing.draw(documents(spark), spark.createDataFrame(targets, MIX))
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert set(got) == {("m", "big"), ("m", "mid"), ("m", "small"), ("m", "none"), ("up", "mid")}
    for key, cap in ((("m", "big"), 1), (("m", "mid"), 3), (("up", "mid"), 5)):
        r = got[key]
        assert abs(r.tokens_reached - r.target_tokens) <= 80 and r.most_copies <= cap
    small = got["m", "small"]
    assert small.tokens_reached == 4 * small.tokens_available and small.documents_drawn == 10 and small.most_copies == 4
    assert got["m", "none"].tokens_reached == 0 and got["m", "none"].documents_available == 0
    assert sum(r.share_reached for k, r in got.items() if k[0] == "m") == pytest.approx(1.0)
    rows = copies.collect()
    assert len({(r.mix_name, r.source, r.doc_id) for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)
    again = mixing.draw(documents(spark), spark.createDataFrame(targets, MIX))[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_newton_equals_bisection(spark):
    hist = [("s", n, 1 + n % 4) for n in range(1, 200)]
    total = sum(n * k for _, n, k in hist)
    wanted = [("m", "s", 1.0, f * total, 2, 1) for f in (0.5,)] + [("k", "s", 1.0, 1.7 * total, 2, 1), ("l", "s", 1.0, 0.001 * total, 2, 1), ("n", "s", 1.0, 2.0 * total, 2, 1)]
    got = mixing.solve(spark.createDataFrame(hist, "source string, n_tokens bigint, docs bigint"), wanted)
    assert got["n", "s"] is None
    for mix, _, _, target, cap, _ in wanted[:3]:
        g = lambda l: sum(n * k * cap / (1 + math.exp(-max(-700, min(700, mixing.base_logit(cap) + l * n)))) for _, n, k in hist)  # noqa: B023, E731
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if g(mid) < target else (low, mid)
        assert g(got[mix, "s"]) == pytest.approx(target, abs=max(0.6, 2e-5 * target)) and got[mix, "s"] == pytest.approx(low, rel=0.02, abs=1e-3)


def test_empty(spark):
    docs, targets = documents(spark), spark.createDataFrame([("m", "big", 1.0, 1, 100, 0)], MIX)
    copies, shares = mixing.draw(docs.limit(0), targets)
    assert copies.count() == 0 and [r.tokens_reached for r in shares.collect()] == [0]
    copies, shares = mixing.draw(docs, targets.limit(0))
    assert copies.count() == 0 and shares.count() == 0
