"""Mixing sources to target weights by entropy balancing.

Every document of a source starts at a base rate (one copy, or half the cap where the cap is one)
and is tilted exponentially by its tokens, r = R / (1 + exp(-(b + l * n))), the bounded form
of exp(l * n) that never passes the cap R.  One multiplier l for each mix and source solves the
convex dual of the token constraint; Newton steps, held in a bracket, run over the exact
histogram of (source, tokens), which is all the dual depends on.  The rates are then rounded
to copies by a threshold on a hash of the document, found by two histogram passes, so that
the tokens drawn meet the target to within about a document.  No step sorts or gathers a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.tokens import NAME, TOKENIZERS, count_tokens
from tessera.session import cut

#: Most rows of (mix, source) targets; they are configuration and held on the driver.
TARGET_BOUND = 10_000
BINS = 4096
TARGET = "mix_name string, source string, share double, target double, repeats int, total bigint"


def _targets(targets: DataFrame) -> list[tuple]:
    """Targets by mix and source: weights of repeated rows add up, the larger cap and total count.

    Null names, and weights or caps that are null or not above zero, take no part.
    """
    rows = (
        targets.filter("mix_name is not null and source is not null and target_weight > 0 and max_repeats > 0 and total_tokens > 0")
        .groupBy("mix_name", "source")
        .agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("r"), F.max("total_tokens").alias("t"))
        .limit(TARGET_BOUND + 1)
        .collect()
    )
    if len(rows) > TARGET_BOUND:
        raise ValueError(f"more than {TARGET_BOUND} rows of targets")
    total_weight: dict[str, float] = {}
    total_tokens: dict[str, int] = {}
    for r in sorted(rows):
        total_weight[r.mix_name] = total_weight.get(r.mix_name, 0.0) + r.w
        total_tokens[r.mix_name] = max(total_tokens.get(r.mix_name, 0), r.t)
    return [(r.mix_name, r.source, r.w / total_weight[r.mix_name], r.w / total_weight[r.mix_name] * total_tokens[r.mix_name], int(r.r), total_tokens[r.mix_name]) for r in sorted(rows)]


def base_logit(cap: int) -> float:
    base = min(1.0, cap / 2)
    return math.log(base / (cap - base)) if cap > base else 0.0


def _rate(cap, logit, multiplier, tokens):
    x = F.least(F.greatest(logit + multiplier * tokens, F.lit(-700.0)), F.lit(700.0))
    return F.when(multiplier.isNull(), cap.cast("double")).otherwise(cap / (1 + F.exp(-x)))


def solve(histogram: DataFrame, targets: list[tuple], tolerance: float = 1e-5, rounds: int = 200) -> dict[tuple[str, str], float | None]:
    """The multiplier of each (mix, source); None where even all copies do not reach the target.

    ``histogram``: source, n_tokens, docs.  The steps stay in a bracket that each of them narrows; a
    dual that is not solved within ``rounds`` is an error, never a result.
    """
    spark = histogram.sparkSession
    sizes = {r.source: (float(r.t), float(r.m)) for r in histogram.join(F.broadcast(spark.createDataFrame([(s,) for s in sorted({t[1] for t in targets})] or [("",)], "source string")), "source").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t"), (F.sum(F.col("n_tokens") * F.col("docs")) / F.sum("docs")).alias("m")).collect()}
    out: dict[tuple[str, str], float | None] = {}
    state: dict[tuple[str, str], list[float]] = {}  # multiplier, lower, upper
    want = {}
    for mix, source, _, target, cap, _ in targets:
        have, mean = sizes.get(source, (0.0, 1.0))
        if have * cap <= target:
            out[mix, source] = None
        else:
            state[mix, source] = [0.0, -math.inf, math.inf]
            want[mix, source] = (target, cap, mean)
    for _ in range(rounds):
        if not state:
            break
        table = spark.createDataFrame([(m, s, want[m, s][1], base_logit(want[m, s][1]), v[0]) for (m, s), v in state.items()], "mix_name string, source string, cap int, logit double, l double")
        r = _rate(F.col("cap"), F.col("logit"), F.col("l"), F.col("n_tokens"))
        weight = F.col("docs") * F.col("n_tokens")
        sums = (
            histogram.join(F.broadcast(table), "source")  # at most TARGET_BOUND rows
            .withColumn("r", r)
            .groupBy("mix_name", "source")
            .agg(F.sum(weight * F.col("r")).alias("g"), F.sum(weight * F.col("n_tokens") * F.col("r") * (1 - F.col("r") / F.col("cap"))).alias("h"))
            .collect()
        )
        for s in sums:
            key = (s.mix_name, s.source)
            l, low, high = state[key]
            target, _, mean = want[key]
            gap = s.g - target
            if abs(gap) <= max(0.5, tolerance * target):
                out[key] = l
                del state[key]
                continue
            low, high = (l, high) if gap < 0 else (low, l)
            step = l - gap / s.h if s.h > 0 else math.nan
            if not (low < step < high):
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else (max(1.0, 2 * abs(l) * mean) / mean) * (1 if gap < 0 else -1)
            state[key] = [step, low, high]
    if state:
        raise RuntimeError(f"no multiplier after {rounds} rounds for {sorted(state)[:5]}")
    return out


def draw(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of every mix.

    copies: mix_name, source, doc_id, n_tokens, copies (1 to max_repeats) of the documents drawn.
    shares: per mix and source the target and what was reached.  Documents without source or
    tokens are never drawn; a scarce source gives all its documents max_repeats times; a source
    without documents gives nothing and is reported with zeros.  Equal documents with ids of
    their own count each; repeated rows of an id count once.
    """
    spark = documents.sparkSession
    counts = cut(count_tokens(documents.select("doc_id", "source", "text").filter("source is not null and doc_id is not null"), ["doc_id", "source"], folder, name).filter("n_tokens > 0").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")))
    wanted = _targets(targets)
    histogram = cut(counts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    multipliers = solve(histogram, wanted)
    rows = [(m, s, share, target, cap, total, base_logit(cap), multipliers[m, s]) for m, s, share, target, cap, total in wanted]
    table = spark.createDataFrame(rows, TARGET + ", logit double, l double")
    rated = counts.join(F.broadcast(table), "source").withColumn("r", _rate(F.col("repeats"), F.col("logit"), F.col("l"), F.col("n_tokens")))
    u = (F.pmod(F.xxhash64("mix_name", "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rated = rated.withColumn("whole", F.least(F.floor("r"), F.col("repeats")).cast("int")).withColumn("w", F.when(F.col("whole") < F.col("repeats"), u - (F.col("r") - F.col("whole"))))
    rated = rated.select("mix_name", "source", "doc_id", "n_tokens", "target", "whole", "w")
    # the threshold on w: first the bin it lies in, then the place in that bin
    bin_of = lambda width, start: F.least(F.floor((F.col("w") - start) / width), F.lit(BINS - 1)).cast("int")
    fixed = rated.groupBy("mix_name", "source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("fixed"), F.max("target").alias("target"))
    threshold = _threshold(rated.filter("w is not null").withColumn("bin", bin_of(2.0 / BINS, -1.0)), fixed.select("mix_name", "source", (F.col("target") - F.col("fixed")).alias("room")))
    first = cut(threshold)
    inside = rated.join(F.broadcast(first.select("mix_name", "source", F.col("cut_bin").alias("b"), F.col("left_over").alias("room"))), ["mix_name", "source"])  # at most TARGET_BOUND rows
    start = -1.0 + F.col("b") * (2.0 / BINS)
    within = inside.filter(F.col("w").isNotNull() & (bin_of(2.0 / BINS, -1.0) == F.col("b"))).withColumn("bin", bin_of(2.0 / BINS / BINS, start))
    second = _threshold(within, first.select("mix_name", "source", F.col("left_over").alias("room")))
    cuts = cut(first.join(second.select("mix_name", "source", F.col("cut_bin").alias("fine"), F.col("left_over").alias("rest"), F.col("next_size").alias("next_size2")), ["mix_name", "source"], "left"))
    # the boundary itself is taken if that comes nearer to the target
    edge = -1.0 + F.col("cut_bin") * (2.0 / BINS) + (F.coalesce("fine", F.lit(0)) + F.when(F.col("rest") * 2 > F.col("next_size2"), 1).otherwise(0)) * (2.0 / BINS / BINS)
    placed = rated.join(F.broadcast(cuts.select("mix_name", "source", edge.alias("edge"))), ["mix_name", "source"], "left")
    copies = placed.withColumn("copies", F.col("whole") + F.when(F.col("w") < F.col("edge"), 1).otherwise(0)).filter("copies > 0")
    copies = copies.select("mix_name", "source", "doc_id", "n_tokens", "copies")
    reached = copies.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents_drawn"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_reached"))
    available = histogram.groupBy("source").agg(F.sum("docs").alias("documents_available"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens_available"))
    shares = (
        table.join(available, "source", "left").join(reached, ["mix_name", "source"], "left")
        .na.fill(0, ["documents_available", "tokens_available", "documents_drawn", "copies", "most_copies", "tokens_reached"])
    )
    by_mix = shares.groupBy("mix_name").agg(F.sum("tokens_reached").alias("mix_tokens"))
    shares = shares.join(by_mix, "mix_name").select(
        "mix_name", "source", F.col("share").alias("target_share"), F.round("target").cast("bigint").alias("target_tokens"), F.col("repeats").alias("max_repeats"),
        "documents_available", "tokens_available", "documents_drawn", "copies", "most_copies", "tokens_reached",
        (F.col("tokens_reached") / F.col("total")).alias("share_of_total"),
        F.when(F.col("mix_tokens") > 0, F.col("tokens_reached") / F.col("mix_tokens")).otherwise(0.0).alias("share_reached"),
    )
    return copies, shares


def _threshold(binned: DataFrame, room: DataFrame) -> DataFrame:
    """cut_bin, left_over, next_size: bins before cut_bin fit in the room, cut_bin with its size does not any more.

    A window over at most ``BINS`` rows for each mix and source.
    """
    from pyspark.sql import Window

    sizes = binned.groupBy("mix_name", "source", "bin").agg(F.sum("n_tokens").alias("size"))
    running = F.sum("size").over(Window.partitionBy("mix_name", "source").orderBy("bin"))
    crossed = sizes.withColumn("upto", running).join(F.broadcast(room), ["mix_name", "source"])  # at most TARGET_BOUND rows
    fits = F.col("upto") <= F.col("room")
    return crossed.groupBy("mix_name", "source").agg(
        F.coalesce(F.min(F.when(~fits, F.col("bin"))), F.max("bin") + 1).cast("int").alias("cut_bin"),
        (F.max("room") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("left_over"),
        F.coalesce(F.min(F.when(~fits, F.struct("bin", "size")))["size"], F.lit(0)).alias("next_size"),
    )
