"""Joins that hold when one key owns a large part of the rows.

Heavy hitters are found with one partially aggregated count.  A piece is the part of a key
that one reducer gets: 1/256 of the rows, at most ``ROWS_A_PIECE``.  A key larger than a piece
is heavy and is cut into as many pieces as its own count asks for, so no reducer grows with
the data.  At most ``MOST_HEAVY`` keys, the largest, reach the driver; any key beyond these is
smaller than 1/``MOST_HEAVY`` of the rows and left to the skew handling of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAVY_SHARE, ROWS_A_PIECE, MOST_HEAVY = 256, 500_000, 4096


def heavy_keys(df: DataFrame, key: str, floor: int = 2000, count: str | None = None) -> list[tuple]:
    """(key, pieces) of the keys with more rows than a piece.  ``count``: a column of counts to add up instead of rows."""
    counts = df.groupBy(key).count() if count is None else df.groupBy(key).agg(F.sum(count).alias("count"))
    # a bounded list: the largest keys are all that can matter
    top = counts.filter((F.col("count") > floor) & F.col(key).isNotNull()).orderBy(F.desc("count"), key).limit(MOST_HEAVY).collect()
    if not top:
        return []
    total = df.count() if count is None else df.agg(F.sum(count)).collect()[0][0]
    piece = max(floor, min(ROWS_A_PIECE, total // HEAVY_SHARE))
    return [(r[0], -(-r[1] // piece)) for r in top if r[1] > piece]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: Column, how: str = "inner", heavy: list[tuple] | None = None) -> DataFrame:
    """Join on ``key``; the rows of a heavy key on the left are spread over its pieces.

    ``right`` should hold few rows a key (those of heavy keys are copied once a piece).
    ``spread_by`` is a deterministic column, so a retried task sends rows to the same place.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if heavy is None:
        heavy = heavy_keys(left, key)
    if not heavy:
        return left.join(right, key, how)
    pieces = F.broadcast(left.sparkSession.createDataFrame(heavy, left.select(F.col(key), F.lit(0).alias("_pieces")).schema))  # at most MOST_HEAVY rows
    lefts = left.join(pieces, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    rights = right.join(pieces, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return lefts.join(rights, [key, "_salt"], how).drop("_salt")
