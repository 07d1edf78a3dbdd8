"""New batches against all history by suffix arrays.

History is kept in immutable segments: the distinct texts of some batches, concatenated,
with their suffix array.  Batches are merged like the digits of a binary counter, so n
batches stand in at most log2(n)+1 segments a bucket.  A text stands in the buckets of all
its anchors, grams picked by content alone (the least of every window), with the suffixes at
these anchors in order; texts that share a passage meet at the anchor in it.  A new batch asks
only a few of its own anchors, so chosen that any text which covers a key to the share has one
of them (``probes``); there binary search finds the candidates, and the lengths of the long
matches are added up for each.  Whole texts stand once more by their hashes, with all their
suffixes: keys too short to have such anchors are looked up there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.addresses import address
from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import scratch, stored

#: Characters of a piece of a bucket, queries of one task, buckets of a text as a rule, folders of an index.
BUCKET_CHARS, ASKED_AT_ONCE, COPIES, SHELVES = 1 << 20, 20_000, 16, 256
#: Length of an anchor in bytes (the grams are read as 64-bit numbers), grams of a window, bytes of a passage that has an anchor for certain.
GRAM, WINDOW = 8, 8
PASSAGE = GRAM + WINDOW - 1
#: Bytes by which suffixes at anchors are ordered, cases told apart for a key, common passages that are known.
DEPTH, CASES, MOST_COMMON = 64, 32, 1 << 16
SEGMENTS = "bucket int, piece int, pieces int, start int, batches int, text binary, suffixes binary"


def _grams(text, at=None):
    """The eight bytes from every place (or those of ``at``) as numbers whose order is that of the bytes; zeros behind the end."""
    import numpy as np

    codes = np.frombuffer(text, dtype=np.uint8)
    padded = np.concatenate((codes, np.zeros(GRAM, dtype=np.uint8)))
    at = np.arange(len(codes)) if at is None else at
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | padded[at + j]
    return out


def leasts(texts: list[bytes]) -> list[tuple]:
    """For each text the hashes of the least grams of its windows and where they stand, two arrays with a place for each window."""
    import numpy as np

    out: list[tuple] = []
    begin = 0
    while begin < len(texts):  # about 4 MB together
        end, size = begin, 0
        while end < len(texts) and (size < 1 << 22 or end == begin):
            size += len(texts[end]) + GRAM
            end += 1
        part = texts[begin:end]
        gap = b"\0" * GRAM
        hashed = _grams(gap.join(part) + gap)
        with np.errstate(over="ignore"):
            for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
                hashed ^= hashed >> np.uint64(shift)
                hashed *= np.uint64(factor)
        hashed ^= hashed >> np.uint64(32)
        grams = np.array([max(1, len(t) - GRAM + 1) for t in part], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum([len(t) + GRAM for t in part])[:-1])).astype(np.int64)
        owner = np.repeat(np.arange(len(part)), grams)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + starts[owner]
        valid = np.full(len(hashed) + WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
        valid[place] = hashed[place]
        least, at = valid[: len(hashed)].copy(), np.zeros(len(hashed), dtype=np.int64)
        for j in range(1, WINDOW):  # of equal grams the first
            less = valid[j : j + len(hashed)] < least
            least[less], at[less] = valid[j : j + len(hashed)][less], j
        whole = place - starts[owner] <= np.maximum(grams[owner] - WINDOW, 0)  # windows within the text
        owner, place = owner[whole], place[whole]
        ends = np.cumsum(np.bincount(owner, minlength=len(part)))[:-1]
        out += zip(np.split(least[place].view(np.int64), ends), np.split(place + at[place] - starts[owner], ends))
        begin = end
    return out


def anchors_of(texts: list[bytes], most: int | None = None) -> list[list[int]]:
    """For each text the hashes of the least grams of its windows, in order; the ``most`` smallest if given.

    Two texts with a common passage of ``PASSAGE`` bytes have a least one in common, at the same place of the passage.
    """
    return [sorted(set(values.tolist()), key=lambda v: v & (2**64 - 1))[:most] for values, _ in leasts(texts)]


def _windows(text: bytes):
    """Hashes of the windows of ``PASSAGE`` bytes."""
    import numpy as np

    grams = _grams(text)
    more = len(text) - PASSAGE + 1
    if more <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        return (grams[:more] * np.uint64(0x9E3779B97F4A7C15) ^ grams[WINDOW - 1 : WINDOW - 1 + more] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _passages(texts):
    import pandas as pd

    return pd.Series([_windows(_bytes(t)) for t in texts])


def _bytes(text: str) -> bytes:
    """A text as it stands in a segment: line breaks, which part the texts there, as a byte that no text has."""
    return text.encode("utf-8", "surrogatepass").replace(b"\n", b"\xfe")


def _text(raw: bytes) -> str:
    return raw.replace(b"\xfe", b"\n").decode("utf-8", "surrogatepass")


def suffix_array(text: bytes):
    """Start positions of the suffixes in order: first by eight bytes, then by doubling."""
    import numpy as np

    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int32)
    # bytes are raised by one, in nine bits, so that the end of the text goes before any byte
    codes = np.concatenate((np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(7, dtype=np.uint64)))
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | codes[j : j + n]
    k = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if fresh[-1] == n - 1:
            return order.astype(np.int32)
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = fresh.astype(np.uint64)
        second = np.zeros(n, dtype=np.uint64)
        second[: max(0, n - k)] = rank[k:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + second
        k *= 2


def longest_match(text: bytes, suffixes, pattern: bytes) -> tuple[int, int, int]:
    """Length of the longest prefix of ``pattern`` in ``text``, and its range in the suffix array."""
    lo, hi = 0, len(suffixes)
    m = len(pattern)
    while lo < hi:
        mid = (lo + hi) // 2
        at = int(suffixes[mid])
        if text[at : at + m] < pattern:
            lo = mid + 1
        else:
            hi = mid
    best = 0
    for i in (lo - 1, lo):
        if 0 <= i < len(suffixes):
            at = int(suffixes[i])
            got = text[at : at + m]
            n = 0
            if got == pattern:
                n = m
            else:
                a, b = 0, min(len(got), m)
                while a < b:  # the common length, by halves
                    c = (a + b + 1) // 2
                    if got[:c] == pattern[:c]:
                        a = c
                    else:
                        b = c - 1
                n = a
            best = max(best, n)
    if not best:
        return 0, 0, 0
    want = pattern[:best]
    lo, hi = 0, len(suffixes)
    while lo < hi:
        mid = (lo + hi) // 2
        at = int(suffixes[mid])
        if text[at : at + best] < want:
            lo = mid + 1
        else:
            hi = mid
    first, hi = lo, len(suffixes)
    while lo < hi:
        mid = (lo + hi) // 2
        at = int(suffixes[mid])
        if text[at : at + best] <= want:
            lo = mid + 1
        else:
            hi = mid
    return best, first, lo


def bounds(whole: int, least: float) -> tuple[int, int]:
    """Length of a long match in a text of ``whole`` bytes, half of the share or all of a whole one, and the bytes that make the share."""
    need = math.ceil(least * whole - 1e-9)
    return (whole if least >= 1 else max(1, math.ceil(least * whole / 2 - 1e-9))), need


def covered(text: bytes, suffixes, starts, key: bytes, least: float) -> dict[int, float]:
    """Record number to the share of ``key`` that its long matches cover, where it is ``least`` or more.

    A match is long if it is at least half of that share.  Each record counts by itself, whatever others match.
    """
    import numpy as np

    pattern = b"\n" + key + b"\n"
    long, need = bounds(len(pattern), least)
    found: dict[int, tuple[int, int]] = {}
    if long > len(text):
        return {}
    for i in range(len(pattern) - long + 1):  # the union of long matches is that of their windows of the least length
        n, first, last = longest_match(text, suffixes, pattern[i : i + long])
        if n < long:
            continue
        for record in np.unique(np.searchsorted(starts, suffixes[first:last], side="right") - 1).tolist():
            got, end = found.get(record, (0, 0))
            found[record] = got + i + long - max(i, end), i + long
    return {r: got / len(pattern) for r, (got, _) in found.items() if got >= need}


def coverage(pattern: bytes, record: bytes, least: float) -> float:
    """What ``covered`` gives of one record, both with their line breaks; 0 where the share is not reached."""
    whole = len(pattern)
    long, need = bounds(whole, least)
    # whatever is missing, these bytes lie in the first and in the last long match
    if pattern[whole - need : long] not in record or pattern[whole - long : need] not in record:
        return 0.0
    got = end = i = 0
    while i + long <= whole and got + whole - max(i, end) >= need:
        if pattern[i : i + long] not in record:
            i += 1
            continue
        if not got and pattern[whole - long : need + i] not in record:
            return 0.0  # what is missing before leaves less to miss behind
        a, b = i + long, whole
        while a < b:  # the end of the match, by halves
            c = (a + b + 1) // 2
            if pattern[i:c] in record:
                a = c
            else:
                b = c - 1
        got, end, i = got + a - max(i, end), a, a - long + 1
    return got / whole if got >= need else 0.0


def probes(key: bytes, values: list[int], places: list[int], windows: list[int], least: float, often: dict[int, int]) -> list[tuple[int, int, int, int]] | None:
    """(anchor, its place, first, end): any text that covers ``key`` to the share has key[first:end] of one of them, with this anchor.

    Let the covered part begin at byte x.  Then at most what the share leaves less x is missing at the end, the text has
    the long match that begins at x, and of the one that covers the end all that is certain whatever its place.  For each x
    an anchor in the rarer of the two is taken, by what ``often`` tells of ``windows``.  None if the key is too short to have one for every x.
    """
    if least >= 1:  # equal texts share all anchors
        at = min(range(len(values)), key=lambda w: values[w] & (2**64 - 1))
        return [(values[at], places[at], 0, len(key))]
    n, whole = len(key), len(key) + 2
    long, need = bounds(whole, least)
    left = whole - need
    step = left // CASES + 1  # neighbouring x of long keys together
    rare = [often.get(v, 0) for v in windows]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for x in range(0, left + 1, step):
        first, end = max(min(x + step - 1, left) - 1, 0), min(x + long - 1, n)
        other, last = max(whole - long - 1, 0), min(need + x - 1, n)
        one, two = min(rare[first : max(first, end - PASSAGE + 1)], default=None), min(rare[other : max(other, last - PASSAGE + 1)], default=None)
        if one is None and two is None:
            return None
        if one is None or two is not None and two < one:
            first, end = other, last
        w = min(range(first, end - PASSAGE + 1), key=lambda w: ((values[w], places[w]) not in out, places[w]))
        group = values[w], places[w]
        a, b = out.get(group, (0, n))
        out[group] = max(a, first), min(b, end)
    return [(v, at, a, b) for (v, at), (a, b) in out.items()]


def segment_of(i: int, n: int) -> tuple[int, int]:
    """First batch and number of batches of the segment that batch i of n stands in."""
    start = 0
    for bit in reversed(range(n.bit_length())):
        size = 1 << bit
        if n & size:
            if i < start + size:
                return start, size
            start += size
    raise ValueError("batch out of range")


def buckets_for(keys: DataFrame) -> int:
    """A power of two, so that a bucket holds about ``BUCKET_CHARS`` characters."""
    total = keys.agg(F.sum(F.octet_length("key"))).collect()[0][0] or 0
    return 1 << max(0, (int(total) * COPIES // BUCKET_CHARS)).bit_length()


def _plain(buckets: int) -> int:
    """Number of buckets for whole texts by their hashes, numbered down from -1: too short keys ask all of these."""
    return max(1, buckets // COPIES)


def _placed(keys: DataFrame, buckets: int) -> DataFrame:
    """``keys`` (key and other columns) in the buckets of all their anchors, with the anchors' places, and in one of the whole texts."""
    plain = _plain(buckets)

    def one(frames):
        import zlib

        for frame in frames:
            texts = [_bytes(k) for k in frame["key"]]
            row, bucket, at = [], [], []
            for i, (values, places) in enumerate(leasts(texts)):
                own: dict[int, set[int]] = {-1 - zlib.crc32(texts[i]) % plain: set()}
                for v, p in set(zip(values.tolist(), places.tolist())):
                    own.setdefault(v % buckets, set()).add(p)
                row += [i] * len(own)
                bucket += own
                at += [sorted(p) for p in own.values()]
            yield frame.iloc[row].assign(bucket=bucket, at=at)

    schema = T.StructType([*keys.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    return keys.filter("key <> ''").mapInPandas(one, schema)


def _asked(keys: DataFrame, buckets: int, least: float) -> DataFrame:
    """key, bucket, at, lo, hi: the ``probes`` of each key; too short keys ask the whole texts, with nulls."""
    keys = keys.select("key").filter("key <> ''").distinct()
    often: dict[int, int] = {}
    if least < 1:
        keys = stored(keys)
        counts = keys.select(F.explode(_passages("key")).alias("passage")).groupBy("passage").count()
        # a bounded list that only saves work: what is found does not hang on what is asked
        often = dict(map(tuple, counts.filter("count > 8").orderBy(F.desc("count"), "passage").limit(MOST_COMMON).collect()))
    plain = _plain(buckets)

    def one(frames):
        import pandas as pd

        for frame in frames:
            out: list[tuple] = []
            for key, (values, places) in zip(frame["key"], leasts([_bytes(k) for k in frame["key"]])):
                chosen = probes(_bytes(key), values.tolist(), places.tolist(), _windows(_bytes(key)).tolist(), least, often)
                if chosen is None:
                    out += [(key, -1 - j, -1, -1, -1) for j in range(plain)]
                else:
                    out += [(key, v % buckets, at, lo, hi) for v, at, lo, hi in chosen]
            yield pd.DataFrame(out, columns=["key", "bucket", "at", "lo", "hi"])

    return stored(keys.mapInPandas(one, "key string, bucket int, at int, lo int, hi int"))


def _arrays(placed: DataFrame) -> DataFrame:
    """Rows of ``SEGMENTS`` of ``placed``: key, bucket, at, start, batches.  A large bucket is cut into pieces by the keys' hashes.

    Buckets of anchors have the suffixes at these anchors in their arrays, by their first ``DEPTH`` bytes, those of whole texts all.
    """

    def one(of, part):
        import numpy as np
        import pandas as pd

        ats = {_bytes(k): at for k, at in zip(part["key"], part["at"])}
        keys = sorted(ats)
        text = b"\n" + b"\n".join(keys) + b"\n"
        if of[0] < 0:
            suffixes = suffix_array(text)
        else:
            begins = np.cumsum([1] + [len(k) + 1 for k in keys[:-1]]).tolist()
            suffixes = np.array(sorted((b + int(a) for b, k in zip(begins, keys) for a in ats[k]), key=lambda p: text[p : p + DEPTH]))
        return pd.DataFrame([{"bucket": of[0], "piece": of[3], "pieces": int(part["pieces"].iloc[0]), "start": of[1], "batches": of[2], "text": text, "suffixes": suffixes.astype("<i4").tobytes()}])

    sizes = placed.groupBy("bucket").agg(F.sum(F.octet_length("key") + 1).alias("chars"))
    heavy = heavy_keys(sizes, "bucket", floor=BUCKET_CHARS, count="chars")
    pieces = F.lit(1)
    if heavy:
        large = placed.sparkSession.createDataFrame(heavy, "bucket int, pieces int")
        placed = placed.join(F.broadcast(large), "bucket", "left")  # a bounded list
        pieces = F.coalesce("pieces", F.lit(1))
    placed = placed.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    return placed.select("bucket", "piece", "pieces", "start", "batches", "key", "at").groupBy("bucket", "start", "batches", "piece").applyInPandas(one, SEGMENTS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _texts(segments):
    import pandas as pd

    return pd.Series([[_text(t) for t in text[1:-1].split(b"\n")] for text in segments])


def build(keys: DataFrame, buckets: int) -> DataFrame:
    """Segments of ``keys`` (key string, batch int from 0): one row a bucket, segment and piece."""
    last = keys.agg(F.max("batch")).collect()[0][0]
    n = (last if last is not None else -1) + 1
    spans = [segment_of(i, n) for i in range(n)]
    pick = lambda at: F.element_at(F.array(*[F.lit(s[at]) for s in spans]), F.col("batch") + 1).cast("int") if spans else F.lit(0)
    return _arrays(stored(_placed(keys.select("key", pick(0).alias("start"), pick(1).alias("batches")).distinct(), buckets)))


class Index:
    """History as a folder of segments, by span of batches and shelf of buckets; nothing written is changed.

    ``batches`` is all the state there is: the live segments follow from it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, batches: int = 0):
        self.spark, self.path, self.buckets, self.batches = spark, path, buckets, batches

    @classmethod
    def of(cls, keys: DataFrame, path: str) -> "Index":
        """A first index of ``keys`` (key string, batch int from 0)."""
        last = keys.agg(F.max("batch")).collect()[0][0]
        made = cls(keys.sparkSession, path, buckets_for(keys), (last if last is not None else -1) + 1)
        made._write(build(keys, made.buckets))
        return made

    def _write(self, segments: DataFrame) -> None:
        span = F.concat_ws("-", "start", "batches")
        segments.withColumn("span", span).withColumn("shelf", F.pmod("bucket", F.lit(SHELVES))).write.mode("append").partitionBy("span", "shelf").parquet(self.path)

    def segments(self, shelves: list[int] | None = None) -> DataFrame:
        """The live segments, of some shelves only."""
        live = [f"{s}-{z}" for s, z in sorted({segment_of(i, self.batches) for i in range(self.batches)})]
        schema = T.StructType([*T._parse_datatype_string(SEGMENTS).fields, T.StructField("span", T.StringType()), T.StructField("shelf", T.IntegerType())])
        if not live:
            return self.spark.createDataFrame([], schema).select("bucket", "piece", "pieces", "start", "batches", "text", "suffixes")
        kept = self.spark.read.schema(schema).parquet(self.path).filter(F.col("span").isin(live))
        kept = kept if shelves is None else kept.filter(F.col("shelf").isin(shelves))
        return kept.select("bucket", "piece", "pieces", "start", "batches", "text", "suffixes")

    def append(self, keys: DataFrame) -> "Index":
        """The index with ``keys`` (key string) as its next batch.

        Segments that the binary counter joins are merged with the batch into a new one; the
        others are neither read nor written.
        """
        start, size = segment_of(self.batches, self.batches + 1)
        fresh = keys.select("key")
        if size > 1:
            old = self.segments().filter((F.col("start") >= start) & (F.col("bucket") < 0))
            fresh = fresh.unionByName(old.select(F.explode(_texts("text")).alias("key")))
        grown = Index(self.spark, self.path, self.buckets, self.batches + 1)
        grown._write(_arrays(stored(_placed(fresh.distinct().select("key", F.lit(start).alias("start"), F.lit(size).alias("batches")), self.buckets))))
        return grown

    def search(self, keys: DataFrame, least: float = 1.0) -> DataFrame:
        """``search`` over the live segments of the asked shelves."""
        asked = _asked(keys, self.buckets, least)
        shelves = [r[0] for r in asked.select(F.pmod("bucket", F.lit(SHELVES))).distinct().collect()]  # at most SHELVES numbers
        return _searched(self.segments(sorted(shelves)), asked, least)


def search(segments: DataFrame, keys: DataFrame, buckets: int, least: float = 1.0) -> DataFrame:
    """key, match, coverage of every key and text of the history that covers it to the share: all of them (see ``probes``)."""
    return _searched(segments, _asked(keys, buckets, least), least)


def _searched(segments: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    def one(left, right):
        from bisect import bisect_left, bisect_right

        import numpy as np
        import pandas as pd

        out: dict[str, list] = {"key": [], "match": [], "coverage": []}
        questions: dict[bytes, list] = {}
        for key, *probe in zip(right["key"], right["at"].tolist(), right["lo"].tolist(), right["hi"].tolist()):
            questions.setdefault(_bytes(key), []).append(probe)
        for text, raw in zip(left["text"], left["suffixes"]) if questions else ():
            suffixes = np.frombuffer(raw, dtype="<i4")
            starts = np.nonzero(np.frombuffer(text, dtype=np.uint8) == 10)[0]
            begins, order, grams = starts.tolist(), suffixes.tolist(), None
            records = (np.searchsorted(starts, suffixes, side="right") - 1).tolist()
            for key, asks in questions.items():
                pattern = b"\n" + key + b"\n"
                if asks[0][0] < 0:
                    found = covered(text, suffixes, starts, key, least)
                else:
                    seen = set()
                    for at, lo, hi in asks:
                        near, passage, before = key[at : min(hi, at + DEPTH)], key[lo:hi], at - lo
                        cut = lambda p, n=len(near): text[p : p + n]
                        first = bisect_left(order, near, key=cut)
                        last = bisect_right(order, near, lo=first, key=cut)
                        hits = range(first, last)
                        if last - first > 16:  # many: by the first grams of the passage at once
                            grams = _grams(text) if grams is None else grams
                            head = _grams(passage[:GRAM])[0]
                            begin = suffixes[first:last] - before
                            hits = np.flatnonzero((begin > 0) & (grams[begin] == head)) + first
                        seen.update(records[j] for j in hits if records[j] not in seen and text.startswith(passage, order[j] - before))
                    found = {r: share for r in seen if (share := coverage(pattern, text[begins[r] : begins[r + 1] + 1], least))}
                for record, share in found.items():
                    if begins[record] + 1 < begins[record + 1]:
                        out["key"].append(_text(key))
                        out["match"].append(_text(text[begins[record] + 1 : begins[record + 1]]))
                        out["coverage"].append(share)
        return pd.DataFrame(out) if out["key"] else pd.DataFrame()  # empty lists have no Arrow type

    spark = asked.sparkSession
    segments = segments.join(asked.select("bucket").distinct(), "bucket", "left_semi")
    # a bucket in pieces is asked piece by piece; many questions to one bucket are dealt out with a copy of its pieces
    in_pieces = segments.filter("pieces > 1").groupBy("bucket").agg(F.max("pieces").alias("pieces"))
    asked = asked.join(F.broadcast(in_pieces), "bucket", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    parts = heavy_keys(asked, "bucket", floor=ASKED_AT_ONCE)
    asked, segments = asked.withColumn("part", F.lit(0)), segments.withColumn("part", F.lit(0))
    if parts:
        many = F.broadcast(spark.createDataFrame(parts, "bucket int, parts int"))
        asked = asked.join(many, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        segments = segments.join(many, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    place = ["bucket", "piece", "part"]
    # a fixed number of tasks: by bytes they would be laid together, but it is the searches that cost
    tasks = 4 * spark.sparkContext.defaultParallelism
    segments, asked = segments.select(*place, "text", "suffixes").repartition(tasks, *place), asked.select(*place, "key", "at", "lo", "hi").repartition(tasks, *place)
    found = segments.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(one, "key string, match string, coverage double")
    return found.groupBy("key", "match").agg(F.max("coverage").alias("coverage"))


#: Share of an address that a known one must cover to be proposed.
NEAR = 0.8


def _sides(batch: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = batch.select("batch_row_id", address("canonical_url").alias("key"), F.col("submitted_at").alias("by")).filter("key is not null and by is not null")
    kept = pages.select(F.col("id").alias("source_page_id"), address("normalized_url").alias("key"), F.col("created_at").alias("at")).filter("key is not null and at is not null")
    return stored(asked), stored(kept.groupBy("source_page_id", "key").agg(F.min("at").alias("at")))


def _index_of(kept: DataFrame) -> Index | None:
    """The pages accepted before as an index with a batch for each month; None without pages."""
    first = kept.agg(F.date_trunc("month", F.min("at"))).collect()[0][0]
    if first is None:
        return None
    month = (F.year("at") - F.lit(first.year)) * 12 + F.month("at") - F.lit(first.month)
    history = stored(kept.groupBy("key").agg(F.min(month).cast("int").alias("batch")))  # a text is indexed with the first batch that brings it
    return Index.of(history, scratch(kept.sparkSession))


def near_pages(batch: DataFrame, pages: DataFrame, least: float = NEAR) -> DataFrame:
    """key, match, coverage: each address of the batch with the known addresses that cover it to the share, itself included."""
    asked, kept = _sides(batch, pages)
    index = _index_of(kept)
    return index.search(asked, least) if index else asked.select("key", F.lit("").alias("match"), F.lit(0.0).alias("coverage")).limit(0)


def known_pages(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """batch_row_id, source_page_id of each batch row that names a page accepted before it.

    ``batch``: batch_row_id, canonical_url, submitted_at; ``pages``: id, normalized_url, created_at.
    Equal addresses cover each other whole, so the index is asked for a share of 1; the near ones are ``near_pages``.
    Null and non-http addresses match nothing; null times are not before anything; repeated
    rows count once; an empty side gives no rows; further columns are ignored.
    """
    asked, kept = _sides(batch, pages)
    index = _index_of(kept)
    if index is None:
        return asked.select("batch_row_id", F.lit(None).cast("string").alias("source_page_id")).limit(0)
    found = index.search(asked, 1.0).filter("key = match").select("key").distinct()
    hit = salted_join(kept, found, "key", F.xxhash64("source_page_id"), "left_semi")
    return salted_join(asked, hit, "key", F.xxhash64("batch_row_id")).filter("at < by").select("batch_row_id", "source_page_id").distinct()
