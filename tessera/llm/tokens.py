"""Token ids of a corpus by a public byte-level BPE tokenizer, with shared chunks encoded once.

A rolling hash over the characters cuts each text into chunks at places that depend on the
content alone, so copied passages give equal chunks wherever they stand.  Each distinct
chunk is encoded once; the ids go back to the documents.  A cut may fall where the
tokenizer would not part, so at every join the pieces around the cut are encoded anew until
the new pieces end where the next chunk's own pieces begin; from there on both agree
exactly, because the splitting pattern looks only forward.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import spread, stored

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The splitting pattern of the vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, MASK_BITS, LEAST, MOST = 24, 9, 128, 8192


@lru_cache(maxsize=4)
def tokenizer(folder: str, name: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    made.encode_special_tokens = True  # strings of special tokens are ordinary text
    made.no_truncation()
    return made


def encode_whole(texts: list[str], folder: str = TOKENIZERS, name: str = NAME) -> list[list[int]]:
    one = tokenizer(folder, name)
    if len(texts) == 1:  # without the cost of a batch
        return [one.encode(texts[0], add_special_tokens=False).ids]
    return [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, the last one its length."""
    return cuts_of([text])[0]


def cuts_of(texts: list[str], at_once: int = 1 << 20) -> list[list[int]]:
    """``cuts`` of many texts: the rolling hash runs over about ``at_once`` characters of them together."""
    out: list[list[int]] = []
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= at_once:
            out.extend(_cuts_of(group))
            group, size = [], 0
    return out + (_cuts_of(group) if group else [])


def _cuts_of(texts: list[str]) -> list[list[int]]:
    import numpy as np

    long = [t for t in texts if len(t) > LEAST]
    # zeros of a window's length between the texts: what stands before a text adds nothing to its hashes
    gap = "\0" * WINDOW
    codes = np.frombuffer(gap.join(long).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    starts, at = [], 0
    for t in long:
        starts.append(at)
        at += len(t) + WINDOW
    for s in starts[1:]:
        codes[s - WINDOW : s] = 0
    rolled = np.zeros(n, dtype=np.uint64)
    base, power = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, n)):
            rolled[k:] += codes[: n - k] * power
            power = power * base
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    places = np.nonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0)[0] + 1
    bounds = np.searchsorted(places, [x for s, t in zip(starts, long) for x in (s + 1, s + len(t))]).tolist()
    out, at = [], 0
    for text in texts:
        if len(text) <= LEAST:
            out.append([len(text)] if text else [])
            continue
        start = starts[at]
        out.append(_spaced([p - start for p in places[bounds[2 * at] : bounds[2 * at + 1]].tolist()], len(text)))
        at += 1
    return out


def _spaced(places: list[int], n: int) -> list[int]:
    """The places that are far enough apart, with further ones where they are too far, and the end."""
    out, last = [], 0
    for p in places:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST and p < n:
            out.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def join_chunks(text: str, ends: list[int], ids: list[list[int]], encode) -> list[int]:
    """The ids of ``text`` from those of its chunks, exactly as if it had been encoded whole.

    ``encode`` gives the ids of a list of texts.  A piece is a match of the splitting
    pattern; pieces are encoded one by one by the tokenizer, so ids can be counted by piece.
    """
    if not ends:
        return []
    find = _pattern().finditer
    out: list[int] = []
    start = 0  # from here on `text` is not in `out` yet
    k = 0
    begin = 0
    while k < len(ends):
        end = ends[k]
        chunk = text[begin:end]
        # pieces of the chunk by itself that are in `out` already or lie before `start`
        skip = 0
        if start > begin:
            lead = encode([chunk[: start - begin]])[0]
            skip = len(lead)
        if k == len(ends) - 1:
            out.extend(ids[k][skip:])
            break
        # the last two pieces may change by what follows the cut ("'l" + "l", blanks before a word)
        tail = [start]
        back = max(start, end - 64)
        while True:
            marks = [m.start() for m in find(chunk, _piece_start(chunk, back - begin, start - begin))]
            if len(marks) >= 3 or back <= start:
                break
            back = max(start, end - 4 * (end - back))
        tail = marks[-2:] if len(marks) > 2 else [start - begin]
        keep = tail[0]
        if keep <= start - begin:
            keep = start - begin
        held = len(encode([chunk[keep:]])[0]) if keep < len(chunk) else 0
        out.extend(ids[k][skip : len(ids[k]) - held])
        # encode pieces over the cut until they end at a border of a later chunk's own pieces
        at = begin + keep
        j = k + 1
        own = _borders(text, ends, j)
        border = next(own, None)
        redone_from = at
        agreed = None
        for m in find(text, at):
            p = m.end()
            while border is not None and border < p:
                border = next(own, None)
            while border is None and j + 1 < len(ends) and p > ends[j]:
                j += 1
                own = _borders(text, ends, j)
                border = next(own, None)
                while border is not None and border < p:
                    border = next(own, None)
            if border == p and p > end:
                agreed = p
                break
        if agreed is None or agreed >= len(text):
            out.extend(encode([text[redone_from:]])[0])
            break
        out.extend(_encode_exactly(text[redone_from:agreed], text[agreed : agreed + 1], encode))
        start = agreed
        k = j
        begin = ends[k - 1]
    return out


def _piece_start(chunk: str, at: int, floor: int) -> int:
    """A place at or before ``at`` where a piece surely begins: before a blank that follows a letter or digit."""
    p = max(at, floor)
    while p > floor and not (chunk[p] == " " and chunk[p - 1].isalnum()):
        p -= 1
    return p


def _borders(text: str, ends: list[int], k: int):
    """Ends of the pieces of chunk k by itself, but for the last two, which may change."""
    begin, end = ends[k - 1], ends[k]
    held: list[int] = []
    for m in _pattern().finditer(text[begin:end]):
        held.append(begin + m.end())
        if k == len(ends) - 1:
            yield held.pop()
        elif len(held) > 3:
            yield held.pop(0)


def _encode_exactly(part: str, following: str, encode) -> list[int]:
    """Ids of ``part`` as it stands before ``following``: blanks at its end keep their pieces."""
    if not part or not part[-1].isspace() or not following or following.isspace():
        return encode([part])[0]
    out: list[int] = []
    for m in _pattern().finditer(part + following):
        if m.start() >= len(part):
            break
        piece = m.group() if m.end() <= len(part) else part[m.start() :]
        out.extend(encode([piece])[0])
    return out


CHUNKS = "k struct<none:boolean,doc:bigint,text:bigint>, ends array<int>, hashes array<binary>"


def _chunked(batches: Iterator) -> Iterator:
    import hashlib

    import pandas as pd

    for batch in batches:
        out: dict[str, list] = {"ends": [], "hashes": []}
        for text, ends in zip(batch["text"], cuts_of(list(batch["text"]))):
            begins = [0, *ends[:-1]]
            out["ends"].append(ends)
            out["hashes"].append([hashlib.blake2b(text[b:e].encode("utf-8", "surrogatepass"), digest_size=16).digest() for b, e in zip(begins, ends)])
        yield pd.DataFrame({"k": batch["k"]} | out)


def _runs(ends: list[int], shared: dict[int, list[int]]) -> list[tuple[int, int, list[int] | None]]:
    """(begin, end, ids) of the shared chunks of a text, and of what lies between them as one part without ids."""
    out: list[tuple[int, int, list[int] | None]] = []
    begin = 0
    for k, end in enumerate(ends):
        ids = shared.get(k)
        if ids is None and out and out[-1][2] is None:
            out[-1] = (out[-1][0], end, None)
        else:
            out.append((begin, end, ids))
        begin = end
    return out


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """doc_id and ids (array of int) of every document, without special tokens.

    Texts are cut once; only the hashes of the chunks are counted.  A chunk that stands in more
    places than one is encoded once, from the place that comes first, and its ids are joined to the
    others; what lies between shared chunks is encoded where it stands, so a text without copies
    is encoded whole and its chunks never leave it.  Null and empty texts give an empty array;
    white space is text; strings of special tokens are ordinary text.  Repeated rows of one doc_id
    and text give one row each text.
    """

    def encoded(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            chunks = [(h, text[b:e]) for text, places in zip(batch["text"], batch["places"]) for h, b, e in ((p["hash"], p["begin"], p["end"]) for p in places)]
            yield pd.DataFrame({"hash": [h for h, _ in chunks], "ids": encode_whole([c for _, c in chunks], folder, name) if chunks else []})

    def joined(batches: Iterator) -> Iterator:
        import pandas as pd

        encode = lambda texts: encode_whole(texts, folder, name)
        for batch in batches:
            parts = []
            for ends, found in zip(batch["ends"], batch["parts"]):
                shared = {p["pos"]: list(p["ids"]) for p in found} if found is not None else {}
                parts.append(_runs(list(ends), shared))
            # one call for all that is not shared
            wanted = [(d, k) for d, runs in enumerate(parts) for k, r in enumerate(runs) if r[2] is None]
            texts = list(batch["text"])
            made = encode([texts[d][parts[d][k][0] : parts[d][k][1]] for d, k in wanted]) if wanted else []
            for (d, k), ids in zip(wanted, made):
                begin, end, _ = parts[d][k]
                parts[d][k] = (begin, end, ids)
            out = [runs[0][2] if len(runs) == 1 else join_chunks(text, [r[1] for r in runs], [r[2] for r in runs], encode) for text, runs in zip(texts, parts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": out})

    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc"), F.xxhash64("text").alias("text"))
    full = spread(documents.filter("text is not null and text <> ''").select("doc_id", "text")).withColumn("k", key)
    chunked = stored(full.select("k", "text").mapInPandas(_chunked, CHUNKS))
    each = chunked.select("k", "ends", F.posexplode("hashes").alias("pos", "hash"))
    begin = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.try_element_at("ends", F.col("pos")))
    each = each.select("k", "pos", "hash", begin.alias("begin"), F.try_element_at("ends", F.col("pos") + 1).alias("end"))
    several = stored(each.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("k", "pos", "begin", "end")).alias("at")).filter("uses > 1"))
    # the shared chunks of a text are read from it together
    keepers = several.select("at.k", F.struct("hash", F.col("at.begin").alias("begin"), F.col("at.end").alias("end")).alias("p")).groupBy("k").agg(F.collect_list("p").alias("places"))
    ids = stored(full.join(keepers, "k").select("text", "places").mapInPandas(encoded, "hash binary, ids array<int>").dropDuplicates(["hash"]))
    placed = salted_join(each.select("k", "pos", "hash"), ids, "hash", F.xxhash64("k", "pos"), heavy=heavy_keys(several, "hash", count="uses"))
    parts = placed.groupBy("k").agg(F.collect_set(F.struct("pos", "ids")).alias("parts"))
    cut_texts = chunked.select("k", "ends").dropDuplicates(["k"]).join(parts, "k", "left")
    done = full.join(cut_texts, "k").select("doc_id", "text", "ends", "parts").mapInPandas(joined, "doc_id bigint, ids array<int>")
    empty = documents.filter("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return done.unionByName(empty)


def count_tokens(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``keep`` and n_tokens of every row; 0 for null and empty texts.  One pass, no shuffle."""
    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator) -> Iterator:
        for batch in batches:
            out = batch[keep].copy()
            out["n_tokens"] = [len(i) for i in encode_whole([t or "" for t in batch["text"]], folder, name)]
            yield out

    return spread(documents.select(*dict.fromkeys([*keep, "text"]))).mapInPandas(counted, schema)
