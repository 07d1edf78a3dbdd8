"""Loading uploaded CSV records: valid rows typed, each bad record with its reason.

Records reach the loader already cut, one string each.  Blocks of records that share a
file layout are parsed together by the columnar CSV reader.  A block that fails is cut in
two and both halves are tried again, down to single records, which a strict state
machine then diagnoses.  So good blocks never leave the fast path and the cost of a bad
record is logarithmic in the block.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.urls import canonical_url, host, within_domain
from tessera.operators.history import first_occurrences
from tessera.operators.skew import salted_join

BATCH_COLUMNS = ["source_url", "expected_university_name", "expected_program_name", "operator_notes"]
SEED_COLUMNS = ["institution_name", "official_domain", "catalogue_url", "sitemap_url", "operator_notes"]
FIELDS = list(dict.fromkeys(BATCH_COLUMNS + SEED_COLUMNS))
REASONS = ["quoting", "column_count", "institution_name", "source_url", "official_domain"]

PARSED = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("input_kind", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        *[T.StructField(f, T.StringType()) for f in FIELDS],
    ]
)

HOST = re.compile(r"(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}", re.I)
ADDRESS = re.compile(r"(https?)://([^/?#\\]*)(?:[/?#].*)?", re.I | re.S)
URL_HOST = re.compile(r"[^\s<>\"{}|^`%@:\[\],;]*[^\W_][^\s<>\"{}|^`%@:\[\],;]*")


def bad_source_url(value: str) -> bool:
    """Not an absolute http(s) address with a host and, if any, a valid port; or with credentials."""
    m = ADDRESS.fullmatch(value.strip())
    if not m:
        return True
    authority = m.group(2)
    if "@" in authority:
        return True
    if authority.startswith("["):
        host, _, rest = authority[1:].partition("]")
        if not re.fullmatch(r"[0-9a-f:.]+", host, re.I) or (rest and rest[0] != ":"):
            return True
        port = rest[1:]
    else:
        host, _, port = authority.partition(":")
        if not URL_HOST.fullmatch(host):
            return True
    return bool(port) and not (re.fullmatch(r"[0-9]{1,7}", port) and 1 <= int(port) <= 65535)


def bad_domain(value: str) -> bool:
    """Not a bare dotted host name that ends in letters."""
    name = value.strip()
    return not HOST.fullmatch(name[:-1] if name.endswith(".") else name)


def strict_cells(text: str, delimiter: str) -> list[str] | None:
    """Cells by RFC 4180, None where the quoting breaks it: the slow path for one record."""
    if '"' not in text:
        return text.split(delimiter)
    cells, at, n = [], 0, len(text)
    while True:
        if at < n and text[at] == '"':
            out, at = [], at + 1
            while True:
                close = text.find('"', at)
                if close < 0:
                    return None
                out.append(text[at:close])
                if text[close + 1 : close + 2] == '"':
                    out.append('"')
                    at = close + 2
                    continue
                at = close + 1
                break
            cells.append("".join(out))
            if at < n and text[at] != delimiter:
                return None
        else:
            end = text.find(delimiter, at)
            end = n if end < 0 else end
            if '"' in text[at:end]:
                return None
            cells.append(text[at:end])
            at = end
        if at >= n:
            return cells
        at += 1


def diagnose(text: str, kind: str, delimiter: str, columns: list[str]) -> tuple[str | None, list[str]]:
    """The first reason that holds for one record, with its cells where they can be had."""
    cells = strict_cells(text, delimiter)
    if cells is None:
        return "quoting", []
    if len(cells) != len(columns):
        return "column_count", []
    row = dict(zip(columns, cells))
    if kind == "seed" and not row.get("institution_name", "").strip():
        return "institution_name", cells
    if kind == "batch" and bad_source_url(row.get("source_url", "")):
        return "source_url", cells
    if kind == "seed" and bad_domain(row.get("official_domain", "")):
        return "official_domain", cells
    return None, cells


def _quoting_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'
    return rf"^(?s:{cell}(?:{d}{cell})*)$"


#: Plain values that need no closer look: what fails these is judged by the full rules.
SURE_URL = re.compile(r"https?://[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)*(?:/[!-~]*)?")
SURE_DOMAIN = re.compile(r"(?:[a-z0-9][a-z0-9-]{0,61}[a-z0-9]\.){1,8}[a-z]{2,63}")
#: Blocks that fail are halved down to this many records, which the strict reader takes one by one.
LEAF = 16


def _fast_block(texts: list[str], delimiter: str, columns: list[str]) -> list[list[str]] | None:
    """All records of a block as columns, or None if any of them cannot be read so."""
    import pyarrow as pa
    from pyarrow import csv

    joined = "\n".join(texts) + "\n"
    if '"' in joined or "\r" in joined or joined.count("\n") > len(texts):
        import pyarrow.compute as pc

        quoted = [t for t in texts if '"' in t or "\n" in t or "\r" in t]
        if not pc.all(pc.match_substring_regex(pa.array(quoted), _quoting_pattern(delimiter))).as_py():
            return None
    elif joined.count(delimiter) != len(texts) * (len(columns) - 1):
        return None
    try:
        read = csv.read_csv(
            io.BytesIO(joined.encode("utf-8", "surrogatepass")),
            read_options=csv.ReadOptions(column_names=columns, block_size=1 << 26, use_threads=False),
            parse_options=csv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if read.num_rows != len(texts):
        return None
    return [read.column(c).to_pylist() for c in columns]


def _judged(cells: dict[str, list[str]], kind: str, n: int) -> list[str | None]:
    """The first reason that holds for each of ``n`` records that could be read."""
    if kind == "batch":
        urls = cells.get("source_url") or [""] * n
        sure = SURE_URL.fullmatch
        return [None if sure(u) else "source_url" if bad_source_url(u) else None for u in urls]
    if kind == "seed":
        names, domains = cells.get("institution_name") or [""] * n, cells.get("official_domain") or [""] * n
        sure = SURE_DOMAIN.fullmatch
        return ["institution_name" if not a.strip() else None if len(d) < 254 and sure(d) else "official_domain" if bad_domain(d) else None for a, d in zip(names, domains)]
    return [None] * n


def parse_block(texts: list[str], kind: str, delimiter: str, columns: list[str]) -> list[tuple[str | None, list[str]]]:
    """(reason, cells) for every record, in order, by bisection."""
    reasons, cells = _parse_block(texts, kind, delimiter, columns)
    return [(r, [c[i] for c in cells] if r not in ("quoting", "column_count") else []) for i, r in enumerate(reasons)]


def _parse_block(texts: list[str], kind: str, delimiter: str, columns: list[str]) -> tuple[list[str | None], list[list[str | None]]]:
    """Reasons of the records and their cells by column."""
    if len(texts) > LEAF or len(texts) == 1:
        got = _fast_block(texts, delimiter, columns) if len(set(columns)) == len(columns) and len(columns) > 1 else None
        if got is not None:
            return _judged(dict(zip(columns, got)), kind, len(texts)), got
    if len(texts) <= LEAF:
        reasons: list[str | None] = []
        out: list[list[str | None]] = [[] for _ in columns]
        for t in texts:
            reason, cells = diagnose(t, kind, delimiter, columns)
            reasons.append(reason)
            for column, cell in zip(out, cells or [None] * len(columns)):
                column.append(cell)
        return reasons, out
    half = len(texts) // 2
    (r1, c1), (r2, c2) = _parse_block(texts[:half], kind, delimiter, columns), _parse_block(texts[half:], kind, delimiter, columns)
    return r1 + r2, [a + b for a, b in zip(c1, c2)]


def _parse(batches: Iterator, block_chars: int = 1 << 20, block_rows: int = 1024) -> Iterator:
    import pandas as pd

    for batch in batches:
        made = []
        for (kind, delimiter, header), part in batch.groupby(["input_kind", "delimiter", "header"], dropna=False, sort=False):
            columns = header.split("\x1f")
            records = part["record"].tolist()
            reasons: list[str | None] = []
            cells: list[list[str | None]] = [[] for _ in columns]
            start = 0
            while start < len(records):
                stop, chars = start, 0
                while stop < len(records) and stop - start < block_rows and (stop == start or chars < block_chars):
                    chars += len(records[stop])
                    stop += 1
                found, read = _parse_block(records[start:stop], kind, delimiter, columns)
                reasons.extend(found)
                for column, more in zip(cells, read):
                    column.extend(more)
                start = stop
            by = dict(zip(columns, cells))
            out = part[["record_id", "file_name", "input_kind", "line_no"]].reset_index(drop=True)
            out["reason"] = reasons
            for f in FIELDS:
                out[f] = by.get(f)
            made.append(out)
        if made:
            yield pd.concat(made, ignore_index=True)


def _record(raw: Column) -> Column:
    """Without line end; a byte-order mark before the first cell is none of its text."""
    return F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+\z", ""), "^﻿", "")


def parse_records(raw: DataFrame) -> DataFrame:
    """Every data record with its reason (null: it can be loaded) and its cells.

    Headers (line 1), and records of nothing but delimiters and spaces, are left out; a null
    record counts as such.  A file without header is read by the usual columns of its kind
    and commas; an unknown kind is checked for quoting and column count only.  Of two
    headers of one file the smaller by text counts.  A file with a large part of the rows is
    spread over reducers by its own size.  Empty input gives an empty result, and further
    columns of ``raw`` are ignored.
    """
    raw = raw.select("record_id", "file_name", "input_kind", "line_no", "raw_record")
    head = F.regexp_replace(_record("raw_record"), '[" ]', "")
    headers = (
        raw.filter("line_no = 1")
        .groupBy("file_name")
        .agg(F.min(head).alias("head"))
        .select(
            "file_name",
            F.coalesce(F.nullif(F.regexp_extract("head", "([,;\t])", 1), F.lit("")), F.lit(",")).alias("delimiter"),
            F.regexp_replace(F.lower("head"), "[,;\t]", "\x1f").alias("header"),
        )
    )
    usual = F.when(F.col("input_kind") == "seed", "\x1f".join(SEED_COLUMNS)).otherwise("\x1f".join(BATCH_COLUMNS))
    records = raw.filter("line_no is distinct from 1 and raw_record is not null")
    rows = (
        salted_join(records, headers, "file_name", F.col("record_id"), "left")
        .select(
            "record_id",
            "file_name",
            F.coalesce("input_kind", F.lit("")).alias("input_kind"),
            "line_no",
            F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
            F.coalesce("header", usual).alias("header"),
            _record("raw_record").alias("record"),
        )
        .filter(F.length(F.regexp_replace(F.translate("record", ",;\t", ""), r"(?U)\s+", "")) > 0)
    )
    return rows.mapInPandas(_parse, PARSED)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").select("record_id", "reason").distinct()


def loaded(parsed: DataFrame, kind: str) -> DataFrame:
    """Typed valid rows: stripped cells, blanks as null, domains lower case without final dot."""
    columns = SEED_COLUMNS if kind == "seed" else BATCH_COLUMNS
    cell = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    out = parsed.filter(F.col("reason").isNull() & (F.col("input_kind") == kind)).select(
        "record_id", "file_name", "line_no", *[cell(c).alias(c) for c in columns]
    )
    if kind == "seed":
        out = out.withColumn("official_domain", F.regexp_replace(F.lower("official_domain"), r"\.$", ""))
    return out


def checked_rows(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``error``: the reason of the parse, or ``outside_domain`` for a seed whose catalogue or sitemap lies off its domain."""
    domain = F.regexp_replace(F.lower(F.trim("official_domain")), r"\.$", "")
    off = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "") & ~F.coalesce(within_domain(host(F.trim(c)), domain), F.lit(False))
    return parsed.withColumn("error", F.coalesce("reason", F.when((F.col("input_kind") == "seed") & (off("catalogue_url") | off("sitemap_url")), "outside_domain")))


def file_status(checked: DataFrame) -> DataFrame:
    """file_name, input_kind, records, errors, accepted: a file with any error is rejected whole, with all its errors counted.

    The errors themselves are the rows of ``checked`` with an error.  Files of nothing but blank records have no row.
    """
    return checked.groupBy("file_name", "input_kind").agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors")).withColumn("accepted", F.col("errors") == 0)


def accepted_rows(checked: DataFrame, kind: str) -> DataFrame:
    """Typed rows of the accepted files, each canonical address (batch) or domain (seed) once a file: its first line."""
    good = file_status(checked).filter("accepted").select("file_name")
    rows = loaded(salted_join(checked, good, "file_name", F.col("record_id"), "left_semi"), kind)
    key = F.col("official_domain") if kind == "seed" else F.coalesce(canonical_url("source_url"), F.col("source_url"))
    return first_occurrences(rows.withColumn("_key", key), ["file_name", "_key"], ["line_no", "record_id"]).drop("_key")
