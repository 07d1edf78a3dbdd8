"""Exports: CSV packages with a manifest of hashes, and reports.

Rows are written by the cluster; only file names, counts and hashes come to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import formula_safe, html_escape


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column ``line``: formula-safe cells, quoted where RFC 4180 asks for it."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return rows.select(F.concat_ws(",", *[cell(formula_safe(F.col(c).cast("string"))) for c in columns]).alias("line"))


def file_digest(lines: DataFrame, header: str, order: str = "line") -> DataFrame:
    """record_count and an order-free digest of a set of lines: equal sets give equal digests at any partitioning."""
    one = F.conv(F.substring(F.sha2(order, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count(F.lit(1)).alias("record_count"), F.sha2(F.concat_ws("|", F.lit(header), F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(one), F.lit(0)).cast("string")), 256).alias("digest"))


def write_package(tables: dict[str, tuple[DataFrame, list[str]]], folder: str) -> dict:
    """Each table as CSV part files with CRLF line ends under ``folder``/name, and manifest.json; returns the manifest.

    A part is complete or absent (Spark's commit protocol); the manifest is written last, so a
    folder without one is no package.
    """
    manifest: dict = {"files": {}}
    spark = None
    for name, (rows, columns) in tables.items():
        spark = rows.sparkSession
        lines = csv_lines(rows, columns)
        safe = rows.select(*[formula_safe(F.col(c).cast("string")).alias(c) for c in columns])
        safe.write.mode("errorifexists").option("header", True).option("lineSep", "\r\n").option("quoteMode", "MINIMAL").option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")
        found = file_digest(lines, ",".join(columns)).collect()[0]
        manifest["files"][name] = {"columns": columns, "record_count": found.record_count, "digest": found.digest}
    if spark is not None:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest.json")
    return manifest


def html_report(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and html: one table row a record, all text escaped; records of a key in order of their cells."""
    tr = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    body = rows.select(key, tr.alias("tr")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("tr")), "").alias("b"))
    return body.select(key, F.concat(F.lit("<table>" + head), "b", F.lit("</table>")).alias("html"))


def sorted_json(map_column: str) -> "F.Column":
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(map_column))))
