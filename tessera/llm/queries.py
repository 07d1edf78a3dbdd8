"""Queries of the language-data problems over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import mainbody, mixing, names, suffixes, survivors, textstats, tokens
from tessera.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.known_pages(table(spark, d, "batch_input_rows"), table(spark, d, "source_pages"))


def p5_near(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the batches and the known addresses that are near-duplicates of them."""
    return suffixes.near_pages(table(spark, d, "batch_input_rows"), table(spark, d, "source_pages")).filter("key <> match")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate(table(spark, d, "cached_pages"), table(spark, d, "evidence_records"), table(spark, d, "source_pages"))


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page, one text a page."""
    lines = mainbody.page_lines(table(spark, d, "cached_pages")).filter("main")
    return lines.groupBy("cached_file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("main_text"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return names.institution_names(table(spark, d, "candidate_records"), table(spark, d, "batch_input_rows"), table(spark, d, "discovery_seeds"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "candidate_records"), _names(spark, d)).select("candidate_id", "field_name").distinct()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record a group."""
    values = survivors.survivors(table(spark, d, "candidate_records"), _names(spark, d))
    return values.groupBy("group_id").pivot("field_name", survivors.FIELDS).agg(F.first("value"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(_names(spark, d)))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """name and entity of every spelling."""
    return names.link_names(_names(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each document in each mix."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and shares reached."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return textstats.not_prose(table(spark, d, "documents"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return textstats.text_statistics(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_main, p5_found, p5_near, p7_found, p7_entities, p8_ids, p9_draw, p9_shares, p10_found, p10_stats)}


CARRIED = "^(utm_.*|mtm_.*|pk_.*|fbclid|gclid|gclsrc|dclid|msclkid|ref|referrer|referer|sessionid|session_id|sid|jsessionid|phpsessid)$"


def _address_sql(table_name: str, columns: str, url: str) -> str:
    return rf"""(select {columns}, regexp_replace(regexp_replace(rtrim(regexp_replace(lower(split_part(a, '@', -1)), ':(80|443)$', ''), '.'), '^www\d?\.', ''), '\.:', ':')
  || coalesce(nullif(regexp_replace('/' || array_to_string(list_filter(string_split(url_decode(trim(p)), '/'), lambda x: x not in ('', '.')), '/'), '/(index|default|home)\.(html?|php\d?|aspx?|jsp|cgi)$', '', 'i'), ''), '/')
  || coalesce('?' || nullif(array_to_string(list_sort(list_distinct(list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 1) <> '' and not regexp_matches(lower(split_part(x, '=', 1)), '{CARRIED}')))), '&'), ''), '') as k
  from (select *, regexp_extract({url}, '(?i)^\s*https?://+([^/?#\s]+)', 1) as a, regexp_extract({url}, '(?i)^\s*https?://+[^/?#\s]+([^?#]*)', 1) as p, regexp_extract({url}, '\?([^#]*)', 1) as q
        from {table_name} where regexp_matches({url}, '(?i)^\s*https?://+[^/?#\s]')))"""


def oracle_sql() -> dict[str, str]:
    batch, pages = _address_sql("batch_input_rows", "batch_row_id, submitted_at", "canonical_url"), _address_sql("source_pages", "id, created_at", "normalized_url")
    return {"p5_found": f"select distinct batch_row_id, id as source_page_id from {batch} b join {pages} s using (k) where s.created_at < b.submitted_at"}
