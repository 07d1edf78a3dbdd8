"""Queries of the general data problems (3, 4, 6) over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import orphans, units
from tessera.session import table
from tessera.sources import records


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(records.parse_records(table(spark, d, "raw_input_records")))


def p3_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parse_records(table(spark, d, "raw_input_records")), "batch")


def p3_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(records.parse_records(table(spark, d, "raw_input_records")), "seed")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Records per file kind and outcome."""
    parsed = records.parse_records(table(spark, d, "raw_input_records"))
    return parsed.groupBy("input_kind", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return records.checked_rows(records.parse_records(table(spark, d, "raw_input_records")))


def upload_files(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files, accepted or rejected whole."""
    return records.file_status(_checked(spark, d))


def upload_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of the rejected files, in place."""
    return _checked(spark, d).filter("error is not null").select("file_name", "line_no", "record_id", "error").distinct()


def upload_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the accepted files, one a domain and file."""
    return records.accepted_rows(_checked(spark, d), "seed")


def upload_batch(spark: SparkSession, d: str) -> DataFrame:
    """Batch rows of the accepted files, one a canonical address and file."""
    return records.accepted_rows(_checked(spark, d), "batch")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.durations(table(spark, d, "candidate_records"), table(spark, d, "evidence_records"))


def p4_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The alias dictionary of the unit spellings in the data."""
    rows = units.candidate_statements(table(spark, d, "candidate_records")).unionByName(units.evidence_statements(table(spark, d, "evidence_records")))
    return units.unit_aliases(units.stated_parts(rows, ["record_table", "record_id"]).select("spelling"))


def _linked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("source_pages", "candidate_records", "evidence_records", "conflict_records")}


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.cascade(_linked(spark, d), table(spark, d, "record_deletions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.broken_references(_cascade(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, column, kind and month."""
    return p6_found(spark, d).groupBy("record_table", "record_column", "kind", "report_month").agg(F.count(F.lit(1)).alias("broken"))


def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return orphans.orphan_counts(_cascade(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_batch_rows, p3_seed_rows, p3_reasons, upload_files, upload_errors, upload_seeds, upload_batch, p4_found, p4_aliases, p6_found, p6_report, p6_cascade)}


def _reference(table_name: str, column: str, parent: str) -> str:
    clean = lambda c: rf"nullif(regexp_replace(lower({c}), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '')"
    return f"""
select '{table_name}' as record_table, '{column}' as record_column, c.id as record_id,
  case when d.k is not null then 'deleted' when p.k is null then 'missing' when p.at > c.created_at then 'late' end as kind,
  strftime(c.created_at, '%Y-%m') as report_month
from (select id, created_at, {clean(column)} as k from {table_name}) c
left join (select {clean('id')} as k, min(created_at) as at from {parent} group by 1) p on p.k = c.k
left join (select distinct {clean('record_id')} as k from record_deletions where record_table = '{parent}' and restored_at is null) d on d.k = c.k
where c.k is not null"""


def _records_sql() -> str:
    """Records of the uploaded files with reason and cells, by expressions alone: a record is matched whole against its delimiter's cells."""
    by_mark = lambda made: "case d when ',' then " + made(",") + " when ';' then " + made(";") + r" else " + made(r"\t") + " end"
    cell = lambda m: rf'("(?:[^"]|"")*"|[^"{m}]*)'
    whole = by_mark(lambda m: f"regexp_full_match(rec, '{cell(m)}({m}{cell(m)})*')")
    cells = by_mark(lambda m: f"regexp_extract_all(rec || d, '{cell(m)}{m}', 1)")
    value = lambda c: f"(case when starts_with(cells[list_position(cols, '{c}')], '\"') then replace(cells[list_position(cols, '{c}')][2:-2], '\"\"', '\"') else cells[list_position(cols, '{c}')] end)"
    return rf"""raw as (select *, regexp_replace(regexp_replace(raw_record, '[\r\n]+$', ''), '^\x{{FEFF}}', '') as rec from raw_input_records where raw_record is not null),
heads as (select file_name, min(replace(replace(rec, '"', ''), ' ', '')) as head from raw where line_no = 1 group by 1),
files as (select file_name, coalesce(nullif(regexp_extract(head, '[,;\t]'), ''), ',') as mark, lower(head) as head from heads),
given as (select record_id, file_name, line_no, coalesce(input_kind, '') as input_kind, coalesce(mark, ',') as d, rec,
  string_split(coalesce(head, case when input_kind = 'seed' then '{",".join(records.SEED_COLUMNS)}' else '{",".join(records.BATCH_COLUMNS)}' end), coalesce(mark, ',')) as cols
  from raw left join files using (file_name) where line_no is distinct from 1 and regexp_replace(translate(rec, ',;' || chr(9), ''), '[\s\x{{00A0}}]+', '', 'g') <> ''),
parts as (select *, {whole} as sound, {cells} as cells from given),
valued as (select *, {", ".join(f"{value(c)} as v_{c}" for c in records.FIELDS)} from parts),
judged as (select *, regexp_extract(trim(v_source_url), '^(?i:https?)://([^/?#\\]*)([/?#]|$)', 1) as authority, regexp_replace(trim(v_official_domain), '\.$', '') as bare from valued),
reasoned as (select *, case when not sound then 'quoting' when len(cells) <> len(cols) then 'column_count' when input_kind = 'seed' and trim(coalesce(v_institution_name, '')) = '' then 'institution_name'
  when input_kind = 'batch' and (v_source_url is null or not regexp_matches(trim(v_source_url), '^(?i:https?)://[^/?#\\]*([/?#]|$)') or contains(authority, '@') or not regexp_full_match(split_part(authority, ':', 1), '[^\s<>"{{}}|^`%@:\[\],;]+') or not regexp_matches(split_part(authority, ':', 1), '[\p{{L}}\p{{N}}]')
    or (position(':' in authority) > 0 and substr(authority, position(':' in authority) + 1) <> '' and coalesce(try_cast(nullif(regexp_extract(substr(authority, position(':' in authority) + 1), '^[0-9]{{1,7}}$'), '') as int), 0) not between 1 and 65535)) then 'source_url'
  when input_kind = 'seed' and (v_official_domain is null or length(bare) > 253 or not regexp_full_match(lower(bare), '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,63}}')) then 'official_domain' end as reason from judged)"""


def _loaded_sql(kind: str, columns: list[str]) -> str:
    cell = lambda c: rf"nullif(regexp_replace(v_{c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '')"
    shown = [f"regexp_replace(lower({cell(c)}), '\\.$', '') as {c}" if c == "official_domain" else f"{cell(c)} as {c}" for c in columns]
    return f"with {_records_sql()} select record_id, file_name, line_no, {', '.join(shown)} from reasoned where reason is null and input_kind = '{kind}'"


def _checked_sql() -> str:
    off = lambda c: rf"(trim(coalesce(v_{c}, '')) <> '' and not (regexp_replace(regexp_replace(lower(regexp_extract(trim(v_{c}), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)', 1)), ':[0-9]*$', ''), '\.+$', '') = dom or ends_with(regexp_replace(regexp_replace(lower(regexp_extract(trim(v_{c}), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)', 1)), ':[0-9]*$', ''), '\.+$', ''), '.' || dom)))"
    return f"{_records_sql()}, domains as (select *, regexp_replace(lower(trim(coalesce(v_official_domain, ''))), '\\.$', '') as dom from reasoned), checked as (select *, coalesce(reason, case when input_kind = 'seed' and ({off('catalogue_url')} or {off('sitemap_url')}) then 'outside_domain' end) as error from domains)"


def _edges(table_name: str, column: str, parent: str) -> str:
    clean = lambda c: rf"nullif(regexp_replace(lower({c}), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '')"
    return f"""
select '{table_name}' as record_table, {clean('c.id')} as node, '{parent}' as parent, {clean('c.' + column)} as key, strftime(c.created_at, '%Y-%m') as report_month,
  p.k is null or d.k is not null as broken
from {table_name} c left join (select distinct {clean('id')} as k from {parent}) p on p.k = {clean('c.' + column)}
left join (select distinct {clean('record_id')} as k from record_deletions where lower(trim(record_table)) = '{parent}' and restored_at is null) d on d.k = {clean('c.' + column)}
where {clean('c.' + column)} is not null and {clean('c.id')} is not null"""


def oracle_sql() -> dict[str, str]:
    union = "\nunion all\n".join(_reference(k.child, k.column, k.parent) for k in orphans.REPORTED)
    found = f"select distinct * from ({union}) where kind is not null"
    edges = "\nunion all\n".join(_edges(k.child, k.column, k.parent) for k in orphans.GRAPH)
    cascade = f"""with recursive e as materialized (select distinct * from ({edges})),
w as (select record_table, node, 0 as depth from e where broken union select e.record_table, e.node, w.depth + 1 from e join w on e.parent = w.record_table and e.key = w.node),
least_depth as (select record_table, node, min(depth) as depth from w group by 1, 2),
months as (select record_table, node, min(report_month) as report_month from e group by 1, 2)
select record_table, report_month, case depth when 0 then 'direct' else 'inherited' end as orphanhood, depth::int as depth, count(*) as "rows" from least_depth join months using (record_table, node) group by all"""
    return {
        "p3_found": f"with {_records_sql()} select distinct record_id, reason from reasoned where reason is not null",
        "p3_reasons": f"with {_records_sql()} select input_kind, coalesce(reason, 'loaded') as outcome, count(*) as records from reasoned group by all",
        "p3_batch_rows": _loaded_sql("batch", records.BATCH_COLUMNS),
        "p3_seed_rows": _loaded_sql("seed", records.SEED_COLUMNS),
        "upload_files": f"with {_checked_sql()} select file_name, input_kind, count(*) as records, count(error) as errors, count(error) = 0 as accepted from checked group by all",
        "upload_errors": f"with {_checked_sql()} select distinct file_name, line_no, record_id, error from checked where error is not null",
        "upload_seeds": f"""with {_checked_sql()}, good as (select file_name from checked group by 1 having count(error) = 0), l as ({_loaded_sql("seed", records.SEED_COLUMNS)})
select * exclude (n) from (select *, row_number() over (partition by file_name, official_domain order by line_no, record_id) as n from l where file_name in (select file_name from good)) where n = 1""",
        "p6_cascade": cascade,
        "p6_found": found,
        "p6_report": f"select record_table, record_column, kind, report_month, count(*) as broken from ({found}) group by all",
    }
