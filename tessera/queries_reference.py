"""Queries of the evidence operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text, urls, values
from tessera.operators import contract, crawl, groups, history, layers, merge, resolve
from tessera.operators.skew import salted_join
from tessera.plans import stages
from tessera.session import table
from tessera.sources import facts, fetchlog, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- evidence

RANKED_SQL = """
every_value as (
  select distinct id, candidate_id, field_name, source_page_id, coalesce(nullif(normalized_value, ''), nullif(extracted_value, '')) as value,
    case confidence when 'high' then 0 when 'medium' then 1 else 2 end as rank, created_at
  from evidence_records
  where field_name in ('program_name','university_name','country_code','city','degree_level','field_category','teaching_language','duration_value','duration_unit','duration_semesters','study_mode','intake','application_url','source_url')
    and candidate_id is not null and coalesce(nullif(normalized_value, ''), nullif(extracted_value, '')) is not null
),
own_urls as (select distinct e.id, e.candidate_id from every_value e join candidate_records c on c.id = e.candidate_id and c.source_page_id = e.source_page_id where e.field_name = 'source_url'),
ranked as (select * from every_value where field_name <> 'source_url' or id in (select id from own_urls) or candidate_id not in (select candidate_id from own_urls)),
best as (select candidate_id, field_name, min(rank) as best, count(distinct lower(value)) as vals, count(distinct source_page_id) as pages from ranked group by all),
strongest as (
  select r.candidate_id, r.field_name, lower(r.value) as folded, best, vals, pages, arg_min(r.id, (r.created_at, r.id)) as id, arg_min(r.value, (r.created_at, r.id)) as value, min((r.created_at, r.id)) as ord
  from ranked r join best b on r.candidate_id = b.candidate_id and r.field_name = b.field_name and r.rank = b.best group by all
),
numbered as (select *, row_number() over (partition by candidate_id, field_name order by ord) as n, count(*) over (partition by candidate_id, field_name) as tops from strongest),
resolved as (
  select a.candidate_id, a.field_name,
    case when a.vals = 1 and a.best = 2 then 'low_only' when a.vals = 1 then 'agreed' when a.tops = 1 then 'outranked' else 'conflict' end as outcome,
    a.value as first_value, a.vals, a.pages, a.best, a.id as first_id, b.id as second_id
  from numbered a left join numbered b on a.candidate_id = b.candidate_id and a.field_name = b.field_name and b.n = 2 where a.n = 1
)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(resolve.ranked_evidence(table(spark, d, "evidence_records"), table(spark, d, "candidate_records")))


@query(f"""with {RANKED_SQL} select candidate_id, field_name, outcome, case when outcome in ('agreed', 'outranked') then first_value end as value, vals as "values", pages,
  case when best = 0 or (best = 1 and pages >= 2) then 'high' when best = 1 then 'medium' else 'low' end as confidence,
  case when outcome = 'conflict' then first_id end as first_evidence_id, case when outcome = 'conflict' then second_id end as second_evidence_id from resolved""")
def evidence_resolution(spark, d):
    return _resolved(spark, d)


@query(f"with {RANKED_SQL} select outcome, count(*) as fields from resolved group by outcome")
def evidence_outcomes(spark, d):
    return _resolved(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("fields"))


@query("""with f as (select candidate_id, field_name, count(distinct coalesce(source_page_id, '')) as pages, count(distinct lower(coalesce(nullif(normalized_value, ''), extracted_value, ''))) as vals
 from evidence_records where candidate_id is not null and field_name is not null group by 1, 2), k as (select distinct candidate_id, field_name, 1 as named from conflict_records)
select candidate_id, field_name, case when named = 1 then 'conflict' when pages > 1 and vals = 1 then 'agreement across sources' else 'single source or complementary' end as agreement from f left join k using (candidate_id, field_name)""")
def field_agreement(spark, d):
    return resolve.agreement(table(spark, d, "evidence_records"), table(spark, d, "conflict_records"))


@query("""with want as (select unnest(['program_name','university_name','country_code','city','degree_level','field_category','teaching_language','duration_value','duration_unit','duration_semesters','study_mode','intake','application_url','source_url']) as f),
c as (select distinct id from candidate_records), have as (select distinct candidate_id, field_name from evidence_records)
select c.id as candidate_id, coalesce(string_agg(f, ',' order by f) filter (where h.field_name is null), '') as missing from c cross join want left join have h on h.candidate_id = c.id and h.field_name = f group by 1""")
def missing_fields(spark, d):
    m = resolve.missing_fields(table(spark, d, "evidence_records").select("candidate_id", "field_name"), table(spark, d, "candidate_records"))
    return m.select("candidate_id", F.array_join("missing", ",").alias("missing"))


@query("""select confidence, coalesce(n, 0) as n from (select unnest(['high', 'medium', 'low']) as confidence) l left join (select confidence, count(*) as n from evidence_records group by 1) using (confidence)""")
def confidence_histogram(spark, d):
    return groups.histogram(table(spark, d, "evidence_records"), "confidence", ["high", "medium", "low"])


# ---------------------------------------------------------------- layers


def _layers_sql(column: str, layer: int) -> str:
    return f"select distinct id as candidate_id, unnest(json_keys({column})) as field_name, {column} as j, {layer} as layer from candidate_records where json_valid({column})"


CONTEXT_SQL = """ctx as (select distinct c.id as candidate_id, 'country_code' as field_name, j.country_code as value from candidate_records c join collection_jobs j on j.id = c.job_id),
free as (select candidate_id, field_name, min(value) as value from ctx where value is not null and not exists (select 1 from evidence_records e where e.candidate_id = ctx.candidate_id and e.field_name = ctx.field_name and e.normalized_value <> ctx.value) group by 1, 2),"""
EFFECTIVE_SQL = f"""
{CONTEXT_SQL}
rows as (select candidate_id, field_name, json_extract_string(j, '$."' || field_name || '"') as value, layer from ({_layers_sql("normalized_data", 1)} union all {_layers_sql("reviewer_overrides", 0)}) union all select candidate_id, field_name, value, 2 from free),
effective as (select candidate_id, field_name, min(layer) as l from rows group by 1, 2),
picked as (select e.candidate_id, e.field_name, min(coalesce(r.value, '')) as told, case e.l when 0 then 'override' when 1 then 'extraction' else 'context' end as layer from effective e
   join rows r on r.candidate_id = e.candidate_id and r.field_name = e.field_name and r.layer = e.l group by all)"""


def _contexts(spark, d):
    """candidate_id, field_name, value: the country of the candidate's job."""
    jobs = table(spark, d, "collection_jobs").select(F.col("id").alias("job_id"), F.col("country_code").alias("value"))
    return table(spark, d, "candidate_records").select(F.col("id").alias("candidate_id"), "job_id").distinct().join(jobs, "job_id").select("candidate_id", F.lit("country_code").alias("field_name"), "value").distinct()


def _effective(spark, d):
    c = table(spark, d, "candidate_records")
    free = layers.context_contradictions(_contexts(spark, d), table(spark, d, "evidence_records")).filter("effective and value is not null")
    context = free.groupBy("candidate_id", "field_name").agg(F.min("value").alias("value")).withColumn("layer", F.lit(layers.CONTEXT))
    return layers.effective_values(layers.json_layer(c, "normalized_data", layers.EXTRACTION), layers.json_layer(c, "reviewer_overrides", layers.OVERRIDE), context)


@query(f"with {EFFECTIVE_SQL} select candidate_id, field_name, nullif(told, '') as value, layer from picked")
def effective_values(spark, d):
    return _effective(spark, d).withColumn("value", F.nullif("value", F.lit("")))


@query(f"with {EFFECTIVE_SQL} select layer, count(*) as fields from picked where trim(told) <> '' group by layer")
def provenance_counts(spark, d):
    return layers.provenance_counts(_effective(spark, d))


@query("""with ctx as (select distinct c.id as candidate_id, 'country_code' as field_name, j.country_code as value from candidate_records c join collection_jobs j on j.id = c.job_id),
ev as (select distinct candidate_id, field_name, normalized_value as f from evidence_records where normalized_value is not null)
select ctx.candidate_id, ctx.field_name, ctx.value, coalesce(string_agg(f, ',' order by f) filter (where f <> ctx.value), '') as contradicting, count(f) filter (where f <> ctx.value) = 0 as effective
from ctx left join ev using (candidate_id, field_name) group by 1, 2, 3""")
def context_contradictions(spark, d):
    context = _contexts(spark, d)
    out = layers.context_contradictions(context, table(spark, d, "evidence_records"))
    return out.withColumn("contradicting", F.array_join("contradicting", ","))


def _canonical_sql(source: str) -> str:
    """id, u, good, bare_c (without query) and c of the addresses u of ``source`` (id, u)."""
    return r"""with
parts as (select id, u, lower(regexp_extract(u, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, regexp_extract(u, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as a, regexp_extract(u, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p,
  regexp_extract(u, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)', 1) as q from (SOURCE)),
hosts as (select *, regexp_replace(lower(regexp_replace(regexp_extract(a, '([^@]*)$', 1), ':\d*$', '')), '\.+$', '') as h, regexp_extract(a, ':(\d+)$', 1) as port, regexp_replace(p, '/+$', '') as bare,
  list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(case when contains(x, '=') then substr(x, position('=' in x) + 1) else '' end, '+', ' '))}), lambda y: not starts_with(lower(y.k), 'utm_') and lower(y.k) not in ('fbclid', 'gclid'))) as kept from parts),
made as (select id, u, s || '://' || h || case when port = '' or (s = 'http' and port = '80') or (s = 'https' and port = '443') then '' else ':' || port end || case when bare = '' then '/' else bare end as c,
  array_to_string(list_transform(kept, lambda y: replace(replace(replace(url_encode(y.k), '%20', '+'), '%2A', '*'), '~', '%7E') || '=' || replace(replace(replace(url_encode(y.v), '%20', '+'), '%2A', '*'), '~', '%7E')), '&') as query, s in ('http', 'https') and h <> '' and not contains(a, '@') and not regexp_matches(a, ':[^\]]*[^\d\]]') as good from hosts)
select id, u, good, c as bare_c, case when good then c || case when query = '' then '' else '?' || query end end as c from made""".replace("SOURCE", source)


# ---------------------------------------------------------------- merges and logs

SPLIT = "timestamp '2025-12-01 00:00:00'"


@query(f"""with old as (select distinct * from evidence_records where created_at < {SPLIT}), new as (select distinct * from evidence_records where created_at >= {SPLIT}),
same_scope as (select distinct candidate_id, source_page_id, extraction_version from new), key_new as (select distinct candidate_id, source_page_id, extraction_version, field_name, extracted_value, evidence_locator from new),
kept as (select o.* from old o where not exists (select 1 from same_scope n where n.candidate_id is not distinct from o.candidate_id and n.source_page_id is not distinct from o.source_page_id and n.extraction_version is not distinct from o.extraction_version)
   or exists (select 1 from key_new k where k.candidate_id is not distinct from o.candidate_id and k.source_page_id is not distinct from o.source_page_id and k.extraction_version is not distinct from o.extraction_version and k.field_name is not distinct from o.field_name and k.extracted_value is not distinct from o.extracted_value and k.evidence_locator is not distinct from o.evidence_locator)),
added as (select * from (select n.*, row_number() over (partition by candidate_id, source_page_id, extraction_version, field_name, extracted_value, evidence_locator order by created_at, id) as rn from new n) n where rn = 1 and not exists (select 1 from old o
   where o.candidate_id is not distinct from n.candidate_id and o.source_page_id is not distinct from n.source_page_id and o.extraction_version is not distinct from n.extraction_version and o.field_name is not distinct from n.field_name and o.extracted_value is not distinct from n.extracted_value and o.evidence_locator is not distinct from n.evidence_locator))
select id, 'kept' as change from kept union all select id, 'inserted' from added""")
def evidence_merge(spark, d):
    e = table(spark, d, "evidence_records").distinct()
    early = F.col("created_at") < F.lit("2025-12-01 00:00:00").cast("timestamp_ntz")
    return merge.merge_by_key(e.filter(early), e.filter(~early), [*merge.EVIDENCE_KEY, "extraction_version"], merge.EVIDENCE_SCOPE).select("id", "change")


@query(f"""with old as (select distinct * from evidence_records where created_at < {SPLIT}), new as (select distinct * from evidence_records where created_at >= {SPLIT}),
gone as (select o.id from old o where exists (select 1 from new n where n.candidate_id is not distinct from o.candidate_id and n.source_page_id is not distinct from o.source_page_id and n.extraction_version is not distinct from o.extraction_version)
   and not exists (select 1 from new k where k.candidate_id is not distinct from o.candidate_id and k.source_page_id is not distinct from o.source_page_id and k.extraction_version is not distinct from o.extraction_version and k.field_name is not distinct from o.field_name and k.extracted_value is not distinct from o.extracted_value and k.evidence_locator is not distinct from o.evidence_locator))
select distinct id from conflict_records k where not exists (select 1 from gone g where g.id = k.first_evidence_id or g.id = k.second_evidence_id)""")
def conflicts_after_merge(spark, d):
    """Conflicts left when the evidence that a merge removes takes its own with it."""
    e = table(spark, d, "evidence_records").distinct()
    early = F.col("created_at") < F.lit("2025-12-01 00:00:00").cast("timestamp_ntz")
    removed = merge.removed_by_merge(e.filter(early), e.filter(~early), [*merge.EVIDENCE_KEY, "extraction_version"], merge.EVIDENCE_SCOPE)
    return merge.without_evidence(table(spark, d, "conflict_records"), removed.select("id")).select("id").distinct()


@query(f"""with {RANKED_SQL}, derived as (select distinct candidate_id, field_name, least(first_id, second_id) as a, greatest(first_id, second_id) as b from resolved where outcome = 'conflict'),
kept as (select candidate_id, field_name, a, b, s, v from (select candidate_id, field_name, least(first_evidence_id, second_evidence_id) as a, greatest(first_evidence_id, second_evidence_id) as b, resolution_status as s, resolved_value as v,
  row_number() over (partition by candidate_id, field_name, least(first_evidence_id, second_evidence_id), greatest(first_evidence_id, second_evidence_id) order by resolution_status <> 'unresolved' desc, coalesce(resolution_status, '') desc, coalesce(resolved_value, '') desc) as n from conflict_records) where n = 1)
select candidate_id, field_name, a as evidence_a, b as evidence_b, coalesce(s, 'unresolved') as resolution_status, v as resolved_value from derived left join kept using (candidate_id, field_name, a, b)""")
def conflict_merge(spark, d):
    found = _resolved(spark, d).filter("outcome = 'conflict'")
    return merge.merge_conflicts(table(spark, d, "conflict_records"), found)


@query(f"""select id, max(created_at) as last_created, count(distinct case when created_at < {SPLIT} then 'kept' else 'new' end) as sides from source_pages group by id""")
def page_upsert(spark, d):
    """Pages of before a day, with those of after it upserted."""
    p = table(spark, d, "source_pages")
    early = F.col("created_at") < F.lit("2025-12-01 00:00:00").cast("timestamp_ntz")
    old, new = p.filter(early), p.filter(~early)
    merged = merge.upsert(old, new, ["id"], "created_at")
    both = old.select("id").distinct().join(new.select("id").distinct(), "id").withColumn("both", F.lit(1))
    return merged.join(both, "id", "left").select("id", F.col("created_at").alias("last_created"), (F.lit(1) + F.coalesce("both", F.lit(0))).cast("bigint").alias("sides"))


@query("""select batch_row_id, job_id, canonical_url from (select *, row_number() over (partition by job_id, canonical_url order by submitted_at, batch_row_id) as n from batch_input_rows where canonical_url is not null) where n = 1""")
def first_occurrences(spark, d):
    b = table(spark, d, "batch_input_rows").filter("canonical_url is not null")
    return history.first_occurrences(b, ["job_id", "canonical_url"], ["submitted_at", "batch_row_id"]).select("batch_row_id", "job_id", "canonical_url")


@query(f"""with k as (select distinct c as u from ({_canonical_sql("select id, original_url as u from source_pages union all select id, normalized_url from source_pages")}) where c is not null),
r as (select b.batch_row_id, b.submitted_at, n.c as key, k.u is not null as known from batch_input_rows b left join ({_canonical_sql("select batch_row_id as id, canonical_url as u from batch_input_rows")}) n on n.id = b.batch_row_id left join k on k.u = n.c)
select batch_row_id, case when known then 'already_existing' when key is not null and row_number() over (partition by key, known order by submitted_at, batch_row_id) = 1 then 'candidate' else 'duplicate' end as status from r""")
def emission_status(spark, d):
    p = table(spark, d, "source_pages").select(urls.canonical_url("original_url").alias("a"), urls.canonical_url("normalized_url").alias("b"))
    rows = table(spark, d, "batch_input_rows").withColumn("key", urls.canonical_url("canonical_url"))
    flagged = crawl.known_addresses(rows, "key", p, ["a", "b"])
    return history.emission_status(flagged, "key", F.col("known"), ["submitted_at", "batch_row_id"]).select("batch_row_id", "status")


@query("""with r as (select batch_row_id, submitted_at, coalesce(trim(expected_program_name), '') = '' as hit from batch_input_rows)
select batch_row_id from (select *, sum(hit::int) over (order by submitted_at, batch_row_id rows between unbounded preceding and current row) - hit::int as seen from r) where seen < 25""")
def cut_at_target(spark, d):
    b = table(spark, d, "batch_input_rows")
    return history.cut_at_target(b, F.coalesce(F.trim("expected_program_name"), F.lit("")) == "", ["submitted_at", "batch_row_id"], 25).select("batch_row_id")


@query("""select candidate_id, field_name, arg_max(v, (updated_at, v)) as value from (select distinct id as candidate_id, updated_at, unnest(json_keys(reviewer_overrides)) as field_name, json_extract_string(reviewer_overrides, '$."' || unnest(json_keys(reviewer_overrides)) || '"') as v from candidate_records where json_valid(reviewer_overrides)) group by 1, 2""")
def review_fold(spark, d):
    c = table(spark, d, "candidate_records").filter(F.expr("try_parse_json(reviewer_overrides) is not null"))
    log = c.select(F.col("id").alias("candidate_id"), "updated_at", F.from_json("reviewer_overrides", "map<string,string>").alias("overrides"))
    return history.fold_overrides(log, ["updated_at"])


@query("""select id, review_status, updated_at from (select *, row_number() over (partition by id order by updated_at desc, review_status desc) as n from (select distinct id, review_status, updated_at from candidate_records)) where n = 1""")
def latest_review(spark, d):
    return history.latest(table(spark, d, "candidate_records").select("id", "review_status", "updated_at"), ["id"], ["updated_at", "review_status"])


# ---------------------------------------------------------------- addresses and text


@query(f"select distinct id, c as canonical, case when good then bare_c else substr(split_part(u, '?', 1), 1, 4096) end as safe from ({_canonical_sql('select distinct id, original_url as u from source_pages')})")
def url_canonical(spark, d):
    return table(spark, d, "source_pages").select("id", urls.canonical_url("original_url").alias("canonical"), urls.safe_canonical("original_url").alias("safe")).distinct()


@query("""select distinct id, split_part(original_url, '?', 1) as bare, split_part(split_part(original_url, '#', 1), '?', 1) as plain from source_pages""")
def url_without_query(spark, d):
    return table(spark, d, "source_pages").select("id", urls.without_query("original_url").alias("bare"), urls.without_query_and_fragment("original_url").alias("plain")).distinct()


@query()
def url_problems(spark, d):
    """Of the addresses of batches, pages and uploaded files."""
    uploaded = table(spark, d, "raw_input_records").filter("input_kind = 'batch' and line_no > 1").select(F.explode(F.split("raw_record", "[,;\t]")).alias("u")).filter(F.col("u").contains("//"))
    every = table(spark, d, "batch_input_rows").select(F.col("source_url").alias("u")).unionByName(table(spark, d, "source_pages").select(F.col("original_url").alias("u"))).unionByName(uploaded)
    return every.groupBy(F.coalesce(urls.address_problem("u"), F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""with u as (select distinct id, normalized_url, source_type, lower(regexp_extract(normalized_url, '^\s*[A-Za-z]+://[^/?#]*([^?#]*)', 1)) as p from source_pages),
t as (select *, regexp_matches(p || ' ', '(^|[^\w]|_)(login|account|calendar|news|event|events|privacy|legal|staff|people|publication|publications|contact|search)($|[^\w]|_)') or regexp_matches(p, '\.(pdf|jpg|jpeg|png|gif|zip|doc|docx)$') as bad,
 len(list_intersect(string_split(p, '/'), ['login','account','calendar','news','event','events','privacy','legal','staff','people','publication','publications','contact','search'])) > 0 or regexp_matches(p, '\.(pdf|jpg|jpeg|png|gif|zip|doc|docx)$') as trap,
 list_sort(list_filter(['programme','program','programmes','programs','degree','degrees','study','bachelor','master','msc','bsc','course-of-study','studiengang','studium'], lambda x: contains(p, x))) as hits from u),
s as (select *, case when bad then 0 else least(100, 25 * len(hits) + case when source_type = 'discovery' then 20 else 0 end) end as score from t)
select id, score::int as score, case when bad then 'negative:trap-or-media' else array_to_string(list_filter([case when len(hits) > 0 then 'path:' || array_to_string(hits[1:4], ',') end, case when source_type = 'discovery' then 'catalogue-context' end], lambda x: x is not null), ';') end as signals, score >= 20 as emitted, trap from s""")
def link_scores(spark, d):
    p = table(spark, d, "source_pages").select("id", "normalized_url", "source_type").distinct()
    s = urls.link_score("normalized_url", F.lit(""), F.col("source_type") == "discovery")
    return p.select("id", s["score"].alias("score"), F.array_join(s["signals"], ";").alias("signals"), (s["score"] >= urls.EMIT_SCORE).alias("emitted"), urls.is_trap("normalized_url").alias("trap"))


@query(r"""select s.seed_id, p.id as page_id from (select seed_id, regexp_replace(lower(trim(official_domain)), '\.+$', '') as dom from discovery_seeds where official_domain is not null and trim(official_domain) <> '') s
join (select distinct id, lower(regexp_extract(normalized_url, '^\s*[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)) as h from source_pages) p on p.h = s.dom or ends_with(p.h, '.' || s.dom)""")
def domain_matches(spark, d):
    pages = table(spark, d, "source_pages").select(F.col("id").alias("page_id"), urls.host("normalized_url").alias("host")).distinct()
    seeds = table(spark, d, "discovery_seeds").select("seed_id", F.regexp_replace(F.lower(F.trim("official_domain")), r"\.+$", "").alias("dom")).filter("dom is not null and dom <> ''")
    hit = crawl.match_domains(pages, "host", seeds.select("dom").distinct(), "dom")
    return salted_join(hit, seeds, "dom", F.col("page_id")).select("seed_id", "page_id")


@query(r"""select batch_row_id, case when regexp_matches(operator_notes, '^[=+\-@\t\r]') then '''' || operator_notes else coalesce(operator_notes, '') end as safe, sha256(coalesce(source_url, '')) as url_hash from batch_input_rows""")
def formula_safe(spark, d):
    return table(spark, d, "batch_input_rows").select("batch_row_id", text.formula_safe("operator_notes").alias("safe"), text.content_hash(F.coalesce("source_url", F.lit(""))).alias("url_hash"))


@query(r"""with e as (select distinct id, field_name, extracted_value from evidence_records), c as (select id, field_name, trim(regexp_replace(coalesce(extracted_value, ''), '[\s\x{00A0}]+', ' ', 'g')) as v from e)
select id, substr(v, 1, 2000) as cleaned, trim(substr(trim(field_name || ': ' || v), 1, 500)) as excerpt, replace(replace(replace(replace(replace(substr(v, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as escaped, replace(lower(v), 'ß', 'ss') as folded from c""")
def clean_text(spark, d):
    e = table(spark, d, "evidence_records").select("id", "field_name", "extracted_value").distinct()
    return e.select("id", text.clean_text("extracted_value").alias("cleaned"), text.excerpt("field_name", "extracted_value").alias("excerpt"), text.html_escape(text.clean_text("extracted_value", 200)).alias("escaped"), text.fold_key("extracted_value").alias("folded"))


@query(r"""select distinct id, 'pages/' || substr(sha256(lower(regexp_extract(normalized_url, '^\s*[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1))), 1, 20) || '/' || content_hash || case when lower(coalesce(content_type, '')) like '%text/plain%' then '.txt' else '.html' end as path from source_pages where content_hash is not null""")
def cache_paths(spark, d):
    p = table(spark, d, "source_pages").filter("content_hash is not null").select("id", "normalized_url", "content_hash", "content_type").distinct()
    return p.select("id", text.cache_path(urls.host("normalized_url"), F.col("content_hash"), F.col("content_type")).alias("path"))


@query(r"""select distinct id, case when regexp_matches(v, '(^|\W)(b\.?\s*sc\.?|bachelor( of science)?)($|\W)') then 'bachelor' when regexp_matches(v, '(^|\W)(m\.?\s*sc\.?|master( of science)?)($|\W)') then 'master'
 when regexp_matches(v, '(^|\W)(ph\.?d\.?|doctorate|dr\.?-?ing\.?)($|\W)') then 'phd' end as level from (select id, lower(extracted_value) as v from evidence_records where field_name = 'degree_level')""")
def degree_words(spark, d):
    e = table(spark, d, "evidence_records").filter(F.col("field_name") == "degree_level")
    return e.select("id", values.degree("extracted_value").alias("level")).distinct()


NORMAL_SQL = r"""
folded as (select distinct id, field_name, extracted_value as raw, trim(regexp_replace(extracted_value, '[\s\x{00A0}]+', ' ', 'g')) as v, lower(extracted_value) as low from evidence_records),
named as (select *, nullif(trim(regexp_replace(regexp_replace(v, '^(b\.?\s*sc\.?|m\.?\s*sc\.?|ph\.?d\.?|bachelor( of science)?|master( of science)?)\s*[-–—,:]?\s*', '', 'i'), '\s*[-–—,:]?\s*(b\.?\s*sc\.?|m\.?\s*sc\.?|ph\.?d\.?|bachelor( of science)?|master( of science)?)$', '', 'i')), '') as bare,
 regexp_extract(low, '\b(\d{1,9}|one|two|three|four|five|six)[\s\x{00A0}]+(semester|year|month)s?\b', 1) as num, regexp_extract(low, '\b(\d{1,9}|one|two|three|four|five|six)[\s\x{00A0}]+(semester|year|month)s?\b', 2) as word,
 try_cast(regexp_extract(low, '^\s*p(\d{1,9})([ym])\s*$', 1) as int) as iso, regexp_extract(low, '^\s*p(\d{1,9})([ym])\s*$', 2) as iso_unit from folded),
counted as (select *, coalesce(try_cast(num as int), case num when 'one' then 1 when 'two' then 2 when 'three' then 3 when 'four' then 4 when 'five' then 5 when 'six' then 6 end) as n from named),
normals as (select id, field_name, raw, case field_name
  when 'degree_level' then case when regexp_matches(low, '(^|\W)(b\.?\s*sc\.?|bachelor( of science)?)($|\W)') then 'bachelor' when regexp_matches(low, '(^|\W)(m\.?\s*sc\.?|master( of science)?)($|\W)') then 'master' when regexp_matches(low, '(^|\W)(ph\.?d\.?|doctorate|dr\.?-?ing\.?)($|\W)') then 'phd' end
  when 'program_name' then coalesce(bare, v)
  when 'teaching_language' then case when regexp_matches(low, 'english|englisch') and regexp_matches(low, 'german|deutsch') then 'English and German' when low like '%bilingual%' then 'bilingual' when regexp_matches(low, 'english|englisch') then 'English' when regexp_matches(low, 'german|deutsch') then 'German' end
  when 'study_mode' then case when raw is null then null when regexp_matches(low, 'hybrid|blended') then 'hybrid' when regexp_matches(low, 'online|distance') then 'online' when regexp_matches(lower(v), 'part[- ]time') then 'part_time' when regexp_matches(lower(v), 'full[- ]time') then 'full_time' else 'unknown' end
  when 'country_code' then case when regexp_matches(trim(raw), '^[A-Za-z]{2}$') then upper(trim(raw)) else case lower(trim(raw)) when 'germany' then 'DE' when 'deutschland' then 'DE' when 'netherlands' then 'NL' when 'france' then 'FR' when 'italy' then 'IT' when 'spain' then 'ES' when 'united kingdom' then 'GB' when 'austria' then 'AT' when 'switzerland' then 'CH' end end end as normal,
  case when not starts_with(field_name, 'duration') then null when iso_unit = 'y' then iso when iso_unit = 'm' then case when iso % 6 = 0 then iso // 6 else iso end when word <> '' then n end as amount,
  case when not starts_with(field_name, 'duration') then null when iso_unit = 'y' then 'years' when iso_unit = 'm' then case when iso % 6 = 0 then 'semesters' else 'months' end when word <> '' then word || 's' end as unit,
  case when not starts_with(field_name, 'duration') then null when iso_unit = 'y' then iso * 2 when iso_unit = 'm' then case when iso % 6 = 0 then iso // 6 end when word = 'semester' then n when word = 'year' then n * 2 end as semesters from counted)"""


@query(f"with {NORMAL_SQL} select id, normal, amount::int as amount, unit, semesters::int as semesters from normals")
def normal_forms(spark, d):
    e = table(spark, d, "evidence_records").select("id", "field_name", "extracted_value").distinct()
    v, f = F.col("extracted_value"), F.col("field_name")
    norm = F.when(f == "degree_level", values.degree(v)).when(f == "program_name", values.program_name(v)).when(f == "teaching_language", values.teaching_language(v)).when(f == "study_mode", values.study_mode(v)).when(f == "country_code", values.country(v))
    dur = F.when(f.startswith("duration"), values.duration(v))
    return e.select("id", norm.alias("normal"), dur["value"].alias("amount"), dur["unit"].alias("unit"), dur["semesters"].alias("semesters"))


@query("""select distinct id, case when has_en and has_de then 'English and German' when v like '%bilingual%' then 'bilingual' when has_en then 'English' when has_de then 'German' end as language
from (select id, lower(extracted_value) as v, regexp_matches(lower(extracted_value), 'english|englisch') as has_en, regexp_matches(lower(extracted_value), 'german|deutsch') as has_de from evidence_records where field_name = 'teaching_language')""")
def language_forms(spark, d):
    e = table(spark, d, "evidence_records").filter("field_name = 'teaching_language'")
    return e.select("id", values.teaching_language("extracted_value").alias("language")).distinct()


@query(r"""select distinct id, case when m like '%hybrid%' or m like '%blended%' then 'hybrid' when m like '%online%' or m like '%distance%' then 'online' when m like '%part time%' then 'part_time' when m like '%full time%' then 'full_time' else 'unknown' end as mode
from (select id, replace(lower(trim(regexp_replace(extracted_value, '\s+', ' ', 'g'))), '-', ' ') as m from evidence_records where field_name = 'study_mode' and extracted_value is not null)""")
def study_mode_forms(spark, d):
    e = table(spark, d, "evidence_records").filter("field_name = 'study_mode' and extracted_value is not null")
    return e.select("id", values.study_mode("extracted_value").alias("mode")).distinct()


@query(r"""with o as (select id as candidate_id, unnest(json_keys(reviewer_overrides)) as field_name, reviewer_overrides as j from candidate_records where json_valid(reviewer_overrides)),
r as (select distinct candidate_id, field_name, trim(json_extract_string(j, '$."' || field_name || '"')) as v from o),
n as (select *, lower(v) as low, case when regexp_matches(lower(v), '(^|\W)(b\.?\s*sc\.?|bachelor( of science)?)($|\W)') then 'bachelor' when regexp_matches(lower(v), '(^|\W)(m\.?\s*sc\.?|master( of science)?)($|\W)') then 'master' when regexp_matches(lower(v), '(^|\W)(ph\.?d\.?|doctorate|dr\.?-?ing\.?)($|\W)') then 'phd' end as degree,
 case when regexp_matches(lower(v), 'english|englisch') and regexp_matches(lower(v), 'german|deutsch') then 'English and German' when lower(v) like '%bilingual%' then 'bilingual' when regexp_matches(lower(v), 'english|englisch') then 'English' when regexp_matches(lower(v), 'german|deutsch') then 'German' end as language,
 case when regexp_matches(v, '^[A-Za-z]{2}$') then upper(v) else case lower(v) when 'germany' then 'DE' when 'deutschland' then 'DE' when 'netherlands' then 'NL' when 'france' then 'FR' when 'italy' then 'IT' when 'spain' then 'ES' when 'united kingdom' then 'GB' when 'austria' then 'AT' when 'switzerland' then 'CH' end end as country,
 case when regexp_matches(lower(v), 'hybrid|blended') then 'hybrid' when regexp_matches(lower(v), 'online|distance') then 'online' when regexp_matches(lower(v), 'part[- ]time') then 'part_time' when regexp_matches(lower(v), 'full[- ]time') then 'full_time' end as mode from r),
c as (select candidate_id, field_name, v, case field_name when 'degree_level' then degree when 'teaching_language' then language when 'country_code' then country when 'study_mode' then mode
  when 'duration_value' then case when regexp_matches(v, '^0*[1-9][0-9]{0,8}$') then v end when 'duration_semesters' then case when regexp_matches(v, '^0*[1-9][0-9]{0,8}$') then v end
  when 'application_url' then case when regexp_matches(v, '^https?://[^/?#\s@]+', 'i') then v end when 'source_url' then case when regexp_matches(v, '^https?://[^/?#\s@]+', 'i') then v end else v end as good,
  case when field_name in ('degree_level', 'teaching_language', 'country_code', 'study_mode') then 'value' when field_name in ('duration_value', 'duration_semesters') then 'number' else 'url' end as complaint from n)
select candidate_id, field_name, case when v is null or length(v) > 2000 then false when v = '' then true else good is not null end as ok, case when v is null or length(v) > 2000 then null when v = '' then '' else good end as value,
 case when v is null or length(v) > 2000 then 'length' when v = '' then null when good is null then complaint end as error from c""")
def override_checks(spark, d):
    rows = layers.json_layer(table(spark, d, "candidate_records"), "reviewer_overrides", layers.OVERRIDE)
    got = values.checked_override("field_name", "value")
    return rows.select("candidate_id", "field_name", got["ok"].alias("ok"), got["value"].alias("value"), got["error"].alias("error"))


@query(r"""select distinct id, case when regexp_matches(trim(extracted_value), '^[A-Za-z]{2}$') then upper(trim(extracted_value)) end as code from evidence_records where field_name = 'country_code'""")
def country_codes(spark, d):
    return table(spark, d, "evidence_records").filter("field_name = 'country_code'").select("id", text.country_code("extracted_value").alias("code")).distinct()


@query(r"""select batch_row_id, coalesce(regexp_full_match(operator_notes, '[\p{L}0-9][\p{L}0-9 ._-]{0,79}'), false) as is_label, coalesce(regexp_full_match(batch_run_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') and not contains(batch_run_id, '..'), false) as is_output_name from batch_input_rows""")
def label_checks(spark, d):
    return table(spark, d, "batch_input_rows").select("batch_row_id", text.is_label("operator_notes").alias("is_label"), text.is_output_name("batch_run_id").alias("is_output_name"))


@query(r"""select seed_id, coalesce(length(official_domain) <= 253 and regexp_full_match(lower(official_domain), '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}'), false) as is_host from discovery_seeds""")
def host_checks(spark, d):
    return table(spark, d, "discovery_seeds").select("seed_id", urls.is_host_name("official_domain").alias("is_host"))


@query(r"""select distinct id, case when error_code in ('timeout', 'network_error') then error_code when http_status in (401, 403) then 'access_blocked' when http_status = 429 then 'rate_limited' when http_status is null or http_status < 200 or http_status > 299 then 'http_error'
 when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) not in ('text/html', 'application/xhtml+xml', 'text/plain', 'application/xml', 'text/xml') then 'unsupported_content_type' when response_bytes > 5242880 then 'response_too_large' else 'fetched' end as outcome,
 coalesce(http_status in (408, 429, 500, 502, 503, 504), false) or coalesce(error_code = 'timeout', false) as transient from source_pages""")
def fetch_outcomes(spark, d):
    p = table(spark, d, "source_pages")
    error = F.when(F.col("error_code").isin("timeout", "network_error"), F.col("error_code"))
    kind = fetchlog.outcome(F.col("http_status"), F.col("content_type"), F.col("response_bytes"), error)
    return p.select("id", kind.alias("outcome"), fetchlog.is_transient(F.col("http_status"), error).alias("transient")).distinct()


# ---------------------------------------------------------------- groups, rates, contracts


@query(r"""select u || ' | ' || p as group_key, count(*) as members, min(id) as smallest_id from (select distinct batch_row_id as id,
 replace(lower(trim(regexp_replace(expected_university_name, '[\s\x{00A0}]+', ' ', 'g'))), 'ß', 'ss') as u, replace(lower(trim(regexp_replace(expected_program_name, '[\s\x{00A0}]+', ' ', 'g'))), 'ß', 'ss') as p from batch_input_rows)
 where u <> '' and p <> '' group by u, p having count(*) > 1""")
def duplicate_groups(spark, d):
    return groups.duplicate_groups(table(spark, d, "batch_input_rows"), "batch_row_id", [F.col("expected_university_name"), F.col("expected_program_name")])


@query("""select count(*) filter (where fetch_status = 'fetched') as fetched, count(*) filter (where http_status >= 400) as http_errors, count(*) filter (where cached_file_path is null) as uncached, count(*) filter (where redirect_count > 0) as redirected from source_pages""")
def run_counters(spark, d):
    p = table(spark, d, "source_pages")
    return groups.counters(p, {"fetched": F.col("fetch_status") == "fetched", "http_errors": F.col("http_status") >= 400, "uncached": F.col("cached_file_path").isNull(), "redirected": F.col("redirect_count") > 0})


@query("""select round(avg(case when fetch_status = 'fetched' then 1.0 else 0.0 end), 6) as fetch_rate, round(avg(case when official_domain then 1.0 else 0.0 end), 6) as official_rate, round(avg(redirect_count::double), 6) as mean_redirects from source_pages""")
def pilot_rates(spark, d):
    p = table(spark, d, "source_pages")
    return groups.rates(p, {"fetch_rate": F.col("fetch_status") == "fetched", "official_rate": F.col("official_domain")}, {"mean_redirects": F.col("redirect_count")})


@query("""select error_code, count(*) as n from source_pages where error_code is not null and trim(error_code) <> '' group by 1""")
def failure_categories(spark, d):
    return groups.failures_by_category(table(spark, d, "source_pages"), "error_code")


# What a programme's row must hold, as a contract.
PROGRAMMES = contract.Entity("programmes", ["program_name", "university_name", "country_code", "degree_level", "application_url", "status"], required=["program_name", "university_name"], conditional={"approved": ["application_url", "degree_level"]}, allowed={"degree_level": ["bachelor", "master", "phd"]}, urls=["application_url"], status_column="status")


@query("""with c as (select id, normalized_data as j, review_status as status, row_number() over (partition by id order by updated_at desc, normalized_data desc) as n from candidate_records where id is not null and json_valid(normalized_data)),
r as (select id, status, json_extract_string(j, '$.program_name') as program_name, json_extract_string(j, '$.university_name') as university_name, json_extract_string(j, '$.country_code') as country_code, json_extract_string(j, '$.degree_level') as degree_level, json_extract_string(j, '$.application_url') as application_url from c where n = 1)
select distinct * from (select id, 'required' as rule, 'program_name' as "column" from r where trim(coalesce(program_name, '')) = '' union all select id, 'required', 'university_name' from r where trim(coalesce(university_name, '')) = ''
 union all select id, 'conditional', 'application_url' from r where status = 'approved' and trim(coalesce(application_url, '')) = '' union all select id, 'conditional', 'degree_level' from r where status = 'approved' and trim(coalesce(degree_level, '')) = ''
 union all select id, 'allowed', 'degree_level' from r where trim(coalesce(degree_level, '')) <> '' and degree_level not in ('bachelor', 'master', 'phd') union all select id, 'url', 'application_url' from r where trim(coalesce(application_url, '')) <> '' and not regexp_matches(application_url, '^(?i:https?)://[^/?#\\s]+')
 union all select min(id), 'duplicate', '*' from r group by program_name, university_name, country_code, degree_level, application_url, status having count(*) > 1)""")
def contract_violations(spark, d):
    c = table(spark, d, "candidate_records").filter("id is not null").filter(F.expr("try_parse_json(normalized_data) is not null"))
    last = c.groupBy("id").agg(F.max_by(F.struct(F.col("normalized_data").alias("j"), F.col("review_status").alias("status")), F.struct("updated_at", "normalized_data")).alias("r"))
    rows = last.select("id", *[F.get_json_object("r.j", f"$.{f}").alias(f) for f in PROGRAMMES.columns[:-1]], F.col("r.status").alias("status"))
    return contract.violations(rows, PROGRAMMES, "id")


SOURCE_TARGETS = {"official_program": "program", "official_admissions": "program", "official_fees": "cost", "official_deadlines": "program", "official_scholarship": "scholarship", "official_government": "country", "other_official": "other"}


@query("""select source_type as target, unmapped, count(*) as n from (select case source_type when 'official_program' then 'program' when 'official_admissions' then 'program' when 'official_fees' then 'cost' when 'official_deadlines' then 'program' when 'official_scholarship' then 'scholarship' when 'official_government' then 'country' when 'other_official' then 'other' end as source_type,
 source_type is not null and source_type not in ('official_program','official_admissions','official_fees','official_deadlines','official_scholarship','official_government','other_official') as unmapped from source_pages) group by 1, 2""")
def value_mapping(spark, d):
    return contract.map_values(table(spark, d, "source_pages").select("source_type"), "source_type", SOURCE_TARGETS).groupBy(F.col("source_type").alias("target"), "unmapped").agg(F.count(F.lit(1)).alias("n"))


def _csv_cell(c: str) -> str:
    safe = rf"(case when regexp_matches({c}, '^[=+\-@\t\r]') then chr(39) || {c} else coalesce({c}, '') end)"
    return rf"""(case when regexp_matches({safe}, '[",\r\n]') then '"' || replace({safe}, '"', '""') || '"' else {safe} end)"""


@query(f"""with l as (select {" || ',' || ".join(map(_csv_cell, ("source_url", "expected_university_name", "expected_program_name", "operator_notes")))} as line from batch_input_rows)
select count(*) as record_count, sha256('source_url,expected_university_name,expected_program_name,operator_notes|' || count(*) || '|' || coalesce(sum(('0x' || substr(sha256(line), 1, 15))::hugeint), 0)) as digest from l""")
def export_digests(spark, d):
    c = table(spark, d, "batch_input_rows")
    columns = ["source_url", "expected_university_name", "expected_program_name", "operator_notes"]
    return sinks.file_digest(sinks.csv_lines(c, columns), ",".join(columns))


# ---------------------------------------------------------------- pages and joins


@query("""select p.id, case when p.cached_file_path is null or p.content_hash is null then 'missing_cache_metadata' when c.cached_file_path is null then 'cache_missing' when sha256(c.page_text) <> p.content_hash then 'cache_hash_mismatch' else 'ok' end as state from (select distinct id, cached_file_path, content_hash from source_pages) p left join cached_pages c using (cached_file_path)""")
def source_integrity(spark, d):
    """The copies here are texts of pages, not the bytes that were hashed (COVERAGE.md)."""
    return fetchlog.source_integrity(table(spark, d, "source_pages"), table(spark, d, "cached_pages").withColumnRenamed("page_text", "content"))


@query("""select distinct p.id from source_pages p join cached_pages c using (cached_file_path) where p.fetch_status in ('fetched', 'cache_hit') and p.cache_expires_at > timestamp '2025-06-01 00:00:00' and sha256(c.page_text) = p.content_hash""")
def cache_hits(spark, d):
    p, kept = table(spark, d, "source_pages"), table(spark, d, "cached_pages").withColumnRenamed("page_text", "content")
    return fetchlog.cache_hits(p, kept, F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).select("id").distinct()


@query("""with x as (select distinct k.id as conflict_id, a.id as a, a.confidence as ca, b.id as b, b.confidence as cb from conflict_records k join evidence_records a on a.id = k.first_evidence_id join evidence_records b on b.id = k.second_evidence_id) select ca as first_confidence, cb as second_confidence, count(*) as n from x group by 1, 2""")
def conflict_sides(spark, d):
    e = table(spark, d, "evidence_records").select("id", "confidence").distinct()
    k = table(spark, d, "conflict_records").select(F.col("id").alias("conflict_id"), "first_evidence_id", "second_evidence_id").distinct()
    a = e.select(F.col("id").alias("first_evidence_id"), F.col("confidence").alias("first_confidence"))
    b = e.select(F.col("id").alias("second_evidence_id"), F.col("confidence").alias("second_confidence"))
    return k.join(a, "first_evidence_id").join(b, "second_evidence_id").groupBy("first_confidence", "second_confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive e as (select distinct c.source_page_id as src, c2.source_page_id as dst from (select distinct job_id, source_page_id, row_number() over (partition by job_id order by source_page_id) as n from (select distinct job_id, source_page_id from candidate_records where source_page_id is not null)) c
 join (select distinct job_id, source_page_id, row_number() over (partition by job_id order by source_page_id) as n from (select distinct job_id, source_page_id from candidate_records where source_page_id is not null)) c2 on c2.job_id = c.job_id and c2.n = c.n + 1),
s as (select job_id as root, min(source_page_id) as node from candidate_records where source_page_id is not null and job_id is not null group by 1),
w as (select root, node, 0 as depth from s union select w.root, e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 3)
select root, node, min(depth) as depth from w group by 1, 2""")
def link_walk(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "candidate_records").select("job_id", "source_page_id").filter("source_page_id is not null").distinct()
    n = c.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("source_page_id")))
    edges = n.select("job_id", "n", F.col("source_page_id").alias("src")).join(n.select("job_id", (F.col("n") - 1).alias("n"), F.col("source_page_id").alias("dst")), ["job_id", "n"]).select("src", "dst")
    seeds = c.filter("job_id is not null").groupBy(F.col("job_id").alias("root")).agg(F.min("source_page_id").alias("node")).withColumn("catalogue", F.lit(False))
    return crawl.walk(seeds, edges, 3).select("root", "node", "depth")


@query()
def discovered_links(spark, d):
    """What discovery emits where each seed's catalogue links the pages of its domain, those of before a day being known."""
    from pyspark.sql import Window

    seeds = table(spark, d, "discovery_seeds").withColumn("dom", F.regexp_replace(F.lower(F.trim("official_domain")), r"\.+$", "")).filter("dom <> ''")
    starts = seeds.groupBy("dom").agg(F.min(F.coalesce("catalogue_url", F.concat(F.lit("https://"), "dom", F.lit("/")))).alias("page_url"))
    pages = table(spark, d, "source_pages").filter("original_url is not null").groupBy("original_url").agg(F.min("created_at").alias("at")).withColumn("host", urls.host("original_url"))
    shown = crawl.match_domains(pages, "host", starts.select("dom"), "dom").join(starts, "dom")
    links = shown.select("page_url", F.col("original_url").alias("target"), F.lit("").alias("text"), (F.row_number().over(Window.partitionBy("page_url").orderBy("at", "original_url")) - 1).alias("ord"))
    known = pages.filter(F.col("at") < F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).select(F.col("original_url").alias("normalized_url"))
    return stages.discover(links, seeds.drop("dom"), known, 2, 1000)


@query()
def html_facts(spark, d):
    """Facts of the kept pages, wrapped as labelled lines of an HTML page."""
    pages = table(spark, d, "cached_pages").select(F.col("cached_file_path").alias("page_url"), F.concat(F.lit("<body><div>"), F.replace(text.html_escape("page_text"), F.lit("\n"), F.lit("<br>\n")), F.lit("</div></body>")).alias("html"))
    return facts.suggestions(facts.html_facts(pages)).select("page_url", "field_name", "locator", "extracted_value", "normalized_value", "confidence")


@query("""select e.candidate_id, count(*) as evidence from (select distinct id, candidate_id from evidence_records) e where exists (select 1 from candidate_records c where c.id = e.candidate_id) and not exists (select 1 from conflict_records k where k.first_evidence_id = e.id or k.second_evidence_id = e.id) group by 1""")
def unconflicted_evidence(spark, d):
    e = table(spark, d, "evidence_records").select("id", "candidate_id").distinct()
    k = table(spark, d, "conflict_records")
    named = k.select(F.col("first_evidence_id").alias("id")).unionByName(k.select(F.col("second_evidence_id").alias("id"))).distinct()
    c = table(spark, d, "candidate_records").select(F.col("id").alias("candidate_id")).distinct()
    return e.join(c, "candidate_id", "left_semi").join(named, "id", "left_anti").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("evidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
