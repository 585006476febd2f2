"""Queries over listings, filtered search, scopes, owners and activity of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import answers, sources
from tidemark.operators.lineage import stored
from tidemark.operators.paging import page
from tidemark.plans import textual
from tidemark.plans.bindings import observations, table


def list_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("course_key"), "o_orderdate")
    courses = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("course_key"))
    found, order = answers.listing(rows, "key", courses)
    return page(found, order, 100)


_STATES = "when 0 then 'ACTIVE' when 1 then 'UNAVAILABLE' else 'UNKNOWN' end"


def list_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subtype"), F.expr(f"case p_size % 3 {_STATES}").alias("availability"))
    found, order = answers.listing(rows, "p_partkey", subtype=("ECONOMY", "STANDARD"), availability=("ACTIVE", "UNKNOWN"))
    return found.orderBy(*order)


def select_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_key"), F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("UNAVAILABLE").alias("availability"))
    return answers.select_courses(courses, table(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.col("o_custkey").alias("course_key")))


def mark_assessment_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.when(F.col("p_size") % 4 == 0, F.concat("p_type", F.lit("-Asmt-link"))).otherwise(F.col("p_type")).alias("handler"))
    assessments = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_partkey").alias("content_id"))
    return answers.mark_assessment_content(content, assessments)


def _search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.selectExpr(*(f"{sql} as {name}" for name, sql in _DOCUMENT.items()), "text")


#: The columns of a search document, the same in Spark and in SQL; {div} is whole division by 8.
_DOCUMENT = {
    "doc_id": "doc_id",
    "entity_kind": "case doc_id % 4 when 0 then 'material' when 1 then 'content' when 2 then 'chunk' else 'claim' end",
    "semantic_type": "lang",
    "file_format": "case doc_id % 5 when 0 then 'pdf' else 'html' end",
    "availability": "case when n_chars > 300 then 'ACTIVE' else 'MISSING' end",
    "text_origin": "case doc_id % 3 when 0 then 'native' when 1 then 'derived:ocr' else 'derived:visual' end",
    "course_key": "source",
    "resource_key": "cast(floor(doc_id / 8) as bigint)",
    "version_key": "case when doc_id % 8 < 6 then doc_id % 2 end",
    "chunk_key": "doc_id % 8",
    "entity_key": "doc_id",
    "source_key": "doc_id",
    "confidence": "quality / 5.0",
}
_DOCUMENTS = "found as (select " + ", ".join(f"{sql} as {name}" for name, sql in _DOCUMENT.items()) + """ from documents left join labels using (doc_id)),
  versions as (select resource_key, max(version_key) as current_version from found group by 1)"""


def _current(docs: DataFrame) -> DataFrame:
    return docs.groupBy("resource_key").agg(F.max("version_key").alias("current_version"))


def filtered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _search_documents(spark, sf_dir)
    filters = answers.Filters(entity_kinds=("material", "chunk"), semantic_types=("en", "de", "fr"), file_formats=("html",), availabilities=("ACTIVE",), origins=("native", "derived"), min_confidence=0.2)
    return answers.apply_filters(docs, filters, _current(docs)).select("doc_id", "resource_key", "version_key", "text_origin")


def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _search_documents(spark, sf_dir)
    filters = answers.Filters(entity_kinds=("material", "chunk", "content"), origins=("derived",))
    passing = stored(answers.apply_filters(docs.drop("text"), filters, _current(docs)))
    scored = textual.rounded_scores(spark, sf_dir, k=6, only=passing.select(F.col("doc_id").alias("key")))  # one more tells whether a page is cut
    hits = stored(answers.search_page(scored, passing, filters, None, 5))
    found = answers.with_neighbors(hits, docs.select("resource_key", "chunk_key", "text"))
    near = F.array_join(F.transform("neighbors", lambda x: F.concat_ws(":", x["at"], F.length(x["near_text"]))), ",")
    return found.select("query_id", "doc_id", "rank", "rank_score", "truncated", near.alias("neighbors"))


def hit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 3
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.when(turn == 0, "event").when(turn == 1, "claim").otherwise("chunk").alias("entity_kind"), (F.col("conv_id") + F.col("turn")).alias("entity_key"))
    claims = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_key"), F.when(F.col("doc_id") % 5 > 0, F.expr("doc_id div 3")).alias("event_key"))
    return answers.hit_events(hits, claims).select("query_id", F.array_join("events", ",").alias("events"), "unresolved")


def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_key"))
    resources = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("course_key"), F.col("o_orderkey").alias("resource_key"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderkey")).alias("version_key"))
    day = F.dayofyear("l_shipdate")
    parses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_key"), F.col("l_shipdate").alias("parsed_at"), F.col("l_linenumber").alias("parse_key"), F.when(day % 40 == 0, "UNSUPPORTED").otherwise("SUCCEEDED").alias("status"), F.when(day % 10 == 1, "PARTIAL").when(day % 50 == 2, "FAILED").otherwise("COMPLETE").alias("coverage"))
    return answers.text_coverage(courses, resources, parses)


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("provider"), F.col("c_custkey").alias("course_key"))


def query_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.search_scopes(_courses(spark, sf_dir), ("material", "announcement", "course"))


def event_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.event_scopes(_courses(spark, sf_dir)).select("provider", "course_key", "scope", "coverage")


def time_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = F.col("o_orderpriority").startswith("5")
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_key"), F.col("o_orderdate").alias("low"), F.when(~vague, F.col("o_orderdate")).alias("high"))
    return answers.time_coverage(events)


def observation_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("observation_key"), F.col("user_id").alias("source_key"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_key"), F.col("c_nationkey").alias("course_key"))
    names = {"announcement": 2, "assessment": 3, "schedule_item": 5, "due_item": 7}
    return sources.observation_owner(seen, {name: customers.where(F.col("source_key") % n == 0) for name, n in names.items()})


def work_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    work = table(spark, sf_dir, "orders").select(key.alias("work_key"), F.when(key % 3 == 0, customer).alias("course_key"), F.when(key % 3 == 1, customer).alias("version_key"), F.when(key % 5 > 0, customer).alias("observation_key"))
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_key"), F.col("c_nationkey").cast("long").alias("course_key"))
    observed = table(spark, sf_dir, "events").select(F.col("event_id").alias("observation_key"), F.col("user_id").alias("course_key"))
    return sources.work_owner(work, versions, observed).select("work_key", "owner")


def _activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with their activity, claims, and active decisions."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as claim_key", "l_orderkey as source_key", "case when l_linenumber % 4 = 0 then 'LOCAL_DECISION' else 'SOURCE' end as origin", "l_discount", "l_tax", "l_returnflag")
    decisions = lines.selectExpr("case when l_discount > 0.095 and origin = 'SOURCE' then claim_key end as selected_claim", "case when l_tax > 0.065 and origin = 'LOCAL_DECISION' then claim_key end as local_claim", "source_key").where("selected_claim is not null or local_claim is not null")
    all_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_key"), F.col("o_custkey").alias("candidate_key"))
    effective = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("candidate_key"))
    bound = lines.where("l_returnflag = 'R' and l_tax < 0.015").select("source_key")
    return sources.active_sources(all_, effective, bound, decisions.where("selected_claim is not null").select("source_key")), lines.select("claim_key", "source_key", "origin").distinct(), decisions


def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir)[0]


def active_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, claims, decisions = _activity(spark, sf_dir)
    return sources.active_claims(claims, active, decisions)


def list_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, claims, decisions = _activity(spark, sf_dir)
    return sources.list_claims(claims, active, decisions)


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = active_sources(spark, sf_dir).withColumnRenamed("candidate_key", "course_key")
    courses = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("course_key"))
    found, order = sources.list_records(rows, "source_key", courses)
    return page(found, order, 200)


def event_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("source_key"), (F.col("l_quantity") / 50).alias("confidence"))
    return sources.event_confidence(claims).withColumn("confidence", F.round("confidence", 6))


def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(key.alias("source_key"), F.when(key % 3 == 0, "ASSESSMENT").when(key % 3 == 1, "DUE_ITEM").otherwise("DOCUMENT").alias("kind"), F.when(key % 3 < 2, F.col("o_custkey")).alias("object_key"), key.alias("locator_key"))
    customers = table(spark, sf_dir, "customer")
    assessments = customers.select(F.col("c_custkey").alias("object_key"), F.col("c_nationkey").alias("content_key"), F.col("c_name").alias("remote_key"))
    due = customers.select(F.col("c_custkey").alias("object_key"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("item_source"))
    contents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("locator_key")).agg(F.min("l_partkey").alias("content_key"))
    return sources.source_context(found, assessments, due, contents).select("source_key", F.array_join("context", ",").alias("context"))


def changed_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course_key"), F.col("doc_id").alias("input_key"), F.md5("text").alias("content_hash"))
    before = docs.withColumn("content_hash", F.when(F.col("input_key") % 97 == 5, "other").otherwise(F.col("content_hash")))
    return sources.changed_courses(docs, sources.input_hashes(before)).select("course_key")


def unresolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as course_key", "case when o_orderstatus <> 'P' then o_orderkey end as event_id", "case when o_orderpriority like '1%' then 'UNRESOLVED' else 'RESOLVED' end as state", "o_orderkey % 4 > 0 as active")
    return sources.unresolved(rows)


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir).select("run_key", "availability", F.col("observation_status").alias("status"), F.when(F.col("version_key") < 20, "FAILED").otherwise("SUCCEEDED").alias("outcome"))
    return sources.run_counts(seen)


def semantic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.col("o_orderkey") % 2 == 0
    value = F.when(dated, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.semantic_value(F.when(dated, "due_time").otherwise("location"), value).alias("value"))


_RECORD = """'{"term": ' || case c_custkey % 5 when 0 then '"  "' when 1 then '"' || c_mktsegment || '"' when 2 then '{"name": "' || c_name || '"}' when 3 then '{"name": 5, "displayName": "' || c_name || '"}' else '7' end
  || ', "isAvailable": ' || case c_custkey % 4 when 0 then 'true' when 1 then 'false' when 2 then '"true"' else 'null' end || ', "visibility": "' || case c_custkey % 3 when 0 then 'Visible' when 1 then 'HIDDEN' else 'odd' end || '"}'"""


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RECORD).alias("body"))
    typed = lambda path, kind: values.json_typed(F.col("body"), path, kind)
    return body.select("c_custkey", values.term(F.col("body")).alias("term"), values.availability(typed("$.isAvailable", "boolean")).alias("availability"), values.visibility(typed("$.visibility", "string")).alias("visibility"))


def denormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_key"), F.col("n_name").alias("provider"))
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_key"), F.col("c_nationkey").alias("object_key"))
    content = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("content_key"), F.col("o_custkey").alias("course_key"))
    resources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("content_key"), "l_linenumber", "l_partkey")
    return sources.denormalised(objects, courses, content, resources).select("content_key", "l_linenumber", "l_partkey", "course_key", "provider")


QUERIES = [
    list_announcements, list_assessments, select_courses, mark_assessment_content, filtered_hits, search_full, hit_events, text_coverage, query_scopes,
    event_scopes, time_coverage, observation_owner, work_owner, active_sources, active_claims, list_claims, list_sources, event_confidence, source_context, changed_courses,
    unresolved_events, run_counts, semantic_values, record_values, denormalised,
]

_ACTIVITY = """
  lines as (select l_orderkey * 10 + l_linenumber as claim_key, l_orderkey as source_key, case when l_linenumber % 4 = 0 then 'LOCAL_DECISION' else 'SOURCE' end as origin, * from lineitem),
  picks as (select distinct claim_key, source_key from lines where l_discount > 0.095 and origin = 'SOURCE'),
  locals as (select distinct claim_key from lines where l_tax > 0.065 and origin = 'LOCAL_DECISION'),
  judged as (select o_orderkey as source_key, o_custkey as candidate_key,
    o_custkey in (select c_custkey from customer where c_acctbal > 5000) or o_orderkey in (select source_key from lines where l_returnflag = 'R' and l_tax < 0.015) or o_orderkey in (select source_key from picks) as active from orders)"""

ORACLE = {
    "list_announcements": """select o_orderkey as key, o_custkey as course_key, o_orderdate, row_number() over (order by o_orderkey desc) as position, count(*) over () > 100 as truncated
from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'FURNITURE') qualify position <= 100""",
    "list_assessments": f"select * from (select p_partkey, p_type as subtype, case p_size % 3 {_STATES} as availability from part) where subtype in ('ECONOMY', 'STANDARD') and availability <> 'UNAVAILABLE'",
    "select_courses": "select c_custkey as course_key, 'ACTIVE' as availability from customer where c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_orderpriority < '3')",
    "mark_assessment_content": """select p_partkey as content_id, case when p_size % 4 = 0 then p_type || '-Asmt-link' when p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 25) then 'assessment:' || p_type else p_type end as handler from part""",
    "filtered_hits": f"""with {_DOCUMENTS}
select doc_id, resource_key, version_key, text_origin from found left join versions using (resource_key)
where entity_kind in ('material', 'chunk') and semantic_type in ('en', 'de', 'fr') and file_format = 'html' and availability = 'ACTIVE' and confidence >= 0.2 and (version_key is null or version_key = current_version)""",
    "search_full": f"""with {textual._SCORED}, {_DOCUMENTS},
  hits as (
    select query_id, found.*, rank_score, row_number() over (partition by query_id order by rank_score, case entity_kind when 'content' then 2 when 'material' then 3 else 4 end, course_key, resource_key, coalesce(version_key, 0), chunk_key, text_origin, doc_id) as rank,
      count(*) over (partition by query_id) > 5 as truncated
    from scored join found using (doc_id) join versions using (resource_key)
    where entity_kind <> 'claim' and text_origin like 'derived:%' and (version_key is null or version_key = current_version))
select h.query_id, h.doc_id, any_value(rank) as rank, any_value(rank_score) as rank_score, any_value(truncated) as truncated,
  string_agg(concat_ws(':', f.chunk_key, length(d.text)), ',' order by f.chunk_key) as neighbors
from hits h join found f on f.resource_key = h.resource_key and abs(f.chunk_key - h.chunk_key) <= 1 join documents d on d.doc_id = f.doc_id where rank <= 5 group by 1, 2""",
    "hit_events": """with h as (select conv_id as query_id, turn % 3 as kind, conv_id + turn as key from conversations),
  c as (select doc_id as key, case when doc_id % 5 > 0 then doc_id // 3 end as event from documents)
select query_id, coalesce(array_to_string(list_sort(list(distinct case when kind = 0 then h.key else event end) filter (kind = 0 or event is not null)), ','), '') as events,
  bool_or(kind = 1 and event is null) as unresolved
from h left join c on c.key = h.key where kind < 2 group by 1""",
    "text_coverage": """with p as (select l_orderkey, arg_max(dayofyear(l_shipdate), (l_shipdate, l_linenumber)) as d from lineitem group by 1),
  r as (select o_custkey, max(case when o_orderkey % 50 = 0 or d is null or d % 40 = 0 then 3 when d % 10 = 1 then 2 when d % 50 = 2 then 4 else 0 end) as worst from orders left join p on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1)
select c_custkey as course_key, case coalesce(worst, 0) when 0 then 'COMPLETE' when 2 then 'PARTIAL' when 3 then 'UNKNOWN' else 'FAILED' end as coverage from customer left join r on c_custkey = o_custkey""",
    "query_scopes": "select c_mktsegment as provider, c_custkey as course_key, unnest(['content', 'announcements']) as scope from customer union all select distinct c_mktsegment, null, 'courses' from customer",
    "event_scopes": """select provider, course_key, scope, case when scope in ('schedule', 'due_items') then 'UNKNOWN' end as coverage
from (select c_mktsegment as provider, c_custkey as course_key, unnest(['content', 'announcements', 'assessments', 'schedule', 'due_items']) as scope from customer)""",
    "time_coverage": "select o_custkey as course_key, count(*) as unbounded, 'PARTIAL' as coverage from orders where o_orderpriority like '5%' group by 1",
    "observation_owner": "select event_id as observation_key, c_nationkey as course_key from events join customer on c_custkey = user_id where user_id % 2 = 0 or user_id % 3 = 0 or user_id % 5 = 0 or user_id % 7 = 0",
    "work_owner": """select o_orderkey as work_key, coalesce(case when o_orderkey % 3 = 0 then o_custkey end, c_nationkey, user_id) as owner
from orders left join customer on o_orderkey % 3 = 1 and c_custkey = o_custkey left join events on o_orderkey % 5 > 0 and event_id = o_custkey""",
    "active_sources": f"with {_ACTIVITY} select * from judged",
    "active_claims": f"""with {_ACTIVITY}
select distinct claim_key, source_key, origin from lines
where origin = 'SOURCE' and (source_key in (select source_key from judged where active) or claim_key in (select claim_key from picks)) or claim_key in (select claim_key from locals)""",
    "list_claims": f"""with {_ACTIVITY}
select distinct claim_key, source_key, origin, (origin = 'SOURCE' and (source_key in (select source_key from judged where active) or claim_key in (select claim_key from picks))) or claim_key in (select claim_key from locals) as active from lines""",
    "list_sources": f"""with {_ACTIVITY}
select source_key, candidate_key as course_key, active, row_number() over (order by source_key) as position, count(*) over () > 200 as truncated
from judged where candidate_key in (select c_custkey from customer where c_mktsegment = 'FURNITURE') qualify position <= 200""",
    "event_confidence": "select l_partkey as event_id, round(avg(l_quantity / 50), 6) as confidence, count(distinct l_suppkey) as sources from lineitem group by 1",
    "source_context": """with c as (select l_orderkey, min(l_partkey) as content from lineitem group by 1)
select o_orderkey as source_key, array_to_string(list_sort(list_filter(case o_orderkey % 3
  when 0 then ['source:' || o_custkey, 'content:' || c_nationkey, 'remote:' || c_name] when 1 then ['source:' || o_custkey, case when c_acctbal > 0 then 'remote:' || c_name end] else ['content:' || content] end, lambda x: x is not null)), ',') as context
from orders left join customer on c_custkey = o_custkey left join c on l_orderkey = o_orderkey""",
    "changed_courses": "select distinct source as course_key from documents where doc_id % 97 = 5",
    "unresolved_events": "select o_custkey as course_key, count(*) as unresolved from orders where o_orderkey % 4 > 0 and (o_orderstatus = 'P' or o_orderpriority like '1%') group by 1",
    "run_counts": """select event_id % 7 as run_key, count(*) filter (event_type not in ('error', 'view')) as observed, count(*) filter (event_id % 5 > 0 and floor(value) < 20) as failed,
  count(*) filter (event_type = 'view') as missing, count(*) filter (event_type = 'error') as uncertain from events group by 1""",
    "semantic_values": "select o_orderkey, case when o_orderkey % 2 = 0 then 'date ' || strftime(o_orderdate, '%Y-%m-%d') else lower(o_orderpriority) end as value from orders",
    "record_values": """select c_custkey, case c_custkey % 5 when 1 then c_mktsegment when 2 then c_name when 3 then c_name end as term,
  case c_custkey % 4 when 0 then 'ACTIVE' when 1 then 'UNAVAILABLE' else 'UNKNOWN' end as availability, case c_custkey % 3 when 0 then 'ACTIVE' when 1 then 'UNAVAILABLE' else 'UNKNOWN' end as visibility from customer""",
    "denormalised": "select l_orderkey as content_key, l_linenumber, l_partkey, o_custkey as course_key, n_name as provider from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey",
}
