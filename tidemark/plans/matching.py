"""Queries over candidates and events: orders as candidates in courses of customers, a tenth of them as sources of known events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import matching
from tidemark.plans.bindings import table

_GENERIC = matching.GENERIC


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    day = F.concat(F.lit("2030-01-0"), (F.floor(key / 10) % 4 + 1).cast("string"))
    signature = F.when(key % 3 == 0, F.concat(F.lit("instant "), day, F.lit(" 10:00:00"))).otherwise(F.concat(F.lit("date "), day))
    title = F.when(key % 7 > 0, F.concat(F.when(key % 2 == 0, "Quiz ").otherwise("Lab "), (key % 3 + 1).cast("string")))
    context = F.when(key % 4 == 1, F.array(F.concat(F.lit("content:"), (key % 6).cast("string")))).when(key % 4 == 2, F.array(F.concat(F.lit("source:"), (key % 8).cast("string"))))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 500).alias("course_key"), key.alias("candidate_key"), key.alias("source_key"), title.alias("title"),
        F.when(first <= "2", "quiz").when(first == "3", _GENERIC).otherwise("lab").alias("kind"), F.when(F.col("o_orderstatus") == "P", "MOVE").otherwise("NONE").alias("change"),
        F.when(key % 5 > 0, F.array(F.struct(F.lit("due_time").alias("field"), signature.alias("signature")))).alias("times"), context.alias("context"), F.lit(0.7).alias("confidence"),
        F.concat_ws(":", F.col("o_custkey") % 500, key % 30).alias("event_id"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _orders(spark, sf_dir)
    own = F.concat_ws(":", "course_key", F.lit("9")).alias("event_id")
    return rows.where("candidate_key % 10 <> 9").drop("event_id"), rows.where("candidate_key % 10 = 9"), rows.where("candidate_key % 40 = 1").select("source_key", own), rows.where("candidate_key % 80 = 1").select("source_key", own)


_MATCHES = f"""
  rows as (
    select *, case when title is null then '' else lower(title) end as identity, right(title, 1) as number
    from (
      select o_custkey % 500 as course_key, o_orderkey as candidate_key,
        case when o_orderkey % 7 > 0 then case when o_orderkey % 2 = 0 then 'Quiz ' else 'Lab ' end || (o_orderkey % 3 + 1) end as title,
        case when left(o_orderpriority, 1) <= '2' then 'quiz' when left(o_orderpriority, 1) = '3' then '{_GENERIC}' else 'lab' end as kind,
        case when o_orderstatus = 'P' then 'MOVE' else 'NONE' end as change,
        case when o_orderkey % 5 > 0 then case when o_orderkey % 3 = 0 then 'instant 2030-01-0' || (o_orderkey // 10 % 4 + 1) || ' 10:00:00' else 'date 2030-01-0' || (o_orderkey // 10 % 4 + 1) end end as signature,
        case when o_orderkey % 4 = 1 then 'content:' || (o_orderkey % 6) when o_orderkey % 4 = 2 then 'source:' || (o_orderkey % 8) end as context,
        (o_custkey % 500) || ':' || (o_orderkey % 30) as event_id
      from orders)),
  known as (
    select event_id, course_key, list(distinct identity) filter (identity <> '') as ids, list(distinct kind) as kinds, list(distinct number) filter (number is not null) as numbers,
      list(distinct signature) filter (signature is not null) as times, list(distinct context) filter (context is not null) as contexts
    from rows where candidate_key % 10 = 9 group by event_id, course_key),
  compared as (
    select c.*, e.event_id as event, list_contains(kinds, kind) as exact, kind = '{_GENERIC}' or list_contains(kinds, '{_GENERIC}') as generic,
      coalesce(list_contains(times, signature) or len(list_filter(times, lambda t: split_part(t, ' ', 2) = split_part(signature, ' ', 2) and split_part(t, ' ', 1) <> split_part(signature, ' ', 1))) > 0, false) as agrees,
      signature is not null and times is not null as comparable, coalesce(list_contains(contexts, context), false) as related
    from (select * exclude (event_id) from rows where candidate_key % 10 <> 9) c join known e on e.course_key = c.course_key and list_contains(ids, identity)
    where len(list_filter(numbers, lambda n: n <> number)) = 0),
  judged as (
    select *, (agrees or related or change <> 'NONE') and (exact or related) and not (comparable and not agrees and not related and change = 'NONE') as merge
    from compared where exact or generic),
  matched as (
    select candidate_key, event, merge,
      concat_ws(',', 'normalized_title', case when exact then 'compatible_type' else 'generic_type_requires_relation' end, 'assessment_number:' || number, case when agrees then 'same_field_time' end,
        case when related and context like 'source:%' then 'shared_typed_source' end, case when related then 'shared_source_context' end, case when change <> 'NONE' then 'explicit_change:' || lower(change) end) as accepted,
      case when comparable and not agrees then 'same_field_time_contradiction' else '' end as rejected,
      cast(case when merge and related then 0.95 when merge then 0.9 else 0.5 end as double) as confidence
    from judged)"""


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, members, _, _ = _inputs(spark, sf_dir)
    return matching.match_candidates(candidates, members).select("candidate_key", "event", "merge", F.array_join("accepted", ",").alias("accepted"), F.array_join("rejected", ",").alias("rejected"), "confidence")


def _flat(audit: DataFrame) -> DataFrame:
    return audit.select("course_key", "candidate_key", "event_id", "result", *(F.array_join(c, ",").alias(c) for c in ("considered", "accepted", "rejected")), "confidence")


def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(matching.decide(*_inputs(spark, sf_dir), onto_known=True))


def reconcile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(matching.decide(*_inputs(spark, sf_dir)))


_AUDIT = f"""
with {_MATCHES},
  summed as (
    select candidate_key, count(*) filter (merge) as merges, min({{'event': event, 'accepted': accepted, 'rejected': rejected, 'confidence': confidence}}) filter (merge) as match,
      string_agg(event, ',' order by event) as considered, coalesce(string_agg(rejected, ',' order by event, rejected) filter (rejected <> ''), '') as rejected, max(confidence) as most
    from matched group by candidate_key),
  decided as (
    select r.*, s.* exclude (candidate_key), candidate_key % 80 = 1 as picked, candidate_key % 40 = 1 as held,
      case when candidate_key % 80 = 1 then 'MANUAL_RETAINED' when candidate_key % 40 = 1 then 'RETAINED' when merges = 1 then 'MERGED' when change <> 'NONE' then 'RELATED_CHANGE' when merges is null then 'CREATED' else 'UNRESOLVED' end as result
    from (select * exclude (event_id) from rows where candidate_key % 10 <> 9) r left join summed s using (candidate_key))
select course_key, candidate_key, result,
  case when held then course_key || ':9' when result = 'CREATED' then sha256(course_key || ':' || candidate_key || ':' || candidate_key) when result = 'MERGED' then match.event end as event_id,
  case when held then course_key || ':9' else coalesce(considered, '') end as considered,
  case when picked then 'manual_identity' when held then 'stable_existing_binding' when result = 'CREATED' then 'no_plausible_existing_event' when result = 'MERGED' then match.accepted else '' end as accepted,
  case when held or result = 'CREATED' then '' when result = 'MERGED' then match.rejected else coalesce(rejected, '') end as rejected,
  cast(case when held then 1 when result = 'CREATED' then 0.7 when result = 'MERGED' then match.confidence else coalesce(most, 0) end as double) as confidence
from decided
"""

QUERIES = (match_candidates, decision_audit, reconcile_candidates)
ORACLE = {"match_candidates": f"with {_MATCHES} select * from matched", "decision_audit": _AUDIT}
