"""Queries over observation logs: change feed, latest state, status, coverage, freshness, lifecycle and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes, latest, status
from tidemark.operators.paging import page
from tidemark.plans.bindings import ATTEMPTS, OBSERVATIONS, RANK, attempts, observations, table

SINCE, UNTIL = "2024-01-05", "2024-01-20"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.recent_changes(observations(spark, sf_dir), _at(SINCE), _at(UNTIL))
    return found.select("resource_key", "observation_key", "observed_at", F.array_join("kinds", ",").alias("kinds"), "previous_version_key", "version_key")


_PREVIOUS = f"""{OBSERVATIONS},
  previous as (
    select *, lag(observation_key) over w as previous_key, lag(fingerprint) over w as previous_fingerprint,
      lag(observation_status) over w as previous_status, lag(availability) over w as previous_availability,
      last_value(version_key ignore nulls) over (partition by resource_key order by observed_at, run_key, observation_key rows between unbounded preceding and 1 preceding) as previous_version_key
    from observations where observation_status <> 'UNKNOWN'
    window w as (partition by resource_key order by observed_at, run_key, observation_key)),
  kinds as (
    select *, case when previous_key is null then case when observation_status = 'OBSERVED' then 'FIRST_OBSERVED' else 'FIRST_RECORDED' end
      else concat_ws(',',
        case when version_key is not null and version_key is distinct from previous_version_key then case when previous_version_key is null then 'BINARY_AVAILABLE' else 'BINARY_CHANGED' end end,
        case when fingerprint is distinct from previous_fingerprint then 'METADATA_CHANGED' end,
        case when observation_status is distinct from previous_status or availability is distinct from previous_availability then 'AVAILABILITY_CHANGED' end) end as kinds
    from previous)"""


def change_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.recent_changes(observations(spark, sf_dir), _at(SINCE), _at(UNTIL))
    rows = found.select("resource_key", "observation_key", "observed_at", F.array_join("kinds", ",").alias("kinds"))
    return page(rows, [F.desc("observed_at"), F.desc("observation_key")], 50, 100)


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_state(observations(spark, sf_dir), ["resource_key"], ["fingerprint", "availability", "observation_key"])


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_by(observations(spark, sf_dir), ["resource_key"], where=F.col("version_key").isNotNull())


def upsert_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    attributes = ["fingerprint", "availability"]
    late, early = obs.where("observation_key % 2 = 0"), obs.where("observation_key % 2 = 1")
    state = latest.merge_state(None, late, ["resource_key"], attributes)
    return latest.merge_state(state, early, ["resource_key"], attributes)


def append_new_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    new = obs.where("observation_key % 3 > 0")
    return latest.append_observations(new, obs.where("observation_key % 3 = 0")).select("resource_key", "run_key", "fingerprint", "observation_key")


def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("sha256", F.when(F.col("version_key").isNotNull(), F.sha2("fingerprint", 256)))
    return latest.assign_versions(obs)


def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.current_version(observations(spark, sf_dir))


def current_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.current_availability(observations(spark, sf_dir))


def scope_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.fold_scopes(attempts(spark, sf_dir), ("event_type", "part"))


_FOLD = f"""{ATTEMPTS},
  folded as (
    select event_type, part, max(attempted_at) as last_attempt_at,
      arg_max(run_key, (attempted_at, run_key)) as last_run_key, arg_max(outcome, (attempted_at, run_key)) as last_outcome,
      arg_max(coverage, (attempted_at, run_key)) as last_coverage,
      max(attempted_at) filter (outcome = 'SUCCEEDED') as last_success_at,
      max(attempted_at) filter (coverage = 'COMPLETE') as last_complete_at,
      arg_max(run_key, (attempted_at, run_key)) filter (coverage = 'COMPLETE') as last_complete_run,
      arg_max(max_age_s, (attempted_at, run_key)) filter (max_age_s is not null) as max_age_s
    from attempts group by event_type, part)"""


def freshness_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.freshness(status.fold_scopes(attempts(spark, sf_dir), ("event_type", "part")), _at("2024-02-01"), 86400)


def stale_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness_modes(spark, sf_dir).where("should_refresh").select("event_type", "part", "mode")


_FRESH = f"""{_FOLD},
  aged as (
    select f.*, m.mode, case when last_complete_at is not null then greatest(cast(floor(epoch(timestamp '2024-02-01')) as bigint) - cast(floor(epoch(last_complete_at)) as bigint), 0) end as age_s,
      case when m.mode = 'MAX_AGE' then 86400 else max_age_s end as limit_s,
      (last_outcome = 'FAILED' or last_coverage <> 'COMPLETE') and (last_complete_at is null or (last_attempt_at, last_run_key) > (last_complete_at, last_complete_run)) as incomplete
    from folded f cross join (select unnest(['CACHE_ONLY', 'ALLOW_STALE', 'MAX_AGE', 'REFRESH_IF_STALE', 'REQUIRE_CURRENT']) as mode) m),
  rated as (
    select *, case when incomplete or age_s is null then case when age_s is not null then 'STALE' else 'UNKNOWN' end
        when limit_s is not null and age_s > limit_s then 'STALE' else 'CURRENT' end as base,
      coalesce(last_outcome = 'SUCCEEDED' and last_coverage = 'COMPLETE' and last_complete_at = last_attempt_at and last_attempt_at >= timestamp '2024-02-01', false) as is_current
    from aged),
  judged as (
    select *, case when mode in ('CACHE_ONLY', 'ALLOW_STALE') then true when mode = 'REFRESH_IF_STALE' and limit_s is null then false
      when mode = 'REQUIRE_CURRENT' then is_current else base = 'CURRENT' end as satisfied from rated),
  fresh as (
    select event_type, part, mode,
      case when mode = 'REQUIRE_CURRENT' and not satisfied then case when age_s is not null then 'STALE' else 'UNKNOWN' end else base end as status,
      age_s, satisfied, not satisfied and not (mode = 'REFRESH_IF_STALE' and limit_s is null) and mode not in ('CACHE_ONLY', 'ALLOW_STALE') as should_refresh,
      concat_ws(',', case when age_s is null then 'NO_COMPLETE_OBSERVATION' end,
        case when mode = 'REFRESH_IF_STALE' and limit_s is null then 'MAX_AGE_UNCONFIGURED' end,
        case when limit_s is null then 'NO_MAX_AGE_GUARANTEE' end, case when incomplete then 'LATEST_ATTEMPT_INCOMPLETE' end,
        case when mode = 'REQUIRE_CURRENT' and not satisfied then 'CURRENT_COVERAGE_UNESTABLISHED' end) as warnings
    from judged)"""


def scope_latest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = attempts(spark, sf_dir).select(F.when(F.col("part") > 0, F.col("part")).alias("course"), F.col("event_type").alias("kind"), "attempted_at", "run_key", "coverage")
    aliases = spark.createDataFrame([("purchase", "content"), ("click", "content")], "kind string, normal string")
    return status.scope_coverage(scopes, aliases)


def library_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("course_key"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("course_key"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    resources = orders.select("course_key", F.col("o_orderkey").alias("resource_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("observed_at"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource_key"), (F.col("l_returnflag") != "R").alias("usable"))
    return status.library_status(courses, resources, chunks)


def work_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))
    return status.work_counts(work, "owner", ["F", "O", "P"])


def work_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    work = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_key"),
        F.col("l_orderkey").alias("owner"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "F", "DONE").otherwise("PENDING").alias("status"),
        (F.col("l_quantity") % 5).cast("int").alias("attempts"),
        F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + F.col("l_linenumber") - 1).alias("depends_on"),
    )
    return status.work_backlog(work, 4)


def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "COMPLETE").otherwise("PARTIAL").alias("coverage"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course_key"), F.col("doc_id").alias("version_key"), "doc_id")
    return status.parse_coverage(docs.join(labels, "doc_id", "left").drop("doc_id"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir)
    return rows.groupBy("event_type", "part").agg(
        status.worst_coverage(F.col("coverage")).alias("worst"),
        F.array_join(status.coverage_warnings(F.col("coverage")), ",").alias("warnings"),
        status.as_of(F.when(F.col("max_age_s") != 0, F.col("attempted_at")), True).alias("strict_as_of"),
        status.as_of(F.col("attempted_at"), False).alias("lenient_as_of"),
    )


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).select(F.expr("run_key div 5").alias("run_key"), "coverage")
    return status.run_status(rows)


def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir)
    items = rows.where("outcome = 'SUCCEEDED' and part % 3 = 0").select(F.expr("run_key div 8").alias("request"), F.col("attempted_at").alias("observed_at"), (F.col("run_key") % 11 == 0).alias("conflict"), (F.col("run_key") % 13 == 0).alias("truncated"))
    scopes = rows.select(F.expr("run_key div 8").alias("request"), "coverage", (F.col("run_key") % 17 > 0).alias("satisfied")).where("coverage != 'FAILED'")
    return status.answer_status(items, scopes)


def inventory_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    day = F.datediff(F.col("observed_at").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    seen = obs.select(day.alias("run_key"), (F.col("resource_key") % 5).alias("course_key"), "resource_key").distinct()
    runs = seen.select("run_key", "course_key").distinct().select("run_key", "course_key", F.col("run_key").alias("run_at"), (F.col("run_key") % 3 > 0).alias("complete"), (F.col("course_key") != 4).alias("parent_available"))
    known = obs.groupBy("resource_key").agg(F.min(day).alias("first_at")).select((F.col("resource_key") % 5).alias("course_key"), "resource_key", "first_at", F.when(F.col("resource_key") % 10 == 3, "REMOVED_CONFIRMED").otherwise("ACTIVE").alias("availability"))
    earlier = obs.where("observation_status = 'NOT_OBSERVED'").select(F.lit(-1).cast("long").alias("run_key"), "resource_key", day.alias("run_at"))
    return changes.inventory(runs, known, seen, earlier)


def fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    extra = obs.withColumn("modified", F.col("observation_key") % 2).withColumn("revision", F.col("version_key") % 3)
    current = latest.current_version(obs)
    last = latest.latest_by(extra, ["resource_key"])
    now_obs = last.join(current, "resource_key").select("resource_key", "observed_at", "current_version", (F.col("resource_key") % 9 == 0).alias("requested"), "fingerprint", "modified", "revision")
    verified = latest.latest_by(extra, ["resource_key"], where=(F.col("observation_status") == "OBSERVED") & (F.col("observation_key") % 4 == 0))
    basis = verified.select("resource_key", F.when(F.col("resource_key") % 8 > 0, F.col("observed_at")).alias("verified_at"), "fingerprint", "modified", "revision")
    easy = now_obs.withColumn("fingerprint", F.when(F.col("resource_key") % 2 == 0, F.col("fingerprint")))
    return changes.fetch_policy(easy, basis.withColumn("fingerprint", F.when(F.col("resource_key") % 2 == 0, F.col("fingerprint"))).withColumn("modified", F.lit(0).cast("long")).withColumn("revision", F.lit(None).cast("long")))


def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_key"), F.when(F.col("event_type") != "error", F.concat_ws(":", "user_id", "props")).alias("capture_id"))
    return changes.replays(runs)


QUERIES = [
    change_feed, change_feed_page, latest_state, latest_rows, upsert_late_data, append_new_observations, version_numbers, current_version,
    current_availability, scope_fold, freshness_modes, stale_scopes, scope_latest_alias, library_status, work_counts, work_backlog,
    parse_coverage, coverage_summary, run_status, answer_status, inventory_omissions, fetch_policy, replayed_runs,
]

ORACLE = {
    "change_feed": f"with {_PREVIOUS} select resource_key, observation_key, observed_at, kinds, previous_version_key, version_key from kinds where kinds <> '' and observed_at >= timestamp '{SINCE}' and observed_at < timestamp '{UNTIL}'",
    "change_feed_page": f"""with {_PREVIOUS}, found as (select resource_key, observation_key, observed_at, kinds from kinds where kinds <> '' and observed_at >= timestamp '{SINCE}' and observed_at < timestamp '{UNTIL}'),
  numbered as (select *, row_number() over (order by observed_at desc, observation_key desc) as position, count(*) over () as n from found)
select resource_key, observation_key, observed_at, kinds, cast(position as bigint) as position, n > 150 as truncated from numbered where position > 100 and position <= 150""",
    "latest_state": f"with {OBSERVATIONS} select resource_key, min(observed_at) as first_seen, max(observed_at) as last_seen, count(*) as observations, arg_max(fingerprint, (observed_at, run_key, observation_key)) as fingerprint, arg_max(availability, (observed_at, run_key, observation_key)) as availability, arg_max(observation_key, (observed_at, run_key, observation_key)) as observation_key from observations group by resource_key",
    "latest_rows": f"with {OBSERVATIONS} select * from observations where version_key is not null qualify row_number() over (partition by resource_key order by observed_at desc, run_key desc, observation_key desc) = 1",
    "upsert_late_data": f"with {OBSERVATIONS} select resource_key, min(observed_at) as first_seen, max(observed_at) as last_seen, count(*) as observations, max(observed_at) as observed_at, arg_max(run_key, (observed_at, run_key, observation_key)) as run_key, arg_max(observation_key, (observed_at, run_key, observation_key)) as observation_key, arg_max(fingerprint, (observed_at, run_key, observation_key)) as fingerprint, arg_max(availability, (observed_at, run_key, observation_key)) as availability from observations group by resource_key",
    "append_new_observations": f"""with {OBSERVATIONS}, new as (select * from observations where observation_key % 3 > 0),
  first as (select resource_key, run_key, fingerprint, arg_min(observation_key, (observed_at, observation_key)) as observation_key from new group by all)
select * from first f where not exists (select 1 from observations o where o.observation_key % 3 = 0 and o.resource_key = f.resource_key and o.run_key = f.run_key and o.fingerprint = f.fingerprint)""",
    "version_numbers": f"""with {OBSERVATIONS}, first as (
    select resource_key, sha256(fingerprint) as sha256, min(observed_at) as first_at, arg_min(observation_key, (observed_at, observation_key)) as first_key
    from observations where version_key is not null group by all)
select *, row_number() over (partition by resource_key order by first_at, first_key, sha256) as version_number from first""",
    "current_version": f"with {OBSERVATIONS} select resource_key, arg_max(version_key, (observed_at, run_key, observation_key)) filter (observation_status = 'OBSERVED' and version_key is not null) as current_version from observations group by resource_key",
    "current_availability": f"with {OBSERVATIONS} select resource_key, coalesce(arg_max(availability, (observed_at, run_key, observation_key)) filter (observation_status <> 'UNKNOWN'), 'UNKNOWN') as availability, count(*) filter (observation_status = 'UNKNOWN') as unknown from observations group by resource_key",
    "scope_fold": f"with {_FOLD} select * from folded",
    "freshness_modes": f"with {_FRESH} select * from fresh",
    "stale_scopes": f"with {_FRESH} select event_type, part, mode from fresh where should_refresh",
    "scope_latest_alias": f"""with {ATTEMPTS}, named as (select case when part > 0 then part end as course, case when event_type in ('purchase', 'click') then 'content' else event_type end as kind, attempted_at, run_key, coverage from attempts),
  last as (select course, kind, arg_max(coverage, (attempted_at, run_key)) as coverage from named group by all)
select c.course, k.kind, coalesce(l.coverage, g.coverage, 'UNKNOWN') as coverage
from (select distinct course from last where course is not null) c cross join (select distinct kind from last) k
left join last l on l.course = c.course and l.kind = k.kind left join last g on g.course is null and g.kind = k.kind""",
    "library_status": """with per_order as (select l_orderkey, count(*) as chunks, count(*) filter (l_returnflag <> 'R') as usable from lineitem group by 1),
  per_course as (
    select c_nationkey as course_key, count(*) as resources, count(*) filter (o_orderstatus = 'F') as finished, count(*) filter (o_orderstatus = 'O') as open,
      count(*) filter (chunks > 0) as parsed, sum(chunks) as chunks, sum(usable) as usable, max(o_orderdate) as last_observed
    from orders join customer on o_custkey = c_custkey left join per_order on l_orderkey = o_orderkey group by 1)
select cast(n_nationkey as bigint) as course_key, coalesce(resources, 0) as resources, coalesce(finished, 0) as finished, coalesce(open, 0) as open, coalesce(parsed, 0) as parsed,
  cast(coalesce(chunks, 0) as bigint) as chunks, cast(coalesce(usable, 0) as bigint) as usable, last_observed from nation left join per_course on course_key = n_nationkey""",
    "work_counts": """select o_custkey as owner, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
    "work_backlog": """with work as (
    select l_orderkey * 10 + l_linenumber as job_key, l_orderkey as owner, case when l_returnflag = 'R' then 'FAILED' when l_linestatus = 'F' then 'DONE' else 'PENDING' end as status,
      cast(l_quantity as integer) % 5 as attempts, case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 end as depends_on from lineitem)
select w.owner, count(*) filter (w.status <> 'DONE') as remaining,
  count(*) filter (w.status = 'FAILED' or (w.status = 'PENDING' and (w.attempts >= 4 or (w.depends_on is not null and coalesce(u.status <> 'DONE', true))))) as blocked
from work w left join work u on u.job_key = w.depends_on group by 1""",
    "parse_coverage": """select source as course_key, count(*) as total, count(quality) as parsed, count(*) filter (quality = 1) as complete,
  case when count(*) = count(quality) and count(*) = count(*) filter (quality = 1) then 'COMPLETE' when count(quality) = 0 then 'UNKNOWN' else 'PARTIAL' end as coverage
from documents left join labels using (doc_id) group by 1""",
    "coverage_summary": f"""with {ATTEMPTS} select event_type, part, arg_max(coverage, {RANK.format('coverage')}) as worst,
  coalesce((select string_agg(c, ',' order by {RANK.format('c')}) from unnest(list_distinct(list(coverage))) t(c) where c <> 'COMPLETE'), '') as warnings,
  case when count(*) filter (max_age_s is null or max_age_s = 0) = 0 then min(attempted_at) end as strict_as_of, min(attempted_at) as lenient_as_of
from attempts group by event_type, part""",
    "run_status": f"""with {ATTEMPTS} select run_key // 5 as run_key, count(*) as scopes, case when bool_and(coverage = 'FAILED') then 'FAILED' when bool_or(coverage <> 'COMPLETE') then 'WARN' else 'OK' end as status, count(*) filter (coverage = 'FAILED') as failed from attempts group by 1""",
    "answer_status": f"""with {ATTEMPTS},
  items as (select run_key // 8 as request, attempted_at, run_key % 11 = 0 as conflict, run_key % 13 = 0 as truncated from attempts where outcome = 'SUCCEEDED' and part % 3 = 0),
  scopes as (select run_key // 8 as request, coverage, run_key % 17 > 0 as satisfied from attempts where coverage <> 'FAILED'),
  a as (select request, count(*) as items, min(attempted_at) as as_of, count(*) filter (conflict) as conflicts, bool_or(truncated) as truncated from items group by 1),
  b as (select request, arg_max(coverage, {RANK.format('coverage')}) as source, string_agg(distinct coverage, ',') filter (coverage <> 'COMPLETE') as warnings, bool_and(satisfied) as fresh from scopes group by 1),
  j as (select b.*, coalesce(items, 0) as items, as_of, coalesce(conflicts, 0) as conflicts, coalesce(truncated, false) as truncated from b left join a using (request)),
  k as (select *, case when source = 'COMPLETE' and truncated then 'PARTIAL' when source = 'COMPLETE' and not fresh then 'STALE' else source end as completeness from j)
select request, items, as_of, conflicts, completeness, source, coalesce(warnings, '') as warnings, fresh, items = 0 and completeness = 'COMPLETE' as conclusive_empty from k""",
    "inventory_omissions": f"""with {OBSERVATIONS},
  days as (select *, date_diff('day', date '2024-01-01', cast(observed_at as date)) as day from observations),
  seen as (select distinct day as run_key, resource_key % 5 as course_key, resource_key from days),
  runs as (select distinct run_key, course_key from seen),
  known as (select resource_key, min(day) as first_at from days group by 1),
  unseen as (
    select r.run_key, r.course_key, k.resource_key, r.run_key as run_at, r.run_key % 3 > 0 and r.course_key <> 4 as sure
    from runs r join known k on k.resource_key % 5 = r.course_key and k.first_at < r.run_key and k.resource_key % 10 <> 3
    where not exists (select 1 from seen s where s.run_key = r.run_key and s.resource_key = k.resource_key)),
  earlier as (
    select resource_key, run_at, run_key, sure as gone from unseen
    union all select resource_key, day, -1, true from days where observation_status = 'NOT_OBSERVED'),
  first_gone as (select resource_key, min((run_at, run_key)) as at from earlier where gone group by 1)
select u.run_key, u.course_key, u.resource_key, u.run_at, case when sure then 'NOT_OBSERVED' else 'UNKNOWN' end as observation_status,
  case when sure then 'MISSING' else 'ACTIVE' end as availability, sure and coalesce(f.at < (u.run_at, u.run_key), false) as removal_candidate
from unseen u left join first_gone f using (resource_key)""",
    "fetch_policy": f"""with {OBSERVATIONS},
  last as (select * from observations qualify row_number() over (partition by resource_key order by observed_at desc, run_key desc, observation_key desc) = 1),
  cur as (select resource_key, arg_max(version_key, (observed_at, run_key, observation_key)) filter (observation_status = 'OBSERVED' and version_key is not null) as current_version from observations group by 1),
  ver as (select * from observations where observation_status = 'OBSERVED' and observation_key % 4 = 0 qualify row_number() over (partition by resource_key order by observed_at desc, run_key desc, observation_key desc) = 1),
  reasons as (
    select l.resource_key, l.observed_at, case
      when c.current_version is null then 'new_resource' when l.resource_key % 9 = 0 then 'verification_requested' when v.resource_key is null then 'metadata_unknown'
      when (case when l.resource_key % 2 = 0 then l.fingerprint end) is distinct from (case when l.resource_key % 2 = 0 then v.fingerprint end)
        or l.observation_key % 2 is distinct from 0 or l.version_key % 3 is distinct from null then 'metadata_changed'
      when l.resource_key % 8 = 0 then 'metadata_unknown' when l.observed_at >= v.observed_at + interval 7 day then 'verification_expired' else 'within_verification_interval' end as reason
    from last l join cur c using (resource_key) left join ver v using (resource_key))
select resource_key, observed_at, reason, reason <> 'within_verification_interval' as fetch from reasons""",
    "replayed_runs": """with runs as (select event_id as run_key, case when event_type <> 'error' then user_id || ':' || props end as capture_id from events)
select run_key, capture_id, coalesce(capture_id is not null and run_key > min(run_key) over (partition by capture_id), false) as replay from runs""",
}
