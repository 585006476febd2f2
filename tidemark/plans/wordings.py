"""Queries over event wording; the strings are built alike in Spark and in SQL, since the corpus holds none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times, wording
from tidemark.operators import events, extract, reconcile
from tidemark.operators.lineage import once
from tidemark.plans.bindings import table

KINDS = ["Assignment", "Homework", "Quiz", "Term test", "Exam", "Presentation", "Tutorial", "Lab", "Lecture", "Project milestone", "Submission", "Picnic"]
PHRASES = [" is due on ", " has been moved to ", " was cancelled. Next one ", " venue changed to Room 5 on ", " may be moved if it rains on ", " starts at 2.30pm on ", " deadline is "]
#: Months in English for SQL and Spark alike.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _of(names: list[str], at):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (at % len(names) + 1).cast("int"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as announcements."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), _of(MONTHS, F.month(day) - 1), F.lit(" "), F.year(day).cast("string"))
    head = F.concat(_of(KINDS, key), F.lit(" #"), (key % 4 + 1).cast("string"))
    text = F.concat(head, _of(PHRASES, F.floor(key / 12)), date, F.lit(" 10:30 UTC+8."))
    return table(spark, sf_dir, "orders").select(key.alias("key"), F.col("o_custkey").alias("course_key"), day.alias("day"), head.alias("head"), date.alias("date_text"), text.alias("text"))


def _sql_of(names: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][cast({at} as bigint) % {len(names)} + 1]"


ANNOUNCEMENTS = f"""
  parts as (
    select o_orderkey as key, o_custkey as course_key, o_orderdate as day, {_sql_of(KINDS, 'o_orderkey')} || ' #' || (o_orderkey % 4 + 1) as head,
      dayofmonth(o_orderdate) || ' ' || {_sql_of(MONTHS, 'month(o_orderdate) - 1')} || ' ' || year(o_orderdate) as date_text from orders),
  announcements as (select *, head || {_sql_of(PHRASES, 'key // 12')} || date_text || ' 10:30 UTC+8.' as text from parts)"""


def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("key", wording.title_identity(F.col("head")).alias("identity"), wording.title_identity(F.concat(F.lit("the Second "), F.lower("head"), F.lit(" was moved"))).alias("second"))


def change_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("key", wording.change_kind(F.col("text")).alias("change"))


def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("key", wording.event_type(F.col("text")).alias("kind"), wording.assessment_subtype(F.col("head")).alias("subtype"), wording.due_marker(F.col("text")).alias("due"), wording.is_negated(F.concat(F.lit("There is no "), F.col("text"))).alias("negated"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("key", times.parse_date(F.col("date_text")).alias("date"), times.parse_date(F.concat(F.lit("Mon, "), F.date_format("day", "MMM"), F.lit(" "), F.dayofmonth("day").cast("string"), F.lit("th, "), F.year("day").cast("string"))).alias("month_first"))


def parse_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = times.temporal_value(F.col("text"))
    return announcements(spark, sf_dir).select("key", value["instant"].alias("instant"), value["precision"].alias("precision"))


def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.lpad((F.col("key") % 60).cast("string"), 2, "0")
    text = F.concat((F.col("key") % 24).cast("string"), F.when(F.col("key") % 3 == 0, ".").otherwise(":"), minute, F.when(F.col("key") % 5 == 0, " pm").otherwise(""))
    return announcements(spark, sf_dir).select("key", times.parse_clock(text).cast("long").alias("minutes"))


def parse_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = times.temporal_value(F.concat(F.lit("Week "), (F.col("key") % 60).cast("string")))
    many = times.temporal_value(F.concat(F.lit("Weeks "), (F.col("key") % 9).cast("string"), F.lit(", 3 and 12")))
    return announcements(spark, sf_dir).select("key", value["week_number"].cast("long").alias("week"), value["precision"].alias("precision"), F.array_join(F.transform(many["week_numbers"], lambda w: w.cast("string")), ",").alias("weeks"))


def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, month = F.dayofmonth("day").cast("string"), F.month("day").cast("string")
    text = F.concat(F.lit("on "), F.when(F.col("key") % 2 == 0, F.concat_ws("/", day, month)).otherwise(F.concat_ws("/", month, day)), F.lit("/24 or 3/4/24"))
    return announcements(spark, sf_dir).select("key", times.date_order(text).alias("numeric_order"))


def temporal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = times.temporal_value(F.when(F.col("key") % 3 == 0, F.lit("Week 3")).otherwise(F.col("date_text")))
    rows = announcements(spark, sf_dir).select("key", times.temporal_bounds(value).alias("bounds"))
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("1995-03-01", "1995-06-01"))
    return events.overlaps(rows, since, until).select("key", "bounds.low", "bounds.high")


def extract_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_documents(announcements(spark, sf_dir).select(F.col("key").alias("doc_id"), F.lit(0).alias("ordinal"), "text"))
    time = F.col("time")
    return found.select(
        "doc_id", "mention", "kind", "change", "title", F.size("times").alias("times"), "location", "due", "partial", "path", time["precision"].alias("precision"), time["instant"].alias("instant"),
        F.col("end_time")["instant"].alias("until"), F.length("original").alias("chars"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of every announcement; the key orders them by announcement, then by mention."""
    rows = announcements(spark, sf_dir)
    found = extract.extract_mentions(rows.select(F.col("key").alias("doc_id"), F.lit(0).alias("ordinal"), "text"))
    found = found.withColumn("candidate_key", F.shiftleft("doc_id", 16) + F.col("mention"))
    return found.join(rows.select(F.col("key").alias("doc_id"), "course_key", "day"), "doc_id").drop("doc_id")


def candidate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidate_fields(_candidates(spark, sf_dir))


def assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.assign_events(once(_candidates(spark, sf_dir), signature=times.temporal_signature(F.col("time"))).drop("times"))


def extract_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    key = F.col("o_orderkey")
    obs = table(spark, sf_dir, "orders").select(
        key.alias("obs_key"), F.when(key % 3 == 0, "assessment").when(key % 3 == 1, "schedule").otherwise("due_item").alias("kind"), F.col("o_orderpriority").alias("title"),
        F.when(key % 2 == 0, day).alias("due_at"), F.when(key % 5 == 0, day).alias("grading_due_at"), F.when(key % 7 > 0, day).alias("start_at"),
    )
    return extract.extract_observations(obs)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as claims about fields of events."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("claim_key"), (key % 900).alias("event_id"), F.when(key % 3 == 0, "due_time").otherwise("location").alias("field_name"),
        F.when(key % 3 == 0, F.when(key % 2 == 0, F.concat(F.lit("date 2024-02-0"), (F.col("user_id") % 3 + 1).cast("string"))).otherwise(F.concat(F.lit("instant 2024-02-0"), (F.col("user_id") % 3 + 1).cast("string"), F.lit(" 09:00:00")))).otherwise(F.concat(F.lit("room "), (F.col("user_id") % 2).cast("string"))).alias("value"),
        F.when(key % 3 == 0, F.when(key % 2 == 0, "DATE_ONLY").otherwise("EXACT_TIME")).alias("precision"), F.round(F.col("value") / 100, 3).alias("confidence"),
        F.when(key % 4 == 0, F.when(key % 3 == 0, "MOVE").otherwise("VENUE_CHANGE")).otherwise("NONE").alias("change"), F.when(key % 11 > 0, F.col("ts")).alias("source_time"),
    )


CLAIMS = """
  claims as (
    select event_id as claim_key, event_id % 900 as event_id, case when event_id % 3 = 0 then 'due_time' else 'location' end as field_name,
      case when event_id % 3 = 0 then case when event_id % 2 = 0 then 'date 2024-02-0' || (user_id % 3 + 1) else 'instant 2024-02-0' || (user_id % 3 + 1) || ' 09:00:00' end else 'room ' || (user_id % 2) end as value,
      case when event_id % 3 = 0 then case when event_id % 2 = 0 then 'DATE_ONLY' else 'EXACT_TIME' end end as precision, round(value / 100, 3) as confidence,
      case when event_id % 4 = 0 then case when event_id % 3 = 0 then 'MOVE' else 'VENUE_CHANGE' end else 'NONE' end as change, case when event_id % 11 > 0 then ts end as source_time
    from events),
  finer as (
    select d.event_id, d.field_name, d.value, min(i.value) as finer from (select distinct event_id, field_name, value from claims where value like 'date %') d
    join (select distinct event_id, field_name, value from claims where value like 'instant %') i on i.event_id = d.event_id and i.field_name = d.field_name and substr(i.value, 9, 10) = substr(d.value, 6, 10)
    group by all having count(*) = 1),
  grouped as (select c.*, coalesce(f.finer, c.value) as grp, case precision when 'EXACT_TIME' then 3 when 'DATE_ONLY' then 2 when 'WEEK_ONLY' then 1 else 0 end as rnk from claims c left join finer f using (event_id, field_name, value)),
  wins as (
    select g.event_id, g.field_name, g.claim_key, g.grp from grouped g
    where g.change <> 'NONE' and g.source_time is not null
      and exists (select 1 from grouped o where o.event_id = g.event_id and o.field_name = g.field_name and o.grp <> g.grp)
      and not exists (select 1 from grouped o where o.event_id = g.event_id and o.field_name = g.field_name and o.grp <> g.grp and (o.source_time is null or o.source_time >= g.source_time or o.rnk > g.rnk))),
  successors as (select event_id, field_name, max(claim_key) as claim_key, max(grp) as grp from wins group by 1, 2 having count(distinct grp) = 1),
  manual as (select event_id % 900 as event_id, case when event_id % 2 = 0 then 'due_time' else 'location' end as field_name, ts as decided_at, event_id as decision_key, 'picked ' || user_id as value from events where event_id % 23 = 0),
  decided as (select * from manual qualify row_number() over (partition by event_id, field_name order by decided_at desc, decision_key desc) = 1),
  chosen as (select * from grouped qualify row_number() over (partition by event_id, field_name, grp order by rnk desc, confidence desc, claim_key) = 1),
  fields as (select event_id, field_name, count(*) as groups, min(value) as single, string_agg(value, ' | ' order by value) as vals from chosen group by 1, 2),
  projected as (
    select f.event_id, f.field_name, coalesce(d.value, case when groups = 1 then single end, n.value) as value,
      case when d.value is not null then 'MANUAL' when groups = 1 then 'AGREED' when n.value is not null then 'SUCCESSOR' else 'OPEN' end as basis, vals
    from fields f left join decided d using (event_id, field_name) left join successors s using (event_id, field_name)
    left join chosen n on n.event_id = s.event_id and n.field_name = s.field_name and n.grp = s.grp)"""


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id % 23 = 0")
    return rows.select((F.col("event_id") % 900).alias("event_id"), F.when(F.col("event_id") % 2 == 0, "due_time").otherwise("location").alias("field_name"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_key"), F.concat(F.lit("picked "), F.col("user_id").cast("string")).alias("value"))


def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.claim_groups(claims(spark, sf_dir)).select("claim_key", "group")


def successor_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.successors(reconcile.claim_groups(claims(spark, sf_dir)))


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.project_events(reconcile.claim_groups(claims(spark, sf_dir)), _manual(spark, sf_dir))


def project_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir)


def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.claim_states(reconcile.claim_groups(claims(spark, sf_dir)), _projected(spark, sf_dir))


def expired_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.expire_manual(_manual(spark, sf_dir), reconcile.claim_groups(claims(spark, sf_dir)))


def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_list(_projected(spark, sf_dir)).select("event_id", "due_time", "location", "open_fields")


def event_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.review(_projected(spark, sf_dir), ["due_time", "location"])
    return found.select("event_id", F.array_join("missing", ",").alias("missing"), F.array_join("conflicts", ",").alias("conflicts"), F.array_join("basis", ",").alias("basis"))


def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.detail(_projected(spark, sf_dir), reconcile.claim_groups(claims(spark, sf_dir)))
    return found.select("event_id", F.size("fields").cast("long").alias("fields"), F.array_join(F.transform("claims", lambda c: c.claim_key.cast("string")), ",").alias("claims"))


QUERIES = [
    title_identity, change_kind, event_type, parse_date, parse_instant, parse_clock, parse_week, date_order, temporal_overlap, extract_mentions, candidate_fields, assign_events,
    extract_structured, claim_groups, successor_claims, project_events, claim_states, expired_decisions, event_list, event_review, event_detail,
]

_TYPE = "case " + " ".join(f"when regexp_matches(lower(text), '\\b(?:{'|'.join(words)})\\b') then '{name}'" for name, words in wording.TYPE_WORDS.items()) + " end"

_MENTIONED = ["assignment_due", "assignment_due", "quiz", "test", "exam", "presentation", "tutorial", "lab", "lecture", "project_milestone", "submission"]

ORACLE = {
    "extract_mentions": f"""with {ANNOUNCEMENTS}, p as (select *, key % 12 as k, key // 12 % 7 as phrase from announcements)
select key as doc_id, 1 as mention, {_sql_of(_MENTIONED + ['none'], 'key')} as kind, ['NONE', 'MOVE', 'CANCELLATION', 'VENUE_CHANGE', 'NONE', 'NONE', 'NONE'][phrase + 1] as change,
  head as title, 1 as times, case when phrase = 3 then 'Room 5' end as location, phrase in (0, 6) as due, false as partial, case when phrase = 2 then 'text.segment.1' else 'text' end as path, 'EXACT_TIME' as precision,
  date_trunc('day', day) + interval 150 minute as instant, cast(null as timestamp) as until, length(text) as chars
from p where k < 11 and phrase <> 4 and not (k = 9 and phrase in (1, 2, 3))""",
    "title_identity": f"""with {ANNOUNCEMENTS},
  w as (select key, lower(regexp_extract(head, '^(?:Term |Project )?([A-Za-z]+)', 1)) as word, lower(replace(head, ' #', ' ')) as plain, key % 4 + 1 as n, key % 12 as k from announcements)
select key, case when word = 'homework' then 'assignment ' || n when word in ('milestone', 'picnic') then plain else word || ' ' || n end as identity,
  case when word = 'homework' then 'assignment 2' when word in ('milestone', 'picnic') then 'the 2 ' || plain else word || ' 2' end as second from w""",
    "change_kind": f"""with {ANNOUNCEMENTS}
select key, case when key % 12 in (9, 11) then 'NONE' else ['NONE', 'MOVE', 'CANCELLATION', 'VENUE_CHANGE', 'NONE', 'NONE', 'NONE'][key // 12 % 7 + 1] end as change from announcements""",
    "event_type": f"""with {ANNOUNCEMENTS}
select key, {_TYPE} as kind, case when head ilike '%exam%' then 'exam' when head ilike '%test%' then 'test' when head ilike '%quiz%' then 'quiz' when head ilike '%discussion%' then 'discussion' when head ilike '%assignment%' then 'assignment' else 'other' end as subtype,
  regexp_matches(text, '(?i)\\b(due|deadline)\\b') as due, key % 12 not in (3, 9, 10, 11) as negated from announcements""",
    "parse_date": f"with {ANNOUNCEMENTS} select key, cast(day as date) as date, cast(day as date) as month_first from announcements",
    "parse_instant": f"with {ANNOUNCEMENTS} select key, date_trunc('day', day) + interval 150 minute as instant, 'EXACT_TIME' as precision from announcements",
    "parse_clock": """select o_orderkey as key, case when o_orderkey % 5 = 0 then case when o_orderkey % 24 between 1 and 12 then (o_orderkey % 24 % 12 + 12) * 60 + o_orderkey % 60 end
  when o_orderkey % 3 = 0 and o_orderkey % 24 <= 12 then null else o_orderkey % 24 * 60 + o_orderkey % 60 end as minutes from orders""",
    "parse_week": """select o_orderkey as key, case when o_orderkey % 60 between 1 and 53 then o_orderkey % 60 end as week, case when o_orderkey % 60 between 1 and 53 then 'WEEK_ONLY' else 'UNKNOWN' end as precision, (o_orderkey % 9) || ',3,12' as weeks from orders""",
    "date_order": "select o_orderkey as key, case when dayofmonth(o_orderdate) > 12 then case when o_orderkey % 2 = 0 then 'DMY' else 'MDY' end end as numeric_order from orders",
    "temporal_overlap": f"""with {ANNOUNCEMENTS}, b as (select key, case when key % 3 > 0 then cast(cast(day as date) - 1 as timestamp) end as low, case when key % 3 > 0 then cast(cast(day as date) + 2 as timestamp) end as high from announcements)
select * from b where low is null or (low < timestamp '1995-06-01' and high >= timestamp '1995-03-01')""",
    "extract_structured": """with o as (select o_orderkey as k, o_orderpriority as title, o_orderdate as day from orders)
select k as obs_key, 'assessment' as kind, title, 'due_at' as field, day as value, 0.95 as confidence from o where k % 3 = 0 and k % 2 = 0
union all select k, 'assessment', title, 'grading_due_at', day, 0.95 from o where k % 3 = 0 and k % 5 = 0
union all select k, 'assessment', title, 'none', null, 0.9 from o where k % 3 = 0 and k % 2 > 0 and k % 5 > 0
union all select k, 'schedule', title, 'start_at', day, 0.98 from o where k % 3 = 1 and k % 7 > 0
union all select k, 'due_item', title, 'due_at', day, 0.95 from o where k % 3 = 2 and k % 2 = 0""",
    "claim_groups": f'with {CLAIMS} select claim_key, grp as "group" from grouped',
    "successor_claims": f'with {CLAIMS} select event_id, field_name, claim_key, grp as "group" from successors',
    "project_events": f"with {CLAIMS} select event_id, field_name, value, basis, case when basis = 'OPEN' then vals end as alternatives from projected",
    "claim_states": f"""with {CLAIMS} select claim_key, case when basis = 'OPEN' then 'CONFLICTING' when g.value = p.value or g.grp = p.value then 'ACCEPTED' when basis = 'SUCCESSOR' then 'SUPERSEDED' else 'REJECTED' end as state
from grouped g join projected p using (event_id, field_name)""",
    "expired_decisions": f"with {CLAIMS} select distinct d.event_id, d.field_name, d.decision_key from decided d join grouped g using (event_id, field_name) where g.source_time > d.decided_at and g.value <> d.value",
    "event_list": f"with {CLAIMS} select event_id, max(value) filter (field_name = 'due_time') as due_time, max(value) filter (field_name = 'location') as location, count(*) filter (basis = 'OPEN') as open_fields from projected group by 1",
    "event_review": f"""with {CLAIMS}, r as (select event_id, list_sort(list(field_name) filter (value is not null)) as present, coalesce(string_agg(field_name, ',' order by field_name) filter (basis = 'OPEN'), '') as conflicts, string_agg(field_name || ':' || basis, ',' order by field_name || ':' || basis) as basis from projected group by 1)
select event_id, array_to_string(list_filter(['due_time', 'location'], lambda x: not list_contains(coalesce(present, []), x)), ',') as missing, conflicts, basis from r""",
    "event_detail": f"""with {CLAIMS} select event_id, (select count(*) from projected p where p.event_id = c.event_id) as fields, string_agg(cast(claim_key as varchar), ',' order by claim_key) as claims from claims c group by 1""",
}
