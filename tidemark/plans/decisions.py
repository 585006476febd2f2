"""Queries over logs of manual decisions, made from orders and events, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decisions
from tidemark.plans.bindings import table


def identity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources in five courses, nations as events."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    sources = customers.select(F.col("c_custkey").alias("source_key"), (F.col("c_custkey") % 5).alias("course_key"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("n"), F.col("c_nationkey"))).alias("bound_event"))
    events = nations.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("event_id"), (F.col("n_nationkey") % 5).cast("long").alias("course_key"))
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_key"), F.col("o_orderdate").alias("decided_at"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 10**6).otherwise(0)).alias("source_key"),
        F.concat(F.lit("n"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 30).otherwise(F.col("o_custkey") % 5 + 5 * (F.col("o_orderkey") % 5))).alias("event_id"),
    )
    found = decisions.identity_decisions(log, sources, events)
    return found.select("decision_key", "source_key", "event_id", F.array_join("reasons", ",").alias("reasons"), "state")


_FIELDS = ["title", "location", "event_type", "status", "start_time", "end_time", "due_time", "teacher"]
_VALUES = ["  Hall 2 ", "quiz", "CANCELLED", "2024-02-03", "2024-02-30", "2024-02-03T10:30:00Z", "7", "60", "", None]


def field_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on the fields of customers as events; lines as claims."""
    key, of = F.col("o_orderkey"), lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    picks = key % 5 == 0
    log = table(spark, sf_dir, "orders").select(
        key.alias("decision_key"), F.col("o_orderdate").alias("decided_at"), F.col("o_custkey").alias("event_id"), of(_FIELDS, F.floor(key / 3)).alias("field_name"),
        F.when(picks, F.col("o_custkey") * 8 + F.floor(key / 3) % 8 + F.when(key % 35 == 0, 1).otherwise(0)).alias("claim_key"), F.when(~picks | (key % 25 == 0), of(_VALUES, F.floor(key / 7))).alias("value"),
        F.when(~picks & (key % 4 > 0), of(["EXACT_TIME", "DATE_ONLY", "WEEK_ONLY"], key)).alias("precision"), F.when(~picks & (key % 6 < 2), "UTC").alias("zone"), F.when(key % 17 > 0, "as said").alias("original"),
    )
    customers = table(spark, sf_dir, "customer")
    claims = customers.select(F.col("c_custkey").alias("event_id"), F.posexplode(F.array(*(F.lit(f) for f in _FIELDS))).alias("n", "field_name")).select((F.col("event_id") * 8 + F.col("n")).alias("claim_key"), "event_id", "field_name")
    found = decisions.field_decisions(log, customers.where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("event_id")), claims)
    return found.select("decision_key", "event_id", "field_name", "value", "precision", F.array_join("reasons", ",").alias("reasons"), "state")


QUERIES = (identity_decisions, field_decisions)


def _list(values: list) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


_STATE = "case when reasons <> '' then 'REJECTED' when row_number() over (partition by {0}, reasons <> '' order by decided_at desc, decision_key desc) = 1 then 'ACTIVE' else 'SUPERSEDED' end as state"

ORACLE = {
    "identity_decisions": f"""with log as (
    select o_orderkey as decision_key, o_orderdate as decided_at, o_custkey + case when o_orderkey % 50 = 0 then 1000000 else 0 end as source_key,
      'n' || case when o_orderkey % 3 = 0 then o_orderkey % 30 else o_custkey % 5 + 5 * (o_orderkey % 5) end as event_id from orders),
  told as (
    select l.*, concat_ws(',', case when n_nationkey is null then 'UNKNOWN_EVENT' end, case when c_custkey is null then 'UNKNOWN_SOURCE' end,
      case when c_custkey % 5 <> n_nationkey % 5 then 'OTHER_COURSE' end, case when c_custkey % 4 = 0 and 'n' || c_nationkey <> event_id then 'BOUND_TO_ANOTHER' end) as reasons
    from log l left join nation on 'n' || n_nationkey = event_id left join customer on c_custkey = source_key)
select decision_key, source_key, event_id, reasons, {_STATE.format('source_key')} from told""",
    "field_decisions": f"""with log as (
    select o_orderkey as k, o_orderdate as decided_at, o_custkey as event_id, {_list(_FIELDS)}[o_orderkey // 3 % 8 + 1] as field_name, o_orderkey % 5 = 0 as picks,
      o_custkey * 8 + o_orderkey // 3 % 8 + case when o_orderkey % 35 = 0 then 1 else 0 end as claim_key, case when o_orderkey % 5 > 0 or o_orderkey % 25 = 0 then {_list(_VALUES)}[o_orderkey // 7 % 10 + 1] end as value,
      case when o_orderkey % 5 > 0 and o_orderkey % 4 > 0 then ['EXACT_TIME', 'DATE_ONLY', 'WEEK_ONLY'][o_orderkey % 3 + 1] end as precision, o_orderkey % 5 > 0 and o_orderkey % 6 < 2 as zoned, o_orderkey % 17 > 0 as said from orders),
  judged as (
    select *, field_name in ('start_time', 'end_time', 'due_time') as timed, field_name = 'teacher' as odd,
      case when field_name in ('start_time', 'end_time', 'due_time') then case precision when 'EXACT_TIME' then case when value like '%Z' then '2024-02-03 10:30:00' end when 'DATE_ONLY' then case when value = '2024-02-03' then value end
          when 'WEEK_ONLY' then case when value = '7' then value end end
        when field_name = 'event_type' then case when value = 'quiz' then value end when field_name = 'status' then case when value = 'CANCELLED' then value end when field_name <> 'teacher' then nullif(trim(value), '') end as stored
    from log),
  told as (
    select *, k as decision_key, concat_ws(',', case when event_id % 9 = 0 then 'UNKNOWN_EVENT' end, case when odd then 'UNKNOWN_FIELD' end, case when picks and value is not null then 'CLAIM_AND_VALUE' end,
      case when picks and k % 35 = 0 then 'CLAIM_OF_ANOTHER_FIELD' end, case when not picks and not odd and value is null then 'NO_VALUE' end, case when not picks and timed and precision is null then 'NO_PRECISION' end,
      case when not picks and timed and precision = 'EXACT_TIME' and not zoned then 'NO_ZONE' end, case when not picks and timed and precision <> 'EXACT_TIME' and zoned then 'ZONE_WITHOUT_INSTANT' end,
      case when not picks and not odd and not timed and (precision is not null or zoned) then 'TIME_DATA_ON_TEXT' end,
      case when not picks and not odd and value is not null and stored is null and (not timed or precision is not null) then 'INVALID_VALUE' end, case when not picks and not odd and not said then 'NO_ORIGINAL' end) as reasons
    from judged)
select decision_key, event_id, field_name, case when not picks then stored end as value, case when not picks and timed then precision end as precision, reasons, {_STATE.format('event_id, field_name')} from told""",
}
