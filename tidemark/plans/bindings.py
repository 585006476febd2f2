"""How the roles of the operators are filled from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of what was seen of each user."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("resource_key"),
        F.col("ts").alias("observed_at"),
        (F.col("event_id") % 7).alias("run_key"),
        F.col("event_id").alias("observation_key"),
        F.col("props").alias("fingerprint"),
        F.when(kind == "error", "UNKNOWN").when(kind == "view", "NOT_OBSERVED").otherwise("OBSERVED").alias("observation_status"),
        F.when(kind == "error", "UNKNOWN").when(kind == "view", "MISSING").otherwise("ACTIVE").alias("availability"),
        F.when(F.col("event_id") % 5 > 0, F.floor("value")).cast("long").alias("version_key"),
    )


OBSERVATIONS = """
  observations as (
    select user_id as resource_key, ts as observed_at, event_id % 7 as run_key, event_id as observation_key, props as fingerprint,
      case event_type when 'error' then 'UNKNOWN' when 'view' then 'NOT_OBSERVED' else 'OBSERVED' end as observation_status,
      case event_type when 'error' then 'UNKNOWN' when 'view' then 'MISSING' else 'ACTIVE' end as availability,
      case when event_id % 5 > 0 then cast(floor(value) as bigint) end as version_key
    from events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as attempts to read scopes: a scope is an event type and a twentieth of the users."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("user_id") % 20).alias("part"),
        F.col("ts").alias("attempted_at"),
        F.col("event_id").alias("run_key"),
        F.when(value < 2, "FAILED").otherwise("SUCCEEDED").alias("outcome"),
        F.when(value < 2, "FAILED").when(value < 8, "PARTIAL").otherwise("COMPLETE").alias("coverage"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100000).cast("long").alias("max_age_s"),
    )


ATTEMPTS = """
  attempts as (
    select event_type, user_id % 20 as part, ts as attempted_at, event_id as run_key,
      case when value < 2 then 'FAILED' else 'SUCCEEDED' end as outcome,
      case when value < 2 then 'FAILED' when value < 8 then 'PARTIAL' else 'COMPLETE' end as coverage,
      case when event_id % 3 = 0 then event_id % 100000 end as max_age_s
    from events)"""

RANK = "case {0} when 'COMPLETE' then 0 when 'STALE' then 1 when 'PARTIAL' then 2 when 'FAILED' then 4 else 3 end"
