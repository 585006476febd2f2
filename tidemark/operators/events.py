"""Views of canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(rows: DataFrame, since: Column, until: Column, bounds: str = "bounds") -> DataFrame:
    """Rows whose bounds (low, high) meet [since, until); what is unbounded always does."""
    low, high = F.col(f"{bounds}.low"), F.col(f"{bounds}.high")
    return rows.where(low.isNull() | high.isNull() | ((low < until) & (high >= since)))


def order_events() -> list[Column]:
    """By the earliest time known, unknown last, then the key."""
    return [F.asc_nulls_last("due_time"), F.asc("event_id")]


def event_list(projected: DataFrame) -> DataFrame:
    """One row per event with its fields as columns."""
    value = lambda name: F.max(F.when(F.col("field_name") == name, F.col("value"))).alias(name)
    return projected.groupBy("event_id").agg(value("due_time"), value("start_time"), value("location"), value("status"), F.count_if(F.col("basis") == "OPEN").alias("open_fields"))


def review(projected: DataFrame, required: list[str]) -> DataFrame:
    """What each event lacks, what is in conflict, and what each field rests on."""
    present = F.collect_set(F.when(F.col("value").isNotNull(), F.col("field_name")))
    return projected.groupBy("event_id").agg(
        F.array_sort(F.array_except(F.array(*(F.lit(r) for r in required)), present)).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("basis") == "OPEN", F.col("field_name")))).alias("conflicts"),
        F.array_sort(F.collect_list(F.concat_ws(":", "field_name", "basis"))).alias("basis"),
    )


def detail(projected: DataFrame, claims: DataFrame) -> DataFrame:
    """Events with their fields and claims as nested arrays."""
    fields = projected.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "value", "basis"))).alias("fields"))
    nested = claims.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("claim_key", "field_name", "value", "confidence"))).alias("claims"))
    return fields.join(nested, "event_id")
