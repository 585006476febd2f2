"""State derived from append-only observations: nothing is overwritten, the newest by an explicit order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of observations; later ones win, whenever they arrive.
ORDER = ("observed_at", "run_key", "observation_key")


def newest(value: Column, order: tuple[str, ...] = ORDER, where: Column | None = None) -> Column:
    """An aggregate: ``value`` of the newest row, of those that ``where`` holds for; one shuffle, combined before it."""
    rank = F.struct(*order)
    return F.max_by(value, rank if where is None else F.when(where, rank))


def latest_by(df: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER, where: Column | None = None) -> DataFrame:
    """The newest whole row of each key."""
    rows = df if where is None else df.where(where)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(newest(F.struct(*rest), order).alias("row")).select(*keys, "row.*").select(*df.columns)


def latest_state(obs: DataFrame, keys: list[str], attributes: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """First and last time seen, and the attributes of the newest observation; arrival order doesn't matter."""
    state = obs.groupBy(*keys).agg(F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"), F.count("*").alias("observations"), newest(F.struct(*attributes), order).alias("row"))
    return state.select(*keys, "first_seen", "last_seen", "observations", *(F.col(f"row.{a}").alias(a) for a in attributes))


def merge_state(state: DataFrame, fresh: DataFrame, keys: list[str], attributes: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """A state table (keys, first_seen, last_seen, observations, order columns, attributes) with newly arrived observations."""
    arrived = fresh.select(*keys, F.col(order[0]).alias("first_seen"), F.col(order[0]).alias("last_seen"), F.lit(1).cast("long").alias("observations"), *order, *(a for a in attributes if a not in order))
    rows = state.select(*arrived.columns).unionByName(arrived) if state is not None else arrived
    extra = [a for a in attributes if a not in order]
    merged = rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"), newest(F.struct(*order, *extra), order).alias("row"))
    return merged.select(*keys, "first_seen", "last_seen", "observations", *(F.col(f"row.{c}").alias(c) for c in (*order, *extra)))


def append_observations(new: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("resource_key", "run_key", "fingerprint")) -> DataFrame:
    """The observations that aren't known yet, each key once (its earliest)."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*(c for c in new.columns if c not in key)), F.struct("observed_at", "observation_key")).alias("row"))
    return first.select(*key, "row.*").select(*new.columns).join(existing.select(*key).distinct(), list(key), "left_anti")


def assign_versions(binaries: DataFrame) -> DataFrame:
    """resource_key, sha256, first_at, first_key, version_number: the n-th distinct hash of a resource; one seen again keeps its number."""
    first = binaries.where("sha256 is not null").groupBy("resource_key", "sha256").agg(F.min(F.struct("observed_at", "observation_key")).alias("first"))
    number = F.row_number().over(Window.partitionBy("resource_key").orderBy("first", "sha256"))
    return first.select("resource_key", "sha256", F.col("first.observed_at").alias("first_at"), F.col("first.observation_key").alias("first_key"), number.cast("long").alias("version_number"))


def current_version(obs: DataFrame) -> DataFrame:
    """The version of the newest OBSERVED observation that carries one."""
    return obs.groupBy("resource_key").agg(newest(F.col("version_key"), where=(F.col("observation_status") == "OBSERVED") & F.col("version_key").isNotNull()).alias("current_version"))


def current_availability(obs: DataFrame) -> DataFrame:
    """The availability of the newest observation that says anything; UNKNOWN ones don't."""
    known = F.col("observation_status") != "UNKNOWN"
    return obs.groupBy("resource_key").agg(F.coalesce(newest(F.col("availability"), where=known), F.lit("UNKNOWN")).alias("availability"), F.count_if(~known).alias("unknown"))


def current_label(selections: DataFrame, candidates: DataFrame, default: str = "unknown") -> DataFrame:
    """Per resource: the newest manual selection, else the best candidate of its newest run that didn't fail, else a default.

    ``selections``: resource_key, selected_at, selection_key, label; ``candidates``: resource_key, run_key, status, rank, label, confidence.
    """
    manual = selections.groupBy("resource_key").agg(newest(F.col("label"), ("selected_at", "selection_key")).alias("manual"))
    usable = candidates.where("status != 'FAILED'")
    last = usable.groupBy("resource_key").agg(F.max("run_key").alias("run_key"))
    best = usable.join(last, ["resource_key", "run_key"]).groupBy("resource_key").agg(F.min_by(F.struct("label", "confidence"), F.struct("rank", "label")).alias("best"))
    keys = candidates.select("resource_key").union(selections.select("resource_key")).distinct()
    joined = keys.join(manual, "resource_key", "left").join(best, "resource_key", "left")
    confidence = F.when(F.col("manual").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("best.confidence", F.lit(0.0)))
    return joined.select("resource_key", F.coalesce("manual", "best.label", F.lit(default)).alias("label"), confidence.alias("confidence"), F.col("manual").isNotNull().alias("user_confirmed"))


def select_label(log: DataFrame) -> DataFrame:
    """Manual picks with the pick that each replaces."""
    by = Window.partitionBy("resource_key").orderBy("selected_at", "selection_key")
    return log.withColumn("supersedes", F.lag("selection_key").over(by))
