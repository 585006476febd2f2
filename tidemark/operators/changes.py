"""Change feed, omissions and fetch policy over observation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import ORDER


def with_previous(obs: DataFrame) -> DataFrame:
    """Each observation that says anything, with what its predecessor said and the last version known before it."""
    by = Window.partitionBy("resource_key").orderBy(*ORDER)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    known = obs.where("observation_status != 'UNKNOWN'")
    return known.select(
        "*",
        F.lag("observation_key").over(by).alias("previous_observation_key"),
        F.lag("fingerprint").over(by).alias("previous_fingerprint"),
        F.lag("observation_status").over(by).alias("previous_status"),
        F.lag("availability").over(by).alias("previous_availability"),
        F.last("version_key", True).over(before).alias("previous_version_key"),
    )


def change_kinds() -> Column:
    """The kinds of change of a row of ``with_previous``, in a fixed order."""
    first = F.col("previous_observation_key").isNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    version = F.col("version_key").isNotNull() & differs("version_key", "previous_version_key")
    later = F.array_compact(
        F.array(
            F.when(version, F.when(F.col("previous_version_key").isNull(), "BINARY_AVAILABLE").otherwise("BINARY_CHANGED")),
            F.when(differs("fingerprint", "previous_fingerprint"), "METADATA_CHANGED"),
            F.when(differs("observation_status", "previous_status") | differs("availability", "previous_availability"), "AVAILABILITY_CHANGED"),
        )
    )
    return F.when(first, F.array(F.when(F.col("observation_status") == "OBSERVED", "FIRST_OBSERVED").otherwise("FIRST_RECORDED"))).otherwise(later)


def recent_changes(obs: DataFrame, since: Column, until: Column) -> DataFrame:
    """Changes in [since, until); the window runs over the whole history, then time is cut."""
    found = with_previous(obs).withColumn("kinds", change_kinds())
    return found.where((F.col("observed_at") >= since) & (F.col("observed_at") < until) & (F.size("kinds") > 0))


def inventory(runs: DataFrame, known: DataFrame, seen: DataFrame, earlier_omissions: DataFrame) -> DataFrame:
    """One row per resource that a run should have seen and didn't.

    ``runs``: run_key, course_key, run_at, complete, parent_available; ``known``: course_key, resource_key, first_at,
    availability; ``seen``: run_key, resource_key; ``earlier_omissions``: run_key, resource_key, run_at.
    Only a complete run of an available parent makes a resource MISSING; else nothing is known and its state is kept.
    """
    due = runs.join(known, "course_key").where((F.col("first_at") < F.col("run_at")) & (F.col("availability") != "REMOVED_CONFIRMED"))
    unseen = due.join(seen, ["run_key", "resource_key"], "left_anti")
    sure = F.col("complete") & F.col("parent_available")
    omitted = unseen.select("run_key", "course_key", "resource_key", "run_at", F.when(sure, "NOT_OBSERVED").otherwise("UNKNOWN").alias("observation_status"), F.when(sure, "MISSING").otherwise(F.col("availability")).alias("availability"))
    all_ = omitted.select("resource_key", "run_at", (F.col("observation_status") == "NOT_OBSERVED").alias("gone"), F.lit(True).alias("mine"), "run_key", "course_key", "observation_status", "availability")
    before = earlier_omissions.select("resource_key", "run_at", F.lit(True).alias("gone"), F.lit(False).alias("mine"), "run_key")
    rows = all_.unionByName(before, allowMissingColumns=True)
    by = Window.partitionBy("resource_key").orderBy("run_at", "run_key").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.max("gone").over(by), F.lit(False)) & F.col("gone")
    return rows.withColumn("removal_candidate", again).where("mine").drop("gone", "mine")


VERIFY_EVERY_S = 7 * 24 * 3600


def fetch_policy(now_obs: DataFrame, basis: DataFrame, interval_s: int = VERIFY_EVERY_S) -> DataFrame:
    """Why each resource is or isn't fetched.

    ``now_obs``: resource_key, observed_at, current_version, requested, fingerprint, modified, revision;
    ``basis``: resource_key, verified_at, fingerprint, modified, revision - what was last verified.
    """
    b = basis.select("resource_key", F.lit(True).alias("has_basis"), *(F.col(c).alias(f"basis_{c}") for c in ("verified_at", "fingerprint", "modified", "revision")))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"basis_{c}"))
    reason = (
        F.when(F.col("current_version").isNull(), "new_resource")
        .when(F.col("requested"), "verification_requested")
        .when(F.col("has_basis").isNull(), "metadata_unknown")
        .when(~(same("fingerprint") & same("modified") & same("revision")), "metadata_changed")
        .when(F.col("basis_verified_at").isNull(), "metadata_unknown")
        .when(F.col("observed_at") >= F.col("basis_verified_at") + F.make_dt_interval(secs=F.lit(interval_s)), "verification_expired")
        .otherwise("within_verification_interval")
    )
    joined = now_obs.join(b, "resource_key", "left").withColumn("reason", reason)
    return joined.select("resource_key", "observed_at", "reason", (F.col("reason") != "within_verification_interval").alias("fetch"))


def replays(runs: DataFrame) -> DataFrame:
    """run_key, capture_id and whether an earlier run brought the same capture; such a run verifies nothing."""
    first = F.min("run_key").over(Window.partitionBy("capture_id"))
    return runs.withColumn("replay", F.col("capture_id").isNotNull() & (F.col("run_key") > first))
