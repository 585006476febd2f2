"""Sources of events and work: who owns them, which are active, what they share, and what has changed since they were reconciled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def denormalised(objects: DataFrame, courses: DataFrame, content: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources with their content, course and provider; a link that is missing leaves the row out.

    ``objects``: object_key, provider; ``courses``: course_key, object_key; ``content``: content_key, course_key; ``resources``: content_key, more.
    """
    return resources.join(content, "content_key").join(courses, "course_key").join(objects, "object_key")


def owner_union(tables: dict[str, DataFrame]) -> DataFrame:
    """source_key, course_key, owner: the objects of several tables (source_key, course_key) under their names."""
    return reduce(DataFrame.unionByName, (t.select("source_key", "course_key", F.lit(name).alias("owner")) for name, t in tables.items()))


def observation_owner(observations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """observation_key, course_key: the course of the object that was observed; of objects without a course none."""
    return observations.join(owner_union(tables), "source_key").select("observation_key", "course_key").distinct()


def work_owner(work: DataFrame, versions: DataFrame, observed: DataFrame) -> DataFrame:
    """Work with ``owner``: its own course_key, else that of its version, else that of its observation.

    ``versions``: version_key, course_key; ``observed``: observation_key, course_key; keys distinct.
    """
    joined = work.join(versions.select("version_key", F.col("course_key").alias("by_version")), "version_key", "left")
    joined = joined.join(observed.select("observation_key", F.col("course_key").alias("by_observation")), "observation_key", "left")
    return joined.select(*work.columns, F.coalesce("course_key", "by_version", "by_observation").alias("owner"))


def active_sources(sources: DataFrame, effective: DataFrame, bound: DataFrame, picked: DataFrame) -> DataFrame:
    """Sources with ``active``: a current extraction holds their candidate, or an active decision their identity or one of their claims.

    ``sources``: source_key, candidate_key; ``effective``: candidate_key; ``bound``, ``picked``: source_key.
    """
    keys = sources.join(effective, "candidate_key", "left_semi").select("source_key").union(bound.select("source_key")).union(picked.select("source_key")).distinct()
    return sources.join(keys.withColumn("found", F.lit(True)), "source_key", "left").select(*sources.columns, F.coalesce("found", F.lit(False)).alias("active"))


def active_claims(claims: DataFrame, active: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims that count: of a source that is active or picked by an active decision; local ones if such a decision made them.

    ``claims``: claim_key, source_key, origin (SOURCE, LOCAL_DECISION); ``active``: source_key, active; ``decisions``:
    selected_claim, local_claim, of active decisions only.
    """
    selected = decisions.select(F.col("selected_claim").alias("claim_key"), F.lit("SOURCE").alias("origin"))
    local = decisions.select(F.col("local_claim"), F.lit("LOCAL_DECISION"))
    of_source = claims.where("origin = 'SOURCE'").join(active.where("active"), "source_key", "left_semi").select("claim_key", "origin")
    keys = of_source.union(selected).union(local).where("claim_key is not null").distinct()
    return claims.join(keys, ["claim_key", "origin"], "left_semi")


def list_claims(claims: DataFrame, active: DataFrame, decisions: DataFrame) -> DataFrame:
    """All claims with ``active``: whether they count."""
    counting = active_claims(claims, active, decisions).select("claim_key", "origin").distinct().withColumn("found", F.lit(True))
    return claims.join(counting, ["claim_key", "origin"], "left").select(*claims.columns, F.coalesce("found", F.lit(False)).alias("active"))


def list_records(rows: DataFrame, key: str, courses: DataFrame | None = None, runs: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """Sources, claims, conflicts or decisions of courses (course_key) or runs (run_key), and their order."""
    for by, wanted in (("course_key", courses), ("run_key", runs)):
        rows = rows.join(wanted, by, "left_semi") if wanted is not None else rows
    return rows, [F.asc(key)]


def event_confidence(claims: DataFrame) -> DataFrame:
    """event_id, confidence (mean), sources (distinct), over active claims; ``claims``: event_id, source_key, confidence."""
    per = claims.groupBy("event_id", "source_key").agg(F.sum("confidence").alias("total"), F.count("confidence").alias("n"))
    return per.groupBy("event_id").agg((F.sum("total") / F.sum("n")).alias("confidence"), F.count("source_key").alias("sources"))


def source_context(sources: DataFrame, assessments: DataFrame, due_items: DataFrame, contents: DataFrame) -> DataFrame:
    """source_key, context: sorted tokens of what a source stands on (``source:``, ``content:``, ``remote:``).

    ``sources``: source_key, kind (ASSESSMENT, DUE_ITEM, DOCUMENT, more), object_key, locator_key; ``assessments``: object_key,
    content_key, remote_key; ``due_items``: object_key, item_source; ``contents``: locator_key, content_key.
    """
    a = assessments.select(F.lit("ASSESSMENT").alias("kind"), "object_key", F.col("content_key").alias("a_content"), "remote_key")
    d = due_items.select(F.lit("DUE_ITEM").alias("kind"), "object_key", "item_source")
    c = contents.select(F.lit("DOCUMENT").alias("kind"), "locator_key", "content_key")
    joined = sources.join(a, ["kind", "object_key"], "left").join(d, ["kind", "object_key"], "left").join(c, ["kind", "locator_key"], "left")
    token = lambda name, value: F.concat(F.lit(f"{name}:"), F.col(value).cast("string"))
    tokens = [token("source", "object_key"), token("content", "a_content"), token("remote", "remote_key"), token("remote", "item_source"), token("content", "content_key")]
    return joined.select("source_key", F.array_sort(F.array_distinct(F.array_compact(F.array(*tokens)))).alias("context"))


def shares_context(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def input_hashes(inputs: DataFrame) -> DataFrame:
    """course_key, input_hash: one hash of all inputs (course_key, input_key, content_hash) of a course, whatever their order.

    Sums of two hashes of each row, so that no course is gathered in one place.
    """
    row = [F.pmod(F.xxhash64(F.lit(seed), "input_key", "content_hash"), F.lit(2**61)).cast("decimal(38,0)") for seed in (0, 1)]
    sums = inputs.groupBy("course_key").agg(F.sum(row[0]).alias("s0"), F.sum(row[1]).alias("s1"), F.count("*").alias("n"))
    return sums.select("course_key", F.sha2(F.concat_ws(":", "s0", "s1", "n"), 256).alias("input_hash"))


def changed_courses(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """course_key, input_hash of the courses whose inputs aren't those of their last run; ``done``: course_key, input_hash."""
    return input_hashes(inputs).join(done, ["course_key", "input_hash"], "left_anti")


def unresolved(sources: DataFrame) -> DataFrame:
    """course_key, unresolved: courses with active sources whose event isn't known. ``sources``: course_key, event_id, state, active."""
    open_ = sources.where("active and (event_id is null or state = 'UNRESOLVED')")
    return open_.groupBy("course_key").agg(F.count("*").alias("unresolved"))


def run_counts(steps: DataFrame) -> DataFrame:
    """run_key and what a run observed, failed on, marked missing and left uncertain; ``steps``: run_key, outcome, availability, status."""
    return steps.groupBy("run_key").agg(
        F.count_if(F.col("status") == "OBSERVED").alias("observed"),
        F.count_if(F.col("outcome") == "FAILED").alias("failed"),
        F.count_if(F.col("availability") == "MISSING").alias("missing"),
        F.count_if(F.col("status") == "UNKNOWN").alias("uncertain"),
    )
