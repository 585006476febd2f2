"""Status, coverage and freshness: how complete and how fresh the evidence for an answer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import newest

#: Coverage from best to worst.
COVERAGE_RANK = {"COMPLETE": 0, "STALE": 1, "PARTIAL": 2, "UNKNOWN": 3, "FAILED": 4}


def rank(coverage: Column) -> Column:
    out = F.lit(3)
    for name, n in COVERAGE_RANK.items():
        out = F.when(coverage == name, n).otherwise(out)
    return out


def worst_coverage(coverage: Column) -> Column:
    """An aggregate; of nothing it is UNKNOWN."""
    return F.coalesce(F.max_by(coverage, rank(coverage)), F.lit("UNKNOWN"))


def coverage_warnings(coverage: Column) -> Column:
    """An aggregate: the distinct coverages that aren't complete, from the least bad."""
    bad = F.collect_set(F.when(coverage != "COMPLETE", F.struct(rank(coverage).alias("rank"), coverage.alias("code"))))
    return F.transform(F.array_sort(bad), lambda x: x.code)


def as_of(time: Column, strict: bool) -> Column:
    """An aggregate: the oldest evidence; strict: unknown if any is unknown."""
    return F.when(F.count_if(time.isNull()) > 0, None).otherwise(F.min(time)) if strict else F.min(time)


def library_status(courses: DataFrame, resources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts per course; each child table is summed per course before it is joined, so nothing fans out.

    ``courses``: course_key; ``resources``: course_key, resource_key, status, observed_at; ``chunks``: resource_key, usable.
    """
    per_resource = chunks.groupBy("resource_key").agg(F.count("*").alias("chunks"), F.count_if("usable").alias("usable"))
    full = resources.join(per_resource, "resource_key", "left")
    per_course = full.groupBy("course_key").agg(
        F.count("*").alias("resources"),
        F.count_if(F.col("status") == "F").alias("finished"),
        F.count_if(F.col("status") == "O").alias("open"),
        F.count_if(F.col("chunks") > 0).alias("parsed"),
        F.sum("chunks").alias("chunks"),
        F.sum("usable").alias("usable"),
        F.max("observed_at").alias("last_observed"),
    )
    joined = courses.join(per_course, "course_key", "left")
    return joined.na.fill(0, ["resources", "finished", "open", "parsed", "chunks", "usable"])


def work_counts(work: DataFrame, owner: str, statuses: list[str]) -> DataFrame:
    """Work by status, one column for each, zeros kept."""
    return work.groupBy(owner).pivot("status", statuses).count().na.fill(0)


def work_backlog(work: DataFrame, max_attempts: int) -> DataFrame:
    """Per owner: what remains, and what is blocked: failed, out of attempts, or waiting for what isn't done.

    ``work``: job_key, owner, status, attempts, depends_on.
    """
    done = work.select(F.col("job_key").alias("depends_on"), F.col("status").alias("upstream"))
    # Work that depends on nothing isn't joined: a null key would bring all of it to one task.
    waits = F.col("depends_on").isNotNull()
    free = work.where(~waits).withColumn("upstream", F.lit(None).cast(work.schema["status"].dataType))
    joined = work.where(waits).join(done, "depends_on", "left").unionByName(free)
    pending = F.col("status") == "PENDING"
    stuck = (F.col("attempts") >= max_attempts) | (F.col("depends_on").isNotNull() & F.coalesce(F.col("upstream") != "DONE", F.lit(True)))
    return joined.groupBy("owner").agg(F.count_if(F.col("status") != "DONE").alias("remaining"), F.count_if((F.col("status") == "FAILED") | (pending & stuck)).alias("blocked"))


def parse_coverage(parses: DataFrame) -> DataFrame:
    """Per course: COMPLETE only if every version has a complete parse. ``parses``: course_key, version_key, coverage (null: none)."""
    found = parses.groupBy("course_key").agg(F.count("*").alias("total"), F.count("coverage").alias("parsed"), F.count_if(F.col("coverage") == "COMPLETE").alias("complete"))
    state = F.when((F.col("total") == F.col("parsed")) & (F.col("total") == F.col("complete")), "COMPLETE").when(F.col("parsed") == 0, "UNKNOWN").otherwise("PARTIAL")
    return found.withColumn("coverage", state)


def run_status(scopes: DataFrame) -> DataFrame:
    """Per run: FAILED if all scopes failed, WARN if any isn't complete. ``scopes``: run_key, coverage."""
    state = F.when(F.bool_and(F.col("coverage") == "FAILED"), "FAILED").when(F.bool_or(F.col("coverage") != "COMPLETE"), "WARN").otherwise("OK")
    return scopes.groupBy("run_key").agg(F.count("*").alias("scopes"), state.alias("status"), F.count_if(F.col("coverage") == "FAILED").alias("failed"))


def fold_scopes(attempts: DataFrame, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Newest attempt, newest success and newest complete read of each scope, as independent maxima.

    ``attempts``: keys, attempted_at, run_key, outcome, coverage, max_age_s.
    """
    order = ("attempted_at", "run_key")
    when = F.struct(*order)
    success = F.col("outcome") == "SUCCEEDED"
    complete = success & (F.col("coverage") == "COMPLETE")
    folded = attempts.groupBy(*keys).agg(
        newest(F.struct("attempted_at", "run_key", "outcome", "coverage"), order).alias("last"),
        F.max(F.when(success, F.col("attempted_at"))).alias("last_success_at"),
        F.max(F.when(complete, when)).alias("complete"),
        newest(F.col("max_age_s"), order, F.col("max_age_s").isNotNull()).alias("max_age_s"),
    )
    return folded.select(
        *keys,
        F.col("last.attempted_at").alias("last_attempt_at"),
        F.col("last.run_key").alias("last_run_key"),
        F.col("last.outcome").alias("last_outcome"),
        F.col("last.coverage").alias("last_coverage"),
        "last_success_at",
        F.col("complete.attempted_at").alias("last_complete_at"),
        F.col("complete.run_key").alias("last_complete_run"),
        "max_age_s",
    )


#: Fixed values.
FRESHNESS_MODES = ("CACHE_ONLY", "ALLOW_STALE", "MAX_AGE", "REFRESH_IF_STALE", "REQUIRE_CURRENT")


def freshness(states: DataFrame, now: Column, max_age_s: int) -> DataFrame:
    """Every scope of ``fold_scopes`` under every mode: status, age, whether it satisfies, whether to refresh, warnings."""
    modes = F.array(*(F.lit(m) for m in FRESHNESS_MODES))
    rows = states.withColumn("mode", F.explode(modes)).withColumn("now", now)
    age = F.greatest(F.floor(F.unix_micros(F.col("now").cast("timestamp")) / 1_000_000) - F.floor(F.unix_micros(F.col("last_complete_at").cast("timestamp")) / 1_000_000), F.lit(0))
    rows = rows.withColumn("age_s", F.when(F.col("last_complete_at").isNotNull(), age))
    rows = rows.withColumn("limit_s", F.when(F.col("mode") == "MAX_AGE", F.lit(max_age_s).cast("long")).otherwise(F.col("max_age_s")))
    later = F.col("last_complete_at").isNull() | (F.struct("last_attempt_at", "last_run_key") > F.struct(F.col("last_complete_at"), F.col("last_complete_run")))
    incomplete = ((F.col("last_outcome") == "FAILED") | (F.col("last_coverage") != "COMPLETE")) & later
    known = F.col("age_s").isNotNull()
    lapsed = F.when(known, "STALE").otherwise("UNKNOWN")
    status = F.when(incomplete | ~known, lapsed).when(F.col("limit_s").isNotNull() & (F.col("age_s") > F.col("limit_s")), "STALE").otherwise("CURRENT")
    rows = rows.withColumn("incomplete", incomplete).withColumn("status", status)
    current = (F.col("last_outcome") == "SUCCEEDED") & (F.col("last_coverage") == "COMPLETE") & (F.col("last_complete_at") == F.col("last_attempt_at")) & (F.col("last_attempt_at") >= F.col("now"))
    mode = F.col("mode")
    unbounded = (mode == "REFRESH_IF_STALE") & F.col("limit_s").isNull()
    satisfied = F.when(mode.isin("CACHE_ONLY", "ALLOW_STALE"), True).when(unbounded, False).when(mode == "REQUIRE_CURRENT", F.coalesce(current, F.lit(False))).otherwise(F.col("status") == "CURRENT")
    rows = rows.withColumn("satisfied", satisfied)
    unmet = (mode == "REQUIRE_CURRENT") & ~F.col("satisfied")
    warnings = F.array_compact(
        F.array(
            F.when(~known, "NO_COMPLETE_OBSERVATION"),
            F.when(unbounded, "MAX_AGE_UNCONFIGURED"),
            F.when(F.col("limit_s").isNull(), "NO_MAX_AGE_GUARANTEE"),
            F.when(F.col("incomplete"), "LATEST_ATTEMPT_INCOMPLETE"),
            F.when(unmet, "CURRENT_COVERAGE_UNESTABLISHED"),
        )
    )
    keys = [c for c in states.columns if c not in ("last_attempt_at", "last_run_key", "last_outcome", "last_coverage", "last_success_at", "last_complete_at", "last_complete_run", "max_age_s")]
    return rows.select(
        *keys,
        "mode",
        F.when(unmet, lapsed).otherwise(F.col("status")).alias("status"),
        "age_s",
        "satisfied",
        (~F.col("satisfied") & ~unbounded & ~mode.isin("CACHE_ONLY", "ALLOW_STALE")).alias("should_refresh"),
        F.array_join(warnings, ",").alias("warnings"),
    )


def scope_coverage(scopes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Newest coverage per course and normalised kind; a course's own scope beats the global one (course null).

    ``scopes``: course, kind, attempted_at, run_key, coverage; ``aliases``: kind, normal.
    """
    named = scopes.join(F.broadcast(aliases), "kind", "left").withColumn("kind", F.coalesce("normal", "kind")).drop("normal")
    last = named.groupBy("course", "kind").agg(newest(F.col("coverage"), ("attempted_at", "run_key")).alias("coverage"))
    courses = last.where("course is not null").select("course").distinct()
    common = last.where("course is null").select("kind", F.col("coverage").alias("common"))
    kinds = last.select("kind").distinct()
    frame = courses.crossJoin(F.broadcast(kinds))  # a few kinds
    joined = frame.join(last, ["course", "kind"], "left").join(F.broadcast(common), "kind", "left")
    return joined.select("course", "kind", F.coalesce("coverage", "common", F.lit("UNKNOWN")).alias("coverage"))


def answer_status(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per request: completeness, oldest evidence, warnings, conflicts, and whether an empty answer is conclusive.

    ``items``: request, observed_at, conflict, truncated; ``coverage``: request, coverage, satisfied.
    """
    per_items = items.groupBy("request").agg(F.count("*").alias("items"), as_of(F.col("observed_at"), True).alias("as_of"), F.count_if("conflict").alias("conflicts"), F.bool_or("truncated").alias("truncated"))
    per_scope = coverage.groupBy("request").agg(worst_coverage(F.col("coverage")).alias("source"), coverage_warnings(F.col("coverage")).alias("warnings"), F.bool_and("satisfied").alias("fresh"))
    joined = per_scope.join(per_items, "request", "left").na.fill(0, ["items", "conflicts"]).na.fill(False, ["truncated"])
    complete = F.when((F.col("source") == "COMPLETE") & F.col("truncated"), "PARTIAL").when((F.col("source") == "COMPLETE") & ~F.col("fresh"), "STALE").otherwise(F.col("source"))
    return joined.select("request", "items", "as_of", "conflicts", complete.alias("completeness"), "source", F.array_join("warnings", ",").alias("warnings"), "fresh", ((F.col("items") == 0) & (complete == "COMPLETE")).alias("conclusive_empty"))
