"""What a question asks for: listings, search filters, order of hits, scopes it rests on, and how far they cover it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import newest
from tidemark.operators.search import small, top
from tidemark.operators.status import worst_coverage


def _one_of(column: str, values: tuple | None) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def listing(rows: DataFrame, key: str, courses: DataFrame | None = None, **wanted: tuple | None) -> tuple[DataFrame, list[Column]]:
    """Rows of the courses (course_key) whose columns hold one of the values asked for, and their order, the newest key first."""
    for column, values in wanted.items():
        rows = rows.where(_one_of(column, values))
    rows = rows.join(small(courses), "course_key", "left_semi") if courses is not None else rows
    return rows, [F.desc(key)]


def select_courses(courses: DataFrame, included: DataFrame | None = None, include_unavailable: bool = False) -> DataFrame:
    """Courses that are on the list (course_key), if there is one, and ACTIVE, unless others are asked for too."""
    rows = courses if include_unavailable else courses.where("availability = 'ACTIVE'")
    return rows.join(included.select("course_key").distinct(), "course_key", "left_semi") if included is not None else rows


#: Parts of a handler that say that a content item is an assessment.
ASSESSMENT_HANDLERS = ("assessment", "asmt")


def mark_assessment_content(content: DataFrame, assessments: DataFrame) -> DataFrame:
    """Content (content_id, handler, more) whose id an assessment has gets ``assessment:`` before a handler that doesn't say it."""
    ids = assessments.select("content_id").distinct().withColumn("found", F.lit(True))
    says = F.lit(False)
    for part in ASSESSMENT_HANDLERS:
        says = says | F.contains(F.lower("handler"), F.lit(part))
    handler = F.when(F.col("found") & ~F.coalesce(says, F.lit(False)), F.concat(F.lit("assessment:"), "handler")).otherwise(F.col("handler"))
    return content.join(ids, "content_id", "left").withColumn("handler", handler).select(*content.columns)


@dataclass(frozen=True)
class Filters:
    """What hits may be; an empty tuple or None asks for nothing. An origin ``derived`` stands for all that start with ``derived:``."""

    entity_kinds: tuple[str, ...] = ()
    semantic_types: tuple[str, ...] = ()
    file_formats: tuple[str, ...] = ()
    availabilities: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    course_key: object = None
    version_key: int | None = None
    min_confidence: float | None = None
    historical: bool = False


def apply_filters(docs: DataFrame, filters: Filters, current: DataFrame | None = None) -> DataFrame:
    """Rows of search documents that pass; without ``historical`` those of no version or of the resource's current one.

    ``current``: resource_key, current_version. An unknown confidence doesn't pass a least one.
    """
    rows = docs.where(_one_of("entity_kind", filters.entity_kinds) & _one_of("semantic_type", filters.semantic_types) & _one_of("file_format", filters.file_formats) & _one_of("availability", filters.availabilities))
    if filters.origins:
        plain = tuple(o for o in filters.origins if o != "derived")
        derived = F.startswith("text_origin", F.lit("derived:")) if "derived" in filters.origins else F.lit(False)
        rows = rows.where((_one_of("text_origin", plain) if plain else F.lit(False)) | derived)
    for column, value in (("course_key", filters.course_key), ("version_key", filters.version_key)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    if filters.min_confidence is not None:
        rows = rows.where(F.col("confidence") >= filters.min_confidence)
    if filters.historical or current is None:
        return rows
    joined = rows.join(current.select("resource_key", "current_version"), "resource_key", "left")
    return joined.where(F.col("version_key").isNull() | (F.col("version_key") == F.col("current_version"))).select(*rows.columns)


#: Kinds that come first among hits of equal rank.
FIRST_KINDS = ("course", "content", "material")


def order_hits() -> list[Column]:
    """By rank, kind, and the keys from course to document; missing keys count as 0."""
    kind = F.array_position(F.array(*(F.lit(k) for k in FIRST_KINDS)), F.col("entity_kind"))
    place = F.when(kind > 0, kind).otherwise(len(FIRST_KINDS) + 1)
    keys = [F.coalesce(F.col(c), F.lit(0)) for c in ("resource_key", "version_key", "chunk_key")]
    return [F.asc("rank_score"), place.asc(), F.asc("course_key"), *(k.asc() for k in keys), *(F.asc(c) for c in ("text_origin", "entity_key", "source_key", "doc_id"))]


def search_page(scored: DataFrame, docs: DataFrame, filters: Filters, current: DataFrame | None, limit: int) -> DataFrame:
    """The first ``limit`` hits of each query (query_id, doc_id, rank_score) that pass the filters; ``truncated`` says whether more follow."""
    hits = top(scored.join(apply_filters(docs, filters, current), "doc_id"), order_hits(), limit + 1)
    more = F.max("rank").over(Window.partitionBy("query_id")) > limit
    return hits.withColumn("truncated", more).where(F.col("rank") <= limit)


def with_neighbors(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Hits with the texts around their chunk, in its order: ``neighbors`` of (resource_key, chunk_key, text)."""
    around = hits.select("query_id", "doc_id", "resource_key", F.explode(F.sequence(F.col("chunk_key") - before, F.col("chunk_key") + after)).alias("at")).where("resource_key is not null")
    texts = chunks.select("resource_key", F.col("chunk_key").alias("at"), F.col("text").alias("near_text"))
    found = texts.join(small(around), ["resource_key", "at"]).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "near_text"))).alias("neighbors"))
    return hits.join(found, ["query_id", "doc_id"], "left")


def hit_events(hits: DataFrame, claims: DataFrame) -> DataFrame:
    """query_id, events (sorted keys), unresolved: the events of hits that are events or claims; a claim may have none yet.

    ``claims``: claim_key, event_key.
    """
    joined = hits.where("entity_kind in ('event', 'claim')").join(claims.select(F.col("claim_key").alias("entity_key"), "event_key", F.lit("claim").alias("entity_kind")), ["entity_key", "entity_kind"], "left")
    is_event = F.col("entity_kind") == "event"
    event = F.when(is_event, F.col("entity_key")).otherwise(F.col("event_key"))
    return joined.groupBy("query_id").agg(F.array_sort(F.collect_set(event)).alias("events"), F.bool_or(~is_event & F.col("event_key").isNull()).alias("unresolved"))


def text_coverage(courses: DataFrame, resources: DataFrame, parses: DataFrame) -> DataFrame:
    """course_key, coverage: the worst newest parse of the resources that a search's filters keep; of none it is COMPLETE.

    ``resources``: course_key, resource_key, version_key (null: none); ``parses``: version_key, parsed_at, parse_key, status,
    coverage. What isn't parsed, or can't be, is UNKNOWN.
    """
    last = parses.groupBy("version_key").agg(newest(F.struct("status", "coverage"), ("parsed_at", "parse_key")).alias("last"))
    known = F.when(F.col("last.status") != "UNSUPPORTED", F.col("last.coverage"))
    per = resources.join(last, "version_key", "left").groupBy("course_key").agg(worst_coverage(F.coalesce(known, F.lit("UNKNOWN"))).alias("coverage"))
    return courses.select("course_key").join(per, "course_key", "left").select("course_key", F.coalesce("coverage", F.lit("COMPLETE")).alias("coverage"))


#: The kinds of hits that rest on each scope of a course.
SCOPE_KINDS = {"content": ("content", "material", "chunk", "event", "claim"), "announcements": ("announcement", "event", "claim"), "assessments": ("assessment", "event", "claim")}
#: The scopes of events, and those of them that need a window of time.
EVENT_SCOPES, WINDOW_SCOPES = ("content", "announcements", "assessments"), ("schedule", "due_items")


def search_scopes(courses: DataFrame, kinds: tuple[str, ...], inventory: bool = False) -> DataFrame:
    """provider, course_key, scope: what a search for these kinds rests on; the course inventory once a provider."""
    scopes = [scope for scope, served in SCOPE_KINDS.items() if set(kinds) & set(served)]
    rows = courses.select("provider", "course_key", F.explode(F.array(*(F.lit(s) for s in scopes)).cast("array<string>")).alias("scope"))
    if not inventory and "course" not in kinds:
        return rows
    whole = courses.select("provider").distinct()
    return rows.unionByName(whole.select("provider", F.lit("courses").alias("scope")), allowMissingColumns=True)


def event_scopes(courses: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """provider, course_key, scope, since, until, coverage: UNKNOWN for scopes that need a window if none is given, else null."""
    windowed = since is not None
    rows = courses.select("provider", "course_key", F.explode(F.array(*(F.lit(s) for s in (*EVENT_SCOPES, *WINDOW_SCOPES)))).alias("scope"))
    needs = F.col("scope").isin(*WINDOW_SCOPES)
    bound = lambda at: F.when(needs, at) if windowed else F.lit(None).cast("timestamp_ntz")
    return rows.select("*", bound(since).alias("since"), bound(until).alias("until"), (F.lit(None) if windowed else F.when(needs, "UNKNOWN")).cast("string").alias("coverage"))


def time_coverage(events: DataFrame) -> DataFrame:
    """course_key, unbounded: the courses of a window's answer with events whose time is missing or too vague, which makes them PARTIAL.

    ``events``: course_key, low, high.
    """
    return events.where("low is null or high is null").groupBy("course_key").agg(F.count("*").alias("unbounded")).withColumn("coverage", F.lit("PARTIAL"))


def provenance(rows: DataFrame, name: str = "provenance") -> DataFrame:
    """Rows with where they come from nested under ``name``: the object, its observation and when that was made."""
    return rows.withColumn(name, F.struct("source_key", "observation_key", "observed_at")).drop("source_key", "observation_key", "observed_at")


def merged_warnings(*lists: Column) -> Column:
    """The distinct warnings of several lists, in the order in which they first occur."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(w, F.array().cast("array<string>")) for w in lists))))
