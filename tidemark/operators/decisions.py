"""Manual decisions as a log: each is held against what it decides on, rejected with all its reasons, or replayed.

Of the accepted decisions on a key the newest, by (decided_at, decision_key), is active and the others are superseded; a
rejected one never displaces another.  Nothing is written over: the log stays, its state is derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wording
from tidemark.operators.matching import GENERIC
from tidemark.operators.search import small

#: Fields of an event, those that are times, types beside those of ``wording``, and states.
TIME_FIELDS = ["start_time", "end_time", "due_time"]
TEXT_FIELDS = ["title", "location"]
EVENT_TYPES = [*wording.TYPE_WORDS, "course_change", "cancellation", "venue_change", GENERIC]
STATES = ["SCHEDULED", "TENTATIVE", "CANCELLED", "COMPLETED", "UNKNOWN"]
MAX_CHARS, MAX_ZONE_CHARS = 4096, 200


def _text(c: Column, most: int = MAX_CHARS) -> Column:
    """Whether the text without blanks around it is neither empty nor too long."""
    return F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))


def _reasons(**rules: Column) -> Column:
    """The names of the rules that hold, in their order; one that can't be judged doesn't."""
    return F.array_compact(F.array(*(F.when(holds, name.upper()) for name, holds in rules.items())))


def replay(log: DataFrame, keys: list[str]) -> DataFrame:
    """``log`` (reasons, decided_at, decision_key) with ``state``: REJECTED, ACTIVE or SUPERSEDED."""
    order = F.struct("decided_at", "decision_key")
    fine = F.size("reasons") == 0
    newest = log.where(fine).groupBy(*keys).agg(F.max(order).alias("newest"))
    joined = log.join(newest, keys, "left")
    state = F.when(~fine, "REJECTED").when(order == F.col("newest"), "ACTIVE").otherwise("SUPERSEDED")
    return joined.select(*log.columns, state.alias("state"))


def identity_decisions(log: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """decision_key, source_key, event_id, decided_at, reasons, state of decisions on which event a source belongs to.

    ``log``: decision_key, decided_at, source_key, event_id; ``sources``: source_key, course_key, bound_event (null if free);
    ``events``: event_id, course_key.  A source stays in its course, and one that is bound can't be moved.
    """
    s = sources.select("source_key", F.col("course_key").alias("of_source"), "bound_event", F.lit(True).alias("source_there"))
    e = events.select("event_id", F.col("course_key").alias("of_event"), F.lit(True).alias("event_there"))
    joined = log.join(small(s), "source_key", "left").join(small(e), "event_id", "left")
    reasons = _reasons(
        unknown_event=F.col("event_there").isNull(),
        unknown_source=F.col("source_there").isNull(),
        other_course=F.col("of_source") != F.col("of_event"),
        bound_to_another=F.col("bound_event") != F.col("event_id"),
    )
    return replay(joined.select("decision_key", "source_key", "event_id", "decided_at", reasons.alias("reasons")), ["source_key"])


def field_decisions(log: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """decision_key, event_id, field_name, decided_at, claim_key, value, precision, reasons, state of decisions on fields.

    ``log``: decision_key, decided_at, event_id, field_name, claim_key, and for a value of one's own value, precision, zone,
    original; ``events``: event_id; ``claims``: claim_key, event_id, field_name.  A decision picks a claim of the same event and field,
    or states a value: an exact time with a zone, a date, a week from 1 to 53, or a text, type or state without any of that.
    ``value`` comes out as it is stored: trimmed, dates as yyyy-MM-dd, instants as UTC seconds.
    """
    c = claims.select("claim_key", F.col("event_id").alias("claimed_event"), F.col("field_name").alias("claimed_field"), F.lit(True).alias("claim_there"))
    joined = log.join(small(events.select("event_id", F.lit(True).alias("event_there"))), "event_id", "left").join(small(c), "claim_key", "left")
    field, value, precision = F.col("field_name"), F.trim("value"), F.col("precision")
    picks, timed = F.col("claim_key").isNotNull(), field.isin(*TIME_FIELDS)
    instant = F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    date = F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), F.lit("yyyy-MM-dd")).cast("date")
    week = value.try_cast("int")
    exact = precision == "EXACT_TIME"
    stored = (
        F.when(timed & exact, F.date_format(instant, "yyyy-MM-dd HH:mm:ss"))
        .when(timed & (precision == "DATE_ONLY"), date.cast("string"))
        .when(timed & (precision == "WEEK_ONLY"), F.when(week.between(1, 53), week.cast("string")))
        .when(field == "event_type", F.when(value.isin(*EVENT_TYPES), value))
        .when(field == "status", F.when(value.isin(*STATES), value))
        .when(field.isin(*TEXT_FIELDS), F.when(_text(value), value))
    )
    own = ~picks & field.isin(*TIME_FIELDS, *TEXT_FIELDS, "event_type", "status")
    reasons = _reasons(
        unknown_event=F.col("event_there").isNull(),
        unknown_field=~field.isin(*TIME_FIELDS, *TEXT_FIELDS, "event_type", "status") | field.isNull(),
        claim_and_value=picks & F.col("value").isNotNull(),
        claim_of_another_field=picks & (F.col("claim_there").isNull() | (F.col("claimed_event") != F.col("event_id")) | (F.col("claimed_field") != field)),
        no_value=own & F.col("value").isNull(),
        no_precision=own & timed & ~F.coalesce(precision.isin("EXACT_TIME", "DATE_ONLY", "WEEK_ONLY"), F.lit(False)),
        no_zone=own & timed & exact & ~_text(F.col("zone"), MAX_ZONE_CHARS),
        zone_without_instant=own & timed & ~exact & F.col("zone").isNotNull(),
        time_data_on_text=own & ~timed & (precision.isNotNull() | F.col("zone").isNotNull()),
        invalid_value=own & F.col("value").isNotNull() & stored.isNull() & (~timed | precision.isin("EXACT_TIME", "DATE_ONLY", "WEEK_ONLY")),
        no_original=own & ~_text(F.col("original")),
    )
    rows = joined.select("decision_key", "event_id", "field_name", "decided_at", "claim_key", F.when(~picks, stored).alias("value"), F.when(~picks & timed, precision).alias("precision"), reasons.alias("reasons"))
    return replay(rows, ["event_id", "field_name"])
