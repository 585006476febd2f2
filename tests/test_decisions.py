"""Replay of manual decisions: what is accepted, what is rejected and why."""

from pyspark.sql import functions as F

from tidemark.operators import decisions

LOG = "decision_key long, decided_at long, event_id string, field_name string, claim_key long, value string, precision string, zone string, original string"


def test_a_source_stays_in_its_course_and_where_it_is_bound(spark):
    log = spark.createDataFrame([(1, 5, 1, "a"), (2, 6, 1, "b"), (3, 6, 1, "c"), (4, 7, 2, "a"), (5, 7, 2, "b"), (6, 1, 3, "z"), (7, 1, 9, "a"), (8, 5, 1, "a"), (9, 1, None, None)], "decision_key long, decided_at long, source_key long, event_id string")
    sources = spark.createDataFrame([(1, 10, None), (2, 10, "b"), (3, None, None)], "source_key long, course_key long, bound_event string")
    events = spark.createDataFrame([("a", 10), ("b", 10), ("c", 11)], "event_id string, course_key long")
    got = {r.decision_key: (r.state, r.reasons) for r in decisions.identity_decisions(log, sources, events).collect()}
    assert got == {
        1: ("SUPERSEDED", []), 8: ("SUPERSEDED", []), 2: ("ACTIVE", []), 3: ("REJECTED", ["OTHER_COURSE"]), 4: ("REJECTED", ["BOUND_TO_ANOTHER"]), 5: ("ACTIVE", []),
        6: ("REJECTED", ["UNKNOWN_EVENT"]), 7: ("REJECTED", ["UNKNOWN_SOURCE"]), 9: ("REJECTED", ["UNKNOWN_EVENT", "UNKNOWN_SOURCE"]),
    }


def test_values_are_checked_by_field(spark):
    one = lambda field, value, precision=None, zone=None, original="said", claim=None: (field, claim, value, precision, zone, original)
    cases = [
        (one("title", " Quiz 1 "), "Quiz 1", []),
        (one("title", " \t"[:1]), None, ["INVALID_VALUE"]),
        (one("title", "x" * 4097), None, ["INVALID_VALUE"]),
        (one("title", "x", "DATE_ONLY"), "x", ["TIME_DATA_ON_TEXT"]),
        (one("event_type", "quiz"), "quiz", []),
        (one("event_type", "party"), None, ["INVALID_VALUE"]),
        (one("status", "CANCELLED", original=" "), "CANCELLED", ["NO_ORIGINAL"]),
        (one("due_time", "2024-02-03T10:30:00+08:00", "EXACT_TIME", "SGT"), "2024-02-03 02:30:00", []),
        (one("due_time", "2024-02-03T10:30:00Z", "EXACT_TIME"), "2024-02-03 10:30:00", ["NO_ZONE"]),
        (one("due_time", "2024-02-30", "DATE_ONLY"), None, ["INVALID_VALUE"]),
        (one("due_time", "2024-02-29", "DATE_ONLY", "UTC"), "2024-02-29", ["ZONE_WITHOUT_INSTANT"]),
        (one("start_time", "53", "WEEK_ONLY"), "53", []),
        (one("start_time", "54", "WEEK_ONLY"), None, ["INVALID_VALUE"]),
        (one("end_time", "3"), None, ["NO_PRECISION"]),
        (one("end_time", None, "DATE_ONLY"), None, ["NO_VALUE"]),
        (one("teacher", "x"), None, ["UNKNOWN_FIELD"]),
        (one(None, "x"), None, ["UNKNOWN_FIELD"]),
        (one("title", None, claim=1), None, []),
        (one("title", "x", claim=1), None, ["CLAIM_AND_VALUE"]),
        (one("location", None, claim=1), None, ["CLAIM_OF_ANOTHER_FIELD"]),
        (one("title", None, claim=7), None, ["CLAIM_OF_ANOTHER_FIELD"]),
    ]
    log = spark.createDataFrame([(i, 1, "e", *row) for i, (row, _, _) in enumerate(cases)] + [(99, 2, "gone", "title", None, "x", None, None, "said")], LOG)
    claims = spark.createDataFrame([(1, "e", "title")], "claim_key long, event_id string, field_name string")
    got = {r.decision_key: r for r in decisions.field_decisions(log, spark.createDataFrame([("e",)], "event_id string"), claims).collect()}
    assert [(got[i].value, got[i].reasons) for i in range(len(cases))] == [(value, reasons) for _, value, reasons in cases]
    assert got[99].reasons == ["UNKNOWN_EVENT"]
    assert {i for i, r in got.items() if r.state == "ACTIVE"} == {17, 4, 7, 11}  # the newest accepted one of each field, equal times by key
    assert decisions.field_decisions(log.limit(0), spark.createDataFrame([("e",)], "event_id string"), claims).count() == 0


def test_many_claims_of_few_rows_are_not_broadcast(spark):
    log = spark.createDataFrame([(1, 1, "e", "title", 7, None, None, None, None), (2, 2, "e", "title", 200_001, None, None, None, None)], LOG.replace("claim_key long", "claim_key int"))
    claims = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(200_000))).alias("claim_key"), F.lit("e").alias("event_id"), F.lit("title").alias("field_name"))
    found = decisions.field_decisions(log, spark.createDataFrame([("e",)], "event_id string"), claims)
    assert "SortMergeJoin [claim_key" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.decision_key: (r.state, r.reasons) for r in found.collect()} == {1: ("ACTIVE", []), 2: ("REJECTED", ["CLAIM_OF_ANOTHER_FIELD"])}
