"""Hand-made cases of single rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, times, wording
from tidemark.operators import changes, classify, extract, latest, library, reconcile, search, status

OBS = "resource_key long, observed_at timestamp, run_key long, observation_key long, fingerprint string, observation_status string, availability string, version_key long"


def at(day):
    return dt.datetime(2024, 1, day)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "said, kind",
    [
        ("Quiz 1 cancelled.", "CANCELLATION"),
        ("Quiz 1 has been moved to Monday.", "MOVE"),
        ("The quiz deadline was changed to Friday", "MOVE"),
        ("Lab 2 room changed to LT5", "VENUE_CHANGE"),
        ("Quiz 1 is not cancelled.", "NONE"),
        ("Was quiz 1 cancelled?", "NONE"),
        ("Quiz 1 is moved if it rains.", "NONE"),
        ("We moved house.", "NONE"),
    ],
)
def test_change_words(spark, said, kind):
    assert one(spark, said, wording.change_kind) == kind


@pytest.mark.parametrize("title, identity", [("Quiz #1", "quiz 1"), ("First Quiz", "quiz 1"), ("Homework 2 was moved to x", "assignment 2"), ("Lab", "lab"), ("Open day", "open day"), ("", "")])
def test_title_identity(spark, title, identity):
    assert one(spark, title, wording.title_identity) == identity


@pytest.mark.parametrize("said, kind", [("unit test the circuit", None), ("Unit test 3 is due", "test"), ("test on Monday", "test"), ("homework", "assignment_due"), ("nothing", None)])
def test_event_type(spark, said, kind):
    assert one(spark, said, wording.event_type) == kind


@pytest.mark.parametrize("said, date", [("2024-02-03", dt.date(2024, 2, 3)), ("Mon, 3rd February 2024", dt.date(2024, 2, 3)), ("Feb 3, 2024", dt.date(2024, 2, 3)), ("30 February 2024", None), ("soon", None)])
def test_dates(spark, said, date):
    assert one(spark, said, times.parse_date) == date


@pytest.mark.parametrize("said, minutes", [("9:05", 545), ("2.30", None), ("2.30 pm", 870), ("14.30", 870), ("12:00 am", 0), ("25:00", None)])
def test_clocks(spark, said, minutes):
    assert one(spark, said, times.parse_clock) == minutes


def test_instants_need_a_zone(spark):
    value = one(spark, "3 February 2024 at 10:30 UTC+8", times.temporal_value)
    assert value.precision == "EXACT_TIME" and value.instant == dt.datetime(2024, 2, 3, 2, 30)
    value = one(spark, "3/4/2024", times.temporal_value)
    assert value.precision == "UNKNOWN" and len(value.possible_dates) == 2
    assert one(spark, "13/4/2024", times.temporal_value).date == dt.date(2024, 4, 13)
    assert one(spark, "Weeks 1, 2 and 5", times.temporal_value).week_numbers == [1, 2, 5]
    got = spark.sql("select '36/9/4 23:59 (UTC+8)' as c, 'UTC+8' as z").select(times.visible_time(F.col("c"), F.col("z")).alias("x")).first().x
    assert got == dt.datetime(2036, 9, 4, 15, 59)


def test_words_and_urls(spark):
    assert one(spark, "Éa_b 1ß", text.tokens) == ["ea", "b", "1ß"]
    assert one(spark, "x https://me:pw@h.example.com:80/p?q=1#f y", text.redact_urls) == "x https://h.example.com:80/p y"
    assert one(spark, "<p>a &amp;lt; b</p><script>x</script>c", text.visible_text) == "a &lt; b\nc"
    assert not one(spark, "the photograph", lambda c: text.contains_phrase(text.tokens(c), "photo"))


def test_late_data_does_not_win(spark):
    rows = [(1, at(3), 1, 3, "c", "OBSERVED", "ACTIVE", 3), (1, at(1), 9, 9, "a", "OBSERVED", "MISSING", 1)]
    a, b = (spark.createDataFrame([r], OBS) for r in rows)
    for order in ((a, b), (b, a)):
        state = latest.merge_state(None, order[0], ["resource_key"], ["availability"])
        got = latest.merge_state(state, order[1], ["resource_key"], ["availability"]).first()
        assert got.availability == "ACTIVE" and got.first_seen == at(1) and got.last_seen == at(3) and got.observations == 2
    tie = spark.createDataFrame([(1, at(1), 1, 1, "a", "OBSERVED", "A", 1), (1, at(1), 2, 2, "a", "OBSERVED", "B", 1)], OBS)
    assert latest.latest_state(tie, ["resource_key"], ["availability"]).first().availability == "B"


def test_unknown_between_equal_rows_is_no_change(spark):
    rows = [(1, at(1), 1, 1, "f", "OBSERVED", "ACTIVE", 1), (1, at(2), 2, 2, None, "UNKNOWN", "UNKNOWN", None), (1, at(3), 3, 3, "f", "OBSERVED", "ACTIVE", 1), (1, at(4), 4, 4, "g", "OBSERVED", "ACTIVE", 2)]
    got = changes.recent_changes(spark.createDataFrame(rows, OBS), F.lit(at(1)), F.lit(at(9))).orderBy("observation_key").collect()
    assert [(r.observation_key, r.kinds) for r in got] == [(1, ["FIRST_OBSERVED"]), (4, ["BINARY_CHANGED", "METADATA_CHANGED"])]


def test_incomplete_inventory_keeps_state(spark):
    runs = spark.createDataFrame([(1, 1, 10, True, True), (2, 1, 11, True, True), (3, 1, 12, False, True)], "run_key long, course_key long, run_at long, complete boolean, parent_available boolean")
    known = spark.createDataFrame([(1, 5, 1, "ACTIVE")], "course_key long, resource_key long, first_at long, availability string")
    seen = spark.createDataFrame([], "run_key long, resource_key long")
    earlier = spark.createDataFrame([], "run_key long, resource_key long, run_at long")
    got = changes.inventory(runs, known, seen, earlier).orderBy("run_key").collect()
    assert [(r.observation_status, r.availability, r.removal_candidate) for r in got] == [("NOT_OBSERVED", "MISSING", False), ("NOT_OBSERVED", "MISSING", True), ("UNKNOWN", "ACTIVE", False)]


def test_freshness_needs_a_limit_to_refresh(spark):
    attempts = spark.createDataFrame([("a", at(1), 1, "SUCCEEDED", "COMPLETE", None), ("b", at(1), 1, "SUCCEEDED", "COMPLETE", 10), ("b", at(2), 2, "FAILED", "FAILED", None)], "scope string, attempted_at timestamp, run_key long, outcome string, coverage string, max_age_s long")
    got = {(r.scope, r["mode"]): r for r in status.freshness(status.fold_scopes(attempts), F.lit(at(3)), 10**9).collect()}
    assert not got["a", "REFRESH_IF_STALE"].satisfied and not got["a", "REFRESH_IF_STALE"].should_refresh
    assert got["a", "MAX_AGE"].satisfied and got["b", "MAX_AGE"].status == "STALE" and got["b", "MAX_AGE"].should_refresh
    assert got["b", "CACHE_ONLY"].satisfied and not got["a", "REQUIRE_CURRENT"].satisfied


def test_all_needs_every_term_and_any_one(spark):
    docs = spark.createDataFrame([(1, "photon energy"), (2, "mineral"), (3, "photon"), (4, ""), (5, None)], "doc_id long, body string")
    found, stats = search.postings(docs, {"body": 1.0}), search.corpus_stats(docs, ["body"])
    asked = search.query_terms(spark.createDataFrame([(1, "Photon missingterm"), (2, "photon energy"), (3, " ")], "query_id long, query string"))
    run = lambda mode: sorted((r.query_id, r.doc_id) for r in search.bm25(found, stats, asked, mode).collect())
    assert run("all") == [(2, 1)] and run("any") == [(1, 1), (1, 3), (2, 1), (2, 3)]


def test_fused_ranks(spark):
    a = spark.createDataFrame([(1, 7, 1)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    assert [(r.doc_id, round(r.rank_score, 9)) for r in search.rrf([a, b]).orderBy("rank").collect()] == [(7, round(-2 / 61, 9)), (8, round(-1 / 62, 9))]


def test_phrases_label_with_confidence(spark):
    df = spark.createDataFrame([(1, "Lab sheet 1", "lab.pdf", None), (2, "collaboration", "x", None)], "resource_key long, title string, filename string, headings string")
    rules = spark.createDataFrame([("lab", "lab"), ("lab", "lab sheet")], "label string, phrase string")
    got = {r.resource_key: (r.label, round(r.confidence, 2)) for r in classify.classify(df, rules).collect()}
    assert got == {1: ("lab", 0.9), 2: ("unknown", 0.0)}


def test_same_wording_is_one_event(spark):
    said = ["Quiz 1 due 10 February 2030 10:00 UTC.", "Quiz #1 deadline 10 February 2030 10:00 UTC.", "First Quiz due 10 February 2030.", "Quiz 1 due 11 February 2030.", "No quiz is due on 10 February 2030."]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)], "doc_id long, ordinal int, text string")
    found = extract.extract_mentions(chunks).withColumn("candidate_key", F.col("doc_id")).withColumn("course_key", F.lit(1).cast("long")).withColumn("signature", times.temporal_signature(F.get("times", F.lit(0))))
    got = {r.candidate_key: (r.outcome, r.event_id) for r in reconcile.assign_events(found).collect()}
    assert [got[i][0] for i in range(4)] == ["CREATED", "MERGED", "MERGED", "CREATED"] and 4 not in got
    assert got[0][1] == got[1][1] == got[2][1] != got[3][1]


def test_trees_and_cycles(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")], "node string, parent string")
    assert {r.node: r.depth for r in library.tree_paths(nodes).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node for r in library.find_cycles(nodes).collect()} == {"x", "y"}
