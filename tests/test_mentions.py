"""Times as the reader finds them, and mentions with their fields."""

import datetime as dt

import pytest

from tidemark.functions import finder
from tidemark.operators import extract


@pytest.mark.parametrize(
    "text, found",
    [
        ("on 3 February 2024, then 2024-02-05.", [("3 February 2024", "date"), ("2024-02-05", "date")]),
        ("Feb 3rd, 2024 at 10:30 (UTC+8)", [("Feb 3rd, 2024 at 10:30 (UTC+8)", "moment")]),
        ("2024-02-03T10:30:15Z and 3/4/24", [("2024-02-03T10:30:15Z", "moment"), ("3/4/24", "date")]),
        ("2.30 to 4.30pm, not 14:00 - 13:00", [("2.30 to 4.30pm", "range"), ("14:00", "clock"), ("13:00", "clock")]),
        ("Weeks 1, 2 and 5; week 7; weeks 3", [("Weeks 1, 2 and 5", "weeks"), ("week 7", "week")]),
        ("x3 May 2024, 3 May 20245, a_3/4/24, 1 2 3, Sept 4 2024", []),
        ("May 5", []),
    ],
)
def test_times_among_tokens(text, found):
    got = finder.read(text)
    assert [(x["text"], x["kind"]) for x in got] == found
    assert all(text[x["start"] : x["end"]] == x["text"] for x in got)


def test_one_half_of_the_day_holds_for_a_range():
    (x,) = finder.read("9.15 – 10.45 a.m. +05:30")
    assert (x["minutes"], x["last_minutes"], x["zone"]) == (555, 645, 330)
    assert finder.read(None) == finder.read("") == finder.read("no digits") == []
    (x,) = finder.read("2.30")  # could be either
    assert x["minutes"] is None


def mentions(spark, *texts):
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, ordinal int, text string")
    return sorted(extract.extract_mentions(chunks).collect(), key=lambda r: (r.doc_id, r.mention))


def test_blocks_of_lines(spark):
    rows = [
        "Quiz 1\nDate: 3 May 2030\nVenue\nHall 2\nTime: 10:00 to 11:30 (UTC+8)\nBring a pen\n12\nLab 2 on 5 May 2030",  # labels lead on, a plain line after a time doesn't, nor does the number of a row
        "3 May 2030\nTutorial 4 in LT1, quiz 5 due 6 May 2030",
        "Exam " + "x" * 1300 + "\n7 May 2030",  # too far
        "Assignment 3\n" + "\n".join(f"line {'abcde'[i]}" for i in range(5)) + "\nDue 8 May 2030",  # too many lines between
    ]
    got = mentions(spark, *rows)
    assert [(r.doc_id, r.mention, r.title, r.path, r.location) for r in got] == [
        (0, 1, "Quiz 1", "text.segment.1+text.segment.4", "Hall 2"), (0, 2, "Lab 2", "text.segment.7", None), (1, 2, "quiz 5", "text.segment.2", None),
    ]
    quiz = got[0]
    assert (quiz.time.instant, quiz.end_time.instant) == (dt.datetime(2030, 5, 3, 2), dt.datetime(2030, 5, 3, 3, 30))
    assert quiz.original == "Quiz 1\nDate: 3 May 2030\nVenue\nHall 2\nTime: 10:00 to 11:30 (UTC+8)" and got[2].due


def test_times_that_belong_to_a_mention(spark):
    got = mentions(
        spark,
        "Presentation from 1 May 2030 to 3 May 2030",
        "Released 1 May 2030: assignment 1 due 9 May 2030",
        "Lab 1 on 13/4/2030 and quiz on 3/4/2030",
        "Dr. Tan's lecture is on 2 May 2030 10:00",
        "Quiz 2 room changed to LT 5 from 4 May 2030",
        "No exam will be held. The exam is not held on 3 May 2030",
        "Lab 3 was cancelled.",
        "The quiz paper moved house on 3 May 2030",
        "Homework 4 in week 7",
        "",
        None,
    )
    by = {r.doc_id: r for r in got}
    assert (by[0].time.date, by[0].end_time.date) == (dt.date(2030, 5, 1), dt.date(2030, 5, 3))
    assert by[1].time.date == dt.date(2030, 5, 9) and len(by[1].times) == 2 and by[1].due
    assert by[2].times[1].date == dt.date(2030, 4, 3) and by[2].times[1].possible_dates is None  # read as the other one is
    assert by[3].time.precision == "UNKNOWN" and by[3].time.date == dt.date(2030, 5, 2)  # no zone
    assert (by[4].change, by[4].location, by[4].title) == ("VENUE_CHANGE", "LT 5", "Quiz 2")
    assert 5 not in by and 7 not in by and 9 not in by and 10 not in by
    assert (by[6].change, by[6].time, by[6].path) == ("CANCELLATION", None, None)
    assert by[8].time.week_number == 7 and by[8].time.precision == "WEEK_ONLY"
