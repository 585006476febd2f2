"""Events of candidates against deciding them one after another."""

import hashlib

import numpy as np

from tidemark.operators import reconcile
from tidemark.plans import wordings

SIGNATURES = [None, "date 2030-02-10", "instant 2030-02-10 10:00:00", "instant 2030-02-10 11:00:00", "date 2030-02-11", "instant 2030-02-11 10:00:00", "week 3", "week 4"]


def agree(a, b):
    return a == b or ({a.split(" ")[0], b.split(" ")[0]} == {"instant", "date"} and a.split(" ")[1] == b.split(" ")[1])


def one_after_another(rows):
    out, events = {}, {}
    for course, key, title, kind, change, signature in sorted(rows, key=lambda r: (r[4] != "NONE", r[1])):
        known = events.setdefault((course, title, kind), [])
        fits = [e for e in known if not signature or not e["times"] or any(agree(signature, t) for t in e["times"])]
        if change != "NONE":
            outcome, event = ("RELATED_CHANGE", known[0]) if len(known) == 1 else ("UNRESOLVED", None)
        else:
            outcome, event = ("MERGED", fits[0]) if len(fits) == 1 else ("UNRESOLVED" if fits else "CREATED", None)
        if event is None:
            event = {"id": f"{course}:{key}", "times": set()}
            known += [event] if outcome == "CREATED" else []
        if signature and change == "NONE":
            event["times"].add(signature)
        out[key] = (hashlib.sha256(event["id"].encode()).hexdigest(), outcome)
    return out


def test_assigned_as_one_after_another(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in rng.permutation(6000):
        course = int(rng.integers(900))
        few = rng.choice(len(SIGNATURES), 4, replace=False) if course % 2 else range(len(SIGNATURES))
        rows.append((course, int(key), "quiz 1" if course % 3 else "lab 2", ["quiz", None][int(rng.integers(6) == 0)], "MOVE" if rng.integers(8) == 0 else "NONE", SIGNATURES[rng.choice(few)]))
    frame = spark.createDataFrame(rows, "course_key long, candidate_key long, title string, kind string, change string, signature string")
    got = {r.candidate_key: (r.event_id, r.outcome) for r in reconcile.assign_events(frame).collect()}
    expected = one_after_another(rows)
    assert got == expected and {o for _, o in got.values()} == {"CREATED", "MERGED", "RELATED_CHANGE", "UNRESOLVED"}


def test_every_mention_of_every_course_is_a_candidate(spark, sf):
    found = wordings._candidates(spark, sf)
    mentions = wordings.extract_mentions(spark, sf).where("not partial").count()
    courses = wordings.announcements(spark, sf).select("course_key").distinct().count()
    got = found.selectExpr("count(*) as n", "count(distinct candidate_key) as keys", "count(distinct course_key) as courses").first()
    assert got.n == got.keys == mentions and got.courses > 0.8 * courses


def test_candidates_are_computed_once(spark):
    rows, read = [(1, key, "quiz 1", "quiz", "NONE", SIGNATURES[key % len(SIGNATURES)]) for key in range(40)], spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "course_key long, candidate_key long, title string, kind string, change string, signature string"
    frame = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    assert len(reconcile.assign_events(frame).collect()) == len(rows) and read.value == len(rows)
