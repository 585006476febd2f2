"""Matches and decisions against deciding candidates one after another."""

import hashlib

import numpy as np
import pytest

from tidemark.operators import matching
from tidemark.plans import matching as plans

CANDIDATE = "course_key long, candidate_key long, source_key long, title string, kind string, change string, times array<struct<field: string, signature: string>>, context array<string>, confidence double"
MEMBER = "event_id string, course_key long, title string, kind string, times array<struct<field: string, signature: string>>, context array<string>"
SIGNATURES = [None, "date 2030-02-10", "instant 2030-02-10 10:00:00", "instant 2030-02-10 11:00:00", "date 2030-02-11", "week 3"]
GENERIC = matching.GENERIC


def agree(a, b):
    if a is None or b is None:
        return False
    return a == b or ({a.split(" ")[0], b.split(" ")[0]} == {"instant", "date"} and a.split(" ")[1] == b.split(" ")[1])


def identity(title):
    return " ".join((title or "").lower().split())


def number(title):
    last = identity(title).split(" ")[-1]
    return last if last.isdigit() else None


def compare(c, event):
    """None, or (merge, confidence, accepted, rejected)."""
    name = identity(c["title"])
    kind, mine = c["kind"] or GENERIC, number(c["title"])
    exact, generic = kind in event["kinds"], kind == GENERIC or GENERIC in event["kinds"]
    if not name or name not in event["ids"] or not (exact or generic) or (mine and event["numbers"] - {mine}):
        return None
    matching_time = conflicting = False
    for field, signature in c["times"] or []:
        known = [s for f, s in event["times"] if f == field]
        if any(agree(signature, s) for s in known):
            matching_time = True
        elif known:
            conflicting = True
    shared = set(c["context"] or []) & event["context"]
    change = c["change"] != "NONE"
    merge = (matching_time or bool(shared) or change) and (exact or bool(shared)) and not (conflicting and not shared and not change)
    accepted = ["normalized_title", "compatible_type" if exact else "generic_type_requires_relation"] + ([f"assessment_number:{mine}"] if mine else [])
    accepted += ["same_field_time"] * matching_time + ["shared_typed_source"] * any(x.startswith("source:") for x in shared) + ["shared_source_context"] * bool(shared)
    accepted += [f"explicit_change:{c['change'].lower()}"] * change
    return merge, 0.95 if merge and shared else 0.9 if merge else 0.5, accepted, ["same_field_time_contradiction"] * conflicting


def one_after_another(candidates, members, bound, manual):
    events, out = {}, {}

    def add(event, row):
        e = events.setdefault(event, {"course": row["course_key"], "ids": set(), "kinds": set(), "numbers": set(), "times": [], "context": set()})
        e["ids"] |= {identity(row["title"])} - {""}
        e["kinds"].add(row["kind"] or GENERIC)
        e["numbers"] |= {number(row["title"])} - {None}
        e["times"] += row["times"] or []
        e["context"] |= set(row["context"] or [])

    for m in members:
        add(m["event_id"], m)

    def decide(c, defer):
        key = c["candidate_key"]
        for fixed, result, signal in ((manual, "MANUAL_RETAINED", "manual_identity"), (bound, "RETAINED", "stable_existing_binding")):
            if c["source_key"] in fixed:
                event = fixed[c["source_key"]]
                out[key] = (event, result, [event], [signal], [], 1.0)
                return True
        found = {e: m for e, x in sorted(events.items()) if x["course"] == c["course_key"] and (m := compare(c, x))}
        merges = [e for e, m in found.items() if m[0]]
        if len(merges) == 1:
            _, confidence, accepted, rejected = found[merges[0]]
            out[key] = (merges[0], "MERGED", list(found), accepted, rejected, confidence)
            add(merges[0], c)
        elif found or c["change"] != "NONE":
            if defer and c["change"] == "NONE":
                return False
            rejected = [r for m in found.values() for r in m[3]]
            out[key] = (None, "UNRESOLVED" if c["change"] == "NONE" else "RELATED_CHANGE", list(found), [], rejected, max((m[1] for m in found.values()), default=0.0))
        else:
            source = "" if c["source_key"] is None else c["source_key"]
            event = hashlib.sha256(f"{c['course_key']}:{key}:{source}".encode()).hexdigest()
            out[key] = (event, "CREATED", [], ["no_plausible_existing_event"], [], c["confidence"])
            add(event, c)
        return True

    in_order = sorted(candidates, key=lambda c: c["candidate_key"])
    deferred = [c for c in in_order if c["change"] == "NONE" and not decide(c, True)]
    for c in [*(c for c in in_order if c["change"] != "NONE"), *deferred]:
        decide(c, False)
    return out


def made_up(seed, n, courses):
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    times = lambda: [(f, pick(SIGNATURES)) for f in ("due_time", "start_time") if rng.random() < 0.6]
    context = lambda: [pick(["content:1", "content:2", "source:7", "source:8", "remote:x"]) for _ in range(int(rng.integers(3)))] if rng.random() < 0.4 else pick([[], None])
    titles = ["quiz 1", "Quiz  1", "quiz 2", "lab", "essay on trees", None, ""]
    kinds = ["quiz", "test", "lab", GENERIC, None]
    one = lambda: {"title": pick(titles), "kind": pick(kinds), "times": times(), "context": context(), "course_key": int(rng.integers(courses))}
    members = [{**one(), "event_id": f"e{i % (n // 8)}"} for i in range(n // 5)]
    for m in members:  # an event is in one course
        m["course_key"] = int(m["event_id"][1:]) % courses
    candidates = [{**one(), "candidate_key": int(k), "source_key": pick([int(k), int(k), None]), "change": pick(["NONE"] * 6 + ["MOVE", "CANCELLATION"]), "confidence": 0.7} for k in rng.permutation(n)]
    keyed = [c["source_key"] for c in candidates if c["source_key"] is not None]
    bound, manual = {k: f"e{k % 9}" for k in keyed if k % 11 == 0}, {k: f"e{k % 7}" for k in keyed if k % 22 == 0}
    return candidates, members, bound, manual


def frames(spark, candidates, members, bound, manual):
    of = lambda rows, schema: spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.replace("array<struct<field: string, signature: string>>", "x").split(", ")) for r in rows], schema)
    pairs = lambda d: spark.createDataFrame(list(d.items()), "source_key long, event_id string")
    return of(candidates, CANDIDATE), of(members, MEMBER), pairs(bound), pairs(manual)


def told(frame):
    return {r.candidate_key: (r.event_id, r.result, r.considered, r.accepted, r.rejected, r.confidence) for r in frame.collect()}


@pytest.mark.parametrize(("seed", "n", "courses"), [(1, 300, 3), (2, 400, 40)])
def test_decisions_equal_one_after_another(spark, seed, n, courses):
    data = made_up(seed, n, courses)
    got, expected = told(matching.decide(*frames(spark, *data))), one_after_another(*data)
    assert got == expected
    assert {x[1] for x in got.values()} == {"CREATED", "MERGED", "RELATED_CHANGE", "UNRESOLVED", "RETAINED", "MANUAL_RETAINED"}


def test_a_chain_in_which_each_needs_the_one_before(spark):
    kinds = [("due_time", f"date 2030-01-{d:02}") for d in range(1, 10)]
    rows = [{"course_key": 1, "candidate_key": i, "source_key": i, "title": "quiz 1", "kind": "quiz", "change": "NONE", "times": [], "context": [f"content:{i}", f"content:{i + 1}"], "confidence": 0.7} for i in range(5)]
    rows += [{**rows[0], "candidate_key": 20 + i, "source_key": 20 + i, "context": [], "times": [t]} for i, t in enumerate(kinds[:2])]
    rows.append({**rows[0], "candidate_key": 30, "source_key": 30, "change": "MOVE", "context": [], "times": kinds[:1]})  # brings the time that one before lacked
    data = (rows, [], {}, {})
    got = told(matching.decide(*frames(spark, *data)))
    assert got == one_after_another(*data)
    assert got[20][1] == "MERGED" and got[21][1] == "UNRESOLVED" and got[4][1] == "MERGED"


def test_no_candidates(spark):
    assert matching.decide(*frames(spark, [], [], {}, {})).count() == 0


def test_query_equals_one_after_another(spark, sf):
    candidates, members, bound, manual = plans._inputs(spark, sf)
    pairs = lambda frame: {r.source_key: r.event_id for r in frame.collect()}
    dicts = lambda frame: [r.asDict(recursive=True) | {"times": [tuple(t) for t in r.times or []]} for r in frame.collect()]
    expected = one_after_another(dicts(candidates), dicts(members), pairs(bound), pairs(manual))
    got = plans.reconcile_candidates(spark, sf).collect()
    flat = lambda x: ",".join(x)
    assert {r.candidate_key: (r.event_id, r.result, r.considered, r.accepted, r.rejected, r.confidence) for r in got} == {k: (e, r, flat(c), flat(a), flat(j), f) for k, (e, r, c, a, j, f) in expected.items()}


def test_rounds_after_the_first_decide_only_what_changed(spark, monkeypatch):
    data = made_up(1, 300, 3)
    asked, real = [], matching._asking

    def counted(*args):
        found = real(*args).collect()
        asked.append({r.candidate_key for r in found})
        return spark.createDataFrame(found, "candidate_key long")

    monkeypatch.setattr(matching, "_asking", counted)
    monkeypatch.setattr(matching, "ROUNDS_KEPT", 3)
    assert told(matching.decide(*frames(spark, *data))) == one_after_another(*data)
    decided = sum(c["title"] not in (None, "") for c in data[0])
    assert len(asked) > 1 and not asked[-1] and all(len(a) < decided for a in asked), [len(a) for a in asked]


def test_a_run_onto_known_events_writes_its_candidates_once(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(matching, "cut", lambda df, cut=matching.cut: written.append(df.columns) or cut(df))
    monkeypatch.setattr(matching, "stored", lambda df, stored=matching.stored: written.append(df.columns) or stored(df))
    assert plans.decision_audit(spark, sf).count() > 0
    assert len([columns for columns in written if "candidate_key" in columns]) == 1


def test_courses_are_gone_through_once_as_rounds_would_decide(spark, monkeypatch):
    candidates, members, bound, manual = made_up(3, 500, 12)
    for c in candidates:
        if c["candidate_key"] % 31 == 0:
            c["course_key"] = None
    members = [{**members[0], "course_key": None, "event_id": "nowhere"}, {**members[0], "event_id": None}, *members]
    data = frames(spark, candidates, members, bound, manual)
    with monkeypatch.context() as m:
        m.setattr(matching, "_courses_apart", lambda *_: False)
        by_rounds = told(matching.decide(*data))
    monkeypatch.setattr(matching, "_asking", None)  # not to be asked
    assert told(matching.decide(*data)) == by_rounds and len(by_rounds) == 500


def test_long_chains_in_many_courses_take_one_run(spark, monkeypatch):
    monkeypatch.setattr(matching, "stored", None)
    rows = [
        {"course_key": c, "candidate_key": 100 * c + i, "source_key": None, "title": "quiz 1", "kind": "quiz", "change": "NONE", "times": [], "context": [f"content:{i}", f"content:{i + 1}"], "confidence": 0.7}
        for c in range(9) for i in range(60)
    ]
    data = (rows, [], {}, {})
    got = told(matching.decide(*frames(spark, *data)))
    assert got == one_after_another(*data) and sum(x[1] == "MERGED" for x in got.values()) == 9 * 59


def test_courses_that_share_an_event_are_not_taken_apart(spark):
    candidates, members, bound, manual = made_up(4, 80, 10)
    assert matching._courses_apart(*frames(spark, candidates, members, bound, manual)[:2])
    members.append({**members[0], "course_key": members[0]["course_key"] + 1})
    assert not matching._courses_apart(*frames(spark, candidates, members, bound, manual)[:2])
