"""Which event a candidate belongs to: scored matches, decisions in order, and an audit row for each.

A candidate resembles an event of its course if a title of both has the same identity, their types
agree (or one is generic) and no number contradicts.  It joins the event if more speaks for
that: a time of the same field that agrees, a shared source or context, or the wording of a
change; without a relation the types have to be the same, and a time that contradicts forbids it.

What an event is known by are facts: ``id``, ``type``, ``has`` (a field), ``at``, ``date``, ``inday`` (a time) and
``ctx`` (context).  Candidates look facts up by equality, so no two candidates are ever compared.
A fact holds from the place on, in the order of decisions, of the first candidate that brought it:
plain candidates by key, then changes, then the plain ones that resembled an event without more
reason, once again.  A decision depends on earlier places only.  So all are decided at once, facts
are drawn from the decisions, and that is repeated until nothing changes: then every one has been
decided on the facts before it.  Rounds are as many as the longest chain of candidates of which
each needs a fact of the one before, and two more.  After the first a round decides only those for
which a fact that they ask for has come to hold before their place, or no longer does.

Since events lie in one course and candidates look for events of theirs, courses don't depend on each
other.  Where there are courses enough for all cores, each is gone through once instead, in the order of
decisions: rows come sorted from the shuffle and only the facts of the course's events are held.

Only the first plain candidate of its course, identity and type can make an event: whatever becomes
of it, the next ones find an event of that identity and type.

Defined results: keys of candidates are distinct and not null; a null type is generic; a title without
identity resembles nothing, so a plain candidate makes an event of its own; a null signature is a
time that agrees with none; null lists are empty; an empty frame gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import wording
from tidemark.operators.lineage import cut, stored
from tidemark.operators.search import size_hint, small

GENERIC = "generic_course_event"
#: How sure a match is with a relation, without one, and if it only resembles.
RELATED, MATCHED, RESEMBLES = 0.95, 0.9, 0.5
#: Passes in the order of decisions; facts of events that are known before hold from 0 on.
PLAIN, CHANGE, AGAIN = 1, 2, 3
#: Outcomes of so many rounds are put together.
ROUNDS_KEPT = 6
PLACE = "struct<pass: int, key: long>"


def _concat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _time_facts(t: Column) -> Column:
    """What a time (field, signature) lets an event be known by."""
    word, day = F.split_part(t["signature"], F.lit(" "), F.lit(1)), F.split_part(t["signature"], F.lit(" "), F.lit(2))
    by_day = F.when(word == "date", _concat("date:", t["field"], ":", day)).when(word == "instant", _concat("inday:", t["field"], ":", day))
    return F.array(_concat("has:", t["field"]), _concat("at:", t["field"], ":", t["signature"]), by_day)


def _time_wanted(t: Column) -> Column:
    """The facts that a time asks for, with the role that each plays: a date agrees with an instant of its day."""
    word, day = F.split_part(t["signature"], F.lit(" "), F.lit(1)), F.split_part(t["signature"], F.lit(" "), F.lit(2))
    by_day = F.when(word == "date", _concat("inday:", t["field"], ":", day)).when(word == "instant", _concat("date:", t["field"], ":", day))
    one = lambda fact, role: F.struct(fact.alias("fact"), F.lit(role).alias("role"), t["field"].alias("field"))
    return F.array(one(_concat("has:", t["field"]), "has"), one(_concat("at:", t["field"], ":", t["signature"]), "agrees"), one(by_day, "agrees"))


def _facts(course: Column, identities: Column, kinds: Column, times_: Column, context: Column) -> Column:
    ids = F.transform(F.filter(identities, lambda i: i != ""), lambda i: _concat("id:", course, ":", i))
    kinds = F.transform(kinds, lambda k: _concat("type:", k))
    said = F.flatten(F.transform(times_, _time_facts))
    return F.array_distinct(F.array_compact(F.concat(ids, kinds, said, F.transform(context, lambda c: _concat("ctx:", c)))))


_TIMES = "array<struct<field: string, signature: string>>"


def prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with identity, number, the facts that they bring and those that they want.

    ``candidates``: course_key, candidate_key, source_key, title, kind, change, times (field, signature), context, confidence.
    """
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).cast(kind)
    rows = candidates.select(
        "course_key", F.col("candidate_key").cast("long").alias("candidate_key"), "source_key", F.coalesce(wording.title_identity(F.col("title")), F.lit("")).alias("identity"),
        F.coalesce("kind", F.lit(GENERIC)).alias("kind"), F.coalesce("change", F.lit("NONE")).alias("change"), none("times", _TIMES).alias("times"), none("context", "array<string>").alias("context"), "confidence",
    )
    one = lambda fact, role: F.struct(fact.alias("fact"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("field"))
    own = F.array(one(_concat("type:", F.col("kind")), "exact"), one(F.lit(f"type:{GENERIC}"), "generic"))
    related = F.transform("context", lambda c: F.struct(_concat("ctx:", c).alias("fact"), F.when(c.startswith("source:"), "source").otherwise("context").alias("role"), F.lit(None).cast("string").alias("field")))
    wanted = F.filter(F.concat(own, F.flatten(F.transform("times", _time_wanted)), related), lambda w: w["fact"].isNotNull())
    return rows.select(
        "*", F.regexp_extract("identity", "(?:^| )([0-9]+)$", 1).alias("number"), wanted.alias("wanted"),
        _facts(F.col("course_key"), F.array("identity"), F.array("kind"), F.col("times"), F.col("context")).alias("facts"),
    )


def _member_facts(members: DataFrame) -> DataFrame:
    """course_key, event, facts: what each source that counts says of its event."""
    bare = members.select(
        "course_key", F.col("event_id").alias("event"), F.coalesce(wording.title_identity(F.col("title")), F.lit("")).alias("identity"), F.coalesce("kind", F.lit(GENERIC)).alias("kind"),
        F.coalesce(F.col("times"), F.array().cast(_TIMES)).cast(_TIMES).alias("times"), F.coalesce(F.col("context"), F.array().cast("array<string>")).alias("context"),
    )
    facts = _facts(F.col("course_key"), F.array("identity"), F.array("kind"), F.col("times"), F.col("context"))
    number = F.regexp_extract("identity", "(?:^| )([0-9]+)$", 1)
    facts = F.concat(facts, F.when(number != "", F.array(_concat("no:", number))).otherwise(F.array().cast("array<string>")))
    return bare.select("course_key", "event", facts.alias("facts"))


def event_facts(members: DataFrame) -> DataFrame:
    """event_id, fact, place: what events are known by from the start, through the sources that are theirs and count.

    ``members``: event_id, course_key, title, kind, times, context; a row for each source.
    """
    place = F.struct(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("key"))
    return _member_facts(members).select("event", F.explode("facts").alias("fact")).distinct().select("event", "fact", place.alias("place"))


def matches(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """candidate_key, place, event and how the candidate, decided at that place, matches each event that it resembles.

    ``rows``: prepared candidates with ``place``; ``facts``: event, fact, place.  Columns: accepted and rejected signals, merge, confidence.
    """
    key = ["candidate_key", "place", "event"]
    held = size_hint(facts)
    numbers = facts.where(F.col("fact").startswith("no:")).groupBy("event").agg(F.collect_set(F.substring("fact", 4, 100)).alias("numbers"))
    named = facts.where(F.col("fact").startswith("id:")).select("event", F.col("fact").alias("block"), F.col("place").alias("since"))
    mine = rows.where("identity != ''").select(*rows.columns, _concat("id:", F.col("course_key"), ":", F.col("identity")).alias("block"))
    pairs = mine.join(held(named), "block").where("since < place").join(held(numbers), "event", "left")
    pairs = pairs.where((F.col("number") == "") | F.col("numbers").isNull() | (F.size(F.array_remove(F.col("numbers"), F.col("number"))) == 0))
    asked = pairs.select(*key, "change", "number", "kind", F.transform("times", lambda t: t["field"]).alias("fields"), F.explode("wanted").alias("w")).select("*", "w.*").drop("w")
    known = facts.select("event", "fact", F.col("place").alias("since"))
    hit = asked.join(held(known), ["event", "fact"], "left").withColumn("hit", F.coalesce(F.col("since") < F.col("place"), F.lit(False)))
    any_ = lambda role: F.bool_or(F.col("hit") & (F.col("role") == role))
    fields = lambda role: F.collect_set(F.when(F.col("hit") & (F.col("role") == role), F.col("field")))
    found = hit.groupBy(*key).agg(
        *(F.first(c).alias(c) for c in ("change", "number", "kind")), F.first("fields").alias("fields"), any_("exact").alias("exact"),
        any_("generic").alias("generic"), any_("source").alias("source"), any_("context").alias("other"), fields("has").alias("has"), fields("agrees").alias("agrees"),
    )
    found = found.withColumn("generic", F.col("generic") | (F.col("kind") == GENERIC)).where("exact or generic")
    agrees = F.size("agrees") > 0
    contradicts = F.size(F.array_except(F.array_intersect("fields", "has"), "agrees")) > 0
    related, change = F.col("source") | F.col("other"), F.col("change") != "NONE"
    merge = (agrees | related | change) & (F.col("exact") | related) & ~(contradicts & ~related & ~change)
    accepted = F.array_compact(
        F.array(
            F.lit("normalized_title"),
            F.when(F.col("exact"), "compatible_type").otherwise("generic_type_requires_relation"),
            F.when(F.col("number") != "", _concat("assessment_number:", F.col("number"))),
            F.when(agrees, "same_field_time"),
            F.when(F.col("source"), "shared_typed_source"),
            F.when(related, "shared_source_context"),
            F.when(change, _concat("explicit_change:", F.lower("change"))),
        )
    )
    rejected = F.array_compact(F.array(F.when(contradicts, "same_field_time_contradiction")))
    confidence = F.when(merge & related, RELATED).when(merge, MATCHED).otherwise(RESEMBLES)
    return found.select(*key, accepted.alias("accepted"), rejected.alias("rejected"), merge.alias("merge"), confidence.alias("confidence"))


def match_candidates(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """candidate_key, event, accepted, rejected, merge, confidence: the known events that each candidate resembles."""
    place = F.struct(F.lit(PLAIN).alias("pass"), F.col("candidate_key").alias("key"))
    return matches(prepared(candidates).withColumn("place", place), event_facts(members)).drop("place")


def _summary(found: DataFrame) -> DataFrame:
    """Of a candidate's matches when it comes first and when it comes again: how many merge, the one that does, and what the audit says of all."""
    columns = []
    for name, there in (("now", F.col("place.pass") != AGAIN), ("again", F.col("place.pass") == AGAIN)):
        one = F.when(there & F.col("merge"), F.struct("event", "accepted", "rejected", "confidence"))
        row = F.when(there, F.struct("event", "rejected"))
        seen = F.array_sort(F.collect_list(row))
        columns.append(F.struct(F.count_if(there & F.col("merge")).alias("merges"), F.min(one).alias("match"), seen.alias("seen"), F.max(F.when(there, F.col("confidence"))).alias("most")).alias(name))
    return found.groupBy("candidate_key").agg(*columns)


#: Stands for the fact by which a candidate finds an event, among those that it asks for.
SELF = "id"


def _asking(asks: DataFrame, before: DataFrame, facts: DataFrame) -> DataFrame:
    """candidate_key: for whom a fact of an event that they find by identity holds at their place in one of both frames only.

    ``asks``: candidate_key, place, block (their identity), fact; ``before``, ``facts``: event, fact, place.
    """
    moved = before.withColumnRenamed("place", "was").join(facts.withColumnRenamed("place", "now"), ["event", "fact"], "full").where("not (was <=> now)")
    moved = moved.select("event", "fact", F.least("was", "now").alias("low"), F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), F.greatest("was", "now")).alias("high"))
    named = facts.where(F.col("fact").startswith("id:")).select("event", F.col("fact").alias("block"))
    found = moved.where(F.col("fact").startswith("id:")).select(F.col("fact").alias("block"), F.lit(SELF).alias("fact"), "low", "high")
    found = found.union(moved.join(named, "event").select("block", "fact", "low", "high")).distinct()
    flips = (F.col("low") < F.col("place")) & (F.col("high").isNull() | (F.col("place") <= F.col("high")))
    return asks.join(small(stored(found)), ["block", "fact"]).where(flips).select("candidate_key").distinct()


def _latest(rounds: list[DataFrame]) -> DataFrame:
    """The rows of all rounds, of each candidate those of its last one."""
    of = [rows.withColumn("round", F.lit(n)) for n, rows in enumerate(rounds)]
    redone = reduce(DataFrame.union, [rows.select("candidate_key", "round") for rows in of[1:]]).groupBy("candidate_key").agg(F.max("round").alias("last_round"))
    joined = reduce(DataFrame.unionByName, of).join(small(redone), "candidate_key", "left")
    return joined.where(F.col("round") == F.coalesce("last_round", F.lit(0))).select(rounds[0].columns)


def _courses_apart(candidates: DataFrame, members: DataFrame) -> bool:
    """Whether no event is known in two courses (or in one and in none), and there are courses enough for all cores."""
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    if candidates.select("course_key").distinct().limit(cores).count() < cores:
        return False
    course = F.coalesce(F.col("course_key").cast("string"), F.lit(""))
    return members.where("event_id is not null").groupBy("event_id").agg(F.min(course).alias("least"), F.max(course).alias("most")).where("least != most").isEmpty()


def _compared(row: dict, facts: set) -> tuple | None:
    """What ``matches`` finds of a candidate and an event with these facts: merge, confidence, accepted, rejected; None if it doesn't resemble it."""
    hits = [(role, field) for fact, role, field in zip(row["asked"], row["roles"], row["asked_fields"]) if fact in facts]
    roles = {role for role, _ in hits}
    exact, change = "exact" in roles, row["change"] != "NONE"
    if not exact and "generic" not in roles and row["kind"] != GENERIC:
        return None
    agrees = {field for role, field in hits if role == "agrees"}
    contradicts = any(role == "has" and field not in agrees for role, field in hits)
    related = "source" in roles or "context" in roles
    merge = bool(agrees or related or change) and (exact or related) and (not contradicts or related or change)
    accepted = ["normalized_title", "compatible_type" if exact else "generic_type_requires_relation"]
    accepted += [f"assessment_number:{row['number']}"] * bool(row["number"]) + ["same_field_time"] * bool(agrees)
    accepted += ["shared_typed_source"] * ("source" in roles) + ["shared_source_context"] * related + [f"explicit_change:{row['change'].lower()}"] * change
    return merge, (RELATED if related else MATCHED) if merge else RESEMBLES, accepted, ["same_field_time_contradiction"] * contradicts


class _Course:
    """The facts of a course's events so far; ``take`` says what becomes of its next candidate, None for one that will come again."""

    def __init__(self):
        self.named, self.facts, self.numbers = defaultdict(set), defaultdict(set), defaultdict(set)
        self.waiting, self.made = set(), False

    def learn(self, event: str | None, facts: list) -> None:
        for fact in facts:
            if fact.startswith("id:"):
                self.named[fact].add(event)
            elif event is not None:  # an event without a name is known by its titles only
                (self.numbers if fact.startswith("no:") else self.facts)[event].add(fact)

    def take(self, row: dict) -> tuple | None:
        """result, event, considered, accepted, rejected, confidence"""
        plain, again, number = row["change"] == "NONE", row["pass"] == AGAIN, f"no:{row['number']}"
        if again and row["key"] not in self.waiting:
            return None
        near = [e for e in self.named.get(row["block"], ()) if not row["number"] or not self.numbers.get(e, set()) - {number}]
        seen = [(e, m) for e in sorted(near, key=lambda e: (e is not None, e or "")) if (m := _compared(row, self.facts.get(e, set())))]
        merges = [(e, m) for e, m in seen if m[0]]
        if len(merges) == 1:
            event, (_, confidence, accepted, rejected) = merges[0]
            self.learn(event, row["facts"])
            return "MERGED", event, [e for e, _ in seen], accepted, rejected, confidence
        if plain and not seen and (row["identity"] == "" or row["block"] or not self.made):
            self.made = True
            if row["block"]:
                self.learn(row["event"], row["facts"])
            return "CREATED", row["event"], [], ["no_plausible_existing_event"], [], row["confidence"]
        if plain and not again and row["block"]:
            self.waiting.add(row["key"])
            return None
        return "UNRESOLVED" if plain else "RELATED_CHANGE", None, [e for e, _ in seen], [], [x for _, m in seen for x in m[3]], max((m[1] for _, m in seen), default=0.0)


_DECIDED = "result string, event_id string, considered array<string>, accepted array<string>, rejected array<string>, confidence double"


def _in_order(open_: DataFrame, members: DataFrame) -> DataFrame:
    """What becomes of the open candidates, course by course: course_key, candidate_key and the columns of ``_DECIDED``.

    What depends on nothing has a unit of its own: a title without identity, and in no course each identity and type.
    """
    block = _concat("id:", F.col("course_key"), ":", F.col("identity"))
    alone = F.when(F.col("identity") == "", _concat("key:", F.col("candidate_key"))).otherwise(_concat("none:", F.col("kind"), ":", F.col("identity")))
    unit = F.when((F.col("identity") != "") & F.col("course_key").isNotNull(), _concat("course:", F.col("course_key"))).otherwise(alone)
    rows = open_.withColumn("unit", unit).withColumn("block", F.when(F.col("identity") != "", block))
    first = F.when(F.col("change") == "NONE", PLAIN).otherwise(CHANGE)
    passes = F.when((F.col("change") == "NONE") & F.col("block").isNotNull(), F.array(F.lit(PLAIN), F.lit(AGAIN))).otherwise(F.array(first))
    rows = rows.select(
        "unit", F.explode(passes).alias("pass"), F.col("candidate_key").alias("key"), F.col("new_event").alias("event"), "facts", "course_key", "identity", "block", "number", "kind", "change",
        F.col("wanted.fact").alias("asked"), F.col("wanted.role").alias("roles"), F.col("wanted.field").alias("asked_fields"), "confidence",
    )
    known = _member_facts(members).select(_concat("course:", F.col("course_key")).alias("unit"), F.lit(0).alias("pass"), F.lit(0).cast("long").alias("key"), "event", "facts").where("unit is not null")
    schema = StructType([open_.schema["course_key"], *StructType.fromDDL(f"candidate_key long, {_DECIDED}")])
    texts = pa.list_(pa.string())
    kinds = [pa.int64(), pa.string(), pa.string(), texts, texts, texts, pa.float64()]

    def run(batches):
        unit = course = None
        for batch in batches:
            columns = {name: batch[name] for name in batch.schema.names if name != "course_key"}
            names, values = list(columns), zip(*(c.to_pylist() for c in columns.values()))
            at, out = [], []
            for i, value in enumerate(values):
                row = dict(zip(names, value))
                if unit != row["unit"]:
                    unit, course = row["unit"], _Course()
                if row["pass"] == 0:
                    course.learn(row["event"], row["facts"])
                elif found := course.take(row):
                    at.append(i)
                    out.append((row["key"], *found))
            told = [pa.array(x, kind) for x, kind in zip(list(zip(*out)) or [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch["course_key"].take(pa.array(at, pa.int64())), *told], names=schema.names)

    ordered = known.unionByName(rows, allowMissingColumns=True).repartition("unit").sortWithinPartitions("unit", "pass", "key")
    return ordered.mapInArrow(run, schema)


def _new_event(course: Column, candidate: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws(":", course.cast("string"), candidate.cast("string"), F.coalesce(source.cast("string"), F.lit(""))), 256)


def decide(candidates: DataFrame, members: DataFrame, bound: DataFrame, manual: DataFrame, onto_known: bool = False) -> DataFrame:
    """One audit row for each candidate: course_key, candidate_key, event_id, result, considered, accepted, rejected, confidence.

    ``members``: what known events stand on (see ``event_facts``); ``bound``, ``manual``: source_key, event_id, distinct keys.  A
    manual identity is kept, then a binding.  With ``onto_known`` candidates are only held against known events, so that none
    depends on another: what a run would decide on each alone.
    """
    rows = prepared(candidates)
    kept = rows.join(manual.select("source_key", F.col("event_id").alias("picked")), "source_key", "left").join(bound.select("source_key", F.col("event_id").alias("held")), "source_key", "left")
    kept = kept.withColumn("fixed", F.coalesce("picked", "held"))
    empty = F.array().cast("array<string>")
    fixed = kept.where("fixed is not null").select(
        "course_key", "candidate_key", F.col("fixed").alias("event_id"), F.when(F.col("picked").isNotNull(), "MANUAL_RETAINED").otherwise("RETAINED").alias("result"), F.array("fixed").alias("considered"),
        F.array(F.when(F.col("picked").isNotNull(), "manual_identity").otherwise("stable_existing_binding")).alias("accepted"), empty.alias("rejected"), F.lit(1.0).alias("confidence"),
    )
    place = lambda pass_: F.struct(pass_.cast("int").alias("pass"), F.col("candidate_key").alias("key"))
    first = F.when(F.col("change") == "NONE", PLAIN).otherwise(CHANGE)
    open_ = kept.where("fixed is null").drop("picked", "held", "fixed").withColumn("new_event", _new_event(F.col("course_key"), F.col("candidate_key"), F.col("source_key")))
    if not onto_known and _courses_apart(candidates, members):
        return fixed.unionByName(_in_order(open_, members))
    # All that follows goes by candidate, so the candidates are dealt that way once.
    open_ = cut(open_.repartition("candidate_key"))
    if onto_known:  # then any may make an event
        open_ = open_.withColumn("may_make", F.lit(True))
    else:
        makers = open_.where("change = 'NONE' and identity != ''").groupBy("course_key", "identity", "kind").agg(F.min("candidate_key").alias("candidate_key")).select("candidate_key", F.lit(True).alias("may_make"))
        open_ = cut(open_.join(makers, "candidate_key", "left").withColumn("may_make", F.coalesce("may_make", F.lit(False)) | ((F.col("identity") == "") & (F.col("change") == "NONE"))))
    evals = open_.withColumn("pass", F.explode(F.when((F.col("change") == "NONE") & F.lit(not onto_known), F.array(F.lit(PLAIN), F.lit(AGAIN))).otherwise(F.array(first))))
    evals = evals.withColumn("place", place(F.col("pass"))).drop("pass")
    known = cut(event_facts(members))

    def outcome(some: DataFrame, there: DataFrame, facts: DataFrame) -> DataFrame:
        """What becomes of these open candidates, decided at these places on these facts."""
        joined = some.join(_summary(matches(there, facts)), "candidate_key", "left")
        joins, later = F.coalesce(F.col("now.merges") == 1, F.lit(False)), F.coalesce(F.col("again.merges") == 1, F.lit(False)) & F.lit(not onto_known)
        plain, nothing = F.col("change") == "NONE", F.coalesce(F.size("now.seen"), F.lit(0)) == 0
        # One that may not make an event will find one of its kind, if not in this round.
        result = F.when(joins, "MERGED").when(~plain, "RELATED_CHANGE").when(nothing & (F.col("may_make") | F.lit(onto_known)), "CREATED").when(later, "MERGED").otherwise("UNRESOLVED")
        pass_ = F.when(joins | (result != "MERGED"), first).otherwise(AGAIN)
        match = F.when(joins, F.col("now.match")).when(result == "MERGED", F.col("again.match"))
        event = F.when(result == "CREATED", F.col("new_event")).otherwise(match["event"])
        last = F.when(plain & (result != "CREATED") & ~joins & F.lit(not onto_known), F.col("again")).otherwise(F.col("now"))
        return joined.select("course_key", "candidate_key", "identity", "facts", event.alias("event"), result.alias("result"), place(pass_).alias("place"), match.alias("match"), last.alias("last"), F.col("confidence").alias("own"))

    decided = outcome(open_, evals, known)
    if not onto_known:
        decided = stored(decided)
        asks = stored(evals.where("identity != ''").select("candidate_key", "place", _concat("id:", F.col("course_key"), ":", F.col("identity")).alias("block"), F.explode(F.array_distinct(F.concat(F.array(F.lit(SELF)), F.transform("wanted", lambda w: w["fact"])))).alias("fact")))
        rounds, facts = [decided], known
        while True:
            # One without identity is found by nobody, so neither are its facts.
            brought = decided.where("event is not null and identity != ''").select("event", F.explode("facts").alias("fact"), "place")
            before, facts = facts, stored(known.union(brought).groupBy("event", "fact").agg(F.min("place").alias("place")))
            again = stored(_asking(asks, before, facts))
            if again.isEmpty():
                break
            some = small(again)
            rounds.append(stored(outcome(open_.join(some, "candidate_key", "left_semi"), evals.join(some, "candidate_key", "left_semi"), facts)))
            decided = _latest(rounds)
            if len(rounds) == ROUNDS_KEPT:  # so that plans stay short
                decided = stored(decided)
                rounds = [decided]

    events = F.coalesce(F.transform(F.col("last.seen"), lambda s: s["event"]), empty)
    against = F.coalesce(F.flatten(F.transform(F.col("last.seen"), lambda s: s["rejected"])), empty)
    made, merged = F.col("result") == "CREATED", F.col("result") == "MERGED"
    return fixed.unionByName(
        decided.select(
            "course_key", "candidate_key", F.col("event").alias("event_id"), "result", F.when(made, empty).otherwise(events).alias("considered"),
            F.when(made, F.array(F.lit("no_plausible_existing_event"))).when(merged, F.col("match.accepted")).otherwise(empty).alias("accepted"),
            F.when(made, empty).when(merged, F.col("match.rejected")).otherwise(against).alias("rejected"),
            F.when(made, F.col("own")).when(merged, F.col("match.confidence")).otherwise(F.coalesce("last.most", F.lit(0.0))).alias("confidence"),
        )
    )
