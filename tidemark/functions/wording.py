"""What English event wording says: kind of event, change, identity of a title, negation, place.

A sentence is cut into tokens once and read from its word of change: what stands to its left, past
forms of "to be" and "to have", is the subject, in which the event, its number and the part of it
that changes are looked up; whatever else stands there makes the sentence say something else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.tokens import let
from tidemark.functions.tokens import words as _words

#: Ordinals and their numbers.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}

#: Event types and their words; the first type that occurs counts.
TYPE_WORDS = {
    "assignment_due": ["assignment", "homework"],
    "quiz": ["quiz"],
    "test": ["test", "midterm"],
    "exam": ["exam", "examination"],
    "presentation": ["presentation"],
    "tutorial": ["tutorial", "tutorials"],
    "lab": ["lab", "laboratory"],
    "lecture": ["lecture"],
    "project_milestone": ["milestone"],
    "submission": ["submission"],
}
#: Words beside "test" that make it an experiment.
SCIENCE_BEFORE = ["scientific", "experimental", "laboratory", "diagnostic", "statistical", "unit"]
SCIENCE_AFTER = ["the", "a", "an", "whether", "if", "method", "model", "sample", "hypothesis", "system", "circuit"]

#: Words that name an event, that may stand before one, and that name a part of it.
EVENTS = [w for t, words in TYPE_WORDS.items() if t not in ("project_milestone", "submission") for w in words]
SUBJECTS = [*EVENTS, "submission"]
BEFORE_EVENT = ["the", *ORDINALS, "term"]
PLACE_PARTS = ["venue", "location", "room"]
TIME_PARTS = ["due", "date", "time", "schedule", "session", "deadline"]
#: Words of change, and forms of verbs before them.
CANCELLED, MOVED, CHANGED, CORRECTED = ["cancelled", "canceled"], ["moved", "postponed", "rescheduled"], ["changed", "updated"], ["corrected"]
CHANGES = [*CANCELLED, *MOVED, *CHANGED, *CORRECTED]
BE, HAVE = ["is", "are", "was", "were", "be", "been"], ["has", "have", "had", "will"]
#: What makes a statement conditional, and what is denied of an event.
CONDITIONS, DENIED = ["if", "unless", "whether"], ["held", "scheduled", "submitted", "due"]
ENDS = [".", ";"]


def _in(c: Column, known: list[str]) -> Column:
    return F.coalesce(c.isin(*known), F.lit(False))


def _all_in(words: Column, known: list[str]) -> Column:
    return F.forall(words, lambda w: _in(w, known))


def _first(words: Column, known: list[str]) -> Column:
    """The place of the first word that is known, or null."""
    return F.array_min(F.transform(words, lambda w, i: F.when(_in(w, known), i)))


def _conditional(words: Column) -> Column:
    return F.exists(words, lambda w: _in(w, CONDITIONS)) | F.exists(F.transform(words, lambda w, i: (w == "in") & F.coalesce(F.get(words, i + 1) == "case", F.lit(False))), lambda x: x)


def is_conditional(c: Column) -> Column:
    return F.when(c.rlike(rf"(?i)\b(?:{'|'.join(CONDITIONS)}|case)\b"), let(_words(c), _conditional)).when(c.isNotNull(), False)


def _change(words: Column) -> Column:
    """What a sentence says of an event by its first word of change; null if it says something else."""

    def at(p: Column) -> Column:
        left = F.reverse(F.slice(words, 1, p))
        verbs = let(F.array_position(F.transform(left, lambda w: _in(w, BE + HAVE)), False), lambda n: F.when(n > 0, n - 1).otherwise(F.size(left)).cast("int"))
        following = let(p + 1, lambda k: F.get(words, F.when(F.get(words, k) == "to", k + 1).otherwise(k)))
        facts = let(verbs, lambda n: F.struct(F.reverse(F.slice(left, n + 1, F.size(left))).alias("subject"), F.get(left, F.lit(0)).alias("verb"), n.alias("verbs")))
        return let(facts, lambda x: of(F.get(words, p), x, following))

    def of(change: Column, x: Column, following: Column) -> Column:
        passive = (x["verbs"] == 0) | _in(x["verb"], BE)
        subject = x["subject"]
        after = lambda e: F.filter(F.slice(subject, e + 2, F.size(subject)), lambda w: (w != "#") & ~w.rlike("^[0-9]"))
        told = lambda part: (
            F.when((F.size(part) == 0) & _in(change, CANCELLED) & passive, "CANCELLATION")
            .when((F.size(part) > 0) & _all_in(part, PLACE_PARTS), F.when(_in(change, ["moved", *CHANGED]) & following.isNotNull() & ~_in(following, ENDS), "VENUE_CHANGE"))
            .when(_all_in(part, TIME_PARTS), F.when(_in(change, MOVED) | ((F.size(part) > 0) & _in(change, CHANGED + CORRECTED)), "MOVE"))
        )
        return let(_first(subject, SUBJECTS), lambda e: F.when(_all_in(F.slice(subject, 1, e), BEFORE_EVENT), let(after(e), told)))

    return let(_first(words, CHANGES), at)


def change_kind(c: Column) -> Column:
    """NONE, CANCELLATION, VENUE_CHANGE or MOVE: only plain statements at the start of a sentence count."""
    plain = ~F.rtrim(c).endswith("?")
    return F.coalesce(F.when(plain & c.rlike(f"(?i){'|'.join(CHANGES)}"), let(_words(c), lambda w: F.when(~_conditional(w), _change(w)))), F.lit("NONE"))


def _is_test(words: Column) -> Column:
    """Whether "test" or "midterm" occurs, other than only beside words of science; a numbered test always counts."""
    beside = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.get(words, i - 1).alias("before"), F.get(words, i + 1).alias("after"), F.get(words, i + 2).alias("later")))
    science = F.exists(beside, lambda b: (b.word == "test") & F.coalesce(_in(b.before, SCIENCE_BEFORE) | _in(b.after, SCIENCE_AFTER), F.lit(False)))
    numbered = F.exists(beside, lambda b: (b.word == "test") & F.coalesce(F.when(b.after == "#", b.later).otherwise(b.after).rlike("^[0-9]"), F.lit(False)))
    return F.exists(words, lambda w: _in(w, TYPE_WORDS["test"])) & (~science | numbered)


def event_type(c: Column) -> Column:
    """The first type whose words occur; a test in scientific wording only if it is numbered."""

    def of(words: Column, test: Column) -> Column:
        def place(w: Column) -> Column:
            out = F.lit(None).cast("int")
            for n, (name, known) in reversed(list(enumerate(TYPE_WORDS.items()))):
                out = F.when(w.isin(*known) & (test if name == "test" else F.lit(True)), n).otherwise(out)
            return out

        return F.get(F.lit(list(TYPE_WORDS)), F.array_min(F.transform(words, place)))

    some = "|".join(w for known in TYPE_WORDS.values() for w in known)
    return F.when(c.rlike(rf"(?i){some}"), let(_words(c), lambda words: let(F.when(F.exists(words, lambda w: w.isin(*TYPE_WORDS["test"])), _is_test(words)), lambda test: of(words, test))))


def title_words(c: Column) -> Column:
    """Words and numbers of a title up to its change wording; ordinals as numbers."""
    words = _words(c)
    changes = F.filter(F.transform(words, lambda w, i: F.when(_in(w, CHANGES), i)), lambda i: i.isNotNull())
    words = F.slice(words, 1, F.coalesce(F.array_min(changes), F.size(words)))
    numbers = F.create_map(*(F.lit(x) for word, n in ORDINALS.items() for x in (word, str(n))))
    kept = F.filter(words, lambda w: w.rlike("^[a-z]+$|^[0-9]+$"))
    text = F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(numbers, w), w)), " ")
    text = F.when(F.size(changes) > 0, F.regexp_replace(text, "(?:(?:^| )(?:is|was|has been))$", "")).otherwise(text)
    return F.filter(F.split(text, " "), lambda w: w != "")


def title_identity(c: Column) -> Column:
    """What makes two titles the same event: event word and number, else all words."""
    words = title_words(c)
    nouns = [w for w in SUBJECTS if w not in ("examination", "tutorials", "laboratory", "midterm")]
    number = F.get(F.filter(words, lambda w: w.rlike("^[0-9]+$")), F.lit(0))
    noun = F.get(F.filter(words, lambda w: _in(w, nouns)), F.lit(0))
    named = F.concat_ws(" ", F.when(noun == "homework", "assignment").otherwise(noun), number)
    return F.coalesce(F.when(number.isNotNull() & noun.isNotNull(), named).otherwise(F.array_join(words, " ")), F.lit(""))


#: Words that lead from a title to its time.
_TAIL = ["start", "starts", "is", "was", "be", "been", "has", "will", "due", "date", "deadline", "on", "at", "from", "to", "by", "before", "submit", "submitted", *CHANGES]


def clean_title(c: Column) -> Column:
    """A title from the wording before a date: without a change of place, then without what only leads to the time."""
    changed_place = rf"(?i)\s(?:{'|'.join(PLACE_PARTS)})(?:\s+(?:{'|'.join(BE + HAVE)}))*\s+(?:{'|'.join(['moved', *CHANGED])})\b.*$"
    text = F.regexp_replace(F.regexp_replace(c, changed_place, ""), rf"(?i)(?:[\s:.–—|-]|\b(?:{'|'.join(_TAIL)})\b)+$", "")
    return F.substring(F.trim(F.when(F.trim(text) == "", c).otherwise(text)), 1, 500)


#: Labels of lines in announcements.
_LABELS = PLACE_PARTS + ["date", "time", "topic", "topics", "duration", "remark", "remarks"]


def location(c: Column) -> Column:
    """What follows the label of a place, up to the next label; places of staff are none."""
    label = rf"(?i)\b({'|'.join(_LABELS)})\s*[:–—-]\s*"
    names, parts = F.regexp_extract_all(F.lower(c), F.lit(label), F.lit(1)), F.split(c, label)
    said = F.filter(F.transform(names, lambda n, i: F.when(_in(n, PLACE_PARTS), F.trim(F.get(parts, i + 1)))), lambda x: x != "")
    return F.when(c.rlike(label), place(F.get(said, F.lit(0))))


def place(c: Column) -> Column:
    """The text if it can be a place: up to 200 characters, no event and nobody's office."""
    return F.when((F.length(c) <= 200) & ~F.exists(_words(c), lambda w: w.isin("staff", "office", "instructor", "lecturer", "teacher", *EVENTS)), c)


def new_place(c: Column) -> Column:
    """What a change of place leads to."""
    after = F.regexp_extract(c, rf"(?i)\b(?:{'|'.join(['moved', *CHANGED])})\s+(?:to\s+)?(.+)$", 1)
    return place(F.nullif(F.regexp_replace(after, r"(?i)(?:[\s:.,–—-]|\b(?:on|at|from|for)\b)+$", ""), F.lit("")))


#: Labels of fields that follow an event on lines of their own.
_FIELDS = ["date", "time", *PLACE_PARTS]
_BULLETS, _DASHES = ["-", "*", "•"], [":", "-", "–", "—"]


def line_facts(c: Column) -> Column:
    """Of a segment: ``label`` (it begins with that of a field), ``bare`` (it is nothing else), ``row`` (the number of a row), ``bracket`` (a date in brackets after by or due)."""

    def of(w: Column) -> Column:
        at = lambda n: F.get(w, F.lit(n))
        label = _in(at(0), _FIELDS) & (at(1).isNull() | _in(at(1), _DASHES))
        row = F.coalesce(at(0).rlike("^[0-9]{1,2}$"), F.lit(False)) & (at(1).isNull() | (_in(at(1), ["st", "nd", "rd", "th", ".", ")"]) & (F.size(w) == 2)))
        return F.struct(label.alias("label"), (label & (F.size(w) <= 2)).alias("bare"), row.alias("row"), (_in(at(0), ["("]) & _in(at(1), ["by", "due"]) & _in(F.get(w, F.size(w) - 1), [")"])).alias("bracket"))

    said = let(let(_words(c), lambda w: F.when(_in(F.get(w, F.lit(0)), _BULLETS), F.slice(w, 2, F.size(w))).otherwise(w)), of)
    nothing = F.struct(*(F.lit(False).alias(name) for name in ("label", "bare", "row", "bracket")))
    return F.when(c.rlike(rf"(?i)^\W*(?:{'|'.join(_FIELDS)}|[0-9]|(?<=\()(?:by|due))"), said).otherwise(nothing)  # most segments begin with something else


def is_negated(c: Column) -> Column:
    """Whether an event is denied: none of it, or that it is held, due or submitted."""

    def denied(words: Column, w: Column, i: Column) -> Column:
        next_ = lambda k: F.get(words, k)
        after_verb = lambda k: _in(next_(k), DENIED) | ((next_(k) == "take") & F.coalesce(next_(k + 1) == "place", F.lit(False)))
        verb = let(i + 1 + F.when(_in(next_(i + 1), BE), 1).otherwise(0), after_verb)
        return F.when(w.isin("not", "never"), F.coalesce(verb, F.lit(False))).when(w == "no", _in(next_(i + 1), EVENTS)).otherwise(False)

    said = let(_words(c), lambda words: F.exists(F.transform(words, lambda w, i: denied(words, w, i)), lambda x: x))
    return F.when(c.rlike(r"(?i)\b(?:no|not|never)\b"), said).when(c.isNotNull(), False)


def due_marker(c: Column) -> Column:
    """Whether something is due: the word, a deadline, or that it is submitted by or before a time."""
    submit = lambda words: F.exists(F.transform(words, lambda w, i: w.isin("submit", "submitted") & _in(F.get(words, i + 1), ["by", "before"])), lambda x: x)
    said = let(_words(c), lambda words: F.exists(words, lambda w: w.isin("due", "deadline")) | submit(words))
    return F.when(c.rlike("(?i)due|deadline|submit"), said).when(c.isNotNull(), False)


#: Titles of people, whose full stop ends no sentence.
TITLES = ["dr.", "prof."]


def segments(c: Column) -> Column:
    """Sentences and clauses, without empty ones: each word of a line says whether one ends after it.

    One ends after a word with a mark of sentences, unless that is a title, and at a comma before the word of an event.
    """

    def ended(words: Column, w: Column, i: Column) -> Column:
        event_next = lambda: _in(F.regexp_extract(F.lower(F.get(words, i + 1)), r"^\p{L}+", 0), EVENTS)
        return F.when(F.right(w, F.lit(1)).isin(".", "!", "?") & ~_in(F.lower(w), TITLES), F.concat(w, F.lit("\n"))).when(w.endswith(",") & event_next(), F.concat(F.substr(w, F.lit(1), F.length(w) - 1), F.lit("\n"))).otherwise(F.concat(w, F.lit(" ")))

    of_line = lambda line: F.split(let(F.split(line, "[ \t]+"), lambda words: F.array_join(F.transform(words, lambda w, i: ended(words, w, i)), "")), "\n")
    parts = F.flatten(F.transform(F.split(c, "[\r\n;]+"), of_line))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def assessment_subtype(c: Column) -> Column:
    out = F.lit("other")
    for name in ("exam", "test", "quiz", "discussion", "assignment"):
        out = F.when(F.lower(c).contains(name), name).otherwise(out)
    return out
