"""Dated events from wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times, wording
from tidemark.functions.finder import found_in_each
from tidemark.functions.tokens import let
from tidemark.operators.lineage import once

PER_CHUNK, PER_DOCUMENT = 100, 1000
CONTEXT_SEGMENTS, CONTEXT_CHARS = 5, 1200
ORIGINAL_CHARS = 4096


def extract_observations(obs: DataFrame) -> DataFrame:
    """Structured rows to candidates, one for each time that they say: obs_key, kind, title, field, value, confidence.

    ``obs``: obs_key, kind (assessment, schedule, due_item), title, due_at, grading_due_at, start_at.
    """
    one = lambda field, confidence: F.when(F.col(field).isNotNull(), F.struct(F.lit(field).alias("field"), F.col(field).alias("value"), F.lit(confidence).alias("confidence")))
    none = F.struct(F.lit("none").alias("field"), F.lit(None).cast("timestamp_ntz").alias("value"), F.lit(0.9).alias("confidence"))
    due = F.array_compact(F.array(one("due_at", 0.95), one("grading_due_at", 0.95)))
    found = (
        F.when(F.col("kind") == "assessment", F.when(F.size(due) > 0, due).otherwise(F.array(none)))
        .when(F.col("kind") == "schedule", F.array_compact(F.array(one("start_at", 0.98))))
        .otherwise(F.array_compact(F.array(one("due_at", 0.95))))
    )
    return obs.select("obs_key", "kind", "title", F.explode(found).alias("x")).select("obs_key", "kind", "title", "x.*")


def blocks(facts: Column) -> Column:
    """First and last place of each mention among the segments of a chunk, in one pass over their facts.

    A segment that names an event begins one; others join it up to ``CONTEXT_SEGMENTS`` and ``CONTEXT_CHARS``, to the
    number of a row, and, once it has a time, as long as a label leads on.
    """
    kind = "struct<found: array<struct<a: int, b: int>>, open: boolean, chars: int, timed: boolean, bare: boolean>"
    start = F.from_json(F.lit('{"found": [], "open": false, "chars": 0, "timed": false, "bare": false}'), kind)

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc["found"], F.size(acc["found"]) - 1)
        state = lambda found, chars, timed: F.struct(found.alias("found"), F.lit(True).alias("open"), chars.cast("int").alias("chars"), timed.alias("timed"), x["bare"].alias("bare"))
        begun = state(F.concat(acc["found"], F.array(F.struct(x["i"].alias("a"), x["i"].alias("b")))), x["chars"], x["dated"])
        longer = F.concat(F.slice(acc["found"], 1, F.size(acc["found"]) - 1), F.array(F.struct(last["a"].alias("a"), x["i"].alias("b"))))
        leads_on = ~acc["timed"] | x["label"] | acc["bare"] | (x["bracket"] & x["dated"])
        fits = (x["i"] - last["a"] <= CONTEXT_SEGMENTS) & (acc["chars"] + x["chars"] <= CONTEXT_CHARS)
        joined = state(longer, acc["chars"] + x["chars"], acc["timed"] | x["dated"])
        return F.when(x["kind"].isNotNull(), begun).when(acc["open"] & ~x["row"] & leads_on & F.coalesce(fits, F.lit(False)), joined).otherwise(acc.withField("open", F.lit(False)))

    return F.aggregate(facts, start, step, lambda acc: acc["found"])


def extract_mentions(chunks: DataFrame) -> DataFrame:
    """doc_id, ordinal, mention, kind, change, title, times (all of its block), time and end_time (its own), location, due, text,
    original (as it was cut) and path (the segments of the time).

    Nothing is shuffled: a chunk's segments stay an array until its mentions are known.  Negated, questioned and
    conditional events are none, nor is one without a time that isn't cancelled and doesn't change its place, nor one with a
    word of change that says no change.  Numeric dates are read in the order that the chunk's own dates show.
    """
    rows = once(chunks.select("doc_id", "ordinal", "text"), segments=wording.segments(F.col("text")), order=times.date_order(F.col("text"))).where("size(segments) > 0").drop("text")
    rows = rows.withColumn("found", found_in_each(F.col("segments")))
    dated = lambda x: x["kind"].isin("date", "moment", "week", "weeks")

    def facts(s: Column, i: Column) -> Column:
        says = lambda line: F.struct(
            i.alias("i"), wording.event_type(s).alias("kind"), F.length(s).alias("chars"), F.exists(F.get("found", i), dated).alias("dated"), *(line[name].alias(name) for name in ("label", "bare", "row", "bracket")),
        )
        return let(wording.line_facts(s), says)

    rows = once(rows, facts=F.transform("segments", facts))
    rows = rows.select("doc_id", "ordinal", "segments", "order", "found", F.transform("facts", lambda x: x["kind"]).alias("kinds"), F.transform("facts", lambda x: x["bare"]).alias("bare"), F.posexplode(blocks(F.col("facts"))).alias("nth", "block"))
    a, b = F.col("block.a"), F.col("block.b")
    anchor = F.get("segments", a)
    mine = F.flatten(F.transform(F.sequence(a, b), lambda k: F.transform(F.get("found", k), lambda x: F.struct(k.alias("segment"), x.alias("x")))))
    rows = once(rows, anchor=anchor, kind=F.get("kinds", a), said=F.slice("segments", a + 1, b - a + 1), mine=mine)
    rows = rows.where(~wording.is_negated(F.col("anchor")) & ~F.rtrim("anchor").endswith("?") & ~wording.is_conditional(F.col("anchor")))
    rows = once(rows, change=wording.change_kind(F.col("anchor")), text=F.array_join("said", " "), due_at=F.regexp_instr("anchor", F.lit(r"(?i)\b(?:due|deadline)\b")), dated=F.filter("mine", lambda m: dated(m["x"])))
    named = F.col("anchor").rlike(rf"(?i)\b(?:{'|'.join(wording.CHANGES)})\b")
    rows = rows.where((F.col("change").isin("CANCELLATION", "VENUE_CHANGE") | (F.size("dated") > 0)) & ~((F.col("change") == "NONE") & named))

    # The time of a mention that is due is the first one after that word.
    after_due = F.filter("dated", lambda m: (m["segment"] > a) | (m["x"]["start"] >= F.col("due_at")))
    rows = once(rows, main=F.coalesce(F.get(after_due, F.lit(0)), F.get("dated", F.lit(0))))
    later = F.filter("mine", lambda m: F.struct(m["segment"], m["x"]["start"]) > F.struct(F.col("main.segment"), F.col("main.x.start")))
    rows = once(rows, next_=F.get(later, F.lit(0)))
    x, y = F.col("main.x"), F.col("next_.x")
    clock = (x["kind"] == "date") & y["kind"].isin("clock", "range")
    between = F.lower(F.trim(F.substr(F.get("segments", F.col("main.segment")), x["end"] + 1, y["start"] - x["end"])))
    until = (F.col("main.segment") == F.col("next_.segment")) & dated(y) & between.isin("to", "until", "ends", "end", "-", "–", "—")
    of = lambda k: F.when(F.size("segments") == 1, "text").otherwise(F.concat(F.lit("text.segment."), k.cast("string")))
    path_of = lambda clock: F.when(clock & (F.col("main.segment") != F.col("next_.segment")), F.concat_ws("+", of(F.col("main.segment")), of(F.col("next_.segment")))).when(F.col("main").isNotNull(), of(F.col("main.segment")))
    clocked = lambda minutes: F.when(clock, F.struct(F.lit("moment").alias("kind"), F.concat_ws(" ", x["text"], y["text"]).alias("text"), x["parts"].alias("parts"), x["numbers"].alias("numbers"), minutes.alias("minutes"), y["zone"].alias("zone")))
    plain = lambda t: F.struct(*(t[c].alias(c) for c in ("kind", "text", "parts", "numbers", "minutes", "zone")))
    rows = rows.withColumn("path", path_of(clock)).withColumn("until", F.when(until, plain(y)))
    rows = once(rows, first_=F.coalesce(clocked(y["minutes"]), F.when(F.col("main").isNotNull(), plain(x))), last_=F.coalesce(F.when(y["kind"] == "range", clocked(y["last_minutes"])), F.col("until")))
    time = F.when(F.col("first_").isNotNull(), times.value_of(F.col("first_"), F.col("order")))
    end = F.when(F.col("last_").isNotNull(), times.value_of(F.col("last_"), F.col("order")))

    # The title ends where the first time begins, unless nothing stands before that.
    first = F.get(F.filter("mine", lambda m: m["segment"] == a), F.lit(0))["x"]
    before = F.when(first.isNull(), F.col("anchor")).when(F.trim(F.substr("anchor", F.lit(1), first["start"])) == "", F.substr("anchor", first["end"] + 1, F.length("anchor"))).otherwise(F.substr("anchor", F.lit(1), first["start"]))
    label_value = lambda k: F.when(F.get("bare", k) & F.lower(F.get("segments", k)).rlike(rf"\b(?:{'|'.join(wording.PLACE_PARTS)})\b") & (k < b) & (F.size(F.get("found", k + 1)) == 0), wording.place(F.get("segments", k + 1)))
    said_place = F.get(F.filter(F.transform(F.sequence(a, b), lambda k: F.coalesce(wording.location(F.get("segments", k)), label_value(k))), lambda p: p.isNotNull()), F.lit(0))
    location = F.when(F.col("change") == "VENUE_CHANGE", wording.new_place(before)).otherwise(said_place)
    return rows.select(
        "doc_id", "ordinal", (F.col("nth") + 1).alias("mention"), "kind", "change", wording.clean_title(before).alias("title"), F.transform("dated", lambda m: times.value_of(m["x"], F.col("order"))).alias("times"),
        time.alias("time"), end.alias("end_time"), location.alias("location"), wording.due_marker(F.col("text")).alias("due"), "text", F.substring(F.array_join("said", "\n"), 1, ORIGINAL_CHARS).alias("original"), "path",
    )


def extract_documents(chunks: DataFrame, per_chunk: int = PER_CHUNK, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Mentions with the documented limits per chunk and document; ``partial`` marks documents that reach one."""
    found = extract_mentions(chunks)
    in_chunk = F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("mention"))
    in_doc = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "mention"))
    ranked = found.withColumn("in_chunk", in_chunk).withColumn("in_doc", in_doc)
    over = F.max((F.col("in_chunk") > per_chunk) | (F.col("in_doc") > per_document)).over(Window.partitionBy("doc_id"))
    return ranked.withColumn("partial", over).where((F.col("in_chunk") <= per_chunk) & (F.col("in_doc") <= per_document)).drop("in_chunk", "in_doc")


def candidate_fields(candidates: DataFrame) -> DataFrame:
    """One row per candidate and field that it fills: candidate_key, field_name, value, precision."""
    time, end = F.col("time"), F.col("end_time")
    field = lambda name, value, precision=None: F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value"), (precision if precision is not None else F.lit(None).cast("string")).alias("precision"))
    rows = F.array(
        field("title", F.col("title")),
        field("event_type", F.col("kind")),
        field("location", F.col("location")),
        field("status", F.when(F.col("change") == "CANCELLATION", "cancelled")),
        F.when(F.col("due"), field("due_time", times.temporal_signature(time), time["precision"])).otherwise(field("start_time", times.temporal_signature(time), time["precision"])),
        field("end_time", times.temporal_signature(end), end["precision"]),
    )
    return candidates.select("candidate_key", F.explode(rows).alias("x")).select("candidate_key", "x.*").where("value is not null")
