"""Candidates to canonical events; claims, conflicts, successors and manual decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times, wording
from tidemark.operators.latest import latest_by
from tidemark.operators.lineage import stored


def assign_events(candidates: DataFrame) -> DataFrame:
    """course_key, candidate_key, event_id, outcome (CREATED, MERGED, RELATED_CHANGE, UNRESOLVED).

    ``candidates``: course_key, candidate_key (distinct), title, kind, change, signature (of its time).  Only candidates
    of a course with the same title identity and kind can match; one without identity is its own.  The candidates come in
    the order of their keys, changes after plain ones; one that agrees with a single event joins it, one that agrees with
    none makes an event, except for changes.

    What this comes to is decided on the first key of each signature, not on candidates one after another:
    - Signatures agree only if they are equal or a date and an instant of that day, so days and weeks don't meet.
    - A date that comes when its day has at most one event holds the whole day together; else it never joins one, and
      each instant is an event of its own.
    - One without a time agrees with everything: it joins the first event until there is a second.
    - If the first of all has no time, its event is the one of the first that has.
    """
    keyed = candidates.withColumn("identity", wording.title_identity(F.col("title")))
    block = F.when(F.col("identity") == "", F.concat(F.lit("\x00"), F.col("candidate_key").cast("string"))).otherwise(F.col("identity"))
    keyed = stored(keyed.select(  # read five times below: the wording that it comes from is read once
        "course_key", F.coalesce(F.col("course_key").cast("string"), F.lit("")).alias("course"), block.alias("block"), F.coalesce("kind", F.lit("")).alias("kind"),
        "candidate_key", F.coalesce(F.col("change") != "NONE", F.lit(False)).alias("is_change"), F.coalesce("signature", F.lit("")).alias("signature"),
    ))
    group = ["course", "block", "kind"]
    plain = keyed.where("not is_change").groupBy(*group, "signature").agg(F.min("candidate_key").alias("first"))

    word, day = F.split_part("signature", F.lit(" "), F.lit(1)), F.split_part("signature", F.lit(" "), F.lit(2))
    signed = plain.where("signature != ''").withColumn("is_date", word == "date").withColumn("unit", F.when(word.isin("instant", "date"), F.concat(F.lit("day "), day)).otherwise(F.col("signature")))
    of_day = Window.partitionBy(*group, "unit")
    signed = signed.withColumn("dated", F.min(F.when(F.col("is_date"), F.col("first"))).over(of_day))
    before = F.count_if(~F.col("is_date") & (F.col("first") < F.col("dated"))).over(of_day)
    together = F.col("dated").isNotNull() & (before <= 1)
    maker = F.when(together, F.min("first").over(of_day)).when(~F.col("is_date"), F.col("first"))
    signed = signed.select(*group, "signature", maker.alias("maker"))

    makers = signed.where("maker is not null").select(*group, "maker").distinct()
    made = makers.groupBy(*group).agg(F.min("maker").alias("made"), F.count("*").alias("n"))
    second = makers.join(made, group).where("maker > made").groupBy(*group).agg(F.min("maker").alias("second"))
    groups = plain.groupBy(*group).agg(F.min("first").alias("earliest")).join(made, group, "left").join(second, group, "left")

    joined = keyed.join(groups, group, "left").join(signed, [*group, "signature"], "left")
    key, earliest = F.col("candidate_key"), F.col("earliest")
    timed = F.when(F.col("maker") == F.col("made"), earliest).otherwise(F.col("maker"))
    untimed = F.when((key < F.col("second")) | F.col("second").isNull(), earliest)
    related = F.when(F.coalesce("n", F.lit(1)) == 1, earliest)
    event = F.when(F.col("is_change"), related).when(F.col("signature") == "", untimed).otherwise(timed)
    outcome = F.when(F.col("event").isNull(), "UNRESOLVED").when(F.col("is_change"), "RELATED_CHANGE").when(F.col("event") == key, "CREATED").otherwise("MERGED")
    event_id = F.sha2(F.concat_ws(":", "course", F.coalesce("event", key).cast("string")), 256)
    return joined.withColumn("event", event).select("course_key", "candidate_key", event_id.alias("event_id"), outcome.alias("outcome"))


def build_claims(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """One claim per candidate field, with the first source time known: modified, published, created."""
    source = candidates.select("candidate_key", "event_id", "confidence", "change", F.coalesce("modified_at", "published_at", "created_at").alias("source_time"))
    return fields.join(source, "candidate_key")


def claim_groups(claims: DataFrame) -> DataFrame:
    """claim_key, event_id, field_name, group: claims that agree; a date joins the one instant that falls on it, if there is only one."""
    distinct = claims.select("event_id", "field_name", "value").distinct()
    coarse = distinct.where(F.col("value").startswith("date "))
    fine = distinct.where(F.col("value").startswith("instant ")).withColumnRenamed("value", "finer")
    matched = coarse.join(fine, ["event_id", "field_name"]).where(times.temporal_agrees(F.col("value"), F.col("finer")))
    only = matched.groupBy("event_id", "field_name", "value").agg(F.min("finer").alias("finer"), F.count("*").alias("n")).where("n = 1").drop("n")
    joined = claims.join(only, ["event_id", "field_name", "value"], "left")
    return joined.select("claim_key", "event_id", "field_name", "value", F.coalesce("finer", "value").alias("group"), "precision", "confidence", "change", "source_time")


#: The fields that each kind of change may replace.
REPLACES = {"MOVE": ("start_time", "end_time", "due_time"), "CANCELLATION": ("status",), "VENUE_CHANGE": ("location",)}


def change_applies(change, field):
    out = F.lit(False)
    for kind, fields in REPLACES.items():
        out = F.when(change == kind, field.isin(*fields)).otherwise(out)
    return out


def successors(grouped: DataFrame) -> DataFrame:
    """event_id, field_name, claim_key, group: the one newer claim of change wording that beats all other groups."""
    by = ["event_id", "field_name"]
    stats = grouped.groupBy(*by, "group").agg(F.max("source_time").alias("newest"), F.count_if(F.col("source_time").isNull()).alias("untimed"), F.max(times.precision_rank(F.col("precision"))).alias("rank"))
    claims = grouped.where(change_applies(F.col("change"), F.col("field_name")) & F.col("source_time").isNotNull()).select(*by, "claim_key", F.col("group").alias("mine"), "source_time", times.precision_rank(F.col("precision")).alias("my_rank"))
    joined = claims.join(stats, by)
    rival = F.col("group") != F.col("mine")
    beaten = (F.col("untimed") == 0) & (F.col("newest") < F.col("source_time")) & (F.col("rank") <= F.col("my_rank"))
    winners = joined.groupBy(*by, "claim_key", "mine").agg(F.bool_and(~rival | beaten).alias("wins"), F.count_if(rival).alias("rivals")).where("wins and rivals > 0")
    one = winners.groupBy(*by).agg(F.countDistinct("mine").alias("n"), F.max("claim_key").alias("claim_key"), F.max("mine").alias("group"))
    return one.where("n = 1").drop("n")


def project_events(grouped: DataFrame, manual: DataFrame) -> DataFrame:
    """event_id, field_name, value, basis (MANUAL, AGREED, SUCCESSOR, OPEN), alternatives: what each field of an event is."""
    by = ["event_id", "field_name"]
    best = Window.partitionBy(*by, "group").orderBy(F.desc(times.precision_rank(F.col("precision"))), F.desc("confidence"), F.asc("claim_key"))
    chosen = grouped.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    fields = chosen.groupBy(*by).agg(F.count("*").alias("groups"), F.min("value").alias("single"), F.array_sort(F.collect_list("value")).alias("values"))
    next_ = successors(grouped).join(chosen.select(*by, "group", F.col("value").alias("newer")), [*by, "group"]).select(*by, "newer")
    decided = latest_by(manual, by, ("decided_at", "decision_key")).select(*by, F.col("value").alias("picked"))
    joined = fields.join(decided, by, "left").join(next_, by, "left")
    basis = F.when(F.col("picked").isNotNull(), "MANUAL").when(F.col("groups") == 1, "AGREED").when(F.col("newer").isNotNull(), "SUCCESSOR").otherwise("OPEN")
    value = F.coalesce("picked", F.when(F.col("groups") == 1, F.col("single")), "newer")
    return joined.select(*by, value.alias("value"), basis.alias("basis"), F.when(basis == "OPEN", F.array_join("values", " | ")).alias("alternatives"))


def claim_states(grouped: DataFrame, projected: DataFrame) -> DataFrame:
    """claim_key, state: ACCEPTED, SUPERSEDED, REJECTED or CONFLICTING."""
    p = projected.select("event_id", "field_name", F.col("value").alias("selected"), "basis")
    joined = grouped.join(p, ["event_id", "field_name"])
    same = (F.col("value") == F.col("selected")) | (F.col("group") == F.col("selected"))
    state = F.when(F.col("basis") == "OPEN", "CONFLICTING").when(same, "ACCEPTED").when(F.col("basis") == "SUCCESSOR", "SUPERSEDED").otherwise("REJECTED")
    return joined.select("claim_key", state.alias("state"))


def expire_manual(manual: DataFrame, grouped: DataFrame) -> DataFrame:
    """Manual decisions that newer evidence contradicts: event_id, field_name, decision_key."""
    newer = grouped.select("event_id", "field_name", F.col("value").alias("claimed"), "source_time")
    current = latest_by(manual, ["event_id", "field_name"], ("decided_at", "decision_key"))
    joined = current.join(newer, ["event_id", "field_name"]).where((F.col("source_time") > F.col("decided_at")) & (F.col("claimed") != F.col("value")))
    return joined.select("event_id", "field_name", "decision_key").distinct()
