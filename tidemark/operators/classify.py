"""Keyword labels with confidence and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.search import small

#: Confidence of a phrase by where it stands.
SIGNALS = {"title": 0.82, "filename": 0.72, "ancestors": 0.62, "headings": 0.58}
STEP, MOST = 0.04, 0.98


def classify(df: DataFrame, rules: DataFrame, key: str = "resource_key") -> DataFrame:
    """key, label, confidence, rank, evidence: each signal's text against each rule's phrase (label, phrase).

    Several signals for a label raise its confidence; rows without any get ``unknown`` with 0.
    """
    told = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(v).alias("value"), F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(s), F.lit(""))), " "), F.lit(" ")).alias("words")) for s, v in SIGNALS.items() if s in df.columns))
    signals = df.select(key, F.explode(told).alias("x")).select(key, "x.*")
    hit = F.col("words").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    hits = signals.join(small(rules), hit)
    grouped = hits.groupBy(key, "label").agg(
        F.least(F.lit(MOST), F.max("value") + STEP * (F.count("*") - 1)).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "signal", "phrase"))), ",").alias("evidence"),
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("confidence", 6)), "label"))
    ranked = grouped.withColumn("rank", rank)
    none = df.select(key).join(grouped.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"), F.lit(1).alias("rank"))
    return ranked.unionByName(none)


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose hash isn't done yet."""
    return inputs.join(done.select("input_hash").distinct(), "input_hash", "left_anti")


def work_plan(inputs: DataFrame, done: DataFrame, steps: list[str]) -> DataFrame:
    """The steps still to do for each input, in order, each waiting for the one before: item, step, input_hash, depends_on."""
    rows = inputs.select("item", "input_hash", F.posexplode(F.array(*(F.lit(s) for s in steps))).alias("at", "step"))
    name = lambda at: F.sha2(F.concat_ws("|", F.element_at(F.array(*(F.lit(s) for s in steps)), at), "input_hash"), 256)
    rows = rows.withColumn("work_hash", name(F.col("at") + 1)).withColumn("depends_on", F.when(F.col("at") > 0, name(F.greatest(F.col("at"), F.lit(1)))))
    return rows.join(done.select("work_hash").distinct(), "work_hash", "left_anti").select("item", "step", "work_hash", "depends_on")
