"""Inventory and freshness over streams, held against their batch forms."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import changes, status
from tidemark.plans.bindings import attempts, observations
from tidemark.streaming import jobs


def start(stream, sink, folder):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination(180)


def test_inventory_of_runs_equals_the_batch(spark, sf, tmp_path):
    obs = observations(spark, sf)
    day = F.datediff(F.col("observed_at").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    seen = obs.select((F.floor(day / 8)).alias("run_key"), (F.col("resource_key") % 3).alias("course_key"), "resource_key").distinct()
    runs = seen.select("run_key", "course_key").distinct().select("*", F.col("run_key").alias("run_at"), (F.col("course_key") < 2).alias("complete"), F.lit(True).alias("parent_available"))
    seen = seen.where("resource_key % 4 > 1 or run_key = 0")  # the others are never seen again
    known = obs.select((F.col("resource_key") % 3).alias("course_key"), "resource_key").distinct().select("*", F.lit(-1).cast("long").alias("first_at"), F.lit("ACTIVE").alias("availability"))
    for n in range(3):
        runs.where(F.least(F.col("run_key"), F.lit(2)) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(stream, jobs.inventory_runs(str(tmp_path / "out"), lambda: known, lambda: seen), str(tmp_path / "c"))
    none = seen.select("run_key", "resource_key", F.col("run_key").alias("run_at")).limit(0)
    expected = changes.inventory(runs, known, seen, none)
    found = spark.read.parquet(*(str(tmp_path / "out" / str(n)) for n in range(3))).select(*expected.columns)
    assert expected.where("removal_candidate").count()
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_freshness_at_each_tick(spark, sf, tmp_path):
    tries = attempts(spark, sf).withColumn("scope", F.col("event_type"))
    ticks = [datetime.datetime(2024, 2, 1), datetime.datetime(2024, 3, 1)]
    for tick in ticks:
        spark.createDataFrame([(tick,)], "now timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("now timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(stream, jobs.freshness_ticks(str(tmp_path / "out"), lambda: tries, 86400), str(tmp_path / "c"))
    for n, tick in enumerate(ticks):
        expected = status.freshness(status.fold_scopes(tries), F.lit(tick), 86400)
        found = spark.read.parquet(str(tmp_path / "out" / str(n))).select(*expected.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_values_of_titles_and_records(spark):
    row = spark.range(1).select(
        values.semantic_value(F.lit("title"), F.lit("Quiz #2")).alias("a"), values.semantic_value(F.lit("title"), F.lit("quiz 2")).alias("b"),
        values.json_typed(F.lit('{"k": "5"}'), "$.k", "bigint").alias("text"), values.json_typed(F.lit("no json"), "$.k", "string").alias("broken"),
        values.availability(F.lit(None).cast("boolean")).alias("none"),
    ).first()
    assert row.a == row.b and row.text is None and row.broken is None and row.none == "UNKNOWN"
