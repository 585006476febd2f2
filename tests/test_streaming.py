from pyspark.sql import functions as F

from tidemark.operators import latest
from tidemark.plans.bindings import observations
from tidemark.streaming import jobs


def replayed(spark, sf, folder):
    rows = observations(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for i in range(3):  # late data: the newest third comes first
        rows.where(F.col("observation_key") % 3 == 2 - i).coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_equals_the_batch(spark, sf, tmp_path):
    rows, stream = replayed(spark, sf, str(tmp_path / "in"))
    state = str(tmp_path / "state")
    query = stream.writeStream.foreachBatch(jobs.maintain_state(state, ["availability"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.read.parquet(f"{state}/2").select("resource_key", "first_seen", "last_seen", "observations", "availability")
    batch = latest.latest_state(rows, ["resource_key"], ["availability"])
    assert sorted(last.collect()) == sorted(batch.select(*last.columns).collect())


def test_ingest_keeps_each_once(spark, sf, tmp_path):
    rows, stream = replayed(spark, sf, str(tmp_path / "in"))
    query = jobs.ingest(stream, "60 days").writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = ["resource_key", "run_key", "fingerprint"]
    assert spark.table("ingested").count() == rows.select(*key).distinct().count()
