"""The live change feed: any order of rows in any batches gives what the batch query gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.plans.bindings import observations
from tidemark.streaming import feed

CHECKED = ["resource_key", "observation_key", "version_key", "previous_observation_key", "previous_version_key", "kinds"]


def streamed(spark, batches, schema, folder):
    """All that the stream emits when it gets the frames one by one."""
    feed.use_state_on_disk(spark)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = feed.change_feed(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(f"{folder}/out")


def expected(rows):
    every = changes.recent_changes(rows, F.lit("1900-01-01").cast("timestamp"), F.lit("2900-01-01").cast("timestamp"))
    return sorted(map(str, every.select(*CHECKED).collect()))


def test_shuffled_batches_equal_the_change_feed(spark, sf, tmp_path):
    rows = observations(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    batches = [rows.where(F.pmod(F.xxhash64("observation_key"), F.lit(5)) == n) for n in range(5)]
    out = streamed(spark, batches, rows.schema, str(tmp_path))
    assert sorted(map(str, feed.current(out).select(*CHECKED).collect())) == expected(rows)
    assert out.where("revision > 0").count() > 0


def observed(n, day, status="OBSERVED", fingerprint="f", version=None, key=1):
    return (key, datetime.datetime(2024, 1, day, 12), 1, n, fingerprint, status, "ACTIVE", version)


@pytest.fixture
def schema():
    return "resource_key long, " + feed.FIELDS.replace("observed_at long", "observed_at timestamp")


def test_a_late_row_corrects_what_follows(spark, schema, tmp_path):
    batches = [[observed(1, 1), observed(3, 3, fingerprint="g"), observed(4, 9, version=7)], [observed(2, 2, fingerprint="g", version=7)], [observed(2, 2, fingerprint="g", version=7)], [observed(5, 2, "UNKNOWN")]]
    out = streamed(spark, [spark.createDataFrame(b, schema) for b in batches], spark.createDataFrame([], schema).schema, str(tmp_path))
    by_revision = {n: sorted((r.observation_key, r.kinds) for r in out.where(F.col("revision") == n).collect()) for n in range(4)}
    assert by_revision[0] == [(1, ["FIRST_OBSERVED"]), (3, ["METADATA_CHANGED"]), (4, ["BINARY_AVAILABLE", "METADATA_CHANGED"])]
    # The third says what the late one said already; the fourth brings no new version any more.
    assert by_revision[1] == [(2, ["BINARY_AVAILABLE", "METADATA_CHANGED"]), (3, []), (4, ["METADATA_CHANGED"])]
    assert by_revision[2] == by_revision[3] == []  # a repeated row, and one that says nothing


def test_null_fields_and_first_records(spark, schema, tmp_path):
    rows = [observed(1, 1, "NOT_OBSERVED", None), observed(2, 1, "OBSERVED", None), (2, datetime.datetime(2024, 1, 1), None, 9, None, "OBSERVED", None, None)]
    frame = spark.createDataFrame(rows, schema)
    out = streamed(spark, [frame.where("observation_key = 2"), frame.where("observation_key <> 2")], frame.schema, str(tmp_path))
    assert sorted(map(str, feed.current(out).select(*CHECKED).collect())) == expected(frame)


def test_a_row_loads_only_the_days_it_changes():
    class Days(dict):
        def getValue(self, key):
            loaded.append(key[0])
            return (self[key[0]],)

        def updateValue(self, key, value):
            self[key[0]] = value[0]

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    from pyspark.sql import Row

    loaded, one = [], feed.ChangeFeed()
    one.days, one.index = Days(), Value()
    micros = lambda x: (x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) if isinstance(x, datetime.datetime) else x
    of = lambda *args, **kw: Row(**dict(zip(["resource_key", *feed.SAID], map(micros, observed(*args, **kw)))))
    list(one.handleInputRows((1,), iter([of(n, n, fingerprint=str(n), version=n) for n in range(1, 29)]), None))
    loaded.clear()
    got = list(one.handleInputRows((1,), iter([of(99, 5, fingerprint="x")]), None))
    assert [r[3] for r in got] == [6, 99] or [r[3] for r in got] == [99, 6]
    assert set(loaded) <= {(datetime.date(2024, 1, d) - datetime.date(1970, 1, 1)).days for d in (4, 5, 6)}
