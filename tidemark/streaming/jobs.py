"""The same operators over streams of observations; the batch path stays the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changes, index, latest, search, status


def ingest(stream: DataFrame, delay: str, key: tuple[str, ...] = ("resource_key", "run_key", "fingerprint")) -> DataFrame:
    """Each (object, run, hash) once, as far as ``delay`` looks back."""
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(list(key))


def maintain_state(path: str, attributes: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that folds each batch into the latest state at ``path``; late rows don't win.

    Each batch writes a new generation and the next one reads the last, so a batch that is run again gives the same.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/{batch_id - 1}") if batch_id else None
        latest.merge_state(state, batch, ["resource_key"], attributes).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return sink


def windowed_counts(stream: DataFrame, delay: str, width: str) -> DataFrame:
    """Observations and resources per time window and status; closed windows only, as the watermark passes them."""
    return (
        stream.withWatermark("observed_at", delay)
        .groupBy(F.window("observed_at", width), "observation_status")
        .agg(F.count("*").alias("observations"), F.approx_count_distinct("resource_key").alias("resources"))
        .select(F.col("window.start").alias("since"), "observation_status", "observations", "resources")
    )


def refresh_index(path: str, documents: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that rebuilds the courses of an index that a batch of changes (old_course, new_course) touches.

    ``documents`` reads the full documents table (course and more) as it is with the batch; a course without documents loses its rows.
    Each batch writes a new generation and the next one reads the last, so a batch that is run again gives the same.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        courses = search.affected(batch)
        rebuilt = build(documents().join(courses, "course", "left_semi"))
        index = search.refresh(batch.sparkSession.read.parquet(f"{path}/{batch_id - 1}"), rebuilt, courses) if batch_id else rebuilt
        index.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return sink


def refresh_saved_index(path: str, documents: Callable[[], DataFrame], fields: dict[str, float], key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for an index as ``index.write`` makes it: a batch of changes (old_course, new_course) overwrites the
    partitions of its courses and touches no others, so its cost is by what it changes, and a batch that is run again gives the same."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        index.write(documents(), path, fields, search.affected(batch), key)

    return sink


def inventory_runs(path: str, known: Callable[[], DataFrame], seen: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes what finished runs (see ``changes.inventory``) omitted; runs come in the order of their time.

    Omissions of earlier batches count for removal candidates. Each batch has a partition of its own under ``path``, so one
    that is run again gives the same.
    """

    def sink(runs: DataFrame, batch_id: int) -> None:
        spark = runs.sparkSession
        if batch_id:
            written = spark.read.parquet(*(f"{path}/{n}" for n in range(batch_id)))
            earlier = written.where("observation_status = 'NOT_OBSERVED'").select("run_key", "resource_key", "run_at")
        else:
            earlier = runs.join(seen().select("run_key", "resource_key"), "run_key").select("run_key", "resource_key", "run_at").limit(0)
        changes.inventory(runs, known(), seen(), earlier).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return sink


def freshness_ticks(path: str, attempts: Callable[[], DataFrame], max_age_s: int, keys: tuple[str, ...] = ("scope",)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink on a stream of ticks (now): the freshness of every scope at the last tick of the batch."""

    def sink(ticks: DataFrame, batch_id: int) -> None:
        now = ticks.agg(F.max("now")).first()[0]
        if now is not None:
            status.freshness(status.fold_scopes(attempts(), keys), F.lit(now), max_age_s).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return sink
