"""The change feed as a stream: the last observations of each resource in state, late rows as corrections.

An observation changes what the feed says of itself, of the next one, and, if it brings a
version, of all up to the next that brings one.  State therefore holds a resource's
observations by day, and an index of its days with the last version of each: a row loads its
own day and those that its arrival changes, not the whole history.

What the feed says of an observation is emitted when it comes and again when a late row
changes it, with a higher ``revision``; no kinds means that nothing changed after all.
``current`` keeps the last word on each observation.  It equals ``changes.recent_changes`` over
the same rows in any order and any batches.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an observation says, in the order of state and of ``ORDER``; times are microseconds since 1970 inside.
FIELDS = "observed_at long, run_key long, observation_key long, fingerprint string, observation_status string, availability string, version_key long"
SAID = [f.split()[0] for f in FIELDS.split(", ")]
OUTPUT = (
    "resource_key long, " + FIELDS + ", previous_observation_key long, previous_fingerprint string, previous_status string, "
    "previous_availability string, previous_version_key long, kinds array<string>, revision long"
)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_row = Row(*(f.split()[0] for f in OUTPUT.split(", ")))
_DAY = 24 * 3600 * 1_000_000


def use_state_on_disk(spark: SparkSession) -> None:
    """State of ``change_feed`` needs the provider that keeps it in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def kinds_of(row: tuple, before: tuple | None, version: int | None) -> list[str]:
    """The kinds of change of an observation after ``before``, with the last ``version`` known until then."""
    _, _, _, fingerprint, status, availability, own = row
    if before is None:
        return ["FIRST_OBSERVED" if status == "OBSERVED" else "FIRST_RECORDED"]
    found = {
        "BINARY_AVAILABLE": own is not None and version is None,
        "BINARY_CHANGED": own is not None and version is not None and own != version,
        "METADATA_CHANGED": fingerprint != before[3],
        "AVAILABILITY_CHANGED": (status, availability) != before[4:6],
    }
    return [kind for kind, holds in found.items() if holds]


def derive(rows: list[tuple], before: tuple | None, version: int | None) -> dict[tuple, tuple]:
    """What the feed says of each of the rows, which are in order and follow ``before``."""
    out = {}
    for row in rows:
        previous = (None,) * 4 if before is None else before[2:6]
        out[row[:3]] = (*previous, version, kinds_of(row, before, version))
        before, version = row, version if row[6] is None else row[6]
    return out


def last_version(rows: list[tuple], version: int | None) -> int | None:
    return next((row[6] for row in reversed(rows) if row[6] is not None), version)


class ChangeFeed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day int", f"rows array<struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>>")
        self.index = handle.getValueState("index", "days array<int>, versions array<long>, revision long")

    def _rows(self, day: int) -> list[tuple]:
        return [tuple(row) for row in self.days.getValue((day,))[0]]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.index.get() if self.index.exists() else None
        days, versions, revision = (list(held[0]), list(held[1]), held[2] + 1) if held else ([], [], 0)
        new: dict[int, list[tuple]] = {}
        for row in rows:
            said = tuple(row[c] for c in SAID)
            if said[4] != "UNKNOWN":  # such a row says nothing
                new.setdefault(said[0] // _DAY, []).append(said)
        touched, found = sorted(new), []
        old_version_of = dict(zip(days, versions))
        for day in touched:
            if day not in old_version_of:
                at = bisect.bisect(days, day)
                days.insert(at, day)
                versions.insert(at, None)
        at = len(days)
        while touched:
            # From the next touched day on, until what a day hands on is as it was.
            at = bisect.bisect_left(days, touched[0])
            before = self._rows(days[at - 1])[-1] if at else None
            version = next((v for v in reversed(versions[:at]) if v is not None), None)
            was_before, was_version = before, version
            while at < len(days):
                day = days[at]
                mine = touched and touched[0] == day
                if not mine and (before, version) == (was_before, was_version):
                    break
                old = self._rows(day) if day in old_version_of else []
                now = old
                if mine:
                    touched.pop(0)
                    # A row without a place of its own (it came before) changes nothing.
                    now = sorted(({row[:3]: row for row in new[day]} | {row[:3]: row for row in old}).values(), key=lambda row: row[:3])
                    self.days.updateValue((day,), (now,))
                    versions[at] = last_version(now, None)
                said, was = derive(now, before, version), derive(old, was_before, was_version)
                found += [(row, said[row[:3]]) for row in now if said[row[:3]] != was.get(row[:3]) and (said[row[:3]][-1] or was.get(row[:3], [[]])[-1])]
                before, version = now[-1], last_version(now, version)
                if old:
                    was_before, was_version = old[-1], last_version(old, was_version)
                at += 1
        self.index.update((days, versions, revision))
        for row, said in found:
            yield _row(key[0], *row, *said, revision)


def change_feed(observations: DataFrame) -> DataFrame:
    """The feed over a stream of observations; a resource with very many rows is one key, whose cost is by the days it touches."""
    fields = [f.split() for f in FIELDS.split(", ")]
    time = F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_at")
    rows = observations.select("resource_key", time, *(F.col(name).cast(kind).alias(name) for name, kind in fields[1:]))
    found = rows.groupBy("resource_key").transformWithState(ChangeFeed(), OUTPUT, "Append", "None")
    return found.withColumn("observed_at", F.timestamp_micros("observed_at"))


def current(emitted: DataFrame) -> DataFrame:
    """The last word of the feed on each observation, where there is any change."""
    others = [c for c in emitted.columns if c not in ("resource_key", "observation_key")]
    last = emitted.groupBy("resource_key", "observation_key").agg(F.max_by(F.struct(*others), "revision").alias("last"))
    return last.select("resource_key", "observation_key", "last.*").where(F.size("kinds") > 0)
