"""Versions of a change stream by keyed state: each key holds its open version, and closes it when the watermark has passed a change."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started in here keep their state in RocksDB, which keyed state with timers needs; the setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Versions(StatefulProcessor):
    """A key's open version, the changes that the watermark has not passed in order of time, and one timer at the earliest of them.

    All is one value of the state: a call to the state costs more than the rows it carries, so a key takes two a batch,
    however many changes it has, and one more for its timer.
    """

    def __init__(self, sequence: str, tracked: list[str], values: StructType, names: list[str]) -> None:
        self.sequence, self.tracked, self.values, self.names = sequence, tracked, values, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        change = StructType([StructField("at", TimestampType()), *self.values.fields])
        self.handle = handle
        self.state = handle.getValueState("versions", StructType([StructField("open", ArrayType(change)), StructField("waiting", ArrayType(change))]))

    def _get(self) -> tuple[tuple | None, list[tuple]]:
        """(the open version or None, the changes that wait)."""
        held = self.state.get()
        if held is None:
            return None, []
        return (_plain(held[0][0]) if held[0] else None), [_plain(c) for c in held[1]]

    def _put(self, held: tuple | None, waiting: list[tuple]) -> None:
        self.state.update(([] if held is None else [held], waiting))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, before = self._get()
        found = {c[0]: c[1:] for c in before}
        for row in rows:
            at, *value = _plain((row[self.sequence], *(row[c] for c in self.tracked)))
            value = tuple(value)
            # of changes at one time the largest counts, nulls least
            if at not in found or _order(value) > _order(found[at]):
                found[at] = value
        waiting = sorted(((at, *value) for at, value in found.items()), key=lambda c: c[0])
        if waiting != before:
            self._put(held, waiting)
            # at the first whole millisecond after the earliest change
            due = [_millis(c[0][0]) + 1 for c in (before, waiting) if c]
            if len(due) == 1 or due[0] != due[1]:
                for old in due[:-1]:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(due[-1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held, changes = self._get()
        passed = [c for c in changes if _millis(c[0]) < mark]
        out = []
        for at, *value in passed:
            value = tuple(value)
            if held is not None and held[1:] == value:
                continue
            if held is not None:
                out.append((*key, *held[1:], held[0], at))
            held = (at, *value)
            out.append((*key, *value, at, None))
        rest = changes[len(passed) :]
        if passed:
            self._put(held, rest)
        if rest:
            self.handle.registerTimer(_millis(rest[0][0]) + 1)  # the timer that has expired is still listed, and goes now
        return (Row(**dict(zip(self.names, r))) for r in out)

    def close(self) -> None:
        pass


def _plain(values: tuple) -> tuple:
    """Times without a zone, as rows have them; the state gives them back with one."""
    return tuple(v.astimezone().replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo else v for v in values)


def _millis(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=at.tzinfo)) // timedelta(milliseconds=1) if at.tzinfo else int(at.timestamp() * 1000)


def _order(value: tuple) -> tuple:
    return tuple((v is not None, v) for v in value)


def versions_by_state(changes: DataFrame, keys: list[str], sequence: str, tracked: list[str], delay: str) -> DataFrame:
    """(keys, tracked, valid_from, valid_to) rows of a change stream, appended as the watermark passes each change.

    A version comes first open (null valid_to) and again when it ends, so a table that merges by (keys, valid_from) and keeps
    the row with an end shows the versions; ``scd2.build_scd2`` gives the same of all changes that are in time. Changes may
    come in any order within ``delay``; later ones are dropped and counted by the stream. A key's state is its open version
    and the changes of the last ``delay``; what a batch gives out grows with its changes, not with the table.
    """
    fields = {f.name: f for f in changes.schema.fields}
    values = StructType([fields[c] for c in tracked])
    out = StructType([*(fields[k] for k in keys), *values.fields, StructField("valid_from", TimestampType()), StructField("valid_to", TimestampType())])
    rows = changes.select(*keys, sequence, *tracked).withWatermark(sequence, delay)
    return rows.groupBy(*keys).transformWithState(_Versions(sequence, tracked, values, out.names), out, "Append", "EventTime")


def ended_last(rows: DataFrame) -> DataFrame:
    """rows with ``ended``, by which a version's closed row counts over its open one."""
    return rows.withColumn("ended", F.col("valid_to").isNotNull().cast("int"))
