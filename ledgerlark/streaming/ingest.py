"""Streaming forms of incremental ingestion (extensions): upserts, failure caches and access logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ledgerlark.operators.lifecycle import FAILURE_SECONDS, store_partitions
from ledgerlark.operators.ondemand import OUT, Known


def upserts(stream: DataFrame, path: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """Write each batch's partitions in place of older ones; a batch that runs again writes the same."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store_partitions(transform(df), path, keys))


def first_failures(stream: DataFrame, keys: list[str], ts: str = "ts", seconds: int = FAILURE_SECONDS) -> DataFrame:
    """The first of repeated failures within the cache's time: later ones are what the cache would have answered."""
    return stream.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def last_access(stream: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The access log as a running aggregate (update or complete mode)."""
    return stream.groupBy(key).agg(F.max(ts).alias("last_access"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind, late rows up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class Remembered(StatefulProcessor):
    """The state of ondemand.Known for each company, with a timer for when its memories end."""

    def __init__(self, seconds: int = FAILURE_SECONDS):
        self.ttl = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("known", "indexed array<int>, pending long, failed long, missing array<int>, since array<long>")

    def _load(self) -> Known:
        got = self.state.get()
        return Known() if got is None else Known(set(got[0]), got[1], got[2], dict(zip(got[3], got[4], strict=True)))

    def _store(self, known: Known) -> None:
        times = [t for t in (known.pending, known.failed, *known.missing.values()) if t is not None]
        if not known.indexed and not times:
            self.state.clear()
            return
        self.state.update((sorted(known.indexed), known.pending, known.failed, list(known.missing), list(known.missing.values())))
        for t in {(t + self.ttl) // 1000 + 1 for t in times} - set(self.handle.listTimers()):
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._load()
        micros = lambda r: int(r.ts.timestamp()) * 1_000_000 + r.ts.microsecond
        for at, asks, event, r in sorted((micros(r), int(r.kind == "request"), r.event_id, r) for r in rows):
            if asks:
                outcome, served = known.asked(r.year, at, self.ttl)
                yield Row(event_id=event, ticker=key[0], year=r.year, ts=r.ts, outcome=outcome, served_year=served)
            else:
                known.told(r.year, r.years, at)
        self._store(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._load()
        known.expire(timerValues.getCurrentWatermarkInMs() * 1000, self.ttl)
        self._store(known)
        yield from ()

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, late: str = "10 seconds", seconds: int = FAILURE_SECONDS) -> DataFrame:
    """ondemand.decided() over a stream of events (event_id, ticker, year, ts, kind, years): requests as they come, with what is known of each
    company as keyed state. Timers forget failures when the watermark has passed their time. Needs the RocksDB state store."""
    rows = stream.where("ticker is not null").withWatermark("ts", late)
    return rows.groupBy("ticker").transformWithState(Remembered(seconds), OUT, "Append", "EventTime")
