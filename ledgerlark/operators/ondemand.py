"""On-demand ingestion: which requests are served from the index, which from the memory of failures, and which are fetched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.lifecycle import FAILURE_SECONDS

OUT = "event_id long, ticker string, year int, ts timestamp, outcome string, served_year int"
TTL = FAILURE_SECONDS * 1_000_000


@dataclass
class Known:
    """What is known of one company, times in microseconds: the years that are indexed, when a fetch began that has no result yet, when the last one failed,
    and when a year was last found not to exist."""

    indexed: set[int] = field(default_factory=set)
    pending: int | None = None
    failed: int | None = None
    missing: dict[int, int] = field(default_factory=dict)

    def asked(self, year: int | None, at: int, ttl: int = TTL) -> tuple[str, int | None]:
        """(outcome, year served) of a request: of a year, or of the last one there is."""
        fresh = lambda t: t is not None and at - t < ttl
        if year in self.indexed or (year is None and self.indexed):
            return "indexed", max(self.indexed) if year is None else year
        if year is not None and fresh(self.missing.get(year)):
            return "year_not_available", None
        if fresh(self.failed):
            return "failed", None
        if fresh(self.pending):
            return "waiting", None
        self.pending = at
        return "fetch", None

    def told(self, year: int | None, years: list[int] | None, at: int) -> None:
        """The result of a fetch: the years that it brought, none where it failed."""
        self.pending = None
        if not years:
            self.failed = at
            return
        self.failed = None
        self.indexed |= set(years)
        if year is not None and year not in years:
            self.missing[year] = at

    def expire(self, now: int, ttl: int = TTL) -> None:
        """Forget what no request from now on would look at."""
        old = lambda t: t is not None and now - t >= ttl
        self.pending, self.failed = (None if old(t) else t for t in (self.pending, self.failed))
        self.missing = {y: t for y, t in self.missing.items() if not old(t)}


def decided(events: DataFrame, seconds: int = FAILURE_SECONDS) -> DataFrame:
    """(event_id, ticker, year, ts, outcome, served_year) of each request among events (event_id, ticker, year, ts, kind, years), in the order of time.

    kind is 'request', or 'result' for the end of a fetch, with the years that it brought (null or none: it failed). Results come before requests of
    the same time, and equal times go by event_id. outcome is indexed, year_not_available or failed (both remembered for `seconds`), waiting
    (for a fetch that began less than `seconds` ago), or fetch: of these there is one at a time for a company. A company's events
    are one sorted run through one task, which keeps its state alone, not its events. Events without a company or time are left out: nothing can be
    fetched or remembered for them."""
    rows = events.where("ticker is not null and ts is not null").select("event_id", "ticker", F.col("year").cast("int").alias("year"), F.col("ts").cast("timestamp").alias("ts"), (F.col("kind") == "request").cast("int").alias("asks"), F.col("years").cast("array<int>").alias("years"))
    run = rows.withColumn("at", F.unix_micros("ts")).repartition("ticker").sortWithinPartitions("ticker", "at", "asks", "event_id")
    ttl = seconds * 1_000_000

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, known = None, Known()
        for batch in batches:
            keep, outcomes, served = [], [], []
            for i, (ticker, year, at, asks, years) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ticker", "year", "at", "asks", "years")), strict=True)):
                if ticker != company:
                    company, known = ticker, Known()
                if asks:
                    outcome, got = known.asked(year, at, ttl)
                    keep.append(i)
                    outcomes.append(outcome)
                    served.append(got)
                else:
                    known.told(year, years, at)
            own = batch.select(["event_id", "ticker", "year", "ts"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(outcomes, pa.string()), pa.array(served, pa.int32())], [*own.schema.names, "outcome", "served_year"])

    return run.mapInArrow(work, OUT)
