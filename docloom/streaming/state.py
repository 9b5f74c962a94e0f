"""Stateful operators over job events: order under the watermark, state that timers free.

``events`` has ``ts``, a timestamp, and ``event_id``; a watermark of ``late`` is put on it. An event that comes
later than that is dropped by Spark. Everything else is handled in order of (ts, event_id) whatever the micro-batches:
a key's events wait in list state until the watermark has passed them. Each operator has a batch twin in
``docloom.streaming.jobs`` with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.staging import stage
from docloom.streaming.jobs import HISTORY, LOCK_S, TREND, trend, ttl_seconds

LATE = "10 minutes"
CLOSING = "9999-01-01"


class InOrder(StatefulProcessor):
    """Hands a key's events to ``fold_all`` in order, once the watermark has passed them, and tells it how far that is.

    A call to the state store costs far more than an event: what a micro-batch brings for a key waits as one row of
    columns, and ``fold_all`` reads and writes a key's state once, whatever the number of its events.
    """

    fields = "us long, event_id long, kind string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names, kinds = zip(*(f.split(" ") for f in self.fields.split(", ")), strict=True)
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{k}>" for n, k in zip(self.names, kinds, strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, new = [], []
        for row in rows:
            at = at or [row.__fields__.index(n) for n in self.names]
            values = tuple(row)
            if values[at[1]] is not None:
                new.append([values[i] for i in at])
        if new:
            self.waiting.appendValue(tuple(map(list, zip(*new, strict=True))))
            self.wake(min(n[0] for n in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((e for part in self.waiting.get() for e in zip(*part, strict=True)), key=lambda e: e[:2])
        left = [e for e in waiting if e[0] > passed]
        if left and len(left) < len(waiting):
            self.waiting.put([tuple(map(list, zip(*left, strict=True)))])
        elif waiting and not left:
            self.waiting.clear()
        if left:
            self.wake(left[0][0])
        return iter(list(self.fold_all(key[0], waiting[: len(waiting) - len(left)], passed)))

    def wake(self, us: int) -> None:
        """Be called when the watermark has passed that time."""
        self.handle.registerTimer(-(-us // 1000))

    def fold_all(self, key, events: list[tuple], passed: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Intervals(InOrder):
    """From when until when each status of a job could be read: until the next one, or the end of its time to live."""

    made = Row("job_id", "status", "since_us", "until_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.current = handle.getValueState("current", "status string, since long, until long")

    def fold_all(self, key, events: list[tuple], passed: int) -> Iterator[Row]:
        before = current = self.current.get()
        for us, _, kind in events:
            if current:
                yield self.made(key, *current[:2], min(current[2], us))
            current = (kind, us, us + ttl_seconds(kind) * 1_000_000)
        if current and current[2] <= passed:
            yield self.made(key, *current)
            current = None
        if current and events:
            self.current.update(current)
            self.wake(current[2])
        elif before and not current:
            self.current.clear()


class Progress(InOrder):
    """Events of a job, numbered, up to and with its first failure. All that stays of an ended job is the flag that ends it."""

    made = Row("job_id", "event_id", "event_type", "step")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "step int, failed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()
        if state and state[1]:
            return iter(())  # nothing after a failure waits
        return super().handleInputRows(key, rows, timerValues)

    def fold_all(self, key, events: list[tuple], passed: int) -> Iterator[Row]:
        if not events:
            return
        step, failed = self.state.get() or (0, False)
        if failed:
            return
        for _, event_id, kind in events:
            step, failed = step + 1, kind == "failed"
            yield self.made(key, event_id, kind, step)
            if failed:
                break
        self.state.update((step, failed))


class Lock(InOrder):
    """Starts that take a job's lock; a release or the end of ``LOCK_S`` seconds frees it, and its state."""

    made = Row("job_id", "event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "us long")

    def fold_all(self, key, events: list[tuple], passed: int) -> Iterator[Row]:
        before = held = (self.held.get() or (None,))[0]
        for us, event_id, kind in events:
            if kind == "release":
                held = None
            elif held is None or us - held >= LOCK_S * 1_000_000:
                held = us
                yield self.made(key, event_id)
        if held is not None and held + LOCK_S * 1_000_000 <= passed:
            held = None
        if held is None and before is not None:
            self.held.clear()
        elif held != before:
            self.held.update((held,))
            self.wake(held + LOCK_S * 1_000_000)


class Trends(InOrder):
    """Of each sample the size of its agent's history and the trends and means of its last samples; state is a ring of ``HISTORY`` samples."""

    fields = "us long, event_id long, cpu double, memory double"
    made = Row("event_id", "agent", "history", "cpu_trend", "mean_cpu", "memory_trend", "mean_memory")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "cpu double, memory double")

    def fold_all(self, key, events: list[tuple], passed: int) -> Iterator[Row]:
        if not events:
            return
        samples = [*map(tuple, self.ring.get()), *(e[2:] for e in events)]
        series = list(zip(*samples, strict=True))
        for at, event in enumerate(events, len(samples) - len(events)):
            found = []
            for name, values in zip(("cpu", "memory"), series, strict=True):
                last = values[max(0, at + 1 - TREND) : at + 1]
                found += [trend(name, last[0], last[-1], len(last)), sum(last) / len(last)]
            yield self.made(event[1], key, min(at + 1, HISTORY), *found)
        self.ring.put(samples[-HISTORY:])


def with_closing_row(stream: DataFrame) -> DataFrame:
    """``stream`` and one row with no values but a time after all others, which moves the watermark past them: for a stream that ends."""
    row = stream.sparkSession.range(1).select(*[F.lit(CLOSING if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in stream.schema])
    closing = stage(row, "closing-row")
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(closing._staged_path))


def _ordered(events: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    timed = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithState(processor, schema, "append", "EventTime")


def status_intervals(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stream: (job_id, status, since_us, until_us) of ``events(job_id, ts, event_id, kind)``; a job without a live status has no state."""
    return _ordered(events, "job_id", Intervals(), "job_id long, status string, since_us long, until_us long", late)


def progress(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stream: (job_id, event_id, event_type, step) of ``events(job_id, ts, event_id, kind)`` up to and with a job's first failure."""
    return _ordered(events, "job_id", Progress(), "job_id long, event_id long, event_type string, step int", late)


def run_once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stream: starts of a job that the lock lets through: ``events(job_id, ts, event_id, kind)``, kind ``start`` or ``release``."""
    return _ordered(events, "job_id", Lock(), "job_id long, event_id long", late)


def trends(samples: DataFrame, late: str = LATE) -> DataFrame:
    """Stream: ``samples(agent, ts, event_id, cpu, memory)`` with history, trends and means."""
    return _ordered(samples, "agent", Trends(), "event_id long, agent string, history int, cpu_trend string, mean_cpu double, memory_trend string, mean_memory double", late)
