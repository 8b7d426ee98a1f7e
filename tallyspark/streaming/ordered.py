"""Streams whose rows count in event-time order, whatever the order and batch they come in: latched stops, stale readings,
retry budgets, and runs that nothing settles.

Each key keeps its rows in state until the watermark has passed them, so that none earlier can come any more, and then
takes them in order of time (equal times by the other columns). What a key remembers besides is one value: the reason
that stopped it, its newest reading, its attempts. Rows later than the watermark allows are dropped by Spark, so the
delay says how late a row may be. State lives in RocksDB, its size follows the rows within the delay. Null keys are a
key of their own; rows without a time are never taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tallyspark.operators.extraction import stops

DELAY = "30 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands the rows of a key to `step` in order; `idle` is asked what the passing of time alone brings.

    Rows are tuples (time in microseconds, other columns). `held` is what the key remembers, a tuple or None.
    """

    #: What a key remembers.
    memory = "at long"

    def __init__(self, columns: str, names: list[str]):
        self.columns, self.row = columns, Row(*names)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.held = handle.getValueState("held", self.memory)

    def step(self, held: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def idle(self, held: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        return held, []

    def wake(self, held: tuple | None) -> int | None:
        """When `idle` is to be asked, in microseconds."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        taken = [tuple(r[1:]) for r in rows]  # the key comes first
        taken = [r for r in taken if r[0] is not None]
        if taken:
            self.waiting.appendList(taken)
            self._wake_at(min(r[0] for r in taken))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: tuple((x is not None, x) for x in r))
        late = [r for r in rows if r[0] > now]
        held = tuple(self.held.get()) if self.held.exists() else None
        for row in ready:
            held, told = self.step(held, row)
            yield from (self.row(*key, *x) for x in told)
        held, told = self.idle(held, now)
        yield from (self.row(*key, *x) for x in told)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        if late:
            self.waiting.put(late)
            self._wake_at(min(r[0] for r in late))
        else:
            self.waiting.clear()
        again = self.wake(held)
        if again is not None and again > now:
            self._wake_at(again)

    def _wake_at(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, at: str, columns: list[str], make, told: str, delay: str) -> DataFrame:
    """Rows (key, told...) of a processor over a stream, its rows as (key, microseconds of `at`, columns...)."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withWatermark(at, delay).select(key, F.unix_micros(at).alias("_micros"), *columns, at)
    kept = rows.select("_micros", *columns).schema
    waiting = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = f"`{key}` {rows.schema[key].dataType.simpleString()}, {told}"
    names = StructType.fromDDL(out).names

    class Trimmed(make):  # rows come with the event time at their end
        def handleInputRows(self, key, rows, timerValues):
            return super().handleInputRows(key, (r[:-1] for r in rows), timerValues)

    return rows.groupBy(key).transformWithState(Trimmed(waiting, names), out, "append", "EventTime")


class _Latch(InOrder):
    """Rows (micros, id, reason, stop)."""

    memory = "at long, reason string"

    def step(self, held, row):
        at, ident, reason, stop = row
        if held and at > held[0]:
            return held, [(ident, held[1], False)]
        return (held or (at, reason)) if stop else held, [(ident, reason, True)]


def latched(events: DataFrame, key: str = "batch", ident: str = "id", at: str = "at", delay: str = DELAY) -> DataFrame:
    """Stream (key, id, reason, admitted): once a key has a stopping reason, it stays, and every later row is refused.

    Later by event time: a stop that comes in a later batch still refuses the rows after it that came before.
    """
    marked = events.withColumn("_stop", F.coalesce(stops(F.col("reason")), F.lit(False)))
    kind = marked.schema[ident].dataType.simpleString()
    told = f"`{ident}` {kind}, reason string, admitted boolean"
    return in_order(marked, key, at, [ident, "reason", "_stop"], _Latch, told, delay)


def _stale(bound_micros: int):
    class Stale(InOrder):
        """Rows (micros, reading)."""

        memory = "at long, reading double"

        def step(self, held, row):
            told = [(held[0], held[1], held[0] + bound_micros)] if held and row[0] > held[0] + bound_micros else []
            return row, told

        def idle(self, held, now):
            if held and held[0] + bound_micros < now:
                return None, [(*held, held[0] + bound_micros)]
            return held, []

        def wake(self, held):
            return held[0] + bound_micros + 1 if held else None

    return Stale


def stale_readings(
    readings: DataFrame, key: str = "account", at: str = "observed_at", bound_minutes: int = 30, delay: str = DELAY
) -> DataFrame:
    """Stream (key, observed_at, reading, stale_at): each reading that nothing newer follows within the bound, told when
    the watermark has passed the bound."""
    micros = bound_minutes * 60_000_000
    rows = readings.withColumn("reading", F.col("reading").cast("double"))
    told = in_order(rows, key, at, ["reading"], _stale(micros), "_at long, reading double, _stale long", delay)
    when = lambda c: F.timestamp_micros(c)
    return told.select(key, when(F.col("_at")).alias(at), "reading", when(F.col("_stale")).alias("stale_at"))


def _budget(most: int):
    class Budget(InOrder):
        """Rows (micros, id, ok)."""

        memory = "attempts long, done boolean"

        def step(self, held, row):
            _, ident, ok = row
            attempts, done = held or (0, False)
            admitted = not done and attempts < most
            if admitted:
                attempts, done = attempts + 1, bool(ok)
            return (attempts, done), [(ident, attempts if admitted else None, admitted)]

    return Budget


def budgeted(
    attempts: DataFrame, key: str, most: int, ident: str = "id", at: str = "at", delay: str = DELAY
) -> DataFrame:
    """Stream (key, id, attempt, admitted): attempts are numbered as they come by event time; those after a success or
    past the budget are refused and have no number. `status` is `ok` for a success."""
    marked = attempts.withColumn("_ok", F.coalesce(F.col("status") == "ok", F.lit(False)))
    kind = marked.schema[ident].dataType.simpleString()
    told = f"`{ident}` {kind}, attempt long, admitted boolean"
    return in_order(marked, key, at, [ident, "_ok"], _budget(most), told, delay)


def reconciled(
    dispatched: DataFrame,
    records: DataFrame,
    key: str = "run_id",
    at: str = "dispatched_at",
    done: str = "recorded_at",
    within: str = "1 hour",
    delay: str = DELAY,
) -> DataFrame:
    """Stream of dispatched runs with the time of the record that settled each (also one that comes batches later), null
    for those that no record settles within the time: told when the watermarks have passed it."""
    left = dispatched.withWatermark(at, delay)
    right = records.select(F.col(key).alias("_key"), F.col(done)).withWatermark(done, delay)
    near = (F.col(done) >= F.col(at)) & (F.col(done) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("_key")) & near, "left").drop("_key")
