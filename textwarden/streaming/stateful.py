"""Stateful streams: alarms over closed windows, status changes in event order, waiting for answers.

What a key keeps is released by event-time timers, which fire when the watermark passes
them, so nothing has to arrive for the key itself.  The keys of the state are narrow (an
alarm, a step in a piece of time, a share of the rows that wait), so no key holds more than a
piece of the stream.  A key's rows are kept many in one entry: each entry is a call to Spark.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from textwarden import constants as K
from textwarden.functions.policy import route
from textwarden.functions.scores import borderline
from textwarden.operators.alarms import alarm_points, breaches
from textwarden.streaming.streams import event_time

# the state store that stateful processors need
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALARM_OUTPUT = "alarm STRING, slot BIGINT, state STRING, value DOUBLE"


def with_state(
    rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, output: str | StructType, timers: bool
) -> DataFrame:
    """A stream through a state processor, one state per key."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor,
        outputStructType=output,
        outputMode="Append",
        timeMode="EventTime" if timers else "None",
    )


def before(ms: int) -> int:
    """The timer that fires once the watermark has reached a time: timers fire when it is past them."""
    return ms - 1


class AlarmProcessor(StatefulProcessor):
    """Counts the breaches in a row per alarm and reports when it goes on or off.

    Its input is one row per closed window, its state three numbers per alarm.  A window
    without points is none of its rows: a timer at the window's end stands for it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "slot BIGINT, period BIGINT, run BIGINT, is_on BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, period, run, on = self.state.get() if self.state.exists() else (None, None, 0, False)
        for w in sorted(rows, key=lambda w: w.slot):
            period, needed = int(w.period_s), int(w.periods)
            if last is not None and w.slot > last + period:
                # the windows in between have no points, so they do not breach
                run = 0
                if on:
                    yield Row(alarm=key[0], slot=last + period, state="OK", value=None)
                    on = False
            run = run + 1 if w.breach else 0
            if (run >= needed) != on:
                on = run >= needed
                yield Row(alarm=key[0], slot=int(w.slot), state="ALARM" if on else "OK", value=w.value)
            last = int(w.slot)
        self.state.update((last, period, run, on))
        if run:
            self.handle.registerTimer(before(1000 * (last + 2 * period)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, period, run, on = self.state.get()
        # a window may have come since the timer was set
        if run and before(1000 * (last + 2 * period)) <= expiredTimerInfo.getExpiryTimeInMs():
            if on:
                yield Row(alarm=key[0], slot=last + period, state="OK", value=None)
            self.state.update((last, period, 0, False))

    def close(self) -> None:
        pass


def alarm_stream(
    metrics: DataFrame, alarms: Sequence[tuple], delay: str = "10 minutes"
) -> DataFrame:
    """State changes of all alarms over a stream of metric points, in append mode.

    Points are summed per alarm and window first; only closed windows reach the
    state, a handful of rows per alarm whatever the number of points.  A metric that falls
    silent does not breach: its alarm goes off when the watermark passes the end of the
    first empty window.  Alarms of one period share a branch of the stream; the branches
    are put together.
    """
    points = event_time(metrics, "ts", delay)
    periods = sorted({row[6] for row in alarms})
    branches = [_alarm_branch(points, [row for row in alarms if row[6] == p], p) for p in periods]
    return reduce(DataFrame.unionByName, branches)


def _alarm_branch(points: DataFrame, alarms: Sequence[tuple], period: int) -> DataFrame:
    keys = ["alarm", "stat", "op", "threshold", "periods", "period_s"]
    sums = alarm_points(points, alarms).groupBy(F.window("ts", f"{period} seconds").alias("w"), *keys).agg(
        F.sum("value").alias("__sum"), F.count("value").alias("__n"),
        F.min("value").alias("__min"), F.max("value").alias("__max"),
    )
    value = (
        F.when(F.col("stat") == "Sum", F.col("__sum"))
        .when(F.col("stat") == "Average", F.col("__sum") / F.col("__n"))
        .when(F.col("stat") == "Minimum", F.col("__min"))
        .when(F.col("stat") == "Maximum", F.col("__max"))
        .otherwise(F.col("__n").cast("double"))
    )
    closed = sums.withColumn("value", value).select(
        "alarm",
        "periods",
        "period_s",
        F.unix_seconds("w.start").alias("slot"),
        "value",
        breaches(F.col("value"), F.col("op"), F.col("threshold")).alias("breach"),
    )
    return with_state(closed, ["alarm"], AlarmProcessor(), ALARM_OUTPUT, timers=True)


ENTRY_ROWS = 10_000  # rows of one state entry
BUCKETS = 1024  # keys of the state of rows that wait for an answer


class Packed:
    """A list of tuples in the state, many of them in one entry."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getListState(name, "rows BINARY")

    def append(self, rows: Iterable[tuple]) -> None:
        rows = iter(rows)
        while part := list(islice(rows, ENTRY_ROWS)):
            self.state.appendValue((pickle.dumps(part),))

    def get(self) -> list[tuple]:
        return [row for entry in self.state.get() for row in pickle.loads(entry[0])]

    def clear(self) -> None:
        self.state.clear()


class ReorderProcessor(StatefulProcessor):
    """Keeps the events of a step in a piece of time until the watermark has passed it, then
    gives those whose status differs from the one before, in event order.

    The first event of a piece is always given, together with the last status of the piece:
    only the pieces in their order can tell whether it is a change.
    """

    def __init__(self, names: Sequence[str], width: int, slice_ms: int):
        self.names, self.width, self.slice_ms = [*names, "previous_status", "__first", "__last"], width, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = Packed(handle, "events")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # what is kept are the last columns: the order, then the status
        self.events.append(tuple(r)[-self.width:] for r in rows)
        self.handle.registerTimer(before(key[-1] + self.slice_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        named = Row(*self.names)
        events = self.events.get()
        events.sort(key=lambda e: [(x is not None, x) for x in e[:-1]])
        self.events.clear()
        previous = None
        for i, event in enumerate(events):
            if not i or event[-1] != previous:
                yield named(*key, *event, previous, not i, events[-1][-1])
            previous = event[-1]

    def close(self) -> None:
        pass


class StatusProcessor(StatefulProcessor):
    """Remembers the last status of a step and passes the events that change it.

    Its input is in pieces of time: a piece's first event, marked, with the last status of the
    piece, and the changes inside the piece, which are changes whatever came before.
    """

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "status STRING")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        named, firsts = Row(*self.names, "previous_status"), []  # one per piece that this batch closes
        for r in rows:
            if r["__first"]:
                firsts.append(r)
            else:
                yield named(*(r[c] for c in self.names), r["previous_status"])
        known = self.state.exists()
        last = self.state.get()[0] if known else None
        for r in sorted(firsts, key=lambda r: r["__slice"]):
            if not known or r["status"] != last:
                yield named(*(r[c] for c in self.names), last)
            known, last = True, r["__last"]
        if firsts:
            self.state.update((last,))

    def close(self) -> None:
        pass


def status_change_stream(
    events: DataFrame,
    by: Sequence[str] = ("step",),
    order: Sequence[str] = ("ts", "event_id"),
    delay: str = "10 minutes",
    piece_s: int = 600,
) -> DataFrame:
    """The events of a stream whose status differs from the one before, per step; the first counts.

    The first column of ``order`` is the event time.  Events may come in any order within the
    delay: they wait until the watermark has passed their piece of time of ``piece_s`` seconds,
    and are then compared in their order.  A key of the first state is a step in one piece, so
    a busy step is spread over as many keys as pieces are open, and a task holds the events of
    a piece at most; the second state has one status per step, and meets one event per piece.
    Events older than the watermark are left out, and counted by Spark as late; so are events
    without a time, which have no place in the order.
    """
    ts, *rest = order
    timed = event_time(events.filter(F.col(ts).isNotNull()), ts, delay)
    micros, piece = F.unix_micros(ts), 1000 * piece_s
    slice_ms = (F.floor(F.unix_micros(ts) / (1000 * piece)) * piece).cast("bigint")
    # the time goes through the state as a number, whatever the time zone of the workers; the
    # column itself stays in the input, by which Spark knows late events
    rows = timed.select(*by, slice_ms.alias("__slice"), ts, micros.alias("__at"), *rest, "status")
    kept = rows.drop(*by, "__slice", ts).schema
    named = [*by, "__slice", *kept.names]
    ordered = StructType([rows.schema[c] for c in named])
    for name, kind in (("previous_status", "string"), ("__first", "boolean"), ("__last", "string")):
        ordered = ordered.add(name, kind)
    changes = StructType([*(rows.schema[c] for c in (*by, *kept.names)), ordered["previous_status"]])
    sorted_ = with_state(rows, [*by, "__slice"], ReorderProcessor(named, len(kept), piece), ordered, timers=True)
    found = with_state(sorted_, by, StatusProcessor(changes.names[:-1]), changes, timers=False)
    back = F.timestamp_micros("__at").cast(events.schema[ts].dataType).alias(ts)
    return found.select(*by, back, *rest, "status", "previous_status")


class VerdictProcessor(StatefulProcessor):
    """Keeps rows that wait for an answer, and answers, in buckets of many keys.

    A row leaves when its wait is over, with the newest answer under its key that came in time,
    or none.  Answers go when no row can need them any more.  A bucket looks through what it
    keeps once a batch in which something is over, and has a timer for the next that will be.
    """

    def __init__(self, names: Sequence[str], columns: Sequence[str], wait_ms: int):
        # the names of the output: the key, the time, the kept columns, the action
        self.names, self.wait_us = list(names), 1000 * wait_ms
        self.row = [columns.index(c) for c in names[:-1]]
        self.answer = [columns.index(c) for c in (names[0], "__at", names[-1])]
        self.is_answer = columns.index("__answer")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.answers = Packed(handle, "rows"), Packed(handle, "answers")

    @staticmethod
    def _over(us: int) -> int:
        """The first millisecond after a time in microseconds."""
        return us // 1000 + 1

    def _due(self, row: tuple) -> int:
        return self._over(row[1] + self.wait_us)

    def _wake(self, rows: list[tuple], answers: list[tuple]) -> None:
        """A timer for the first of these rows and answers that will be over."""
        times = [*map(self._due, rows), *(self._over(a[1]) for a in answers)]
        if times:
            self.handle.registerTimer(min(times))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        while part := list(islice(rows, ENTRY_ROWS)):
            waiting, answers = [], []
            for r in part:
                if r[self.is_answer]:
                    answers.append(tuple(r[i] for i in self.answer))
                else:
                    waiting.append(tuple(r[i] for i in self.row))
            self.rows.append(waiting)
            self.answers.append(answers)
            self._wake(waiting, answers)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # timers before it fire
        rows, answers = self.rows.get(), self.answers.get()
        over = [r for r in rows if self._due(r) < now]
        if not over and all(self._over(a[1]) >= now for a in answers):
            return  # another timer of this batch has been here
        given, left = defaultdict(list), defaultdict(list)
        for a in answers:
            given[a[0]].append(a)
        named = Row(*self.names)
        for r in over:
            in_time = [a[1:] for a in given.get(r[0], ()) if self._in_time(r, a) and a[2] is not None]
            yield named(*r, max(in_time)[1] if in_time else None)
        for r in rows:
            if self._due(r) >= now:
                left[r[0]].append(r)
        needed = lambda a: any(self._in_time(r, a) for r in left.get(a[0], ()))
        ahead = [a for a in answers if self._over(a[1]) >= now]
        behind = [a for a in answers if self._over(a[1]) < now and needed(a)]
        waiting = [r for of_key in left.values() for r in of_key]
        for state, had, kept in ((self.rows, rows, waiting), (self.answers, answers, ahead + behind)):
            if len(kept) < len(had):
                state.clear()
                state.append(kept)
        # answers that are over wait for a row, which has its own time
        self._wake(waiting, ahead)

    def _in_time(self, row: tuple, answer: tuple) -> bool:
        return row[1] <= answer[1] <= row[1] + self.wait_us

    def close(self) -> None:
        pass


def answered_rows(
    waiting: DataFrame, answers: DataFrame, key: str, wait: str = "10 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """The rows of a stream, each once, with ``__action``: the newest answer that came within the wait, or NULL.

    ``waiting`` has the key and ts; ``answers`` has the key, answer_ts and action.  A row leaves when
    the slower of the two streams, less the delay, has passed ts plus wait; its timer needs no
    row of the same key.  Rows that come late wait like others, for no time: none is lost.
    Rows of either stream with a null key are not kept, but move its time on (heartbeats).
    """
    spark = waiting.sparkSession
    wait_ms = spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {wait})")).first()[0]
    kept = [c for c in waiting.columns if c not in (key, "ts")]
    kind = waiting.schema[key].dataType
    asked = _clocked(waiting, "ts", delay, key).select(
        key, F.lit(False).alias("__answer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"), *kept,
        F.lit(None).cast("string").alias("__action"),
    )
    given = _clocked(answers, "answer_ts", delay, key).select(
        F.col(key).cast(kind).alias(key),
        F.lit(True).alias("__answer"),
        F.unix_micros(F.col("answer_ts").cast("timestamp")).alias("__at"),
        *[F.lit(None).cast(waiting.schema[c].dataType).alias(c) for c in kept],
        F.col("action").alias("__action"),
    )
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__bucket")
    both = asked.unionByName(given).select(bucket, "*")
    out = StructType([both.schema[c] for c in (key, "__at", *kept, "__action")])
    processor = VerdictProcessor(out.names, both.columns, wait_ms)
    decided = with_state(both, ["__bucket"], processor, out, timers=True)
    ts = F.timestamp_micros("__at").alias("ts")
    return decided.withColumn("ts", ts).select(*[F.col(c) for c in waiting.columns], "__action")


def _clocked(df: DataFrame, ts: str, delay: str, key: str) -> DataFrame:
    """The rows with a key and a time; the others, too, move the watermark, but no row is late by it.

    The watermark is of a column that the state does not see, so Spark drops none of its rows.
    """
    clock = event_time(df.withColumn("__clock", F.col(ts)), "__clock", delay)
    # one condition over the clock as well, so that it is not moved below the watermark
    keep = F.when(F.col("__clock").isNull(), F.lit(False)).otherwise(F.col(key).isNotNull())
    return clock.filter(keep).drop("__clock")


def verdict_return_stream(
    scored: DataFrame,
    answers: DataFrame,
    key: str = "doc_id",
    wait: str = "10 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """One decision per scored row: by the newest reviewer action that came within the wait, else review.

    ``scored`` has key, ts and score; ``answers`` has key, answer_ts and action.  Rows that need no
    answer leave at once, as do rows without a key or a time, which cannot wait.  Only
    borderline rows are kept in the state; one without an answer in time leaves with the
    fallback decision when its timer fires.
    """
    asked = F.coalesce(borderline("score", hi_closed=True), F.lit(False))
    can_wait = F.col(key).isNotNull() & F.col("ts").isNotNull()
    # rows that do not wait have no key here: they only move the time on
    queue = scored.withColumn(key, F.when(asked, F.col(key)))
    decided = answered_rows(queue, answers, key, wait, delay)
    rest = scored.filter(~(asked & can_wait)).withColumn("ts", F.col("ts").cast("timestamp"))
    rest = rest.select(*scored.columns, F.lit(None).cast("string").alias("__action"))
    return decided.unionByName(rest).withColumn("__r", route("score", "__action")).select(*scored.columns, "__r.*")
