"""Counters with expiry, lockouts and debounced triggers as keyed state with
event-time timers.

Rows wait in state until the watermark has passed them and are then handled in
order of time and id, so a stream in any number of batches gives what one batch
gives, if rows come no later than the watermark's delay. State lives in the
stream's checkpoint and is there again after a restart; it is dropped when its
deadline passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Handles a key's rows (t in microseconds, id, x) in order once the
    watermark passes them, and its deadline (in microseconds, None: no deadline)
    once neither a row nor the watermark lies before it."""

    #: Schema of the state, which starts as ``START``.
    STATE = ""
    START: tuple = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "t long, id long, x long")
        self._state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            t, ident, x = (frame.iloc[:, place].tolist() for place in (-3, -2, -1))
            self._waiting.appendList(list(zip(t, ident, x)))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Handle what the watermark (in milliseconds) has passed."""
        waiting = sorted(tuple(r) for r in self._waiting.get()) if self._waiting.exists() else []
        due = [r for r in waiting if r[0] // 1000 < watermark]
        state = tuple(self._state.get()) if self._state.exists() else self.START
        out = []
        for t, ident, x in due:
            deadline = self.deadline(state)
            if deadline is not None and deadline <= t:
                state, more = self.expired(state)
                out += more
            state, more = self.step(state, t, ident, x)
            out += more
        deadline = self.deadline(state)
        if deadline is not None and deadline // 1000 < watermark:
            state, more = self.expired(state)
            out += more
            deadline = self.deadline(state)
        if due:
            rest = waiting[len(due) :]
            self._waiting.put(rest) if rest else self._waiting.clear()
        else:
            rest = waiting
        self._state.update(state) if state != self.START else self._state.clear()
        times = [t // 1000 for t, *_ in rest[:1]] + ([math.ceil(deadline / 1000)] if deadline is not None else [])
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if times:
            self._handle.registerTimer(max(min(times), watermark))
        if out:
            frame = pd.DataFrame(out, columns=self.COLUMNS)
            for place, value in enumerate(key):
                frame.insert(place, f"_k{place}", value)
            yield frame

    def close(self) -> None:
        pass

    COLUMNS: list[str] = []

    def deadline(self, state: tuple) -> int | None:
        raise NotImplementedError

    def expired(self, state: tuple) -> tuple[tuple, list]:
        raise NotImplementedError

    def step(self, state: tuple, t: int, ident: int, x: int) -> tuple[tuple, list]:
        raise NotImplementedError


class LivingCounter(InOrder):
    """A count that every row raises and keeps alive for ``ttl`` microseconds more."""

    STATE, START, COLUMNS = "start long, last long, n long", (0, 0, 0), ["start", "last_until", "n"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def deadline(self, state):
        return state[1] + self.ttl if state[2] else None

    def expired(self, state):
        return self.START, [(state[0], state[1] + self.ttl, state[2])]

    def step(self, state, t, ident, x):
        return ((state[0] if state[2] else t), t, state[2] + 1), []


class Throttle(InOrder):
    """Failures (x 0) within ``window`` of the one before count up; from the
    ``most``-th on each locks the key for ``lock``. What comes while it is
    locked is turned away and not counted; a success (x 1) clears all."""

    STATE, START, COLUMNS = "n long, last long, until long", (0, 0, 0), ["id", "allowed", "attempts", "locked_until"]

    def __init__(self, most: int, window: int, lock: int):
        self.most, self.window, self.lock = most, window, lock

    def deadline(self, state):
        return max(state[1] + self.window, state[2]) if state[0] else None

    def expired(self, state):
        return self.START, []

    def step(self, state, t, ident, x):
        n, last, until = state
        if until > t:
            return state, [(ident, False, n, until)]
        if x:
            return self.START, [(ident, True, 0, None)]
        n = n + 1 if n and last + self.window > t else 1
        until = t + self.lock if n >= self.most else 0
        return (n, t, until), [(ident, True, n, until or None)]


class Debounce(InOrder):
    """Fires once when a value has stood unchanged for ``quiet`` microseconds,
    unless it fired for that value last. Values of 0 or less never fire."""

    STATE, START, COLUMNS = "seen long, since long, open boolean, fired long", (0, 0, False, 0), ["value", "fired_at"]

    def __init__(self, quiet: int):
        self.quiet = quiet

    def deadline(self, state):
        return state[1] + self.quiet if state[2] else None

    def expired(self, state):
        seen, since, _, fired = state
        if seen <= 0 or seen == fired:
            return (seen, since, False, fired), []
        return (seen, since, False, seen), [(seen, since + self.quiet)]

    def step(self, state, t, ident, x):
        return (state if x == state[0] else (x, t, True, state[3])), []


def _run(events: DataFrame, processor: InOrder, keys: list[str], ts: str, ident: Column, value: Column, schema: str, delay: str) -> DataFrame:
    """The processor over a stream's rows; rows without a time or id are left out."""
    rows = events.select(*[F.col(k) for k in keys], F.col(ts).cast("timestamp").alias("_ts"), ident.cast("long").alias("_id"), value.cast("long").alias("_x")).where("_ts IS NOT NULL AND _id IS NOT NULL")
    rows = rows.withWatermark("_ts", delay).select(*keys, "_ts", F.unix_micros("_ts").alias("_t"), "_id", "_x")
    kinds = ", ".join(f"_k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    found = rows.groupBy(*keys).transformWithStateInPandas(processor, f"{kinds}, {schema}", "Append", "EventTime")
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in found.columns if not c.startswith("_k")])


def _when(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


def living_counts(events: DataFrame, ts: str, keys: list[str], ttl_seconds: int, id_col: str, delay: str = "0 seconds") -> DataFrame:
    """(keys, start, last_until, n) of counters that have ended: nothing was
    counted for ``ttl_seconds`` (X05). A stream; nulls in keys are a key."""
    found = _run(events, LivingCounter(ttl_seconds * 1_000_000), keys, ts, F.col(id_col), F.lit(0), "start long, last_until long, n long", delay)
    return _when(found, "start", "last_until")


def throttled(events: DataFrame, ts: str, keys: list[str], id_col: str, success: Column, most: int, window_seconds: int, lock_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, id, allowed, attempts, locked_until): what became of each attempt
    (X06). A stream of successes and failures."""
    second = 1_000_000
    found = _run(events, Throttle(most, window_seconds * second, lock_seconds * second), keys, ts, F.col(id_col), success.cast("int"), "id long, allowed boolean, attempts long, locked_until long", delay)
    return _when(found, "locked_until").withColumnRenamed("id", id_col)


def debounced(events: DataFrame, ts: str, keys: list[str], id_col: str, value: Column, quiet_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(keys, value, fired_at): a row once a value has stood for
    ``quiet_seconds`` and isn't the one fired last (X09). A stream."""
    found = _run(events, Debounce(quiet_seconds * 1_000_000), keys, ts, F.col(id_col), value, "value long, fired_at long", delay)
    return _when(found, "fired_at")


class rocks:
    """Within it, streams start with the state store that timers need; the
    session's own setting is back afterwards."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(_PROVIDER, None)
        self.conf.set(_PROVIDER, _ROCKS)

    def __exit__(self, *_):
        self.conf.set(_PROVIDER, self.before) if self.before else self.conf.unset(_PROVIDER)
