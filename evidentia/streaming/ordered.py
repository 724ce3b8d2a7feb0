"""Live signals as streams with event-time timers, each equal to its batch twin.

A fold is a small state machine over one key's rows in event-time order, with a deadline that may fall due because nothing came. `ordered_stream` runs
any of them with transformWithState: rows wait in state until the watermark has passed them, so that they are folded in order whatever order they came
in; deadlines are folded between the rows where they belong; and a key that has been quiet for `keep_ms` of event time leaves no state behind.
Rows later than the watermark are dropped by Spark. A twin over tables has neither bound, so both agree on rows that are no later than the
lateness and on keys that are quiet for less than `keep_ms`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from evidentia.streaming import signals as S

#: Quiet event time after which a key's state is dropped.
KEEP_MS = 6 * 3_600_000
#: What a stream of marks has: `what` and `detail` are the fold's own.
MARKS = ("session_id", "key", "t", "seq", "what", "detail")
FOUND = "session_id string, key string, t long, what string, detail string"
#: (t, what, detail) of a finding.
Found = tuple[int, str, str]


@dataclass(frozen=True)
class Burst:
    """The threshold's worth of equal marks within the window; it starts anew when it fires."""

    threshold: int
    window_ms: int

    def start(self) -> dict:
        return {}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        times = [x for x in state.get(what, []) if t - x < self.window_ms] + [t]
        fires = len(times) >= self.threshold
        state[what] = [] if fires else times
        return [(t, what, str(len(times)))] if fires else []

    def due(self, state: dict) -> int | None:
        return None

    def fire(self, state: dict, at: int) -> list[Found]:
        return []


@dataclass(frozen=True)
class Storm:
    """Requests and failures of one endpoint, each with a burst of its own."""

    requests: Burst = Burst(S.STORM_REQUESTS, S.STORM_WINDOW_MS)
    failures: Burst = Burst(S.STORM_FAILURES, S.STORM_WINDOW_MS)

    def start(self) -> dict:
        return {}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        return (self.requests if what == "requests" else self.failures).step(state, t, what, detail)

    def due(self, state: dict) -> int | None:
        return None

    def fire(self, state: dict, at: int) -> list[Found]:
        return []


@dataclass(frozen=True)
class Abandoned:
    """Inputs, then a hidden page in time, with no mutating request between."""

    least: int = S.ABANDON_INPUTS
    window_ms: int = S.ABANDON_WINDOW_MS

    def start(self) -> dict:
        return {"n": 0, "last": None}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        if what == "input":
            state["n"], state["last"] = state["n"] + 1, t
        elif what == "mutation":
            state["n"] = 0
        elif what == "hidden" and state["n"] >= self.least and t - state["last"] <= self.window_ms:
            state["n"] = 0
            return [(t, "abandoned", "")]
        return []

    def due(self, state: dict) -> int | None:
        return None

    def fire(self, state: dict, at: int) -> list[Found]:
        return []


@dataclass(frozen=True)
class EarlyLook:
    """A look falls due when no trigger came for the debounce time, unless the look before is within the cool-down."""

    debounce_ms: int = S.FINALIZE_DEBOUNCE_MS
    cooldown_ms: int = S.FINALIZE_COOLDOWN_MS

    def start(self) -> dict:
        return {"last": None, "look": None}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        state["last"] = t
        return []

    def due(self, state: dict) -> int | None:
        return None if state["last"] is None else state["last"] + self.debounce_ms

    def fire(self, state: dict, at: int) -> list[Found]:
        state["last"] = None
        if state["look"] is not None and at - state["look"] < self.cooldown_ms:
            return []
        state["look"] = at
        return [(at, "look", "")]


@dataclass(frozen=True)
class Home:
    """A trace's rows belong to the tumbling session of its first row. The key is the trace, so that no service is one state."""

    minutes: int = 30

    def start(self) -> dict:
        return {"home": None}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        if state["home"] is None:
            state["home"] = t // (self.minutes * 60_000)
        return [(t, f"auto-{what}-{state['home']}", detail or "")]

    def due(self, state: dict) -> int | None:
        return None

    def fire(self, state: dict, at: int) -> list[Found]:
        return []


@dataclass(frozen=True)
class Desync:
    """A connection that dropped and came back, against what was seen of its resource before and after.

    Marks: open, drop, reopen, and seen with `detail` "resource digest". The state holds the last digest of every resource over reconnects.
    """

    verify_ms: int = 30_000

    def start(self) -> dict:
        return {"down": False, "last": {}, "held": None, "again": [], "at": None}

    def step(self, state: dict, t: int, what: str, detail: str | None) -> list[Found]:
        out: list[Found] = []
        if what == "seen":
            name, _, digest = (detail or "").rpartition(" ")
            if state["at"] is not None and name not in state["again"]:
                state["again"].append(name)
                if name in state["held"] and state["held"][name] != digest:
                    out = [(state["at"], "changed", name)]
                    state["at"] = None
            state["last"][name] = digest
        elif what == "reopen" and state["down"]:
            out = self.fire(state, t)
            state |= {"down": False, "at": t, "held": dict(state["last"]), "again": []}
        else:
            state["down"] = what == "drop"
        return out

    def due(self, state: dict) -> int | None:
        return None if state["at"] is None else state["at"] + self.verify_ms + 1

    def fire(self, state: dict, at: int) -> list[Found]:
        out = [] if state["at"] is None else [(state["at"], "unverified", "")]
        state["at"] = None
        return out


class _Ordered(StatefulProcessor):
    """Buffers a key's rows until the watermark has passed them and folds them in order, with the deadlines between them."""

    def __init__(self, fold, keep_ms: int):
        self.fold, self.keep_ms = fold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, seq long, what string, detail string")
        self.state = handle.getValueState("state", "fold string, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["t"], r["seq"], r["what"], r["detail"]) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(t for t, *_ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready, later = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        held = self.state.get() if self.state.exists() else None
        state, last = (json.loads(held[0]), held[1]) if held else (self.fold.start(), None)
        out: list[Found] = []
        for t, _, what, detail in ready:
            out += self._passed(state, t)
            out += self.fold.step(state, t, what, detail)
            last = t
        out += self._passed(state, upto + 1)
        if len(later) < len(rows):
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
        due = self.fold.due(state)
        if not later and due is None and (last is None or last + self.keep_ms <= upto):
            self.state.clear()
        else:
            self.state.update((json.dumps(state), last))
            self._wake(min(x for x in (later[0][0] if later else None, due, None if last is None else last + self.keep_ms) if x is not None), upto)
        return iter([Row(session_id=str(key[0]), key=str(key[1]), t=int(t), what=what, detail=detail) for t, what, detail in out])

    def _passed(self, state: dict, t: int) -> list[Found]:
        """What fell due before a time."""
        out: list[Found] = []
        while (due := self.fold.due(state)) is not None and due <= t:
            out += self.fold.fire(state, due)
        return out

    def _wake(self, at: int, gone: int = -1) -> None:
        """A timer at this time, unless one is due sooner; those up to `gone` are firing now."""
        if not any(gone < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def ordered_stream(marks: DataFrame, fold, lateness: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """marks(session_id, key, t, seq, what, detail) as a stream -> findings. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`)."""
    typed = marks.select(F.col("session_id").cast("string").alias("session_id"), F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"), "what", F.col("detail").cast("string").alias("detail"))
    timed = typed.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)
    return timed.groupBy("session_id", "key").transformWithState(statefulProcessor=_Ordered(fold, keep_ms), outputStructType=FOUND, outputMode="append", timeMode="eventTime")


def _marks(events: DataFrame, key, what, detail=None) -> DataFrame:
    return events.select("session_id", key.alias("key"), "t", "seq", what.alias("what"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")).where("what IS NOT NULL")


def storm_marks(events: DataFrame, endpoint) -> DataFrame:
    failed = (F.col("k") == "net.err") | ((F.col("k") == "net.res") & (F.col("st") >= 400))
    return _marks(events, endpoint, F.when(F.col("k") == "net.req", "requests").when(failed, "failures"))


def slow_marks(events: DataFrame, slow_ms: float = S.SLOW_MS) -> DataFrame:
    return _marks(events, F.lit("session"), F.when((F.col("k") == "net.res") & (F.col("dur") >= slow_ms), "slow"))


def flow_marks(events: DataFrame) -> DataFrame:
    mutation = (F.col("k") == "net.req") & ~F.coalesce("method", F.lit("GET")).isin("GET", "HEAD")
    return _marks(events, F.lit("flow"), F.when(F.col("k") == "inp", "input").when((F.col("k") == "vis") & (F.col("msg") == "hidden"), "hidden").when(mutation, "mutation"))


def trigger_marks(triggers: DataFrame) -> DataFrame:
    return triggers.select("session_id", F.lit("look").alias("key"), "t", F.lit(0).cast("long").alias("seq"), F.lit("trigger").alias("what"), F.lit(None).cast("string").alias("detail"))


def trace_marks(events: DataFrame) -> DataFrame:
    """events(service, trace_id, t, seq): the trace is the key, and `what` the service."""
    return events.select(F.col("service").alias("session_id"), F.col("trace_id").alias("key"), "t", "seq", F.col("service").alias("what"), F.col("seq").cast("string").alias("detail"))


#: Stream twins: retry storms (T2), slow responses (T3), abandoned flows (T4), early looks (T9), tumbling sessions (T12).
def retry_storms_stream(events: DataFrame, endpoint, **kw) -> DataFrame:
    return ordered_stream(storm_marks(events, endpoint), Storm(), **kw)


def slow_responses_stream(events: DataFrame, **kw) -> DataFrame:
    return ordered_stream(slow_marks(events), Burst(S.SLOW_RESPONSES, S.SLOW_WINDOW_MS), **kw)


def abandoned_flows_stream(events: DataFrame, **kw) -> DataFrame:
    return ordered_stream(flow_marks(events), Abandoned(), **kw)


def early_looks_stream(triggers: DataFrame, debounce_ms: int = S.FINALIZE_DEBOUNCE_MS, cooldown_ms: int = S.FINALIZE_COOLDOWN_MS, **kw) -> DataFrame:
    return ordered_stream(trigger_marks(triggers), EarlyLook(debounce_ms, cooldown_ms), **kw)


def tumbling_sessions_stream(events: DataFrame, minutes: int = 30, **kw) -> DataFrame:
    return ordered_stream(trace_marks(events), Home(minutes), **kw)


def desync_stream(marks: DataFrame, verify_ms: int = 30_000, **kw) -> DataFrame:
    """marks as of `desync.stream_marks`."""
    return ordered_stream(marks, Desync(verify_ms), **kw)
