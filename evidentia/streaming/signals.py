"""Live signal detectors as stateful streaming operators, and their batch twins over ordered arrays.

Each detector resets when it fires, so a plain sliding window would fire again on the next event: state is kept per key.
The reference semantics have no lateness bound; a stream needs one, and rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Thresholds and windows.
RAGE_CLICKS, RAGE_WINDOW_MS = 4, 1500
STORM_REQUESTS, STORM_FAILURES, STORM_WINDOW_MS = 4, 2, 5000
SLOW_RESPONSES, SLOW_MS, SLOW_WINDOW_MS = 3, 3000, 10_000
ABANDON_INPUTS, ABANDON_WINDOW_MS = 2, 30_000

FIRED = "session_id string, key string, t long, n int"


def _burst(threshold: int, window_ms: int):
    """State: times inside the window; fires at the threshold and starts anew."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(t for pdf in batches for t in pdf["t"].tolist()):
            times = [x for x in times if t - x < window_ms] + [t]
            if len(times) >= threshold:
                out.append((str(key[0]), str(key[1]), t, len(times)))
                times = []
        state.update((times,))
        state.setTimeoutDuration(max(1, 10 * window_ms))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "key", "t", "n"])

    return run


def bursts_stream(events: DataFrame, threshold: int = RAGE_CLICKS, window_ms: int = RAGE_WINDOW_MS) -> DataFrame:
    """events(session_id, key, t) as a stream -> firings."""
    return events.groupBy("session_id", "key").applyInPandasWithState(_burst(threshold, window_ms), FIRED, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def bursts(events: DataFrame, threshold: int = RAGE_CLICKS, window_ms: int = RAGE_WINDOW_MS) -> DataFrame:
    """The batch twin: a fold over the ordered times of each key."""
    ordered = events.groupBy("session_id", "key").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    zero = F.struct(F.array().cast("array<bigint>").alias("times"), F.array().cast("array<bigint>").alias("fired"))

    def step(s: Column, t: Column) -> Column:
        times = F.concat(F.filter(s["times"], lambda x: t - x < window_ms), F.array(t))
        fires = F.size(times) >= threshold
        return F.struct(F.when(fires, F.array().cast("array<bigint>")).otherwise(times).alias("times"), F.when(fires, F.concat(s["fired"], F.array(t))).otherwise(s["fired"]).alias("fired"))

    fired = ordered.select("session_id", "key", F.explode(F.aggregate("ts", zero, step, lambda s: s["fired"])).alias("t"))
    return fired.select("session_id", "key", "t", F.lit(threshold).alias("n"))


def rage_clicks(events: DataFrame, target: Column, **kw) -> DataFrame:
    return bursts(events.where("k = 'clk'").select("session_id", target.alias("key"), "t"), **kw)


def retry_storms(events: DataFrame, endpoint: Column, window_ms: int = STORM_WINDOW_MS) -> DataFrame:
    """Requests or failures of one endpoint in a burst; an endpoint that storms both ways is reported for each."""
    requests = bursts(events.where("k = 'net.req'").select("session_id", endpoint.alias("key"), "t"), STORM_REQUESTS, window_ms)
    failures = bursts(events.where("k = 'net.err' OR (k = 'net.res' AND st >= 400)").select("session_id", endpoint.alias("key"), "t"), STORM_FAILURES, window_ms)
    return requests.withColumn("kind", F.lit("requests")).unionByName(failures.withColumn("kind", F.lit("failures")))


def slow_responses(events: DataFrame, slow_ms: float = SLOW_MS, threshold: int = SLOW_RESPONSES, window_ms: int = SLOW_WINDOW_MS) -> DataFrame:
    return bursts(events.where((F.col("k") == "net.res") & (F.col("dur") >= slow_ms)).select("session_id", F.lit("session").alias("key"), "t"), threshold, window_ms)


def abandoned_flows(events: DataFrame, window_ms: int = ABANDON_WINDOW_MS, least: int = ABANDON_INPUTS) -> DataFrame:
    """A page hidden within the window after enough inputs, with no mutating request between: a fold over the session."""
    kind = F.when(F.col("k") == "inp", 1).when((F.col("k") == "vis") & (F.col("msg") == "hidden"), 2).when((F.col("k") == "net.req") & ~F.coalesce("method", F.lit("GET")).isin("GET", "HEAD"), 3)
    ordered = events.withColumn("e", kind).where("e IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "e"))).alias("xs"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("fired"))

    def step(s: Column, x: Column) -> Column:
        fires = (x["e"] == 2) & (s["n"] >= least) & (x["t"] - s["last"] <= window_ms)
        n = F.when(x["e"] == 1, s["n"] + 1).when((x["e"] == 3) | fires, F.lit(0)).otherwise(s["n"])
        return F.struct(n.alias("n"), F.when(x["e"] == 1, x["t"]).otherwise(s["last"]).alias("last"), F.when(fires, F.concat(s["fired"], F.array(x["t"]))).otherwise(s["fired"]).alias("fired"))

    return ordered.select("session_id", F.explode(F.aggregate("xs", zero, step, lambda s: s["fired"])).alias("t"))


def idle_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity windows that end after an idle gap; works on batch tables and, with a watermark, on streams."""
    return events.withColumn("ts", F.timestamp_millis("t")).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "session_id", F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "n")


def tumbling_sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """service -> tumbling sessions of fixed length; a trace stays with the session that saw it first."""
    bucket = F.floor(F.col("t") / (minutes * 60_000))
    first = events.groupBy("service", "trace_id").agg(F.min("t").alias("t"))
    home = first.select("service", "trace_id", F.concat_ws("-", F.lit("auto"), "service", bucket.cast("string")).alias("session_id"))
    return events.join(home, ["service", "trace_id"])


def throttle(events: DataFrame, keys: list[str], least_ms: int) -> DataFrame:
    """Rows at least `least_ms` after the last kept one: a fold, since the bound is to the kept row and not the previous one."""
    ordered = events.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    kept = F.expr(f"aggregate(ts, CAST(array() AS ARRAY<BIGINT>), (a, t) -> CASE WHEN size(a) = 0 OR t - a[greatest(size(a) - 1, 0)] >= {least_ms} THEN concat(a, array(t)) ELSE a END)")
    return ordered.select(*keys, F.explode(kept).alias("t"))


# ---- flags, buffers, late data


#: Time and number of events that a ring buffer holds; debounce, cool-down and lateness of an early look at a session.
RING_MS, RING_EVENTS = 300_000, 50_000
FINALIZE_DEBOUNCE_MS, FINALIZE_COOLDOWN_MS, LATE_MS = 45_000, 300_000, 1000


def auto_flags(signals: DataFrame, debounce_ms: int, most: int) -> DataFrame:
    """signals(session_id, t, key, tag) -> t, key, tag of the flags that a session raises by itself.

    Only the first signal of a key counts. A flag falls due when no new key came for the debounce time after it, and is that of the first
    waiting signal; a session raises so many at most. Groups of waiting signals are gaps in the ordered times: windows, no fold.
    """
    first = signals.groupBy("session_id", "key").agg(F.min(F.struct("t", "tag")).alias("f")).select("session_id", "key", "f.*")
    order = Window.partitionBy("session_id").orderBy("t", "key")
    parted = first.withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(order) >= debounce_ms, F.lit(True)).cast("int"))
    grouped = parted.withColumn("group", F.sum("gap").over(order))
    return grouped.where((F.col("gap") == 1) & (F.col("group") <= most)).select("session_id", "t", "key", "tag", "group")


def _flag_state(debounce_ms: int, most: int):
    """State: keys seen, the waiting signal, time of the last new key, flags so far. A later signal, or the end of the wait in event time, raises the waiting one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, waiting, last, n = state.get if state.exists else ([], None, None, 0)
        seen, out = set(seen), []
        rows = [] if state.hasTimedOut else sorted((int(r.t), r.key, r.tag) for pdf in batches for r in pdf.itertuples())
        for t, k, tag in rows:
            if k in seen or (n >= most and waiting is None):
                continue
            if waiting is not None and t - last >= debounce_ms:
                out.append((str(key[0]), *waiting))
                waiting, n = None, n + 1
                if n >= most:
                    continue
            seen.add(k)
            waiting = waiting or (t, k, tag)
            last = t
        if state.hasTimedOut and waiting is not None:
            out.append((str(key[0]), *waiting))
            waiting, n = None, n + 1
        state.update((sorted(seen), waiting, last, n))
        if waiting is not None:
            state.setTimeoutTimestamp(max(last + debounce_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "t", "key", "tag"])

    return run


def auto_flags_stream(signals: DataFrame, debounce_ms: int, most: int, lateness: str = "10 seconds") -> DataFrame:
    """The same on a stream, in event time: rows later than the watermark are dropped by Spark before they reach the state."""
    timed = signals.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)
    schema = "seen array<string>, waiting struct<t:long,key:string,tag:string>, last long, n int"
    return timed.groupBy("session_id").applyInPandasWithState(_flag_state(debounce_ms, most), "session_id string, t long, key string, tag string", schema, "append", GroupStateTimeout.EventTimeTimeout)


def ring_snapshot(events: DataFrame, at: DataFrame, window_ms: int = RING_MS, most: int = RING_EVENTS) -> DataFrame:
    """at(session_id, flag_t): what a buffer of so much time and so many events holds at each flag: its events up to then, the latest ones."""
    from evidentia.operators.joins import range_join

    held = range_join(at, events, ["session_id"], "flag_t", "t", window_ms, 0)
    w = Window.partitionBy("session_id", "flag_t").orderBy(F.desc("t"), F.desc("seq"))
    return held.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def bounded_bus(events: DataFrame, batch: Column, most: int = RING_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(events that a bus of so many places passes on, drops of each session and batch): the oldest of a batch go first."""
    w = Window.partitionBy("session_id", "__b").orderBy(F.desc("seq"))
    placed = events.withColumn("__b", batch).withColumn("__r", F.row_number().over(w))
    drops = placed.groupBy("session_id", F.col("__b").alias("batch")).agg(F.count_if(F.col("__r") > most).alias("dropped")).where("dropped > 0")
    return placed.where(F.col("__r") <= most).drop("__b", "__r"), drops


def early_looks(triggers: DataFrame, debounce_ms: int = FINALIZE_DEBOUNCE_MS, cooldown_ms: int = FINALIZE_COOLDOWN_MS) -> DataFrame:
    """triggers(session_id, t) of high severity -> when each session is looked at early: the debounce time after a run of triggers, and no
    sooner than the cool-down after the look before. The look depends on the one before it, so the ordered ends of runs are folded."""
    order = Window.partitionBy("session_id").orderBy("t")
    ends = triggers.withColumn("next", F.lead("t").over(order)).where(F.col("next").isNull() | (F.col("next") - F.col("t") >= debounce_ms))
    due = ends.groupBy("session_id").agg(F.array_sort(F.collect_list(F.col("t") + debounce_ms)).alias("ts"))
    step = f"(a, t) -> CASE WHEN size(a) = 0 OR t - a[greatest(size(a) - 1, 0)] >= {cooldown_ms} THEN concat(a, array(t)) ELSE a END"
    return due.select("session_id", F.explode(F.expr(f"aggregate(ts, CAST(array() AS ARRAY<BIGINT>), {step})")).alias("look_t"))


def late_sessions(events: DataFrame, finished: DataFrame, late_ms: int = LATE_MS) -> DataFrame:
    """finished(session_id, end): sessions with events newer than what they were finished with; they are made anew as a whole."""
    newest = events.groupBy("session_id").agg(F.max("t").alias("newest"))
    return newest.join(finished, "session_id").where(F.col("newest") > F.col("end") + late_ms).select("session_id", "end", "newest")


def with_watermark(events: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """A stream whose order holds within the lateness: what comes later is dropped and does not fire a detector."""
    return events.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)
