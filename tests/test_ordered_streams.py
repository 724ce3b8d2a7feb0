"""Streams with event-time timers against their batch twins, with rows out of order and late; and stream desync."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evidentia.operators import desync as Y
from evidentia.streaming import ordered as O
from evidentia.streaming import signals as S
from tests.test_detectors_screen import telemetry

FAR = 10**9
MARKS = "session_id string, key string, t long, seq long, what string, detail string"


def played(spark, tmp_path, batches, schema, make, name):
    """Feeds each batch as a micro-batch of its own, then a far mark that moves the watermark past all timers; returns the findings."""
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / name
    source.mkdir()
    try:
        stream = spark.readStream.schema(schema).json(str(source))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        fields = [c.split()[0] for c in schema.split(", ")]
        for n, batch in enumerate(batches):
            text = "\n".join(json.dumps(dict(zip(fields, row, strict=True))) for row in batch)
            hidden = source / f"_b{n}"
            hidden.write_text(text)
            hidden.rename(source / f"b{n}.json")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.table(name).collect()


def shuffled(rows, seed, size=6):
    """Rows in micro-batches, out of order within reach of a lateness of 10 seconds."""
    r = random.Random(seed)
    moved = sorted(rows, key=lambda x: x[2] + r.uniform(0, 4000))
    return [moved[i : i + size] for i in range(0, len(moved), size)]


def flush(key=("zz", "zz")):
    return [(*key, FAR, 0, "flush", None)]


def test_storms_looks_and_flows_agree_with_their_twins(spark, tmp_path):
    r = random.Random(7)
    events = []
    for s in ("a", "b"):
        t = 0
        for n in range(120):
            t += r.choice([200, 900, 2500, 20_000])
            k, st, dur, m, msg = r.choice([("net.req", None, None, "GET", None), ("net.req", None, None, "POST", None), ("net.res", 500, 100.0, None, None), ("net.res", 200, 4000.0, None, None), ("inp", None, None, None, None), ("inp", None, None, None, None), ("vis", None, None, None, "hidden")])
            events.append((s, n, t, k, st, dur, m, msg, f"e{r.randrange(2)}"))
    log = spark.createDataFrame(events, "session_id string, seq long, t long, k string, st int, dur double, method string, msg string, endpoint string")
    folds = {
        "storms": (O.storm_marks(log, F.col("endpoint")), O.Storm(), {(x["session_id"], x["key"], x["t"], x["kind"]) for x in S.retry_storms(log, F.col("endpoint")).collect()}, lambda x: (x["session_id"], x["key"], x["t"], x["what"])),
        "slow": (O.slow_marks(log), O.Burst(S.SLOW_RESPONSES, S.SLOW_WINDOW_MS), {(x["session_id"], x["t"]) for x in S.slow_responses(log).collect()}, lambda x: (x["session_id"], x["t"])),
        "flows": (O.flow_marks(log), O.Abandoned(), {(x["session_id"], x["t"]) for x in S.abandoned_flows(log).collect()}, lambda x: (x["session_id"], x["t"])),
        "looks": (O.trigger_marks(log.where("st = 500")), O.EarlyLook(), {(x["session_id"], x["look_t"]) for x in S.early_looks(log.where("st = 500")).collect()}, lambda x: (x["session_id"], x["t"])),
    }
    for name, (marks, fold, want, row) in folds.items():
        rows = [tuple(x) for x in marks.select(*O.MARKS).collect()]
        got = played(spark, tmp_path, [*shuffled(rows, 3, 30), flush(), flush(("zz", "zy"))], MARKS, lambda m, f=fold: O.ordered_stream(m, f), name)
        assert {row(x) for x in got if x["session_id"] != "zz"} == want and want, name


def test_late_rows_are_dropped(spark, tmp_path):
    trigger = lambda t: ("s", "look", t, 0, "trigger", None)
    batches = [[trigger(1000)], [("u", "look", 400_000, 0, "trigger", None)], [trigger(2000), ("u", "look", 400_500, 0, "trigger", None)], [trigger(900_000)], flush(), flush(("zz", "zy"))]
    got = played(spark, tmp_path, batches, MARKS, lambda m: O.ordered_stream(m, O.EarlyLook(100, 400)), "late")
    # 2000 is later than the watermark of 390000: it neither moves nor adds a look
    assert sorted((x["session_id"], x["t"]) for x in got if x["session_id"] != "zz") == [("s", 1100), ("s", 900_100), ("u", 400_100), ("u", 400_600)]


def test_tumbling_sessions_agree(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["api", "web"]), f"t{r.randrange(6)}", r.randrange(0, 5_400_000, 1000), n) for n in range(60)]
    log = spark.createDataFrame(rows, "service string, trace_id string, t long, seq long")
    want = {(x["service"], x["trace_id"], x["seq"], x["session_id"]) for x in S.tumbling_sessions(log).collect()}
    marks = [tuple(x) for x in O.trace_marks(log).select(*O.MARKS).collect()]
    got = played(spark, tmp_path, [*shuffled(marks, 2, 20), flush(), flush(("zz", "zy"))], MARKS, lambda m: O.ordered_stream(m, O.Home()), "homes")
    assert {(x["session_id"], x["key"], int(x["detail"]), x["what"]) for x in got if x["session_id"] != "zz"} == want


class Held:
    """A key's state and timers, as the processor sees them."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        held = self

        class Value:
            exists = staticmethod(lambda: held.value is not None)
            get = staticmethod(lambda: held.value)
            update = staticmethod(lambda v: setattr(held, "value", v))
            clear = staticmethod(lambda: setattr(held, "value", None))

        return Value

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


def driven(fold, batches, watermarks, keep_ms=1000):
    """The processor alone: batches of (t, seq, what, detail) and the watermark that is reached after each."""
    held, out = Held(), []
    p = O._Ordered(fold, keep_ms)
    p.init(held)
    for batch, mark in zip(batches, watermarks, strict=True):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m)
        if batch:
            list(p.handleInputRows(("s", "k"), (dict(zip(("t", "seq", "what", "detail"), r, strict=True)) for r in batch), now))
        for t in sorted(t for t in held.timers if t <= mark):
            out += list(p.handleExpiredTimer(("s", "k"), now, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
            held.timers.discard(t)
    return [(r["t"], r["what"]) for r in out], held


def test_order_of_arrival_does_not_matter_and_quiet_keys_leave_no_state():
    r = random.Random(2)
    for _ in range(200):
        rows = [(t, n, r.choice(["drop", "reopen", "seen", "open"]), f"x d{r.randrange(2)}") for n, t in enumerate(sorted(r.randrange(3000) for _ in range(25)))]
        whole, held = driven(O.Desync(200), [rows, []], [3000, 10_000])
        assert (held.rows, held.value, held.timers) == ([], None, set())
        at = sorted(rows, key=lambda x: x[0] + r.uniform(0, 300))
        parts = [at[i : i + 5] for i in range(0, 25, 5)]
        marks = [min((x[0] for p in parts[k + 1 :] for x in p), default=3000) - 1 for k in range(5)]
        for k in range(1, 5):
            marks[k] = max(marks[k], marks[k - 1])
        split, held = driven(O.Desync(200), [*parts, []], [*marks, 10_000])
        assert split == whole and (held.rows, held.value, held.timers) == ([], None, set())
        _, held = driven(O.Desync(200), [rows, []], [3000, 3500], keep_ms=10_000)
        assert held.value is not None and held.timers


# ---- stream desync

STREAM = "/api/orders/stream"


def sse(t, op, kind="net.sse", url=STREAM, **d):
    return (t, kind, {"url": url, "op": op, **d})


def get(t, i, url, body):
    return [(t, "net.req", {"id": i, "requestId": i, "method": "GET", "url": url}), (t + 100, "net.res", {"id": i, "requestId": i, "st": 200, **({"body": json.dumps(body)} if not isinstance(body, str) else {"body": body})})]


def dbread(t, rid, status):
    return (t, "db.read", {"table": "orders", "pk": {"id": 1}, "row": {"id": 1, "status": status}, "requestId": rid})


BACK = [sse(1000, "open"), sse(2000, "error"), sse(3000, "open", reopen=True, count=1)]
PENDING, SHIPPED = [{"id": 1, "status": "pending"}], [{"id": 1, "status": "shipped"}]
ROWS = [*get(500, "a", "/api/orders/1", {"ok": True}), dbread(550, "a", "pending"), *BACK, *get(4000, "b", "/api/orders/1", {"ok": True}), dbread(4050, "b", "shipped")]
WS = [sse(1000, "open", "net.ws", "wss://app.test/api/orders/stream"), sse(2000, "close", "net.ws", "wss://app.test/api/orders/stream", code=1006), sse(3000, "open", "net.ws", "wss://app.test/api/orders/stream", reopen=True)]
#: name -> (events, severity of the finding or None)
DESYNC = {
    "changed": ([*get(500, "a", "/api/orders", PENDING), *BACK, *get(4000, "b", "/api/orders", SHIPPED)], "medium"),
    "same": ([*get(500, "a", "/api/orders", PENDING), *BACK, *get(4000, "b", "/api/orders", PENDING)], "low"),
    "unchecked": (BACK, "low"),
    "opaque": ([*get(500, "a", "/api/orders", "<html>1"), *BACK, *get(4000, "b", "/api/orders", "<html>2")], "low"),
    "no_reopen": (BACK[:2], None),
    "plain_open": ([*BACK[:2], sse(3000, "open")], None),
    "closed": ([BACK[0], sse(2000, "close"), sse(3000, "open", reopen=True)], "low"),
    "rows": (sorted(ROWS, key=lambda e: e[0]), "medium"),
    "elsewhere": ([*get(500, "a", "/api/inventory", [{"id": 1, "count": 4}]), *BACK, *get(4000, "b", "/api/inventory", [{"id": 1, "count": 9}])], "low"),
    "socket": ([*get(500, "a", "/api/orders", PENDING), *WS, *get(4000, "b", "/api/orders", SHIPPED)], "medium"),
    "stayed": (WS[:1], None),
    "seen_long_after": ([*get(500, "a", "/api/orders", PENDING), *BACK, *get(90_000, "b", "/api/orders", SHIPPED)], "low"),
}


@pytest.fixture(scope="module")
def log(spark):
    return telemetry(spark, {k: e for k, (e, _) in DESYNC.items()}).cache()


def test_stream_desync(log):
    got = {r["session_id"]: r for r in Y.stream_desync(log).collect()}
    assert {k: got[k]["severity"] if k in got else None for k in DESYNC} == {k: v for k, (_, v) in DESYNC.items()}
    assert "never delivered" in got["changed"]["message"] and "orders" in got["rows"]["message"] and "could not be verified" in got["same"]["message"]


def test_desync_stream_agrees_with_its_twin(spark, tmp_path, log):
    r = random.Random(9)
    rows = [tuple(x) for x in Y.stream_marks(log).select(*O.MARKS).collect()]
    for s in range(8):
        t = 0
        for n in range(60):
            t += r.choice([100, 1000, 9000])
            what = r.choice(["open", "drop", "reopen", "reopen", "seen", "seen", "seen"])
            rows.append((f"r{s}", "/api", t, n, what, f"x{r.randrange(2)} d{r.randrange(3)}" if what == "seen" else None))
    want = sorted((x["session_id"], x["key"], x["t"], x["what"], x["detail"]) for x in Y.reconnects(spark.createDataFrame(rows, MARKS)).collect())
    got = played(spark, tmp_path, [*shuffled(rows, 4, 60), flush(), flush(("zz", "zy"))], MARKS, O.desync_stream, "desync")
    assert sorted((x["session_id"], x["key"], x["t"], x["what"], x["detail"]) for x in got) == want and len(want) > 20
