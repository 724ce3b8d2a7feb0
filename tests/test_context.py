"""Regression and linked request context, recurrence, and the predicates and aggregates that reads are made of."""

import json

from evidentia import api
from evidentia.functions import text as X
from evidentia.operators import aggregates as A
from evidentia.operators import context as C
from evidentia.operators import projections as P
from tests.test_detectors_screen import telemetry


def run(t0, status, extra=(), release="v1", clicks=("a", "b")):
    out = [(t0, "nav", {"to": "/cart"}), *[(t0 + 10 * (n + 1), "clk", {"el": {"sig": s}}) for n, s in enumerate(clicks)]]
    out += [(t0 + 100, "net.req", {"id": "1", "requestId": "r1", "method": "POST", "url": "http://x/api/orders/7"}), (t0 + 110, "db.diff", {"op": "insert", "table": "orders", "pk": {"id": 7}, "after": {"id": 7}, "requestId": "r1"}),
            (t0 + 150, "net.res", {"id": "1", "st": status, "dur": 50}), (t0 + 160, "env", {"release": release, "flags": {"f": "on"}})]
    return [*out, *extra]


def test_regression_context(spark):
    note = (1300, "db.diff", {"op": "insert", "table": "notes", "pk": {"id": 1}, "after": {"id": 1}, "requestId": "r1"})
    log = telemetry(spark, {"good": run(0, 200), "bad": run(1000, 500, [note], "v2", ("a", "c")), "other": run(5000, 500), "same": run(9000, 200)})
    got = {k: df.collect() for k, df in api.get_regression_context(log, "good", "bad").items()}
    assert sorted((r["change"], r["sig"]) for r in got["steps"]) == [("added", "c"), ("missing", "b")]
    assert [(r["divergence"], r["a_st"], r["b_st"], r["b_t"], r["b_request_id"]) for r in got["calls"]] == [("status", 200, 500, 1100, "r1")]
    assert [(r["table"], r["change"], r["b_t"], json.loads(r["b_after"])) for r in got["writes"]] == [("notes", "added", 1300, {"id": 1})]
    assert [(r["key"], r["before"], r["after"], r["change"]) for r in got["environment"]] == [("release", "v1", "v2", "changed")]
    assert [(r["t0"], r["t1"], r["requests"]) for r in got["window"]] == [(100, 2300, ["r1"])]
    assert {r["plane"]: r["n"] for r in got["summary"]} == {"flow": 2, "network": 1, "db": 1, "env": 1}
    pairs = spark.createDataFrame([("p", "good", "bad"), ("q", "good", "same"), ("r", "same", "other")], "pair string, left string, right string")
    counts = {(r["pair"], r["plane"]): r["n"] for r in C.regression_context(log, pairs)["summary"].collect()}
    assert counts == {("p", "flow"): 2, ("p", "network"): 1, ("p", "db"): 1, ("p", "env"): 1, ("r", "network"): 1}


def test_linked_request_context(spark):
    back = [(105, "backend.req.start", {"requestId": "r1", "method": "POST"}), (140, "backend.req.end", {"requestId": "r1", "statusCode": 200}), (120, "backend.http", {"requestId": "r1", "service": "mail"}), (300, "backend.req.start", {"requestId": "r9"})]
    log = telemetry(spark, {"s": [*run(0, 200), *back], "u": run(0, 200)})
    got = api.get_linked_request_context(log, "s", "r1")
    assert got["status"].first()["status"] == "linked"
    assert [(r["plane"], r["k"]) for r in got["rows"].collect()] == [("backend", "backend.req.start"), ("backend", "backend.req.end"), ("db", "db.diff"), ("network", "net.req"), ("network", "net.res"), ("outbound", "backend.http")]
    one = api.get_linked_request_context(log, "s", "r1", limit=1)["rows"].collect()
    assert [(r["plane"], r["matched"]) for r in one] == [("backend", 2), ("db", 1), ("network", 2), ("outbound", 1)]
    asked = spark.createDataFrame([("s", "r1"), ("s", "r9"), ("s", "none"), ("u", "r1")], "session_id string, request_id string")
    status = {(r["session_id"], r["request_id"]): r["status"] for r in C.linked_request_context(log.where("session_id = 's'"), asked)["status"].collect()}
    assert status[("s", "r1")] == "linked" and status[("s", "none")] == "unknown" and status[("s", "r9")] not in ("linked", "unknown")


def test_recurrence(spark):
    bugs = spark.createDataFrame([("s", "x", 2, 1, 5), ("u", "x", 1, 7, 8), ("u", "y", 1, 1, 1)], "session_id string, signature string, occurrences long, first_seen long, last_seen long")
    sessions = spark.createDataFrame([("s", 1, "v1"), ("u", 2, "v2")], "session_id string, start long, release string")
    r = api.get_recurrence(bugs, sessions, "x").first()
    assert (r["session_count"], r["occurrences"], r["first_release"], r["last_release"]) == (2, 3, "v1", "v2") and api.get_recurrence(bugs, sessions, "z").count() == 0


def test_guards_and_aggregates(spark):
    rows = [("b", "high", 1, 2), (None, "high", 1, 2), ("b", None, 1, 2), ("b", "high", None, 2), ("b", "high", 1, None), ("b", "high", 3, 2), ("b", "low", 2, 2)]
    bugs = spark.createDataFrame(rows, "bug_id string, severity string, first_seen long, last_seen long")
    assert bugs.where(P.is_bug_record()).count() == 2
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", None), ("b", 4.0), ("b", 6.0), ("c", None)], "k string, v double")
    assert {r["k"]: (r["median"], r["n"]) for r in A.exact_medians(v, ["k"], "v").collect()} == {"a": (2.0, 4), "b": (5.0, 2), "c": (None, 1)}
    e = spark.createDataFrame([("s", t) for t in (0, 5, 10, 10, 14)], "k string, t long")
    assert sorted((r["t"], r["n"]) for r in A.sliding_counts(e, ["k"], 10).collect()) == [(0, 1), (5, 2), (10, 3), (10, 3), (14, 4)]


def test_routes_without_ids(spark):
    paths = {"/o/deadbeef": "/o/:id", "/o/cafebabe/x": "/o/:id/x", "/facade/decade": "/facade/decade", "/defaced": "/defaced", "/o/a1b2c3": "/o/:id", "/o/12": "/o/:id", "/o/abcdefabcdef": "/o/:id", "/added": "/added"}
    df = spark.createDataFrame([(f"http://x{p}",) for p in paths], "url string")
    assert {r["url"][8:]: r["r"] for r in df.select("url", X.stable_route(df["url"]).alias("r")).collect()} == paths
