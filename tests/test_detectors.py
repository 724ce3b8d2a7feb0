"""Firing and silent cases of the detectors: every case is a session, and one run covers them all."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import detectors as D
from evidentia.sources.telemetry import promote


def read(t, stmt, table="ratings", rid="a", **d):
    return (t, "db.read", {"table": table, "pk": {"id": stmt}, "row": {"rating": 5}, "requestId": rid, **({} if stmt is None else {"stmt": stmt}), **d})


def diff(t, rid, before, after, table="carts", pk=1, op="update"):
    return (t, "db.diff", {"op": op, "table": table, "pk": {"id": pk}, "before": before, "after": after, "requestId": rid})


def req(t, i, url="http://x/api/s?q=a", method="GET", **d):
    return (t, "net.req", {"id": i, "url": url, "method": method, **d})


def res(t, i, st=200, **d):
    return (t, "net.res", {"id": i, "st": st, **d})


def post(t, i, body='{"q":1}'):
    return req(t, i, "http://x/api/cart", "POST", body=body, requestId=i)


def gauges(*totals):
    return [e for n, v in enumerate(totals) for e in ((1000 * n, "nav", {"to": f"/{n}"}), (1000 * n + 100, "ui.listeners", {"total": v}))]


def job(*kinds):
    return [(10 * n, f"backend.job.{k}", {"job": "pay", "jobId": "j1", "requestId": "r1", **({"error": {"message": "gone"}} if k == "error" else {}), **({"outcome": o} if o else {})}) for n, (k, o) in enumerate(kinds)]


def states(*values):
    return [diff(10 * n, f"r{n}", {"status": a}, {"status": b}, "orders") for n, (a, b) in enumerate(zip(values, values[1:], strict=False))]


LOGIN = diff(1, "l", None, {"id": "s1", "user_id": 4}, "sessions", op="insert")


def order_read(t, owner):
    return (t, "db.read", {"table": "orders", "pk": {"id": 1}, "row": {"id": 1, "user_id": owner}, "requestId": "d", "stmt": 1})


#: detector -> (cases that fire, cases that stay silent)
CASES = {
    "n_plus_one_query": ([[read(i, i) for i in range(12)]], [[read(i, 1) for i in range(12)], [read(i, i) for i in range(5)], [read(i, None) for i in range(12)], [read(i, i, "p") for i in range(5)] + [read(9 + i, 9 + i, "q") for i in range(5)]]),
    "lost_update": (
        [[diff(10, "a", {"qty": 1}, {"qty": 2}), diff(20, "b", {"qty": 1}, {"qty": 2})]],
        [[diff(10, "a", {"qty": 1}, {"qty": 2}), diff(20, "b", {"qty": 2}, {"qty": 3})], [diff(10, "a", {"qty": 1}, {"qty": 2}), diff(20, "a", {"qty": 1}, {"qty": 2})], [diff(10, "a", {"qty": 1}, {"qty": 2}), diff(20, "b", {"qty": 1}, {"qty": 2}, pk=2)],
         [diff(10, "a", {"qty": 1}, {"qty": 5}), diff(20, "b", {"qty": 1}, {"qty": 9})], [diff(10, "a", {"updated_at": 1}, {"updated_at": 2}), diff(20, "b", {"updated_at": 1}, {"updated_at": 2})]],
    ),
    "response_race": (
        [[req(100, "a", "http://x/s?q=de"), req(150, "b", "http://x/s?q=desk"), res(200, "b"), res(400, "a")]],
        [[req(100, "a", "http://x/s?q=de"), req(150, "b", "http://x/s?q=desk"), res(200, "a"), res(400, "b")], [req(100, "a", "http://x/s?q=de"), res(200, "a"), req(300, "b", "http://x/s?q=desk"), res(400, "b")],
         [req(100, "a", "http://x/s?q=de"), req(150, "b", "http://x/p?q=desk"), res(200, "b"), res(400, "a")], [req(100, "a", "http://x/s?q=de"), req(150, "b", "http://x/s?q=desk"), res(200, "b"), res(400, "a", 500)]],
    ),
    "concurrent_duplicate_mutation": ([[post(100, "a"), post(101, "b"), res(140, "a"), res(141, "b")]], [[post(100, "a"), res(140, "a"), post(200, "b"), res(240, "b")], [post(100, "a"), post(101, "b"), res(140, "a"), res(141, "b", 500)], [post(100, "a"), post(101, "b", '{"q":2}'), res(140, "a"), res(141, "b")]]),
    "retry_loop_against_success": ([[e for n in range(5) for e in (post(100 * n, f"i{n}"), res(100 * n + 9, f"i{n}"))]], [[e for n in range(2) for e in (post(100 * n, f"i{n}"), res(100 * n + 9, f"i{n}"))], [e for n in range(5) for e in (post(100 * n, f"i{n}"), res(100 * n + 9, f"i{n}", 500 if n == 2 else 200))]]),
    "latency_outlier": ([[e for n in range(11) for e in (req(n, f"i{n}"), res(n + 9, f"i{n}", dur=789 if n == 5 else 15))]], [[e for n in range(4) for e in (req(n, f"i{n}"), res(n + 9, f"i{n}", dur=789 if n == 3 else 15))], [e for n in range(11) for e in (req(n, f"i{n}"), res(n + 9, f"i{n}", dur=4 if n == 5 else 0.1))]]),
    "listener_growth": ([gauges(20, 60, 110)], [gauges(100, 120, 140), gauges(4, 8, 12), gauges(20, 200, 110), gauges(20, 110)]),
    "layout_overflow": ([[(1, "ui.layout", {"overflowX": 25, "url": "/c", "dir": "rtl"})]], [[(1, "ui.layout", {"overflowX": 24, "url": "/c"})]]),
    "job_did_not_complete": ([job(("start", None), ("error", "failure")), job(("start", None)), job(("start", None), ("end", "skipped"))], [job(("start", None), ("end", "success")), job(("start", None), ("end", None))]),
    "state_flip_flop": ([states("placed", "delivered", "placed")], [states("placed", "paid", "shipped"), [diff(1, "a", {"status": "true"}, {"status": "false"}), diff(2, "b", {"status": "false"}, {"status": "true"})]]),
    "cross_user_read": ([[LOGIN, order_read(5, 1)]], [[LOGIN, order_read(5, 4)], [order_read(5, 1)], [LOGIN, diff(2, "m", None, {"user_id": 1}, "sessions", op="insert"), order_read(5, 1)]]),
    "duplicate_write": ([[diff(n, "a", None, {"id": n, "text": "hi"}, "notes", n, "insert") for n in (1, 2)]], [[diff(n, "a", None, {"id": n, "user_id": 3}, "likes", n, "insert") for n in (1, 2)], [diff(n, f"r{n}", None, {"id": n, "text": "hi"}, "notes", n, "insert") for n in (1, 2)]]),
    "acknowledged_write_never_landed": ([[post(1, "a"), res(2, "a", 201), diff(3, "z", {"q": 1}, {"q": 2})]], [[post(1, "a"), res(2, "a", 200), diff(3, "z", {"q": 1}, {"q": 2})], [post(1, "a"), res(2, "a", 201)], [post(1, "a"), diff(2, "a", {"q": 1}, {"q": 2}), res(3, "a", 201)]]),
    "stored_active_markup": ([[diff(1, "a", None, {"bio": "<img src=x onerror=go()>"}, op="insert")]], [[diff(1, "a", None, {"bio": "<b>bold</b> prose on = x"}, op="insert")]]),
    "interpolation_artifact": ([[diff(1, "a", None, {"m": v}, op="insert")] for v in ("Hello undefined, welcome", "Total: NaN", "[object Object]", "Dear {{name}}")], [[diff(1, "a", None, {"m": v}, op="insert")] for v in ("behaviour is undefined in this case", "a NaNny state", "5")]),
    "pagination_first_page_offset": ([[req(1, "b", "http://x/p?page=1", requestId="a"), read(2, 1, q={"limit": 10, "offset": 5})]], [[req(1, "b", "http://x/p?page=2", requestId="a"), read(2, 1, q={"limit": 10, "offset": 5})], [req(1, "b", "http://x/p", requestId="a"), read(2, 1, q={"limit": 10, "offset": 10})], [req(1, "b", "http://x/p", requestId="a"), read(2, 1, q={"limit": 1, "offset": 1})]]),
    "repeated_clicks": ([[(n * 1000, "clk", {"el": {"sig": "s"}}) for n in range(3)]], [[(n * 1000, "clk", {"el": {"sig": "s"}}) for n in range(2)], [(n * 2000, "clk", {"el": {"sig": "s"}}) for n in range(3)]]),
    "backend_http_client_error": ([[(1, "backend.req.end", {"requestId": "r", "statusCode": 404})]], [[(1, "backend.req.end", {"requestId": "r", "statusCode": 204})], [(1, "backend.req.error", {"requestId": "r"}), (2, "backend.req.end", {"requestId": "r", "statusCode": 404})]]),
    "backend_request_error": ([[(5, "backend.req.end", {"requestId": "r", "statusCode": 500}), (6, "backend.req.error", {"requestId": "r"})]], [[(1, "backend.req.end", {"requestId": "r", "statusCode": 500})]]),
    "app_2xx_failure": ([[req(1, "a"), res(2, "a", body='{"ok": false}')], [req(1, "a"), res(2, "a", body={"status": "failed"})]], [[req(1, "a"), res(2, "a", body={"ok": True})]]),
    "otel_log_error": ([[(1, "backend.otel.log", {"severityNumber": 17, "body": "x"})]], [[(1, "backend.otel.log", {"severityNumber": 9, "body": "x"})]]),
    "otel_span_error": ([[(1, "backend.otel.span", {"statusCode": "ERROR"})], [(1, "backend.otel.span", {"attributes": {"http.status_code": 503}})]], [[(1, "backend.otel.span", {"statusCode": "OK"})]]),
    "pending_request": ([[req(1, "a")]], [[req(1, "a"), res(2, "a")]]),
    "slow_request": ([[req(1, "a"), res(7000, "a", dur=6000)]], [[req(1, "a"), res(70, "a", dur=60)]]),
}


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for name, (fires, silent) in CASES.items():
        for kind, cases in (("fires", fires), ("silent", silent)):
            for n, events in enumerate(cases):
                rows += [(f"{name}/{kind}/{n}", seq, t, k, json.dumps(d)) for seq, (t, k, d) in enumerate(events)]
    raw = spark.createDataFrame(rows, "session_id string, seq long, t long, k string, d string")
    return promote(raw.withColumn("d", F.parse_json("d"))).cache()


def test_detectors_fire_and_stay_silent(log):
    got = {}
    for name in D.DETECTORS:
        for r in D.DETECTORS[name](log).select("session_id", "detector").distinct().collect():
            got.setdefault(r["session_id"], set()).add(r["detector"])
    for name, (fires, silent) in CASES.items():
        for n in range(len(fires)):
            assert name in got.get(f"{name}/fires/{n}", ()), (name, n)
        for n in range(len(silent)):
            assert name not in got.get(f"{name}/silent/{n}", ()), (name, n)


def test_db_mutation_scores(spark):
    def score(*events):
        rows = [("s", seq, t, k, json.dumps(d)) for seq, (t, k, d) in enumerate(events)]
        e = promote(spark.createDataFrame(rows, "session_id string, seq long, t long, k string, d string").withColumn("d", F.parse_json("d")))
        return [r["score"] for r in D.db_mutation(e).collect()]

    write = diff(1000, "a", {"q": 1}, {"q": 2})
    assert score(write) == [40]
    assert score(write, (1500, "err", {"msg": "x"})) == [64]
    assert score(write, (9000, "err", {"msg": "x"})) == [40]
    assert score(write, (1500, "net.err", {"id": "i", "requestId": "a"})) == [88]
    assert score(write, (1500, "net.err", {"id": "i", "requestId": "other"})) == [40]


def test_candidates_are_deduplicated_and_rationed(spark):
    rows = [("s", n, n, "err", json.dumps({"msg": f"boom {'abcdefghij'[n % 10]}"})) for n in range(40)] + [("s", 99, 99, "rej", json.dumps({"msg": "late"}))]
    e = promote(spark.createDataFrame(rows, "session_id string, seq long, t long, k string, d string").withColumn("d", F.parse_json("d")))
    out = D.evidence_candidates(e, ["uncaught_error", "unhandled_rejection"], most=4).collect()
    assert len(out) == 4 and {r["detector"] for r in out} == {"uncaught_error", "unhandled_rejection"}
    assert all(r["occurrences"] == 4 and r["t"] < 10 for r in out if r["detector"] == "uncaught_error")
