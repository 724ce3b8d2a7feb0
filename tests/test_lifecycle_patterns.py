"""Ordered patterns against brute force, and the lifecycle detectors: firing and silent cases, each a session."""

import datetime
import json
import random

import pytest

from evidentia.operators import detectors as D
from evidentia.operators.patterns import Pattern, Step, match_patterns
from tests.test_detectors import diff
from tests.test_detectors_business import call, ins
from tests.test_detectors_screen import telemetry

T = int(datetime.datetime(2026, 7, 28, 22, 35, 24, 906000, tzinfo=datetime.UTC).timestamp() * 1000)


def note(t, order, kind, status="sent"):
    return (t, "db.read", {"table": "notifications", "row": {"id": t, "order_id": order, "type": kind, "status": status}})


def drain(told, st=200):
    return call(100, "drain-1", "POST", "http://x/api/admin/jobs/drain", st=st, told=json.dumps(told))


def attempt(run_at, **d):
    return diff(T, "tick-1", {"id": 1, "status": "pending", "attempts": 0}, {"id": 1, "status": "pending", "attempts": 1, "run_at": run_at, "last_error": "transient failure", **d}, "jobs", 1)


def start(t, rid):
    return (t, "backend.req.start", {"requestId": rid, "method": "POST", "url": "/api/ops/slow-write"})


def end(t, rid, code=401):
    return (t, "backend.req.end", {"requestId": rid, "statusCode": code})


ROTATED = (200, "db.diff", {"requestId": "rotate-1", "op": "delete", "table": "sessions", "pk": {"id": "old"}, "before": {"id": "old"}})


def report(t, n, note, kind="dashboard"):
    return ins(t, "ops_reports", {"id": t, "kind": kind, "rows_returned": n, "note": note}, f"dash-{t}")


#: detector -> (cases that fire, cases that stay silent)
CASES = {
    "notification_lifecycle_order_inverted": (
        [[note(100, 7, "order_cancelled"), note(120, 7, "order_confirmed")]],
        [[note(100, 7, "order_cancelled"), note(120, 8, "order_confirmed")], [note(100, 7, "order_confirmed"), note(120, 7, "order_cancelled")], [note(100, 7, "order_cancelled"), note(120, 7, "order_confirmed", "queued")],
         [note(100, 7, "order_cancelled"), note(110, 7, "order_reopened"), note(120, 7, "order_confirmed")]],
    ),
    "job_drain_left_work_deferred": ([drain({"processed": 0, "deferred": 1, "remaining": 1})], [drain({"processed": 1, "deferred": 0, "remaining": 0}), drain({"processed": 0, "deferred": 1, "remaining": 1}, 500)]),
    "retry_schedule_clock_shift": ([[attempt("2026-07-29T07:35:25.904Z")]], [[attempt("2026-07-28T22:35:25.904Z")], [attempt("2026-07-29T07:05:25.904Z")], [attempt("2026-07-29T07:35:25.904Z", last_error=None)], [attempt("soon")]]),
    "inflight_request_invalidated_by_session_rotation": (
        [[start(100, "slow-1"), ROTATED, end(300, "slow-1")]],
        [[ROTATED, start(250, "late-1"), end(300, "late-1")], [start(100, "slow-1"), ROTATED, end(300, "slow-1", 200)], [start(100, "slow-1"), end(150, "slow-1"), ROTATED], [start(100, "slow-1"), ROTATED, start(210, "b"), end(300, "b")]],
    ),
    "cached_empty_result_after_data_arrived": (
        [[report(100, 0, "cache=skip-empty"), ins(150, "orders", {"id": 1, "status": "placed"}, "seed-1"), report(200, 0, "cache=hit")]],
        [[report(100, 0, "cache=skip-empty"), report(200, 0, "cache=hit")], [report(100, 0, "cache=skip-empty"), ins(150, "orders", {"id": 1}, "seed-1"), report(200, 3, "cache=hit")],
         [report(100, 0, "cache=skip-empty"), ins(150, "orders", {"id": 1}, "seed-1"), report(200, 0, "cache=hit", "sales")], [report(100, 0, "cache=skip-empty"), ins(150, "orders", {"id": 1}, "seed-1"), report(200, 0, "cache=miss")]],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    sessions = {f"{name}/{kind}/{n}": events for name, (fires, silent) in CASES.items() for kind, cases in (("fires", fires), ("silent", silent)) for n, events in enumerate(cases)}
    log = telemetry(spark, sessions).cache()
    return {(r["session_id"], r["detector"]): r for r in D.run_detectors(log, list(CASES)).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_fires_and_stays_silent(found, name):
    fires, silent = CASES[name]
    assert [n for n in range(len(fires)) if (f"{name}/fires/{n}", name) not in found] == []
    assert [n for n in range(len(silent)) if (f"{name}/silent/{n}", name) in found] == []


def test_the_finding_names_its_request(found):
    r = found["inflight_request_invalidated_by_session_rotation/fires/0", "inflight_request_invalidated_by_session_rotation"]
    assert (r["request_id"], r["t"], r["subject"]) == ("slow-1", 300, "request slow-1")


PATTERNS = [
    Pattern("ab", (Step(("a",)), Step(("b",)))),
    Pattern("ab_near", (Step(("a",)), Step(("b",), within_ms=3))),
    Pattern("abc_no_x", (Step(("a",)), Step(("b", "d")), Step(("c",), within_ms=8)), forbidden=("x",)),
    Pattern("a_S_c", (Step(("a",)), Step(("S",), of_session=True), Step(("c",), within_ms=12))),
    Pattern("ab_S_c_no_x", (Step(("a",)), Step(("b",)), Step(("S",), of_session=True), Step(("c", "d"))), forbidden=("x",)),
    Pattern("only_d", (Step(("d",)),)),
]


def completions(rows, p):
    """Brute force: the rows at which a chain of the pattern ends, by trying every chain of the entity."""
    place = lambda r: (r["t"], r["seq"])

    def chains(steps, e):
        *head, step = steps
        between = bool(head) and head[-1].of_session
        before = head[:-1] if between else head
        for r in (r for r in rows if r["symbol"] in step.symbols and r["entity"] == e):
            if not head:
                yield [r]
            for c in chains(before, e) if head else ():
                near = place(c[-1]) < place(r) and (step.within_ms is None or r["t"] - c[-1]["t"] <= step.within_ms)
                met = not between or any(x["symbol"] in head[-1].symbols and place(c[-1]) < place(x) < place(r) for x in rows)
                barred = any(x["symbol"] in p.forbidden and x["entity"] == e and place(c[-1]) < place(x) < place(r) for x in rows)
                if near and met and not barred:
                    yield [*c, r]

    return {(e, p.name, c[-1]["t"], c[-1]["seq"]) for e in {r["entity"] for r in rows if r["entity"]} for c in chains(list(p.steps), e)}


def test_patterns_are_the_brute_force_chains(spark):
    r = random.Random(11)
    sessions = {f"s{s}": [{"entity": None if (sym := r.choice("abcdxS")) == "S" else r.choice("pq"), "t": r.randrange(25), "seq": i, "symbol": sym} for i in range(r.randrange(4, 22))] for s in range(60)}
    flat = [(s, x["entity"], x["t"], x["seq"], x["symbol"]) for s, xs in sessions.items() for x in xs]
    got = {(x["session_id"], x["entity"], x["pattern"], x["t"], x["seq"]) for x in match_patterns(spark.createDataFrame(flat, "session_id string, entity string, t long, seq long, symbol string"), PATTERNS).collect()}
    assert got == {(s, *hit) for s, xs in sessions.items() for p in PATTERNS for hit in completions(xs, p)}
    assert len({g[2] for g in got}) == len(PATTERNS)


def test_steps_of_session_scope_stand_between_steps():
    with pytest.raises(ValueError, match="between"):
        Pattern("p", (Step(("a",), of_session=True), Step(("b",))))
    with pytest.raises(ValueError, match="no bound"):
        Pattern("p", (Step(("a",)), Step(("S",), 5, of_session=True), Step(("b",))))
